"""Text quality from random-indexing word vectors and a two-layer network.

Every word has a sparse random index vector that follows from its hash. The
vector of a word is the sum of the index vectors of its neighbours in all
training documents; a word outside the vocabulary has its own index vector. A document is the mean of its word vectors, beside the mean of the
index vectors of its word shapes and pairs of equal neighbours. A two-layer NumPy network, trained on a
bounded sample of labelled documents, gives a probability; a temperature fitted
on documents the network never saw calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.llm.shared import Scratch

SAMPLE = 8000
DIM = 64
NONZERO = 4
WINDOW = 2
LEAST_COUNT = 3
VOCABULARY = 30_000
HIDDEN = 32
EPOCHS = 60
SLICE_BYTES = 8 << 20
NEIGHBOUR_BYTES = 1 << 20
SHAPE_TABLE = np.full(256, ord("o"), np.uint8)
SHAPE_TABLE[ord("a") : ord("z") + 1] = ord("a")
SHAPE_TABLE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE_TABLE[ord("0") : ord("9") + 1] = ord("0")
SHAPE_TABLE[128:] = ord("a")  # bytes of letters beyond ASCII, mostly
SHAPE_TABLE[33:48] = np.arange(33, 48)


def index_vectors(hashes: np.ndarray, dim: int = DIM, nonzero: int = NONZERO) -> np.ndarray:
    """Sparse vectors of +1 and -1, fixed by the hash."""
    out = np.zeros((len(hashes), dim), np.float32)
    h, rows = hashes.astype(np.uint64), np.arange(len(hashes))
    for k in range(nonzero):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(k)
        out[rows, (h >> np.uint64(40)).astype(np.int64) % dim] += np.where((h >> np.uint64(39)) & np.uint64(1), 1, -1)
    return out


def _hash(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _shapes(words: list[str]) -> tuple[list[str], np.ndarray]:
    """(distinct shapes, shape of each word): runs of character classes over whole words, upper, lower, digit, and ASCII marks as they are."""
    packed = pa.array(words, pa.large_binary())
    ends = np.frombuffer(packed.buffers()[1], np.int64)[: len(words) + 1]
    if ends[-1] == 0:
        return ([""] if words else []), np.zeros(len(words), np.int64)
    kind = SHAPE_TABLE[np.frombuffer(packed.buffers()[2], np.uint8)[: ends[-1]]]
    starts = np.concatenate([[True], kind[1:] != kind[:-1]])
    starts[ends[:-1][ends[:-1] < ends[-1]]] = True
    kept = np.concatenate([[0], np.cumsum(starts)])[ends]
    runs = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(kept), pa.py_buffer(kind[starts])]).dictionary_encode()
    return [s.decode() for s in runs.dictionary.to_pylist()], runs.indices.to_numpy(zero_copy_only=False)


def _shape(word: str) -> str:
    return _shapes([word])[0][0]


def word_codes(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, code of each word, bounds of each text) of whole texts; empty words fall out."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)[full], ends[offsets]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of whole texts of about ``most`` bytes; a longer text is one by itself."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, upto - at)
        at = upto


def _means(values: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of ``values[codes]`` over each text, summed in blocks of words that fit the cache."""
    out = np.zeros((len(bounds) - 1, values.shape[1]), np.float32)
    step = 1 << 13
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for s in range(0, len(codes), step):
        t = text[s : s + step]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        out[t[first]] += np.add.reduceat(values[codes[s : s + step]], first, axis=0)
    return out / np.maximum(np.diff(bounds), 1)[:, None]


@dataclass
class Model:
    hashes: np.ndarray  # sorted word hashes
    vectors: np.ndarray  # their context vectors, unit length
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def features(self, texts: pa.Array) -> np.ndarray:
        words, codes, bounds = word_codes(texts)
        if not words:
            return np.zeros((len(texts), 3 * DIM + 3), np.float32)
        h = _hash(words)
        own = index_vectors(h) / np.float32(np.sqrt(NONZERO))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            own[hit] = self.vectors[at[hit]]
        kinds, kind_of = _shapes(words)
        shaped = index_vectors(_hash(kinds))
        n = np.diff(bounds)
        pooled, form = _means(own, codes, bounds), _means(shaped, kind_of[codes], bounds)
        same = np.concatenate([[False], codes[1:] == codes[:-1]]).astype(np.float32)[:, None] if len(codes) else np.zeros((0, 1), np.float32)
        again = _means(same, np.arange(len(codes)), bounds)
        lens = np.array([len(w) for w in words], np.float32)[:, None]
        length = _means(lens, codes, bounds)
        return np.hstack([pooled, form, form**2, again, np.log1p(n)[:, None].astype(np.float32), length])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((x - self.mean) / self.spread @ w1 + b1) @ w2 + b2)[:, 0]

    def score(self, texts: pa.Array) -> np.ndarray:
        out = [self.logits(self.features(part)) for part in slices(texts)]
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30)))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice of texts: (word hash, count)."""
    for batch in batches:
        for part in slices(batch.column(0)):
            words, codes, _ = word_codes(part)
            if len(codes):
                yield pa.record_batch([pa.array(_hash(words).view(np.int64)), pa.array(np.bincount(codes, minlength=len(words)))], names=["h", "n"])


def _neighbour_sums(known: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (word hash, summed index vectors of its neighbours) for the words in ``known`` (sorted).

    Index vectors are sparse, so each neighbour adds its few entries to the
    cells of its word, and a slice's entries are summed in one count.
    """
    sums = np.zeros(len(known) * DIM)
    for batch in batches:
        for part in slices(batch.column(0), NEIGHBOUR_BYTES):
            words, codes, bounds = word_codes(part)
            if not len(codes):
                continue
            h = _hash(words)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            cell = np.where(known[at] == h, at * DIM, -1)[codes]
            index = index_vectors(h)
            entry = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]  # entries that are not zero come first
            sign = np.take_along_axis(index, entry, 1)
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            cells, signs = [], []
            for d in range(1, WINDOW + 1):
                for own, other in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
                    near = (text[own] == text[other]) & (cell[own] >= 0)
                    cells.append((cell[own][near][:, None] + entry[codes[other][near]]).reshape(-1))
                    signs.append(sign[codes[other][near]].reshape(-1))
            sums += np.bincount(np.concatenate(cells), np.concatenate(signs), len(sums))
    sums = sums.reshape(-1, DIM)
    seen = np.flatnonzero(sums.any(1))
    for at in np.array_split(seen, max(1, len(seen) // 4096)):
        yield pa.record_batch([pa.array(known[at].view(np.int64)), pa.array(list(sums[at]), pa.list_(pa.float64()))], names=["h", "v"])


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 3) -> list[np.ndarray]:
    """Two layers by Adam on the logistic loss, classes weighted to equal mass up to a square root."""
    rng = np.random.default_rng(seed)
    p = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, 1)) / np.sqrt(hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            a = np.tanh(x[rows] @ p[0] + p[1])
            q = 1 / (1 + np.exp(-np.clip((a @ p[2] + p[3])[:, 0], -30, 30)))
            d = ((q - y[rows]) / len(rows))[:, None]
            back = (d @ p[2].T) * (1 - a * a)
            grads = [x[rows].T @ back + 1e-4 * p[0], back.sum(0), a.T @ d + 1e-4 * p[2], d.sum(0)]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` labelled documents, picked by a hash of the id; None without both labels.

    ``train`` is a condition on the id. Words are counted and neighbours summed
    over all documents it holds for, labelled or not; the driver gets the vectors
    of the ``VOCABULARY`` most frequent words, of those that occur at least
    ``LEAST_COUNT`` times, and one feature row a sampled document. Of repeated
    ids the smallest label and smallest text count. A fifth of the sample fits
    the temperature.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    marked = labels.where(train & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("y"))
    picked = marked.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample)
    named = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = scratch.keep(named.join(picked, "id").groupBy("id", "y").agg(F.min("text").alias("text")).repartition(spark.sparkContext.defaultParallelism, "id"), "sample")
    texts = docs.where(train & F.col(text).isNotNull()).select(F.col(text).alias("text"))
    counted = texts.mapInArrow(_word_counts, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    known = np.sort(counted.orderBy(F.desc("n"), "h").limit(VOCABULARY).toPandas()["h"].to_numpy(np.int64).view(np.uint64))
    near = texts.mapInArrow(partial(_neighbour_sums, known), "h bigint, v array<double>") if len(known) else spark.createDataFrame([], "h bigint, v array<double>")
    sums = near.groupBy("h").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(DIM)]).toPandas()
    sums = sums.assign(u=sums["h"].to_numpy(np.int64).view(np.uint64)).sort_values("u")
    vectors = sums[[f"v{i}" for i in range(DIM)]].to_numpy(np.float32)
    vectors = vectors / np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-9)
    model = Model(sums["u"].to_numpy(), vectors, np.zeros(1), np.ones(1), [], 1.0)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([shared.value.features(part) for part in slices(batch.column(1))]) if len(batch) else np.zeros((0, 1))
            yield pa.record_batch([batch.column(0).cast(pa.string()), batch.column(2).cast(pa.int32()), pa.array([r.tolist() for r in x], pa.list_(pa.float32()))], names=["id", "y", "x"])

    made = rows.select("id", "text", "y").mapInArrow(featured, "id string, y int, x array<float>").toPandas().sort_values("id")
    if made["y"].nunique() < 2:
        return None
    x, y = np.stack(list(made["x"])).astype(np.float64), made["y"].to_numpy().astype(np.float64)
    model.mean, model.spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = (x - model.mean) / model.spread
    part = np.arange(len(x)) % 5 == 0
    model.layers = train_network(x[~part], y[~part])
    z = (np.tanh(x[part] @ model.layers[0] + model.layers[1]) @ model.layers[2] + model.layers[3])[:, 0]

    def loss(t: float) -> float:
        return float(np.logaddexp(0, np.where(y[part] > 0, -z, z) / t).mean())

    model.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return model


def score_quality(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with __score, the calibrated probability of label 1, over whole texts.

    A null or empty text has the score of no words at all; without a model every
    score is 0.5. Repeated rows are each scored, an empty table gives no rows,
    and a column named __score must not be there already.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType(list(df.schema.fields)).add("__score", "double")
    at = df.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = m.score(batch.column(at)) if m is not None else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s.astype(np.float64))], names=[*batch.schema.names, "__score"])

    return df.mapInArrow(score, schema)
