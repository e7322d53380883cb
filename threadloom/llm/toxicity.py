"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the bag of itself and its character n-grams between boundary marks;
every member is hashed to a row of one embedding table. A word vector is the
mean of its rows, a document vector the mean of its word vectors, and a linear
softmax over two classes reads the document vector. Table and softmax are
trained jointly in NumPy, so a misspelling that was never seen still shares the
n-grams of the word it comes from. How far a row may move follows the log ratio
of its shares in both classes, which keeps chance n-grams of a small sample out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.llm.quality import slices, word_codes
from threadloom.llm.shared import Scratch

BUCKETS = 1 << 18
DIM = 4
GRAMS = (3, 4, 5, 6)
SAMPLE = 1500
FIT_BYTES = 16_384
PSEUDO = 100  # words of a zero vector that every mean starts with, so a few words decide less than many
PRIOR_DOCS = 30.0  # documents of no class that every row has seen
LEAST_DOCS = 3
EPOCHS = 8
RATE = 20.0
DAMPING = 0.99  # quantile of the rows' gradients below which steps are damped
BATCH_DOCS = 64
WORDS_AT_ONCE = 1 << 14
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def folded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, code of each word, bounds of each text): runs of letters and digits of whole texts in lower case."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    return word_codes(pc.replace_substring_regex(lower, r"[^\p{L}\p{N}]+", " "))


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, owners): the rows of the embedding table that each word's bag holds, and the word each belongs to."""
    marked = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    power = np.cumprod(np.full(int(sizes.max(initial=1)), _PRIME, np.uint64))
    whole = np.add.reduceat(marked * power[np.arange(len(marked)) - (ends - sizes)[owner]], ends - sizes) if len(words) else marked
    hashes, owners, h = [whole], [np.arange(len(words))], marked
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * _PRIME + marked[n - 1 :] if len(h) else h
        if n in GRAMS:
            inside = owner[: len(h)] == owner[n - 1 :]
            hashes.append(h[inside] + np.uint64(n))
            owners.append(owner[: len(h)][inside])
    mixed = np.concatenate(hashes) * _MIX
    return ((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(46)).astype(np.int64) % BUCKETS, np.concatenate(owners)


def _summed(values: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(owner, values[:, d], size) for d in range(values.shape[1])], 1)


@dataclass
class Model:
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def word_vectors(self, words: list[str]) -> np.ndarray:
        out = [np.zeros((0, self.table.shape[1]))]
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            rows, owner = word_grams(part)
            out.append(_summed(self.table[rows], owner, len(part)) / np.bincount(owner, minlength=len(part))[:, None])
        return np.concatenate(out)

    def text_vectors(self, texts: pa.Array) -> np.ndarray:
        words, codes, bounds = folded_words(texts)
        n = np.diff(bounds)
        text, vectors = np.repeat(np.arange(len(n)), n), self.word_vectors(words)
        return np.stack([np.bincount(text, vectors[codes, d], len(n)) for d in range(self.table.shape[1])], 1) / (n + PSEUDO)[:, None]

    def score(self, texts: pa.Array) -> np.ndarray:
        logits = [(v @ self.weights + self.bias) @ np.array([-1.0, 1.0]) for v in (self.text_vectors(p) for p in slices(texts))]
        return probability(self.slope * np.concatenate(logits) + self.offset) if logits else np.zeros(0)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the table, their weights in the document's mean) of each text."""
    words, codes, bounds = folded_words(texts)
    rows, owner = word_grams(words)
    order = np.argsort(owner, kind="stable")
    rows, sizes = rows[order].astype(np.int32), np.bincount(owner, minlength=len(words))
    starts = np.cumsum(sizes) - sizes
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        seen, times = np.unique(codes[s:e], return_counts=True)
        many = sizes[seen]
        at = np.arange(many.sum()) + np.repeat(starts[seen] - (np.cumsum(many) - many), many)
        held, where = np.unique(rows[at], return_inverse=True)
        yield held, np.bincount(where, np.repeat(times / many, many), len(held)).astype(np.float32) / (e - s + PSEUDO)


def row_scales(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Squared log ratio of each row's shares of documents in both classes; 0 for rows of fewer than ``LEAST_DOCS`` documents."""
    share = [float((y == v).mean()) for v in (0, 1)]
    seen = [np.bincount(np.concatenate([np.zeros(0, np.int32), *[r for r, c in zip(rows, y, strict=True) if c == v]]), minlength=BUCKETS) for v in (0, 1)]
    ratio = np.log((seen[1] / share[1] + PRIOR_DOCS) / (seen[0] / share[0] + PRIOR_DOCS))
    return np.where(seen[0] + seen[1] >= LEAST_DOCS, ratio * ratio, 0).astype(np.float32)


def train(rows: list[np.ndarray], weights: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Embedding table and softmax by damped Adagrad on the cross-entropy, both classes with equal mass. ``y`` holds both labels."""
    rng = np.random.default_rng(seed)
    half = rng.standard_normal((DIM, 1))
    model = Model(np.zeros((BUCKETS, DIM), np.float32), np.hstack([half, -half]), np.zeros(2))
    seen, seen_w, seen_b = np.zeros((BUCKETS, DIM), np.float32), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    scale, share = row_scales(rows, y), np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    batches = []
    for docs in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH_DOCS)):
        every, w = np.concatenate([rows[d] for d in docs]), np.concatenate([weights[d] for d in docs])
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), [len(rows[d]) for d in docs])
        moving = scale[every] > 0
        held, where = np.unique(every[moving], return_inverse=True)
        batches.append((docs, held, where.astype(np.int32), w[moving] * scale[every[moving]], owner[moving]))
    damp = 0.0
    for epoch in range(-1, epochs):  # the first pass only measures gradients
        for b in rng.permutation(len(batches)):
            docs, held, where, w, owner = batches[b]
            mean = _summed(model.table[held][where] * w[:, None], owner, len(docs))
            z = mean @ model.weights + model.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - np.stack([1 - y[docs], y[docs]], 1)) * (share[docs] / len(docs))[:, None]
            back = (d @ model.weights.T).astype(np.float32)
            grad = _summed(back[owner] * w[:, None], where, len(held)).astype(np.float32)
            seen[held] += grad * grad
            if epoch < 0:
                continue
            model.table[held] -= RATE * grad / (np.sqrt(seen[held]) + damp)
            for g, sums, value in ((mean.T @ d, seen_w, model.weights), (d.sum(0), seen_b, model.bias)):
                sums += g * g
                value -= 0.1 * g / np.sqrt(sums)
        if epoch < 0:
            damp = max(float(np.quantile(np.sqrt(seen[scale > 0].max(1)), DAMPING)), 1e-12) if (scale > 0).any() else 1e-12
    model.table *= scale[:, None]
    return model


def _calibrated(model: Model, z: np.ndarray, y: np.ndarray, share: np.ndarray) -> Model:
    """Slope and offset of the logit by Newton steps on the cross-entropy with the weights of all labelled rows, with a slight pull to slope 1."""
    a, b, scale = 1.0, 0.0, max(float(np.std(z)), 1e-6)
    x = z / scale
    a = scale
    for _ in range(50):
        p = probability(a * x + b)
        g, h = share * (p - y), share * p * (1 - p)
        grad = np.array([(g * x).sum() + 1e-2 * a, g.sum() + 1e-3 * b])
        hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        move = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    model.slope, model.offset = max(a, 1e-3) / scale, b
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` documents of each label, picked by a hash of the id; None without both labels.

    ``train_rows`` is a condition on ``labels``. Texts over ``FIT_BYTES`` bytes are
    left out of the fit (not of scoring), so the fit is bounded in bytes. Of
    repeated ids the smallest label and smallest text count; null ids and texts
    don't. A fifth of the sample calibrates the logit to the shares of both
    labels among all labelled rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.where(train_rows & F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
    marked = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("int").alias("y"))
    short = docs.where(F.col(text).isNotNull() & (F.octet_length(text) <= FIT_BYTES)).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    at = F.xxhash64(F.col("id").cast("string"))
    # Ids are picked before texts move: the bounded top of each label, then one join.
    ids = scratch.keep(short.select("id").distinct().join(marked, "id").withColumn("at", at), "ids")
    sizes = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    tops = [ids.where(F.col("y") == v).orderBy("at", "id").limit(sample) for v in (0, 1)]
    picked = scratch.keep(tops[0].unionByName(tops[1]), "picked")
    rows = short.join(picked.select("id", "y"), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bag for part in slices(batch.column(1)) for bag in bags(part)]
            yield pa.record_batch(
                [batch.column(0).cast(pa.string()), batch.column(2), pa.array([r for r, _ in made], pa.list_(pa.int32())), pa.array([w for _, w in made], pa.list_(pa.float32()))],
                names=["id", "y", "r", "w"],
            )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, r, w = [], [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
            for column, out in ((batch.column(2), r), (batch.column(3), w)):
                out += [column[i].values.to_numpy().copy() for i in range(len(batch))]
        if ids:
            order = sorted(range(len(ids)), key=ids.__getitem__)
            model = _fit_sample([r[i] for i in order], [w[i] for i in order], np.array([y[i] for i in order], np.float64), sizes)
            yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # The sample is bounded in rows and bytes: one task trains, and the driver gets the model alone.
    bagged = rows.select("id", "text", "y").mapInArrow(featured, "id string, y int, r array<int>, w array<float>")
    found = bagged.repartition(1).mapInArrow(fitted, "model binary").first()
    return pickle.loads(found["model"]) if found else None


def _fit_sample(r: list[np.ndarray], w: list[np.ndarray], y: np.ndarray, sizes: dict[int, int]) -> Model | None:
    """Trains on four fifths of the sample and calibrates on the rest."""
    if len(np.unique(y)) < 2:
        return None
    part = np.arange(len(y)) % 5 == 0
    if len(np.unique(y[~part])) < 2 or len(np.unique(y[part])) < 2:
        part = np.zeros(len(y), bool)
    fit = np.flatnonzero(~part)
    model = train([r[i] for i in fit], [w[i] for i in fit], y[fit])
    held = np.flatnonzero(part) if part.any() else fit
    z = np.array([(w[i] @ model.table[r[i]].astype(np.float64) @ model.weights + model.bias) @ np.array([-1.0, 1.0]) for i in held])
    total = sum(sizes.values())
    share = np.where(y[held] > 0, sizes[1] / total / max(y[held].mean(), 1e-9), sizes[0] / total / max(1 - y[held].mean(), 1e-9))
    return _calibrated(model, z, y[held], share)


def score_toxicity(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with __score, the calibrated probability of label 1, over whole texts.

    Null and empty texts and texts without letters or digits have the score of
    the zero vector; without a model every score is 0.5. Repeated rows are each
    scored; a column named __score must not be there already.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    schema = StructType(list(df.schema.fields)).add("__score", "double")
    at = df.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = m.score(batch.column(at)) if m is not None else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s.astype(np.float64))], names=[*batch.schema.names, "__score"])

    return df.mapInArrow(score, schema)
