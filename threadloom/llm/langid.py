"""Language identification by interpolated Kneser-Ney character models.

Each language has an n-gram model over lower-cased code points. The n-grams of
all languages lie in one sorted array of 64-bit hashes per order, beside a row
of interpolated log probabilities; unseen n-grams back off through sorted
arrays of contexts. The language with the lowest length-normalised
cross-entropy wins. On a part of the labelled sample that the counts never saw,
a scale for the confidence and a limit of cross-entropy per language are
calibrated; a text above the limit is rejected. The limit follows a high
quantile of each language's own texts, not the worst one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from threadloom.llm.shared import Scratch, lean

ORDER = 4
PER_LANGUAGE = 400
CALIBRATE = 4
CHUNK = 1 << 20
SYMBOLS = float(1 << 16)
HIGH = 0.95
FACTOR = 3.0
LEAST_MARGIN, LEAST_SPREAD = 0.5, 8.0
SCARCE = 40.0
UNKNOWN = "und"
COEFFICIENTS = np.random.default_rng(20).integers(0, 1 << 63, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def fold_text(text: str) -> str:
    """Lower case; runs of white space are one space."""
    return " ".join(text.lower().split())


def code_points(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    x[(x >= 48) & (x <= 57)] = 48
    return x


def gram_keys(x: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """keys[k - 1][i]: hash of the k-gram that ends at i, of an array padded with ``order`` symbols in front."""
    out, total = [], np.zeros(len(x), np.uint64)
    for k in range(order):
        shifted = np.zeros(len(x), np.uint64)
        shifted[k:] = x[: len(x) - k]
        total = total + (shifted + np.uint64(1)) * COEFFICIENTS[k]
        out.append(_mix(total + np.uint64(k)))
    return out


def _padded(text: str, before: str = "") -> np.ndarray:
    return code_points((" " * ORDER + before)[-ORDER:] + text)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct highest-order n-grams of each language in a batch, with the keys of their parts."""
    for part in batches:
        for lang, texts in part.groupby("lang")["text"]:
            for text in texts:
                folded = fold_text(text)
                for s in range(0, len(folded), CHUNK):
                    keys = gram_keys(_padded(folded[s : s + CHUNK], folded[max(0, s - ORDER) : s]))
                    top, first, n = np.unique(keys[-1][ORDER:], return_index=True, return_counts=True)
                    at = first + ORDER
                    row = {"lang": lang, "g": top.view(np.int64), "n": n}
                    for k in range(1, ORDER):
                        row[f"s{k}"] = keys[k - 1][at].view(np.int64)
                        row[f"c{k}"] = keys[k - 1][at - 1].view(np.int64)
                    yield pd.DataFrame(row)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # by order from 1: sorted hashes
    logs: list[np.ndarray]  # (keys, languages): interpolated log probability
    contexts: list[np.ndarray]  # by order: sorted hashes of contexts (order 1: none)
    weights: list[np.ndarray]  # (contexts, languages): log of what is left to the lower order
    floor: np.ndarray
    scale: float = 1.0
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    margin: np.ndarray | None = None

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(positions, languages) of an array with ``ORDER`` symbols of context in front."""
        keys = [k[ORDER:] for k in gram_keys(x)]
        before = [k[ORDER - 1 : -1] for k in gram_keys(x)]
        out = np.zeros((len(keys[0]), len(self.languages)), np.float32)
        todo = np.arange(len(out))
        for k in range(ORDER, 0, -1):
            at, hit = _find(self.keys[k - 1], keys[k - 1][todo])
            out[todo[hit]] += self.logs[k - 1][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            if k > 1:
                at, hit = _find(self.contexts[k - 1], before[k - 2][todo])
                out[todo[hit]] += self.weights[k - 1][at[hit]]
        out[todo] += self.floor
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) mean negative log probability a symbol, and the symbols of each text. Whole texts, in chunks."""
        total, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        group: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if group:
                logs = self.log_probabilities(np.concatenate([g for _, g in group]))
                ends = np.cumsum([len(g) for _, g in group])
                for (i, g), e in zip(group, ends, strict=True):
                    # The first text's context is the array's; the others' lie between the texts.
                    total[i] -= logs[e - len(g) : e - ORDER].sum(axis=0, dtype=np.float64)
                group.clear()

        held = 0
        for i, text in enumerate(texts):
            folded = fold_text(text)
            sizes[i] = len(folded)
            for s in range(0, len(folded), CHUNK):
                piece = _padded(folded[s : s + CHUNK], folded[max(0, s - ORDER) : s])
                group.append((i, piece))
                held += len(piece)
                if held >= CHUNK:
                    flush()
                    held = 0
        flush()
        return total / np.maximum(sizes, 1)[:, None], sizes

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Best language, its confidence, and whether the text is rejected."""
        ce, n = self.entropies(texts)
        best = ce.argmin(axis=1)
        z = -self.scale * (ce - ce.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(n, 1))[:, None]
        p = 1 / np.exp(z).sum(axis=1)
        limit = self.centre[best] + self.margin[best] + self.spread[best] / np.sqrt(np.maximum(n, 1))
        return [self.languages[i] for i in best], p, ce[np.arange(len(best)), best] > limit


def _kneser_ney(rows: pd.DataFrame, languages: list[str]) -> Model:
    """``rows``: one row a language and distinct highest-order n-gram; its size follows the bounded sample."""
    count, lang = len(languages), rows["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()
    model = Model(languages, [None] * ORDER, [None] * ORDER, [None] * ORDER, [None] * ORDER, np.full(count, -np.log(SYMBOLS), np.float32))
    lower: np.ndarray | None = None
    for k in range(1, ORDER + 1):
        gram = rows["g" if k == ORDER else f"s{k}"].to_numpy().view(np.uint64)
        keys, at = np.unique(gram, return_inverse=True)
        c = np.zeros((len(keys), count))
        # Highest order: counts. Below: in how many distinct longer n-grams it ends, of the next order.
        if k == ORDER:
            np.add.at(c, (at, lang), rows["n"].to_numpy())
        else:
            longer = rows["g" if k + 1 == ORDER else f"s{k + 1}"].to_numpy()
            seen = pd.DataFrame({"l": lang, "x": longer, "at": at}).drop_duplicates()
            np.add.at(c, (seen["at"].to_numpy(), seen["l"].to_numpy()), 1)
        first = np.zeros(len(keys), np.int64)
        first[at[::-1]] = np.arange(len(at))[::-1]
        n1, n2 = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.where(n1 > 0, n1 / np.maximum(n1 + 2.0 * n2, 1), 0.5)
        if k == 1:
            total = np.maximum(c.sum(0), 1)
            left = np.maximum(discount * (c > 0).sum(0), 0.5) / total
            p = np.maximum(c - discount, 0) / total + left / SYMBOLS
            model.floor = np.log(left / SYMBOLS).astype(np.float32)
        else:
            ctx, of = np.unique(rows[f"c{k - 1}"].to_numpy().view(np.uint64)[first], return_inverse=True)
            total, kinds = np.zeros((len(ctx), count)), np.zeros((len(ctx), count))
            np.add.at(total, of, c)
            np.add.at(kinds, of, c > 0)
            left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            suffix = rows[f"s{k - 1}"].to_numpy().view(np.uint64)[first]
            below = lower[np.searchsorted(model.keys[k - 2], suffix)]
            p = np.where(total[of] > 0, np.maximum(c - discount, 0) / np.maximum(total[of], 1), 0) + left[of] * below
            model.contexts[k - 1], model.weights[k - 1] = ctx, np.log(np.maximum(left, 1e-12)).astype(np.float32)
        model.keys[k - 1], model.logs[k - 1], lower = keys, np.log(np.maximum(p, 1e-30)).astype(np.float32), p
    return model


def fit_languages(df: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from at most ``per_language`` labelled rows of each language, picked by a hash of the id; None without any.

    A quarter of the sample calibrates the confidence and the limits. The counts
    are made on Spark; the driver gets the distinct n-grams of the sample.
    """
    spark = df.sparkSession
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "text"))
    sample = (
        df.where(train).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
        .where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
        .withColumn("r", rank).where(F.col("r") <= per_language)
    )
    sample = Scratch(spark, "langid").keep(sample, "sample")
    parts = "".join(f", s{k} bigint, c{k} bigint" for k in range(1, ORDER))
    grams = sample.where(F.col("r") % CALIBRATE != 0).repartition(spark.sparkContext.defaultParallelism).mapInPandas(lean(_counts), f"lang string, g bigint, n bigint{parts}")
    names = [f"{a}{k}" for k in range(1, ORDER) for a in "sc"]
    rows = grams.groupBy("lang", "g").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in names]).toPandas()
    if not len(rows):
        return None
    model = _kneser_ney(rows, sorted(rows["lang"].unique()))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            ce, n = model.entropies(list(part["text"]))
            yield pd.DataFrame({"lang": part["lang"], "n": n, "ce": list(ce)})

    seen = sample.where(F.col("r") % CALIBRATE == 0).select("text", "lang").mapInPandas(lean(measure), "lang string, n double, ce array<double>").toPandas()
    return _calibrate(model, seen)


def _high(values: np.ndarray) -> float:
    """A high quantile; from two values on the largest never counts, so one odd or mislabelled text moves nothing."""
    return float(np.quantile(values, HIGH, method="lower"))


def _calibrate(model: Model, seen: pd.DataFrame) -> Model:
    size = len(model.languages)
    model.centre, model.spread, model.margin = np.full(size, 4.0), np.full(size, LEAST_SPREAD), np.full(size, LEAST_MARGIN)
    seen = seen[seen["lang"].isin(model.languages)]
    if not len(seen):
        return model
    ce, n = np.stack(list(seen["ce"])), np.maximum(seen["n"].to_numpy(), 1)
    true = seen["lang"].map({v: i for i, v in enumerate(model.languages)}).to_numpy()
    scales = np.geomspace(0.05, 20, 40)

    def loss(s: float) -> float:
        z = -s * (ce - ce.min(1, keepdims=True)) * np.sqrt(n)[:, None]
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), true]).mean())

    model.scale = float(scales[np.argmin([loss(s) for s in scales])])
    own = ce[np.arange(len(ce)), true]
    for i in range(size):
        mine = true == i
        if mine.any():
            model.centre[i] = np.median(own[mine])
            over = own[mine] - model.centre[i]
            # Few texts say little about the tail, so the margin widens fast below SCARCE texts.
            model.margin[i] = max(LEAST_MARGIN, FACTOR * _high(over)) + (SCARCE / len(over)) ** 2
            model.spread[i] = max(LEAST_SPREAD, _high(over * np.sqrt(n[mine])))
    return model


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with __lang, __confidence (0 to 1) and __rejected.

    A text that is null or has no letter is ``und`` with confidence 0 and
    rejected; so is every text without a model. All other texts get the best
    language, whether rejected or not. Texts are read whole.
    """
    known = F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}")
    schema = StructType(list(df.schema.fields)).add("__lang", "string").add("__confidence", "double").add("__rejected", "boolean")
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in batches:
            ok = part["__known"].to_numpy(bool) & (m is not None)
            langs, score, out = np.full(len(part), UNKNOWN, object), np.zeros(len(part)), np.ones(len(part), bool)
            if ok.any():
                langs[ok], score[ok], out[ok] = m.judge(list(part[text][ok]))
            yield part.drop(columns=["__known"]).assign(__lang=langs, __confidence=score, __rejected=out)

    return df.withColumn("__known", known).mapInPandas(lean(judge), schema)
