"""Importance resampling of documents towards a target distribution over hashed n-grams.

The bytes of a text go through one 256-byte table that lower-cases A-Z and
blanks every ASCII byte that is no letter or digit; ``bytes.split`` gives the
words. The CRC-32 of a run of words continues that of the run one word shorter,
so n-grams are never built as strings. Counters per batch meet in a sum per
bucket on Spark. A bucket's gain is the log ratio of its smoothed shares in the
target and in the documents; a document's weight is the mean gain of its
features, and Gumbel noise from a hash of the id draws without replacement.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.windows import range_position
from threadloom.llm.shared import Scratch

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
STRETCH = 1 << 20
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
TABLE = bytes(c if c >= 128 else (lower if (lower := bytes([c]).lower()[0]) in _KEPT else 32) for c in range(256))


def stretches(text: str) -> Iterator[list[bytes]]:
    """The words of a whole text in runs of about ``STRETCH`` bytes; no word is cut."""
    data, at = text.encode().translate(TABLE), 0
    while at < len(data):
        end = data.find(b" ", min(at + STRETCH, len(data)))
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def bucket_counts(text: str | None, longest: int, buckets: int) -> tuple[Counter, int]:
    """(occurrences of each bucket over all runs of 1 to ``longest`` words, number of words)."""
    found: Counter = Counter()
    if text is None:
        return found, 0
    total, carried = 0, []
    for words in stretches(text):
        total += len(words)
        if longest == 1:
            for word, n in Counter(words).items():
                found[crc32(word) % buckets] += n
            continue
        run = carried + words
        codes = [crc32(w) for w in run]
        found.update(c % buckets for c in codes[len(carried) :])
        for size in range(2, longest + 1):
            codes = [crc32(w, crc32(b" ", c)) for c, w in zip(codes, run[size - 1 :])]
            fresh = max(len(carried) - size + 1, 0)  # runs that end in an earlier stretch were counted there
            found.update(c % buckets for c in codes[fresh:])
        carried = run[len(run) - min(longest - 1, len(run)) :]
    return found, total


def corpus_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Occurrences of every bucket over all rows of ``texts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()  # at most ``buckets`` entries
        for batch in batches:
            for value in batch.column(0):
                total.update(bucket_counts(value.as_py(), longest, buckets)[0])
        yield pa.record_batch([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], names=["b", "n"])

    sums = texts.select(F.col(text).alias("t")).mapInArrow(count, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # one row a bucket
        out[row["b"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of add-one shares, floored."""
    size, total, aim = len(source), int(source.sum()), int(target.sum())
    return np.floor(1000 * np.log(((target + 1.0) * (total + size)) / ((source + 1.0) * (aim + size)))).astype(np.int64)


def importance_ranks(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = 1,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_features, weight, score and rank (null unless drawn), all bigint but the id.

    Of the documents with at least ``least_words`` words the ``percent`` % (floored)
    of highest scores are drawn; ties go to the smaller id, null ids last. A null
    or empty text has no features and weight 0. A null id draws its noise as the
    empty string does. Repeated rows are scored and ranked each by itself. Empty
    tables give empty results; an empty target gives weights against a uniform one.
    Other columns of either table don't matter, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    gains = bucket_gains(corpus_counts(docs, text, longest, buckets), corpus_counts(target, target_text, longest, buckets))
    shared = spark.sparkContext.broadcast(gains)  # one number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            sums, sizes, lengths = [], [], []
            for value in batch.column(1):
                found, words = bucket_counts(value.as_py(), longest, buckets)
                n = found.total()
                at, times = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
                sums.append(int(gain[at] @ times) // n if n else 0)
                sizes.append(n)
                lengths.append(words)
            yield pa.record_batch([batch.column(0), pa.array(lengths, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    # Written before it is ranked: drawing the bounds of the ranges reads the rows once more, and texts should be read once.
    weighed = scratch.keep(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(weigh, f"id {kind}, n_words bigint, n_features bigint, weight bigint"), "weights")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("__fit", F.col("n_words") >= least_words)
    placed = range_position(scored, [F.desc("__fit"), F.desc("score"), F.asc_nulls_last("id"), "weight", "n_features"], "__pos", scratch.keep)
    fit = placed.where("__fit").agg(F.count("*")).first()[0]
    rank = F.when(F.col("__pos") <= percent * fit // 100, F.col("__pos"))
    return placed.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", rank.alias("rank"))


def resampled(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with all their columns; a null id is never drawn here, as it names no row."""
    drawn = ranks.where("rank is not null").select(F.col(id_col).alias("__drawn")).distinct()
    return docs.join(drawn, docs[id_col] == F.col("__drawn"), "left_semi")
