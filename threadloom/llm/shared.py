"""Helpers that several operators use: shared tables, salted joins, components."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import ensure_checkpoint_dir

SALTS = 64
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    return (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one operator in the shared folder: they cut the lineage and survive lost executors.

    ``drop`` removes those that the operator no longer needs; what its result
    still reads is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self.count = 0
        # Rows may be very long texts or sets: batches to Python are bounded in bytes, not in rows.
        if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH)) > BATCH_BYTES:
            spark.conf.set(BATCH, str(BATCH_BYTES))
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # the session has ended; the folder goes with the job's other checkpoints
            return

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{name}-{self.count}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """``df`` written once and read back."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete_path(self.spark, t._scratch_path)


def give_back() -> None:
    """Returns memory that this process has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` (batches to batches) for mapInArrow and mapInPandas; at the end its freed memory goes back.

    Spark keeps a worker for later tasks, and a stage that needs none runs beside
    all that wait: what they hold on to counts with the executor's memory.
    """

    def lean_run(batches):
        yield from run(batches)
        give_back()

    return lean_run


def lean_group(run: Callable) -> Callable:
    """The same for applyInPandas, after each group; for groups of about a block of documents or more."""

    def lean_run(part):
        out = run(part)
        give_back()
        return out

    return lean_run


def attach(big: DataFrame, small: DataFrame, key: str, spread: Column, salts: int = SALTS) -> DataFrame:
    """Left join of ``small`` (unique, non-null keys) to ``big``, with each key's rows dealt over ``salts`` tasks.

    ``small`` is repeated once a salt, so pass only the keys that more than one row shares.
    """
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "__salt"], "left").drop("__salt")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes that are not the smallest, over edges a-b."""
    if not len(a):
        return a, b
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)].astype(np.int64), inverse[len(a) :].astype(np.int64)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        if (label[x] == label[y]).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in batches:
        a, b = forest(np.concatenate([a, part["a"].to_numpy()]), np.concatenate([b, part["b"].to_numpy()]))
        if len(a) > 1 << 20:
            yield pd.DataFrame({"a": a, "b": b})
            a, b = a[:0], b[:0]
    yield pd.DataFrame({"a": a, "b": b})


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b: bigint) except the roots themselves.

    Each task first shrinks its edges to a forest of bounded size; then large-star
    and small-star steps alternate until nothing changes. The edges of one node
    are dealt over salts, and a node's minimum is aggregated before the shuffle,
    so a centre with very many neighbours is not one task. There is no round limit.
    """

    def step(e: DataFrame, small: bool) -> DataFrame:
        both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        near = both if small else both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = attach(near, low, "u", F.col("v"), 8)
        if small:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    now = scratch.keep(edges.select("a", "b").mapInPandas(lean(_forests), "a bigint, b bigint"), "edges")
    seen = None
    while True:
        after = scratch.keep(step(step(now, False), True), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        scratch.drop(now)
        now = after
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))


def blocks_of(
    df: DataFrame, keys: list[str], key_types: str, order: str, columns: dict[str, str], size: int
) -> DataFrame:
    """Rows range-sorted by (keys, order) and cut into blocks of at most ``size``; a block never spans two keys.

    ``columns`` maps a column to a NumPy type, or to ``bytes`` for equal-length
    binary cells. A block is one row: keys, blk, n, lo, hi, and each column as
    one binary value.
    """
    names = list(columns)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 32, 0
        held: pd.DataFrame | None = None

        def emit(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal count
            row = {k: [part[k].iloc[0]] for k in keys}
            row |= {"blk": [base + count], "n": [len(part)], "lo": [float(part[order].iloc[0])], "hi": [float(part[order].iloc[-1])]}
            for c, kind in columns.items():
                row[c] = [b"".join(part[c]) if kind == "bytes" else part[c].to_numpy().astype(kind).tobytes()]
            count += 1
            return pd.DataFrame(row)

        for part in batches:
            held = part if held is None or not len(held) else pd.concat([held, part], ignore_index=True)
            if not len(held):
                continue
            change = np.zeros(len(held), bool)
            for k in keys:
                v = held[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            starts = [0, *np.flatnonzero(change), len(held)]
            left = 0
            for i, (s, e) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                last = i == len(starts) - 2
                while e - s >= size or (not last and e > s):
                    yield emit(held.iloc[s : min(e, s + size)])
                    s = min(e, s + size)
                left = s
            held = held.iloc[left:].reset_index(drop=True)
        if held is not None and len(held):
            yield emit(held)

    schema = f"{key_types}, blk bigint, n int, lo double, hi double, " + ", ".join(f"{c} binary" for c in names)
    dealt = df.select(*keys, order, *[c for c in names if c not in (*keys, order)]).repartitionByRange(*keys, order)
    return dealt.sortWithinPartitions(*keys, order).mapInPandas(cut, schema)

