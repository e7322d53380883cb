"""Windows over keys that may hold a large share of all rows.

A plain ``Window.partitionBy(key)`` puts one key in one task. The helpers here
split each key by ``bucket``, an expression that never decreases along
``order`` (a day, a month, a value band), run the window inside
(key, bucket), and carry one summary row per bucket across. Results are exact
for any bucket that is monotone in the order; the bucket only sets task size.
Key columns must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.session import cut_lineage, written

BUCKET = "__bucket"
RANGE_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits
FEW_KEYS = 200_000  # ranges of keys that go to every task


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def range_sorted(df: DataFrame, order: Sequence[str | Column], keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """``df`` range-sorted by ``order`` and written once by ``keep``, with ``__part``, which never decreases along the order, and ``__at``, the row in it.

    Spark draws the bounds of the ranges from the data, so a part has about the
    same number of rows at every size and under any skew of a leading column, as
    long as ``order`` tells rows apart. Bounds may differ when a plan runs twice;
    therefore the rows are kept before anything counts them.
    """
    by = _order(order)
    rows = keep(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    return rows.withColumn("__part", F.shiftright("__at", RANGE_ROW_BITS)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << RANGE_ROW_BITS) - 1)))


def range_position(df: DataFrame, order: Sequence[str | Column], name: str = "pos", keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """``df`` with the position of each row in the order of the whole table, from 1.

    One shuffle; the driver gets one count per partition, never rows. Rows that
    are equal in ``order`` take their positions in any order.
    """
    rows = range_sorted(df, order, keep)
    counts = {r[0]: r[1] for r in rows.groupBy("__part").agg(F.count("*")).collect()}
    sizes = np.array([counts.get(i, 0) for i in range(max(counts, default=0) + 1)], np.int64)
    before = F.get(F.lit(np.cumsum(sizes) - sizes), F.col("__part").cast("int"))
    return rows.withColumn(name, before + F.col("__at") + 1).drop("__part", "__at")


def positioned(df: DataFrame, order: Sequence[str | Column], limit: int | None = None, name: str = "pos") -> DataFrame:
    """``df`` with its position along ``order``; with ``limit`` each task keeps only its own first rows."""
    if limit is None:
        return range_position(df, order, name)
    by = _order(order)
    return df.orderBy(*by).limit(limit).withColumn(name, F.row_number().over(Window.orderBy(*by)))


def range_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """Row number per key along ``order``, from 1; a key of any size is spread over as many ranges as it needs. Null is a key.

    Rows are shuffled once, into their ranges, and written. A key's rows stand
    together in a range, so what is counted are ranges of keys; where those are
    few, they go to every task and a row's place in its range says the rest.
    Where keys are many, rows are numbered inside (key, range), and only a key
    that goes on from an earlier range needs more, one a range at most.
    """
    rows = range_sorted(df, [*keys, *order], written)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first")))
    offsets = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    if counts.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        return rows.join(F.broadcast(offsets), same).select(*df.columns, (F.col("__at") - F.col("__first") + 1 + F.col("__off")).alias(name))
    local = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__at")))
    return local.join(F.broadcast(offsets.where("__off > 0")), same, "left").select(*df.columns, (F.col("__rn") + F.coalesce("__off", F.lit(0))).alias(name))


def split_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, name: str = "pos"
) -> DataFrame:
    """Row number per key, from 1, as int-safe bigint."""
    rows = df.withColumn(BUCKET, bucket)
    by = [*keys, BUCKET]
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*by).agg(F.count("*").alias("__n")).select(
        *by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    local = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*_order(order))))
    return local.join(offsets, by).withColumn(name, F.col("__rn") + F.col("__off")).drop("__rn", "__off", BUCKET)


def split_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, name: str
) -> DataFrame:
    """``lag(value)`` along ``order``."""
    rows = df.withColumn(BUCKET, bucket).withColumn("__v", value)
    by = [*keys, BUCKET]
    carried = rows.groupBy(*by).agg(F.max_by("__v", F.struct(*_order(order))).alias("__last")).select(
        *by, F.lag("__last").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("__carry")
    )
    w = Window.partitionBy(*by).orderBy(*_order(order))
    local = rows.withColumn("__lag", F.lag("__v").over(w)).withColumn("__rn", F.row_number().over(w))
    return (
        local.join(carried, by)
        .withColumn(name, F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col("__lag")))
        .drop("__lag", "__rn", "__carry", "__v", BUCKET)
    )


def split_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, name: str
) -> DataFrame:
    """Inclusive running sum along ``order`` (a total order)."""
    rows = df.withColumn(BUCKET, bucket).withColumn("__v", value)
    by = [*keys, BUCKET]
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*by).agg(F.sum("__v").alias("__s")).select(
        *by, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__carry")
    )
    w = Window.partitionBy(*by).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__run", F.sum("__v").over(w))
    return local.join(carried, by).withColumn(name, F.col("__run") + F.col("__carry")).drop(
        "__run", "__carry", "__v", BUCKET
    )


def split_last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, name: str
) -> DataFrame:
    """Latest non-null ``value`` at or before each row."""
    rows = df.withColumn(BUCKET, bucket).withColumn("__v", value)
    by = [*keys, BUCKET]
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("__v").isNotNull(), F.struct(*_order(order)))
    carried = rows.groupBy(*by).agg(F.max_by("__v", known).alias("__last")).select(
        *by, F.last("__last", ignorenulls=True).over(before).alias("__carry")
    )
    w = Window.partitionBy(*by).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__known", F.last("__v", ignorenulls=True).over(w))
    return local.join(carried, by).withColumn(name, F.coalesce("__known", "__carry")).drop(
        "__known", "__carry", "__v", BUCKET
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int | None, name: str = "pos") -> DataFrame:
    """First ``k`` rows per key, or all of them numbered.

    The rank filter lets Spark cut each map task to ``k`` rows before the
    shuffle; without ``k`` the key is split into ranges.
    """
    if k is None:
        return range_row_number(df, keys, order, name)
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def pick_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics per key without sorting a key in one task.

    ``ranks`` maps an output name to a 0-based index expression over ``n`` (the
    group count). Values are first counted per (key, value); the running count
    over distinct values is split by value band, and each index is read from
    the value whose count range covers it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    sized = counts.withColumn("__band", value_band(F.col(value)))
    upto = split_running_sum(sized, keys, [value], F.col("__band"), F.col("__c"), "__hi")
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("n"))
    joined = upto.join(totals, list(keys))
    lo = F.col("__hi") - F.col("__c")
    picks = [
        F.max(F.when((expr >= lo) & (expr < F.col("__hi")), F.col(value))).alias(name) for name, expr in ranks.items()
    ]
    return joined.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def value_band(col: Column) -> Column:
    """A monotone band of a number: sign and power of two, cut in 16 steps."""
    v = col.cast("double")
    mag = F.floor(F.log2(F.greatest(F.abs(v), F.lit(1e-9))) * 16)
    return F.when(v >= 0, mag + 100000).otherwise(-mag - 100000)
