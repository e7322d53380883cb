"""Split windows equal plain windows on a table where one key holds a third of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import windows as w


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        data.append((key, rng.randrange(1000), i, rng.choice([None, rng.randrange(50)])))
    return spark.createDataFrame(data, "k string, at int, uid int, v int").repartition(7).cache()


def band():
    return F.floor(F.col("at") / 100)


def same(got, want, *cols):
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_row_number(rows):
    got = w.split_row_number(rows, ["k"], ["at", "uid"], band())
    want = rows.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("at", "uid")).cast("long"))
    same(got, want, "k", "uid", "pos")


def test_row_number_without_key(rows):
    got = w.split_row_number(rows, [], [F.col("at").desc(), "uid"], -band())
    want = rows.withColumn("pos", F.row_number().over(Window.orderBy(F.col("at").desc(), "uid")).cast("long"))
    same(got, want, "uid", "pos")


@pytest.mark.parametrize("name", ["previous", "running_sum", "last_known"])
def test_carried(rows, name):
    over = Window.partitionBy("k").orderBy("at", "uid")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    plain = {
        "previous": F.lag("v").over(over),
        "running_sum": F.sum("uid").over(upto),
        "last_known": F.last("v", ignorenulls=True).over(upto),
    }[name]
    value = F.col("uid") if name == "running_sum" else F.col("v")
    got = getattr(w, f"split_{name}")(rows, ["k"], ["at", "uid"], band(), value, "out")
    same(got, rows.withColumn("out", plain), "k", "uid", "out")


def test_pick_ranks(rows):
    got = {r["k"]: (r["n"], r["lo"], r["hi"]) for r in w.pick_ranks(rows, ["k"], "at", {"lo": F.lit(0), "hi": F.col("n") - 1}).collect()}
    want = {r["k"]: (r["n"], r["lo"], r["hi"]) for r in rows.groupBy("k").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).collect()}
    assert got == want


@pytest.mark.parametrize("few", [200_000, 0])
def test_row_numbers_over_ranges(spark, monkeypatch, few):
    """A key on several ranges and many keys in one are numbered alike, whether ranges of keys go to every task or not."""
    monkeypatch.setattr(w, "FEW_KEYS", few)
    monkeypatch.setattr(w, "cut_lineage", None)  # rows are written, which is smaller than a checkpoint
    rows = [(None if i % 7 == 0 else 1 if i % 3 else i, (i * 37) % 101, i) for i in range(400)]
    groups = {}
    for k, v, i in rows:
        groups.setdefault(k, []).append((v, i))
    want = {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}
    got = w.range_row_number(spark.createDataFrame(rows, "k int, v int, i int").repartition(3), ["k"], ["v", "i"])
    assert {r["i"]: r["pos"] for r in got.collect()} == want
    joins = got._jdf.queryExecution().optimizedPlan().toString()
    assert joins.count("strategy=broadcast") == 1  # rows are not shuffled to learn where their key begins
