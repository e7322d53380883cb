"""Quiet-time batches against a plain loop, as a table and as a replayed feed."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from threadloom.streaming import feeds
from threadloom.streaming.quiet import Quiet, quiet_batches, quiet_stream

RULE = Quiet(least=2_000_000, most=60_000_000, factor=10, forget=600_000_000)
BASE = 1_700_000_000_000_000


def _plain(rows):
    out = []
    for owner in {r[0] for r in rows}:
        mine, quiet, batch = sorted((at, cost) for o, at, cost in rows if o == owner), RULE.least, []
        for at, cost in mine:
            if batch and at - batch[-1][0] >= quiet:
                out.append((owner, batch[0][0], batch[-1][0] + quiet, len(batch)))
                quiet = RULE.least if at - batch[-1][0] >= RULE.forget else min(RULE.most, max(RULE.least, 10 * batch[-1][1]))
                batch = []
            batch.append((at, cost))
        out.append((owner, batch[0][0], batch[-1][0] + quiet, len(batch)))
    return sorted(out)


def _changes():
    rng, rows = random.Random(8), []
    for owner in (1, 2, 3):
        at = BASE
        for _ in range(250):
            at += rng.choice([0, 300_000, 1_999_999, 2_000_000, 5_000_000, 20_000_000, 59_999_999, 60_000_000, 61_000_000, 700_000_000])
            rows.append((owner, at, rng.choice([0, 100_000, 600_000, 3_000_000, 90_000_000])))
    return rows


def test_batches_equal_a_plain_loop(spark):
    rows = _changes()
    df = spark.createDataFrame([(o, i, a, c) for i, (o, a, c) in enumerate(rows)], "owner long, uid long, at long, cost long").repartition(5)
    assert sorted(tuple(r) for r in quiet_batches(df, RULE).collect()) == _plain(rows)
    assert quiet_batches(df.limit(0), RULE).count() == 0


def test_replayed_feed_equals_a_plain_loop_and_its_state_ends(spark):
    rng, rows = random.Random(1), _changes()
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(50_000_000))  # up to 50 seconds late
    folder, size = feeds.work_folder(spark, "feed"), len(order) // 6
    end = max(r[1] for r in rows) + 10**12
    for part in [*[order[i : i + size] for i in range(0, len(order), size)], [(-1, end, 0)], [(-1, end + 10**10, 0)]]:
        made = spark.createDataFrame(part, "owner long, at long, cost long").select("owner", F.timestamp_micros("at").alias("ts"), "cost")
        made.coalesce(1).write.mode("append").parquet(folder)
    root = feeds.work_folder(spark, "quiet")
    feed = feeds.file_stream(spark, folder, made.schema, 1)
    got = feeds.drain(quiet_stream(feed, RULE, "60 seconds"), "quiet", "append", root).where("owner > 0").select("owner", "start", "end", "n").collect()
    assert sorted(tuple(r) for r in got) == _plain(rows)
    left = spark.read.format("statestore").load(f"{root}/state").select("key.*").collect()
    assert {r[0] for r in left} <= {-1}
