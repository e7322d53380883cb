"""Streaming twins of the change, membership and activity operators (Structured Streaming).

The notes format has no rule for late rows, so nothing is dropped unless the
caller names a ``late`` limit, which bounds the state of an endless stream. Sinks are Parquet folders
below the shared checkpoint folder; a restarted query continues from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.session import ensure_checkpoint_dir

CONFIRM = 2


def file_stream(spark: SparkSession, folder: str, schema, per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a table, one file or a folder of them, as a stream; with ``per_batch`` so many files a micro-batch."""
    reader = spark.readStream.schema(schema)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    # As a pattern the path may be a file or a folder; a plain path has to be a folder.
    return reader.parquet(f"{folder[:-1]}[{folder[-1]}]")


def accepted(rows: DataFrame, column: str, late: str | None) -> DataFrame:
    return rows.withWatermark(column, late) if late and rows.isStreaming else rows


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str, mode: str, folder: str | None = None) -> DataFrame:
    """Runs a stream over all rows now available and returns what it wrote.

    Each micro-batch overwrites its own ``batch=`` folder, so a batch that is
    replayed after a failure replaces its rows instead of adding them twice.
    In update mode the result holds every version of a row, with its batch.
    """
    spark = stream.sparkSession
    root = folder or work_folder(spark, name)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows/batch=*")


def latest_version(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Last written version of each row of an update-mode sink."""
    rest = [c for c in versions.columns if c not in [*keys, "batch"]]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, "r.*")


def change_feed_latest(edits: DataFrame) -> DataFrame:
    """Newest edit per item (item, at, uid, user); state is one row per item."""
    newest = edits.groupBy("item").agg(F.max(F.struct("at", "uid", "user")).alias("m"))
    return newest.select("item", F.col("m.at").alias("at"), F.col("m.user").alias("user"))


def follow_stream_diff(source: DataFrame, placed: DataFrame) -> DataFrame:
    """Pending and placed counts per owner as source rows (owner, uid) arrive against a board table."""
    on = placed.select("owner", "uid").distinct().withColumn("on_board", F.lit(True))
    rows = source.join(on, ["owner", "uid"], "left")
    return rows.groupBy("owner").agg(F.count_if(F.col("on_board").isNull()).alias("pending"), F.count("on_board").alias("placed"))


def _misses(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Complete reads after the last one that showed the item, in whatever order reads arrive."""
    last, later = state.get if state.exists else (None, [])
    rows = pd.concat(list(batches))
    shown = rows.loc[rows["present"], "read"].max()
    last = last if pd.isna(shown) else int(shown) if last is None else max(last, int(shown))
    reads = pd.concat([pd.Series(later, dtype="int64"), rows.loc[rows["complete"] & ~rows["present"], "read"].astype("int64")])
    reads = reads if last is None else reads[reads > last]
    state.update((last, reads.tolist()))
    yield pd.DataFrame({"owner": [key[0]], "item": [key[1]], "missed": [len(reads)], "gone": [len(reads) >= CONFIRM]})


def left_after_two_misses(reads: DataFrame) -> DataFrame:
    """Items (owner, item, read, present, complete) that two complete reads in a row missed.

    A partial read clears an item it shows and never counts one it does not.
    State is the last read that showed the item and the complete reads after
    it, so an older read that comes late counts as it would have in time.
    """
    return reads.groupBy("owner", "item").applyInPandasWithState(
        _misses, "owner long, item string, missed long, gone boolean", "last long, later array<long>", "update", GroupStateTimeout.NoTimeout
    )


def left_after_two_misses_batch(reads: DataFrame) -> DataFrame:
    """The same verdict from a table: complete reads after the last one that showed the item."""
    shown = reads.groupBy("owner", "item").agg(F.max(F.when(F.col("present"), F.col("read"))).alias("last"))
    later = reads.join(shown, ["owner", "item"])
    missed = F.count_if(F.col("complete") & ~F.col("present") & (F.col("last").isNull() | (F.col("read") > F.col("last"))))
    return later.groupBy("owner", "item").agg(missed.alias("missed")).withColumn("gone", F.col("missed") >= CONFIRM)


def quiet_time_batches(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Runs of events (owner, ts) separated by a quiet gap."""
    rows = accepted(events, "ts", late)
    return rows.groupBy("owner", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(
        "owner", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def windowed_activity(events: DataFrame, width: str = "7 days", slide: str = "1 day", late: str | None = None) -> DataFrame:
    """Event counts (kind, ts) in sliding windows."""
    rows = accepted(events, "ts", late)
    return rows.groupBy(F.window("ts", width, slide).alias("w"), "kind").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), "kind", "n"
    )


def stream_interval_join(stalls: DataFrame, gestures: DataFrame, tail: str, late: str | None = None) -> DataFrame:
    """Stalls (session, uid, st) with every gesture (session, gid, g_st, g_en) whose span plus tail holds them.

    With ``late`` both sides carry a watermark, and the range condition bounds how long rows are kept.
    """
    a = accepted(stalls, "st", late)
    b = accepted(gestures, "g_st", late).withColumnRenamed("session", "g_session")
    inside = F.expr(f"session = g_session AND st >= g_st AND st <= g_st + interval {tail}")
    return a.join(b, inside).drop("g_session")


def opens_counter(events: DataFrame) -> DataFrame:
    """Running open count per item."""
    return events.groupBy("item").agg(F.count("*").alias("opens"))

