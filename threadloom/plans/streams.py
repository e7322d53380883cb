"""Streaming queries: the event file is read as a stream, drained, and read back from the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import telemetry
from threadloom.plans.aggregates import LATEST_SQL, micros
from threadloom.plans.base import query
from threadloom.streaming import feeds
from threadloom.streaming.quiet import Quiet, quiet_batches, quiet_stream


def events(t):
    return feeds.file_stream(t.spark, f"{t.root}/events.parquet", t.events.schema)


def stamped(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def item():
    return F.get_json_object("props", "$.k").cast("long").alias("item")


@query("change_feed_latest", LATEST_SQL)
def _(t):
    edits = events(t).select(item(), micros("ts").alias("at"), F.col("event_id").alias("uid"), F.col("user_id").alias("user"))
    return feeds.latest_version(feeds.drain(feeds.change_feed_latest(edits), "latest", "update"), ["item"])


@query(
    "follow_stream_diff",
    """SELECT user_id AS owner, count(*) FILTER (event_type NOT IN ('view', 'click')) AS pending, count(*) FILTER (event_type IN ('view', 'click')) AS placed FROM events GROUP BY 1""",
)
def _(t):
    placed = t.events.where("event_type IN ('view', 'click')").select(F.col("user_id").alias("owner"), F.col("event_id").alias("uid"))
    source = events(t).select(F.col("user_id").alias("owner"), F.col("event_id").alias("uid"))
    return feeds.latest_version(feeds.drain(feeds.follow_stream_diff(source, placed), "follow", "update"), ["owner"])


def reads(t):
    """One read per user and day; an item is an event type, a day with an error is a partial read."""
    seen = t.events.select(F.col("user_id").alias("owner"), F.dayofmonth("ts").alias("read"), F.col("event_type").alias("item"))
    daily = seen.groupBy("owner", "read").agg(F.collect_set("item").alias("items"))
    kinds = F.explode(F.array(*[F.lit(k) for k in ("click", "view", "purchase", "signup")])).alias("item")
    return daily.select("owner", "read", kinds, "items").select(
        "owner", "item", "read", F.array_contains("items", F.col("item")).alias("present"), (~F.array_contains("items", "error")).alias("complete")
    )


READS_SQL = """
WITH d AS (SELECT user_id AS owner, day(ts) AS "read", list(DISTINCT event_type) AS items FROM events GROUP BY 1, 2),
 r AS (SELECT owner, k AS item, "read", list_contains(items, k) AS present, NOT list_contains(items, 'error') AS complete FROM d, unnest(['click', 'view', 'purchase', 'signup']) u(k)),
 l AS (SELECT owner, item, max("read") FILTER (present) AS last FROM r GROUP BY 1, 2)
SELECT owner, item, count(*) FILTER (complete AND NOT present AND (last IS NULL OR "read" > last)) AS missed, count(*) FILTER (complete AND NOT present AND (last IS NULL OR "read" > last)) >= 2 AS gone
FROM r JOIN l USING (owner, item) GROUP BY 1, 2"""


@query("left_after_two_misses_batch", READS_SQL)
def _(t):
    return feeds.left_after_two_misses_batch(reads(t))


@query("left_after_two_misses", READS_SQL)
def _(t):
    folder = feeds.work_folder(t.spark, "reads")
    table = reads(t)
    table.write.parquet(folder)
    stream = feeds.file_stream(t.spark, folder, table.schema)
    return feeds.latest_version(feeds.drain(feeds.left_after_two_misses(stream), "misses", "update"), ["owner", "item"])


QUIET_SQL = """
WITH e AS (SELECT user_id AS owner, event_id AS uid, epoch_us(ts) AS tm FROM events),
 l AS (SELECT *, CASE WHEN tm - lag(tm) OVER w < 3600000000 THEN 0 ELSE 1 END AS brk FROM e WINDOW w AS (PARTITION BY owner ORDER BY tm, uid)),
 g AS (SELECT *, sum(brk) OVER (PARTITION BY owner ORDER BY tm, uid) AS m FROM l)
SELECT owner, min(tm) AS "start", max(tm) + 3600000000 AS "end", count(*) AS n FROM g GROUP BY owner, m"""


@query("quiet_time_batches", QUIET_SQL)
def _(t):
    rows = t.events.select(F.col("user_id").alias("owner"), F.col("event_id").alias("uid"), micros("ts").alias("at"))
    runs = telemetry.sessions(rows, 3_600_000_000, inclusive=False)
    return runs.groupBy("owner", "start").agg((F.max("at") + 3_600_000_000).alias("end"), F.count("*").alias("n"))


@query("quiet_time_batches_stream", QUIET_SQL)
def _(t):
    rows = stamped(events(t)).select(F.col("user_id").alias("owner"), "ts")
    out = feeds.drain(feeds.quiet_time_batches(rows, "1 hour"), "quiet", "complete")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(last, "batch").select("owner", micros("start").alias("start"), micros("end").alias("end"), "n")


RULE = Quiet(least=600_000_000, most=21_600_000_000, forget=86_400_000_000)
BACKOFF_SQL = """
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS owner, epoch_us(ts) AS tm, round(value * 30000000)::BIGINT AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 w(owner, i, tm, cost, quiet, b) AS (SELECT owner, i, tm, cost, 600000000::BIGINT, 1::BIGINT FROM e WHERE i = 1
  UNION ALL SELECT e.owner, e.i, e.tm, e.cost, CASE WHEN e.tm - w.tm < w.quiet THEN w.quiet WHEN e.tm - w.tm >= 86400000000 THEN 600000000 ELSE least(21600000000, greatest(600000000, 10 * w.cost)) END,
   CASE WHEN e.tm - w.tm < w.quiet THEN b ELSE b + 1 END FROM w JOIN e ON e.owner = w.owner AND e.i = w.i + 1)
SELECT owner, min(tm) AS "start", max(tm) + max(quiet) AS "end", count(*) AS n FROM w GROUP BY owner, b"""


def changes(t):
    return t.events.select(F.col("user_id").cast("long").alias("owner"), F.col("event_id").alias("uid"), micros("ts").alias("at"), F.round(F.col("value") * 30_000_000).cast("long").alias("cost"), F.col("ts").cast("timestamp").alias("ts"))


@query("quiet_time_backoff", BACKOFF_SQL)
def _(t):
    return quiet_batches(changes(t).drop("ts"), RULE)


@query("quiet_time_backoff_stream", BACKOFF_SQL)
def _(t):
    folder = feeds.work_folder(t.spark, "changes")
    rows = changes(t).select("owner", "ts", "cost")
    rows.write.parquet(folder)
    # The end of the feed is one change of nobody, long after all others, that lets every timer run out.
    end = t.events.agg(F.lit(-1).cast("long").alias("owner"), (F.max("ts").cast("timestamp") + F.expr("interval 30 days")).alias("ts"), F.lit(0).cast("long").alias("cost"))
    end.write.mode("append").parquet(folder)
    return feeds.drain(quiet_stream(feeds.file_stream(t.spark, folder, rows.schema), RULE), "backoff", "append").where("owner >= 0").drop("batch")


WINDOW_SQL = """
WITH e AS (SELECT event_type AS kind, epoch_us(date_trunc('day', ts)) AS d FROM events)
SELECT d - o * 86400000000 AS "start", kind, count(*) AS n FROM e, unnest(range(7)) u(o) GROUP BY 1, 2"""


@query("windowed_activity", WINDOW_SQL)
def _(t):
    rows = stamped(t.events).select(F.col("event_type").alias("kind"), "ts")
    daily = feeds.windowed_activity(rows, "1 day", "1 day")
    slid = daily.select("kind", "n", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("o"), micros("start").alias("d"))
    return slid.groupBy((F.col("d") - F.col("o") * 86_400_000_000).alias("start"), "kind").agg(F.sum("n").alias("n"))


@query("windowed_activity_stream", WINDOW_SQL)
def _(t):
    rows = stamped(events(t)).select(F.col("event_type").alias("kind"), "ts")
    out = feeds.latest_version(feeds.drain(feeds.windowed_activity(rows), "activity", "update"), ["start", "kind"])
    return out.select(micros("start").alias("start"), "kind", "n")


@query(
    "stream_interval_join",
    """SELECT s.user_id AS session, s.event_id AS uid, g.event_id AS gid FROM events s JOIN events g ON g.user_id = s.user_id AND s.event_type = 'error' AND g.event_type = 'purchase' AND s.ts >= g.ts AND s.ts <= g.ts + INTERVAL 90 MINUTE""",
)
def _(t):
    stalls = stamped(events(t)).where("event_type = 'error'").select(F.col("user_id").alias("session"), F.col("event_id").alias("uid"), F.col("ts").alias("st"))
    gestures = stamped(events(t)).where("event_type = 'purchase'").select(F.col("user_id").alias("session"), F.col("event_id").alias("gid"), F.col("ts").alias("g_st"))
    return feeds.drain(feeds.stream_interval_join(stalls, gestures, "90 minutes"), "joined", "append").select("session", "uid", "gid")


@query("opens_counter", "SELECT json_extract_string(props, '$.k')::BIGINT AS item, count(*) AS opens FROM events WHERE event_type = 'view' GROUP BY 1")
def _(t):
    return feeds.latest_version(feeds.drain(feeds.opens_counter(events(t).where("event_type = 'view'").select(item())), "opens", "update"), ["item"])
