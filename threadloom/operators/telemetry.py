"""Interaction logs: stalls, gestures, inputs, latencies, budgets.

Times are microseconds. Joins of points with spans meet on time buckets;
"latest before" lookups are one union and a carried value, split by bucket, so
one busy session spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.windows import pick_ranks, split_last_known, split_previous

HOUR_US = 3_600_000_000

# Zoom bands and time limits of the recorder.
BANDS = ((0.2, "map"), (0.6, "overview"), (0.9, "small"), (1.3, "reading"))
GESTURE_TAIL_US = 250_000
INPUT_BACK_US = 400_000
HOVER_GAP_US = 4_000
DRAG_TAIL_US = 6_000_000


def zoom_band(zoom: Column) -> Column:
    out = F.when(zoom.isNull(), "no board")
    for limit, name in BANDS:
        out = out.when(zoom < limit, name)
    return out.otherwise("close")


def _exact(value: Column) -> Column:
    """Sum of doubles that does not depend on the order of the rows."""
    return F.sum(value.cast("decimal(24,6)")).cast("double")


def stall_attribution(frames: DataFrame) -> DataFrame:
    """Script and forced time per (context, band, owner); render and rest are owners of their own.

    Frames are (uid, d, render, zoom, context, scripts array<struct<owner, d, f>>).
    """
    script_total = F.aggregate("scripts", F.lit(0.0), lambda s, x: s + x["d"])
    rest = F.greatest(F.lit(0.0), F.col("d") - script_total - F.col("render"))
    own = F.transform("scripts", lambda s: F.struct(s["owner"].alias("owner"), (s["d"] - s["f"]).alias("script"), s["f"].alias("forced")))
    extra = F.array(
        F.struct(F.lit("(render)").alias("owner"), F.col("render").alias("script"), F.lit(0.0).alias("forced")),
        F.struct(F.lit("(rest)").alias("owner"), rest.alias("script"), F.lit(0.0).alias("forced")),
    )
    rows = frames.select("context", zoom_band(F.col("zoom")).alias("band"), F.explode(F.concat(own, extra)).alias("x"))
    return rows.groupBy("context", "band", "x.owner").agg(_exact(F.col("x.script")).alias("script"), _exact(F.col("x.forced")).alias("forced"), F.count("*").alias("n"))


def stall_to_gesture(stalls: DataFrame, gestures: DataFrame, tail_us: int = GESTURE_TAIL_US, bucket_us: int = HOUR_US) -> DataFrame:
    """Each stall (session, uid, st) with the latest gesture (session, gid, st, en) whose span plus tail holds it, or null."""
    cell = lambda c: F.floor(c / bucket_us)
    spans = gestures.select("session", "gid", F.col("st").alias("g_st"), (F.col("en") + tail_us).alias("g_en"))
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("g_st")), cell(F.col("g_en")))))
    met = stalls.withColumn("cell", cell(F.col("st"))).join(spans, ["session", "cell"]).where(F.col("st").between(F.col("g_st"), F.col("g_en")))
    hit = met.groupBy("session", "uid").agg(F.max(F.struct("g_st", "gid"))["gid"].alias("gid"))
    return stalls.join(hit, ["session", "uid"], "left")


def latest_before(points: DataFrame, marks: DataFrame, bucket_us: int = 24 * HOUR_US) -> DataFrame:
    """Points (session, uid, at) with the latest mark (session, at, label) at or before them: ``mark_at`` and ``mark``."""
    m = marks.select("session", "at", F.lit(0).alias("side"), F.lit(None).cast("long").alias("uid"), F.struct(F.col("at").alias("mark_at"), F.col("label").alias("mark")).alias("m"))
    p = points.select("session", "at", F.lit(1).alias("side"), "uid", F.lit(None).cast(m.schema["m"].dataType).alias("m"))
    carried = split_last_known(m.unionByName(p), ["session"], ["at", "side", "uid"], F.floor(F.col("at") / bucket_us), F.col("m"), "seen")
    return carried.where("side = 1").select("session", "uid", "at", F.col("seen.mark_at").alias("mark_at"), F.col("seen.mark").alias("mark"))


def nearest_input_context(stalls: DataFrame, inputs: DataFrame, back_us: int = INPUT_BACK_US) -> DataFrame:
    """Context of stalls without a gesture: the latest input in the time before their end, else idle."""
    found = latest_before(stalls, inputs)
    return found.select("session", "uid", F.when(F.col("mark_at") >= F.col("at") - back_us, F.col("mark")).otherwise("idle").alias("context"))


def sessions(events: DataFrame, gap_us: int, inclusive: bool = True, bucket_us: int = 24 * HOUR_US) -> DataFrame:
    """Adds ``start``: the first time of the run an event (owner, uid, at) belongs to.

    A run goes on while the next event is at most (or, when not inclusive,
    less than) the gap after the one before it.
    """
    day = F.floor(F.col("at") / bucket_us)
    prev = split_previous(events, ["owner"], ["at", "uid"], day, F.col("at"), "before")
    gap = F.col("at") - F.col("before")
    new = F.col("before").isNull() | ((gap > gap_us) if inclusive else (gap >= gap_us))
    return split_last_known(prev, ["owner"], ["at", "uid"], day, F.when(new, F.col("at")), "start")


def hover_moments(events: DataFrame, gap_us: int = HOVER_GAP_US) -> DataFrame:
    """Hover events close after one another as one moment: longest duration, any on the board, size."""
    return sessions(events, gap_us).groupBy("owner", "start").agg(F.max("d").alias("d"), F.bool_or("in_board").alias("in_board"), F.count("*").alias("n"))


def tail_stalls(stalls: DataFrame, anchors: DataFrame, tail_us: int = DRAG_TAIL_US) -> DataFrame:
    """Idle stalls that begin within the tail after a drag or an item press."""
    found = latest_before(stalls, anchors.withColumn("label", F.lit("anchor")))
    return found.where(F.col("mark_at") >= F.col("at") - tail_us).select("session", "uid", "at")


def _median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    n = F.col("n")
    two = pick_ranks(df, keys, value, {"__lo": F.floor((n - 1) / 2), "__hi": F.floor(n / 2)})
    return two.select(*keys, ((F.col("__lo") + F.col("__hi")) / 2).alias(name))


def latency_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, nearest-rank percentiles by both definitions, maximum, median and MAD per group; exact."""
    n = F.col("n")
    ceil_rank = lambda p: F.greatest(F.lit(0), F.ceil(n * p / 100) - 1)
    floor_rank = lambda p: F.least(n - 1, F.floor(n * p / 100))
    picks = pick_ranks(
        rows, keys, value,
        {"p50": ceil_rank(50), "p75": ceil_rank(75), "p90": ceil_rank(90), "p95": ceil_rank(95), "q50": floor_rank(50), "q90": floor_rank(90), "max": n - 1,
         "__lo": F.floor((n - 1) / 2), "__hi": F.floor(n / 2)},
    ).withColumn("median", (F.col("__lo") + F.col("__hi")) / 2).drop("__lo", "__hi")
    middle = picks.select(*keys, "median")
    spread = rows.join(middle, list(keys)).withColumn("__off", F.round(F.abs(F.col(value) - F.col("median")), 6))
    return picks.join(_median(spread, keys, "__off", "mad"), list(keys))


def newest_per_scenario(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest line (at, uid, metrics map) per scenario."""
    return lines.groupBy(*keys).agg(F.max(F.struct("at", "uid", F.map_entries("metrics").alias("m"))).alias("x")).select(
        *keys, F.col("x.at").alias("at"), F.col("x.uid").alias("uid"), F.map_from_entries("x.m").alias("metrics")
    )


def step_medians(lines: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Median of each named metric per step, one column per metric."""
    flat = lines.select(*keys, F.explode("metrics").alias("metric", "value")).where(F.col("metric").isin(list(names)))
    return _median(flat, [*keys, "metric"], "value", "mid").groupBy(*keys).pivot("metric", list(names)).agg(F.first("mid"))


def ab_verdict(rows: DataFrame) -> DataFrame:
    """Per group: median change from arm a to b against the noise of the pair of equal runs a1, a2.

    Rows are (grp, arm, value). The floor is the larger of the a1/a2 median
    shift and their larger MAD; lower is better.
    """
    middle = _median(rows, ["grp", "arm"], "value", "mid")
    off = rows.join(middle, ["grp", "arm"]).withColumn("off", F.round(F.abs(F.col("value") - F.col("mid")), 6))
    spread = _median(off, ["grp", "arm"], "off", "mad")
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    arms = middle.join(spread, ["grp", "arm"]).groupBy("grp").agg(
        *[pick(a, "mid").alias(f"m_{a}") for a in ("a", "b", "a1", "a2")], pick("a1", "mad").alias("s1"), pick("a2", "mad").alias("s2")
    )
    delta = F.round(F.col("m_b") - F.col("m_a"), 6)
    floor = F.round(F.greatest(F.abs(F.coalesce("m_a1", F.lit(0.0)) - F.coalesce("m_a2", F.lit(0.0))), F.coalesce("s1", F.lit(0.0)), F.coalesce("s2", F.lit(0.0))), 6)
    out = arms.select("grp", "m_a", "m_b", delta.alias("delta"), floor.alias("floor"))
    beats = F.coalesce(F.abs("delta") > F.col("floor"), F.lit(False))
    return out.withColumn("beats", beats).withColumn("better", F.when(beats, F.when(F.col("delta") < 0, "b").otherwise("a")))


def budget_check(counts: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Counts (key, value) over their ceiling, missing or non-finite ones included."""
    rows = ceilings.join(counts, "key", "left")
    bad = F.col("value").isNull() | F.isnan(F.col("value").cast("double")) | (F.col("value") > F.col("ceiling"))
    return rows.select("key", "value", "ceiling", bad.alias("over"))


def lower_ceilings(counts: DataFrame, ceilings: DataFrame) -> DataFrame:
    """New ceilings: lowered where the count is below, never raised; ``refused`` marks a raise."""
    rows = ceilings.join(counts, "key", "left")
    return rows.select("key", F.least("ceiling", F.coalesce("value", "ceiling")).alias("ceiling"), F.coalesce(F.col("value") > F.col("ceiling"), F.lit(False)).alias("refused"))
