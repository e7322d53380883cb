"""Telemetry queries: the event table is the recorder's log, users are sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.windows import range_row_number
from threadloom.operators import telemetry as op
from threadloom.operators import traces
from threadloom.plans.aggregates import micros
from threadloom.plans.base import query

K = "cast(get_json_object(props, '$.k') AS int)"


@query(
    "stall_attribution",
    """
WITH e AS (SELECT event_type, value, json_extract_string(props, '$.k')::INT AS k FROM events),
 x AS (SELECT CASE WHEN k > 90 THEN 'no board' WHEN k / 60.0 < 0.2 THEN 'map' WHEN k / 60.0 < 0.6 THEN 'overview' WHEN k / 60.0 < 0.9 THEN 'small' WHEN k / 60.0 < 1.3 THEN 'reading' ELSE 'close' END AS band, * FROM e),
 o AS (SELECT band, event_type AS owner, value * 0.5 - value * 0.1 AS script, value * 0.1 AS forced FROM x UNION ALL SELECT band, '(native)', value * 0.2 - 0.0, 0.0 FROM x
  UNION ALL SELECT band, '(render)', value * 0.1, 0.0 FROM x UNION ALL SELECT band, '(rest)', greatest(0.0, value - (0.0::DOUBLE + value * 0.5 + value * 0.2) - value * 0.1), 0.0 FROM x)
SELECT 'log' AS context, band, owner, sum(script::DECIMAL(24,6))::DOUBLE AS script, sum(forced::DECIMAL(24,6))::DOUBLE AS forced, count(*) AS n FROM o GROUP BY 2, 3""",
)
def _(t):
    script = lambda owner, d, f: F.struct(owner.alias("owner"), d.alias("d"), f.alias("f"))
    k = F.expr(K)
    frames = t.events.select(
        F.col("event_id").alias("uid"), F.col("value").alias("d"), (F.col("value") * 0.1).alias("render"), F.when(k <= 90, k / 60.0).alias("zoom"), F.lit("log").alias("context"),
        F.array(script(F.col("event_type"), F.col("value") * 0.5, F.col("value") * 0.1), script(F.lit("(native)"), F.col("value") * 0.2, F.lit(0.0))).alias("scripts"),
    )
    return op.stall_attribution(frames)


def log(t, kinds):
    return t.events.where(F.col("event_type").isin(kinds)).select(F.col("user_id").alias("session"), F.col("event_id").alias("uid"), micros("ts").alias("at"), "event_type", "value")


SPAN = 5_400_000_000
LOG_SQL = "SELECT user_id AS session, event_id AS uid, epoch_us(ts) AS tm, event_type, value FROM events"


@query(
    "stall_to_gesture",
    f"""
WITH e AS ({LOG_SQL}), s AS (SELECT * FROM e WHERE event_type = 'error'), g AS (SELECT session, uid AS gid, tm AS st, tm + {SPAN} AS en FROM e WHERE event_type = 'purchase')
SELECT s.session, s.uid, s.tm AS st, arg_max(gid, (g.st, gid)) AS gid FROM s LEFT JOIN g ON g.session = s.session AND s.tm BETWEEN g.st AND g.en + 250000 GROUP BY 1, 2, 3""",
)
def _(t):
    stalls = log(t, ["error"]).select("session", "uid", F.col("at").alias("st"))
    gestures = log(t, ["purchase"]).select("session", F.col("uid").alias("gid"), F.col("at").alias("st"), (F.col("at") + SPAN).alias("en"))
    return op.stall_to_gesture(stalls, gestures)


@query(
    "nearest_input_context",
    f"""
WITH e AS ({LOG_SQL}), s AS (SELECT session, uid, tm + (value * 1000)::BIGINT AS en FROM e WHERE event_type = 'error')
SELECT s.session, s.uid, coalesce(arg_max(i.event_type, (i.tm, i.uid)), 'idle') AS context FROM s LEFT JOIN e i ON i.session = s.session AND i.event_type IN ('click', 'view') AND i.tm <= s.en AND i.tm >= s.en - 7200000000 GROUP BY 1, 2""",
)
def _(t):
    stalls = log(t, ["error"]).select("session", "uid", (F.col("at") + F.round(F.col("value") * 1000).cast("long")).alias("at"))
    inputs = log(t, ["click", "view"]).select("session", "at", F.col("event_type").alias("label"))
    return op.nearest_input_context(stalls, inputs, 7_200_000_000)


@query(
    "hover_moments",
    """
WITH e AS (SELECT user_id AS owner, event_id AS uid, epoch_us(ts) AS tm, value AS d, event_type = 'view' AS b FROM events),
 l AS (SELECT *, CASE WHEN tm - lag(tm) OVER w <= 3600000000 THEN 0 ELSE 1 END AS brk FROM e WINDOW w AS (PARTITION BY owner ORDER BY tm, uid)),
 g AS (SELECT *, sum(brk) OVER (PARTITION BY owner ORDER BY tm, uid) AS m FROM l)
SELECT owner, min(tm) AS start, max(d) AS d, bool_or(b) AS in_board, count(*) AS n FROM g GROUP BY owner, m""",
)
def _(t):
    rows = t.events.select(F.col("user_id").alias("owner"), F.col("event_id").alias("uid"), micros("ts").alias("at"), F.col("value").alias("d"), (F.col("event_type") == "view").alias("in_board"))
    return op.hover_moments(rows, 3_600_000_000)


@query(
    "tail_stalls",
    f"""
WITH e AS ({LOG_SQL}) SELECT session, uid, tm AS "at" FROM e s WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM e a WHERE a.session = s.session AND a.event_type = 'purchase' AND s.tm >= a.tm AND s.tm <= a.tm + {SPAN})""",
)
def _(t):
    return op.tail_stalls(log(t, ["error"]), log(t, ["purchase"]).select("session", "at"), SPAN)


@query(
    "latency_summary",
    """
WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
 p AS (SELECT event_type, n, max(value) FILTER (i = greatest(0, ceil(n * 50 / 100.0) - 1)) AS p50, max(value) FILTER (i = greatest(0, ceil(n * 75 / 100.0) - 1)) AS p75, max(value) FILTER (i = greatest(0, ceil(n * 90 / 100.0) - 1)) AS p90,
  max(value) FILTER (i = greatest(0, ceil(n * 95 / 100.0) - 1)) AS p95, max(value) FILTER (i = least(n - 1, floor(n * 50 / 100.0))) AS q50, max(value) FILTER (i = least(n - 1, floor(n * 90 / 100.0))) AS q90, max(value) AS max,
  (max(value) FILTER (i = (n - 1) // 2) + max(value) FILTER (i = n // 2)) / 2 AS median FROM v GROUP BY 1, 2)
SELECT p.*, m.mad FROM p JOIN (SELECT event_type, median(round(abs(value - p2.median), 6)) AS mad FROM events JOIN p p2 USING (event_type) GROUP BY 1) m USING (event_type)""",
)
def _(t):
    return op.latency_summary(t.events.select("event_type", "value"), ["event_type"], "value")


# A task per event, touching or ending before the next event of its thread, holds a script span, that a layout span, and that a span without category;
# a paint span of the middle begins inside the script span and outlasts it.
SHAPE = {"click": "FunctionCall", "view": "UpdateLayoutTree", "purchase": "Paint", "signup": "MinorGC.1", "error": "FunctionCall"}
TRACE_SQL = """
WITH x AS (SELECT user_id AS thread, event_id AS uid, event_type AS k, epoch_us(ts) AS s, least(1000 + round(coalesce(value, 0) * 1000)::BIGINT, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts), 1000)) AS d,
  epoch_us(TIMESTAMP '2024-01-05') AS lo, epoch_us(TIMESTAMP '2024-01-20') AS hi FROM events),
 r AS (SELECT thread, uid, 0 AS lvl, 'other' AS category, s, s + d AS f, lo, hi FROM x
  UNION ALL SELECT thread, uid, 1, CASE k WHEN 'click' THEN 'script' WHEN 'error' THEN 'script' WHEN 'view' THEN 'style' WHEN 'purchase' THEN 'paint' ELSE 'gc' END, s + d // 4, s + d // 4 + d // 2, lo, hi FROM x
  UNION ALL SELECT thread, uid, 2, 'layout', s + d // 4, s + d // 4 + d // 4, lo, hi FROM x
  UNION ALL SELECT thread, uid, 3, 'other', s + d // 4 + d // 2 - d // 8, s + d // 4 + d // 2, lo, hi FROM x),
 c AS (SELECT thread, uid, lvl, category, greatest(s, lo) AS c0, least(f, hi) AS c1 FROM r WHERE least(f, hi) > greatest(s, lo)),
 w AS (SELECT c.*, c1 - c0 - coalesce((SELECT sum(i.c1 - i.c0) FROM c i WHERE i.thread = c.thread AND i.uid = c.uid AND ((c.lvl = 0 AND i.lvl = 1) OR (c.lvl = 1 AND i.lvl IN (2, 3)))), 0) AS self,
  EXISTS (SELECT 1 FROM c i WHERE i.thread = c.thread AND i.uid = c.uid AND c.lvl > 1 AND i.lvl = 1 AND i.category = 'script') AS forced FROM c)
"""


def trace(t):
    at = micros("ts")
    rows = range_row_number(t.events.select(F.col("user_id").alias("thread"), F.col("event_id").alias("uid"), F.col("event_type").alias("k"), "value", at.alias("at")), ["thread"], ["at", "uid"], "i")
    following = rows.select("thread", (F.col("i") - 1).alias("i"), F.col("at").alias("next"))
    met = rows.join(following, ["thread", "i"], "left")
    d = F.least(F.lit(1000) + F.round(F.coalesce("value", F.lit(0.0)) * 1000).cast("long"), F.coalesce(F.col("next") - F.col("at"), F.lit(1000)))
    base = met.withColumn("d", d)
    part = lambda k: F.floor(F.col("d") / k)
    name = F.element_at(F.create_map(*[F.lit(x) for kv in SHAPE.items() for x in kv]), F.col("k"))
    span = lambda lvl, n, s, dur: F.struct((F.col("uid") * 4 + lvl).alias("uid"), n.alias("name"), s.alias("at"), dur.alias("dur"))
    spans = F.array(
        span(0, F.lit("RunTask"), F.col("at"), F.col("d")), span(1, name, F.col("at") + part(4), part(2)), span(2, F.lit("Layout"), F.col("at") + part(4), part(4)),
        # the last one is longer than what it lies in, so it is cut to it
        span(3, F.lit("Unknown"), F.col("at") + part(4) + part(2) - part(8), part(8) + F.floor(part(4) / 2)),
    )
    return base.select("thread", F.inline(spans))


WINDOW = (1_704_412_800_000_000, 1_705_708_800_000_000)


@query(
    "trace_category_time",
    TRACE_SQL
    + """SELECT thread, category, sum(self)::BIGINT AS self_us, sum(CASE WHEN category IN ('style', 'layout') AND forced THEN self ELSE 0 END)::BIGINT AS forced_us, count(*) AS n FROM w GROUP BY 1, 2
UNION ALL SELECT thread, 'idle', 1296000000000 - sum(CASE WHEN lvl = 0 THEN c1 - c0 ELSE 0 END)::BIGINT, 0, count(*) FILTER (lvl = 0) FROM w GROUP BY 1""",
)
def _(t):
    return traces.trace_category_time(trace(t), *WINDOW)


@query("long_tasks", TRACE_SQL + """SELECT thread, uid * 4 AS uid, c0 - 1704412800000000 AS st, c1 - c0 AS d FROM w WHERE lvl = 0 AND c1 - c0 >= 50000""")
def _(t):
    return traces.long_tasks(trace(t), *WINDOW)


@query(
    "selector_totals",
    """SELECT concat('.', event_type, ' > #', user_id % 7) AS selector, sum(round(value * 1000)::BIGINT)::BIGINT AS us, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS attempts, sum(json_extract_string(props, '$.k')::BIGINT // 3)::BIGINT AS matches FROM events GROUP BY 1""",
)
def _(t):
    k = F.expr(K).cast("long")
    return traces.selector_totals(
        t.events.select(F.concat(F.lit("."), "event_type", F.lit(" > #"), (F.col("user_id") % 7).cast("string")).alias("selector"), F.round(F.col("value") * 1000).cast("long").alias("us"), k.alias("attempts"), F.floor(k / 3).alias("matches"))
    )


def scenario_lines(t):
    metrics = F.create_map(F.lit("ms"), F.col("value"), F.lit("k"), F.expr(K).cast("double"), F.lit("other"), F.lit(1.0))
    return t.events.select(F.col("event_type").alias("scenario"), F.col("user_id").alias("grp"), F.col("event_id").alias("uid"), micros("ts").alias("at"), metrics.alias("metrics"))


@query("newest_per_scenario", """SELECT user_id AS grp, event_type AS scenario, max(epoch_us(ts)) AS "at", arg_max(event_id, (ts, event_id)) AS uid, arg_max(value, (ts, event_id)) AS ms FROM events GROUP BY 1, 2""")
def _(t):
    out = op.newest_per_scenario(scenario_lines(t), ["grp", "scenario"])
    return out.select("grp", "scenario", "at", "uid", F.element_at("metrics", "ms").alias("ms"))


@query("step_medians", "SELECT event_type AS scenario, median(value) AS ms, median(json_extract_string(props, '$.k')::DOUBLE) AS k FROM events GROUP BY 1")
def _(t):
    return op.step_medians(scenario_lines(t), ["scenario"], ["ms", "k"])


@query(
    "ab_verdict",
    """
WITH r AS (SELECT json_extract_string(props, '$.k')::INT AS grp, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' WHEN 'purchase' THEN 'a1' WHEN 'error' THEN 'a2' END AS arm, value FROM events),
 m AS (SELECT grp, arm, median(value) AS mid FROM r WHERE arm IS NOT NULL GROUP BY 1, 2), s AS (SELECT grp, arm, median(round(abs(value - mid), 6)) AS mad FROM r JOIN m USING (grp, arm) GROUP BY 1, 2),
 p AS (SELECT grp, max(mid) FILTER (arm = 'a') AS m_a, max(mid) FILTER (arm = 'b') AS m_b, max(mid) FILTER (arm = 'a1') AS x1, max(mid) FILTER (arm = 'a2') AS x2, max(mad) FILTER (arm = 'a1') AS s1, max(mad) FILTER (arm = 'a2') AS s2 FROM m JOIN s USING (grp, arm) GROUP BY 1),
 d AS (SELECT grp, m_a, m_b, round(m_b - m_a, 6) AS delta, round(greatest(abs(coalesce(x1, 0.0) - coalesce(x2, 0.0)), coalesce(s1, 0.0), coalesce(s2, 0.0)), 6) AS floor FROM p)
SELECT *, coalesce(abs(delta) > floor, false) AS beats, CASE WHEN abs(delta) > floor THEN CASE WHEN delta < 0 THEN 'b' ELSE 'a' END END AS better FROM d""",
)
def _(t):
    arm = F.expr("CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' WHEN 'purchase' THEN 'a1' WHEN 'error' THEN 'a2' END")
    return op.ab_verdict(t.events.select(F.expr(K).alias("grp"), arm.alias("arm"), "value").where("arm IS NOT NULL"))


def counts(t):
    return t.events.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("value"))


def ceilings(t):
    return t.events.groupBy(F.col("event_type").alias("key")).agg((F.count_distinct("user_id") * 14).alias("ceiling"))


BUDGET_SQL = "SELECT event_type AS key, count(*) AS value, count(DISTINCT user_id) * 14 AS ceiling FROM events GROUP BY 1"


@query("budget_check", f"SELECT *, value > ceiling AS over FROM ({BUDGET_SQL})".replace("AS over", 'AS "over"'))
def _(t):
    return op.budget_check(counts(t), ceilings(t))


@query("lower_ceilings", f"SELECT key, least(value, ceiling) AS ceiling, value > ceiling AS refused FROM ({BUDGET_SQL})")
def _(t):
    return op.lower_ceilings(counts(t), ceilings(t))
