"""Aggregate queries over orders, lines, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import aggregates as op
from threadloom.plans.base import query
from threadloom.plans.relations import UID, cited

NOW_MS = 1_000_000_000_000


def millis(col: str):
    return F.unix_millis(F.col(col).cast("timestamp"))


def micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


@query(
    "item_meta",
    """
SELECT o_orderkey AS uid, epoch_ms(o_orderdate) AS created, ls AS edited, c_name AS created_by, length(o_orderpriority) AS text_length, coalesce(n, 0) AS children, coalesce(r, 0) AS refs
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(epoch_ms(l_shipdate)) AS ls FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
LEFT JOIN (SELECT l_partkey, count(*) AS r FROM lineitem GROUP BY 1) ON l_partkey = o_orderkey""",
)
def _(t):
    ships = t.lineitem.groupBy(F.col("l_orderkey").alias("uid")).agg(F.max(millis("l_shipdate")).alias("edited"))
    items = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("uid"), millis("o_orderdate").alias("created"), F.col("c_name").alias("created_by"), F.length("o_orderpriority").alias("text_length")
    )
    return op.item_meta(items.join(ships, "uid", "left"), t.lineitem.select(F.col("l_partkey").alias("dst")), t.lineitem.select(F.col("l_orderkey").alias("parent")))


@query(
    "card_stats",
    """
SELECT p_partkey AS uid, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN l_orderkey END) AS refs, count(DISTINCT o_custkey) AS boards,
 count(DISTINCT CASE WHEN l_linestatus <> 'F' THEN l_orderkey END) AS open, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_orderkey END) AS done
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def _(t):
    rows = cited(t)
    refs = rows.select(F.col("l_partkey").alias("dst"), F.col("l_orderkey").alias("src"), F.col("o_custkey").alias("board"), (F.col("o_orderstatus") != "P").alias("outside"))
    tasks = t.lineitem.select(F.col("l_partkey").alias("owner"), F.col("l_orderkey").alias("uid"), (F.col("l_linestatus") == "F").alias("done"))
    return op.card_stats(t.part.select(F.col("p_partkey").alias("uid")), refs, tasks)


@query(
    "comment_index",
    """
WITH n AS (SELECT conv_id AS cell, count(*) AS threads, min(turn) AS first_thread, sum(length(text)) AS native FROM conversations WHERE role = 'user' GROUP BY 1),
 l AS (SELECT conv_id AS cell, count(*) AS legacy FROM conversations GROUP BY 1)
SELECT cell, threads, first_thread, CASE WHEN native > 0 THEN native ELSE legacy END::BIGINT AS comments FROM n FULL JOIN l USING (cell)""",
)
def _(t):
    native = t.conversations.where("role = 'user'").select(F.col("conv_id").alias("cell"), F.col("turn").alias("thread"), F.length("text").alias("n"))
    legacy = t.conversations.groupBy(F.col("conv_id").alias("cell")).agg(F.count("*").alias("legacy"))
    return op.comment_index(native.unionByName(native), legacy)


def event_refs(t):
    return t.events.select(F.get_json_object("props", "$.k").cast("long").alias("target"), F.col("event_id").alias("uid"), micros("ts").alias("at"))


@query("reference_span", "SELECT json_extract_string(props, '$.k')::BIGINT AS target, count(*) AS n, min(epoch_us(ts)) AS first_at, max(epoch_us(ts)) AS last_at FROM events GROUP BY 1")
def _(t):
    return op.reference_span(event_refs(t))


@query("newest_references", "SELECT * FROM (SELECT json_extract_string(props, '$.k')::BIGINT AS target, event_id AS uid, epoch_us(ts) AS at, row_number() OVER (PARTITION BY json_extract_string(props, '$.k') ORDER BY ts DESC, event_id) AS pos FROM events)")
def _(t):
    return op.newest_references(event_refs(t))


@query(
    "time_histogram",
    """
WITH e AS (SELECT user_id AS owner, epoch_us(ts) AS tm FROM events), s AS (SELECT owner, min(tm) AS lo, max(tm) AS hi FROM e GROUP BY 1),
 c AS (SELECT owner, CASE WHEN hi = lo THEN 0 ELSE least(11, floor(((tm - lo) * 12)::DOUBLE / (hi - lo)))::INTEGER END AS bucket, count(*) AS n FROM e JOIN s USING (owner) GROUP BY 1, 2)
SELECT s.owner, b AS bucket, coalesce(n, 0) AS n FROM s CROSS JOIN unnest(range(12)) u(b) LEFT JOIN c ON c.owner = s.owner AND c.bucket = b""",
)
def _(t):
    return op.time_histogram(t.events.select(F.col("user_id").alias("owner"), micros("ts").alias("at")))


@query(
    "strength_score",
    """
WITH e AS (SELECT l_suppkey AS a, l_partkey AS b, count(*) AS refs, count(DISTINCT l_returnflag) AS shared, max(epoch_ms(l_shipdate)) AS last_ms FROM lineitem GROUP BY 1, 2)
SELECT a, b, refs, shared, last_ms, round(0.6 * least(refs, 12) / 12.0 + 0.25 * least(shared, 3) / 3.0 + 0.15 * exp(-ln(2.0) * greatest(0.0, (1000000000000 - last_ms) / 86400000.0) / 180), 8) AS strength FROM e""",
)
def _(t):
    edges = t.lineitem.groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(
        F.count("*").alias("refs"), F.count_distinct("l_returnflag").alias("shared"), F.max(millis("l_shipdate")).alias("last_ms")
    )
    return op.strength_score(edges, NOW_MS).withColumn("strength", F.round("strength", 8))


@query(
    "dusty",
    """
SELECT o_orderkey AS uid, epoch_ms(o_orderdate) AS created, e AS edited, (1000000000000 - greatest(epoch_ms(o_orderdate), e)) // 86400000 AS age_days FROM orders
LEFT JOIN (SELECT l_orderkey, max(epoch_ms(l_shipdate)) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE greatest(epoch_ms(o_orderdate), e) <= 1000000000000 - 365 * 86400000::BIGINT""",
)
def _(t):
    ships = t.lineitem.groupBy(F.col("l_orderkey").alias("uid")).agg(F.max(millis("l_shipdate")).alias("edited"))
    items = t.orders.select(F.col("o_orderkey").alias("uid"), millis("o_orderdate").alias("created")).join(ships, "uid", "left")
    return op.dusty(items, 365, NOW_MS)


def event_edits(t):
    return t.events.select(F.get_json_object("props", "$.k").cast("long").alias("item"), F.col("event_id").alias("uid"), F.col("user_id").alias("user"), micros("ts").alias("at"), "event_type")


LATEST_SQL = "SELECT json_extract_string(props, '$.k')::BIGINT AS item, max(epoch_us(ts)) AS at, arg_max(user_id, (ts, event_id)) AS \"user\" FROM events GROUP BY 1"


@query("latest_edit", LATEST_SQL)
def _(t):
    return op.latest_edit(event_edits(t))


@query(
    "changed_since",
    f"""SELECT item, "at", "user", seen FROM ({LATEST_SQL}) JOIN (SELECT json_extract_string(props, '$.k')::BIGINT AS k, max(epoch_us(ts)) AS seen FROM events WHERE event_type = 'view' GROUP BY 1) ON k = item WHERE "at" > seen""",
)
def _(t):
    visits = event_edits(t).where("event_type = 'view'").groupBy("item").agg(F.max("at").alias("seen"))
    return op.changed_since(event_edits(t), visits)


def dated_mentions(t):
    return cited(t).select(F.to_date("o_orderdate").alias("day"), F.col("l_partkey").alias("card"), F.col("o_orderkey").alias("page"), F.col("o_totalprice").alias("edited"))


@query(
    "timeline_days",
    """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, year(o_orderdate) AS year, count(*) AS mentions, count(DISTINCT l_partkey) AS cards, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS page
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderdate""",
)
def _(t):
    return op.timeline_days(dated_mentions(t)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "first_last_mention",
    "SELECT l_partkey AS card, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def _(t):
    show = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return op.first_last_mention(dated_mentions(t)).select("card", show("first_day"), show("last_day"), "n")


def order_months(t):
    span = t.orders.agg(F.to_date(F.min("o_orderdate")).alias("s"), F.to_date(F.max("o_orderdate")).alias("e"))
    return span.select(F.explode(op.month_steps(F.col("s"), F.col("e"))).alias("t"))


MONTHS_SQL = """SELECT DISTINCT m AS t FROM (SELECT min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders) x,
 LATERAL (SELECT s AS m UNION ALL SELECT e UNION ALL SELECT unnest(generate_series(date_trunc('month', s) + INTERVAL 1 MONTH, e, INTERVAL 1 MONTH))::DATE) y"""


@query("month_steps", f"SELECT strftime(t, '%Y-%m-%d') AS t FROM ({MONTHS_SQL})")
def _(t):
    return order_months(t).select(F.date_format("t", "yyyy-MM-dd").alias("t"))


@query(
    "as_of_sets",
    f"""
WITH m AS MATERIALIZED ({MONTHS_SQL}), o AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_custkey FROM orders),
 e AS (SELECT greatest(a.day, b.day) AS day, count(*) AS n FROM (SELECT o_custkey, min(o_orderkey) AS x, max(o_orderkey) AS y FROM o GROUP BY 1) JOIN o a ON a.o_orderkey = x JOIN o b ON b.o_orderkey = y GROUP BY 1)
SELECT strftime(t, '%Y-%m-%d') AS t, (SELECT count(*) FROM o WHERE day > t) AS future, (SELECT count(*) FROM o WHERE day <= t AND day > t - 7) AS fresh,
 coalesce((SELECT sum(n) FROM e WHERE day > t), 0)::BIGINT AS hidden_edges FROM m""",
)
def _(t):
    items = t.orders.select(F.col("o_orderkey").alias("uid"), F.to_date("o_orderdate").alias("day"))
    edges = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("from_uid"), F.max("o_orderkey").alias("to_uid"))
    return op.as_of_sets(items, edges, order_months(t)).withColumn("t", F.date_format("t", "yyyy-MM-dd"))


@query("calendar_slots", "SELECT o_orderkey AS uid, day(o_orderdate) AS slot, round(date_diff('day', DATE '1997-03-01', o_orderdate::DATE) / 30.0::DOUBLE, 6) AS axis FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-04-01'")
def _(t):
    return op.calendar_slots(t.orders.select(F.col("o_orderkey").alias("uid"), F.to_date("o_orderdate").alias("day")), 1997, 3)


@query(
    "kanban_columns",
    """
WITH r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'Done' WHEN o_orderstatus = 'P' THEN 'No status' ELSE o_orderpriority END AS c, o_orderkey AS seq FROM orders),
 g AS (SELECT c, count(*) AS n, min(seq) AS first_seq FROM r GROUP BY 1)
SELECT c AS "column", CASE WHEN c = 'Done' THEN 0 WHEN c = 'No status' THEN 2 ELSE 1 END AS grp, CASE WHEN c = 'Done' THEN 1 END AS fixed, first_seq, n FROM g
UNION ALL SELECT 'To do', 0, 0, NULL, 0""",
)
def _(t):
    value = F.expr("CASE WHEN o_orderstatus = 'F' THEN 'Done' WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderpriority END")
    return op.kanban_columns(t.orders.select(F.col("o_orderkey").alias("uid"), value.alias("value"), F.col("o_orderkey").alias("seq")))


@query(
    "lane_bands",
    """
WITH s AS (SELECT p_brand AS v, min(p_partkey) AS f FROM part GROUP BY 1),
 l AS (SELECT v, v NOT IN ('Brand#9', 'Brand#4') AS is_new FROM s)
SELECT p_partkey AS uid, coalesce(v, 'none') AS lane, coalesce(is_new, false) AS is_new FROM part LEFT JOIN l ON v = p_brand""",
)
def _(t):
    return op.lane_bands(t.part.select(F.col("p_partkey").alias("uid"), F.col("p_brand").alias("value"), F.col("p_partkey").alias("seq")), ["Brand#9", "Brand#4"])


def event_attributes(t):
    pairs = F.array(
        F.struct(F.lit("k").alias("name"), F.get_json_object("props", "$.k").alias("value")),
        F.struct(F.lit("type").alias("name"), F.col("event_type").alias("value")),
        F.struct(F.lit("k").alias("name"), F.lit("later").alias("value")),
    )
    return t.events.select(F.col("event_id").alias("owner"), F.posexplode(pairs).alias("ord", "p")).select("owner", "ord", "p.*")


@query("attribute_table", "SELECT event_id AS owner, json_extract_string(props, '$.k') AS k, event_type AS type FROM events")
def _(t):
    return op.attribute_table(event_attributes(t), ["k", "type"])


@query("attribute_names", "SELECT 'k' AS name, min(event_id) AS first_owner, 0 AS first_ord, 2 * count(*) AS n FROM events UNION ALL SELECT 'type', min(event_id), 1, count(*) FROM events")
def _(t):
    return op.attribute_names(event_attributes(t))


@query(
    "link_legend",
    """
SELECT concat(l_returnflag, l_linestatus) AS name, min(l_orderkey) AS first_seq, count(*) AS n, CASE l_returnflag WHEN 'R' THEN 'red' ELSE 'gray' END AS color,
 CASE l_returnflag WHEN 'R' THEN 'dashed' ELSE 'solid' END AS dash, concat(l_returnflag, l_linestatus) <> 'AF' AS shown FROM lineitem WHERE l_quantity > 10 GROUP BY ALL""",
)
def _(t):
    links = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_orderkey").alias("seq"), F.when(F.col("l_quantity") > 10, "attr").otherwise("ref").alias("kind"))
    styles = t.lineitem.where("l_returnflag = 'R'").select(F.concat("l_returnflag", "l_linestatus").alias("name"), F.lit("red").alias("color"), F.lit("dashed").alias("dash")).distinct()
    hidden = links.where("name = 'AF'").select("name")
    return op.link_legend(links, styles, hidden)
