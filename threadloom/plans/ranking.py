"""Ranking and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import ranking as op
from threadloom.operators import search
from threadloom.plans.aggregates import micros, millis
from threadloom.plans.base import query
from threadloom.plans.relations import UID


ROWS_SQL = """WITH r AS (SELECT o_orderkey AS seq, concat('000001', lower(o_orderpriority), ' ', lpad(length(o_custkey::VARCHAR)::VARCHAR, 6, '0'), o_custkey) AS title,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS edited, CASE WHEN o_custkey % 10 > 0 THEN o_orderdate END AS created, refs, parts AS children, length(concat(o_orderpriority, ' ', o_custkey)) AS text_length
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS refs, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT seq, {1}row_number() OVER (ORDER BY {0}seq) AS pos FROM r"""


def sortable(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("seq")).agg(F.count("*").alias("refs"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("children"))
    title = F.concat_ws(" ", "o_orderpriority", "o_custkey")
    day = millis("o_orderdate")
    rows = t.orders.select(
        F.col("o_orderkey").alias("seq"), title.alias("title"), F.length(title).alias("text_length"), F.when(F.col("o_orderstatus") != "P", day).alias("edited"), F.when(F.col("o_custkey") % 10 > 0, day).alias("created")
    )
    return rows.join(lines, "seq", "left")


# Columns a sort shows beside the position, and their SQL.
SHOWN = {"edited": "epoch_ms(edited) AS edited, "}


def _sorted_query(sort, order):
    @query(f"sort_rows_{sort}", ROWS_SQL.format(order, SHOWN.get(sort, "")))
    def _(t):
        return op.sort_rows(sortable(t), sort).select("seq", *[c for c in SHOWN if c == sort], "pos")


for _sort, _by in {
    "best": "", "edited": "edited DESC NULLS LAST, ", "created": "created DESC NULLS LAST, ", "oldest": "created NULLS LAST, ", "linked": "refs DESC NULLS LAST, ",
    "children": "children DESC NULLS LAST, ", "longest": "text_length DESC, ", "title": "title, ",
}.items():
    _sorted_query(_sort, _by)


DOT_SQL = """SELECT e.vec_id, e.label, row_number() OVER (ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) DESC, e.vec_id) AS r
 FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"""


def vector_hits(t):
    items = t.embeddings.select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vec"), "label")
    first = items.orderBy("uid").limit(1)
    return search.nearest_vectors(items, first, k=None, skip_source=False)


@query("semantic_candidates", f"SELECT uid, page, rank, pos, row_number() OVER (ORDER BY rank) AS place FROM (SELECT vec_id AS uid, label AS page, r AS rank, row_number() OVER (PARTITION BY label ORDER BY r) AS pos FROM ({DOT_SQL})) WHERE pos <= 2")
def _(t):
    hits = vector_hits(t).select("uid", F.col("label").alias("page"), F.col("pos").alias("rank"))
    return op.semantic_candidates(hits)


@query(
    "heading_assign",
    """SELECT conv_id AS doc, turn AS pos, concat(conv_id, '-', turn) AS uid, role = 'user' AS is_heading,
 last_value(CASE WHEN role = 'user' THEN concat(conv_id, '-', turn) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations""",
)
def _(t):
    return op.heading_assign(t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.concat_ws("-", "conv_id", "turn").alias("uid"), (F.col("role") == "user").alias("is_heading")))


@query(
    "journal_window",
    """
WITH e AS (SELECT ts::DATE AS d, event_id AS uid, epoch_us(ts) AS ord FROM events WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-25')
SELECT strftime(d, '%Y-%m-%d') AS day, uid, ord, pos, 0 AS more FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ord, uid) AS pos, count(*) OVER (PARTITION BY d) AS n FROM e)""",
)
def _(t):
    rows = t.events.select(F.to_date("ts").alias("day"), F.col("event_id").alias("uid"), micros("ts").alias("ord"))
    return op.journal_window(rows, "2024-01-24", 14).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "inbox",
    """
SELECT l_orderkey AS uid, strftime(o_orderdate, '%Y-%m-%d') AS day, max(epoch_ms(l_shipdate)) AS time, row_number() OVER (ORDER BY max(l_shipdate) DESC, o_orderdate DESC, l_orderkey) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE p_brand = 'Brand#2' AND o_orderstatus <> 'P' GROUP BY l_orderkey, o_orderdate""",
)
def _(t):
    cites = t.lineitem.join(t.part.where("p_brand = 'Brand#2'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    entries = cites.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("uid"), F.to_date("o_orderdate").alias("day"), millis("l_shipdate").alias("time"))
    return op.inbox(entries, t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("uid"))).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "arrivals",
    """
WITH p AS (SELECT user_id AS owner, event_id AS uid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events WHERE event_type = 'click'),
 u AS (SELECT user_id AS owner, count(*) AS used FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT p.owner, uid, pos, pos <= greatest(0, 20 - coalesce(used, 0)) AS shown FROM p LEFT JOIN u ON u.owner = p.owner""",
)
def _(t):
    rows = t.events.select(F.col("user_id").alias("owner"), F.col("event_id").alias("uid"), micros("ts").alias("ord"), "event_type")
    return op.arrivals(rows.where("event_type = 'click'").drop("event_type"), rows.where("event_type = 'purchase'"), 20)


@query(
    "walk_stops",
    f"""
WITH i AS (SELECT l_suppkey AS board, {UID} AS uid, l_quantity AS x, l_extendedprice AS y, l_returnflag = 'R' AND l_quantity > 45 AS mark FROM lineitem),
 c AS (SELECT a.board, a.uid, count(*) AS members FROM i a JOIN i b ON a.board = b.board AND abs(a.x - b.x) <= 5 AND abs(a.y - b.y) <= 2000 WHERE a.mark GROUP BY 1, 2)
SELECT i.board, i.uid, x, y, floor(y / 200)::BIGINT AS "row", row_number() OVER (PARTITION BY i.board ORDER BY floor(y / 200), x, y, i.uid) AS pos, members FROM i JOIN c ON c.board = i.board AND c.uid = i.uid WHERE mark""",
)
def _(t):
    items = t.lineitem.select(F.col("l_suppkey").alias("board"), F.expr(UID).alias("uid"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), "l_returnflag")
    return op.walk_stops(items.where("l_returnflag = 'R' AND x > 45").drop("l_returnflag"), items, 5.0, 2000.0)


@query(
    "footnote_numbers",
    """
WITH f AS (SELECT l_suppkey AS doc, concat('n', l_partkey) AS note, min(l_orderkey * 10 + l_linenumber) AS first_pos FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY first_pos, note) AS n FROM f)
SELECT doc, note, first_pos, n AS number, false AS overflow FROM r""",
)
def _(t):
    marked = t.lineitem.select(
        F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.explode(F.regexp_extract_all(F.concat(F.lit("see [^n"), "l_partkey", F.lit("] and on")), F.lit(r"\[\^([^\]]+)\]"), F.lit(1))).alias("note"),
    )
    return op.footnote_numbers(marked, t.part.where("p_size < 40").select(F.concat(F.lit("n"), "p_partkey").alias("note")))


@query(
    "merge_semantic",
    f"""
WITH k AS (SELECT doc_id AS uid, n_chars AS rank FROM documents WHERE contains(lower(text), 'thand') ),
 s AS (SELECT vec_id AS uid, r AS rank FROM ({DOT_SQL}) WHERE vec_id NOT IN (SELECT uid FROM k))
SELECT *, row_number() OVER (ORDER BY semantic, rank, uid) AS pos FROM (SELECT uid, rank, false AS semantic FROM k UNION ALL SELECT uid, rank, true FROM s)""",
)
def _(t):
    keyword = t.documents.where(F.lower("text").contains("thand")).select(F.col("doc_id").alias("uid"), F.col("n_chars").alias("rank"))
    return op.merge_semantic(keyword, vector_hits(t).select("uid", F.col("pos").cast("long").alias("rank")))


PAGED_SQL = """SELECT doc_id AS doc, concat('b', i) AS block_id, i // 20 AS page, i AS pos, string_split(text, chr(10))[i + 1] AS text
 FROM documents, unnest(range(len(string_split(text, chr(10))))) u(i)"""


@query(
    "fill_free_pages",
    f"""
WITH l AS ({PAGED_SQL}), paid AS (SELECT * FROM l WHERE contains(text, ',')), free AS (SELECT doc, concat('b', pos // 2) AS block_id, page, pos, text FROM l WHERE pos > 0)
SELECT doc, block_id, page, pos, text, false AS filled FROM paid
UNION ALL SELECT f.doc, CASE WHEN p.block_id IS NULL THEN f.block_id ELSE concat(f.block_id, '~f') END, page, pos, text, true FROM free f
 LEFT JOIN (SELECT doc, block_id FROM paid) p ON p.doc = f.doc AND p.block_id = f.block_id WHERE (f.doc, f.page) NOT IN (SELECT (doc, page) FROM paid)""",
)
def _(t):
    lines = t.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("page", F.floor(F.col("pos") / 20))
    named = lambda df, idx: df.withColumn("block_id", F.concat(F.lit("b"), idx.cast("string"))).select("doc", "block_id", "page", "pos", "text")
    return op.fill_free_pages(named(lines.where(F.col("text").contains(",")), F.col("pos")), named(lines.where("pos > 0"), F.floor(F.col("pos") / 2)))


@query(
    "best_local_doc",
    """
WITH r AS (SELECT md5(lang || length(text)::VARCHAR) AS file, doc_id AS uid, n_chars AS "at", source AS engine, CASE source WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 WHEN 'src3' THEN 2 ELSE 1 END AS tier FROM documents WHERE source <> 'src0')
SELECT file, arg_max(uid, (tier, "at", uid)) AS uid, arg_max(engine, (tier, "at", uid)) AS engine, arg_max("at", (tier, "at", uid)) AS "at", count(*) AS reads FROM r GROUP BY file""",
)
def _(t):
    tiers = {f"src{i}": {1: 3, 2: 2, 3: 2}.get(i, 1) for i in range(1, 64)}
    reads = t.documents.select(F.md5(F.concat("lang", F.length("text").cast("string"))).alias("file"), F.col("doc_id").alias("uid"), F.col("n_chars").alias("at"), F.col("source").alias("engine"))
    return op.best_local_doc(reads, tiers)
