"""Filter queries: orders cite brands, flags and ship days; customers, parts and documents fill the library."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import filters as op
from threadloom.plans.base import query


def order_refs(t) -> DataFrame:
    line = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    dsts = F.array("p_brand", F.concat(F.lit("flag "), "l_returnflag"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    return line.select(F.col("l_orderkey").alias("src"), F.explode(dsts).alias("dst"))


TREE = op.All(
    (
        op.Any_((op.Cites("Brand#2"), op.Cites("Brand#17"))),
        op.Not(op.Cites("flag R")),
        op.Any_((op.Cites("flag A"), op.between(date(1996, 3, 1), date(1996, 3, 31)))),
    )
)
HITS_SQL = """SELECT l_orderkey AS src FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
 HAVING bool_or(p_brand IN ('Brand#2', 'Brand#17')) AND NOT bool_or(l_returnflag = 'R')
 AND (bool_or(l_returnflag = 'A') OR bool_or(l_shipdate::DATE BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'))"""


@query("ref_query", HITS_SQL)
def _(t):
    return op.ref_query(order_refs(t), TREE)


@query(
    "query_rows",
    f"""
WITH h AS ({HITS_SQL}), r AS (SELECT o_orderkey AS uid, o_orderpriority AS text, c_name AS crumb, epoch_ms(o_orderdate) AS edited
  FROM h JOIN orders ON src = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')
SELECT *, row_number() OVER (ORDER BY edited DESC, uid) AS pos, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r) < 0 AS partial FROM r""",
)
def _(t):
    nodes = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("uid"),
        F.col("o_orderpriority").alias("text"),
        F.col("c_name").alias("crumb"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("edited"),
    )
    exclude = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("src"))
    return op.query_rows(order_refs(t), TREE, nodes, exclude)


@query(
    "ref_leaf_hits",
    """
WITH p AS (SELECT p_partkey AS leaf FROM part WHERE p_brand = 'Brand#2'),
 d AS (SELECT DISTINCT leaf, l_orderkey FROM lineitem JOIN p ON l_partkey = leaf)
SELECT leaf, concat('o', l_orderkey) AS uid, false AS partial FROM d
UNION SELECT leaf, concat_ws('-', 'l', x.l_orderkey, l_linenumber, l_partkey, l_suppkey), false FROM d JOIN lineitem x ON x.l_orderkey = d.l_orderkey
UNION SELECT leaf, concat_ws('-', 'l', l_orderkey, l_linenumber, l_partkey, l_suppkey), false FROM lineitem JOIN p ON l_partkey = leaf""",
)
def _(t):
    leaves = t.part.where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("leaf"))
    line = F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = F.concat(F.lit("o"), "l_orderkey")
    refs = t.lineitem.select(order.alias("src"), F.col("l_partkey").alias("dst"))
    children = t.lineitem.select(order.alias("parent"), line.alias("uid"))
    on_page = t.lineitem.select(F.col("l_partkey").alias("leaf"), line.alias("uid"))
    return op.ref_leaf_hits(refs, leaves, children, on_page)


def doc_rows(t):
    return t.documents.select(
        F.col("doc_id").alias("uid"),
        F.col("source").alias("type"),
        F.array("lang").alias("tags"),
        F.lower("text").alias("lower"),
        (F.lit(1_700_000_000_000) - F.col("n_chars") * 600_000).alias("edited"),
        F.col("text").contains("whe").alias("on_board"),
    )


@query(
    "library_filter",
    """SELECT doc_id AS uid, source AS type FROM documents WHERE source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6') AND lang = 'en'
  AND contains(lower(text), 'the') AND contains(lower(text), 'of the') AND n_chars * 600000 < 30 * 86400000::BIGINT AND NOT contains(text, 'whe')""",
)
def _(t):
    kinds = ["src1", "src2", "src3", "src4", "src5", "src6"]
    return op.library_filter(
        doc_rows(t), types=kinds, tag="en", text='The "of  the"', days=30, now_ms=1_700_000_000_000, orphan=True
    ).select("uid", "type")


@query(
    "meta_filter",
    """
SELECT o_orderkey AS uid FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE o_orderpriority = '1-URGENT' AND n > 0 AND p > 0 AND epoch_ms(o_orderdate) > 900000000000 - 400 * 86400000::BIGINT""",
)
def _(t):
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("children"), F.count_distinct("l_partkey").alias("refs"))
    rows = t.orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("uid"),
        F.col("o_orderpriority").alias("created_by"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created"),
        "children",
        "refs",
    )
    return op.meta_filter(rows, created_by="1-urgent", refs=True, children=True, created_days=400, now_ms=900_000_000_000).select("uid")


@query(
    "browse",
    """
SELECT event_id AS uid, event_type AS kind, epoch_us(ts) // 1000 AS edited, row_number() OVER (ORDER BY epoch_us(ts) // 1000 DESC, event_id) AS pos FROM events WHERE event_type IN ('click', 'purchase')
  AND epoch_us(ts) // 1000 > 1705500000000 - 10 * 86400000::BIGINT AND user_id = 8""",
)
def _(t):
    rows = t.events.select(
        F.col("event_id").alias("uid"),
        F.col("event_type").alias("kind"),
        F.col("user_id").cast("string").alias("created_by"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("edited"),
    )
    return op.browse(rows, now_ms=1_705_500_000_000, kinds=["click", "purchase"], days=10, created_by="8").drop("created_by")


@query(
    "library_search",
    """
WITH r AS (SELECT 'doc' AS kind, doc_id::VARCHAR AS uid, concat(source, ' ', lang) AS title, lower(text) AS low FROM documents
 UNION ALL SELECT 'page', page_id::VARCHAR, url, lower(html) FROM pages
 UNION ALL SELECT 'talk', concat(conv_id, '-', turn), role, lower(text) FROM conversations)
SELECT kind, uid, title, row_number() OVER (ORDER BY starts_with(low, 'tion') DESC, length(title), kind, uid) AS pos FROM r WHERE contains(low, 'tion') AND contains(low, 'the')""",
)
def _(t):
    docs = t.documents.select(F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("uid"), F.concat_ws(" ", "source", "lang").alias("title"), F.lower("text").alias("lower"))
    pages = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("uid"), F.col("url").alias("title"), F.lower("html").alias("lower"))
    talk = t.conversations.select(F.lit("talk").alias("kind"), F.concat_ws("-", "conv_id", "turn").alias("uid"), F.col("role").alias("title"), F.lower("text").alias("lower"))
    return op.library_search([docs, pages, talk], "tion the")


@query(
    "search_pages",
    """SELECT p_partkey AS uid, p_name AS title, starts_with(lower(p_name), 're') AS prefix, row_number() OVER (ORDER BY starts_with(lower(p_name), 're') DESC, length(p_name), lower(p_name), p_partkey) AS pos FROM part WHERE contains(lower(p_name), 're')""",
)
def _(t):
    return op.search_titles(t.part.select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("title")), "Re")


@query(
    "orphans",
    """
SELECT 'part' AS kind, p_partkey AS uid FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)
UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')""",
)
def _(t):
    items = reduce(
        DataFrame.unionByName,
        [
            t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("uid")),
            t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("uid")),
            t.supplier.select(F.lit("board").alias("kind"), F.col("s_suppkey").alias("uid")),
        ],
    )
    under = t.orders.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.lit("customer").alias("kind"), F.col("o_custkey").alias("uid"))
    cited = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 49").select(F.lit("part").alias("kind"), F.col("l_partkey").alias("uid"))
    return op.orphans(items, under, cited)


@query("table_filter", "SELECT * FROM customer WHERE contains(lower(concat_ws(chr(31), c_custkey, c_name, c_mktsegment)), '13') OR contains(lower(c_mktsegment), '13')")
def _(t):
    return op.table_filter(t.customer, ["c_custkey", "c_name", "c_mktsegment"], " 13 ")


@query(
    "bright_set",
    """SELECT l_orderkey AS uid FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2'))
  AND bool_or(l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45))""",
)
def _(t):
    items = t.lineitem.select(F.col("l_orderkey").alias("uid"), F.lit("card").alias("type"), F.array("l_partkey").alias("targets"))
    hits = lambda cond: t.part.where(cond).select(F.col("p_partkey").alias("target"))
    return op.bright_set(items, [hits("p_brand = 'Brand#2'"), hits("p_size > 45")])


@query(
    "lens_catalog",
    """
WITH c AS (SELECT p_partkey AS seq, unnest(string_split(p_name, ' ')) AS tag, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part),
 d AS (SELECT seq, tag, min(i) AS i FROM c GROUP BY ALL), f AS (SELECT tag, min(seq) AS first_seq, count(*) AS cards FROM d GROUP BY 1)
SELECT f.tag, first_seq, i AS first_i, cards FROM f JOIN d ON d.tag = f.tag AND d.seq = first_seq""",
)
def _(t):
    return op.lens_catalog(t.part.select(F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("uid"), F.split("p_name", " ").alias("tags")))


@query("bucket_members", "SELECT o_orderkey AS uid FROM orders WHERE o_orderpriority = '2-HIGH'")
def _(t):
    attrs = t.orders.select(F.col("o_orderkey").alias("owner"), F.lit("Priority").alias("name"), F.col("o_orderpriority").alias("value"))
    return op.bucket_members(attrs, attrs, name="priority", value="2-high")


def line_boxes(t):
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("uid"),
        "l_orderkey", "l_suppkey", "l_returnflag",
        F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"),
        (F.col("l_discount") * 100).alias("w"),
        (F.col("l_tax") * 1000).alias("h"),
    )


BOX_SQL = "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS uid, l_quantity AS x, l_extendedprice AS y, l_discount * 100 AS w, l_tax * 1000 AS h FROM lineitem"


@query("spatial_in_rectangle", f"SELECT uid FROM ({BOX_SQL}) WHERE x >= 10 AND y >= 20000 AND x + w <= 30 AND y + h <= 60000")
def _(t):
    return op.in_rectangle(line_boxes(t), 10, 20000, 20, 40000).select("uid")


@query(
    "spatial_outermost",
    """SELECT concat('o', o_orderkey) AS uid FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) FROM lineitem
WHERE l_quantity < 40 AND l_quantity + l_discount * 100 > 10 AND l_extendedprice < 60000 AND l_extendedprice + l_tax * 1000 > 50000
 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)""",
)
def _(t):
    lines = op.in_rectangle(line_boxes(t), 10, 50000, 30, 10000, mode="intersect").select("uid")
    orders = t.orders.where("o_totalprice > 300000").select(F.concat(F.lit("o"), "o_orderkey").alias("uid"))
    closure = line_boxes(t).select(F.concat(F.lit("o"), "l_orderkey").alias("anc"), F.col("uid").alias("desc"))
    return op.outermost(orders.unionByName(lines), closure)


@query(
    "spatial_in_polygon",
    f"""SELECT uid FROM ({BOX_SQL}) WHERE y BETWEEN 10000 AND 90000 AND x >= 5 AND
 ((y <= 50000 AND x <= 5 + 40 * (y - 10000) / 40000) OR (y >= 50000 AND x <= 45 - 40 * (y - 50000) / 40000))""",
)
def _(t):
    return op.in_polygon(line_boxes(t), [(5.0, 10000.0), (45.0, 50000.0), (5.0, 90000.0)]).select("uid")


@query(
    "spatial_container_of",
    """
WITH b AS (SELECT p_partkey AS box, p_size::DOUBLE AS x0, p_size + 3.0 AS x1, p_retailprice * 40 AS y0, p_retailprice * 40 + p_size * 10 AS y1 FROM part),
 j AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS uid, l_quantity AS x, l_extendedprice AS y, box, (x1 - x0) * (y1 - y0) AS area
  FROM lineitem JOIN b ON l_quantity BETWEEN x0 AND x1 AND l_extendedprice BETWEEN y0 AND y1)
SELECT uid, x, y, arg_min(box, (area, box)) AS box, count(*) AS n_boxes FROM j GROUP BY uid, x, y""",
)
def _(t):
    size = F.col("p_size").cast("double")
    boxes = t.part.select(
        F.col("p_partkey").alias("box"), size.alias("x0"), (size + 3).alias("x1"),
        (F.col("p_retailprice") * 40).alias("y0"), (F.col("p_retailprice") * 40 + size * 10).alias("y1"),
    )
    return op.container_of(line_boxes(t).select("uid", "x", "y"), boxes, 1.0, 100.0)


@query(
    "spatial_neighbourhood",
    f"""
WITH i AS MATERIALIZED (SELECT {BOX_SQL.removeprefix('SELECT ').replace(' FROM lineitem', '')}, l_suppkey AS board, l_returnflag = 'R' AND l_quantity > 45 AS mark FROM lineitem),
 m AS (SELECT *, x + w / 2 AS mx, y + h / 2 AS my, greatest(w, 6.0) / 2 AS hw, greatest(h, 4000.0) / 2 AS hh FROM i)
SELECT a.board, a.uid AS landmark, b.uid FROM m a JOIN m b ON a.board = b.board AND (a.uid = b.uid OR (b.mx BETWEEN a.mx - a.hw AND a.mx + a.hw AND b.my BETWEEN a.my - a.hh AND a.my + a.hh)) WHERE a.mark""",
)
def _(t):
    items = line_boxes(t).withColumnRenamed("l_suppkey", "board")
    return op.neighbourhood_members(items, items.where("l_returnflag = 'R' AND x > 45"), 6.0, 4000.0)


@query("same_value", "SELECT p_partkey AS uid, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 28 AND p_type = 'ECONOMY')")
def _(t):
    seeds = t.part.where("p_size = 28 AND p_type = 'ECONOMY'")
    return op.same_value(t.part.select(F.col("p_partkey").alias("uid"), "p_brand"), seeds, "p_brand")
