"""Extraction queries: markup is built from table columns in Spark and in the SQL check."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import markup as m
from threadloom.operators import extraction as op
from threadloom.plans.base import query

REF_TEXT = "concat('[[part ', l_partkey, ']] ((ord', l_orderkey, ')) #', l_returnflag, ' `[[code ', l_suppkey, ']]` #', l_returnflag)"


@query(
    "extract_refs",
    r"""
WITH b AS (SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS src,
  regexp_replace(concat('[[part ', l_partkey, ']] ((ord', l_orderkey, ')) #', l_returnflag, ' `[[code ', l_suppkey, ']]` #', l_returnflag),
    '`[^`\n]*`', ' ', 'g') AS text FROM lineitem)
SELECT src, 'page' AS dst_kind, unnest(list_distinct(list_concat(regexp_extract_all(text, '\[\[([^\[\]]+)\]\]', 1),
   regexp_extract_all(text, '(?:^|[\s(,;])#([^\s\[\]#,.!?;:()`]+)', 1)))) AS dst FROM b
UNION ALL SELECT src, 'block', unnest(list_distinct(regexp_extract_all(text, '\(\(([\w-]{1,36})\)\)', 1))) FROM b""",
)
def _(t):
    uid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return op.extract_refs(t.lineitem.select(uid.alias("uid"), F.expr(REF_TEXT).alias("text")))


@query(
    "extract_links",
    r"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS urls,
  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS labels FROM pages)
SELECT page_id AS uid, i AS pos, urls[i + 1] AS url,
  CASE WHEN trim(labels[i + 1]) <> '' THEN trim(labels[i + 1]) ELSE urls[i + 1] END AS label
FROM p, unnest(range(len(urls))) AS u(i)""",
)
def _(t):
    blocks = t.pages.select(F.col("page_id").alias("uid"), F.col("html").alias("text"))
    return op.extract_links(blocks, m.HTML_ANCHOR, label_group=2, url_group=1)


def customer_markup(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("uid"),
        F.expr(
            "concat('#', lower(c_mktsegment), ' #[[', n_name, ']] ^^', c_name, '^^ and ^^ ', c_mktsegment, ' ^^ #h/', "
            "CASE WHEN c_acctbal < 0 THEN 'Red' WHEN c_acctbal < 5000 THEN 'teal' ELSE 'mauve' END, ' #', lower(c_mktsegment))"
        ).alias("text"),
    )


CUSTOMER_MARKUP_SQL = """SELECT c_custkey AS uid, concat('#', lower(c_mktsegment), ' #[[', n_name, ']] ^^', c_name, '^^ and ^^ ',
  c_mktsegment, ' ^^ #h/', CASE WHEN c_acctbal < 0 THEN 'Red' WHEN c_acctbal < 5000 THEN 'teal' ELSE 'mauve' END,
  ' #', lower(c_mktsegment)) AS text FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@query(
    "extract_tags",
    rf"""
WITH b AS ({CUSTOMER_MARKUP_SQL}),
 z AS (SELECT uid, regexp_extract_all(text, '#\[\[([^\]\n]+)\]\]|#([^\s#\[\]()]+)', 1) AS g1,
   regexp_extract_all(text, '#\[\[([^\]\n]+)\]\]|#([^\s#\[\]()]+)', 2) AS g2 FROM b),
 e AS (SELECT uid, i, trim(CASE WHEN g1[i + 1] <> '' THEN g1[i + 1] ELSE g2[i + 1] END) AS tag FROM z, unnest(range(len(g1))) u(i))
SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY min(i)) - 1 AS pos, tag FROM e WHERE tag <> '' GROUP BY uid, tag""",
)
def _(t):
    return op.extract_tags(customer_markup(t))


@query(
    "extract_highlights",
    rf"""
WITH b AS ({CUSTOMER_MARKUP_SQL}), h AS (SELECT uid, lower(regexp_extract(text, '#h/([A-Za-z]+)', 1)) AS c,
  regexp_extract_all(text, '\^\^([\s\S]*?)\^\^', 1) AS spans FROM b)
SELECT uid, CASE WHEN c IN ('gray','red','orange','yellow','green','teal','blue','indigo','purple','pink') THEN c ELSE 'gray' END AS color,
  i AS pos, trim(spans[i + 1]) AS span FROM h, unnest(range(len(spans))) u(i)""",
)
def _(t):
    return op.extract_highlights(customer_markup(t))


@query(
    "extract_attributes",
    """
SELECT event_id AS owner, 0 AS ord, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events
UNION ALL SELECT event_id, 1, 'Event type', event_type FROM events""",
)
def _(t):
    kids = F.array(
        F.concat(F.lit("k:: "), F.get_json_object("props", "$.k")),
        F.concat(F.lit(" Event type ::"), F.col("event_type"), F.lit(" ")),
        F.concat(F.lit("plain child "), F.col("value").cast("string")),
    )
    blocks = t.events.select(F.col("event_id").alias("owner"), F.posexplode(kids).alias("ord", "text"))
    return op.extract_attributes(blocks)


def line_annotations(t):
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("uid"),
        F.col("l_orderkey").alias("doc"),
        F.col("l_linenumber").alias("page"),
        F.col("l_partkey").alias("part"),
        F.expr(
            "concat('note #h/', CASE l_returnflag WHEN 'R' THEN 'red' WHEN 'A' THEN 'Blue' ELSE 'none' END)"
        ).alias("text"),
    )


def highlighted(t):
    notes = line_annotations(t)
    groups = t.orders.select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("group"))
    placed = notes.join(t.part.where("p_brand = 'Brand#2'"), F.col("part") == F.col("p_partkey"), "left_semi")
    return op.highlight_rows(notes.drop("part"), groups, placed)


HIGHLIGHT_SQL = """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS uid, l_orderkey AS doc,
  l_linenumber AS page, CASE l_returnflag WHEN 'R' THEN 'red' WHEN 'A' THEN 'blue' ELSE 'gray' END AS color, o_custkey AS "group",
  l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2') AS placed
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey"""


@query("highlight_rows", HIGHLIGHT_SQL)
def _(t):
    return highlighted(t).drop("text")


@query(
    "page_chips",
    f"""SELECT doc, page, count(*) AS n, min(uid) AS first_uid, count(*) FILTER (placed) AS n_placed
FROM ({HIGHLIGHT_SQL}) WHERE page >= 1 GROUP BY doc, page""",
)
def _(t):
    return op.page_chips(highlighted(t))


@query(
    "classify_blocks",
    """
WITH s AS (
 SELECT 'web' AS kind, 'note' AS shape FROM pages WHERE NOT contains(url, '(')
 UNION ALL SELECT 'block', 'note' FROM documents
 UNION ALL SELECT 'block', 'page' FROM part
 UNION ALL SELECT 'block', 'block' FROM orders
 UNION ALL SELECT 'image', 'image' FROM supplier
 UNION ALL SELECT 'pdf', 'pdf' FROM customer
 UNION ALL SELECT CASE WHEN p_size < 25 THEN 'region' ELSE 'pin' END, 'region' FROM part
 UNION ALL SELECT 'block', 'regions' FROM supplier)
SELECT kind, shape, count(*) AS n FROM s GROUP BY kind, shape""",
)
def _(t):
    texts = (
        t.pages.select(F.col("url").alias("text"))
        .unionByName(t.documents.select("text"))
        .unionByName(t.part.select(F.expr("concat('[[', p_name, ']]')").alias("text")))
        .unionByName(t.orders.select(F.expr("concat(' ((ord', o_orderkey, '))')").alias("text")))
        .unionByName(t.supplier.select(F.expr("concat('![', s_name, '](http://x.example/', s_suppkey, '.png)')").alias("text")))
        .unionByName(t.customer.select(F.expr("concat('{{pdf: http://x.example/', c_custkey, '.pdf}}')").alias("text")))
        .unionByName(t.part.select(F.expr("concat(CASE WHEN p_size < 25 THEN '{{[[picture-region]]: k=img d=' ELSE '{{[[page-pin]]: pg=1 d=' END, p_partkey, '}} ![see](', p_name, ')')").alias("text")))
        .unionByName(t.supplier.select(F.lit(" {{[[page-pins]]}}").alias("text")))
    )
    macros = {"picture-region": "region", "page-pin": "pin"}
    kinds = texts.select(m.library_kind(F.col("text"), macros).alias("kind"), m.block_shape(F.col("text"), list(macros), ["page-pins"]).alias("shape"))
    return kinds.groupBy("kind", "shape").agg(F.count("*").alias("n"))


@query(
    "library_row_kinds",
    """
SELECT concat('n', n_nationkey) AS uid, 'board' AS kind FROM nation
UNION ALL SELECT concat('p', p_partkey), CASE p_type WHEN 'ECONOMY' THEN 'table' WHEN 'PROMO' THEN 'heading' ELSE 'paragraph' END FROM part
UNION ALL SELECT concat('u', page_id), CASE WHEN contains(url, ' ') THEN 'block' ELSE 'web' END FROM pages
UNION ALL SELECT concat('o', o_orderkey), CASE WHEN o_orderstatus = 'P' THEN 'page' ELSE 'daily' END FROM orders""",
)
def _(t):
    none = F.lit(None).cast("string")
    row = lambda df, uid, kind, part=none, title=none, text=none: df.select(uid.alias("uid"), F.lit(kind).alias("kind"), part.alias("part"), title.alias("title"), text.alias("text"))
    key = lambda prefix, c: F.concat(F.lit(prefix), c)
    part = F.when(F.col("p_type") == "ECONOMY", "table").when(F.col("p_type") == "PROMO", "heading").otherwise("list")
    day = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("Plan of "), m.daily_title(F.to_date("o_orderdate")))).otherwise(m.daily_title(F.to_date("o_orderdate")))
    rows = (
        row(t.nation, key("n", "n_nationkey"), "board")
        .unionByName(row(t.part, key("p", "p_partkey"), "part", part=part))
        .unionByName(row(t.pages, key("u", "page_id"), "block", text=F.col("url")))
        .unionByName(row(t.orders, key("o", "o_orderkey"), "page", title=day))
    )
    return rows.select("uid", m.library_row_kind(*[F.col(c) for c in ("kind", "part", "title", "text")]).alias("kind"))


TITLE_SQL = """concat(monthname(d), ' ', day(d), CASE WHEN day(d) BETWEEN 11 AND 13 THEN 'th' WHEN day(d) % 10 = 1 THEN 'st'
  WHEN day(d) % 10 = 2 THEN 'nd' WHEN day(d) % 10 = 3 THEN 'rd' ELSE 'th' END, ', ', year(d))"""


@query(
    "daily_dates",
    f"""
SELECT o_orderkey AS uid, {TITLE_SQL} AS title, strftime(d, '%Y-%m-%d') AS from_title,
  CASE WHEN month(d) = 2 THEN strftime(d, '%Y-%m-%d') ELSE NULL END AS from_february,
  strftime(d, '%Y-%m-%d') AS from_text, NULL AS bad_day FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""",
)
def _(t):
    day = F.to_date("o_orderdate")
    rows = t.orders.select(F.col("o_orderkey").alias("uid"), m.daily_title(day).alias("title"), day.alias("d"))
    show = "yyyy-MM-dd"
    return rows.select(
        "uid",
        "title",
        F.date_format(m.daily_title_date(F.col("title")), show).alias("from_title"),
        F.date_format(m.daily_title_date(F.when(F.month("d") == 2, F.col("title")).otherwise("Later")), show).alias("from_february"),
        F.date_format(m.iso_date(F.concat(F.lit("on "), F.col("d").cast("string"), F.lit(" it"))), show).alias("from_text"),
        F.date_format(m.daily_title_date(F.concat(F.lit("February 30th, "), F.year("d").cast("string"))), show).alias("bad_day"),
    )


@query(
    "date_source",
    """
WITH c AS (SELECT c_custkey, c_name, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN DATE '2001-02-03'
   WHEN 'MACHINERY' THEN DATE '2002-03-04' END AS attr FROM customer),
 m AS (SELECT o_custkey, min(o_orderdate)::DATE AS f, max(o_orderdate)::DATE AS l FROM orders GROUP BY o_custkey)
SELECT c_custkey AS uid, strftime(attr, '%Y-%m-%d') AS by_attribute, strftime(f, '%Y-%m-%d') AS by_first, strftime(l, '%Y-%m-%d') AS by_last
FROM c LEFT JOIN m ON c_custkey = o_custkey""",
)
def _(t):
    text = F.expr(
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'Due:: [[February 3rd, 2001]]' "
        "WHEN 'MACHINERY' THEN 'met 2002-03-04' ELSE 'no day here' END"
    )
    items = t.customer.select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("title"), text.alias("text"))
    mentions = t.orders.select(F.col("o_custkey").alias("uid"), F.to_date("o_orderdate").alias("day"))
    return op.date_source(items, mentions)


@query(
    "task_meta",
    """
SELECT o_orderkey AS uid, CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'TODO' END AS state,
  CASE WHEN o_orderstatus = 'P' THEN 'Cancelled' ELSE '' END AS status,
  lower(o_orderpriority) AS priority, concat('cust ', o_custkey) AS project,
  strftime(o_orderdate, '%Y-%m-%d') AS due_day, o_orderstatus = 'F' AS done, o_orderstatus = 'P' AS cancelled,
  o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1998-01-01' AS overdue,
  o_orderdate::DATE = DATE '1998-01-01' AS due_today FROM orders""",
)
def _(t):
    tasks = t.orders.select(
        F.col("o_orderkey").alias("uid"),
        F.expr(
            "concat('{{[[', CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'TODO' END, ']]}} order', "
            "CASE WHEN o_orderstatus = 'P' THEN ' #[[task-status/Cancelled]]' ELSE '' END)"
        ).alias("text"),
    )
    kids = F.array(
        F.concat(F.lit("Due:: [["), m.daily_title(F.to_date("o_orderdate")), F.lit("]]")),
        F.expr("concat('Priority:: ', o_orderpriority)"),
        F.lit("priority:: second value loses"),
        F.expr("concat('Project:: cust ', o_custkey)"),
    )
    blocks = t.orders.select(F.col("o_orderkey").alias("owner"), F.posexplode(kids).alias("ord", "text"))
    names = {"due": "due", "priority": "priority", "project": "project"}
    rows = op.task_meta(tasks, op.extract_attributes(blocks), F.lit("1998-01-01").cast("date"), names)
    return rows.withColumn("priority", F.lower("priority")).withColumn("due_day", F.date_format("due_day", "yyyy-MM-dd")).drop("due")


def tree_levels(t):
    """region > nation > customer > order > line as (uid, parent) frames; uids carry a level letter."""
    uid = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    return [
        t.region.select(uid("r", "r_regionkey").alias("uid"), F.lit(None).cast("string").alias("parent")),
        t.nation.select(uid("n", "n_nationkey").alias("uid"), uid("r", "n_regionkey").alias("parent")),
        t.customer.select(uid("c", "c_custkey").alias("uid"), uid("n", "c_nationkey").alias("parent")),
        t.orders.select(uid("o", "o_orderkey").alias("uid"), uid("c", "o_custkey").alias("parent")),
    ]


CLOSURE_SQL = """
WITH o AS (SELECT concat('o', o_orderkey) AS d, concat('c', c_custkey) AS a1, concat('n', n_nationkey) AS a2, concat('r', n_regionkey) AS a3
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 c AS (SELECT concat('c', c_custkey) AS d, concat('n', n_nationkey) AS a1, concat('r', n_regionkey) AS a2
   FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT a1 AS anc, d AS "desc", 1 AS depth FROM o UNION ALL SELECT a2, d, 2 FROM o UNION ALL SELECT a3, d, 3 FROM o
UNION ALL SELECT a1, d, 1 FROM c UNION ALL SELECT a2, d, 2 FROM c
UNION ALL SELECT concat('r', n_regionkey), concat('n', n_nationkey), 1 FROM nation"""


@query("ancestors", CLOSURE_SQL)
def _(t):
    return op.closure_of_levels(tree_levels(t))


@query("descendants_unknown_depth", CLOSURE_SQL)
def _(t):
    region, *rest = tree_levels(t)
    edges = rest[0]
    for level in rest[1:]:
        edges = edges.unionByName(level)
    return op.closure_of_edges(edges)


PATHS = """
SELECT concat('r', r_regionkey) AS uid, 0 AS depth, lpad(r_regionkey::VARCHAR, 4, '0') AS path FROM region
UNION ALL SELECT concat('n', n_nationkey), 1, concat(lpad(n_regionkey::VARCHAR, 4, '0'), '/', lpad(n_nationkey::VARCHAR, 4, '0')) FROM nation
UNION ALL SELECT concat('c', c_custkey), 2, concat(lpad(n_regionkey::VARCHAR, 4, '0'), '/', lpad(n_nationkey::VARCHAR, 4, '0'), '/', lpad(c_custkey::VARCHAR, 12, '0'))
  FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('o', o_orderkey), 3, concat(lpad(n_regionkey::VARCHAR, 4, '0'), '/', lpad(n_nationkey::VARCHAR, 4, '0'), '/', lpad(c_custkey::VARCHAR, 12, '0'),
  '/', strftime(o_orderdate, '%Y%m%d'), lpad(o_orderkey::VARCHAR, 12, '0'))
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def tree_paths(t):
    pad = lambda col, n: F.lpad(F.col(col).cast("string"), n, "0")
    join = lambda *cols: F.concat_ws("/", *cols)
    nation = t.nation.withColumn("np", join(pad("n_regionkey", 4), pad("n_nationkey", 4)))
    customer = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn(
        "cp", join("np", pad("c_custkey", 12))
    )
    orders = t.orders.join(customer.select("c_custkey", "cp"), F.col("o_custkey") == F.col("c_custkey")).withColumn(
        "op", join("cp", F.concat(F.date_format("o_orderdate", "yyyyMMdd"), pad("o_orderkey", 12)))
    )
    node = lambda df, letter, key, depth, path: df.select(
        F.concat(F.lit(letter), F.col(key).cast("string")).alias("uid"), F.lit(depth).alias("depth"), path.alias("path")
    )
    return (
        node(t.region, "r", "r_regionkey", 0, pad("r_regionkey", 4))
        .unionByName(node(nation, "n", "n_nationkey", 1, F.col("np")))
        .unionByName(node(customer, "c", "c_custkey", 2, F.col("cp")))
        .unionByName(node(orders, "o", "o_orderkey", 3, F.col("op")))
    )


@query("outline_order", f"SELECT uid, depth, path, row_number() OVER (ORDER BY path) AS pos FROM ({PATHS})")
def _(t):
    return op.outline_order(tree_paths(t))


@query(
    "reading_order",
    """
SELECT container, uid, x, y, r AS "row", row_number() OVER (PARTITION BY container ORDER BY r, x, y, uid) AS pos FROM (
 SELECT l_orderkey AS container, concat(l_linenumber, '-', l_partkey, '-', l_suppkey) AS uid, l_quantity AS x, l_extendedprice AS y,
  floor(l_extendedprice / 200)::BIGINT AS r FROM lineitem)""",
)
def _(t):
    items = t.lineitem.select(
        F.col("l_orderkey").alias("container"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("uid"),
        F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"),
    )
    return op.reading_order(items)


@query(
    "board_contents",
    f"""
WITH s AS ({PATHS}), k AS (
 SELECT concat('r', n_regionkey) AS uid, count(*) AS members FROM nation GROUP BY ALL
 UNION ALL SELECT concat('n', c_nationkey), count(*) FROM customer GROUP BY ALL
 UNION ALL SELECT concat('c', o_custkey), count(*) FROM orders GROUP BY ALL)
SELECT s.uid, s.depth, s.path, coalesce(members, 0) AS members FROM s LEFT JOIN k USING (uid) WHERE depth < 3""",
)
def _(t):
    levels = tree_levels(t)
    members = levels[1].unionByName(levels[2]).unionByName(levels[3])
    return op.board_contents(tree_paths(t).where("depth < 3"), members)


@query(
    "board_path",
    """
SELECT concat('o', o_orderkey) AS uid, concat_ws(' > ', r_name, n_name, c_name) AS path FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def _(t):
    titles = (
        t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("anc"), F.col("r_name").alias("title"))
        .unionByName(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("anc"), F.col("n_name").alias("title")))
        .unionByName(t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("anc"), F.col("c_name").alias("title")))
    )
    closure = op.closure_of_levels(tree_levels(t)).where(F.col("desc").startswith("o"))
    return op.board_path(closure, titles)


@query(
    "trail_stops",
    """
WITH s AS (SELECT conv_id AS trail, turn AS ord, concat(conv_id, '-', turn) AS uid, lower(split_part(text, ' ', 1)) AS card,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, concat(conv_id, '-', turn)) AS pos FROM conversations)
SELECT *, min(pos) OVER (PARTITION BY trail, card) AS badge FROM s""",
)
def _(t):
    stops = t.conversations.select(
        F.col("conv_id").alias("trail"),
        F.col("turn").alias("ord"),
        F.concat_ws("-", "conv_id", "turn").alias("uid"),
        F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("card"),
    )
    return op.trail_stops(stops)
