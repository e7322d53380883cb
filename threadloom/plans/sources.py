"""Source and sink queries. Files are built from table rows in Spark, then read back by the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import cells as cell_ops
from threadloom.plans.base import query
from threadloom.sources import blocks as src
from threadloom.sources import canvas, outline


@query(
    "read_outline_json",
    """
WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i + 1] AS s FROM documents, unnest(range(len(string_split(text, chr(10))))) u(i)),
 w AS (SELECT doc_id, i, j, string_split(s, '. ')[j + 1] AS s FROM l, unnest(range(len(string_split(s, '. ')))) u(j))
SELECT doc_id, concat('d', doc_id) AS uid, lang AS string, NULL AS parent_uid, 0 AS ord, 0 AS depth FROM documents
UNION ALL SELECT doc_id, concat('d', doc_id, '-', i), s, concat('d', doc_id), i, 1 FROM l
UNION ALL SELECT doc_id, concat('d', doc_id, '-', i, '-', j), s, concat('d', doc_id, '-', i), j, 2 FROM w""",
)
def _(t):
    lines = F.split("text", "\n")
    name = lambda *parts: F.concat(F.lit("d"), F.concat_ws("-", *parts))
    tree = F.struct(
        name("doc_id").alias("uid"),
        F.col("lang").alias("string"),
        F.reverse(
            F.transform(
                lines,
                lambda s, i: F.struct(
                    name(F.col("doc_id"), i).alias("uid"),
                    s.alias("string"),
                    i.cast("long").alias("order"),
                    F.transform(
                        F.split(s, r"\. "), lambda w, j: F.struct(name(F.col("doc_id"), i, j).alias("uid"), w.alias("string"))
                    ).alias("children"),
                ),
            )
        ).alias("children"),
    )
    files = t.documents.select("doc_id", F.to_json(tree).alias("json"))
    return outline.flatten_tree(files, "json").select("doc_id", "uid", "string", "parent_uid", "ord", "depth")


@query(
    "read_outline_replies",
    """SELECT conv_id, concat(conv_id, '-', turn) AS uid, text AS string, CASE WHEN turn > 0 THEN concat(conv_id, '-', turn - 1) END AS parent_uid, 0 AS ord, turn AS depth,
 CASE WHEN role = 'user' THEN 'regions' ELSE 'nodes' END AS "table" FROM conversations""",
)
def _(t):
    """Each turn is the child of the one before, so a tree is as deep as its conversation is long."""
    turn = F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("uid"), F.col("text").alias("string"), F.struct(F.when(F.col("role") == "user", "region").otherwise("note").alias("type")).alias("props")))
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("json")))).alias("turns"))
    opened = F.array_join(F.transform("turns", lambda x: F.concat(F.substr(x["json"], F.lit(1), F.length(x["json"]) - 1), F.lit(', "children": ['))), "")
    files = turns.select("conv_id", F.concat(opened, F.repeat(F.lit("]}"), F.size("turns"))).alias("json"))
    return outline.flatten_tree(files, "json").select("conv_id", "uid", "string", "parent_uid", "ord", "depth", "table")


BLOCKS_SQL = """
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY isl) - 1 AS pos, 'para' AS type, NULL AS level,
  trim(regexp_replace(string_agg(s, ' ' ORDER BY i), '[ \\t]+', ' ', 'g')) AS text
FROM (SELECT doc, i, s, i - row_number() OVER (PARTITION BY doc ORDER BY i) AS isl0, sum(brk) OVER (PARTITION BY doc ORDER BY i) AS isl, blank
 FROM (SELECT doc, i, s, s SIMILAR TO '\\s*' OR s SIMILAR TO '\\s*(-{3,}|\\*{3,}|_{3,})\\s*' AS blank,
   CASE WHEN s SIMILAR TO '\\s*' OR s SIMILAR TO '\\s*(-{3,}|\\*{3,}|_{3,})\\s*' THEN 1 ELSE 0 END AS brk
  FROM (SELECT doc_id AS doc, i, string_split(text, chr(10))[i + 1] AS s
   FROM documents, unnest(range(len(string_split(text, chr(10))))) u(i))))
WHERE NOT blank GROUP BY doc, isl"""


@query("text_to_blocks", BLOCKS_SQL)
def _(t):
    return src.text_to_blocks(t.documents)


@query("document_to_markdown", f"SELECT doc, 0 AS part, pos, text AS line FROM ({BLOCKS_SQL})")
def _(t):
    return src.document_markdown_lines(src.text_to_blocks(t.documents))


@query(
    "extract_pipe_tables",
    """
WITH c AS (SELECT doc_id AS doc, i, string_split(replace(text, '|', '/'), chr(10))[i + 1] AS s
  FROM documents, unnest(range(len(string_split(text, chr(10))))) u(i))
SELECT doc, 0 AS table_id, 0 AS r, 0 AS c, 'Line' AS text, true AS header FROM (SELECT DISTINCT doc FROM c)
UNION ALL SELECT DISTINCT doc, 0, 0, 1, 'Text', true FROM c
UNION ALL SELECT doc, 0, i + 1, 0, concat('', i), false FROM c
UNION ALL SELECT doc, 0, i + 1, 1, trim(s), false FROM c""",
)
def _(t):
    rows = F.transform(
        F.split(F.translate("text", "|", "/"), "\n"), lambda s, i: F.concat(F.lit("| "), i.cast("string"), F.lit(" | "), s, F.lit(" |"))
    )
    text = F.concat(F.lit("| Line | Text |\n|---|:---:|\n"), F.array_join(rows, "\n"))
    return src.extract_pipe_tables(src.text_to_blocks(t.documents.select("doc_id", text.alias("text"))))


CANVAS_SQL = """
WITH l AS (SELECT doc_id, i, length(string_split(text, chr(10))[i + 1]) AS n, contains(string_split(text, chr(10))[i + 1], ',') AS comma,
   len(string_split(text, chr(10))) AS total
  FROM documents, unnest(range(len(string_split(text, chr(10))))) u(i)),
 v AS (SELECT * FROM l WHERE n > 20 AND (comma OR n > 100)),
 k AS (SELECT doc_id, n, min(i) AS i FROM v GROUP BY doc_id, n),
 e AS (SELECT a.doc_id, a.n AS f, b.n AS g FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
 g AS (SELECT e.* FROM e JOIN k x ON x.doc_id = e.doc_id AND x.n = e.f JOIN k y ON y.doc_id = e.doc_id AND y.n = e.g WHERE e.f <> e.g)
SELECT d.doc_id, NULL::VARCHAR AS error, coalesce(kn, 0) AS n_nodes, coalesce(gn, 0) AS n_edges,
  d.total + (d.total - 1) - coalesce(kn, 0) - coalesce(gn, 0) AS skipped
FROM (SELECT DISTINCT doc_id, total FROM l) d LEFT JOIN (SELECT doc_id, count(*) AS kn FROM k GROUP BY 1) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS gn FROM g GROUP BY 1) USING (doc_id)"""


@query("read_canvas", CANVAS_SQL)
def _(t):
    size = lambda s: F.length(s)
    lines = F.split("text", "\n")
    node_id = lambda s: F.concat(F.lit("n"), size(s).cast("string"))
    nodes = F.transform(
        lines,
        lambda s, i: F.struct(
            node_id(s).alias("id"),
            F.when(s.contains(","), "text").when(size(s) > 100, "group").otherwise("shape").alias("type"),
            F.lit(0.0).alias("x"),
            (i * 10.0).alias("y"),
            (size(s) - 20).cast("double").alias("width"),
            F.lit(8.0).alias("height"),
            s.alias("text"),
        ),
    )
    df = t.documents.select("doc_id", nodes.alias("nodes"))
    edges = F.transform(
        F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0))),
        lambda n, i: F.struct(F.concat(F.lit("e"), i).alias("id"), n["id"].alias("fromNode"), F.get("nodes", i + 1)["id"].alias("toNode")),
    )
    files = df.select("doc_id", F.to_json(F.struct("nodes", edges.alias("edges"))).alias("json"))
    return canvas.parse_canvas(files).select(
        "doc_id", "error", F.size("kept_nodes").alias("n_nodes"), F.size("kept_edges").alias("n_edges"), "skipped"
    )


def order_board(t):
    """Customers as boards: orders are sections, lines are cards placed by quantity and price."""
    orders = t.orders.select(
        F.col("o_custkey").alias("board"),
        F.concat(F.lit("o"), "o_orderkey").alias("uid"),
        F.lit("section").alias("type"),
        F.col("o_orderpriority").alias("title"),
        F.lit(0.0).alias("x"),
        F.col("o_totalprice").alias("y"),
        F.lit(480.0).alias("w"),
        F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(320.0).alias("h"),
        F.lit(0).alias("depth"),
        F.col("o_orderkey").alias("ord"),
    )
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("board"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("uid"),
        F.lit("card").alias("type"),
        F.col("l_returnflag").alias("title"),
        F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"),
        F.lit(280.0).alias("w"),
        F.lit(160.0).alias("h"),
        F.lit(1).alias("depth"),
        F.col("l_orderkey").alias("ord"),
    )
    edges = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("board"),
        F.concat_ws("-", F.lit("e"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("uid"),
        F.concat(F.lit("o"), "l_orderkey").alias("from_uid"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("to_uid"),
        F.col("l_linestatus").alias("label"),
    )
    return orders.unionByName(lines), edges


@query(
    "write_canvas",
    """
WITH l AS (SELECT o_custkey AS board, o_orderstatus AS st, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS uid, * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_custkey AS board, 'node' AS part, concat('0:0000:', lpad(o_orderkey::VARCHAR, 20, '0')) AS rank,
 concat('{"id":"o', o_orderkey, '","x":0,"y":', floor(o_totalprice + 0.5)::BIGINT, ',"width":480,"height":320,"type":"group","label":"', o_orderpriority, '"}') AS json
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT board, 'node', concat('1:0000:', lpad(l_orderkey::VARCHAR, 20, '0')),
 concat('{"id":"', uid, '","x":', floor(l_quantity + 0.5)::BIGINT, ',"y":', floor(l_extendedprice + 0.5)::BIGINT, ',"width":280,"height":160,"type":"text","text":"', l_returnflag, '"}') FROM l
UNION ALL SELECT board, 'edge', concat('e-', uid), concat('{"id":"e-', uid, '","fromNode":"o', l_orderkey, '","toNode":"', uid, '","label":"', l_linestatus, '"}') FROM l WHERE st <> 'P'""",
)
def _(t):
    items, edges = order_board(t)
    return canvas.write_canvas_rows(items, edges)


@query(
    "write_outline_markdown",
    """
WITH l AS (SELECT o_custkey AS board, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS uid, * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_custkey AS board, 0 AS part, concat(lpad(floor(o_totalprice * 100)::BIGINT::VARCHAR, 14, '0'), '/', o_orderkey) AS path, concat('# ', o_orderpriority) AS line FROM orders
UNION ALL SELECT board, 0, concat(lpad(floor(o_totalprice * 100)::BIGINT::VARCHAR, 14, '0'), '/', o_orderkey, '/', lpad(floor(l_extendedprice * 100)::BIGINT::VARCHAR, 14, '0'), lpad(floor(l_quantity)::BIGINT::VARCHAR, 6, '0'), uid),
  concat('  - ', l_returnflag) FROM l
UNION ALL SELECT board, 1, concat('e', uid), concat_ws(' -> ', o_orderpriority, l_linestatus, l_returnflag) FROM l""",
)
def _(t):
    number = lambda c, k, n: F.lpad(F.floor(F.col(c) * k).cast("long").cast("string"), n, "0")
    uid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    top = F.concat(number("o_totalprice", 100, 14), F.lit("/"), F.col("o_orderkey"))
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sections = t.orders.select(
        F.col("o_custkey").alias("board"), top.alias("path"), F.lit("section").alias("role"), F.lit(0).alias("depth"), F.col("o_orderpriority").alias("title")
    )
    cards = joined.select(
        F.col("o_custkey").alias("board"),
        F.concat(top, F.lit("/"), number("l_extendedprice", 100, 14), number("l_quantity", 1, 6), uid).alias("path"),
        F.lit("card").alias("role"),
        F.lit(1).alias("depth"),
        F.col("l_returnflag").alias("title"),
    )
    edges = joined.select(
        F.col("o_custkey").alias("board"),
        F.concat(F.lit("e"), uid).alias("uid"),
        F.col("o_orderpriority").alias("a"),
        F.col("l_linestatus").alias("label"),
        F.col("l_returnflag").alias("b"),
    )
    return canvas.outline_markdown_lines(sections.unionByName(cards), edges)


@query(
    "read_jsonl_ledger",
    "SELECT concat('u', user_id) AS uid, event_type AS kind, epoch_us(ts) AS at FROM events WHERE event_type NOT IN ('error', 'view')",
)
def _(t):
    row = F.to_json(
        F.struct(
            F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit("u"), "user_id")).alias("uid"),
            F.col("event_type").alias("kind"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        )
    )
    torn = F.when(F.col("event_type") == "error", F.expr("substring(j, 1, length(j) - 4)")).otherwise(F.col("j"))
    lines = t.events.select("event_type", row.alias("j")).select(torn.alias("value"))
    return canvas.parse_ledger(lines, "uid string, kind string, at bigint")


def line_cells(t):
    """Orders as tables: row = rank of the line, columns = four of its fields."""
    return cell_ops.cells_from_lines(t.lineitem)


CELLS_SQL = """
WITH f AS (SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) - 1 AS r,
  struct_pack(a := l_partkey, b := l_suppkey, q := l_quantity, p := l_extendedprice, f := l_returnflag, s := l_linestatus) AS m FROM lineitem),
cells AS (SELECT table_id, r, unnest([0, 1, 2, 3]) AS c,
  unnest([concat('part, ', m.a), CASE WHEN m.f = 'A' THEN NULL ELSE concat(m.q::BIGINT, '') END, concat('"', m.f, '"'), m.s]) AS text,
  unnest([1, CASE WHEN m.f = 'A' THEN 2 ELSE 1 END, 1, 1]) AS span_hint FROM f)"""


@query(
    "write_table_csv",
    CELLS_SQL
    + """, g AS (SELECT table_id, r, c, coalesce(text, '') AS text FROM cells)
SELECT t.table_id, i AS r, CASE WHEN x.line IS NULL THEN ',,,' ELSE x.line END AS line
FROM (SELECT table_id, max(r) AS mr FROM g GROUP BY 1) t, unnest(range(t.mr + 1)) u(i)
LEFT JOIN (SELECT table_id, r, string_agg(CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN concat('"', replace(text, '"', '""'), '"') ELSE text END, ',' ORDER BY c) AS line FROM g GROUP BY 1, 2) x
ON x.table_id = t.table_id AND x.r = i""",
)
def _(t):
    return cell_ops.csv_lines(line_cells(t))


@query(
    "write_table_markdown",
    CELLS_SQL
    + """, s AS (SELECT table_id, bool_or(span_hint > 1) AS spanned, max(r) AS mr FROM cells GROUP BY 1),
 g AS (SELECT s.table_id, spanned, i AS r, v.c AS c, x.text AS text, x.table_id IS NULL AS hole
   FROM s, unnest(range(s.mr + 1)) u(i), unnest([0, 1, 2, 3]) v(c) LEFT JOIN cells x ON x.table_id = s.table_id AND x.r = i AND x.c = v.c)
SELECT table_id, r, CASE WHEN NOT spanned THEN concat('| ', string_agg(coalesce(text, ''), ' | ' ORDER BY c), ' |')
 ELSE concat('<tr>', string_agg(CASE WHEN c = 1 AND text IS NULL AND NOT hole THEN '' ELSE
   concat(CASE WHEN r = 0 AND NOT hole THEN '<th' ELSE '<td' END, CASE WHEN c = 0 AND text IS NOT NULL AND EXISTS (SELECT 1 FROM cells y WHERE y.table_id = g.table_id AND y.r = g.r AND y.span_hint > 1) THEN ' colspan="2"' ELSE '' END, '>',
   replace(coalesce(text, ''), '"', '&quot;'), CASE WHEN r = 0 AND NOT hole THEN '</th>' ELSE '</td>' END) END, '' ORDER BY c), '</tr>') END AS line
FROM g GROUP BY table_id, r, spanned""",
)
def _(t):
    return cell_ops.markdown_lines(line_cells(t))


@query(
    "flat_rows",
    CELLS_SQL
    + """, s AS (SELECT table_id, max(r) AS mr FROM cells GROUP BY 1)
SELECT s.table_id, i AS r, v.c, CASE WHEN v.c = 1 AND x.table_id IS NOT NULL AND x.text IS NULL THEN z.text ELSE coalesce(x.text, '') END AS text
FROM s, unnest(range(s.mr + 1)) u(i), unnest([0, 1, 2, 3]) v(c)
LEFT JOIN cells x ON x.table_id = s.table_id AND x.r = i AND x.c = v.c LEFT JOIN cells z ON z.table_id = s.table_id AND z.r = i AND z.c = 0""",
)
def _(t):
    return cell_ops.flat_rows(line_cells(t))


@query(
    "grid_spec",
    CELLS_SQL
    + """ SELECT table_id, c, count(*) AS filled, coalesce(avg(CASE WHEN regexp_matches(replace(text, ',', ''), '^[-+]?[0-9]+$') THEN 1.0 ELSE 0.0 END) >= 0.8, false) AS align_right
FROM cells WHERE r > 0 AND text IS NOT NULL AND trim(text) <> '' GROUP BY 1, 2""",
)
def _(t):
    return cell_ops.column_alignment(line_cells(t), header_rows=1)
