"""Document-structure queries: document lines are laid on pages of twenty; order lines are boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import documents as op
from threadloom.plans.base import query
from threadloom.plans.pairing import boxes_matched_sql, boxes_sql, match_sql, overlap_sql
from threadloom.plans.relations import UID
from threadloom.session import written

ROWS = 20


def lines(t, docs=None, carry=()):
    """Twenty lines a page, 36 points apart; size, weight and left edge follow the text. ``docs`` stands in for the documents, ``carry`` names columns of it to keep."""
    rows = (t.documents if docs is None else docs).select(F.col("doc_id").alias("doc"), *carry, F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    n = F.length("text")
    y = (F.col("pos") % ROWS * 36).cast("double")
    return rows.select(
        "doc", F.floor(F.col("pos") / ROWS).alias("page"), F.lit(720.0).alias("page_h"), "pos", "text",
        F.when(F.col("text").contains(","), 72.0).otherwise(90.0).alias("x0"), y.alias("y0"), (F.lit(90.0) + n * 2.0).alias("x1"), (y + 10).alias("y1"),
        (y + 10).alias("base"), F.when(n < 30, 14.0).when(n < 60, 12.0).otherwise(10.0).alias("size"),
        (~F.col("text").rlike(r"[.?!,;]$")).alias("bold"), F.lit(False).alias("italic"), n.alias("chars"), *carry,
    )


LINES_SQL = """SELECT doc_id AS doc, i // 20 AS page, 720.0::DOUBLE AS page_h, i AS pos, s AS text, CASE WHEN contains(s, ',') THEN 72.0::DOUBLE ELSE 90.0::DOUBLE END AS x0, (i % 20 * 36)::DOUBLE AS y0,
 90.0 + length(s) * 2.0 AS x1, (i % 20 * 36 + 10)::DOUBLE AS y1, (i % 20 * 36 + 10)::DOUBLE AS base,
 CASE WHEN length(s) < 30 THEN 14.0 WHEN length(s) < 60 THEN 12.0 ELSE 10.0 END::DOUBLE AS size, NOT regexp_matches(s, '[.?!,;]$') AS bold, length(s) AS chars
 FROM (SELECT doc_id, i, string_split(text, chr(10))[i + 1] AS s FROM documents, unnest(range(len(string_split(text, chr(10))))) u(i))"""

FURNITURE_SQL = f"""
WITH l AS MATERIALIZED (SELECT *, lower(trim(regexp_replace(regexp_replace(text, '\\d+', '#', 'g'), '\\s+', ' ', 'g'))) AS norm,
   CASE WHEN (y0 + y1) / 2 <= 57.6 THEN 'top' WHEN (y0 + y1) / 2 >= 662.4 THEN 'bottom' END AS band FROM ({LINES_SQL})),
 p AS (SELECT doc, count(DISTINCT page) AS n FROM l GROUP BY 1),
 k AS (SELECT doc, band, norm, count(DISTINCT page) AS seen FROM l WHERE band IS NOT NULL GROUP BY 1, 2, 3),
 f AS (SELECT l.doc, l.page, l.pos, CASE
   WHEN regexp_matches(trim(l.text), '(?i)^(\\d+|page\\s+\\d+(\\s+of\\s+\\d+)?|[-–]\\s*\\d+\\s*[-–]|\\d+\\s*/\\s*\\d+)$') THEN 'page-number'
   WHEN seen >= greatest(2, least(3, n), ceil(n / 2.0)) AND n >= 2 AND EXISTS (SELECT 1 FROM l o WHERE o.doc = l.doc AND o.band = l.band AND o.norm = l.norm AND o.page <> l.page AND abs(o.base - l.base) <= 3) THEN 'repeated'
   WHEN length(trim(l.text)) <= 120 AND regexp_matches(trim(l.text), '(?i)hdl\\.handle\\.net|hathitrust\\.org|books\\.google\\.|^original\\s+from$|^digitized\\s+(?:by\\s+)?google\\b') THEN 'stamp' END AS reason
  FROM l JOIN p USING (doc) JOIN k ON k.doc = l.doc AND k.band = l.band AND k.norm = l.norm)"""


def footed(t):
    """The lines with a running footer under every page: document source and page number."""
    rows = lines(t)
    foot = rows.groupBy("doc", "page").agg(F.max("pos").alias("p")).join(t.documents.select(F.col("doc_id").alias("doc"), "source"), "doc")
    foot = foot.select(
        "doc", "page", F.lit(720.0).alias("page_h"), (F.col("p") + 1_000_000).alias("pos"), F.concat("source", F.lit(" page "), "page").alias("text"),
        F.lit(72.0).alias("x0"), F.lit(700.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(710.0).alias("y1"), F.lit(710.0).alias("base"),
        F.lit(8.0).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(10).alias("chars"),
    )
    return rows.unionByName(foot)


FOOTED_SQL = FURNITURE_SQL.replace(
    f"FROM ({LINES_SQL})",
    f"""FROM (SELECT doc, page, pos, text, y0, y1, base FROM ({LINES_SQL}) UNION ALL
 SELECT doc, page, max(pos) + 1000000, concat(any_value(source), ' page ', page), 700.0, 710.0, 710.0 FROM ({LINES_SQL}) x JOIN documents ON doc_id = doc GROUP BY doc, page)""",
)


@query("repeated_furniture", FOOTED_SQL + " SELECT * FROM f WHERE reason IS NOT NULL")
def _(t):
    return op.repeated_furniture(footed(t))


BODY_SQL = f"""SELECT doc, arg_min(k, (-n, f)) AS body_size, max(n) AS chars FROM (
 SELECT doc, floor(size * 2 + 0.5) / 2 AS k, sum(chars)::BIGINT AS n, min(pos) AS f FROM ({LINES_SQL}) GROUP BY 1, 2) GROUP BY doc"""


@query("body_size", BODY_SQL)
def _(t):
    return op.body_size(lines(t))


@query(
    "heading_levels",
    f"""
WITH b AS ({BODY_SQL}), l AS (SELECT x.*, body_size FROM ({LINES_SQL}) x JOIN b USING (doc)),
 c AS (SELECT * FROM (SELECT doc, size, row_number() OVER (PARTITION BY doc ORDER BY size DESC) AS cls FROM (SELECT DISTINCT doc, size FROM l WHERE size >= body_size * 1.15)) WHERE cls <= 3),
 m AS (SELECT doc, max(cls) AS n_cls FROM c GROUP BY 1),
 r AS (SELECT l.*, c.cls, coalesce(n_cls, 0) AS n_cls, len(string_split_regex(trim(text), '\\s+')) AS words,
   l.size >= body_size - 0.5 AND l.size < body_size * 1.15 AS sized FROM l LEFT JOIN c ON c.doc = l.doc AND c.size = l.size LEFT JOIN m ON m.doc = l.doc),
 n AS (SELECT *, coalesce(lead(sized AND NOT bold) OVER (PARTITION BY doc ORDER BY page, pos), true) AS nb,
   regexp_extract(trim(text), '^((\\d+)(\\.\\d+)*)\\.?\\s+\\S', 1) AS num FROM r),
 h AS (SELECT *, CASE WHEN trim(text) = '' OR NOT regexp_matches(trim(text), '[\\p{{L}}\\p{{N}}]') OR regexp_matches(trim(text), '(?i)^(?:table|tab\\.?|fig(?:ure)?s?\\.?|plates?)\\s*\\d+[A-Za-z]?[.:]?(\\s|$)') THEN 0
   WHEN cls IS NOT NULL AND words <= 24 THEN cls WHEN cls IS NOT NULL THEN 0
   WHEN bold AND sized AND regexp_matches(text, '[A-Za-z]{{3}}') AND words <= 14 AND NOT regexp_matches(trim(text), '[.?!,;]$') AND nb THEN least(4, n_cls + 1) ELSE 0 END AS lv,
   CASE WHEN num = '' THEN 0 ELSE len(string_split(num, '.')) END AS dep FROM n),
 g AS (SELECT *, max(CASE WHEN lv = 1 AND dep = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc) AS off FROM h),
 a AS (SELECT *, count(*) FILTER (lv > 0 AND dep > 0) OVER (PARTITION BY doc) AS cnt, count(*) FILTER (lv > 0 AND dep > 0 AND dep + off = lv) OVER (PARTITION BY doc) AS agree FROM g)
SELECT doc, page, pos, (CASE WHEN lv > 0 AND dep > 0 AND cnt >= 3 AND agree >= ceil(cnt * 0.5) THEN least(6, dep + off) ELSE lv END)::INTEGER AS level FROM a""",
)
def _(t):
    rows = lines(t)
    return op.heading_levels(rows, op.body_size(rows))


EDGED_SQL = f"""SELECT * REPLACE (72.0 + length(text) % 4 * 14.0 AS x0), 72.0 + length(text) % 4 * 14.0 + CASE WHEN length(text) % 5 = 0 THEN 14.0 ELSE 0.0 END AS text_x0 FROM ({LINES_SQL})""".replace("(i % 20 * 36", "(i % 20 * 14")


@query(
    "paragraphs",
    f"""
WITH RECURSIVE b AS ({BODY_SQL}), l AS MATERIALIZED (SELECT x.*, body_size, row_number() OVER (PARTITION BY x.doc, page ORDER BY pos) AS k FROM ({EDGED_SQL}) x JOIN b ON b.doc = x.doc),
 g AS (SELECT *, base - lag(base) OVER w AS gap, greatest(size, lag(size) OVER w) AS big, lag(size) OVER w AS ps, lag(bold) OVER w AS pb, lag(chars) OVER w AS pc, lag(text) OVER w AS pt, lag(x0) OVER w AS px FROM l WINDOW w AS (PARTITION BY doc, page ORDER BY pos)),
 u AS (SELECT doc, page, median(gap) AS usual FROM g WHERE gap > 0 AND gap < 3 * body_size GROUP BY 1, 2),
 n AS MATERIALIZED (SELECT g.doc, g.page, k, pos, text, x0, text_x0, px, big, gap > 1.7 * big OR abs(ps - size) > 0.6 OR (pb <> bold AND (pc > 20 OR chars > 20))
   OR (regexp_matches(pt, '[.?!:]$') AND regexp_matches(text, '^[A-Z("“]') AND gap > 1.25 * coalesce(usual, body_size * 1.3)) AS apart, regexp_matches(pt, '[.?!]$') AS ended FROM g LEFT JOIN u ON u.doc = g.doc AND u.page = g.page),
 f(doc, page, k, para, m, edge, tedge) AS (SELECT doc, page, k, 1::BIGINT, 1, x0, text_x0 FROM n WHERE k = 1
  UNION ALL SELECT doc, page, k, para + brk, CASE WHEN brk = 1 THEN 1 ELSE m + 1 END, CASE WHEN brk = 1 THEN x0 ELSE edge END, CASE WHEN brk = 1 THEN text_x0 ELSE tedge END
  FROM (SELECT n.*, para, m, edge, tedge, CASE WHEN apart
     OR NOT (abs(x0 - edge) <= 1.5 * big OR abs(x0 - tedge) <= 1.5 * big OR abs(x0 - px) <= 1.5 * big OR (m = 1 AND px - x0 > 0.8 * big AND px - x0 < 4 * big))
     OR (ended AND x0 - CASE WHEN m = 1 THEN tedge ELSE px END > 0.8 * big AND x0 - CASE WHEN m = 1 THEN tedge ELSE px END < 4 * big) THEN 1 ELSE 0 END AS brk
    FROM f JOIN n ON n.doc = f.doc AND n.page = f.page AND n.k = f.k + 1))
SELECT f.doc, f.page, para, min(pos) AS first_pos, count(*) AS lines, string_agg(text, ' ' ORDER BY pos) AS text FROM f JOIN n ON n.doc = f.doc AND n.page = f.page AND n.k = f.k GROUP BY 1, 2, 3""",
)
def _(t):
    tight = lines(t).withColumn("base", (F.col("pos") % ROWS * 14 + 10).cast("double")).withColumn("x0", 72 + F.length("text") % 4 * 14.0)
    edged = tight.withColumn("text_x0", F.col("x0") + F.when(F.length("text") % 5 == 0, 14.0).otherwise(0.0))
    return op.paragraphs(edged, op.body_size(edged))


@query("detect_lists")
def _(t):
    marked = lines(t).withColumn("base", (F.col("pos") % ROWS * 14).cast("double"))
    mark = F.when(F.col("text").contains(","), F.concat(F.lit("- "), "text")).when(F.length("text") < 60, F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), "text")).otherwise(F.col("text"))
    return op.detect_lists(marked.withColumn("text", mark))


@query(
    "words_to_lines",
    f"""SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY pos) AS line, len(string_split(text, ' ')) AS words, text FROM ({LINES_SQL})""",
)
def _(t):
    rows = lines(t).select("doc", "page", "base", "size", F.posexplode(F.split("text", " ")).alias("i", "text"))
    jitter = F.col("base") + (F.length("text") % 3) * 0.5
    return op.words_to_lines(rows.select("doc", "page", "text", (F.col("i") * 10.0).alias("x0"), jitter.alias("base"), F.lit(10.0).alias("size")))


@query(
    "columns_and_reading_order",
    f"""
WITH l AS (SELECT doc, page, pos, text, CASE WHEN length(text) > 400 THEN 60.0 WHEN pos % 20 < 10 THEN 72.0 ELSE 330.0 END AS x0, (pos % 10 * 36)::DOUBLE AS y0, chars FROM ({LINES_SQL})),
 x AS (SELECT *, CASE WHEN length(text) > 400 THEN 560.0 ELSE x0 + 220 END AS x1 FROM l),
 e AS (SELECT doc, page, x0, row_number() OVER (PARTITION BY doc, page ORDER BY x0) AS k FROM (SELECT doc, page, x0 FROM x WHERE chars >= 8 GROUP BY 1, 2, 3 HAVING count(*) >= 4)),
 gu AS (SELECT b.doc, b.page, b.x0 AS g FROM e a JOIN e b ON a.doc = b.doc AND a.page = b.page AND b.k = a.k + 1 AND b.x0 - a.x0 >= 122.4),
 w AS (SELECT x.*, g, coalesce(x0 < g - 10 AND x1 > g + 1, false) AS wide FROM x LEFT JOIN gu ON gu.doc = x.doc AND gu.page = x.page),
 s AS (SELECT *, sum(wide::INT) OVER (PARTITION BY doc, page ORDER BY y0, x0, pos)::BIGINT * 2 - wide::INT AS slice, CASE WHEN wide OR g IS NULL OR (x0 + x1) / 2 < g THEN 0 ELSE 1 END AS col FROM w)
SELECT doc, page, pos, slice, col, row_number() OVER (PARTITION BY doc, page ORDER BY slice, col, y0, x0, pos) AS reading_pos FROM s""",
)
def _(t):
    wide = F.col("chars") > 400
    rows = lines(t).withColumn("x0", F.when(wide, 60.0).when(F.col("pos") % 20 < 10, 72.0).otherwise(330.0))
    rows = rows.withColumn("x1", F.when(wide, 560.0).otherwise(F.col("x0") + 220)).withColumn("y0", (F.col("pos") % 10 * 36).cast("double"))
    return op.columns_and_reading_order(rows, 612.0)


def boxes(t, cond="true", dx="0", text="l_returnflag", rows=None):
    """Order lines as word boxes: page = order, x from quantity, y from price. ``rows`` stands in for the order lines."""
    return (t.lineitem if rows is None else rows).where(cond).select(
        F.col("l_orderkey").alias("page"), F.expr(UID).alias("uid"), F.expr(text).alias("text"), F.expr("CASE WHEN l_returnflag = 'R' THEN 0.4D ELSE 0.9D END").alias("conf"),
        F.expr(f"l_quantity * 10 + {dx}").alias("x0"), F.expr("l_extendedprice / 100").alias("y0"),
        F.expr(f"l_quantity * 10 + {dx} + 60").alias("x1"), F.expr("l_extendedprice / 100 + 40").alias("y1"),
    )


@query(
    "caption_links",
    f"""
WITH RECURSIVE ba AS MATERIALIZED ({boxes_sql("l_linestatus = 'O'")}), bb AS MATERIALIZED ({boxes_sql("l_linestatus = 'F'")}),
 g AS (SELECT p.page, p.uid AS a, q.uid AS b, p.text = 'A' AS tab, greatest(0.0::DOUBLE, q.y0 - p.y1, p.y0 - q.y1) AS yg, greatest(0.0::DOUBLE, q.x0 - p.x1, p.x0 - q.x1) AS xg FROM ba p JOIN bb q ON p.page = q.page AND (p.text = 'A') = (q.text = 'A')),
 near AS MATERIALIZED (SELECT page, a, b, -(yg + 0.25::DOUBLE * xg) AS near FROM g WHERE yg <= CASE WHEN tab THEN 30 ELSE 36 END AND xg <= 36),
 {match_sql('near', 'near')}
SELECT page, a AS caption, b AS target, -near AS gap FROM matched JOIN near USING (page, a, b)""",
)
def _(t):
    kind = F.when(F.col("text") == "A", "table").otherwise("figure")
    caps = boxes(t, "l_linestatus = 'O'").withColumn("kind", kind)
    return op.caption_links(caps, boxes(t, "l_linestatus = 'F'").withColumn("kind", kind))


@query(
    "contents_rows",
    """
WITH c AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS r, max(CASE WHEN l_returnflag = 'R' THEN 'l2' WHEN l_quantity < 12 THEN 'none' ELSE concat(l_quantity::INT, ' ..') END) AS text FROM lineitem GROUP BY 1, 2),
 s AS (SELECT table_id FROM c GROUP BY 1 HAVING max(r) >= 1)
SELECT table_id, count(*) AS filled, count(*) FILTER (text <> 'none') AS pages, count(*) FILTER (text <> 'none') >= greatest(1, 0.5 * count(*)) AS contents FROM c JOIN s USING (table_id) GROUP BY 1""",
)
def _(t):
    text = F.expr("CASE WHEN l_returnflag = 'R' THEN 'l2' WHEN l_quantity < 12 THEN 'none' ELSE concat(cast(l_quantity AS int), ' ..') END")
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("r")).agg(F.max(text).alias("text"))
    return op.contents_rows(rows.withColumn("c", F.explode(F.array(F.lit(1), F.lit(0)))))


@query(
    "page_title",
    FOOTED_SQL
    + f""", b0 AS (SELECT x.* FROM ({LINES_SQL}) x WHERE page < 2 AND (doc, page, pos) NOT IN (SELECT (doc, page, pos) FROM f WHERE reason IS NOT NULL)
   UNION ALL BY NAME SELECT doc, page, 720.0::DOUBLE AS page_h, max(pos) + 1000000 AS pos, concat(any_value(source), ' page ', page) AS text, 72.0 AS x0, 700.0 AS y0, 200.0 AS x1, 710.0 AS y1, 710.0 AS base, 8.0 AS size, false AS bold, 10 AS chars FROM ({LINES_SQL}) z JOIN documents ON doc_id = doc WHERE page < 2 GROUP BY doc, page
   HAVING (doc, page, max(pos) + 1000000) NOT IN (SELECT (doc, page, pos) FROM f WHERE reason IS NOT NULL)),
 b1 AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS tx FROM b0),
 b2 AS (SELECT * FROM b1 WHERE tx <> '' AND NOT (len(regexp_extract_all(tx, '\\d')) >= 6 AND len(regexp_extract_all(tx, '\\d')) > 2 * len(regexp_extract_all(tx, '\\p{{L}}')))),
 b3 AS (SELECT *, base - lag(base) OVER w AS step, lag(size) OVER w AS s0, lag(bold) OVER w AS w0, lag(x0) OVER w AS l0, lag(x1) OVER w AS r0 FROM b2 WINDOW w AS (PARTITION BY doc, page ORDER BY base, x0)),
 b4 AS (SELECT *, sum(CASE WHEN (abs(s0 - size) <= 0.5 OR (size BETWEEN 0.8::DOUBLE * s0 AND s0 AND step <= 0.95::DOUBLE * s0)) AND step <= 2.2::DOUBLE * size AND step > 0.5::DOUBLE * size AND x0 < r0 AND x1 > l0 AND w0 = bold THEN 0 ELSE 1 END)
   OVER (PARTITION BY doc, page ORDER BY base, x0) AS stack FROM b3),
 b5 AS (SELECT *, (row_number() OVER (PARTITION BY doc, page, stack ORDER BY base, x0) - 1) // 6 AS piece FROM b4),
 b6 AS (SELECT doc, page, stack, piece, arg_min(size, (base, x0)) AS size, arg_min(bold, (base, x0)) AS bold, min(base) AS base, trim(regexp_replace(string_agg(tx, ' ' ORDER BY base, x0), '^\\(\\s*\\d+\\s*\\)\\s*', '')) AS title FROM b5 GROUP BY 1, 2, 3, 4),
 b7 AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, size DESC, bold DESC, base, stack, piece) AS best FROM b6
  WHERE len(string_split_regex(trim(title), '\\s+')) BETWEEN 3 AND 45 AND (size > 1.1::DOUBLE * 9 OR (bold AND size >= 8.7)))
SELECT doc, page, title FROM b7 WHERE best = 1""",
)
def _(t):
    rows = footed(t)
    return op.page_title(rows, op.repeated_furniture(rows), body_size=9.0)


WORD_SQL = f"""SELECT doc, page, pos, w AS text, CASE quality WHEN 1 THEN 0.9 WHEN 0 THEN CASE WHEN length(w) > 6 THEN 0.3 ELSE 0.7 END ELSE 0.6 END::DOUBLE AS conf
 FROM (SELECT doc, page, pos, unnest(string_split(text, ' ')) AS w FROM ({LINES_SQL})) LEFT JOIN labels ON doc_id = doc"""
CORE_SQL = "lower(regexp_replace(regexp_replace(text, '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', ''))"


def trimmed(text, blanks):
    """The text without what is neither letter nor digit at either end of a word; ``blanks`` are the characters between words."""
    mark = rf"[^\p{{L}}\p{{N}}{blanks}]"
    return F.regexp_replace(text, rf"(?={mark})(?:{mark}+(?![^{blanks}])|(?<![^{blanks}]){mark}+)", "")


def doc_words(t):
    """Words of lines; a document meets its label before it is cut, and a line is trimmed as a whole."""
    marked = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    pairs = F.arrays_zip(F.split("text", " ").alias("text"), F.split(trimmed(F.col("text"), " "), " ").alias("core"))
    rows = lines(t, marked, ["quality"]).select("doc", "page", "pos", "quality", F.inline(pairs).alias("text", "core"))
    conf = F.expr("CASE quality WHEN 1 THEN 0.9D WHEN 0 THEN CASE WHEN length(text) > 6 THEN 0.3D ELSE 0.7D END ELSE 0.6D END")
    return rows.withColumn("conf", conf).drop("quality")


def lexicon(t, least_docs: int = 8):
    """Words of at least so many documents; a document's words are counted once in its row, so only counts are shuffled behind the texts."""
    whole = t.documents.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    cut = F.array_distinct(F.split(F.lower(trimmed(F.col("text"), r" \n")), r"[ \n]"))
    return whole.select(F.explode(cut).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("word")


LEX_SQL = f"SELECT word FROM (SELECT doc, {CORE_SQL} AS word FROM ({WORD_SQL})) WHERE word <> '' GROUP BY 1 HAVING count(DISTINCT doc) >= 8"


@query(
    "ocr_page_quality",
    f"""
WITH w AS MATERIALIZED (SELECT *, {CORE_SQL} AS core FROM ({WORD_SQL})), x AS MATERIALIZED ({LEX_SQL}),
 g AS (SELECT doc, page, count(conf) AS n, count(*) FILTER (conf < 0.5) AS low, avg(conf) AS mc, count(*) FILTER (length(core) >= 4) AS cores, count(*) FILTER (length(core) >= 4 AND core IN (SELECT word FROM x)) AS known FROM w GROUP BY 1, 2)
SELECT doc, page, n, low, round(mc, 6) AS mean_conf, cores, known, coalesce((n >= 12 AND low / n >= 0.15) OR (n < 12 AND mc < 0.8) OR (cores >= 10 AND known / cores < 0.5 AND mc < 0.98) OR (cores >= 20 AND low / n >= 0.04 AND known / cores < 0.12), false) AS weak FROM g""",
)
def _(t):
    return op.ocr_page_quality(doc_words(t), lexicon(t))


@query("ocr_vote")
def _(t):
    names = t.part.select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))
    used = "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_returnflag l_linestatus name".split()
    named = written(t.lineitem.join(names, F.col("l_partkey") == F.col("p_partkey")).select(*used))
    first = boxes(t, text="CASE WHEN l_returnflag = 'R' THEN concat(substring(name, 1, 1), 'q', substring(name, 3)) ELSE name END", rows=named)
    second = boxes(t, "l_linestatus = 'O' OR l_returnflag = 'R'", dx="l_discount * 100", text="name", rows=named)
    lex = names.select(F.lower("name").alias("word"))
    return op.ocr_vote(first, second, lex, 60.0, 40.0)


@query(
    "page_skew",
    """
WITH r AS (SELECT l_suppkey AS page, l_orderkey AS "row", regr_slope(l_extendedprice / 1000, l_quantity * 10) AS s, count(*) AS n, max(l_quantity * 10) - min(l_quantity * 10) AS span FROM (SELECT l_orderkey % 1 + o_custkey AS l_suppkey, l_orderkey, l_extendedprice, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1, 2),
 v AS (SELECT *, round(degrees(atan(s)), 6) AS a FROM r WHERE n >= 3 AND span >= 150 AND s IS NOT NULL),
 c AS (SELECT *, sum(span) OVER (PARTITION BY page ORDER BY a, "row") AS acc, sum(span) OVER (PARTITION BY page) AS total, count(*) OVER (PARTITION BY page) AS rs FROM v)
SELECT page, min(a) AS skew, max(rs) AS rows FROM c WHERE rs >= 3 AND acc >= total / 2 GROUP BY 1""".replace("l_orderkey % 1 + o_custkey", "o_custkey"),
)
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return op.page_skew(rows.select(F.col("o_custkey").alias("page"), F.col("l_orderkey").alias("row"), (F.col("l_quantity") * 10).alias("x"), (F.col("l_extendedprice") / 1000).alias("y")))


@query(
    "numeric_grid_pages",
    """
WITH w AS (SELECT o_custkey AS page, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS uid, l_discount * 1000 AS x, l_extendedprice / 100 AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 s AS (SELECT *, CASE WHEN x - lag(x) OVER o <= 8 THEN 0 ELSE 1 END AS st FROM w WINDOW o AS (PARTITION BY page ORDER BY x, y, uid)),
 c AS (SELECT *, sum(st) OVER (PARTITION BY page ORDER BY x, y, uid) AS col FROM s),
 g AS (SELECT page, col, min(y) AS t, max(y) AS b FROM c GROUP BY 1, 2 HAVING count(DISTINCT y) >= 4)
SELECT page, count(*) AS columns FROM g GROUP BY 1 HAVING count(*) >= 2 AND max(t) < min(b)""",
)
def _(t):
    words = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("page"), F.expr(UID).alias("uid"), F.col("l_quantity").cast("string").alias("text"), (F.col("l_discount") * 1000).alias("x"), (F.col("l_extendedprice") / 100).alias("y")
    )
    return op.numeric_grid_pages(words)


@query(
    "doubtful_lines",
    f"""
WITH w AS MATERIALIZED (SELECT *, regexp_replace(regexp_replace(text, '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}]+$', '') AS core FROM ({WORD_SQL})), x AS MATERIALIZED ({LEX_SQL}),
 g AS (SELECT doc, page, pos AS line, count(*) FILTER (conf < 0.5) AS unsure, count(*) FILTER (regexp_matches(core, '\\p{{Ll}}\\p{{Lu}}|\\p{{L}}\\d+\\p{{L}}')) AS odd,
  count(*) FILTER (length(core) >= 4 AND lower(core) NOT IN (SELECT word FROM x) AND regexp_matches(core, '^\\p{{Ll}}+$')) AS unknown, count(*) AS words FROM w GROUP BY 1, 2, 3)
SELECT * FROM g WHERE (unsure > 0 OR odd > 0 OR unknown > 0) AND (doc, line) NOT IN (SELECT (doc, pos) FROM ({LINES_SQL}) WHERE contains(text, '%'))""",
)
def _(t):
    tables = lines(t).where(F.col("text").contains("%")).select("doc", "page", F.col("pos").alias("line"))
    return op.doubtful_lines(doc_words(t).withColumnRenamed("pos", "line"), lexicon(t), tables)


@query(
    "spelling_consensus",
    f"""
WITH w AS (SELECT lang AS page, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents), c AS MATERIALIZED (SELECT page, word, count(*) AS n FROM w WHERE length(word) >= 4 GROUP BY 1, 2),
 x AS MATERIALIZED ({LEX_SQL.replace('>= 8', '>= 60')}),
 d AS MATERIALIZED (SELECT page, word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS form FROM c, unnest(range(1, length(word) + 1)) u(i)),
 e AS (SELECT a.page, a.word, a.n, b.word AS better, b.n AS better_n FROM d a JOIN d b ON a.page = b.page AND a.i = b.i AND a.form = b.form AND a.word <> b.word
  UNION SELECT a.page, a.word, a.n, b.word, b.n FROM d a JOIN c b ON a.page = b.page AND b.word = a.form
  UNION SELECT a.page, a.word, a.n, b.word, b.n FROM c a JOIN d b ON a.page = b.page AND b.form = a.word),
 p AS (SELECT *, better IN (SELECT word FROM x) AS known FROM e WHERE word <> better || 's' AND word NOT IN (SELECT word FROM x)),
 o AS (SELECT * FROM p WHERE (known AND better_n >= 2 AND better_n >= 2 * n) OR (NOT known AND better_n >= 3 AND better_n >= 3 * n))
SELECT page, word, n, arg_min(better, (-better_n, NOT known, better)) AS better, arg_min(better_n, (-better_n, NOT known, better)) AS better_n FROM o GROUP BY 1, 2, 3""",
)
def _(t):
    words = t.documents.select(F.col("lang").alias("page"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    return op.spelling_consensus(words, lexicon(t, 60))


@query(
    "merge_engine_tables",
    boxes_matched_sql(boxes_sql(), boxes_sql("l_linestatus = 'O'", "l_discount * 100"), 0.5)
    + " SELECT matched.page, a AS fresh, b AS layer, CASE WHEN 0.7 > conf + 0.02 THEN 'layer' ELSE 'fresh' END AS chose FROM matched JOIN ba ON ba.page = matched.page AND ba.uid = a",
)
def _(t):
    stats = lambda df, share: df.withColumn("share", share).withColumn("total", F.lit(10)).withColumn("rows", F.lit(4)).withColumn("cols", F.lit(3))
    return op.merge_engine_tables(stats(boxes(t), F.col("conf")), stats(boxes(t, "l_linestatus = 'O'", dx="l_discount * 100"), F.lit(0.7)), 60.0, 40.0)


@query(
    "merge_scoped",
    """
WITH b AS (SELECT l_orderkey AS page, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS uid, l_linenumber::BIGINT AS pos, l_quantity * 10 AS x0, l_quantity * 10 + 60 AS x1, l_extendedprice / 100 AS y0, l_extendedprice / 100 + 40 AS y1, l_returnflag AS f FROM lineitem),
 g AS (SELECT DISTINCT b.page, b.uid, b.pos FROM b JOIN b r ON b.page = r.page AND r.f = 'R' AND least(b.x1, r.x1 + 5) > greatest(b.x0, r.x0 + 5) AND least(b.y1, r.y1) > greatest(b.y0, r.y0)),
 a AS (SELECT page, min(pos) AS m FROM g GROUP BY 1)
SELECT page, uid, pos AS "key", 0 AS sub, 'base' AS origin FROM b WHERE (page, uid) NOT IN (SELECT (page, uid) FROM g)
UNION ALL SELECT b.page, concat('s', uid), coalesce(m, 1000000000), pos::INT, 'scoped' FROM b LEFT JOIN a ON a.page = b.page WHERE f = 'R'""",
)
def _(t):
    numbered = lambda df: df.withColumn("pos", F.split_part("uid", F.lit("-"), F.lit(2)).cast("long"))
    scoped = numbered(boxes(t, "l_returnflag = 'R'")).withColumn("uid", F.concat(F.lit("s"), "uid"))
    return op.merge_scoped(numbered(boxes(t)), scoped, boxes(t, "l_returnflag = 'R'", dx="5"), 60.0, 40.0)


@query(
    "merge_figures",
    boxes_matched_sql(boxes_sql("l_linestatus = 'O'"), boxes_sql("l_returnflag <> 'N'", "l_discount * 200"), 0.3)
    + """, c AS (SELECT page, uid, CASE WHEN text = 'R' THEN 'Figure 1. Seen' ELSE 'seen' END AS cap, CASE WHEN text = 'R' THEN 2 ELSE 0 END AS s FROM ba),
 l AS (SELECT page, uid, CASE WHEN text = 'A' THEN 'Fig. 2 text.' ELSE '' END AS cap, CASE WHEN text = 'A' THEN 3 ELSE -1 END AS s FROM bb)
SELECT m.page, a AS uid, CASE WHEN l.s > c.s THEN l.cap ELSE c.cap END AS caption, 'paired' AS origin FROM matched m JOIN c ON c.page = m.page AND c.uid = a JOIN l ON l.page = m.page AND l.uid = b
UNION ALL SELECT page, uid, cap, 'local' FROM l WHERE (page, uid) NOT IN (SELECT (page, b) FROM matched)
UNION ALL SELECT page, uid, cap, 'cloud' FROM c WHERE (page, uid) NOT IN (SELECT (page, a) FROM matched) AND page NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def _(t):
    cloud = boxes(t, "l_linestatus = 'O'").withColumn("caption", F.when(F.col("text") == "R", "Figure 1. Seen").otherwise("seen"))
    local = boxes(t, "l_returnflag <> 'N'", dx="l_discount * 200").withColumn("caption", F.when(F.col("text") == "A", "Fig. 2 text.").otherwise(""))
    return op.merge_figures(cloud, local, t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("page")), 60.0, 40.0)


@query(
    "box_dedupe",
    f"""
WITH RECURSIVE w AS MATERIALIZED ({boxes_sql(text="l_partkey::VARCHAR")} UNION ALL SELECT page, concat('z', uid), text, conf, l_linestatus, flag, x0, y0, x1, y1 FROM ({boxes_sql("l_linestatus = 'O'", "l_discount * 200", "l_suppkey::VARCHAR")})),
 near AS MATERIALIZED (SELECT page, a, list(b) AS rivals FROM ({overlap_sql('w', 'w')}) WHERE iou >= 0.3 AND a <> b GROUP BY 1, 2),
 turn AS MATERIALIZED (SELECT w.page, uid, text, coalesce(rivals, []) AS rivals, row_number() OVER (PARTITION BY w.page ORDER BY length(text) DESC, uid) AS k FROM w LEFT JOIN near ON near.page = w.page AND near.a = uid),
 walk(page, k, kept, uid, text) AS (SELECT DISTINCT page, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR FROM turn
  UNION ALL SELECT page, k, CASE WHEN free THEN list_append(kept, uid) ELSE kept END, CASE WHEN free THEN uid END, text FROM (SELECT t.page, t.k, t.uid, t.text, kept, len(list_intersect(t.rivals, kept)) = 0 AS free FROM walk v JOIN turn t ON t.page = v.page AND t.k = v.k + 1))
SELECT page, uid, text::BIGINT AS text FROM walk WHERE uid IS NOT NULL""",
)
def _(t):
    words = boxes(t, text="l_partkey").unionByName(boxes(t, "l_linestatus = 'O'", dx="l_discount * 200", text="l_suppkey").withColumn("uid", F.concat(F.lit("z"), "uid")))
    return op.box_dedupe(words, 60.0, 40.0).select("page", "uid", "text")
