"""Search queries: documents are the corpus, sentences of the benchmark texts the questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import search as op
from threadloom.plans.base import query
from threadloom.plans.sources import BLOCKS_SQL
from threadloom.session import written
from threadloom.sources.blocks import text_to_blocks

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
STOP = "('" + "','".join(op.STOP_WORDS) + "')"


def docs(t):
    return t.documents.select(F.col("doc_id").alias("doc"), "text")


@query(
    "parts_index",
    f"""
WITH b AS ({BLOCKS_SQL}), c AS (SELECT doc_id, concat('Quality ', quality, ' toxic ', toxic) AS cap FROM labels)
SELECT doc, pos, type AS kind, concat_ws(chr(10), text, CASE WHEN pos = 0 THEN cap END) AS text, lower(concat_ws(chr(10), text, CASE WHEN pos = 0 THEN cap END)) AS lower
FROM b LEFT JOIN c ON doc_id = doc""",
)
def _(t):
    captions = t.labels.select(F.col("doc_id").alias("doc"), F.lit(0).alias("pos"), F.concat(F.lit("Quality "), "quality", F.lit(" toxic "), "toxic").alias("caption"))
    return op.parts_index(text_to_blocks(t.documents), captions)


@query(
    "gram_postings",
    f"""
WITH w AS (SELECT doc_id AS doc, unnest(list_distinct({WORDS.format('text')})) AS w FROM documents),
 g AS (SELECT DISTINCT doc, substr(w, i, n) AS gram FROM w, unnest([1, 2, 3]) x(n), unnest(range(1, length(w) - n + 2)) u(i))
SELECT gram, count(*) AS docs, min(doc) AS first_doc FROM g GROUP BY gram""",
)
def _(t):
    return op.gram_postings(docs(t)).groupBy("gram").agg(F.count("*").alias("docs"), F.min("doc").alias("first_doc"))


SENTENCES_SQL = f"""SELECT DISTINCT lower(trim(s, ' .')) AS query, lower(trim(s, ' .')) AS phrase, list_distinct({WORDS.format("trim(s, ' .')")}) AS terms
 FROM (SELECT unnest(string_split(replace(text, chr(10), '. '), '. ')) AS s FROM benchmark) WHERE length(trim(s, ' .')) >= 8"""


def sentences(t):
    s = t.benchmark.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(". ")), r"\. ")).alias("s")).select(F.expr("lower(trim(BOTH ' .' FROM s))").alias("query"))
    return s.where(F.length("query") >= 8).distinct().select("query", F.col("query").alias("phrase"), op.words(F.col("query")).alias("terms"))


PARTS_SQL = r"""SELECT doc_id AS doc, (i // 20) + 1 AS page, i AS part, trim(regexp_replace(s, '\s+', ' ', 'g')) AS text, CASE WHEN length(s) < 80 THEN 'heading' WHEN contains(s, ',') THEN 'paragraph' ELSE 'caption' END AS kind
 FROM (SELECT doc_id, i, string_split(text, chr(10))[i + 1] AS s FROM documents, unnest(range(len(string_split(text, chr(10))))) u(i))"""


def line_parts(t):
    """Lines as parts, twenty a page, with a kind by their shape."""
    lines = t.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("part", "text"))
    kind = F.when(F.length("text") < 80, "heading").when(F.contains("text", F.lit(",")), "paragraph").otherwise("caption")
    return lines.select("doc", (F.floor(F.col("part") / 20) + 1).alias("page"), "part", kind.alias("kind"), "text")


ASKED_SQL = r"""SELECT DISTINCT query, lower(replace(query, '"', '')) AS phrase,
  list_filter(list_transform(regexp_extract_all(query, '"[^"]*"|\S+'), lambda x: trim(CASE WHEN regexp_matches(x, '^".*"$') THEN x[2:-2] ELSE x END)), lambda x: x <> '') AS terms,
  CASE length(query) % 4 WHEN 0 THEN ['heading', 'caption'] WHEN 1 THEN ['paragraph'] WHEN 2 THEN CAST([] AS VARCHAR[]) END AS kinds,
  CASE length(query) % 6 WHEN 0 THEN 'p. 1' WHEN 1 THEN '1-3' WHEN 2 THEN '2-' WHEN 3 THEN '-1' WHEN 4 THEN 'all' END AS pages
 FROM (SELECT lower(unnest([s, concat('"', w[1], ' ', w[2], '" ', w[3])])) AS query
  FROM (SELECT s, string_split(s, ' ') AS w FROM (SELECT trim(unnest(string_split(replace(text, chr(10), '. '), '. ')), ' .') AS s FROM benchmark)) WHERE length(s) >= 8 AND len(w) >= 3)
 UNION ALL SELECT * FROM (VALUES ('', '', CAST([] AS VARCHAR[]), ['caption'], 'pages 2-3'), ('-', '-', ['-'], NULL, NULL)) v(query, phrase, terms, kinds, pages)"""


def asked_parts(t):
    """Sentences and quoted word pairs, with kinds and page ranges; a query without terms and one without letters."""
    s = t.benchmark.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(". ")), r"\. ")).alias("s")).select(F.expr("trim(BOTH ' .' FROM s)").alias("s"), F.expr("split(trim(BOTH ' .' FROM s), ' ')").alias("w"))
    s = s.where((F.length("s") >= 8) & (F.size("w") >= 3))
    forms = F.expr("""array(s, concat('"', w[0], ' ', w[1], '" ', w[2]))""")
    q = s.select(F.explode(F.transform(forms, F.lower)).alias("query")).distinct()
    kinds = F.expr("CASE length(query) % 4 WHEN 0 THEN array('heading', 'caption') WHEN 1 THEN array('paragraph') WHEN 2 THEN CAST(array() AS array<string>) END")
    pages = F.expr("CASE length(query) % 6 WHEN 0 THEN 'p. 1' WHEN 1 THEN '1-3' WHEN 2 THEN '2-' WHEN 3 THEN '-1' WHEN 4 THEN 'all' END")
    asked = q.select("query", op.query_phrase(F.col("query")).alias("phrase"), op.query_terms(F.col("query")).alias("terms"), kinds.alias("kinds"), pages.alias("pages"))
    bare = [("", "", [], ["caption"], "pages 2-3"), ("-", "-", ["-"], None, None)]
    return asked.unionByName(t.spark.createDataFrame(bare, asked.schema))


PART_SEARCH_SQL = f"""
WITH q AS MATERIALIZED (SELECT *, CASE pages WHEN 'p. 1' THEN [1, 1] WHEN '1-3' THEN [1, 3] WHEN '2-' THEN [2, 1000000] WHEN '-1' THEN [1, 1] WHEN 'pages 2-3' THEN [2, 3] END AS span FROM ({ASKED_SQL})),
 d AS MATERIALIZED (SELECT *, lower(text) AS low FROM ({PARTS_SQL})),
 f AS (SELECT query, phrase, terms, doc, page, part, kind, text, low FROM q JOIN d ON (len(terms) = 0 OR contains(low, terms[1])) AND len(list_filter(terms, lambda x: NOT contains(low, x))) = 0
  WHERE query <> '-' AND (kinds IS NULL OR len(kinds) = 0 OR list_contains(kinds, kind)) AND (span IS NULL OR page BETWEEN span[1] AND span[2])),
 h AS (SELECT *, CASE WHEN contains(low, phrase) THEN phrase ELSE terms[1] END AS needle FROM f),
 a AS (SELECT *, greatest(0, 120 - length(needle)) AS room, strpos(low, needle) - 1 AS spot FROM h),
 b AS (SELECT *, greatest(0, spot - room // 3) AS start FROM a),
 c AS (SELECT *, least(length(text), start + length(needle) + room) AS stop FROM b),
 r AS (SELECT query, doc, page, part, kind, len(terms) > 1 AND contains(low, phrase) AS exact,
  CAST(coalesce(list_sum(list_transform(terms, lambda x: (length(low) - length(replace(low, x, ''))) // length(x))), 0) AS BIGINT) AS hits,
  CASE WHEN len(terms) = 0 THEN concat(substr(text, 1, 120), CASE WHEN length(text) > 120 THEN '…' ELSE '' END)
   ELSE concat(CASE WHEN start > 0 THEN '…' ELSE '' END, substr(text, start + 1, stop - start), CASE WHEN stop < length(text) THEN '…' ELSE '' END) END AS snippet FROM c)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY exact DESC, hits DESC, doc, page, part) AS pos FROM r"""


@query("search_parts", PART_SEARCH_SQL)
def _(t):
    return op.search_parts(line_parts(t), asked_parts(t))


DOCUMENT_PARTS_SQL = r"SELECT doc_id AS doc, 1 AS page, 0 AS part, 'paragraph' AS kind, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents"
ANY_PART_SQL = f"SELECT *, CAST(NULL AS VARCHAR[]) AS kinds, CAST(NULL AS VARCHAR) AS pages FROM ({SENTENCES_SQL})"


@query("search_documents", PART_SEARCH_SQL.replace(ASKED_SQL, ANY_PART_SQL).replace(PARTS_SQL, DOCUMENT_PARTS_SQL).replace("SELECT *, row_number() OVER (PARTITION BY query ORDER", "SELECT * EXCLUDE (snippet), row_number() OVER (PARTITION BY query ORDER"))
def _(t):
    """Whole documents as parts, the words of a sentence as terms, every kind and page."""
    asked = sentences(t).withColumns({"kinds": F.lit(None).cast("array<string>"), "pages": F.lit(None).cast("string")})
    parts = docs(t).select("doc", F.lit(1).alias("page"), F.lit(0).alias("part"), F.lit("paragraph").alias("kind"), "text")
    return op.search_parts(parts, asked).drop("snippet")


MISTYPED_SQL = f"""SELECT query, phrase, list_distinct(list_transform(terms, lambda w: CASE WHEN w = longest AND length(w) >= 6 THEN concat(substr(w, 1, 1), substr(w, 3)) ELSE w END)) AS terms
 FROM (SELECT *, list_sort(list_transform(terms, lambda w: {{'l': -length(w), 'w': w}}))[1].w AS longest FROM ({SENTENCES_SQL}))"""


def mistyped(t):
    """Sentences whose longest word lacks its second letter."""
    longest = F.array_min(F.transform("terms", lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))["w"]
    drop = lambda w: F.when((w == longest) & (F.length(w) >= 6), F.concat(F.substr(w, F.lit(1), F.lit(1)), F.substr(w, F.lit(3), F.length(w)))).otherwise(w)
    return sentences(t).select("query", "phrase", F.array_distinct(F.transform("terms", drop)).alias("terms"))


def text_pages(t):
    lines = t.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    rows = lines.select(F.col("doc").alias("file"), F.floor(F.col("pos") / 20).cast("int").alias("page"), "pos", F.lit("para").alias("kind"), "text")
    return op.fold_part_rows(rows).select(F.col("file").alias("doc"), "page", "text")


@query(
    "search_fulltext",
    f"""
WITH q AS MATERIALIZED ({MISTYPED_SQL}), t AS MATERIALIZED (SELECT query, unnest(terms) AS term, len(terms) AS n FROM q), x AS MATERIALIZED (SELECT DISTINCT term FROM t),
 l AS (SELECT doc_id AS doc, i // 20 AS page, i, string_split(text, chr(10))[i + 1] AS s FROM documents, unnest(range(len(string_split(text, chr(10))))) u(i)),
 p AS MATERIALIZED (SELECT doc, page, lower(trim(regexp_replace(string_agg(s, chr(10) ORDER BY i), '\\s+', ' ', 'g'))) AS low FROM l GROUP BY 1, 2),
 w AS MATERIALIZED (SELECT doc, page, unnest(list_distinct(regexp_extract_all(low, '[a-z0-9]+'))) AS word FROM p),
 m AS MATERIALIZED (SELECT term, word FROM x JOIN (SELECT DISTINCT word FROM w) ON abs(length(term) - length(word)) <= 1 AND levenshtein(translate(term, 'àâäçéèêëîïôöùûüßñíóáú', 'ABCDEFGHIJKLMNOPQRSTU'), word) <= 1 WHERE length(term) >= 4),
 h AS (SELECT doc, page, term, false AS fuzzy FROM p JOIN x ON contains(low, term) UNION ALL SELECT DISTINCT doc, page, term, true FROM w JOIN m USING (word)),
 g AS (SELECT doc, page, term, bool_and(fuzzy) AS fuzzy FROM h GROUP BY 1, 2, 3),
 r AS (SELECT query, doc, page, bool_or(fuzzy) AS fuzzy, any_value(n) AS terms FROM g JOIN t USING (term) GROUP BY 1, 2, 3 HAVING count(*) = any_value(n))
SELECT query, doc, page, contains(low, phrase) AND (r.terms > 1 OR contains(phrase, ' ')) AS exact, fuzzy, r.terms,
 row_number() OVER (PARTITION BY query ORDER BY contains(low, phrase) AND (r.terms > 1 OR contains(phrase, ' ')) DESC, fuzzy, doc, page) AS pos FROM r JOIN q USING (query) JOIN p USING (doc, page)""",
)
def _(t):
    return op.search_fulltext(text_pages(t), mistyped(t))


@query(
    "fold_part_rows",
    """
WITH l AS (SELECT doc_id AS file, i // 20 AS page, i AS pos, string_split(text, chr(10))[i + 1] AS s FROM documents, unnest(range(len(string_split(text, chr(10))))) u(i))
SELECT file, page, count(*) AS parts, string_agg(s, chr(10) ORDER BY pos) AS text FROM l WHERE NOT contains(s, '%') GROUP BY 1, 2""",
)
def _(t):
    lines = t.documents.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = F.when(F.col("text").contains("%"), "figure").otherwise("para")
    return op.fold_part_rows(lines.withColumn("page", F.floor(F.col("pos") / 20)).withColumn("kind", kind))


@query(
    "find_on_board",
    """
SELECT o_custkey AS board, concat('o', o_orderkey) AS uid, 'item' AS kind, concat('o', o_orderkey) AS focus FROM orders WHERE contains(lower(o_orderpriority), 'urgent')
UNION ALL SELECT o_custkey, concat('e', o_orderkey), 'edge', concat('e', o_orderkey) FROM orders WHERE contains(lower(concat('to ', o_orderstatus, ' urgent')), 'urgent') AND o_orderstatus = 'P'
UNION ALL SELECT c_nationkey, concat('o', o_orderkey), 'nested', concat('c', o_custkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(o_orderpriority), 'urgent')""",
)
def _(t):
    o = F.concat(F.lit("o"), "o_orderkey")
    items = t.orders.select(F.col("o_custkey").alias("board"), o.alias("uid"), F.col("o_orderpriority").alias("hay"))
    edges = t.orders.select(F.col("o_custkey").alias("board"), F.concat(F.lit("e"), "o_orderkey").alias("uid"), F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("to "), "o_orderstatus", F.lit(" Urgent"))).otherwise("").alias("label"))
    nested = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("board"), o.alias("uid"), F.concat(F.lit("c"), "o_custkey").alias("holder"), F.col("o_orderpriority").alias("hay"))
    return op.find_on_board(items, edges, nested, " Urgent ")


BM25_SQL = f"""
WITH c AS MATERIALIZED (SELECT doc_id AS doc, list_filter({WORDS.format('text')}, lambda w: length(w) >= 2 AND w NOT IN {STOP}) AS t FROM documents),
 st AS (SELECT count(*) AS n, avg(len(t)) AS al FROM c),
 qq AS MATERIALIZED (SELECT DISTINCT item_id AS query, unnest(list_filter({WORDS.format('text')}, lambda w: length(w) >= 2 AND w NOT IN {STOP})) AS token FROM benchmark),
 x AS (SELECT doc, len(t) AS l, unnest(t) AS token FROM c),
 tf AS MATERIALIZED (SELECT doc, l, token, count(*) AS f FROM x WHERE token IN (SELECT token FROM qq) GROUP BY ALL),
 df AS (SELECT token, count(*) AS d FROM tf GROUP BY 1),
 s AS (SELECT query, doc, round(sum(ln(1 + (n - d + 0.5::DOUBLE) / (d + 0.5::DOUBLE)) * (f * 2.2::DOUBLE) / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al))), 6) AS score
  FROM tf JOIN df USING (token) JOIN qq USING (token), st GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS pos FROM s)"""


@query("bm25_rank", BM25_SQL + " SELECT * FROM r")
def _(t):
    return op.bm25_rank(docs(t), t.benchmark.select(F.col("item_id").alias("query"), "text"))


@query(
    "context_pack",
    BM25_SQL.replace("WITH c", "WITH RECURSIVE c", 1)
    + """, z AS (SELECT query, doc, pos, (n_chars + 3) // 4 AS size, lang = 'en' AND n_chars < 800 AS forced FROM r JOIN documents ON doc_id = doc),
 i AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY forced DESC, pos) AS turn FROM z),
 w(query, turn, used, took) AS (SELECT DISTINCT query, 0::BIGINT, 0::BIGINT, false FROM i
  UNION ALL SELECT i.query, i.turn, CASE WHEN used + size <= 2000 THEN used + size ELSE used END, used + size <= 2000 FROM w JOIN i ON i.query = w.query AND i.turn = w.turn + 1)
SELECT i.query, doc, pos, size, forced, used FROM w JOIN i ON i.query = w.query AND i.turn = w.turn WHERE took""",
)
def _(t):
    scores = op.bm25_scores(docs(t), t.benchmark.select(F.col("item_id").alias("query"), "text"))
    parts = t.documents.select(F.col("doc_id").alias("doc"), F.ceil(F.col("n_chars") / 4).alias("size"), F.expr("lang = 'en' AND n_chars < 800").alias("forced"))
    sized = written(scores.join(parts.hint("shuffle_hash"), "doc"))
    taken = op.context_pack(sized, 2000, [F.col("score").desc(), "doc"])
    return op.placed(taken, sized).select("query", "doc", "pos", "size", "forced", "used")


@query(
    "related_query_text",
    """
WITH k AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE turn > 0),
 g AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS kids FROM k WHERE rn <= 10 GROUP BY 1)
SELECT c.conv_id AS uid, substr(concat_ws(chr(10), c.role, c.text, kids), 1, 600) AS query_text FROM conversations c LEFT JOIN g ON g.conv_id = c.conv_id WHERE c.turn = 0""",
)
def _(t):
    rows = t.conversations.where("turn = 0").select(F.col("conv_id").alias("uid"), F.col("role").alias("title"), "text")
    return op.related_query_text(rows, t.conversations.where("turn > 0").select(F.col("conv_id").alias("uid"), F.col("turn").alias("ord"), "text"))


@query(
    "nearest_vectors",
    """
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id DESC LIMIT 1)
SELECT e.vec_id AS uid, e.label, row_number() OVER (ORDER BY list_dot_product(e.embedding::DOUBLE[], v) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) DESC, e.vec_id) AS pos
FROM embeddings e, q WHERE e.vec_id <> q.vec_id""",
)
def _(t):
    items = t.embeddings.select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vec"), "label")
    return op.nearest_vectors(items, items.orderBy(F.col("uid").desc()).limit(1), None).drop("score")


@query(
    "search_images",
    """
WITH p AS (SELECT p_partkey AS key, unnest([{'l': p_size / 50.0::DOUBLE, 'a': (p_retailprice - 900) / 1000 - 0.1, 'b': 0.15::DOUBLE, 'w': 0.7::DOUBLE},
   {'l': 0.5::DOUBLE, 'a': 0.02::DOUBLE, 'b': 0.01::DOUBLE, 'w': 0.3::DOUBLE}]) AS e FROM part),
 s AS (SELECT key, max(e.w * CASE WHEN sqrt(e.a * e.a + e.b * e.b) < 0.035 THEN 0 ELSE greatest(0.0, 1 - sqrt(pow((e.l - 0.6) * 0.5, 2) + pow(e.a - 0.05, 2) + pow(e.b - 0.12, 2)) / 0.2) END) AS sc FROM p GROUP BY 1)
SELECT key, round(sc, 6) AS score, row_number() OVER (ORDER BY round(sc, 6) DESC, key) AS pos FROM s JOIN part ON p_partkey = key WHERE sc >= 0.15 AND contains(lower(concat(p_name, ' ', p_type)), 'ring')""",
)
def _(t):
    entry = lambda l, a, b, w: F.struct(l.cast("double").alias("l"), a.cast("double").alias("a"), b.cast("double").alias("b"), w.cast("double").alias("weight"))  # noqa: E731, E741
    entries = F.array(
        entry(F.col("p_size") / 50.0, (F.col("p_retailprice") - 900) / 1000 - 0.1, F.lit(0.15), F.lit(0.7)),
        entry(F.lit(0.5), F.lit(0.02), F.lit(0.01), F.lit(0.3)),
    )
    palette = t.part.select(F.col("p_partkey").alias("key"), F.explode(entries).alias("e")).select("key", "e.*")
    images = t.part.select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("hay"), F.col("p_partkey").alias("seq"))
    return op.search_images(images, palette, ["ring"], {"mustard": (0.6, 0.05, 0.12)})


@query(
    "identity_match",
    """SELECT doc_id AS doc, lang AS venue FROM documents WHERE contains(lower(concat_ws(chr(10), split_part(text, chr(10), 1), source, lang, text)), 'tion')
 AND contains(lower(concat_ws(chr(10), split_part(text, chr(10), 1), source, lang, text)), 'src3')""",
)
def _(t):
    idents = t.documents.select(F.col("doc_id").alias("doc"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("source").alias("authors"), F.col("lang").alias("venue"), "text")
    return op.identity_match(idents, ["tion", "src3"]).select("doc", "venue")
