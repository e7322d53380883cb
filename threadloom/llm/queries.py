"""Registered queries of this subpackage, each a thin form of one operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query(
    "op8_top_inner",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
      WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """,
)
def top_inner(spark, sf_dir):
    from threadloom.llm.topk import top_inner

    return top_inner(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


@query(
    "op10_near_vectors",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
    ), reach(node, root) AS (
      SELECT vec_id, vec_id FROM v
      UNION
      SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
    ), comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.root, e.vec_id) AS component_id, coalesce(c.root, e.vec_id) = e.vec_id AS kept
    FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN comp c ON c.node = e.vec_id
    """,
)
def near_vectors(spark, sf_dir):
    from threadloom.llm.vector_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_mix_sources")
def mix_sources(spark, sf_dir):
    from threadloom.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op1_warc_archives",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
    t AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
    SELECT d.page_id, d.payload_bytes, d.payload_digest,
      CASE WHEN t.top > d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN t.top > d.page_id THEN t.top END AS refers_to
    FROM d LEFT JOIN t ON t.payload_digest = d.payload_digest AND d.payload_bytes >= 1000
    """,
)
def warc_archives(spark, sf_dir):
    from threadloom.llm.shared import Scratch
    from threadloom.llm.warc import read_warc, write_warc

    root = Scratch(spark, "warc").path("archive")
    write_warc(table(spark, sf_dir, "pages"), root)
    return read_warc(spark, root, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_pack_documents")
def pack_documents(spark, sf_dir):
    from threadloom.llm.packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_language_id")
def language_id(spark, sf_dir):
    from threadloom.llm.langid import fit_languages, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs, ~held_out("doc_id") & F.col("doc_id").isNotNull())
    found = identify(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model)
    return found.select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__confidence").alias("score"))


@query("op9_quality")
def quality(spark, sf_dir):
    from threadloom.llm.langid import held_out
    from threadloom.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id") & F.col("doc_id").isNotNull())
    scored = score_quality(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model)
    score = F.col("__score")
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


@query("op7_url_filter")
def url_filter(spark, sf_dir):
    from threadloom.llm.urlfilter import fit_urls, judge_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, fit_urls(pages))
    return judged.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"), F.col("__score").alias("score"))


@query("op2_ngram_join", None)
def ngram_join(spark, sf_dir):
    from threadloom.llm.ngram_join import link_documents

    return link_documents(table(spark, sf_dir, "documents"))


@query("op4_suffix_dedup")
def suffix_dedup(spark, sf_dir):
    from threadloom.llm.suffix_dedup import drop_repeats

    cut = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.col("__n_spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256")
    )


def register_pipeline() -> None:
    """The module at the top of the repository registers itself as query ``pipeline``."""
    import corpus_pipeline

    if corpus_pipeline.ORACLE_SQL:
        SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


@query("op11_toxicity")
def toxicity(spark, sf_dir):
    from threadloom.llm.toxicity import fit_toxicity, score_toxicity

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held))
    score = F.col("__score")
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


@query(
    "op12_importance_resampling",
    r"""
    WITH w AS (
      SELECT doc_id, 0 AS side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws,
        row_number() OVER () AS r
      FROM documents
      UNION ALL
      SELECT NULL, 1, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), NULL
      FROM benchmark
    ), t AS (
      SELECT list_transform(range(256), lambda b: list_reduce([b, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc_table
    ), f AS (SELECT side, r, unnest(ws) AS word FROM w),
    v AS (SELECT DISTINCT word FROM f),
    h AS (
      SELECT word, xor(list_reduce(
          list_concat([4294967295::BIGINT], list_transform(range(0, octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT))),
          lambda c, b: xor(c // 256, crc_table[CAST(xor(c % 256, b) AS INTEGER) + 1])), 4294967295) % 10000 AS bucket
      FROM v, t
    ), c AS (
      SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN h USING (word) GROUP BY bucket
    ), total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM c),
    g AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM c, total),
    d AS (SELECT r, count(*) AS n, sum(gain) AS gains FROM f JOIN h USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
    x AS (
      SELECT w.doc_id, coalesce(d.n, 0) AS n_features, CAST(coalesce(floor(d.gains / d.n), 0) AS BIGINT) AS weight,
        CAST('0x' || substr(sha256('2024:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS hash
      FROM w LEFT JOIN d USING (r) WHERE w.side = 0
    ), y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((hash + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
    z AS (
      SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS pos, count(*) FILTER (n_features >= 20) OVER () AS fit FROM y
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND pos <= 10 * fit // 100 THEN pos END AS rank FROM z
    """,
)
def importance_resampling(spark, sf_dir):
    from threadloom.llm.resampling import importance_ranks

    ranks = importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


@query(
    "op13_filter_audit",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
    m AS (
      SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic, {
        'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
        'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)} AS f
      FROM d LEFT JOIN l ON l.doc_id = d.doc_id
    ), k AS (
      SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails, count(*) AS n
      FROM m GROUP BY ALL
    ), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    o AS (
      SELECT a.c || b.c || e.c || g.c || h.c AS filter_order FROM x a, x b, x e, x g, x h
      WHERE len(list_distinct([a.c, b.c, e.c, g.c, h.c])) = 5
    ), s AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step)),
    r AS (
      SELECT part, filter_order, step, own, n, good, toxic, list_contains(fails, own) AS failing, len(fails) = 1 AS one, len(list_intersect(fails, before)) > 0 AS gone FROM k, s
    ), z AS (
      SELECT part, filter_order, step, own,
        sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN failing AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failing AND one THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN failing AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN failing AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
      FROM r GROUP BY ALL
    )
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM z
    """,
)
def filter_audit(spark, sf_dir):
    from threadloom.llm.filter_audit import audit_documents

    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
