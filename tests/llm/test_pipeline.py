"""The pipeline's stages on a small table, each held against a plain version of its rule."""

from __future__ import annotations

import corpus_pipeline as C
from pyspark.sql import functions as F
from test_duplicates import repeats_by_hand, roots_of, shingles

from threadloom.llm.queries import table

ROOT = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, ROOT, "documents")
    names = docs.columns
    more = docs.limit(3).select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.lit("12 !").alias("text"), *[F.col(c) for c in names[2:]])
    docs = docs.unionByName(more).cache()
    before = {r.doc_id: r for r in docs.collect()}
    seen = {}
    for name, stage in C.STAGES:
        stage(spark, docs, ROOT).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "pack_documents":
            assert docs.columns == names
    kept = {r.doc_id for r in seen["language_id"]}
    assert kept == {i for i in before if i < 10_000_000}
    sets = {i: shingles(before[i].text) for i in kept}
    ids = sorted(kept)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots_of(ids, edges)
    assert {r.doc_id for r in seen["ngram_join"]} == set(root.values())
    want = repeats_by_hand([(r.doc_id, r.text) for r in seen["ngram_join"]], 100)
    for r in seen["suffix_dedup"]:
        assert r.text == want[r.doc_id][3].decode("utf-8", "ignore") and r.n_chars == len(r.text)
    texts = {r.doc_id: r.text for r in seen["suffix_dedup"]}
    assert all(texts[r.doc_id] == r.text for r in seen["mix_sources"])
    total = sum(len(t.split()) for t in texts.values())
    assert abs(sum(len(r.text.split()) for r in seen["mix_sources"]) - total) < 0.1 * total
    assert {r.doc_id for r in seen["pack_documents"]} == {r.doc_id for r in seen["mix_sources"]}
