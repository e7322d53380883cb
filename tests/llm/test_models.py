"""Language, quality and url models: held-out accuracy, invariance and odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm.langid import ORDER, SYMBOLS, _counts, _kneser_ney, fit_languages, fold_text, held_out, identify
from threadloom.llm.quality import fit_quality, score_quality
from threadloom.llm.queries import QUERIES, table
from threadloom.llm.urlfilter import COMMON, fit_urls, judge_urls, rule_for, split_url

ROOT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROOT, "documents")


def test_kneser_ney_by_hand():
    import pandas as pd

    texts = ["abab abc", "abba"]
    rows = pd.concat(list(_counts([pd.DataFrame({"lang": "x", "text": texts})])))
    rows = rows.groupby(["lang", "g"], as_index=False).agg({"n": "sum", **{c: "first" for c in rows.columns if c[0] in "sc"}})
    model = _kneser_ney(rows, ["x"])
    grams = {k: {} for k in range(1, ORDER + 1)}
    for t in texts:
        p = " " * ORDER + fold_text(t)
        for i in range(ORDER, len(p)):
            g = p[i - ORDER + 1 : i + 1]
            grams[ORDER][g] = grams[ORDER].get(g, 0) + 1
    for k in range(ORDER - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / SYMBOLS
        c = grams[k]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = n1 / (n1 + 2 * n2) if n1 else 0.5
        mine = [v for x, v in c.items() if x[:-1] == g[:-1]]
        if not mine:
            return p(g[1:])
        left = d * len(mine) / sum(mine)
        return max(c.get(g, 0) - d, 0) / sum(mine) + (max(left, 0.5 / sum(mine)) if k == 1 else left) * p(g[1:])

    for text in ("abab", "cab", "zzz", "bca  b"):
        t = " " * ORDER + fold_text(text)
        want = -sum(math.log(p(t[i - ORDER + 1 : i + 1])) for i in range(ORDER, len(t))) / (len(t) - ORDER)
        got, n = model.entropies([text, text])
        assert got[0, 0] == pytest.approx(want, rel=1e-4) and got[1, 0] == pytest.approx(want, rel=1e-4) and n[0] == len(t) - ORDER


def test_language_accuracy_and_odd_texts(spark, docs):
    model = fit_languages(docs, ~held_out("doc_id"), per_language=60)
    held = identify(docs.where(held_out("doc_id")), model).select("lang", "__lang", "__rejected").toPandas()
    assert (held["lang"] == held["__lang"]).mean() > 0.97 and held["__rejected"].mean() < 0.01
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !!", 1), (4, "de la maison " * 90000, 1), (5, "日本語の文章です" * 30, 1), (5, "the", 1)], "doc_id long, text string, __n int")
    got = {(r.doc_id, len(r.text or "")): r for r in identify(odd, model).collect()}
    assert len(got) == 6 and [got[i, n]["__lang"] for i, n in ((1, 0), (2, 0), (3, 6))] == ["und"] * 3
    assert got[5, 240]["__rejected"] and not got[4, 13 * 90000]["__rejected"] and got[5, 3]["__lang"] in model.languages
    assert all(0 <= r["__confidence"] <= 1 for r in got.values())
    assert fit_languages(docs.limit(0), F.lit(True)) is None
    assert {r["__lang"] for r in identify(odd, None).collect()} == {"und"}
    assert identify(odd.limit(0), model).count() == 0


def test_quality_ranks_held_out_documents(spark, docs):
    labels = table(spark, ROOT, "labels")
    model = fit_quality(docs, labels, ~held_out("doc_id"), sample=400)
    got = score_quality(docs.where(held_out("doc_id")), model).join(labels, "doc_id").select("quality", "__score").toPandas()
    assert ((got["__score"] >= 0.3) == (got["quality"] == 1)).mean() > 0.9
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "word " * 300000), (2, "x")], "score long, text string")
    scores = [r["__score"] for r in score_quality(odd, model).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1]
    assert fit_quality(docs, labels.limit(0), F.lit(True)) is None
    assert score_quality(odd, None).where("__score = 0.5").count() == 4
    assert score_quality(odd.limit(0), model).count() == 0


def test_url_parts_and_rules(spark):
    rows = ["http://A.Example.ORG/en/12?x#y", "x", None, "://h", "a://b.com?x/y", "http://com/fr/", "http://xcom/fr/1", "http://q.example.org/es/1", "http://org", "ftp://ÄB.org/#", "http://u://v/w", "https://s.com/de/2"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "i int, url string")
    host, path = split_url(F.col("url"))
    rule, action = rule_for(host, path)
    got = [tuple(r)[1:] for r in df.select("i", host, path, rule, action).orderBy("i").collect()]
    assert got == [
        ("a.example.org", "/en/12", "example.org/en/1", "block"), ("", "", None, None), ("", "", None, None), ("h", "", None, None), ("b.com", "", None, None), ("com", "/fr/", "com/fr/", "allow"),
        ("xcom", "/fr/1", None, None), ("q.example.org", "/es/1", "example.org/es/", "block"), ("org", "", None, None), ("Äb.org", "/", "org/", "allow"), ("u:", "//v/w", None, None), ("s.com", "/de/2", "com/de/", "block"),
    ]


def test_url_model_segments_and_judges(spark):
    pages = table(spark, ROOT, "pages")
    model = fit_urls(pages)
    assert model.split("cheappills") == ["cheap", "pills"] and model.split("onlinecasino") == ["online", "casino"]

    def best(name):
        return max((sum(model.words.get(w, math.log(10 / model.total) - len(w) * math.log(10)) for w in ws), ws) for ws in cuts(name))[0]

    def cuts(name):
        return [[name]] + [[name[:k], *rest] for k in range(1, len(name)) for rest in cuts(name[k:])]

    for name in ("blogshop", "xxwebq", *COMMON[:3]):
        assert sum(model.words.get(w, math.log(10 / model.total) - len(w) * math.log(10)) for w in model.split(name)) == pytest.approx(best(name))
    odd = spark.createDataFrame([(1, "http://www.cheappills.net/a"), (2, None), (3, "http://" + "a" * 3000 + ".net/"), (4, "http://my-blog.net/"), (4, "http://my-blog.net/")], "host long, url string")
    got = sorted((r["host"], r["__verdict"]) for r in judge_urls(odd, model).collect())
    assert got == [(1, "block"), (2, "allow"), (3, "allow"), (4, "allow"), (4, "allow")]
    assert judge_urls(odd.limit(0), model).count() == 0
    assert fit_urls(pages.limit(0)).split("cheappills") == ["cheap", "pills"]


def test_every_operator_has_its_query():
    assert {int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")} == set(range(1, 14))
    assert np.all([callable(q) for q in QUERIES.values()])


def test_one_odd_calibrating_text_does_not_lift_the_limit():
    import pandas as pd

    from threadloom.llm.langid import Model, _calibrate

    rng = np.random.default_rng(5)
    own = [*(1.5 + 0.05 * rng.standard_normal(60)), 4.5]  # the last text is long and not of the language
    seen = pd.DataFrame({"lang": "x", "n": [1500.0] * 60 + [20000.0], "ce": [[c] for c in own]})
    model = _calibrate(Model(["x"], [], [], [], [], np.zeros(1)), seen)
    limit = model.centre[0] + model.margin[0] + model.spread[0] / math.sqrt(1500)
    assert 1.5 + 4 * 0.05 < limit < 2.75
    wide = seen.assign(ce=[[1.5 + 20 * (c - 1.5)] if c < 4 else [c] for c in own])
    assert _calibrate(Model(["x"], [], [], [], [], np.zeros(1)), wide).margin[0] > 2 * model.margin[0]


@pytest.mark.parametrize("out", ["es", "fr"])
def test_texts_of_a_language_left_out_are_rejected(spark, out):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    model = fit_languages(docs.where(F.col("lang") != out), ~held_out("doc_id"))
    got = identify(docs.where(held_out("doc_id") & F.col("text").rlike(r"\p{L}")), model).select("lang", "__rejected").toPandas()
    mine = got["lang"] == out
    assert got["__rejected"][mine].mean() > 0.9 and got["__rejected"][~mine].mean() < 0.02


def test_shapes_read_words_whole():
    from itertools import groupby

    from threadloom.llm.quality import SHAPE_TABLE, _shape, _shapes

    words = ["ab", "Ab1", "", "b", "", "é.", "..", ".", "Ab12", "", ""]
    kinds, at = _shapes(words)
    assert [kinds[i] for i in at] == ["".join(k for k, _ in groupby(chr(SHAPE_TABLE[b]) for b in w.encode())) for w in words]
    assert _shapes([])[0] == [] and _shapes(["", ""])[0] == [""]
    assert _shape("é" * 40 + "A1!") == "aA0!" and _shape("x" * 64 + "!" + "9" * 100_000 + "B") == "a!0A" and _shape("") == ""


def test_url_counts_are_whole_whatever_the_vocabulary(spark):
    pages = table(spark, ROOT, "pages").select("url").limit(400)
    odd = spark.createDataFrame([("http://zyxwvqueue.net/zyxwv/queue",), ("http://zyxwv-casino.net/q/q",), (None,), ("http://zyxwvqueue.net/zyxwv/queue",)], "url string")
    rows = pages.unionByName(odd)
    whole, small = fit_urls(rows), fit_urls(rows, vocabulary=5)
    assert whole.rare_words is None and len(small.words) == len(small.tokens) == 5
    want, got = (sorted(((r["url"] or "", r["__verdict"], round(r["__score"], 9)) for r in judge_urls(rows, m).collect())) for m in (whole, small))
    assert got == want
    again = fit_urls(spark.range(210_000).select(F.format_string("http://a.net/%s", F.translate(F.conv("id", 10, 8), "01234567", "abcdefgh")).alias("url")))
    assert round(math.exp(again.words["net"]) * again.total) == 210_000 + 50


def test_word_vectors_sum_over_all_training_texts(spark):
    import pyarrow as pa

    from threadloom.llm import quality as q

    texts = ["a b c a", None, "", "b a", "x", "a a"]
    known = np.sort(q._hash(["a", "b", "x"]))
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    got = {h: np.array(v) for out in q._neighbour_sums(known, iter([batch, batch])) for h, v in zip(out.column(0).to_numpy().view(np.uint64), out.column(1).to_pylist(), strict=True)}
    one = {w: q.index_vectors(q._hash([w]))[0].astype(float) for w in "abcx"}
    want = {w: np.zeros(q.DIM) for w in "ab"}
    for t in texts:
        words = (t or "").split()
        for i, w in enumerate(words):
            for j in range(max(0, i - q.WINDOW), min(len(words), i + q.WINDOW + 1)):
                if j != i and w in want:
                    want[w] += 2 * one[words[j]]
    assert set(got) == set(q._hash(["a", "b"])) and all(np.allclose(got[q._hash([w])[0]], v) for w, v in want.items())
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(["good fine words here"] * 4 + ["bad poor words there"] * 4)] + [(1, "another text of an id", 0)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(8)], "doc_id long, quality int")
    one, two = (fit_quality(d, labels, F.lit(True)) for d in (docs, docs.repartition(3)))
    assert np.array_equal(one.hashes, two.hashes) and all(np.allclose(a, b) for a, b in zip(one.layers, two.layers, strict=True))
