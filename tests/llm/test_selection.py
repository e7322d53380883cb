"""Toxicity model, importance resampling and the filter audit: brute force, held-out accuracy and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import resampling, toxicity
from threadloom.llm.filter_audit import audit_documents, audit_filters
from threadloom.llm.queries import table
from threadloom.llm.resampling import importance_ranks, resampled
from threadloom.llm.toxicity import fit_toxicity, score_toxicity, word_grams

ROOT = "/root/testdata/sf0.01"


def _features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def _ranks(docs, target, longest, buckets, percent, least):
    def hashed(feats):
        return Counter(zlib.crc32(f.encode()) % buckets for f in feats)

    s = sum((hashed(_features(t, longest)[1]) for _, t in docs), Counter())
    t = sum((hashed(_features(x, longest)[1]) for x in target), Counter())
    size, aim = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (size + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        words, feats = _features(text, longest)
        weight = sum(gain[b] * n for b, n in hashed(feats).items()) // len(feats) if feats else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize(("longest", "stretch"), [(1, 1 << 20), (1, 7), (3, 1 << 20), (3, 9)])
def test_ranks_equal_brute_force(spark, monkeypatch, longest, stretch):
    monkeypatch.setattr(resampling, "STRETCH", stretch)
    rng = random.Random(4)
    vocabulary = ["Ab", "b2", "ümlaut", "ÜB", "x", "日本", "mid-way", "a\x00b", "Q&A", "é"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(12)))) for i in range(60)]
    docs += [(3, docs[3][1]), (None, "b2 x x x"), (None, None), (70, None), (71, ""), (72, "  ,;"), (73, "x " * 4000), (-5, "日本" * 3000), (74, docs[5][1]), (75, docs[5][1])]
    target = ["x ümlaut b2", None, "", "Ab ab AB x"]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, __fit int")
    got = importance_ranks(d.repartition(5), spark.createDataFrame([(t, 1) for t in target], "text string, n int"), longest=longest, buckets=97, percent=30, least_words=4)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = _ranks(docs, target, longest, 97, 30, 4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    drawn = {r[0] for r in want if r[5]}
    assert {r["doc_id"] for r in resampled(d, got).collect()} == drawn - {None}


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    assert importance_ranks(none, some).count() == 0
    row = importance_ranks(some, none, percent=100).first()
    assert row["rank"] == 1 and row["n_features"] == 60


def _audit(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    bad = {i for i, _, t in labels if i is not None and t == 1}
    rows = []
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, v in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)),
            i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)), strict=True) if v}
        rows.append((source or "", fails, i in good, i in bad))
    out = []
    for part in {r[0] for r in rows}:
        mine, share, lines = [r for r in rows if r[0] == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order):
                lost = [r for r in left if c in r[1]]
                share[c] += len(lost)
                failing = sum(c in r[1] for r in mine)
                left = [r for r in left if c not in r[1]]
                lines.append((part, order, step + 1, len(left), len(lost), failing - len(lost), sum(r[1] == {c} for r in mine), sum(r[2] for r in lost), sum(r[3] for r in lost), c))
        out += [(*line[:-1], share[line[-1]]) for line in lines]
    return sorted(out)


def test_audit_equals_running_every_order(spark):
    rng = random.Random(9)
    texts = [None, "", "a " * 250, " ".join(f"w{k}" for k in range(220)), "SHOUT " * 210, "x|y " * 3, " ".join(f"Z{k} é" for k in range(300)), "😀" * 50 + " A", " ".join("ab") + "\x0b#"]
    docs = [(rng.choice([*range(40), None]), rng.choice(texts), rng.choice(["s", "t", "", None])) for _ in range(150)]
    docs += [(7, "copy", "s"), (7, "copy", "s"), (7, "copy", "t"), (9, "copy", "t"), (None, "copy", "s"), (500, "alone", "u")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(30), *range(5), None, 500]]
    d = spark.createDataFrame([(i, t, s, 1, 2, 3, 4) for i, t, s in docs], "doc_id long, text string, source string, A int, n int, part int, quality int")
    m = spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int, source int")
    got = audit_documents(d.repartition(4), m)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == _audit(docs, labels)
    assert audit_documents(d.limit(0), m).count() == 0 and audit_documents(d, m.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_two_filters_with_null_conditions(spark):
    df = spark.createDataFrame([(None, 5), (1, 1), (3, None), (3, 9)], "a int, b int")
    got = audit_filters(df, {"X": F.col("a") > 2, "Y": F.col("b") > 4}, F.lit("p"), F.col("a") == 3, F.lit(None).cast("boolean"))
    rows = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got.collect()}
    assert rows == {("XY", 1): (2, 2, 0, 1, 2, 0, 3), ("XY", 2): (1, 1, 1, 1, 0, 0, 3), ("YX", 1): (2, 2, 0, 1, 1, 0, 3), ("YX", 2): (1, 1, 1, 1, 1, 0, 3)}


def test_word_bags_and_means_by_hand():
    words = ["idiot", "é", "日本語x", "a"]
    rows, owner = word_grams(words)
    for k, w in enumerate(words):
        alone, _ = word_grams([w])
        assert sorted(rows[owner == k]) == sorted(alone)
        marked = f"<{w}>"
        assert len(alone) == 1 + sum(max(len(marked) - n + 1, 0) for n in toxicity.GRAMS)
    assert set(word_grams(["idiots"])[0]) & set(word_grams(["idiot"])[0])
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.standard_normal((toxicity.BUCKETS, 4)).astype(np.float32), rng.standard_normal((4, 2)), np.array([0.1, -0.2]), 0.7, 0.3)
    texts = ["Idiot, a É é!", "", None, "日本語x a " * 500]
    got = model.score(pa.array(texts))
    for text, p in zip(texts, got, strict=True):
        seen = re.findall(r"[^\W_]+", (text or "").lower())
        vectors = [model.table[word_grams([w])[0]].astype(float).mean(0) for w in seen]
        mean = np.sum(vectors, 0) / (len(seen) + toxicity.PSEUDO) if seen else np.zeros(4)
        z = (mean @ model.weights + model.bias) @ [-1, 1]
        assert p == pytest.approx(1 / (1 + math.exp(-(0.7 * z + 0.3))), rel=1e-5)
    bags = list(toxicity.bags(pa.array(texts)))
    for (r, w), vector in zip(bags, model.text_vectors(pa.array(texts)), strict=True):
        assert w @ model.table[r].astype(float) == pytest.approx(vector, rel=1e-4, abs=1e-7)


def test_toxicity_finds_held_out_documents_and_misspellings(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit_toxicity(docs, labels, ~held)
    got = score_toxicity(docs.where(held).select("doc_id", "text"), model).join(labels, "doc_id").where("quality = 1").select("toxic", "__score").toPandas()
    called, toxic = got["__score"] >= 0.3, got["toxic"] == 1
    assert called[toxic].mean() > 0.85 and called[~toxic].mean() < 0.01
    plain = "the tion and of anre thin erer ouhe " * 4
    rows = [(1, plain + "such a window, window"), (2, plain + "such idiotts and morron"), (3, None), (4, ""), (5, "!!"), (6, "the " * 200000), (6, "x")]
    odd = score_toxicity(spark.createDataFrame(rows, "score int, text string"), model).collect()
    found = {r["score"]: r["__score"] for r in odd}
    assert len(odd) == 7 and all(0 <= r["__score"] <= 1 for r in odd) and found[3] == found[4] == found[5] and found[2] > 2 * found[1]
    assert fit_toxicity(docs, labels.limit(0), F.lit(True)) is None
    assert score_toxicity(docs.limit(3), None).where("__score = 0.5").count() == 3 and score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_fit_of_repeated_ids_and_few_rows(spark):
    rows = [(1, "good day"), (1, "a good day"), (2, "vile scum"), (3, None), (None, "vile"), (4, "fine " * 9000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 1), (None, 0), (4, 0), (9, 1), (5, None)], "doc_id long, toxic int")
    one, two = (fit_toxicity(d, labels, F.lit(True)) for d in (docs, docs.repartition(3)))
    assert np.array_equal(one.table, two.table) and one.offset == two.offset
    assert fit_toxicity(docs, labels.where("toxic = 1"), F.lit(True)) is None
