"""Near copies, repeated bytes and vectors, each against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm.ngram_join import Trie, link_documents
from threadloom.llm.suffix_dedup import drop_repeats, merged
from threadloom.llm.topk import top_inner
from threadloom.llm.vector_dedup import near_vectors


def roots_of(nodes, edges):
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingles(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def family(seed=1, n=220):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    out = []
    bases = [rng.choices(words, k=rng.randint(20, 120)) for _ in range(6)]
    for i in range(n):
        kind = i % 5
        if kind < 3:
            t = list(bases[i % len(bases)])
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
        elif kind == 3:
            t = passage + rng.choices(words, k=rng.randint(0, 30))
        else:
            t = rng.choices(words, k=rng.randint(1, 40))
        out.append((i, " ".join(t).upper() if i % 7 == 0 else " ".join(t)))
    out += [(900, "a b c"), (901, "A  b\tc"), (902, None), (903, ""), (904, " \n"), (905, "a b c d"), (906, "a\u00a0b c"), (20, out[20][1])]
    return out


@pytest.mark.parametrize("chunk", [512, 7])
def test_ngram_links_match_brute_force(spark, chunk):
    rows = family()
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, n int, keys string").repartition(6)
    got = link_documents(df, chunk=chunk).collect()
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots_of(ids, edges)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), root[i]) for i in ids}
    assert len(set(root.values())) < len(ids) - 20


def test_ngram_links_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in link_documents(df).collect())
    assert got == [(-1, 2, -1), (-1, 2, -1), (2, 2, 2), (3, 2, 2)]
    assert link_documents(df.limit(0)).count() == 0


def test_trie_join_against_pairs():
    rng = np.random.default_rng(4)
    base = np.sort(rng.choice(200, 40, replace=False))
    seqs = [np.unique(np.concatenate([rng.choice(base, 36, replace=False), rng.choice(400, 3)])) for _ in range(60)]
    sizes = np.array([len(s) + int(rng.integers(0, 3)) for s in seqs])
    q, s = Trie(seqs, sizes).join(seqs, sizes, 75)
    want = {(a, b) for a in range(60) for b in range(60) if 175 * len(np.intersect1d(seqs[a], seqs[b])) >= 75 * (sizes[a] + sizes[b])}
    assert set(zip(q.tolist(), s.tolist(), strict=True)) == want and len(want) > 60


def repeats_by_hand(rows, length):
    seen, out = {}, {}
    for i in sorted({i for i, _ in rows if i is not None}):
        b = next((t or "").encode() for j, t in rows if j == i)
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                mark[p : p + length] = b"\1" * length
            else:
                seen[w] = (i, p)
        out[i] = (len(b), sum(mark), len(re.findall(rb"\x01+", bytes(mark))), bytes(c for c, m in zip(b, mark, strict=True) if not m))
    return out


def test_repeats_match_brute_force(spark):
    rng = random.Random(3)
    letters = "abcdefghij éü"
    passages = ["".join(rng.choices(letters, k=rng.randint(100, 260))) for _ in range(5)]
    rows = []
    for i in range(120):
        t = "".join(rng.choices(letters, k=rng.randint(0, 300)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(60)
            t += p[a : a + rng.randint(90, 200)] + "".join(rng.choices(letters, k=rng.randint(0, 50)))
        rows.append((i, t))
    rows += [(500, "ab" * 400), (501, "ab" * 300), (502, "z" * 99), (503, "z" * 100), (504, "z" * 101), (505, None), (506, ""), (507, rows[3][1]), (508, rows[3][1])]
    df = spark.createDataFrame([(*r, b"x", 1) for r in [*rows, (None, "q" * 300), (7, rows[7][1])]], "doc_id long, text string, data binary, s int").repartition(5)
    got = drop_repeats(df).collect()
    want = repeats_by_hand(rows, 100)
    assert len(got) == len(rows) + 2
    for r in got:
        mine = (300, 0, 0, b"q" * 300) if r.doc_id is None else want[r.doc_id]
        assert (r["__n_bytes"], r["__n_removed"], r["__n_spans"], bytes(r["__kept"])) == mine
    assert sum(v[1] for v in want.values()) > 3000
    assert drop_repeats(df.limit(0)).count() == 0


def test_repeats_of_large_anchor_groups():
    from threadloom.llm import suffix_dedup as S

    rng = random.Random(8)
    core = "".join(rng.choices("abcdefgh", k=104))
    rows = [(i, "".join(rng.choices("abcdefgh", k=40)) + core + "".join(rng.choices("abcdefgh", k=40))) for i in range(60)]
    part = S.pd.DataFrame({"h": [1] * 60, "doc_id": [i for i, _ in rows], "s": [0] * 60, "data": [t.encode() for _, t in rows]})
    whole = S._compare([part], 100)
    cut = S.pd.concat(list(S._by_window(part, 100, 5)))
    spread = lambda x: sorted((d, s + k) for d, s, n in zip(x["doc_id"], x["s"], x["n"], strict=True) for k in range(n))
    assert spread(whole) == spread(cut) and set(spread(cut)) >= {(i, 40 + k) for i in range(1, 60) for k in range(5)}


def test_long_texts_are_cut_into_stretches():
    from threadloom.llm import suffix_dedup as S

    rng = random.Random(6)
    text = "".join(rng.choices("abcd", k=5000)).encode()
    windows = [(at + k, part[k : k + 100]) for at, part in S.stretches(text, 100, 700) for k in range(len(part) - 99)]
    assert windows == [(k, text[k : k + 100]) for k in range(4901)]
    assert list(S.stretches(b"short", 100, 700)) == [(0, b"short")] and list(S.stretches(b"", 100, 700)) == [(0, b"")]
    runs = S.runs_of([p for _, p in S.stretches(text, 100, 700)], np.full(8, 3), np.arange(0, 4901, 700))
    assert sorted(s + k for s, n in zip(runs["s"].tolist(), runs["n"].tolist(), strict=True) for k in range(n)) == list(range(4901))


def test_merged_intervals():
    s, e = merged(np.array([5, 0, 10, 30]), np.array([10, 3, 12, 31]))
    assert s.tolist() == [0, 5, 30] and e.tolist() == [3, 12, 31]


def vectors(seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    centres = rng.standard_normal((4, 16))
    for i in range(160):
        v = centres[i % 4] + rng.standard_normal(16) * (0.05 if i % 3 else 1)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 3))
    rows += [(200, rows[1][1], 1), (201, [2 * x for x in rows[1][1]], 1), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] * 16, 1), (205, rows[1][1], None), (206, [None] * 16, 1)]
    rows += [(207, rows[1][1][:8], 1), (208, rows[1][1][:8], 1), (209, [], 1), (210, [float("inf")] + [1.0] * 15, 1), (1, rows[1][1], 1)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, cnt int, unit string"


def test_near_vectors_match_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "u") for r in rows], SCHEMA).repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    good = {i: (np.array(v), g) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    cos = lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) if len(a) == len(b) else 0
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if good[a][1] == good[b][1] and cos(good[a][0], good[b][0]) >= 0.98]
    every = sorted({i for i, _, _ in rows})
    root = roots_of(every, edges)
    links = {i: sum(i in e for e in edges) for i in every}
    assert got == {i: (links[i], root[i], root[i] == i) for i in every} and len(edges) > 50
    assert near_vectors(df.limit(0)).count() == 0


def test_top_inner_matches_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "u") for r in rows], SCHEMA).repartition(4)
    ints = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()}
    want = {}
    for q in ints:
        if q % 9 == 0 or q == 207:
            scored = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))
            want |= {(q, r + 1): (c, -s) for r, (s, c) in enumerate(scored[:5])}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_inner(df, 5, (F.col("vec_id") % 9 == 0) | (F.col("vec_id") == 207), pivots=5).collect()}
    assert got == want and sum(q == 207 for q, _ in got) == 1
    assert top_inner(df.limit(0), 5, F.col("vec_id") % 9 == 0).count() == 0


def test_repeats_with_clashing_columns_and_a_batch_size_with_unit(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        line = "one passage that is well over one hundred bytes long and that is found in both of the documents of this test, word for word. "
        names = "gone windows __id id x0 x1 c0 s n".split()
        df = spark.createDataFrame([(1, line, *range(9)), (2, "x" + line, *range(9))], ["doc_id", "text", *names])
        got = {r["doc_id"]: r for r in drop_repeats(df).collect()}
        assert got[1]["__n_removed"] == 0 and got[2]["__n_removed"] == len(line) and [got[2][c] for c in names] == list(range(9))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
