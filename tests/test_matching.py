"""Matching, components and box walks against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions.matching import match_best_first, overlap_pairs
from threadloom.operators import documents, evaluation, relations

BOXES = "page int, uid string, text string, x0 double, y0 double, x1 double, y1 double"


def random_boxes(rng, n, tag):
    out = []
    for i in range(n):
        x, y = rng.uniform(0, 120), rng.uniform(0, 60)
        out.append((rng.randrange(3), f"{tag}{i}", "w" * rng.randrange(1, 6), x, y, x + rng.uniform(8, 30), y + rng.uniform(5, 12)))
    return out


def iou(a, b):
    w = min(a[5], b[5]) - max(a[3], b[3])
    h = min(a[6], b[6]) - max(a[4], b[4])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[5] - r[3]) * (r[6] - r[4])
    return w * h / (area(a) + area(b) - w * h)


def greedy(a, b, least):
    pairs = sorted(((-iou(x, y), x[1], y[1]) for x in a for y in b if x[0] == y[0] and iou(x, y) >= least))
    used, out = set(), set()
    for _, x, y in pairs:
        if x not in used and y not in used:
            used |= {x, y}
            out.add((x, y))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_match_equals_greedy(spark, seed):
    rng = random.Random(seed)
    a, b = random_boxes(rng, 60, "a"), random_boxes(rng, 60, "b")
    pairs = overlap_pairs(spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES), 20.0, 8.0)
    assert pairs.count() == sum(iou(x, y) > 0 for x in a for y in b if x[0] == y[0])
    got = {(r["a"], r["b"]) for r in match_best_first(pairs.where("iou >= 0.1")).collect()}
    assert got == greedy(a, b, 0.1)


def test_box_dedupe(spark):
    rng = random.Random(5)
    words = random_boxes(rng, 80, "w")
    kept = []
    for word in sorted(words, key=lambda r: (-len(r[2]), r[1])):
        if all(k[0] != word[0] or iou(k, word) < 0.3 for k in kept):
            kept.append(word)
    got = documents.box_dedupe(spark.createDataFrame(words, BOXES), 20.0, 8.0)
    assert {r["uid"] for r in got.collect()} == {k[1] for k in kept}


def test_detection_counts(spark):
    rng = random.Random(9)
    a, b = random_boxes(rng, 40, "a"), random_boxes(rng, 40, "b")
    row = evaluation.detection_f1(spark.createDataFrame(b, BOXES), spark.createDataFrame(a, BOXES), 20.0, 8.0, 0.2).first()
    assert row["tp"] == len(greedy(a, b, 0.2)) and row["pred_n"] == 40 and row["truth_n"] == 40


def test_components(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(60)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["uid"]: r["component"] for r in relations.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}


def test_mirror_cycles(spark):
    follows = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "g")]
    got = {r["board"]: (r["verdict"], r["hops"]) for r in relations.mirror_cycles(spark.createDataFrame(follows, "board string, follows string")).collect()}
    assert got == {"a": ("cycle", 3), "b": ("cycle", 3), "c": ("cycle", 3), "e": ("self", 0)}


def test_refused_boards(spark):
    cards = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 1), (2, 2)], "board int, uid int")
    names = cards.selectExpr("board", "uid", "'x' AS name")
    none = spark.createDataFrame([], "board int, a int, b int")
    got = relations.suggest_pairs(cards, names, none, none, limit=4).collect()
    assert [(r["board"], r["a"], r["b"]) for r in got] == [(2, 1, 2)]
    assert [r["board"] for r in relations.too_many(cards, 4).collect()] == [1]


def test_text_distance_equals_the_table():
    import random

    from threadloom.operators.evaluation import text_distance

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(400):
        a = "".join(rng.choices("abé", k=rng.randrange(90)))
        b = "".join(rng.choices("abcé", k=rng.randrange(90))) if rng.random() < 0.5 else "".join(c for c in a if rng.random() > 0.1)
        assert text_distance(a, b) == table(a, b), (a, b)
    assert text_distance("x" * 100_000, "x" * 40_000 + "y" + "x" * 60_000) == 1


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_similar_sets_equal_all_pairs(spark, least):
    import random

    from threadloom.functions.matching import similar_sets

    rng = random.Random(7)
    # the item 0 is in every set
    rows = {side: [(rng.choice("pq"), i, sorted({0, *rng.choices(range(1, 9), k=rng.randrange(0, 6))})) for i in range(70)] + [("p", 100, []), ("p", 101, [0])] for side in "ab"}
    a, b = (spark.createDataFrame(rows[s], "page string, uid int, items array<int>") for s in "ab")
    got = sorted((r["page"], r["a"], r["b"], r["inter"]) for r in similar_sets(a, b, ["page"], least).collect())
    want = [(p, i, j, len(set(x) & set(y))) for p, i, x in rows["a"] for q, j, y in rows["b"] if p == q and set(x) & set(y) and len(set(x) & set(y)) >= least * len(set(x) | set(y)) - 1e-9]
    assert got == sorted(want)


def test_captions_and_bullets(spark):
    from threadloom.operators import documents

    yes = ["Tabelle 3: x", "Abb. 2", "Abbildungen 4", "Tafel 1", "Fig 3a.", "table 1", "Taf. 9 x"]
    no = ["Tabel 3", "Table", "Figur 2", "see Fig. 3"]
    got = spark.createDataFrame([(t,) for t in yes + no], "t string").select(F.col("t").rlike(documents.CAPTION)).collect()
    assert [r[0] for r in got] == [True] * len(yes) + [False] * len(no)
    marks = ["• x", "◦ x", "– x", "· x", "(12) x", "b) x", "iv. x", "-x", "A. x", "1234. x", "• "]
    got = spark.createDataFrame([(t,) for t in marks], "t string").select(F.regexp_extract("t", documents.BULLET, 1)).collect()
    assert [r[0] for r in got] == ["•", "◦", "–", "·", "(12)", "b)", "iv.", "", "", "", ""]


def test_pairs_hold_what_is_carried(spark):
    rng = random.Random(4)
    a = spark.createDataFrame(random_boxes(rng, 40, "a"), BOXES)
    pairs = overlap_pairs(a, a, 3.0, 2.0, ["text"])
    texts = {r["uid"]: r["text"] for r in a.collect()}
    got = pairs.collect()
    assert got and all(r["a_text"] == texts[r["a"]] and r["b_text"] == texts[r["b"]] for r in got)


def test_boxes_are_shuffled_once_or_twice(spark):
    """Cells of the size of a box: it touches four, but most boxes lie in one tile."""
    boxes = [(1, f"w{i}", "w", 7.0 * i + 0.5, 3.0, 7.0 * i + 20.5, 11.0) for i in range(200)]
    frame = spark.createDataFrame(boxes, BOXES)
    plan = overlap_pairs(frame, frame, 20.0, 8.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "/ 80.0" in plan and "/ 32.0" in plan


def test_dedupe_rounds_hold_only_pairs(spark, monkeypatch):
    """Words without a better rival are not written again each round."""
    alone = [(1, f"a{i}", "w", 1000.0 * i, 0.0, 1000.0 * i + 10, 10.0) for i in range(50)]
    chain = [(2, f"c{i}", "w" * (9 - i), 3.0 * i, 0.0, 3.0 * i + 10, 10.0) for i in range(8)]
    written = []
    cut = documents.cut_lineage
    monkeypatch.setattr(documents, "cut_lineage", lambda df: written.append(out := cut(df)) or out)
    got = documents.box_dedupe(spark.createDataFrame(alone + chain, BOXES), 20.0, 8.0)
    assert {r["uid"] for r in got.collect()} == {f"a{i}" for i in range(50)} | {"c0", "c2", "c4", "c6"}
    assert sum(df.where("page = 1").count() for df in written) == 0


def test_matching_writes_pairs_in_doubt_only(spark, monkeypatch):
    """What the first round settles at either end is written once."""
    from threadloom.functions import matching

    written = []
    cut = matching.cut_lineage
    monkeypatch.setattr(matching, "cut_lineage", lambda df: written.append(out := cut(df)) or out)
    pairs = [(1, f"a{i}", f"b{j}", 1.0 / (1 + abs(i - j)), 0.0) for i in range(20) for j in range(20)]
    got = match_best_first(spark.createDataFrame(pairs, "page int, a string, b string, iou double, inter double"))
    assert {(r["a"], r["b"]) for r in got.collect()} == {(f"a{i}", f"b{i}") for i in range(20)}
    assert sum(df.count() for df in written) == 20


def test_matching_keeps_columns(spark):
    pairs = spark.createDataFrame([(1, "a", "x", 0.9, True), (1, "a", "y", 0.8, False), (1, "b", "x", 0.7, False), (1, "b", "y", 0.6, True)], "page int, a string, b string, iou double, mark boolean")
    got = match_best_first(pairs, keep=["mark"])
    assert {(r["a"], r["b"], r["mark"]) for r in got.collect()} == {("a", "x", True), ("b", "y", True)}


def test_references_are_grouped_by_sorting(spark):
    rows = [("t1", f"b{i % 7}", "p1") for i in range(30)] + [("t1", "b9", "p2"), ("t1", "t1", "p2"), ("t2", "b1", "t2"), ("t2", "b3", "p1"), ("t2", None, "p1"), (None, "b1", "p1"), ("t2", "b1", None)]
    refs = spark.createDataFrame(rows, "target string, uid string, page string")
    out = relations.group_linked_refs(refs)
    want = {}
    for t, u, p in rows:
        if None not in (t, u, p) and t not in (u, p):
            want.setdefault((t, p), set()).add(u)
    assert sorted(map(tuple, out.collect())) == sorted((t, p, len(us), min(us)) for (t, p), us in want.items())
    once = relations.linked_refs(refs)
    assert once.columns == ["target", "uid", "page"]
    assert sorted(map(tuple, once.collect())) == sorted((t, u, p) for (t, p), us in want.items() for u in us)
    assert all("HashAggregate" not in df._jdf.queryExecution().toString() for df in (out, once))


def far_boxes(spark):
    """Boxes of 60 by 40 in one tile, two of them 50 and 96 apart: their union would come out as zero."""
    corners = {"a": (10.0, 10.0), "b": (120.0, 146.0), "c": (12.0, 11.0)}
    return spark.createDataFrame([(1, u, "w", x, y, x + 60, y + 40) for u, (x, y) in corners.items()], BOXES)


def test_box_dedupe_of_boxes_apart_both_ways(spark):
    got = documents.box_dedupe(far_boxes(spark), 60.0, 40.0)
    assert {r["uid"] for r in got.collect()} == {"a", "b"}


def test_word_agreement_of_boxes_apart_both_ways(spark):
    boxes = far_boxes(spark)
    got = evaluation.word_agreement(boxes, boxes, 60.0, 40.0).collect()
    assert [(r["page"], r["a_n"], r["b_n"], r["matched"]) for r in got] == [(1, 3, 3, 3)]


def test_groups_of_references_are_whole_and_biggest_first(spark):
    rows = [("t1", f"b{i % 7}", "p1") for i in range(30)] + [("t1", f"c{i}", "p0") for i in range(7)] + [("t1", "t1", "p2"), ("t1", "bad))", "p2"), ("t1", "on", "p3"), ("t1", "d", "p3"), ("t2", "b1", "t2"), ("t2", "b3", "p1"), ("t2", None, "p1"), ("t3", "on", "p1")]
    skip = spark.createDataFrame([("on",)], "uid string")
    out = relations.group_linked_refs(spark.createDataFrame(rows, "target string, uid string, page string"), skip, whole=True)
    assert sorted((r["target"], r["pos"], r["page"], r["n"], r["first_uid"], r["uids"]) for r in out.collect()) == [
        ("t1", 1, "p0", 7, "c0", [f"c{i}" for i in range(7)]), ("t1", 2, "p1", 7, "b0", [f"b{i}" for i in range(7)]), ("t1", 3, "p3", 1, "d", ["d"]), ("t2", 1, "p1", 1, "b3", ["b3"]),
    ]


def test_ocr_vote_in_a_row_and_on_tiles(spark, monkeypatch):
    """Small pages are matched in their row, without a window or a checkpoint; the result is that of the rounds over tiles."""
    rng = random.Random(11)
    names = ["house", "hquse", "tree", "garden", "7", ""]
    side = lambda n, tag: [(p if p < 3 else None, u, rng.choice(names), rng.choice([0.4, 0.9, None]), *box) for p, u, _, *box in random_boxes(rng, n, tag)] + [(9, f"{tag}z", "tree", 0.9, 0.0, 0.0, 10.0, 10.0), (None, f"{tag}n", "tree", 0.9, 0.0, 0.0, 10.0, 10.0), (5 if tag == "a" else 6, f"{tag}o", "tree", 0.9, 0.0, 0.0, 10.0, 10.0)]
    kind = "page int, uid string, text string, conf double, x0 double, y0 double, x1 double, y1 double"
    a, b = side(60, "a"), side(60, "b")
    b += [(0, "b1", "tree", 0.9, *b[1][4:])]
    sides = [spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)]
    lex = spark.createDataFrame([(w,) for w in ("house", "tree", "garden")], "word string")
    vote = lambda: documents.ocr_vote(*sides, lex, 20.0, 8.0)
    in_row = vote()
    plan = in_row._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join FullOuter") == 1
    got = sorted(map(tuple, in_row.collect()), key=str)
    for bound in (0, 45):  # all pages on tiles, then some
        monkeypatch.setattr(documents, "ROW_PAGE", bound)
        assert sorted(map(tuple, vote().collect()), key=str) == got
    assert {r[3] for r in got} == {"matched", "alone", "added"}
