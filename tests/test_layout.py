"""Paragraphs, neighbourhoods and arrows from outside against plain loops."""

from __future__ import annotations

import random
import re
from statistics import median

import pytest
from pyspark.sql import functions as F

from threadloom.operators import documents, filters, relations, search
from threadloom.plans.documents import trimmed

LINES = "doc int, page int, pos int, text string, x0 double, text_x0 double, base double, size double, bold boolean, chars int"


def plain_paragraphs(page, body):
    """The groups of one page, line by line."""
    gaps = [b["base"] - a["base"] for a, b in zip(page, page[1:])]
    usual = [g for g in gaps if 0 < g < 3 * body]
    usual = median(usual) if usual else body * 1.3
    groups = []
    for line in page:
        cur = groups[-1] if groups else None
        if cur:
            prev, first = cur[-1], cur[0]
            gap, size = line["base"] - prev["base"], max(line["size"], prev["size"])
            near = lambda edge, line=line, size=size: abs(line["x0"] - edge) <= 1.5 * size
            step = line["x0"] - (first["text_x0"] if len(cur) == 1 else prev["x0"])
            apart = gap > 1.7 * size or abs(prev["size"] - line["size"]) > 0.6 or (prev["bold"] != line["bold"] and max(prev["chars"], line["chars"]) > 20)
            second = len(cur) == 1 and 0.8 * size < prev["x0"] - line["x0"] < 4 * size
            in_line = near(first["x0"]) or near(first["text_x0"]) or near(prev["x0"]) or second
            wide = re.search(r"[.?!:]$", prev["text"]) and re.match('[A-Z("\u201c]', line["text"]) and gap > 1.25 * usual
            indented = re.search(r"[.?!]$", prev["text"]) and 0.8 * size < step < 4 * size
            if not apart and in_line and not wide and not indented:
                cur.append(line)
                continue
        groups.append([line])
    return groups


def folded(spark, rows):
    lines = spark.createDataFrame(rows, LINES)
    body = spark.createDataFrame([(d, 10.0) for d in {r["doc"] for r in rows}], "doc int, body_size double")
    return sorted((r["doc"], r["page"], r["first_pos"], r["lines"], r["text"]) for r in documents.paragraphs(lines, body).collect())


def line(pos, x0, text="running text", doc=1, page=0, base=None, text_x0=None, size=10.0, bold=False, chars=40):
    return dict(doc=doc, page=page, pos=pos, text=text, x0=x0, text_x0=text_x0, base=pos * 12.0 if base is None else base, size=size, bold=bold, chars=chars)


@pytest.mark.parametrize(
    "edges, sizes",
    [
        ([100.0, 72.0, 100.0, 72.0], [3, 1]),  # an indented start and back to its edge; the second line sets none
        ([72.0, 100.0, 100.0], [1, 2]),  # a hanging line is not flush with anything
        ([72.0, 86.0, 100.0, 86.0], [4]),  # a slow drift stays flush with the line before
        ([72.0, 86.0, 100.0, 72.0], [4]),  # and returns to the first edge
        ([72.0, 86.0, 100.0, 58.0], [4]),  # within reach of the first edge alone
        ([72.0, 86.0, 100.0, 50.0], [3, 1]),  # an outdent counts on the second line only
        ([None, 72.0, None], [3]),
    ],
)
def test_first_left_edge_of_a_paragraph(spark, edges, sizes):
    assert [r[3] for r in folded(spark, [line(i, x) for i, x in enumerate(edges)])] == sizes


def test_paragraphs_equal_a_plain_loop(spark):
    rng, rows = random.Random(5), []
    for doc in range(6):
        for page in range(5):
            base = 0.0
            for pos in range(rng.choice([1, 2, 30])):
                base += rng.choice([12.0, 12.0, 12.0, 12.5, 16.0, 20.0])
                x0 = 72 + 9.0 * rng.randrange(5)
                text = rng.choice(["words", "Words", '"Said', "end.", "End:", "What?", ""])
                rows.append(line(pos, x0, text, doc, page, base, rng.choice([x0, x0 + 9, x0 + 20]), rng.choice([10.0] * 8 + [10.5, 11.0]), rng.random() < 0.1, rng.choice([5, 40])))
    want = []
    for doc, page in {(r["doc"], r["page"]) for r in rows}:
        for g in plain_paragraphs([r for r in rows if (r["doc"], r["page"]) == (doc, page)], 10.0):
            want.append((doc, page, g[0]["pos"], len(g), " ".join(r["text"] for r in g)))
    assert folded(spark, rows) == sorted(want)
    assert folded(spark, [{**r, "text_x0": None} for r in rows]) != sorted(want)
    assert documents.paragraphs(spark.createDataFrame([], LINES), spark.createDataFrame([], "doc int, body_size double")).count() == 0


def test_neighbourhood_equals_all_pairs(spark):
    rng = random.Random(3)
    boxes = [(b, f"{b}u{i}", rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.0, 2.0, 40.0]), rng.choice([0.0, 3.0, 30.0])) for b in "ab" for i in range(80)]
    boxes += [("a", "corner", 0.0, 0.0, 10.0, 10.0), ("a", "edge", 10.0, 10.0, 0.0, 0.0), ("a", "nowhere", None, None, None, None)]
    items = spark.createDataFrame(boxes, "board string, uid string, x double, y double, w double, h double")
    marks = items.where("uid LIKE '%u1%' OR uid IN ('corner', 'nowhere')")
    want = set()
    for board, uid, x, y, w, h in boxes:
        if "u1" not in uid and uid not in ("corner", "nowhere"):
            continue
        for other, name, ox, oy, ow, oh in boxes:
            if name == uid or (other == board and None not in (x, ox) and abs(ox + ow / 2 - x - w / 2) <= max(w, 10) / 2 and abs(oy + oh / 2 - y - h / 2) <= max(h, 8) / 2):
                want.add((board, uid, name))
    got = [tuple(r) for r in filters.neighbourhood_members(items, marks, 10.0, 8.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("a", "corner", "edge") in want


def test_arrows_from_outside(spark):
    closure = spark.createDataFrame(
        [("top", "inner", 1), ("top", "far", 1), ("inner", "x", 1), ("top", "x", 2), ("inner", "s", 1), ("far", "y", 1), ("top", "y", 2), ("text", "loose", 1), ("top", "direct", 1)],
        "anc string, desc string, depth int",
    )
    boards = spark.createDataFrame([("top",), ("inner",), ("far",)], "uid string")
    items = spark.createDataFrame([("inner", "x", "card"), ("inner", "x2", None), ("inner", "s", "section"), ("far", "y", "card"), ("top", "inner", "board")], "board string, uid string, type string")
    edges = spark.createDataFrame(
        [
            ("top", "e1", "x", "y"),  # both ends lie on nested boards: one row each
            ("top", "e1", "x", "y"),
            ("inner", "e2", "x", "y"),  # own edge of inner, an outside one of far
            ("top", "e3", "x", "x2"),  # other end on the board too
            ("top", "e4", "s", "direct"),  # a section is no card
            ("top", "e5", "loose", "x"),  # outside every board
            ("top", "e6", "direct", "x2"),
            (None, "e7", "direct", "y"),
            ("far", "e8", "inner", "y"),  # top is not nested
            ("top", "e9", "x", None),
            ("top", "e10", "x", "x"),
        ],
        "board string, edge string, from string, to string",
    )
    got = sorted(tuple(r) for r in relations.arrows_from_outside(items, edges, boards, closure).select("board", "card", "edge", "other", "place").collect())
    assert got == [("far", "y", "e1", "x", "inner"), ("far", "y", "e2", "x", "inner"), ("far", "y", "e7", "direct", "top"), ("inner", "x", "e1", "y", "far"), ("inner", "x2", "e6", "direct", "top")]


def test_page_title_stacks_lines_and_reads_the_second_page(spark):
    def line(doc, page, pos, text, base, size, bold=False, x0=50.0, x1=300.0):
        return (doc, page, pos, text, float(base), float(size), bold, x0, x1)

    rows = [
        line(1, 0, 0, "COVER", 50, 30), line(1, 0, 1, "plain body text of the cover", 100, 10), line(1, 1, 0, "A Title On Page", 60, 18), line(1, 1, 1, "Two Goes On", 80, 18), line(1, 1, 2, "body text in its own size", 120, 10),
        line(2, 0, 0, "running header of it", 20, 20), line(2, 0, 1, "Bold Heading of Body Size", 60, 10, True), line(2, 1, 0, "Larger Type On Page Two", 60, 24),
        line(3, 0, 0, "( 54 ) Patent Title Here", 60, 16), line(3, 0, 1, "with a smaller wrap", 74, 13.5), line(3, 0, 2, "to the right of it", 86, 13.5, x0=400.0, x1=500.0),
        line(4, 0, 0, "two words", 60, 16), line(4, 2, 0, "Title on page three only", 60, 16), line(5, 0, 0, "123456 7890 ab no", 60, 16), line(5, 0, 1, "Same Size Is Lower", 300, 16), line(5, 0, 2, "Same Size Bold Wins", 400, 16, True),
        *[line(6, 0, i, f"row {i}", 60 + 20 * i, 16) for i in range(8)],
    ]
    lines = spark.createDataFrame(rows, "doc int, page int, pos int, text string, base double, size double, bold boolean, x0 double, x1 double")
    furniture = spark.createDataFrame([(2, 0, 0)], "doc int, page int, pos int")
    got = {r.doc: (r.page, r.title) for r in documents.page_title(lines, furniture).collect()}
    assert got == {
        1: (1, "A Title On Page Two Goes On"), 2: (0, "Bold Heading of Body Size"), 3: (0, "Patent Title Here with a smaller wrap"),
        5: (0, "Same Size Bold Wins"), 6: (0, "row 0 row 1 row 2 row 3 row 4 row 5"),
    }


def test_container_of_equal_boxes(spark):
    """Copies of a box meet the points once, count each, and are never sent whole to the driver."""
    rng = random.Random(8)
    boxes = [(i, *rng.choice([(0.0, 0.0, 9.0, 9.0), (1.0, 1.0, 5.0, 5.0), (2.0, 2.0, 6.0, 6.0), (4.0, 0.0, 12.0, 3.0)])) for i in range(60)]
    points = [(f"p{i}", float(rng.randrange(12)), float(rng.randrange(12))) for i in range(40)]
    out = filters.container_of(spark.createDataFrame(points, "uid string, x double, y double"), spark.createDataFrame(boxes, "box int, x0 double, y0 double, x1 double, y1 double"), 2.0, 2.0)
    want = {}
    for uid, x, y in points:
        inside = [((x1 - x0) * (y1 - y0), b) for b, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1]
        if inside:
            want[uid] = (min(inside)[1], len(inside))
    assert {r["uid"]: (r["box"], r["n_boxes"]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("copies") > 0


def test_contents_rows_read_the_cells_once(spark):
    data = [
        (1, 0, 0, "Intro"), (1, 0, 1, "l2 .."), (1, 1, 0, "End"), (1, 1, 1, "none"), (2, 0, 0, "a"), (2, 0, 1, "7"),
        (3, 0, 1, "1"), (3, 1, 1, "2"), (3, 1, 2, "3"), (4, 0, 1, " "), (4, 1, 1, None), (5, 0, 1, "x"), (5, 1, 1, "1999"), (5, 2, 1, "y"), (None, 0, 1, "1"), (None, 1, 1, "2"),
    ]
    out = documents.contents_rows(spark.createDataFrame(data, "table_id int, r int, c int, text string"))
    assert sorted(tuple(r) for r in out.select("table_id", "filled", "pages", "contents").collect()) == [(1, 2, 1, True), (5, 3, 1, False)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_arrows_meet_before_they_count_once(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    items = frame([("c1", "o1", "card"), ("c2", "o2", "card")], "board string, uid string, type string")
    edges = frame([(h, "e", "o1", "o2") for h in ("c3", "c3", "c4", None)], "board string, edge string, from string, to string")
    boards = frame([("n0",), ("c1",), ("c2",)], "uid string")
    closure = frame([("n0", "c1", 1), ("n0", "c2", 1), ("c1", "o1", 1), ("c2", "o2", 1)], "anc string, desc string, depth int")
    out = relations.arrows_from_outside(items, edges, boards, closure)
    assert sorted(tuple(r) for r in out.select("board", "card", "edge", "other", "place").collect()) == [("c1", "o1", "e", "o2", "c2"), ("c2", "o2", "e", "o1", "c1")]
    assert not re.search(r"Aggregate \[home", out._jdf.queryExecution().optimizedPlan().toString())


def test_lines_are_trimmed_as_their_words_are(spark):
    lines = ["(a) --b-- c.d, 'e", "...  \u00bfqu\u00e9? x2! \t-y\t", "", "-", " ", "a\r- b- -", "1,5 (2) \u00bd) A\u0301", "--a", "a--", "!a!!b! !"]
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    got = [r.c for r in df.select(F.split(trimmed(F.col("text"), " "), " ").alias("c")).collect()]
    want = [r.c for r in df.select(F.transform(F.split("text", " "), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).alias("c")).collect()]
    assert got == want


def test_words_meet_few_lexicon_rows_without_a_shuffle(spark, monkeypatch):
    rows = [(1, 1, i // 5, w, 0.9) for i, w in enumerate("(Known) known, odDly unknown x 'known' fa1l known zzzz. known known known".split())]
    words = spark.createDataFrame(rows, "doc int, page int, line int, text string, conf double")
    lex = spark.createDataFrame([("known",), ("known",)], "word string")
    none = words.select("doc", "page", "line").limit(0)
    quality, doubt = documents.ocr_page_quality(words, lex), documents.doubtful_lines(words, lex, none)
    spread = [str(df._jdf.queryExecution().optimizedPlan()) for df in (quality, doubt)]
    assert all("broadcast" in p for p in spread)
    few = [sorted(df.collect()) for df in (quality, doubt)]
    assert [tuple(r)[2:7] for r in few[0]] == [(12, 0, 0.9, 11, 7)]
    assert [tuple(r) for r in few[1]] == [(1, 1, 0, 0, 1, 1, 5), (1, 1, 1, 0, 1, 1, 5)]
    monkeypatch.setattr(search, "HANDED_OUT", 0)
    assert [sorted(df.collect()) for df in (documents.ocr_page_quality(words, lex), documents.doubtful_lines(words, lex, none))] == few


def test_connection_index_meets_the_items_once(spark):
    rows = [("e1", "a", "b"), ("e2", "a", "gone"), ("e3", "gone", "b"), ("e4", None, "b"), ("f1", "e1", "a"), ("f2", "b", "e1"), ("f3", "e1", "e1"), ("f4", "e2", "a"), ("f5", "e1", "e2"), ("g1", "f1", "a"), ("g2", "f3", "e1"), ("s", "s", "a"), ("e1", "a", "gone")]
    edges = spark.createDataFrame([(*r, "l") for r in rows], "uid string, from_uid string, to_uid string, label string")
    items = spark.createDataFrame([("a",), ("b",), ("a",)], "uid string")
    plain = {u for u, x, y in rows if x in ("a", "b") and y in ("a", "b")}
    ok = {"a", "b"} | plain
    out = relations.connection_index(edges, items)
    assert sorted((r.uid, r.from_uid or "", r.to_uid, r.label, r.valid) for r in out.collect()) == sorted((u, x or "", y, "l", x in ok and y in ok) for u, x, y in rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan


def test_ocr_vote_meets_both_engines_once(spark):
    word = lambda uid, text, x, conf=0.9, page=1: (page, uid, text, conf, x, 0.0, x + 10.0, 10.0)
    kind = "page int, uid string, text string, conf double, x0 double, y0 double, x1 double, y1 double"
    first = spark.createDataFrame([word("a1", "hquse", 0.0, 0.4), word("a2", "alone", 50.0), word("a3", "tree", 100.0)], kind)
    second = spark.createDataFrame([word("b1", "house", 1.0), word("b2", "garden", 200.0), word("b3", "zzzzz", 300.0), word("b4", "tree", 100.0), word("b5", "tree", 0.0, page=2), word("b6", "cat", 400.0), word("b7", "house", 500.0)], kind)
    lex = spark.createDataFrame([(w,) for w in ("house", "garden", "tree", "cat", "tree")], "word string")
    whole = {(1, "a1", "house", "matched"), (1, "a2", "alone", "alone"), (1, "a3", "tree", "matched")}
    out = documents.ocr_vote(first, second, lex, 20.0, 20.0)
    assert {tuple(r) for r in out.collect()} == whole | {(1, "b2", "garden", "added"), (1, "b7", "house", "added"), (2, "b5", "tree", "added")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("FullOuter") == 1
    assert {tuple(r) for r in documents.ocr_vote(first, second, lex, 20.0, 20.0, insert_cap=1).collect()} == whole | {(1, "b2", "garden", "added"), (2, "b5", "tree", "added")}


def test_table_rows_are_made_without_a_join(spark):
    """Cells meet once; where they are dealt by table already, nothing is shuffled. Spans, holes, overlaps and empty rows included."""
    from threadloom.operators import cells

    made = [(1, 0, 0, 1, 2, "a|b", True), (1, 0, 1, 1, 1, "under", True), (1, 1, 0, 2, 1, "tall", False), (1, 4, 2, 1, 1, "x\ny", False), (2, 0, 1, 1, 1, 'p"q', False), (2, 1, 0, 1, 1, None, False)]
    table = spark.createDataFrame(made, "table_id int, r int, c int, row_span int, col_span int, text string, header boolean").repartition(3, "table_id")
    owner = {}
    for t, r, c, rs, cs, text, header in sorted(made, key=lambda x: x[:3]):
        for i in range(r, r + rs):
            for j in range(c, c + cs):
                owner.setdefault((t, i, j), ("anchor" if (i, j) == (r, c) else "covered", text, header, rs, cs))
    want = {(t, i, j, *owner.get((t, i, j), ("hole", None, False, 1, 1))) for t, rows, cols in ((1, 5, 3), (2, 2, 2)) for i in range(rows) for j in range(cols)}
    grid = cells.table_grid(table)
    assert sorted(map(tuple, grid.collect()), key=str) == sorted(want, key=str)
    lines = cells.markdown_lines(table)
    assert {(r["table_id"], r["r"]): r["line"] for r in lines.collect()} == {
        (1, 0): '<tr><th colspan="2">a|b</th><td></td></tr>', (1, 1): '<tr><td rowspan="2">tall</td><td></td><td></td></tr>', (1, 2): "<tr><td></td><td></td></tr>",
        (1, 3): "<tr><td></td><td></td><td></td></tr>", (1, 4): "<tr><td></td><td></td><td>x\ny</td></tr>", (2, 0): '|  | p"q |', (2, 1): "|  |  |",
    }
    assert {(r["table_id"], r["r"]): r["line"] for r in cells.csv_lines(table).collect()}[(2, 0)] == ',"p""q"'
    for df in (grid, lines, cells.flat_rows(table)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM")
