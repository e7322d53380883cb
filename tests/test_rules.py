"""One row for each branch of the text and number rules, and streams that get their files out of order."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from threadloom.functions.markup import block_shape, library_kind, library_row_kind
from threadloom.operators import cells, documents, evaluation, search
from threadloom.streaming import feeds


def apply(spark, fn, values, schema="text string"):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(fn.alias("x")).collect()]


def test_is_number(spark):
    yes = ["1", " 12.5 ", "1,234", "+3", "-.5", "(12)", "( 1,2 )", "45%", "±3", "1e5", "12 [a]", "12(3)", "50%(2)", "7."]
    no = ["", "abc", "1 2", "1-2", "(12", "12)", "1.2.3", "%", "e5", "[a]", "--1", "1,"]
    assert apply(spark, cells.is_number(F.col("text")), [*yes, *no]) == [True] * len(yes) + [False] * len(no)


def test_repair_number(spark):
    got = apply(spark, cells.repair_number(F.col("text")), ["1.5", "|2|", "5|", "|0", "28. 90", "1 .16", "1 2", "lO.5", "BOB", "D.OD", "see", "--", "***", "NN", ".5", "1,5", "1,500"])
    assert got == ["1.5", "2", "5", "10", "28.90", "1.16", "12", "10.5", None, "0.00", None, "--", "***", "NN", "0.5", "1.5", "1,500"]
    assert apply(spark, cells.repair_number(F.col("text"), F.lit(","), F.lit(False)), ["1.5", ".5", "1,5"]) == ["1,5", ".5", "1,5"]


def test_column_style_decides_the_decimal_mark(spark):
    rows = [("a", i, 0, 1, t) for i, t in enumerate(["1.5", "2.5", "3.25", "1 ,S", "-"])] + [("b", i, 0, 1, t) for i, t in enumerate(["see", "x", "1"])]
    out = cells.numeric_column_repair(spark.createDataFrame(rows, "table_id string, r int, c int, col_span int, text string"))
    assert {(r.table_id, r.r): (r.repaired, r.state) for r in out.collect()} == {
        ("a", 0): ("1.5", "kept"), ("a", 1): ("2.5", "kept"), ("a", 2): ("3.25", "kept"), ("a", 3): ("1.5", "fixed"), ("a", 4): ("—", "kept"),
    }


READINGS = [
    ("word", "", True, False, 0.9, 0.9, "word"), ("Ab c", "abC", False, False, 0.5, 0.9, "Ab c"), ("1.53", "l.53", False, False, 0.5, 0.9, "1.53"),
    ("energy", "39.87", True, False, 0.9, 0.5, "39.87"), ("word", "-", True, False, 0.5, 0.9, "word"), ("-", "word", False, True, 0.9, 0.5, "word"),
    ("cats", "cat", False, True, 0.5, 0.9, "cats"), ("boxes", "box", False, True, 0.5, 0.9, "boxes"), ("as", "a", False, True, 0.5, 0.9, "a"), ("1.53", "153", True, True, 0.5, 0.9, "1.53"), ("-", "*", False, False, 0.5, 0.9, "-"), ("wrod", "word", False, True, 0.9, 0.5, "word"), ("word", "wrod", True, False, 0.5, 0.9, "word"),
    ("form", "from", True, True, 0.9, 0.5, "from"), ("zzab", "zzcd", False, False, 0.9, 0.5, "zzab"), ("zzab", "zzcd", False, False, 0.5, 0.5, "zzcd"),
    ("abcdefgh", "stuvwxyz", False, False, 0.5, 0.9, "abcdefgh"), ("exam", "exam-", True, True, 0.5, 0.5, "exam-"), ("sea-board", "board", False, True, 0.5, 0.9, "sea-board"),
]


def test_choose_reading(spark):
    fn = documents.choose_reading(*[F.col(c) for c in "v o vk ok vc oc".split()])
    got = apply(spark, fn, [r[:6] for r in READINGS], "v string, o string, vk boolean, ok boolean, vc double, oc double")
    assert got == [r[6] for r in READINGS]


def test_norm_text(spark):
    got = apply(spark, evaluation.norm_text(F.col("text")), ["Ａ—b", "1 , 5 x", "2. 5", "ﬁne ²", "Note†*", "x 3 y 4", None, " A  B ", "( a )"])
    assert got == ["a-b", "1,5 x", "2.5", "fine 2", "note", "x3 y4", "", "a b", "( a)"]


def test_library_kind(spark):
    got = apply(spark, library_kind(F.col("text")), ["{{[[pdf]]: u}}", "{{PDF: u}}", "see ![x](y.png)", "https://a.b/c", "[t](https://a.b)", "at https://a.b now", "", None, "[x](http://a", "http://a )", " http://a\n", "![x]( y)"])
    assert got == ["pdf", "pdf", "image", "web", "web", "block", "block", "block", "block", "block", "web", "block"]


def test_block_shape(spark):
    rows = {
        "[[a]]": "page", " [[a [[b]] c]] ": "page", "[[a]] [[b]]": "note", "#[[a b]]": "page", "#tag": "page", "#a b": "note", "[[]]": "note", "[[a": "note", "[[a]]]]": "note", "]][[a]]": "note",
        "((u-1))": "block", "{{[[Diagram]]": "board", "{{ pdf : x": "pdf", "{{[[pdf]]: x": "pdf", "{{PDF: x": "note", "![a](b)": "image", "x ![a](b)": "note", "": "note",
    }
    assert dict(zip(rows, apply(spark, block_shape(F.col("text")), list(rows)), strict=True)) == rows


def test_macros_of_regions_and_pins(spark):
    rows = {
        "{{[[cut-out]]: k=img d=u1}}": ("region", "region"), "  {{[[cut-out]]:}} ![a](b.png)\nmore": ("region", "region"), "{{[[pin.x]]: pg=2}} note": ("pin", "region"),
        "{{[[pin.x]]: pg=2}}note": ("block", "note"), "{{[[pinyx]]: pg=2}}": ("block", "note"), "{{[[cut-out]] k}}": ("block", "note"), "see {{[[cut-out]]: k}}": ("block", "note"), "{{[[cut-out]]: }k}}": ("block", "note"),
        " {{[[pins]]}} ": ("block", "regions"), "{{[[pins]]}} x": ("block", "note"), "": ("block", "note"),
    }
    assert apply(spark, library_kind(F.col("text"), {"cut-out": "region", "pin.x": "pin"}), list(rows)) == [k for k, _ in rows.values()]
    assert apply(spark, block_shape(F.col("text"), ["cut-out", "pin.x"], ["pins"]), list(rows)) == [s for _, s in rows.values()]


def test_library_row_kind(spark):
    rows = [("board", None, "x", None, "board"), ("part", "table", None, None, "table"), ("part", "odd", None, None, "paragraph"), ("part", None, None, None, "paragraph"), ("block", None, None, "http://a", "web"),
        ("daily", None, "x", None, "daily"), ("page", None, "May 1st, 2020", None, "daily"), ("page", None, "May 1, 2020", None, "page"), (None, None, None, None, "page")]
    got = apply(spark, library_row_kind(*[F.col(c) for c in "k p t x".split()]), [r[:4] for r in rows], "k string, p string, t string, x string")
    assert got == [r[4] for r in rows]


def test_fulltext_tests_each_page(spark):
    pages = spark.createDataFrame([(1, 0, "one category here"), (1, 1, "a caterory there"), (2, 0, "Nothing  of\nit"), (3, 0, "sub-categorys, here")], "doc int, page int, text string")
    asked = spark.createDataFrame([("a", "categ", ["categ"]), ("b", "category", ["category"]), ("c", "of it", ["of", "it"]), ("d", "category here", ["here", "category"])], "query string, phrase string, terms array<string>")
    got = {(r.query, r.doc, r.page): (r.exact, r.fuzzy) for r in search.search_fulltext(pages, asked).collect()}
    assert got == {
        ("a", 1, 0): (False, False), ("a", 3, 0): (False, False), ("b", 1, 0): (False, False), ("b", 1, 1): (False, True), ("b", 3, 0): (False, False),
        ("c", 2, 0): (True, False), ("d", 1, 0): (True, False), ("d", 3, 0): (False, False), ("d", 1, 1): (False, True),
    }
    assert {r.page for r in search.search_fulltext(pages, asked, (1, 1)).collect()} == {1}


def test_part_search_by_kind_page_and_reading_order(spark):
    rows = [
        (1, 1, 0, "heading", "Red Apples and  green\npears"), (1, 1, 1, "paragraph", "apples apples, red"), (1, 2, 2, "caption", "A red-apple pie"), (1, 3, 3, "paragraph", "red apples"),
        (2, 1, 0, "paragraph", "green pears, red apples, " + "x" * 200), (2, 1, 1, "paragraph", None), (2, 2, 2, "caption", ""),
    ]
    parts = spark.createDataFrame(rows, "doc int, page int, part int, kind string, text string")
    wanted = [("red apples", None, None), ("apple", ["caption"], ""), ('"green pears" red', [], "p. 1"), ("red", ["paragraph", "heading"], "2-"), ("pears e", [], "-1"), ("- red", [], ""), ("", ["caption"], "2"), ("zebra red", [], "")]
    asked = spark.createDataFrame([(q, k, p) for q, k, p in wanted], "query string, kinds array<string>, pages string")
    queries = asked.select("query", search.query_phrase(F.col("query")).alias("phrase"), search.query_terms(F.col("query")).alias("terms"), "kinds", "pages")
    got = {}
    for r in search.search_parts(parts, queries).orderBy("query", "pos").collect():
        got.setdefault(r.query, []).append((r.doc, r.part, r.exact, r.hits))
    bounds = {"p. 1": (1, 1), "2-": (2, 99), "-1": (1, 1), "2": (2, 2)}

    def plain(query, kinds, pages):
        terms = [(a or b).strip() for a, b in re.findall(r'"([^"]*)"|(\S+)', query.lower())]
        if any(not re.search(r"\w", x) for x in terms):
            return []
        phrase, low, high = query.replace('"', "").lower(), *bounds.get(pages, (0, 99))
        out = []
        for doc, page, part, kind, text in rows:
            hay = " ".join((text or "").split()).lower()
            if (not kinds or kind in kinds) and low <= page <= high and all(x in hay for x in terms):
                out.append((doc, part, len(terms) > 1 and phrase in hay, sum(hay.count(x) for x in terms)))
        return sorted(out, key=lambda h: (-h[2], -h[3], h[0], h[1]))

    assert got == {q: hits for q, k, p in wanted if (hits := plain(q, k, p))}
    assert len(got["red apples"]) == 4 and got[""] == [(1, 2, False, 0), (2, 2, False, 0)]
    one = search.search_parts(parts, queries.where("query = 'red apples'"), 1).collect()
    assert [(r.doc, r.part, r.snippet) for r in one] == [(1, 0, "Red Apples and green pears")]
    cut = search.search_parts(parts, queries.where("query = '\"green pears\" red'")).collect()
    assert {r.snippet for r in cut if r.doc == 2} == {("green pears, red apples, " + "x" * 200)[:120] + "\u2026"}


def test_page_ranges(spark):
    texts = ["3-8", "p. 3-8", "Pages 5", "4-", "-6", "8-3", "0", "all", "", "-", None]
    got = apply(spark, search.page_bounds(F.col("p")), [(x,) for x in texts], "p string")
    top = (1 << 63) - 1
    assert [tuple(r) if r else None for r in got] == [(3, 8), (3, 8), (5, 5), (4, top), (1, 6), None, None, None, None, None, None]


def test_context_pack_goes_on_after_a_part_that_does_not_fit(spark):
    rows = [(1, 10, 1, 50, False), (1, 11, 2, 90, False), (1, 12, 3, 30, False), (1, 13, 4, 30, False), (1, 14, 5, 20, False), (2, 20, 1, 101, False), (3, 30, 2, 60, True), (3, 31, 1, 60, False)]
    got = search.context_pack(spark.createDataFrame(rows, "query int, doc int, pos int, size int, forced boolean"), 100)
    assert sorted((r.query, r.doc, r.used) for r in got.collect()) == [(1, 10, 50), (1, 12, 80), (1, 14, 100), (3, 30, 60)]


def test_bootstrap_ranks(spark):
    pairs = spark.createDataFrame([("a", i, float(i % 7)) for i in range(300)], "category string, id int, d double")
    row = evaluation.bootstrap_ci(pairs, resamples=200).first()
    assert row.n == 200 and row.lo < 3 < row.hi


@pytest.mark.parametrize("per_batch", [1, 10])
def test_streams_do_not_lose_late_files(spark, tmp_path, per_batch):
    import os

    import pandas as pd

    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i, (read, present) in enumerate([(1, True), (3, False), (4, False), (2, True)]):
        file = folder / f"part-{i}.parquet"
        ts = pd.Timestamp("2024-01-01") + pd.Timedelta(days=read)
        pd.DataFrame({"owner": [1], "item": ["a"], "read": [read], "present": [present], "complete": [True], "ts": [ts.as_unit("us")], "kind": ["k"]}).to_parquet(file, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(file, (1_600_000_000 + 100 * i, 1_600_000_000 + 100 * i))
    table = spark.read.parquet(str(folder))
    stream = feeds.file_stream(spark, str(folder), table.schema, per_batch)
    gone = feeds.latest_version(feeds.drain(feeds.left_after_two_misses(stream), "t", "update"), ["owner", "item"])
    want = feeds.left_after_two_misses_batch(table)
    assert [(r.missed, r.gone) for r in gone.collect()] == [(r.missed, r.gone) for r in want.collect()] == [(2, True)]
    days = feeds.latest_version(feeds.drain(feeds.windowed_activity(stream.withColumn("ts", F.col("ts").cast("timestamp")), "1 day"), "d", "update"), ["start", "kind"])
    assert sorted(r.start.day for r in days.collect()) == [2, 3, 4, 5] and days.where("n = 1").count() == 4
    one_file = feeds.file_stream(spark, str(folder / "part-0.parquet"), table.schema)
    assert feeds.drain(feeds.opens_counter(one_file), "o", "update").count() == 1


def test_digitless_cells_are_read_on_demand(spark):
    rows = [("a", i, 0, 1, t) for i, t in enumerate(["1.50", "2.50", "3.25", "lOlOOO.lO", "lO.5O"])]
    frame = spark.createDataFrame(rows, "table_id string, r int, c int, col_span int, text string")
    state = lambda **k: {r.r: (r.repaired, r.state) for r in cells.numeric_column_repair(frame, **k).collect() if r.r > 2}
    assert state() == {3: ("101000.10", "fixed"), 4: ("10.50", "fixed")}
    assert state(digitless=False) == {3: ("lOlOOO.lO", "unsure"), 4: ("10.50", "fixed")}


@pytest.mark.parametrize("large", [5, 100_000])
def test_reading_metrics(spark, monkeypatch, large):
    """Words meet by page, or by page and word on large pages, with equal results."""
    monkeypatch.setattr(cells, "LARGE_PAGE", large)
    rows = [(1, "rule", 0, 0, "Red ring red"), (1, "rule", 0, 1, "7"), (1, "rule", 1, 0, "blue x"), (1, "reader", 0, 0, ""), (1, "reader", 1, 0, "ring"), (1, "reader", 1, 1, None), (2, "rule", 0, 0, "red")]
    told = [(1, 0, "red"), (1, 0, "ring"), (1, 1, "ring"), (1, 1, "ring"), (1, 1, "8"), (2, 0, "blue"), (3, 0, "x")]
    out = cells.reading_metrics(spark.createDataFrame(rows, "page int, reading string, r int, c int, text string"), spark.createDataFrame(told, "page int, row int, word string"))
    want = {}
    for page, reading in {r[:2] for r in rows}:
        cut = [(r, c, w) for p, k, r, c, t in rows if (p, k) == (page, reading) for w in re.findall(r"\w+", (t or "").lower())]
        said = {w for p, _, w in told if p == page}
        fit = lambda axis: [(lambda hit: sum(hit) / len(hit))([x[2] in said for x in cut if x[axis] == i]) for i in sorted({x[axis] for x in cut})]  # noqa: B023, E731
        mean = lambda v: round(sum(v) / len(v), 9) if v else None
        mine, words = {w for *_, w in cut}, {t for t in told if t[0] == page}
        found = sum(w in mine for *_, w in words)
        want[page, reading] = (mean(fit(0)), mean(fit(1)), round(found / len(words), 9) if found else None)
    nine = lambda v: None if v is None else round(v, 9)
    assert {(r.page, r.reading): (nine(r.row_fit), nine(r.col_fit), nine(r.row_coverage)) for r in out.collect()} == want


@pytest.mark.parametrize("large", [3, 100_000])
def test_adjacency_in_one_task_or_dealt(spark, monkeypatch, large):
    """Tables kept in one task and tables dealt over tasks count the same neighbours."""
    monkeypatch.setattr(evaluation, "LARGE_TABLE", large)
    kind = "table_id int, r int, c int, text string"
    truth = [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "a"), (1, 1, 1, "b"), (2, 0, 0, "x"), (2, 0, 2, "y")]
    pred = [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "a"), (1, 1, 1, "c"), (3, 0, 0, "q"), (3, 1, 0, "")]
    out = evaluation.adjacency_f1(spark.createDataFrame(pred, kind), spark.createDataFrame(truth, kind))
    assert {r.table_id: (r.tp, r.fp, r.fn) for r in out.collect()} == {1: (2, 2, 2), 2: (0, 0, 1)}


def test_search_keeps_its_hits_when_nothing_is_handed_out(spark, monkeypatch):
    pages = spark.createDataFrame([(i, 0, f"common words on page x{i % 7}y, caterory {i}") for i in range(60)], "doc int, page int, text string")
    asked = spark.createDataFrame([(q, q, q.split()) for q in ("common x3y", "category x5y", "words page", "zebra on")], "query string, phrase string, terms array<string>")
    parts = pages.select("doc", "page", F.lit(0).alias("part"), F.lit("line").alias("kind"), "text")
    wide = asked.select("*", F.lit(None).cast("array<string>").alias("kinds"), F.lit("0").alias("pages"))
    both = lambda: (set(search.search_fulltext(pages, asked).collect()), set(search.search_parts(parts, wide).collect()))
    few = both()
    monkeypatch.setattr(search, "HANDED_OUT", 0)
    assert both() == few
    assert {(r.query, r.doc) for r in few[0]} == {("common x3y", i) for i in range(60) if i % 7 == 3} | {("category x5y", i) for i in range(60) if i % 7 == 5} | {("words page", i) for i in range(60)}


def test_postings_of_a_text_need_no_shuffle(spark):
    texts = spark.createDataFrame([(1, "a b A"), (2, None)], "doc int, text string")
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(search, "cut_lineage", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
        assert {tuple(r) for r in search.word_postings(texts, ["doc"]).collect()} == {(1, "a"), (1, "b")}
    assert len(seen) == 1 and "Exchange" not in seen[0]


def test_search_meets_texts_where_their_words_met(spark, monkeypatch):
    """Nothing is checkpointed, hits are written in one go, and parts of a listed kind are not dealt by kind."""
    parts = [(1, 1, i, "body" if i % 2 else "head", f"red apple {i} and Green pear") for i in range(6)]
    asked = [("a", "red apple", ["red", "apple"], ["body"], None), ("k", "", [], ["head"], None), ("n", "blue", ["blue"], None, None)]
    frames = [spark.createDataFrame(parts, "doc int, page int, part int, kind string, text string"), spark.createDataFrame(asked, "query string, phrase string, terms array<string>, kinds array<string>, pages string")]
    monkeypatch.setattr(type(frames[0]), "checkpoint", None)
    plans, keep = [], search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    got = search.search_parts(*frames).collect()
    assert {(r["query"], r["part"], r["exact"]) for r in got} == {("a", i, True) for i in (1, 3, 5)} | {("k", i, False) for i in (0, 2, 4)}
    by_kind = [line for line in plans[-1].splitlines() if "Join" in line and "kind#" in line.split(", (")[-1]]
    assert by_kind and all("strategy=broadcast" in line for line in by_kind)


def test_readings_dealt_by_page_are_not_dealt_again(spark):
    """What is shuffled are a reading's metrics, not its cells and words; the result is the same."""
    rows = [(p, k, r, c, f"w{(p * r + c) % 5} w{c} {r}") for p in range(6) for k in ("rule", "reader") for r in range(3) for c in range(2)]
    told = [(p, r, f"w{(p + r) % 4}") for p in range(6) for r in range(3)]
    sides = [spark.createDataFrame(rows, "page int, reading string, r int, c int, text string"), spark.createDataFrame(told, "page int, row int, word string")]
    whole = cells.reading_metrics(*sides)
    dealt = cells.reading_metrics(*[df.repartition(3, "page") for df in sides], dealt=True)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect()))
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") and "REPARTITION_BY_COL" not in plan


@pytest.mark.parametrize("look", [1, 3, 200])
def test_packing_sends_first_parts_only(spark, monkeypatch, look):
    """The greedy walk along a given order with places among all scores; no part is numbered or dealt to be looked at."""
    monkeypatch.setattr(search, "LOOK", look)
    monkeypatch.setattr(search, "range_position", None)
    rows = [(q, d, float((d * 7 + q) % 11), (d * d * 13 + q) % 60, d % 5 == 0 if d % 4 else None) for q in range(3) for d in range(40)]
    scores = spark.createDataFrame(rows, "query int, doc int, score double, size int, forced boolean")
    kept = []
    cut = search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df: kept.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    got = search.placed(search.context_pack(scores, 90, [F.col("score").desc(), "doc"]), scores)
    want = set()
    for q in range(3):
        ranked = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        place = {r[1]: i for i, r in enumerate(ranked, 1)}
        used = 0
        for r in sorted(ranked, key=lambda r: not r[4]):
            if used + r[3] <= 90:
                used += r[3]
                want.add((q, r[1], place[r[1]], used))
    assert {(r.query, r.doc, r.pos, r.used) for r in got.collect()} == want
    assert "Exchange" not in kept[0]


def test_scores_meet_queries_where_a_document_is(spark):
    docs = spark.createDataFrame([(i, f"red apple{i % 3} pear " * (i + 1)) for i in range(9)], "doc int, text string")
    asked = spark.createDataFrame([(1, "red pear"), (2, "apple1 apple2"), (3, "the")], "query int, text string")
    out = search.bm25_scores(docs, asked)
    assert {(r["query"], r["doc"]) for r in out.collect()} == {(1, i) for i in range(9)} | {(2, i) for i in range(9) if i % 3}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "hashpartitioning(query" not in plan and "REPARTITION_BY_NUM" in plan
