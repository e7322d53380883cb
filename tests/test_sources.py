"""Readers on small hand-made inputs with the awkward cases."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from threadloom.functions import markup
from threadloom.operators import cells, documents, filters
from threadloom.sources import blocks, canvas, outline

TEXT = """# Title

First line
second line
---
| A | B |
|---|:---:|
| 1 | x |
| 2 |
after the table

- one
- two
> quoted
> more
```
code | not a table
# not a heading
```
$$
a + b
$$
last"""


def test_text_to_blocks(spark):
    rows = blocks.text_to_blocks(spark.createDataFrame([(1, TEXT), (2, "")], "doc_id int, text string")).orderBy("doc", "pos").collect()
    assert [(r["type"], r["level"], r["text"]) for r in rows] == [
        ("heading", 1, "Title"),
        ("para", None, "First line second line"),
        ("table", None, "| A | B |\n|---|:---:|\n| 1 | x |\n| 2 |"),
        ("para", None, "after the table"),
        ("list", 0, "one\ntwo"),
        ("para", None, "quoted more"),
        ("code", None, "code | not a table\n# not a heading"),
        ("formula", None, "a + b"),
        ("para", None, "last"),
    ]


def test_pipe_table_is_padded(spark):
    parsed = blocks.text_to_blocks(spark.createDataFrame([(1, TEXT)], "doc_id int, text string"))
    got = {(r["r"], r["c"]): (r["text"], r["header"]) for r in blocks.extract_pipe_tables(parsed).collect()}
    assert got == {(0, 0): ("A", True), (0, 1): ("B", True), (1, 0): ("1", False), (1, 1): ("x", False), (2, 0): ("2", False), (2, 1): ("", False)}


def test_outline_order_ties_and_containers(spark):
    tree = {
        "uid": "p", "title": "Page",
        "children": [
            {"uid": "b", "string": "second", "order": 1, "children": [{"uid": "d", "string": "", "order": 0}]},
            {"uid": "a", "string": "first", "order": 0},
            {"uid": "c", "string": "tie", "order": 1, "props": {"type": "edge"}},
        ],
    }
    rows = outline.flatten_tree(spark.createDataFrame([(json.dumps(tree),)], "json string"), "json").collect()
    got = {r["uid"]: (r["parent_uid"], r["ord"], r["depth"], r["table"]) for r in rows}
    assert got == {"p": (None, 0, 0, "nodes"), "a": ("p", 0, 1, "nodes"), "b": ("p", 1, 1, "nodes"), "c": ("p", 2, 1, "edges"), "d": ("b", 0, 2, "nodes")}


def test_canvas_rules(spark):
    node = lambda i, **k: {"id": i, "type": "text", "x": 0, "y": 0, "width": 5, "height": 5, **k}
    file = {
        "nodes": [node("a"), node("a"), node("b", width=0), node("c", type="shape"), node("d", type="link"), node("e", type="link", url="http://x")],
        "edges": [{"id": "1", "fromNode": "a", "toNode": "e"}, {"id": "2", "fromNode": "a", "toNode": "a"}, {"id": "3", "fromNode": "a", "toNode": "b"}],
    }
    row = canvas.parse_canvas(spark.createDataFrame([(json.dumps(file),)], "json string")).first()
    assert [n["id"] for n in row["kept_nodes"]] == ["a", "e"]
    assert [e["id"] for e in row["kept_edges"]] == ["1"] and row["skipped"] == 6 and row["error"] is None


def test_large_canvas_is_read_whole(spark):
    nodes = [{"id": str(i), "type": "text", "x": 0, "y": i, "width": 9, "height": 9, "text": "t"} for i in range(2500)]
    edges = [{"id": f"e{i}", "fromNode": str(i % 2500), "toNode": str((i + 1) % 2500)} for i in range(5000)]
    row = canvas.parse_canvas(spark.createDataFrame([(json.dumps({"nodes": nodes, "edges": edges}),)], "json string")).first()
    assert len(row["kept_nodes"]) == 2500 and len(row["kept_edges"]) == 5000 and row["skipped"] == 0 and row["error"] is None


def test_ledger_skips_torn_lines(spark):
    lines = spark.createDataFrame([('{"uid": "a", "n": 1}',), ('{"uid": "b", "n"',), ('{"n": 2}',), ("",)], "value string")
    assert [r["uid"] for r in canvas.parse_ledger(lines, "uid string, n int").collect()] == ["a"]


@pytest.mark.parametrize(
    ("title", "day"),
    [("October 5th, 2026", date(2026, 10, 5)), ("February 30th, 2026", None), ("October 5, 2026", None), ("Notes", None)],
)
def test_daily_title(spark, title, day):
    assert spark.range(1).select(markup.daily_title_date(F.lit(title)).alias("d")).first()["d"] == day


def test_references_skip_code(spark):
    row = spark.range(1).select(
        markup.page_refs(F.lit("[[A]] #b `[[C]]` [[A]] x#no")).alias("p"), markup.block_refs(F.lit("((abc)) `((no))`")).alias("b")
    ).first()
    assert row["p"] == ["A", "b"] and row["b"] == ["abc"]


def test_query_shape_rules(spark):
    refs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "src int, dst string")
    tree = filters.All((filters.Cites("a"), filters.Not(filters.Cites("b"))))
    assert [r["src"] for r in filters.ref_query(refs, tree).collect()] == [2]
    with pytest.raises(ValueError):
        filters.ref_query(refs, filters.All((filters.Not(filters.Cites("a")),)))
    with pytest.raises(ValueError):
        filters.ref_query(refs, filters.Not(filters.Cites("a")))
    with pytest.raises(ValueError):
        filters.between(date(2026, 1, 1), date(2026, 3, 1))


def test_lists_levels(spark):
    data = [(1, 0, i, t, x, float(i * 12), 10.0) for i, (t, x) in enumerate([("- a", 10.0), ("- b", 30.0), ("more b", 40.0), ("- c", 10.0), ("plain", 10.0)])]
    lines = spark.createDataFrame(data, "doc int, page int, pos int, text string, x0 double, base double, size double")
    got = [(r["pos"], r["level"], r["lines"], r["ordered"]) for r in documents.detect_lists(lines).orderBy("pos").collect()]
    assert got == [(0, 0, 1, False), (1, 1, 2, False), (3, 0, 1, False)]


@pytest.mark.parametrize(("text", "number"), [("1,234.5", True), ("(12)", True), ("3%", True), ("12 [a]", True), ("abc", False), ("", False)])
def test_numeric_text(spark, text, number):
    assert spark.range(1).select(cells.is_number(F.lit(text)).alias("n")).first()["n"] is number


def test_outlines_of_any_depth(spark):
    tree = {"uid": "n30", "string": "leaf"}
    for k in range(29, -1, -1):
        tree = {"uid": f"n{k}", "string": f"s{k}", "order": 0, "children": [{"uid": f"x{k}", "order": 5, "open": "maybe"}, tree, {"string": 7}]}
    texts = [(1, json.dumps(tree), 1), (2, None, 1), (3, "{broken", 1), (4, '{"uid": "z", "children": "none", "props": {"type": "edge"}}', 1)]
    rows = outline.flatten_tree(spark.createDataFrame(texts, "id int, json string, __n int"), "json").collect()
    chain = {r["uid"]: r for r in rows if r["id"] == 1 and r["uid"] and r["uid"][0] == "n"}
    assert [(chain[f"n{k}"]["depth"], chain[f"n{k}"]["parent_uid"], chain[f"n{k}"]["ord"]) for k in range(1, 31)] == [(k, f"n{k - 1}", 0) for k in range(1, 31)]
    assert chain["n30"]["string"] == "leaf" and len([r for r in rows if r["id"] == 1]) == 31 + 60
    assert all(r["ord"] == 2 and r["open"] is None for r in rows if r["uid"] and r["uid"][0] == "x")
    assert [(r["uid"], r["table"]) for r in rows if r["id"] == 4] == [("z", "edges")] and not [r for r in rows if r["id"] in (2, 3)]
