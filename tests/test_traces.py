"""Nested trace spans against a plain stack."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import traces


def _plain(spans, start, end):
    out = {}
    for thread in {s[0] for s in spans}:
        rows = sorted(
            ((max(at, start), min(at + dur, end), name in traces.TASKS, uid, name) for t, uid, name, at, dur in spans if t == thread and at is not None and dur is not None),
            key=lambda r: (r[0], -r[1], not r[2], r[3]),
        )
        stack = []

        def close():
            n = stack.pop()
            out[thread, n["uid"]] = (n["parent"], n["end"] - n["start"], max(0, n["end"] - n["start"] - n["child"]), n["task"] and not n["inside"], n["under"])

        for c0, c1, task, uid, name in rows:
            if c1 <= c0:
                continue
            while stack and stack[-1]["end"] <= c0:
                close()
            top = stack[-1] if stack else None
            stop = min(c1, top["end"]) if top else c1
            if top:
                top["child"] += stop - c0
            stack.append({
                "uid": uid, "start": c0, "end": stop, "child": 0, "task": task, "parent": top and top["uid"], "script": name == "FunctionCall",
                "inside": bool(top) and (top["inside"] or top["task"]), "under": bool(top) and (top["under"] or top["script"]),
            })
        while stack:
            close()
    return out


@pytest.mark.parametrize("seed", range(3))
def test_nesting_equals_a_plain_stack(spark, seed):
    rng = random.Random(seed)
    names = [*traces.TASKS, "FunctionCall", "Layout", "Paint", "x"]
    spans = [(rng.choice([1, 2, 2, 2]), i, rng.choice(names), rng.randrange(0, 3000), rng.choice([0, 1, 5, 5, 20, 100])) for i in range(600)]
    spans += [(1, 1000, "RunTask", -50, 5000), (3, 1001, "RunTask", 10, 5), (3, 1002, "RunTask", 15, 5), (3, 1003, "x", 15, 5), (4, 1004, "x", None, 3), (4, 1005, "x", 3, None), (5, 1006, "x", 99_999, 3)]
    df = spark.createDataFrame(spans, "thread int, uid long, name string, at long, dur long").repartition(5)
    got = {(r["thread"], r["uid"]): (r["parent"], r["span"], r["self"], r["top_task"], r["under_script"]) for r in traces.nested_spans(df, 100, 2900).collect()}
    assert got == _plain(spans, 100, 2900)
    totals = {(r["thread"], r["category"]): r["self_us"] for r in traces.trace_category_time(df, 100, 2900).collect()}
    assert totals[3, "idle"] if (3, "idle") in totals else True
    assert totals[1, "idle"] == 0 and sum(v for (t, c), v in totals.items() if t == 1) == 2800
    assert traces.nested_spans(df.limit(0), 0, 10).count() == 0


def test_categories(spark):
    want = {"RunTask": None, "v8.run": "script", "ResizeObserver::x": "script", "UpdateLayoutTree": "style", "UpdateLayoutX": "layout", "UpdateLayoutTreeX": "layout", "Layout": "layout", "InvalidateStyleY": "style", "MinorGC": "gc", "V8.GCx": "gc", "V8xGC": None, "Decode Image": "paint", "paint": None}
    rows = spark.createDataFrame([(n,) for n in want], "name string").select("name", traces.span_category(F.col("name")).alias("c")).collect()
    assert {r["name"]: r["c"] for r in rows} == want
