"""Main-thread traces: nested spans, self time by category, idle time, long tasks, selector totals.

Spans of a thread nest by one sorted pass with a stack. The pass is split where
a thread is at rest: no span that began before is still open there, so the stack
is empty and what follows depends on nothing earlier. The rest points come from
a running maximum of span ends that is carried across range partitions; the
runs between them are dealt over all tasks, and a run is streamed with a stack
as deep as its nesting.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.windows import range_sorted, split_last_known
from threadloom.session import cut_lineage

LONG_TASK_US = 50_000

# Names of trace events and the category each counts for.
TASKS = ("RunTask", "ThreadControllerImpl::RunTask")
NAMES = {
    "script": (
        "FunctionCall EvaluateScript v8.run v8.callFunction V8.Execute TimerFire FireAnimationFrame EventDispatch RunMicrotasks FireIdleCallback "
        "XHRReadyStateChange XHRLoad v8.compile V8.CompileCode v8.parseOnBackground v8.produceCache"
    ).split(),
    "style": "UpdateLayoutTree RecalculateStyles ParseAuthorStyleSheet".split(),
    "layout": ["Layout"],
    "paint": ["Paint", "PrePaint", "Layerize", "UpdateLayer", "UpdateLayerTree", "CompositeLayers", "Commit", "PaintImage", "Decode Image", "ImageDecodeTask", "HitTest"],
}
PREFIXES = (
    ("script", "^(MutationObserver|IntersectionObserver|ResizeObserver)"),
    ("style", "^InvalidateStyle"),
    ("layout", "^UpdateLayout(?!Tree$)"),
    ("gc", r"^(MinorGC|MajorGC|V8\.GC|BlinkGC|CppGC)"),
)


def span_category(name: Column) -> Column:
    """script, style, layout, paint, gc or null; exact names go before prefixes."""
    of_name = F.create_map(*[F.lit(x) for kind, names in NAMES.items() for n in names for x in (n, kind)])
    return F.coalesce(F.element_at(of_name, name), *[F.when(name.rlike(pattern), kind) for kind, pattern in PREFIXES])


def _nest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted spans (thread, run, uid, c0, c1, task, script) with their place in the nesting."""
    stack: list[list] = []  # [thread, run, uid, start, end, child time, task, under script, inside a task]
    out: list[tuple] = []

    def close() -> None:
        thread, _, uid, start, end, child, _, _, inside, parent, under = stack.pop()
        out.append((thread, uid, parent, end - start, max(0, end - start - child), inside, under))

    for part in batches:
        for thread, run, uid, c0, c1, task, script in part.itertuples(index=False):
            while stack and (stack[-1][0] != thread or stack[-1][1] != run or stack[-1][4] <= c0):
                close()
            top = stack[-1] if stack else None
            end = min(c1, top[4]) if top else c1
            if top:
                top[5] += end - c0
            stack.append([thread, run, uid, c0, end, 0, task, script, bool(top) and (top[8] or top[6]), top[2] if top else None, bool(top) and (top[10] or top[7])])
        yield _spans(out)
        out.clear()
    while stack:
        close()
    yield _spans(out)


def _spans(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["thread", "uid", "parent", "span", "self", "in_task", "under_script"])
    return out.astype({"parent": "Int64"})


def nested_spans(events: DataFrame, start: int, end: int) -> DataFrame:
    """Spans (thread, uid, name, at, dur) clipped to the window and nested per thread.

    Gives thread, uid, name, category, start, span, self, parent, top_task and
    under_script. A span that outlasts the one it began in is cut to it. Of spans
    that begin together the longer is outside, then tasks, then the smaller uid.
    What has no category counts as ``other`` if it is a task or inside one. Spans
    without length inside the window are left out; null times too. Spans that
    overlap without a rest are streamed by one task.
    """
    lo, hi = F.greatest("at", F.lit(start)), F.least(F.col("at") + F.col("dur"), F.lit(end))
    clipped = events.where("at IS NOT NULL AND dur IS NOT NULL").select("thread", "uid", "name", lo.alias("c0"), hi.alias("c1"), F.col("name").isin(*TASKS).alias("task")).where("c1 > c0")
    rows = range_sorted(clipped, ["thread", "c0", F.desc("c1"), F.desc("task"), "uid"])
    before = Window.partitionBy("thread", "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy("thread").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("thread", "__part").agg(F.max("c1").alias("__end")).select("thread", "__part", F.max("__end").over(parts).alias("__open"))
    open_until = F.greatest(F.max("c1").over(before), F.col("__open"))
    at_rest = rows.join(carried, ["thread", "__part"]).withColumn("__rest", F.coalesce(F.col("c0") >= open_until, F.lit(True)))
    runs = split_last_known(at_rest, ["thread"], ["__at"], F.col("__part"), F.when(F.col("__rest"), F.col("c0")), "run")
    script = F.coalesce(span_category(F.col("name")) == "script", F.lit(False))
    dealt = runs.withColumn("script", script).repartition("thread", "run").sortWithinPartitions("thread", "run", "__part", "__at")
    kind = {c: clipped.schema[c].dataType.simpleString() for c in ("thread", "uid")}
    nested = dealt.select("thread", "run", "uid", "c0", "c1", "task", "script").mapInPandas(
        _nest, f"thread {kind['thread']}, uid {kind['uid']}, parent {kind['uid']}, span bigint, self bigint, in_task boolean, under_script boolean"
    )
    met = nested.join(clipped.select("thread", "uid", "name", "c0", "task"), ["thread", "uid"])
    category = F.coalesce(span_category(F.col("name")), F.when(F.col("task") | F.col("in_task"), "other"))
    return met.select("thread", "uid", "name", category.alias("category"), F.col("c0").alias("start"), "span", "self", "parent", (F.col("task") & ~F.col("in_task")).alias("top_task"), "under_script")


def trace_category_time(events: DataFrame, start: int, end: int) -> DataFrame:
    """Per (thread, category): self time, spans, spans of style and layout time that script forced; ``idle`` is the window less its outermost tasks."""
    spans = cut_lineage(nested_spans(events, start, end))
    forced = F.when(F.col("category").isin("style", "layout") & F.col("under_script"), F.col("self")).otherwise(0)
    busy = spans.where("category IS NOT NULL").groupBy("thread", "category").agg(F.sum("self").alias("self_us"), F.sum(forced).alias("forced_us"), F.count("*").alias("n"))
    tasks = F.sum(F.when(F.col("top_task"), F.col("span")).otherwise(0))
    idle = spans.groupBy("thread").agg((F.lit(end - start) - tasks).alias("self_us"), F.count_if("top_task").alias("n"))
    return busy.unionByName(idle.select("thread", F.lit("idle").alias("category"), "self_us", F.lit(0).cast("bigint").alias("forced_us"), "n"))


def long_tasks(events: DataFrame, start: int, end: int, least_us: int = LONG_TASK_US) -> DataFrame:
    """Outermost tasks of at least ``least_us``: thread, uid, start within the window, length."""
    spans = nested_spans(events, start, end)
    return spans.where(F.col("top_task") & (F.col("span") >= least_us)).select("thread", "uid", (F.col("start") - start).alias("st"), F.col("span").alias("d"))


def selector_totals(timings: DataFrame) -> DataFrame:
    """Time, match attempts and matches per selector over all timings (selector, us, attempts, matches); missing numbers count as 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return timings.groupBy("selector").agg(total("us"), total("attempts"), total("matches"))
