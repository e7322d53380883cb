"""Which filter removes what, over every order of the filters.

Spark reduces the documents to counts per part and failure pattern. The counts
of a part are one contingency tensor with an axis of two (pass, fail) for each
filter. Whatever an order and a step ask for is a contraction of that tensor:
each axis is met by a vector that selects pass, fail or both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import Scratch

PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def contract(tensor: np.ndarray, picks: Sequence[np.ndarray]) -> int:
    """The sum of ``tensor`` over the cells that every axis's vector selects."""
    axes = range(tensor.ndim)
    return int(np.einsum(tensor, list(axes), *[x for i, v in zip(axes, picks, strict=True) for x in (v, [i])], []))


def audit_part(tensors: dict[str, np.ndarray], names: str) -> list[tuple]:
    """Rows (order, step, counts) of one part. ``tensors``: ``all``, ``good`` and ``toxic`` counts, one axis a filter in the order of ``names``."""
    whole, size = tensors["all"], len(names)

    def picked(which: str, before: Sequence[int], at: int | None, last: np.ndarray) -> int:
        picks = [PASS if i in before else ALL for i in range(size)]
        if at is not None:
            picks[at] = last
        return contract(tensors[which], picks)

    cells: dict[tuple[frozenset, int], tuple] = {}
    for at in range(size):
        fails = picked("all", (), at, FAIL)
        alone = contract(whole, [FAIL if i == at else PASS for i in range(size)])
        others = [i for i in range(size) if i != at]
        for mask in range(1 << len(others)):
            before = frozenset(o for k, o in enumerate(others) if mask >> k & 1)
            removed = picked("all", before, at, FAIL)
            cells[before, at] = (
                picked("all", before, at, PASS), removed, fails - removed, alone, picked("good", before, at, FAIL), picked("toxic", before, at, FAIL)
            )
    rows, share = [], [0] * size
    for order in permutations(range(size)):
        for step, at in enumerate(order):
            found = cells[frozenset(order[:step]), at]
            share[at] += found[1]
            rows.append(("".join(names[i] for i in order), step + 1, at, found))
    return [(order, step, *found, share[at]) for order, step, at, found in rows]


def audit_filters(docs: DataFrame, fails: dict[str, Column], part: Column, good: Column, toxic: Column, times: Column | None = None) -> DataFrame:
    """Counts for every part, order of the filters and step.

    ``fails`` maps a one-letter name to a condition on ``docs`` that holds when
    the filter fails; a null condition passes. ``times`` is how often a row
    counts (once). A part that is null counts as the empty string; ``good`` and
    ``toxic`` that are null are false. Without rows there are no parts. Each part
    is one row of counts before it is contracted, so a part of any size and any
    number of parts are spread.
    """
    names = "".join(fails)
    size, orders = 1 << len(names), list(fails)
    pattern = sum((F.when(F.coalesce(c, F.lit(False)), 1 << (len(names) - 1 - i)).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))
    flags = docs.select(
        F.coalesce(part.cast("string"), F.lit("")).alias("part"), pattern.cast("int").alias("p"),
        F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(toxic, F.lit(False)).alias("toxic"), (F.lit(1) if times is None else times).cast("bigint").alias("n"),
    )
    counts = flags.groupBy("part", "p").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("p", "all", "good", "toxic")).alias("cells"))  # at most 2^filters cells

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, cells in zip(batch["part"], batch["cells"], strict=True):
                tensors = {}
                for which in ("all", "good", "toxic"):
                    flat = np.zeros(size, np.int64)
                    for c in cells:
                        flat[c["p"]] = c[which]
                    tensors[which] = flat.reshape((2,) * len(orders))
                out = pd.DataFrame(audit_part(tensors, names), columns=["filter_order", "step", *COUNTS])
                yield out.assign(part=name)

    return rows.mapInPandas(run, "filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", part string").select("part", "filter_order", "step", *COUNTS)


def text_words(text: Column) -> Column:
    """The words of a whole text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Conditions A to D on a whole text that is not null and its words."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``audit_filters`` of the five text filters over all of ``docs``.

    E fails for a text that a smaller id holds, in any part; null and empty texts
    are equal, a null id is neither smaller nor fails. Texts meet by SHA-256. A
    repeated row counts as often as it occurs. An id counts as good or toxic if
    any of its label rows says so; labels of null ids and ids without a label
    say nothing. Extra columns may have any name.
    """
    keep = Scratch(docs.sparkSession, "audit").keep
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    failing = text_failures(F.col("text"), F.col("words"))
    rows = read.withColumn("words", text_words(F.col("text"))).select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in failing.items()])
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # First one row an id, so copies of a text are dealt over all tasks; then each task folds its rows of a text before they meet.
    by = ["digest", "part", *failing, "good", "toxic"]
    single = rows.join(marks, "id", "left").groupBy("id", *by).agg(F.count("*").alias("n"))
    no_id = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    folded = keep(single.groupBy(*by).agg(F.min("id").alias("low"), F.sum("n").alias("n"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("n_low"), no_id.alias("n_null")), "texts")
    least = folded.groupBy("digest").agg(F.min("low").alias("least"))
    passing = F.col("n_null") + F.when(F.col("low") == F.col("least"), F.col("n_low")).otherwise(0)
    sides = F.array(F.struct(F.lit(False).alias("E"), passing.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - passing).alias("n")))
    counted = folded.join(least, "digest").select("part", *failing, "good", "toxic", F.inline(sides))
    return audit_filters(counted, {k: F.col(k) for k in "ABCDE"}, F.col("part"), F.col("good"), F.col("toxic"), F.col("n"))
