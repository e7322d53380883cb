"""Scores of parsed tables and texts against truth, pooled rates and paired statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import partial
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.matching import jaccard, match_best_first, overlap_pairs, similar_sets, tokens_of
from threadloom.functions.windows import pick_ranks, split_running_sum, value_band

SOFT_MATCH = 0.9
TABLE_MATCH = 0.2
HIT_IOU = 0.5
NEAR_PARTS = 32  # positions of a document that are dealt together to find what stands next to a part
LARGE_TABLE = 100_000  # cells of both sides above which a table is not kept in one task


# Compatibility forms that tables hold: pairs of form and plain text, each a fixed value.
_WIDE = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
_SMALL = {"\u00a0": " ", "\u2007": " ", "\u202f": " ", "º": "o", "ª": "a", "µ": "μ", "²": "2", "³": "3", "¹": "1"} | {chr(0x2080 + k): str(k) for k in range(10)} | {chr(0x2070 + k): str(k) for k in (0, *range(4, 10))}
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4", "™": "tm", "℃": "°c", "№": "no"}
_FOLDED = r"[^\x00-\x7fÀ-ɏ]"  # what may be one of these forms or a dash: no plain or accented Latin letter is

_ONE_WORD = r"^[!-)+-~]*\z"  # no space, no form and no star: only case is left to fold


def norm_text(text: Column) -> Column:
    """Comparable text of a cell or line: plain forms, one kind of dash and space, marks closed up, note marks gone, case folded.

    Superscript digits are their plain digits, as compatibility folding has
    them, so only daggers and stars are left as note marks at the end. The
    steps stand in a lambda, for as one generated method they are too long to
    be compiled to machine code.
    """
    steps = F.get(F.transform(F.array(F.coalesce(text, F.lit(""))), _normed), F.lit(0))
    return F.when(text.rlike(_ONE_WORD), F.lower(text)).otherwise(steps)


def _normed(text: Column) -> Column:
    flat = F.translate(text, "".join([*_WIDE, *_SMALL]), "".join([*_WIDE.values(), *_SMALL.values()]))
    for form, plain in _LIGATURES.items():
        flat = F.replace(flat, F.lit(form), F.lit(plain))
    folds = F.regexp_replace(flat, "[\u2010-\u2015\u2212]", "-")
    dashed = F.when(text.rlike(_FOLDED), folds).otherwise(text)  # most texts hold none of the forms
    marks = F.regexp_replace(dashed, r"\s+(?=[,.;:)])", "")
    closed = F.regexp_replace(F.regexp_replace(marks, r"(?<=\d[.,])\s+(?=\d)", ""), r"\s+", " ")
    folded = F.lower(F.trim(F.regexp_replace(closed, r"[†‡*]+$", "")))
    return F.regexp_replace(folded, r"(?<=\b[a-z])\s+(?=\d)", "")


def rates(tp: Column, pred: Column, truth: Column) -> list[Column]:
    """Precision, recall and F1 with 0 for empty denominators."""
    p = F.coalesce(F.try_divide(tp, pred), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, truth), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f, 6).alias("f1")]


def cell_matches(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Cells of both sides on (table_id, r, c, row_span, col_span) with similarity; unsure truth cells are out on both sides."""
    key = ["table_id", "r", "c", "row_span", "col_span"]
    t = truth.select(*key, norm_text(F.col("text")).alias("t_text"), "unsure", F.lit(True).alias("in_t"))
    p = pred.select(*key, norm_text(F.col("text")).alias("p_text"), F.lit(True).alias("in_p"))
    both = p.join(t, key, "full_outer").where(~F.coalesce("unsure", F.lit(False)))
    longest = F.greatest(F.length("t_text"), F.length("p_text"))
    sim = F.when(F.col("t_text") == F.col("p_text"), 1.0).otherwise(1 - F.try_divide(F.levenshtein("t_text", "p_text"), longest))
    hit = F.col("in_t") & F.col("in_p")
    return both.select(*key, F.coalesce("in_p", F.lit(False)).alias("in_p"), F.coalesce("in_t", F.lit(False)).alias("in_t"), F.when(hit, sim).alias("sim"))


def table_f1(pred: DataFrame, truth: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cell and structure F1 per group of ``by`` columns (subset of the cell keys), micro-averaged."""
    c = cell_matches(pred, truth)
    sums = c.groupBy(*by).agg(
        F.count_if("in_p").alias("pred_n"), F.count_if("in_t").alias("truth_n"), F.count("sim").alias("structure_tp"),
        F.count_if(F.col("sim") == 1.0).alias("cell_tp"), F.count_if(F.col("sim") >= SOFT_MATCH).alias("soft_tp"),
    )
    p, r, f1 = rates(F.col("cell_tp"), F.col("pred_n"), F.col("truth_n"))
    _, _, structure = rates(F.col("structure_tp"), F.col("pred_n"), F.col("truth_n"))
    return sums.select("*", p, r, f1, structure.alias("structure_f1"))


def worst_tables(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.orderBy("f1", "table_id").limit(k)


def table_match(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth tables matched one to one with predictions by shared cell texts, Jaccard over 0.2, best first.

    Tables (page, uid, items) meet on their rarest items; an item is a
    normalised cell text.
    """
    shared = similar_sets(truth, pred, ["page"], TABLE_MATCH)
    score = F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))
    return match_best_first(shared.withColumn("score", score).where(F.col("score") > TABLE_MATCH).select("page", "a", "b", "score"), "score")


def adjacency_relations(cells: DataFrame) -> DataFrame:
    """Multiset of neighbour relations (table_id, a, b, dir, n): the next filled cell to the right and below."""
    filled = cells.withColumn("t", norm_text(F.col("text"))).where(F.col("t") != "")
    right = filled.withColumn("nxt", F.lead("t").over(Window.partitionBy("table_id", "r").orderBy("c")))
    down = filled.withColumn("nxt", F.lead("t").over(Window.partitionBy("table_id", "c").orderBy("r")))
    both = right.select("table_id", F.col("t").alias("a"), F.col("nxt").alias("b"), F.lit("h").alias("dir")).unionByName(
        down.select("table_id", F.col("t").alias("a"), F.col("nxt").alias("b"), F.lit("v").alias("dir"))
    )
    return both.where(F.col("b").isNotNull()).groupBy("table_id", "a", "b", "dir").agg(F.count("*").alias("n"))


def _adjacency_counts(cells: DataFrame) -> DataFrame:
    """(table_id, tp, fp, fn) of the neighbour relations of predicted and true cells (table_id, r, c, text, predicted)."""
    filled = cells.withColumn("t", norm_text(F.col("text"))).where(F.col("t") != "")
    after = lambda line, along: F.lead("t").over(Window.partitionBy("table_id", "predicted", line).orderBy(along))
    near = filled.withColumn("right", after("r", "c")).withColumn("down", after("c", "r"))
    ends = F.array(F.struct(F.col("right").alias("b"), F.lit("h").alias("dir")), F.struct(F.col("down").alias("b"), F.lit("v").alias("dir")))
    both = near.select("table_id", "predicted", F.col("t").alias("a"), F.explode(ends).alias("e")).where(F.col("e.b").isNotNull())
    met = both.groupBy("table_id", "a", "e.b", "e.dir").agg(F.count_if("predicted").alias("np"), F.count_if(~F.col("predicted")).alias("nt"))
    return met.groupBy("table_id").agg(
        F.sum(F.least("np", "nt")).alias("tp"), F.sum(F.greatest(F.lit(0), F.col("np") - F.col("nt"))).alias("fp"), F.sum(F.greatest(F.lit(0), F.col("nt") - F.col("np"))).alias("fn")
    )


def adjacency_f1(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Neighbour relations of predicted and true cells per table, with rates.

    Cells are shuffled once, by table, and all windows and counts stand there; a
    table of more than ``LARGE_TABLE`` cells is dealt by row, column and pair.
    """
    side = lambda df, predicted: df.select("table_id", "r", "c", "text", F.lit(predicted).alias("predicted"))
    cells = side(pred, True).unionByName(side(truth, False))
    # At most one row for LARGE_TABLE cells of the input, so it may go to every task.
    large = F.broadcast(cells.groupBy("table_id").agg(F.count("*").alias("n")).where(F.col("n") > LARGE_TABLE).select("table_id"))
    small = cells.join(large, "table_id", "left_anti").repartition("table_id")
    sums = _adjacency_counts(small).unionByName(_adjacency_counts(cells.join(large, "table_id", "left_semi")))
    return sums.select("*", *rates(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")))


def detection_f1(pred: DataFrame, truth: DataFrame, cell_w: float, cell_h: float, min_iou: float = HIT_IOU) -> DataFrame:
    """Boxes matched best first at the overlap; unmatched ones are false positives and negatives. One row."""
    match = match_best_first(overlap_pairs(truth, pred, cell_w, cell_h).where(F.col("iou") >= min_iou))
    counts = match.agg(F.count("*").alias("tp")).join(pred.agg(F.count("*").alias("pred_n")), F.lit(True)).join(truth.agg(F.count("*").alias("truth_n")), F.lit(True))
    return counts.select("*", *rates(F.col("tp"), F.col("pred_n"), F.col("truth_n")))


def figure_caption_score(pred: DataFrame, truth: DataFrame, cell_w: float, cell_h: float) -> DataFrame:
    """Per page: figures hit and captions linked (token Jaccard from one half, or the smaller set of two or more contained)."""
    ta, tb = tokens_of(F.col("a_caption")), tokens_of(F.col("b_caption"))
    inter, small = F.size(F.array_intersect(ta, tb)), F.least(F.size(ta), F.size(tb))
    linked = (jaccard(ta, tb) >= 0.5) | ((small >= 2) & (inter == small))
    pairs = overlap_pairs(truth, pred, cell_w, cell_h, ["caption"]).where(F.col("iou") >= HIT_IOU)
    match = match_best_first(pairs.withColumn("linked", linked), keep=["linked"])
    hits = match.groupBy("page").agg(F.count("*").alias("hits"), F.count_if("linked").alias("linked"))
    size = truth.groupBy("page").agg(F.count("*").alias("truth_n")).join(pred.groupBy("page").agg(F.count("*").alias("pred_n")), "page", "full_outer")
    return size.join(hits, "page", "left").na.fill(0)


def heading_accuracy(pred: DataFrame, truth: DataFrame, least: float = 0.8) -> DataFrame:
    """Per document: truth headings found (token Jaccard) and found with the right level.

    Headings (doc, uid, level, text) meet on their rarest tokens; the first
    predicted heading that passes decides the level.
    """
    sets = lambda df: df.select("doc", "uid", tokens_of(F.col("text")).alias("items"))
    level = lambda df, p: df.select("doc", F.col("uid").alias(p), F.col("level").alias(p + "_level"))
    close = similar_sets(sets(truth), sets(pred), ["doc"], least).join(level(truth, "a"), ["doc", "a"]).join(level(pred, "b"), ["doc", "b"])
    first = close.groupBy("doc", "a", "a_level").agg(F.min_by("b_level", "b").alias("b_level"))
    found = first.groupBy("doc").agg(F.count("*").alias("matched"), F.count_if(F.col("a_level") == F.col("b_level")).alias("level_ok"))
    total = truth.groupBy("doc").agg(F.count("*").alias("total"))
    out = total.join(found, "doc", "left").na.fill(0)
    return out.withColumn("accuracy", F.round(F.col("level_ok") / F.col("total"), 3))


def kendall_tau(ranks: DataFrame) -> DataFrame:
    """Order agreement per document of two rankings (doc, a, b), both without ties, b from 0.

    Discordant pairs are counted without listing pairs: at each bit of ``b`` the
    rows that share the higher bits are read in ``a`` order, and every 0 counts
    the 1s before it. That is one row per bit instead of one per pair.
    """
    width = ranks.groupBy("doc").agg(F.count("*").alias("n"), F.max("b").alias("top"))
    levels = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.col("top") + 1)) - 1).cast("int"))
    rows = ranks.join(width, "doc").select("doc", "a", "b", F.explode(levels).alias("lv"))
    rows = rows.select("doc", "a", "lv", F.expr("shiftright(b, lv + 1)").alias("high"), F.expr("shiftright(b, lv) & 1").alias("bit"))
    before = Window.partitionBy("doc", "lv", "high").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ones", F.coalesce(F.sum("bit").over(before), F.lit(0)))
    bad = rows.where("bit = 0").groupBy("doc").agg(F.sum("ones").alias("discordant"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    out = width.join(bad, "doc", "left").withColumn("discordant", F.coalesce("discordant", F.lit(0)))
    return out.select("doc", "n", "discordant", F.round(F.when(pairs == 0, 1.0).otherwise(1 - F.try_divide(2 * F.col("discordant"), pairs)), 6).alias("tau"))


def text_distance(a: str, b: str) -> int:
    """Edit distance of two texts of any length, a whole column of the table at a time.

    What both texts begin and end with costs nothing. Along the rest, the
    differences between neighbours of a column are bits of two integers, so one
    character of ``b`` is a handful of operations on integers as long as ``a``.
    """
    while a != b and a and b and a[0] == b[0]:  # doubling steps find the end of a long common start
        step = 1
        while step * 2 <= min(len(a), len(b)) and a[: step * 2] == b[: step * 2]:
            step *= 2
        a, b = a[step:], b[step:]
    while a != b and a and b and a[-1] == b[-1]:
        step = 1
        while step * 2 <= min(len(a), len(b)) and a[-step * 2 :] == b[-step * 2 :]:
            step *= 2
        a, b = a[:-step], b[:-step]
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    rest = iter(long)
    if all(c in rest for c in short):  # only lacks characters: as many as the lengths differ by, the least any two texts can be apart
        return len(long) - len(short)
    where = _places(a)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, score = full, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        level = (((same & rises) + rises) ^ rises) | same | falls
        up, down = falls | (full & ~(level | rises)), rises & level
        score += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & full, down << 1 & full
        rises, falls = down | (full & ~(level | up)), up & level
    return score


def _places(text: str) -> dict[str, int]:
    """For each character the positions it stands at, as bits."""
    at: dict[str, list[int]] = {}
    for i, c in enumerate(text):
        at.setdefault(c, []).append(i)
    out = {}
    for c, places in at.items():
        bits = np.zeros(len(text) // 8 + 1, np.uint8)
        np.bitwise_or.at(bits, np.array(places) >> 3, (1 << (np.array(places) & 7)).astype(np.uint8))
        out[c] = int.from_bytes(bits.tobytes(), "little")
    return out


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else text_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def edit_distance(a: str | Column, b: str | Column) -> Column:
    """``text_distance`` of two columns in Arrow batches; null for a null text."""
    return F.pandas_udf(_distances, "bigint")(a, b)


def _compared(t: pd.Series, p: pd.Series, tw: pd.Series, pw: pd.Series) -> pd.DataFrame:
    """Distance of two texts, and how many words of the first the second holds, each as often as it occurs."""
    found = [sum((Counter(a) & Counter(b)).values()) if a is not None and b is not None else 0 for a, b in zip(tw, pw, strict=True)]
    return pd.DataFrame({"char_dist": _distances(t, p), "found": found})


def cer_counts(pairs: DataFrame) -> DataFrame:
    """Character distance of whole (doc, truth, pred) texts without spaces, and the share of truth words found (bag overlap), a row a pair."""
    t, p = F.replace(norm_text(F.col("truth")), F.lit(" "), F.lit("")), F.replace(norm_text(F.col("pred")), F.lit(" "), F.lit(""))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    # A distance is heavy for its few bytes, so rows are dealt by number, which adaptive execution does not fold into few tasks.
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = pairs.repartition(tasks, "doc").select("doc", t.alias("t"), p.alias("p"), words("truth").alias("tw"), words("pred").alias("pw"))
    met = F.pandas_udf(_compared, "char_dist bigint, found bigint")("t", "p", "tw", "pw")
    sized = texts.select("doc", F.length("t").cast("long").alias("char_n"), F.coalesce(F.size("tw"), F.lit(0)).alias("word_n"), met.alias("met"))
    return sized.select("doc", "met.char_dist", "char_n", "met.found", F.greatest("word_n", F.lit(0)).cast("long").alias("word_n")).na.fill(0)


def line_exactness(lines: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth lines (source, text) that occur exactly, trimmed, among the read lines."""
    have = lines.select(F.trim("text").alias("k")).distinct().withColumn("hit", F.lit(True))
    rows = truth.select("source", F.trim("text").alias("k")).join(have, "k", "left")
    return rows.groupBy("source").agg(F.count("*").alias("lines"), F.count("hit").alias("exact"))


def _placed(words: pd.Series, own: pd.Series, beside: pd.Series) -> pd.DataFrame:
    """For each part how many of its words its own evidence holds, and how many only that beside it."""
    rows = []
    for part, *seen in zip(words, own, beside, strict=True):
        here, near = ({w for w in x if w is not None} for x in seen)
        mine = sum(w in here for w in part)
        rows.append((mine, sum(w in near and w not in here for w in part)))
    return pd.DataFrame(rows, columns=["own", "neighbour"], dtype="int64")


def placement_score(parts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Words of each part found in its own evidence, only next to it, or nowhere; rows on both sides are (doc, pos, words).

    Words stay in the array of their part, so a row that is shuffled is a part
    and not a word. Parts are dealt once, by stretches of ``NEAR_PARTS``
    positions of a document, and evidence at an end goes to the next stretch too.
    """
    stretch = lambda by: F.floor((F.col("pos") + by) / NEAR_PARTS)
    none = F.array().cast("array<string>")
    one = parts.select("doc", "pos", F.coalesce("words", none).alias("words"), F.lit(True).alias("part"), stretch(0).alias("at"))
    seen = evidence.where(F.col("doc").isNotNull()).select("doc", "pos", F.array_distinct("words").alias("words"), F.lit(False).alias("part"), F.explode(F.array_distinct(F.array(stretch(-1), stretch(0), stretch(1)))).alias("at"))
    around = Window.partitionBy("doc", "at").orderBy("pos").rangeBetween(-1, 1)
    rows = one.unionByName(seen).withColumn("held", F.collect_list(F.when(~F.col("part"), F.struct("pos", "words"))).over(around)).where("part")
    there = lambda own: F.flatten(F.transform(F.filter("held", lambda x: (x["pos"] == F.col("pos")) == own), lambda x: F.coalesce(x["words"], none)))
    met = F.pandas_udf(_placed, "own bigint, neighbour bigint")(F.col("words"), there(True), there(False))
    sums = rows.select("doc", F.size("words").alias("n"), met.alias("met")).groupBy("doc")
    return sums.agg(F.sum("n").alias("total"), F.sum("met.own").alias("own"), F.sum("met.neighbour").alias("neighbour")).where("total > 0")


def furniture_score(lines: DataFrame) -> DataFrame:
    """Per document: truth furniture that was not removed, and body lines that were.

    ``lines`` is (doc, text, removed, truth, body); the flags tell which of the
    three a line is, and equal texts of a document count once.
    """
    flags = ("removed", "truth", "body")
    rows = lines.where("removed OR truth OR body").select("doc", norm_text(F.col("text")).alias("k"), *flags)
    keys = rows.groupBy("doc", "k").agg(*[F.bool_or(c).alias(c) for c in flags])
    gone = F.coalesce("removed", F.lit(False))
    counted = keys.groupBy("doc").agg(F.count_if(gone).alias("removed"), F.count_if(F.col("truth") & ~gone).alias("missing"), F.count_if(F.col("body") & gone).alias("leaked"))
    return counted.where("removed > 0 OR missing > 0")


def footnote_links(notes: DataFrame, refs: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth marks (doc, mark) that have a note and a reference to it."""
    ok = notes.select("doc", "mark").distinct().join(refs.select("doc", "mark").distinct(), ["doc", "mark"])
    rows = truth.select("doc", "mark").distinct().join(ok.withColumn("linked", F.lit(True)), ["doc", "mark"], "left")
    return rows.groupBy("doc").agg(F.count("*").alias("total"), F.count("linked").alias("linked"))


def word_agreement(a: DataFrame, b: DataFrame, cell_w: float, cell_h: float, same_text: bool = True) -> DataFrame:
    """Per page: words of two engines and how many agree one to one at the overlap, with equal text if asked."""
    pairs = overlap_pairs(a, b, cell_w, cell_h, ["text"] if same_text else []).where(F.col("iou") >= HIT_IOU)
    if same_text:
        pairs = pairs.where("a_text = b_text")
    hit = match_best_first(pairs).groupBy("page").agg(F.count("*").alias("matched"))
    size = a.groupBy("page").agg(F.count("*").alias("a_n")).join(b.groupBy("page").agg(F.count("*").alias("b_n")), "page", "full_outer")
    return size.join(hit, "page", "left").na.fill(0)


def pool_components(rows: DataFrame, group: str, weights: dict[str, float]) -> DataFrame:
    """Component rates pooled over pages (group, component, num, den), with the weighted composite of those present."""
    pooled = rows.groupBy(group).pivot("component", list(weights)).agg(F.try_divide(F.sum("num"), F.sum("den")))
    weight = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0))
    return pooled.withColumn("composite", F.try_divide(total, weight))


# Chebyshev fit of the complementary error function (Numerical Recipes), constant term first.
ERFC_FIT = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def erfc(x: Column) -> Column:
    t = 1 / (1 + 0.5 * F.abs(x))
    fit = F.lit(0.0)
    for coefficient in reversed(ERFC_FIT):
        fit = fit * t + coefficient
    tail = t * F.exp(-x * x + fit)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def paired_compare(pairs: DataFrame) -> DataFrame:
    """Paired differences (id, d) per ``category``: wins, mean, Cohen d_z and the Wilcoxon signed-rank test.

    Ranks average over ties of |d|. They are read from counts per distinct
    |d| and a running count split by value band, so no category is sorted in
    one task. The p value is the one-sided normal one (first side larger) with
    tie and continuity correction.
    """
    by = ["category"]
    all_ = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"),
        F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"),
    )
    nonzero = pairs.where("d <> 0").select(*by, F.abs("d").alias("m"), (F.col("d") > 0).cast("int").alias("up"))
    counts = nonzero.groupBy(*by, "m").agg(F.count("*").alias("c"), F.sum("up").alias("up"))
    upto = split_running_sum(counts, by, ["m"], value_band(F.col("m")), F.col("c"), "hi")
    rank = F.col("hi") - (F.col("c") - 1) / 2
    sums = upto.groupBy(*by).agg(
        F.sum(rank * F.col("up")).alias("w_plus"), F.sum("c").alias("m_n"), F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c")).alias("tie_term")
    )
    n = F.col("m_n").cast("double")
    total = n * (n + 1) / 2
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    z = F.try_divide(F.col("w_plus") - total / 2 - 0.5, F.sqrt(variance))
    out = all_.join(sums, by, "left")
    return out.select(
        *by, "n", "wins", "losses", "ties", F.round("mean", 4).alias("mean"), F.round(F.try_divide("mean", "sd"), 6).alias("cohen_dz"),
        F.col("w_plus"), F.round(F.try_divide(2 * F.col("w_plus") - total, total), 6).alias("rank_biserial"),
        F.coalesce(F.round(0.5 * erfc(z / F.sqrt(F.lit(2.0))), 6), F.when(F.col("m_n").isNull(), 1.0)).alias("p"),
    )


def _poisson_sums(batches: Iterator[pd.DataFrame], resamples: int, seed: int) -> Iterator[pd.DataFrame]:
    """Weighted sums per category and resample of the rows of one task, 512 rows at a time."""
    steps = np.cumsum([0.36787944117144233 / factorial(k) for k in range(12)])
    draws = np.arange(resamples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    sums: dict = {}
    for batch in batches:
        for category, rows in batch.groupby("category", sort=False):
            total, weight = sums.setdefault(category, (np.zeros(resamples), np.zeros(resamples)))
            ids, d = rows["h"].to_numpy().astype(np.uint64), rows["d"].to_numpy(dtype=float)
            for at in range(0, len(d), 512):
                x = ids[at : at + 512, None] ^ draws[None, :]
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
                w = np.searchsorted(steps, u * (1.0 / (1 << 53)), side="right")
                total += d[at : at + 512] @ w
                weight += w.sum(axis=0)
    for category, (total, weight) in sums.items():
        yield pd.DataFrame({"category": category, "s": np.arange(resamples), "wd": total, "w": weight})


def bootstrap_ci(pairs: DataFrame, resamples: int = 10_000, seed: int = 20261009, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean difference per category over seeded resamples of the pairs.

    Each row draws a Poisson weight per resample from a hash of (seed,
    resample, id), the one-pass form of the bootstrap for spread-out data. A
    task adds up its own rows and sends one partial sum per category and
    resample; a re-run task draws the same weights.
    """
    rows = pairs.select("category", F.xxhash64("id").alias("h"), F.col("d").cast("double").alias("d"))
    part = rows.mapInPandas(partial(_poisson_sums, resamples=resamples, seed=seed), "category string, s long, wd double, w double")
    means = part.groupBy("category", "s").agg(F.sum("wd").alias("wd"), F.sum("w").alias("w"))
    means = means.select("category", F.try_divide("wd", "w").alias("mean"))
    tail = (1 - level) / 2
    return pick_ranks(means, ["category"], "mean", {"lo": F.floor(tail * F.col("n")), "hi": F.ceil((1 - tail) * F.col("n")) - 1})
