"""Sorts, caps per group, reading order over boards, and unions of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.windows import positioned, split_last_known, split_row_number, top_per_key

# Caps of the lists.
PER_PAGE = 2


def _number_key(digits: Column) -> Column:
    """Digit runs of any length in number order: how many digits, then the digits."""
    bare = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), 6, "0"), bare)


def natural_key(text: Column) -> Column:
    """Lower-case key in which runs of digits compare as numbers."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), _number_key(x)).otherwise(x)), "")


def sort_keys(sort: str) -> list[Column]:
    """Order of the eight row sorts; rows without the number come last, input order breaks ties."""
    table = {
        "best": [],
        "edited": [F.col("edited").desc_nulls_last()],
        "created": [F.col("created").desc_nulls_last()],
        "oldest": [F.col("created").asc_nulls_last()],
        "linked": [F.col("refs").desc_nulls_last()],
        "children": [F.col("children").desc_nulls_last()],
        "longest": [F.col("text_length").desc_nulls_last()],
        "title": [natural_key(F.col("title")).asc_nulls_last()],
    }
    return [*table[sort], F.col("seq")]


def sort_rows(rows: DataFrame, sort: str, limit: int | None = None) -> DataFrame:
    """Rows with their position ``pos`` in one of the eight sorts."""
    return positioned(rows, sort_keys(sort), limit)


def semantic_candidates(hits: DataFrame, per_page: int = PER_PAGE, limit: int | None = None) -> DataFrame:
    """Ranked hits (uid, page, rank) once per uid, at most ``per_page`` per page: ``pos`` on the page, ``place`` over all."""
    once = hits.groupBy("uid", "page").agg(F.min("rank").alias("rank"))
    return positioned(top_per_key(once, ["page"], ["rank", "uid"], per_page), ["rank", "uid"], limit, "place")


def heading_assign(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, pos, uid, is_heading) under their nearest heading at or before them."""
    return split_last_known(
        blocks, ["doc"], ["pos", "uid"], F.floor(F.col("pos") / 1000), F.when(F.col("is_heading"), F.col("uid")), "heading"
    )


def journal_window(blocks: DataFrame, last_day: str, days: int, cap: int | None = None) -> DataFrame:
    """Blocks (day, uid, ord) of the last ``days`` days, numbered; with ``cap`` so many a day, and the rest counted."""
    end = F.lit(last_day).cast("date")
    rows = blocks.where(F.col("day").between(F.date_sub(end, days - 1), end))
    size = rows.groupBy("day").agg((F.lit(0).cast("bigint") if cap is None else F.greatest(F.lit(0), F.count("*") - cap)).alias("more"))
    return top_per_key(rows, ["day"], ["ord", "uid"], cap).join(size, "day")


def inbox(entries: DataFrame, on_board: DataFrame, cap: int | None = None) -> DataFrame:
    """Blocks (uid, day, time) that cite the board from daily pages and are not on it, newest first."""
    fresh = entries.where(F.col("day").isNotNull()).groupBy("uid").agg(F.max("day").alias("day"), F.max("time").alias("time"))
    out = fresh.join(on_board.select("uid"), "uid", "left_anti")
    return positioned(out, [F.col("time").desc(), F.col("day").desc(), "uid"], cap)


def arrivals(pending: DataFrame, placed: DataFrame, allowance: int) -> DataFrame:
    """Pending items (owner, uid, ord) numbered; ``shown`` are those within the allowance less what the visit already placed, the rest waits."""
    used = placed.groupBy("owner").agg(F.count("*").alias("used"))
    numbered = top_per_key(pending, ["owner"], ["ord", "uid"], None)
    return numbered.join(used, "owner", "left").select("owner", "uid", "pos", (F.col("pos") <= F.greatest(F.lit(0), F.lit(allowance) - F.coalesce("used", F.lit(0)))).alias("shown"))


def walk_stops(landmarks: DataFrame, items: DataFrame, half_w: float, half_h: float, band: int = 200) -> DataFrame:
    """Landmarks (board, uid, x, y) in bucketed reading order with the number of items around each.

    Items and landmarks meet on (board, cell); a landmark is listed in the cells
    its viewport touches.
    """
    gx, gy = (lambda c: F.floor(c / (2 * half_w))), (lambda c: F.floor(c / (2 * half_h)))
    spread = landmarks.withColumn("cx", F.explode(F.sequence(gx(F.col("x") - half_w), gx(F.col("x") + half_w)))).withColumn(
        "cy", F.explode(F.sequence(gy(F.col("y") - half_h), gy(F.col("y") + half_h)))
    )
    cells = items.select("board", F.col("x").alias("ix"), F.col("y").alias("iy"), gx(F.col("x")).alias("cx"), gy(F.col("y")).alias("cy"))
    near = spread.join(cells, ["board", "cx", "cy"]).where(
        (F.abs(F.col("ix") - F.col("x")) <= half_w) & (F.abs(F.col("iy") - F.col("y")) <= half_h)
    )
    counts = near.groupBy("board", "uid").agg(F.count("*").alias("members"))
    row = F.floor(F.col("y") / band)
    ranked = split_row_number(landmarks.withColumn("row", row), ["board"], ["row", "x", "y", "uid"], F.col("row"), "pos")
    return ranked.join(counts, ["board", "uid"], "left").na.fill(0, ["members"])


def footnote_numbers(refs: DataFrame, defs: DataFrame, cap: int | None = None) -> DataFrame:
    """Known notes numbered by first reference (doc, note, pos), in each document; with ``cap`` later ones are overflow without number."""
    first = refs.join(defs.select("note"), "note", "left_semi").groupBy("doc", "note").agg(F.min("pos").alias("first_pos"))
    kept = top_per_key(first, ["doc"], ["first_pos", "note"], cap, "number").select("doc", "note", "number")
    return first.join(kept, ["doc", "note"], "left").withColumn("overflow", F.col("number").isNull())


def merge_semantic(keyword: DataFrame, semantic: DataFrame, limit: int | None = None) -> DataFrame:
    """Keyword rows, then semantic rows (uid, rank) not already shown (the best ``limit``, if given), in one order ``pos``."""
    extra = semantic.join(keyword.select("uid"), "uid", "left_anti").groupBy("uid").agg(F.min("rank").alias("rank"))
    if limit is not None:
        extra = extra.orderBy("rank", "uid").limit(limit)
    both = keyword.select("uid", "rank", F.lit(False).alias("semantic")).unionByName(extra.select("uid", "rank", F.lit(True).alias("semantic")))
    return positioned(both, ["semantic", "rank", "uid"])


def fill_free_pages(paid: DataFrame, free: DataFrame) -> DataFrame:
    """Pages the paid read lacks come from the other engine; a clashing block id gets a suffix; pages stay in order.

    Both frames are (doc, block_id, page, pos, text).
    """
    missing = free.join(paid.select("doc", "page").distinct(), ["doc", "page"], "left_anti")
    taken = paid.select("doc", "block_id").withColumn("taken", F.lit(True))
    renamed = missing.join(taken, ["doc", "block_id"], "left").withColumn(
        "block_id", F.when(F.col("taken"), F.concat("block_id", F.lit("~f"))).otherwise(F.col("block_id"))
    )
    return paid.withColumn("filled", F.lit(False)).unionByName(renamed.drop("taken").withColumn("filled", F.lit(True)))


def paid_pages_only(filled: DataFrame) -> DataFrame:
    return filled.where(~F.col("filled")).drop("filled")


def best_local_doc(reads: DataFrame, tiers: dict[str, int]) -> DataFrame:
    """Best parse per file (file, engine, at, uid): highest tier, then newest; unknown engines never win."""
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv]), F.col("engine"))
    ranked = reads.withColumn("tier", tier).where(F.col("tier").isNotNull())
    best = ranked.groupBy("file").agg(F.max(F.struct("tier", "at", "uid", "engine")).alias("m"), F.count("*").alias("reads"))
    return best.select("file", F.col("m.uid").alias("uid"), F.col("m.engine").alias("engine"), F.col("m.at").alias("at"), "reads")
