"""Box overlap joins and one-to-one matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.session import cut_lineage

BOX = ("x0", "y0", "x1", "y1")
TILE = 4  # cells a side of the tiles that boxes are dealt by


def box_area(prefix: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{prefix}x1") - F.col(f"{prefix}x0")) * F.greatest(
        F.lit(0.0), F.col(f"{prefix}y1") - F.col(f"{prefix}y0")
    )


def overlap_pairs(a: DataFrame, b: DataFrame, cell_w: float, cell_h: float, carry: Sequence[str] = ()) -> DataFrame:
    """(page, a, b, inter, iou) of boxes (page, uid, x0..y1) that overlap, with ``a_`` and ``b_`` columns of what to ``carry``.

    Boxes spread over the tiles they touch and meet on (page, tile). A pair is
    kept only in the tile that holds the corner of its intersection, so no pair
    appears twice and no distinct is needed. Choose cells near the size of a
    box: then a tile of a few cells a side holds few boxes and most boxes lie
    in one or two tiles, so few copies of them are shuffled.

    A caller's filter on ``iou`` may run in the join before the test that boxes
    overlap. Boxes apart both ways can have a union of zero there, so the
    division must not fail; such pairs are no overlap and go in any case.
    """
    tile_w, tile_h = cell_w * TILE, cell_h * TILE

    def spread(df: DataFrame, p: str) -> DataFrame:
        cells = df.select("page", F.col("uid").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in (*BOX, *carry)])
        cells = cells.withColumn("cx", F.explode(F.sequence(F.floor(F.col(f"{p}_x0") / tile_w), F.floor(F.col(f"{p}_x1") / tile_w))))
        return cells.withColumn("cy", F.explode(F.sequence(F.floor(F.col(f"{p}_y0") / tile_h), F.floor(F.col(f"{p}_y1") / tile_h))))

    left, top = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    w, h = F.least("a_x1", "b_x1") - left, F.least("a_y1", "b_y1") - top
    met = spread(a, "a").join(spread(b, "b"), ["page", "cx", "cy"])
    met = met.where((w > 0) & (h > 0) & (F.col("cx") == F.floor(left / tile_w)) & (F.col("cy") == F.floor(top / tile_h)))
    inter = w * h
    iou = F.try_divide(inter, box_area("a_") + box_area("b_") - inter)
    carried = [f"{p}_{c}" for c in carry for p in "ab"]
    return met.select("page", "a", "b", inter.alias("inter"), iou.alias("iou"), *carried)


def similar_sets(a: DataFrame, b: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """(keys, a, b, na, nb, inter) of sets (keys, uid, items) of both sides with Jaccard of at least ``least``.

    Items are ordered from the rarest on; two sets that are alike enough share
    one of their first few, so only those meet, and only where both sizes leave
    room. An item that all sets hold joins nothing unless it is all they have.
    Items of a set are distinct and not null; empty sets are like nothing.
    """

    def spread(df: DataFrame, p: str) -> DataFrame:
        return df.select(*keys, F.col("uid").alias(p), F.size("items").alias("n" + p), F.explode("items").alias("item"))

    both = spread(a, "a").select("item").unionByName(spread(b, "b").select("item"))
    rarity = both.groupBy("item").agg(F.count("*").alias("__n"))

    def prefixes(df: DataFrame, p: str) -> DataFrame:
        met = spread(df, p).join(rarity, "item").groupBy(*keys, p, "n" + p).agg(F.array_sort(F.collect_list(F.struct("__n", "item"))).alias("__o"))
        items = F.transform("__o", lambda x: x["item"])
        first = F.slice(items, F.lit(1), (F.col("n" + p) - F.ceil(F.col("n" + p) * least - 1e-9) + 1).cast("int"))
        return met.select(*keys, p, "n" + p, items.alias("i" + p), F.explode(first).alias("item"))

    room = (F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9)
    near = prefixes(a, "a").join(prefixes(b, "b"), [*keys, "item"]).where(room)
    inter = F.size(F.array_intersect("ia", "ib"))
    shared = near.select(*keys, "a", "b", "na", "nb", inter.alias("inter")).distinct()
    return shared.where(F.col("inter") >= least * (F.col("na") + F.col("nb") - F.col("inter")) - 1e-9)


def match_best_first(pairs: DataFrame, score: str = "iou", keep: Sequence[str] = ()) -> DataFrame:
    """One-to-one matching (page, a, b, score, columns to ``keep``) of pairs: best score first, ties by ids.

    A pair that is the best choice of both its ends is taken by the greedy walk
    too; taking all such pairs and repeating on the rest gives the same result.
    Ends are compared only through their own candidates. A round writes its
    pairs once, marked; pairs of an end already taken drop out where the window
    over that end stands, so what is joined and written again are only pairs
    still in doubt.
    """
    best = F.struct((-F.col(score)).alias("s"), "a", "b")
    over_a, over_b = Window.partitionBy("page", "a"), Window.partitionBy("page", "b")
    rest, taken = pairs.select("page", "a", "b", score, *keep), None
    while True:  # every round takes the best pair of each page at least
        marked = rest.withColumn("__ba", F.min(best).over(over_a) == best).withColumn("__won", F.col("__ba") & (F.min(best).over(over_b) == best))
        marked = cut_lineage(marked.withColumn("__held", F.max("__won").over(over_b)).where("__won OR NOT __held").drop("__ba", "__held"))
        won, open_ = marked.where("__won").drop("__won"), marked.where("NOT __won").drop("__won")
        taken = won if taken is None else taken.unionByName(won)
        if open_.isEmpty():
            return taken
        rest = cut_lineage(open_.join(won.select("page", "a"), ["page", "a"], "left_anti"))
        if rest.isEmpty():
            return taken


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two distinct arrays; two empty ones are equal."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, 1.0).otherwise(inter / union)
