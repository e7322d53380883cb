"""Filters over references, library rows and boards."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.markup import query_terms
from threadloom.functions.windows import positioned, range_position

# Limits of the reference query.
BETWEEN_DAYS = 31


@dataclass(frozen=True)
class Cites:
    """Leaf: blocks that cite this page or block."""

    target: str


@dataclass(frozen=True)
class All:
    args: tuple


@dataclass(frozen=True)
class Any_:
    args: tuple


@dataclass(frozen=True)
class Not:
    arg: object


def between(first: date, last: date) -> Any_:
    """Any daily page of the span; spans over 31 days are refused."""
    days = (last - first).days + 1
    if not 1 <= days <= BETWEEN_DAYS:
        raise ValueError(f"between spans {days} days, limit {BETWEEN_DAYS}")
    return Any_(tuple(Cites((first + timedelta(days=i)).isoformat()) for i in range(days)))


def _leaves(node) -> set[str]:
    if isinstance(node, Cites):
        return {node.target}
    if isinstance(node, Not):
        return _leaves(node.arg)
    return set().union(*[_leaves(a) for a in node.args])


def _check(node, inside_all: bool = False) -> None:
    if isinstance(node, Cites):
        return
    if isinstance(node, Not):
        if not inside_all:
            raise ValueError("not is only allowed inside all")
        return _check(node.arg)
    if isinstance(node, All) and all(isinstance(a, Not) for a in node.args):
        raise ValueError("all needs a positive clause")
    for arg in node.args:
        _check(arg, isinstance(node, All))


def _holds(node, names: dict[str, str]) -> Column:
    if isinstance(node, Cites):
        return F.col(names[node.target])
    if isinstance(node, Not):
        return ~_holds(node.arg, names)
    parts = [_holds(a, names) for a in node.args]
    return reduce(lambda a, b: a & b, parts) if isinstance(node, All) else reduce(lambda a, b: a | b, parts)


def ref_query(refs: DataFrame, tree) -> DataFrame:
    """Source uids of ``refs`` (src, dst) that satisfy the tree.

    The leaf targets are pushed to the scan as one IN filter; one grouped pass
    then keeps a flag per leaf and source, combined before the shuffle, and the
    tree becomes a filter on the flags. Cost does not grow with the tree.
    """
    _check(tree)
    targets = sorted(_leaves(tree))
    names = {target: f"leaf_{i}" for i, target in enumerate(targets)}
    flags = [F.bool_or(F.col("dst") == target).alias(name) for target, name in names.items()]
    return refs.where(F.col("dst").isin(targets)).groupBy("src").agg(*flags).where(_holds(tree, names)).select("src")


def query_rows(refs: DataFrame, tree, nodes: DataFrame, exclude: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Hits of a query: excluded uids dropped, newest edit first then uid, with total and text.

    Hits meet the texts once; the total is the last position of all hits, or with
    ``cap`` a count of the timed hits, and never a window over all rows.
    """
    hits = ref_query(refs, tree)
    if exclude is not None:
        hits = hits.join(exclude.select("src"), "src", "left_anti")
    timed = hits.join(nodes, hits["src"] == nodes["uid"]).drop("src")
    order = [F.col("edited").desc(), "uid"]
    if cap is None:
        shown = range_position(timed, order)
        return shown.join(shown.agg(F.max("pos").alias("total")), F.lit(True)).withColumn("partial", F.lit(False))
    shown = positioned(timed, order, cap)
    return shown.join(timed.agg(F.count("*").alias("total")), F.lit(True)).withColumn("partial", F.col("total") > cap)


def ref_leaf_hits(refs: DataFrame, leaves: DataFrame, children: DataFrame, on_page: DataFrame) -> DataFrame:
    """Per leaf: citing blocks, everything under them, and blocks on the leaf's page. Hot leaves keep all their rows, so ``partial`` is false."""
    direct = refs.join(leaves.select(F.col("leaf").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("leaf"), F.col("src").alias("uid")).distinct()
    under = direct.join(children.select(F.col("parent").alias("uid"), F.col("uid").alias("kid")), "uid").select("leaf", F.col("kid").alias("uid"))
    page = on_page.join(leaves.select("leaf"), "leaf", "left_semi").select("leaf", "uid")
    return direct.unionByName(under).unionByName(page).distinct().withColumn("partial", F.lit(False))


def library_filter(
    rows: DataFrame, *, types: list[str] = (), tag: str = "", text: str = "", days: int = 0, now_ms: int = 0, orphan: bool = False
) -> DataFrame:
    """Conjunction of library filters over (type, tags, lower, edited, on_board)."""
    out = rows
    if types:
        out = out.where(F.col("type").isin(list(types)))
    if tag:
        out = out.where(F.array_contains("tags", tag))
    for term in query_terms(text):
        out = out.where(F.col("lower").contains(term))
    if days:
        out = out.where(F.col("edited") > now_ms - days * 86_400_000)
    if orphan:
        out = out.where((F.col("type") != "board") & ~F.col("on_board"))
    return out


def meta_filter(
    rows: DataFrame, *, created_by: str = "", edited_by: str = "", refs: bool = False, children: bool = False,
    under: str = "", created_days: int = 0, now_ms: int = 0,
) -> DataFrame:
    out = rows
    if created_days:
        out = out.where(F.col("created") > now_ms - created_days * 86_400_000)
    for name, value in (("created_by", created_by), ("edited_by", edited_by), ("page_title", under)):
        if value:
            out = out.where(F.lower(name) == value.lower())
    if refs:
        out = out.where(F.col("refs") > 0)
    if children:
        out = out.where(F.col("children") > 0)
    return out


def browse(
    rows: DataFrame, *, now_ms: int, kinds: list[str] = (), under: str = "", days: int = 0, created_by: str = "",
    by: str = "edited", default_days: int = 30, limit: int | None = None,
) -> DataFrame:
    """Rows without search text: filters, then newest first. An unbounded browse looks back ``default_days``."""
    bounded = days > 0 or bool(under) or bool(kinds)
    window = days if days > 0 else (0 if bounded else default_days)
    out = rows
    if kinds:
        out = out.where(F.col("kind").isin(list(kinds)))
    if under:
        out = out.where(F.col("page_title") == under)
    if window:
        out = out.where(F.col(by) > now_ms - window * 86_400_000)
    if created_by:
        out = out.where(F.lower("created_by") == created_by.lower())
    return positioned(out, [F.col(by).desc_nulls_last(), "uid"], limit)


def library_search(parts: list[DataFrame], text: str, limit: int | None = None) -> DataFrame:
    """Union of typed scans (kind, uid, title, lower, edited), once per (kind, uid), best matches first."""
    terms = query_terms(text)
    rows = reduce(DataFrame.unionByName, [library_filter(p, text=text) for p in parts]).dropDuplicates(["kind", "uid"])
    starts = F.col("lower").startswith(terms[0]) if terms else F.lit(False)
    ranked = rows.select("kind", "uid", "title", starts.alias("__starts"))
    return positioned(ranked, [F.desc("__starts"), F.length("title"), "kind", "uid"], limit).drop("__starts")


def search_titles(pages: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Titles that contain the text: prefix matches, then shorter, then by name and uid."""
    needle = text.lower()
    low = F.lower("title")
    hits = pages.where(low.contains(needle)).withColumn("prefix", low.startswith(needle))
    return positioned(hits, [F.col("prefix").desc(), F.length("title"), low, "uid"], limit)


def orphans(items: DataFrame, under_board: DataFrame, cited_on_board: DataFrame) -> DataFrame:
    """Items (kind, uid) that are on no board, neither below one nor cited by a card; boards never count."""
    on = under_board.select("kind", "uid").unionByName(cited_on_board.select("kind", "uid"))
    return items.where(F.col("kind") != "board").join(on, ["kind", "uid"], "left_anti")


def table_filter(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    needle = text.strip().lower()
    if not needle:
        return rows
    return rows.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle) for c in columns]))


def bright_set(items: DataFrame, results: list[DataFrame]) -> DataFrame:
    """Items whose targets (array column) meet every result set; sections never light up."""
    cards = items.where(F.col("type") != "section").select("uid", F.explode("targets").alias("target"))
    out = None
    for hits in results:
        lit = cards.join(hits.select("target"), "target", "left_semi").select("uid").distinct()
        out = lit if out is None else out.join(lit, "uid", "left_semi")
    return out


def lens_catalog(cards: DataFrame) -> DataFrame:
    """Tags of cards (seq, uid, tags) in first-seen order with the number of cards that carry them."""
    seen = cards.select("seq", "uid", F.posexplode(F.array_distinct("tags")).alias("i", "tag"))
    return seen.groupBy("tag").agg(F.min(F.struct("seq", "i")).alias("f"), F.count("*").alias("cards")).select(
        "tag", F.col("f.seq").alias("first_seq"), F.col("f.i").alias("first_i"), "cards"
    )


def bucket_members(tags: DataFrame, attributes: DataFrame, *, tag: str = "", name: str = "", value: str = "") -> DataFrame:
    """Blocks bound to a tag bucket or to a ``Name:: value`` bucket."""
    if tag:
        return tags.where(F.col("tag") == tag).select("uid").distinct()
    same = (F.lower("name") == name.lower()) & (F.lower("value") == value.lower())
    return attributes.where(same).select(F.col("owner").alias("uid")).distinct()


def in_rectangle(items: DataFrame, x: float, y: float, w: float, h: float, mode: str = "contain") -> DataFrame:
    if mode == "contain":
        test = (F.col("x") >= x) & (F.col("y") >= y) & (F.col("x") + F.col("w") <= x + w) & (F.col("y") + F.col("h") <= y + h)
    else:
        test = (F.col("x") < x + w) & (F.col("x") + F.col("w") > x) & (F.col("y") < y + h) & (F.col("y") + F.col("h") > y)
    return items.where(test)


def outermost(selected: DataFrame, closure: DataFrame) -> DataFrame:
    """Selected items without a selected ancestor."""
    nested = closure.join(selected.select(F.col("uid").alias("anc")), "anc", "left_semi").select(F.col("desc").alias("uid"))
    return selected.join(nested, "uid", "left_anti")


def in_polygon(points: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Points (x, y) inside a polygon by the even-odd rule; the edge counts as inside.

    The polygon is part of the query, so the test is one column expression.
    """
    px, py = F.col("x"), F.col("y")
    crossings, on_edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon[-1:] + polygon[:-1], polygon, strict=True):
        cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        within = px.between(min(ax, bx), max(ax, bx)) & py.between(min(ay, by), max(ay, by))
        on_edge = on_edge | ((F.abs(cross) < 1e-9) & within)
        if ay != by:
            at = (ax - bx) * (py - by) / (ay - by) + bx
            crossings = crossings + (((F.lit(by) > py) != (F.lit(ay) > py)) & (px < at)).cast("int")
    return points.where(on_edge | (crossings % 2 == 1))


def container_of(points: DataFrame, boxes: DataFrame, cell_w: float, cell_h: float) -> DataFrame:
    """Innermost box per point: points and boxes meet on grid cells, then the bounds are checked.

    Boxes of equal bounds meet the points as one, with their number and their
    first id. Boxes spread over the cells they touch, and no size estimate sees
    how many those are, so both sides are sorted and merged; a crowded cell is
    an ordinary skewed join key, which adaptive execution splits.
    """
    gx = lambda c: F.floor(c / cell_w)
    gy = lambda c: F.floor(c / cell_h)
    alike = boxes.groupBy("x0", "y0", "x1", "y1").agg(F.min(F.struct("box")).alias("first"), F.count("*").alias("copies"))
    spread = alike.withColumn("cx", F.explode(F.sequence(gx(F.col("x0")), gx(F.col("x1"))))).withColumn(
        "cy", F.explode(F.sequence(gy(F.col("y0")), gy(F.col("y1"))))
    )
    near = points.withColumn("cx", gx(F.col("x"))).withColumn("cy", gy(F.col("y"))).join(spread.hint("merge"), ["cx", "cy"])
    inside = near.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return inside.groupBy("uid", "x", "y").agg(F.min_by("first.box", F.struct(area, "first.box")).alias("box"), F.sum("copies").alias("n_boxes"))


def neighbourhood_members(items: DataFrame, landmarks: DataFrame, screen_w: float, screen_h: float) -> DataFrame:
    """Members (board, landmark, uid) of each landmark's neighbourhood: itself and the items whose centre lies in it, edges included.

    The neighbourhood is centred on the landmark and at least a screen large.
    Centres and neighbourhoods meet on screen-sized cells of a board, so a board
    of any size is spread over its cells. A landmark without a box has itself only.
    """
    gx, gy = (lambda c: F.floor(c / screen_w)), (lambda c: F.floor(c / screen_h))
    mid_x, mid_y = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    half_w, half_h = F.greatest(F.col("w"), F.lit(screen_w)) / 2, F.greatest(F.col("h"), F.lit(screen_h)) / 2
    around = landmarks.select("board", F.col("uid").alias("landmark"), (mid_x - half_w).alias("x0"), (mid_x + half_w).alias("x1"), (mid_y - half_h).alias("y0"), (mid_y + half_h).alias("y1"))
    spread = around.withColumn("cx", F.explode(F.sequence(gx(F.col("x0")), gx(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(gy(F.col("y0")), gy(F.col("y1")))))
    centres = items.select("board", "uid", mid_x.alias("mx"), mid_y.alias("my"), gx(mid_x).alias("cx"), gy(mid_y).alias("cy"))
    inside = F.col("mx").between(F.col("x0"), F.col("x1")) & F.col("my").between(F.col("y0"), F.col("y1")) & (F.col("uid") != F.col("landmark"))
    found = spread.join(centres, ["board", "cx", "cy"]).where(inside).select("board", "landmark", "uid")
    return found.unionByName(around.select("board", "landmark", F.col("landmark").alias("uid")))


def same_value(items: DataFrame, seeds: DataFrame, column: str) -> DataFrame:
    """Items whose ``column`` equals a seed's, null matching null."""
    values = seeds.select(F.col(column).alias("__seed")).distinct()
    return items.join(values, items[column].eqNullSafe(values["__seed"]), "left_semi")
