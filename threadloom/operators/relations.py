"""Joins over the note graph: links, neighbours, membership sources, diffs, components, suggestions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.windows import split_row_number, split_running_sum, top_per_key
from threadloom.operators.extraction import extract_refs
from threadloom.session import cut_lineage, written

# Caps and ranks of the note graph.
MIRROR_HOPS = 8
SNAPSHOT_KEEP = 10
KIND_RANK = {"tree": 1, "ref": 2, "attr": 3}
DAY_US = 86_400_000_000


def _label_list(labels: Column) -> Column:
    """Attribute names by name, ``mentions`` last, as one string."""
    named = F.array_sort(F.filter(labels, lambda x: x != "mentions"))
    return F.array_join(F.concat(named, F.filter(labels, lambda x: x == "mentions")), ", ")


def graph_links(refs: DataFrame, holders: DataFrame, from_cards: DataFrame, to_cards: DataFrame, below_board: DataFrame) -> DataFrame:
    """Links between cards: a block that cites B and lies on or below A gives A -> B.

    ``refs`` is (src, dst, attr), ``holders`` (src, anc) lists the page and
    ancestors of a block and the block itself. Blocks below the board are left
    out first, then both card filters cut the references before the grouping.
    """
    outside = refs.join(below_board.select("src"), "src", "left_anti")
    ends = outside.join(to_cards.select(F.col("target").alias("dst"), F.col("card").alias("to_card")), "dst")
    pairs = ends.join(holders, "src").join(from_cards.select(F.col("target").alias("anc"), F.col("card").alias("from_card")), "anc")
    label = F.coalesce("attr", F.lit("mentions"))
    grouped = pairs.where(F.col("from_card") != F.col("to_card")).groupBy("from_card", "to_card").agg(
        F.collect_set(label).alias("labels"),
        F.max(F.when(F.col("attr").isNotNull(), KIND_RANK["attr"]).otherwise(KIND_RANK["ref"])).alias("rank"),
        F.count_distinct("src").alias("n"),
        F.min("src").alias("first_source"),
    )
    kind = F.when(F.col("rank") == KIND_RANK["attr"], "attr").otherwise("ref")
    return grouped.select(
        "from_card", "to_card", kind.alias("kind"), _label_list(F.col("labels")).alias("labels"),
        F.col("n").alias("n_sources"), "first_source",
    )


def filter_links(links: DataFrame, mode: str = "all") -> DataFrame:
    if mode == "off":
        return links.limit(0)
    return links.where(F.col("kind") == "attr") if mode == "attributes" else links


def covered_by(links: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visible links, covered edges): an explicit edge between the pair, either way, hides the link."""
    key = lambda a, b: [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]
    keyed_links = links.select("*", *key("from_card", "to_card"))
    keyed_edges = edges.select("*", *key("from_uid", "to_uid"))
    visible = keyed_links.join(keyed_edges.select("lo", "hi"), ["lo", "hi"], "left_anti").drop("lo", "hi")
    covered = keyed_edges.join(keyed_links.select("lo", "hi"), ["lo", "hi"], "left_semi").drop("lo", "hi")
    return visible, covered


def card_ref_links(texts: DataFrame, index: DataFrame) -> DataFrame:
    """Links written on cards: texts (card, uid, text, attr) cite targets listed in index (dst_kind, dst, card)."""
    refs = extract_refs(texts.select(F.struct("card", "uid", "attr").alias("uid"), "text"))
    hits = refs.join(index.withColumnRenamed("card", "to_card"), ["dst_kind", "dst"])
    links = hits.select(F.col("src.card").alias("from_card"), "to_card", F.col("src.attr").alias("attr"), F.col("src.uid").alias("uid"))
    return links.where(F.col("from_card") != F.col("to_card")).groupBy("from_card", "to_card").agg(
        F.when(F.max("attr").isNotNull(), "attr").otherwise("ref").alias("kind"),
        F.collect_set(F.coalesce("attr", F.lit("mentions"))).alias("labels"),
    )


def tree_links(cards: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent to child links of a followed outline, between cards (card, target) present on the board."""
    child = cards.select(F.col("card").alias("to_card"), F.col("target").alias("uid")).join(parents, "uid")
    above = cards.select(F.col("card").alias("from_card"), F.col("target").alias("parent"))
    return child.join(above, "parent").where(F.col("from_card") != F.col("to_card")).select("from_card", "to_card").distinct().select(
        "from_card", "to_card", F.lit("tree").alias("kind"), F.array().cast("array<string>").alias("labels")
    )


def merge_links(sets: Sequence[DataFrame]) -> DataFrame:
    """Union of link sets: the strongest kind and every label per pair."""
    rank = F.when(F.col("kind") == "attr", 3).when(F.col("kind") == "ref", 2).otherwise(1)
    rows = reduce(DataFrame.unionByName, sets).withColumn("rank", rank).withColumn("label", F.explode_outer("labels"))
    merged = rows.groupBy("from_card", "to_card").agg(F.max_by("kind", "rank").alias("kind"), F.collect_set("label").alias("labels"))
    return merged.withColumn("labels", _label_list(F.col("labels")))


def neighbors(refs: DataFrame, cap: int | None = None) -> DataFrame:
    """Per item: outgoing titles, attribute-valued titles, and citing pages by count, numbered; with ``cap`` so many each.

    ``refs`` is (item, item_title, relation in|out, title, attr, seq). The item's
    own title and the attribute's name page are left out.
    """
    rows = refs.where((F.col("title") != F.col("item_title")) & (F.coalesce(F.col("attr") != F.col("title"), F.lit(True))))
    relation = F.when(F.col("relation") == "in", "in").when(F.col("attr").isNotNull(), "attr").otherwise("out")
    rows = rows.where((F.col("relation") == "out") | F.col("attr").isNull()).withColumn("relation", relation)
    counted = rows.groupBy("item", "relation", "title").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    weight = F.when(F.col("relation") == "in", -F.col("n")).otherwise(F.col("seq"))
    ranked = top_per_key(counted.withColumn("weight", weight), ["item", "relation"], ["weight", "title"], cap)
    return ranked.drop("weight", "seq")


def related(neighbor_rows: DataFrame, limit: int | None = None) -> DataFrame:
    """One ordered list per item: attributes, then links to, then linked from by count."""
    order = F.when(F.col("relation") == "attr", 0).when(F.col("relation") == "out", 1).otherwise(2)
    rows = neighbor_rows.withColumnRenamed("pos", "within").withColumn("section", order)
    return top_per_key(rows, ["item"], ["section", "within", "title"], limit, "pos")


def linked_refs(refs: DataFrame) -> DataFrame:
    """Blocks (uid, page) that cite each target once, without the target itself and its own page.

    Nearly every row is its own, so a hash map would hold a task's rows. They are
    dealt and sorted instead, which spills; a minimum of structs keeps the
    aggregate on that order.
    """
    rows = refs.where((F.col("uid") != F.col("target")) & (F.col("page") != F.col("target"))).select("target", "uid", "page")
    once = rows.repartition("target", "page", "uid").groupBy("target", "page", "uid").agg(F.min(F.struct("uid")).alias("block"))
    return once.select("target", F.col("block.uid").alias("uid"), "page")


REF_UID = r"\A[\w-]+\z"


def group_linked_refs(refs: DataFrame, skip: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(target, page) with the number of citing blocks and the first of them; blocks of ``skip`` (uid) and malformed uids are left out.

    With ``whole`` a group has all its blocks, in order (``uids``), and its
    position among the groups of its target: most references first, then by
    page. Such a group is one row, as long as a page has citing blocks.

    Blocks are counted on the order that ``linked_refs`` leaves. As they are dealt
    by block too, a page with very many references to one target is not one task.
    """
    rows = refs if skip is None else refs.join(skip.select("uid").distinct(), "uid", "left_anti")
    blocks = linked_refs(rows.where(F.col("uid").cast("string").rlike(REF_UID))).groupBy("target", "page")
    if not whole:
        grouped = blocks.agg(F.count("*").alias("n"), F.min(F.struct("uid")).alias("first"))
        return grouped.select("target", "page", "n", F.col("first.uid").alias("first_uid"))
    grouped = blocks.agg(F.array_sort(F.collect_list("uid")).alias("uids"))
    sized = grouped.select("target", "page", F.size("uids").cast("long").alias("n"), F.col("uids")[0].alias("first_uid"), "uids")
    return top_per_key(sized, ["target"], [F.col("n").desc(), "page"], None)


def group_refs_by_year(refs: DataFrame, cap: int | None = None) -> DataFrame:
    """References per target by year (the newest ``cap`` of them, if given), with the total and the number left out."""
    totals = refs.groupBy("target").agg(F.count("*").alias("total"))
    shown = refs if cap is None else top_per_key(refs, ["target"], [F.col("time").desc(), "uid"], cap)
    years = shown.groupBy("target", F.year("time").alias("year")).agg(F.count("*").alias("n"))
    return years.join(totals, "target").withColumn("hidden", F.lit(0) if cap is None else F.greatest(F.lit(0), F.col("total") - cap))


def boards_with(direct: DataFrame, via: DataFrame, boards: DataFrame) -> DataFrame:
    """Boards (version 2) that hold a block below them or through a citing card, with the first card."""
    rows = direct.select("uid", "board", F.lit(None).cast("string").alias("card")).unionByName(via.select("uid", "board", "card"))
    first = rows.groupBy("uid", "board").agg(F.min("card").alias("card"), F.bool_or(F.col("card").isNull()).alias("direct"))
    return first.join(boards.where("version = 2").select("board", "title"), "board")


def connection_index(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Edges with validity: each end is an item, or an edge between two items.

    Edges meet the items once and are written with what was found. Those between
    two items are settled; of the others, only ends that are no item are looked
    up among them, and an edge with an end that is neither stays out of the
    second look-up.
    """
    known = items.select("uid").distinct()

    def end_known(rows: DataFrame, end: str, among: DataFrame, flag: str) -> DataFrame:
        return rows.join(among.select(F.col("uid").alias(end)).withColumn(flag, F.lit(True)), end, "left")

    marked = end_known(end_known(edges, "from_uid", known, "from_ok"), "to_uid", known, "to_ok")
    marked = written(marked.select("uid", "from_uid", "to_uid", "label", F.coalesce("from_ok", F.lit(False)).alias("from_ok"), F.coalesce("to_ok", F.lit(False)).alias("to_ok")))
    both = F.col("from_ok") & F.col("to_ok")
    plain = marked.where(both).select("uid").distinct()
    left = marked.where(~both)
    parts = [marked.where(both)]
    for end, flag, other in (("from_uid", "from_ok", "to_ok"), ("to_uid", "to_ok", "from_ok")):
        parts.append(end_known(left.where(F.col(other) & ~F.col(flag)).drop(flag), end, plain, flag))
    neither = end_known(end_known(left.where(~F.col("from_ok") & ~F.col("to_ok")).drop("from_ok", "to_ok"), "from_uid", plain, "from_ok"), "to_uid", plain, "to_ok")
    out = reduce(DataFrame.unionByName, [*parts, neither])
    return out.select("uid", "from_uid", "to_uid", "label", (F.coalesce("from_ok", F.lit(False)) & F.coalesce("to_ok", F.lit(False))).alias("valid"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(uid, component): smallest uid reachable over undirected edges (a, b).

    Alternates the large-star and small-star steps of the published two-phase
    algorithm, which needs about log(n) rounds even on long chains. Each round
    is two grouped minima (combined before the shuffle) joined back to the
    edges; a hub is a skewed join key on the edge side, which adaptive
    execution splits. Lineage is cut each round.
    """
    nodes = edges.select(F.col("a").alias("uid")).union(edges.select("b")).distinct()
    current = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("x"), F.least("v", "m").alias("y"))
        tied = small.where("x <> y").unionByName(low.select(F.col("u").alias("x"), F.col("m").alias("y")))
        current = cut_lineage(tied.select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
        after = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state:
            roots = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "uid")
            return nodes.join(roots, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
        state = after


def suggest_pairs(
    cards: DataFrame, names: DataFrame, existing: DataFrame, dismissed: DataFrame, limit: int | None = None, cap: int | None = None, mentions: DataFrame | None = None
) -> DataFrame:
    """Unlinked card pairs of a board that share a name (score 2) or of which one names the other without a link (1), best first.

    ``mentions`` (uid, title_uid, title) come from ``unlinked_mentions``. The
    strongest reason of a pair stays: the least shared name, else the title that
    the smaller uid mentions, else the other's. No board is refused. With
    ``limit`` boards of more cards are left out (they are in ``too_many``), and
    with ``cap`` a board keeps its first pairs. The pairs are the result, so
    their number sets the cost.
    """
    rows = names.select("board", "uid", "name").distinct()
    members = cards.select("board", "uid").distinct()
    if limit is not None:
        small = members.groupBy("board").agg(F.count("*").alias("n")).where(F.col("n") <= limit).select("board")
        rows, members = rows.join(small, "board", "left_semi"), members.join(small, "board", "left_semi")
    a, b = rows.withColumnRenamed("uid", "a"), rows.withColumnRenamed("uid", "b")
    found = a.join(b, ["board", "name"]).where("a < b").groupBy("board", "a", "b").agg(F.min("name").cast("string").alias("reason"), F.lit(2).alias("score"))
    if mentions is not None:
        named = mentions.join(members, "uid").join(members.withColumnRenamed("uid", "title_uid"), ["board", "title_uid"]).where("uid <> title_uid")
        first = F.min_by("title", F.struct("uid", (-F.length("title")).alias("l"), "title"))
        weak = named.groupBy("board", F.least("uid", "title_uid").alias("a"), F.greatest("uid", "title_uid").alias("b")).agg(first.alias("reason"), F.lit(1).alias("score"))
        found = found.unionByName(weak.join(found, ["board", "a", "b"], "left_anti"))
    for known in (existing, dismissed):
        pair = known.select("board", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = found.join(pair, ["board", "a", "b"], "left_anti")
    return top_per_key(found, ["board"], [F.col("score").desc(), "a", "b"], cap)


def too_many(cards: DataFrame, limit: int) -> DataFrame:
    return cards.groupBy("board").agg(F.count_distinct("uid").alias("n")).where(F.col("n") > limit)


def mirror_cycles(follows: DataFrame, hops: int = MIRROR_HOPS) -> DataFrame:
    """(board, verdict, hops): boards that follow themselves, or reach themselves within ``hops``.

    Boards that nothing follows cannot lie on a cycle, so they are trimmed
    before the walk starts.
    """
    edges = cut_lineage(follows.select("board", "follows").distinct())
    own = edges.where("board = follows").select("board", F.lit("self").alias("verdict"), F.lit(0).alias("hops"))
    inner = edges.where("board <> follows")
    inner = cut_lineage(inner.join(inner.select(F.col("follows").alias("board")), "board", "left_semi"))
    walk = inner.select(F.col("board").alias("origin"), F.col("follows").alias("at"))
    found = []
    for hop in range(2, hops + 1):
        walk = walk.join(inner.select(F.col("board").alias("at"), "follows"), "at").select("origin", F.col("follows").alias("at")).distinct()
        walk = cut_lineage(walk)
        found.append(walk.where("origin = at").select(F.col("origin").alias("board"), F.lit("cycle").alias("verdict"), F.lit(hop).alias("hops")))
        walk = walk.where("origin <> at")
    cycles = reduce(DataFrame.unionByName, found).join(own, "board", "left_anti")
    return own.unionByName(cycles.groupBy("board", "verdict").agg(F.min("hops").alias("hops")))


def company(rows: DataFrame, cap: int = 6, span_us: int = DAY_US) -> DataFrame:
    """First ``cap`` other rows of the same owner within the span of each row, in time order.

    Rows (owner, uid, at) are numbered per owner; the number of rows before the
    span starts says which ranks to take, so each row reads ``cap + 1`` ranks
    instead of every row in its span. Both counts are split by day.
    """
    day = F.floor(F.col("at") / DAY_US)
    ranked = split_row_number(rows, ["owner"], ["at", "uid"], day, "rank")
    real = rows.select("owner", "at", "uid", F.lit(1).alias("one"), F.lit(1).alias("kind"))
    probe = rows.select("owner", (F.col("at") - span_us).alias("at"), "uid", F.lit(0).alias("one"), F.lit(0).alias("kind"))
    counted = split_running_sum(real.unionByName(probe), ["owner"], ["at", "kind", "uid"], day, F.col("one"), "before")
    starts = counted.where("kind = 0").select("owner", "uid", (F.col("at") + span_us).alias("at"), "before")
    wanted = starts.withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.col("before") + cap + 1)))
    other = ranked.select("owner", "rank", F.col("uid").alias("other"), F.col("at").alias("other_at"))
    hits = wanted.join(other, ["owner", "rank"]).where((F.col("other") != F.col("uid")) & (F.col("other_at") <= F.col("at") + span_us))
    return top_per_key(hits, ["owner", "uid"], ["rank"], cap).select("owner", "uid", "other", "pos")


def resurface(days: DataFrame, rows: DataFrame, intervals: Sequence[int] = (7, 30, 90, 365), cap: int = 6) -> DataFrame:
    """Rows (uid, day) within a day of ``page_day - interval``, nearest first, ``cap`` per page day and interval.

    A row reaches at most three page days per interval through an equi join on
    the day. Rows of one day all have the same distance, so only the first
    ``cap`` uids of a day can be shown: cutting there is exact, and keeps a
    crowded day out of the join.
    """
    first = top_per_key(rows, ["day"], ["uid"], cap, "__i").drop("__i")
    targets = days.select("page_day", F.explode(F.array(*[F.lit(i) for i in intervals])).alias("days_ago")).withColumn(
        "delta", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    )
    targets = targets.withColumn("day", F.date_add(F.col("page_day"), F.col("delta") - F.col("days_ago")))
    hits = targets.join(first, "day").withColumn("delta", F.abs("delta"))
    return top_per_key(hits, ["page_day", "days_ago"], ["delta", "uid"], cap).select("page_day", "days_ago", "uid", "delta", "pos")


def follow_children(blocks: DataFrame, cap: int | None = None) -> DataFrame:
    """Direct children of each source (owner, uid, ord, text), numbered, with a completeness flag; with ``cap`` the first of each owner."""
    rows = blocks.withColumn("blank", F.trim(F.coalesce("text", F.lit(""))) == "")
    if cap is None:
        return top_per_key(rows, ["owner"], ["ord", "uid"], None).withColumn("complete", F.lit(True))
    size = blocks.groupBy("owner").agg((F.count("*") <= cap).alias("complete"))
    return top_per_key(rows, ["owner"], ["ord", "uid"], cap, "pos").join(size, "owner")


def follow_diff(source: DataFrame, placed: DataFrame, skipped: DataFrame) -> DataFrame:
    """Per owner: pending, placed, dismissed and fresh counts of its source items.

    ``source`` is (owner, uid, blank, fresh). A placed item is never pending; a
    skipped one counts as dismissed.
    """
    on = placed.select("owner", "uid").distinct().withColumn("on_board", F.lit(True))
    off = skipped.select("owner", "uid").distinct().withColumn("skip", F.lit(True))
    rows = source.join(on, ["owner", "uid"], "left").join(off, ["owner", "uid"], "left")
    on_board = F.coalesce("on_board", F.lit(False))
    skip = F.coalesce("skip", F.lit(False))
    pending = ~on_board & ~skip & ~F.col("blank")
    return rows.groupBy("owner").agg(
        F.count_if(pending).alias("pending"),
        F.count_if(on_board).alias("placed"),
        F.count_if(~on_board & skip).alias("dismissed"),
        F.count_if(pending & F.col("fresh")).alias("fresh"),
    )


def dedupe_follow(waiting: DataFrame) -> DataFrame:
    """Items waiting in several lanes (item, lane_pos, skipped) belong to the first lane.

    Later lanes get a hint, or nothing when the first lane skipped the item.
    """
    lanes = waiting.groupBy("item", "lane_pos").agg(F.bool_or("skipped").alias("skipped"))
    first = lanes.groupBy("item").agg(F.min("lane_pos").alias("first_lane"), F.min_by("skipped", "lane_pos").alias("first_skipped"))
    role = (
        F.when(F.col("skipped") & (F.col("lane_pos") == F.col("first_lane")), "skip")
        .when(F.col("lane_pos") == F.col("first_lane"), "own")
        .when(F.col("first_skipped"), "suppressed")
        .when(F.col("skipped"), "skip")
        .otherwise("hint")
    )
    return lanes.join(first, "item").select("item", "lane_pos", "first_lane", role.alias("role"))


def moved_items(old: DataFrame, new: DataFrame) -> DataFrame:
    a = old.select("uid", F.col("heading").alias("was"))
    return a.join(new.select("uid", F.col("heading").alias("now")), "uid").where(~F.col("was").eqNullSafe(F.col("now")))


def diff_boards(prev: DataFrame, nxt: DataFrame, structure: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Added, removed and changed items between two versions; ``structural`` marks membership, parent or order changes."""
    a = prev.select("uid", F.struct(*structure).alias("s0"), F.struct(*content).alias("c0"))
    b = nxt.select("uid", F.struct(*structure).alias("s1"), F.struct(*content).alias("c1"))
    both = a.join(b, "uid", "full_outer")
    moved = ~F.col("s0").eqNullSafe(F.col("s1"))
    change = (
        F.when(F.col("s0").isNull(), "added").when(F.col("s1").isNull(), "removed").when(moved | ~F.col("c0").eqNullSafe(F.col("c1")), "changed")
    )
    return both.select("uid", change.alias("change"), moved.alias("structural")).where(F.col("change").isNotNull())


def partition_snapshots(snapshots: DataFrame, keep: int = SNAPSHOT_KEEP) -> DataFrame:
    """Snapshots (board, uid, at) flagged: the newest ``keep`` per board against older ones."""
    kept = top_per_key(snapshots, ["board"], [F.col("at").desc(), "uid"], keep).select("board", "uid", F.lit(True).alias("kept"))
    return snapshots.join(kept, ["board", "uid"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def plan_restore(snapshot: DataFrame, current: DataFrame, containers: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Operations that bring a board back to a snapshot: move when the old parent still exists and differs, props when a field differs."""
    was = snapshot.select("uid", F.col("parent").alias("old_parent"), F.struct(*fields).alias("old"))
    now = current.select("uid", "parent", F.struct(*fields).alias("new"))
    alive = containers.select(F.col("uid").alias("old_parent")).distinct().withColumn("alive", F.lit(True))
    rows = was.join(now, "uid").join(alive, "old_parent", "left")
    move = F.when(F.col("alive") & (F.col("old_parent") != F.col("parent")), "move")
    props = F.when(~F.col("old").eqNullSafe(F.col("new")), "props")
    return rows.select("uid", "old_parent", F.explode(F.array_compact(F.array(move, props))).alias("op"))


def namespace_parent(title: Column) -> Column:
    """``Project/Sub`` -> ``Project``; null without a slash inside the title."""
    name = F.trim(title)
    at = F.locate("/", name)
    return F.when((at > 1) & (at < F.length(name)), F.substr(name, F.lit(1), at - 1))


def named_by_precedence(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """First non-blank of the name columns, and which one it was."""
    filled = [F.when(F.trim(F.coalesce(F.col(n), F.lit(""))) != "", F.trim(n)) for n in names]
    origin = F.coalesce(*[F.when(f.isNotNull(), F.lit(n)) for f, n in zip(filled, names, strict=True)])
    return rows.withColumn("name", F.coalesce(*filled)).withColumn("name_from", origin)


def expand_candidates(nodes: DataFrame, placed: DataFrame, zones: Sequence[str], keep: int | None = None) -> DataFrame:
    """Ranked nodes (card, uid, zone, idx) in zone order, those already placed left out."""
    rank = F.array_position(F.array(*[F.lit(z) for z in zones]), F.col("zone"))
    ranked = nodes.where(F.col("zone").isin(list(zones))).join(placed.select("card", "uid"), ["card", "uid"], "left_anti").withColumn("zone_rank", rank)
    return top_per_key(ranked, ["card"], ["zone_rank", "idx", "uid"], keep)


def arrow_homes(ends: DataFrame, items: DataFrame, closure: DataFrame) -> DataFrame:
    """Edge ends that are not on the board, each with the nearest board item that contains it."""
    away = ends.select(F.col("uid").alias("end")).distinct().join(items.select(F.col("uid").alias("end")), "end", "left_anti")
    above = closure.select(F.col("desc").alias("end"), "anc", "depth").join(items.select(F.col("uid").alias("anc")), "anc", "left_semi")
    home = above.join(away, "end", "left_semi").groupBy("end").agg(F.min_by("anc", "depth").alias("home"), F.min("depth").alias("up"))
    return away.join(home, "end", "left")


def arrows_from_outside(items: DataFrame, edges: DataFrame, boards: DataFrame, closure: DataFrame) -> DataFrame:
    """Edges drawn elsewhere to a card of a nested board (board, card, edge, other, place); ``place`` is the nearest board around the other end.

    ``items`` is (board, uid, type), ``edges`` (board, edge, from, to) and
    ``boards`` (uid). Sections are no cards; edges of the board itself, edges
    whose other end is on it too and other ends outside every board are left
    out. A card on several boards has its edges on each; repeated edges count once:
    they fall together at the end, where few of them are left to shuffle.
    """
    around = closure.join(boards.select(F.col("uid").alias("anc")), "anc", "left_semi")
    nested = boards.select(F.col("uid").alias("board")).join(around.select(F.col("desc").alias("board")), "board", "left_semi").distinct()
    on_board = items.select("board", "uid", "type").join(nested, "board", "left_semi")
    cards = on_board.where(~F.col("type").eqNullSafe("section")).select("board", F.col("uid").alias("card")).distinct()
    ends = F.explode(F.array(F.struct(F.col("from").alias("card"), F.col("to").alias("other")), F.struct(F.col("to").alias("card"), F.col("from").alias("other"))))
    drawn = edges.select(F.col("board").alias("home"), "edge", ends.alias("e")).select("home", "edge", "e.card", "e.other").where("card IS NOT NULL AND other IS NOT NULL")
    met = drawn.join(cards, "card").where(~F.col("home").eqNullSafe(F.col("board")))
    away = met.join(on_board.select("board", F.col("uid").alias("other")), ["board", "other"], "left_anti")
    place = around.groupBy(F.col("desc").alias("other")).agg(F.min_by("anc", F.struct("depth", "anc")).alias("place"))
    return away.join(place, "other").select("board", "card", "edge", "other", "place").distinct()
