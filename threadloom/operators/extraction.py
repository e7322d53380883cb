"""Graph tables out of block text: references, links, tags, attributes, tasks, containment, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import markup as m
from threadloom.functions.windows import range_position, split_row_number
from threadloom.session import cut_lineage


def extract_refs(blocks: DataFrame) -> DataFrame:
    """(src, dst_kind, dst) once per block. Works inside the row, so nothing is shuffled."""
    pages = F.transform(m.page_refs(F.col("text")), lambda x: F.struct(F.lit("page").alias("dst_kind"), x.alias("dst")))
    uids = F.transform(m.block_refs(F.col("text")), lambda x: F.struct(F.lit("block").alias("dst_kind"), x.alias("dst")))
    return blocks.select(F.col("uid").alias("src"), F.explode(F.concat(pages, uids)).alias("r")).select("src", "r.*")


def extract_links(blocks: DataFrame, pattern: str = m.MARKDOWN_LINK, label_group: int = 1, url_group: int = 2) -> DataFrame:
    """(uid, pos, url, label): every link of a block in text order; label falls back to the url."""
    pairs = F.arrays_zip(
        m.all_matches(F.col("text"), pattern, url_group).alias("url"),
        m.all_matches(F.col("text"), pattern, label_group).alias("label"),
    )
    rows = blocks.select("uid", F.posexplode(pairs).alias("pos", "link"))
    label = F.trim("link.label")
    return rows.select(
        "uid", "pos", F.col("link.url").alias("url"), F.when(label != "", label).otherwise(F.col("link.url")).alias("label")
    )


def extract_tags(blocks: DataFrame) -> DataFrame:
    return blocks.select("uid", F.posexplode(m.tag_names(F.col("text"))).alias("pos", "tag"))


def extract_attributes(blocks: DataFrame) -> DataFrame:
    """``Name:: value`` children as (owner, ord, name, value)."""
    text = F.col("text")
    return blocks.select(
        "owner", "ord", m.attribute_name(text).alias("name"), m.attribute_value(text).alias("value")
    ).where(F.col("name").isNotNull())


def extract_highlights(blocks: DataFrame) -> DataFrame:
    text = F.col("text")
    return blocks.select("uid", m.highlight_color(text).alias("color"), F.posexplode(m.highlights(text)).alias("pos", "span"))


def highlight_rows(annotations: DataFrame, groups: DataFrame, placed: DataFrame) -> DataFrame:
    """Annotations (uid, doc, page, text) with colour, owning group and whether a card shows them."""
    flags = placed.select("uid").distinct().withColumn("placed", F.lit(True))
    return (
        annotations.withColumn("color", m.highlight_color(F.col("text")))
        .join(groups.select("doc", "group"), "doc", "left")
        .join(flags, "uid", "left")
        .withColumn("placed", F.coalesce("placed", F.lit(False)))
    )


def page_chips(rows: DataFrame) -> DataFrame:
    """Highlights per document page with the count and the first uid; pages must be whole numbers from 1."""
    return rows.where(F.col("page") >= 1).groupBy("doc", "page").agg(
        F.count("*").alias("n"), F.min("uid").alias("first_uid"), F.count_if("placed").alias("n_placed")
    )


def task_meta(tasks: DataFrame, attributes: DataFrame, today: Column, names: dict[str, str]) -> DataFrame:
    """Tasks (uid, text) with state, status tag and the first child per known attribute.

    ``names`` maps a lower-case attribute name to its field. The first value per
    field is kept by a partial aggregate, so a task with many children is not sorted.
    """
    text = F.col("text")
    fields = sorted(set(names.values()))
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    known = attributes.withColumn("field", F.element_at(lookup, F.lower("name"))).where(F.col("field").isNotNull())
    first = known.groupBy(F.col("owner").alias("uid")).pivot("field", fields).agg(F.min_by("value", "ord"))
    state = F.regexp_extract(text, m.TASK_STATE, 1)
    base = tasks.select("uid", state.alias("state"), F.trim(F.regexp_extract(text, m.STATUS_TAG, 1)).alias("status"))
    due_text = F.regexp_replace("due", r"^\[\[([\s\S]+)\]\]$", "$1")
    due = m.daily_title_date(due_text)
    return (
        base.where(F.col("state") != "")
        .join(first, "uid", "left")
        .withColumn("due_day", due)
        .withColumn("done", F.col("state") == "DONE")
        .withColumn("cancelled", F.lower("status") == "cancelled")
        .withColumn("overdue", F.coalesce((F.col("due_day") < today) & ~F.col("done"), F.lit(False)))
        .withColumn("due_today", F.coalesce(F.col("due_day") == today, F.lit(False)))
    )


def closure_of_levels(levels: Sequence[DataFrame]) -> DataFrame:
    """(anc, desc, depth) of a tree whose levels are known: each frame holds (uid, parent) of one level.

    The parent's ancestor list rides along as an array no longer than the number
    of levels, so each level costs one join and the pairs come from one explode.
    """
    out, above = None, None
    for level in levels:
        if above is None:
            here = level.select("uid", F.array().cast("array<string>").alias("chain"))
        else:
            up = above.select(F.col("uid").alias("parent"), F.concat("chain", F.array("uid")).alias("chain"))
            here = level.join(up, "parent").select("uid", "chain")
            pairs = here.select(
                F.col("uid").alias("desc"), F.size("chain").alias("__n"), F.posexplode("chain").alias("__i", "anc")
            ).select("anc", "desc", (F.col("__n") - F.col("__i")).alias("depth"))
            out = pairs if out is None else out.unionByName(pairs)
        above = here
    return out


def closure_of_edges(parents: DataFrame, max_depth: int = 100) -> DataFrame:
    """(anc, desc, depth) of a containment table (uid, parent) of unknown depth.

    One join per level on the parent edge, the lineage cut each time. A cycle
    would never end, so passing ``max_depth`` is an error rather than a cut.
    """
    edges = cut_lineage(parents.where(F.col("parent").isNotNull()).select("uid", "parent").distinct())
    frontier = edges.select(F.col("parent").alias("anc"), F.col("uid").alias("desc"), F.lit(1).alias("depth"))
    out = frontier
    for depth in range(2, max_depth + 2):
        step = frontier.join(edges.withColumnRenamed("uid", "anc"), "anc").select(
            F.col("parent").alias("anc"), "desc", F.lit(depth).alias("depth")
        )
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            return out.groupBy("anc", "desc").agg(F.min("depth").alias("depth"))
        if depth > max_depth:
            raise ValueError(f"containment deeper than {max_depth}: is there a cycle?")
        out = out.unionByName(frontier)
    return out


def outline_order(nodes: DataFrame) -> DataFrame:
    """Depth-first position of nodes that carry ``path``, the padded sibling orders from the root down; paths sort as text."""
    return range_position(nodes, ["path"])


def reading_order(items: DataFrame, band: int = 200) -> DataFrame:
    """Items (container, uid, x, y) in rows of ``band`` height, then x, y, uid."""
    row = F.floor(F.col("y") / band)
    ordered = items.withColumn("row", row)
    return split_row_number(ordered, ["container"], ["row", "x", "y", "uid"], F.col("row"), "pos")


def board_contents(sections: DataFrame, members: DataFrame) -> DataFrame:
    """Sections (uid, title, depth, path) with their direct member count."""
    counts = members.groupBy(F.col("parent").alias("uid")).agg(F.count("*").alias("members"))
    return sections.join(counts, "uid", "left").withColumn("members", F.coalesce("members", F.lit(0)))


def trail_stops(stops: DataFrame) -> DataFrame:
    """Stops (trail, ord, uid, card) numbered along each trail, with the first stop per card as badge."""
    numbered = split_row_number(stops, ["trail"], ["ord", "uid"], F.floor(F.col("ord") / 1000), "pos")
    badge = numbered.groupBy("trail", "card").agg(F.min("pos").alias("badge"))
    return numbered.join(badge, ["trail", "card"])


def date_source(items: DataFrame, mentions: DataFrame) -> DataFrame:
    """Items (uid, title, text) dated by themselves, and by their first and last dated mention.

    The own date is the title when it names a day, else a ``Date::``/``Due::``
    value, else the first ISO day in the text.
    """
    value = F.trim(F.regexp_extract("text", r"(?i)(?:^|\n)\s*(?:Date|Due)::\s*([^\n]+)", 1))
    bare = F.regexp_replace(value, r"^\[\[|\]\]$", "")
    own = F.coalesce(
        m.daily_title_date(F.col("title")), m.daily_title_date(bare), m.iso_date(bare), m.iso_date(F.col("text"))
    )
    spans = mentions.groupBy("uid").agg(F.min("day").alias("f"), F.max("day").alias("l"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd")
    return items.join(spans, "uid", "left").select(
        "uid", show(own).alias("by_attribute"), show("f").alias("by_first"), show("l").alias("by_last")
    )


def board_path(closure: DataFrame, titles: DataFrame, sep: str = " > ") -> DataFrame:
    """Root-first titles above each block; the list is as long as the tree is deep."""
    named = closure.join(titles, "anc").groupBy("desc").agg(F.collect_list(F.struct(-F.col("depth"), "title")).alias("up"))
    return named.select(
        F.col("desc").alias("uid"), F.array_join(F.transform(F.array_sort("up"), lambda x: x["title"]), sep).alias("path")
    )
