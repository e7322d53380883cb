"""Counts, spans, scores, timelines and groupings over the note graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.windows import split_running_sum, top_per_key

DAY_MS = 86_400_000

# Weights and half life of the link strength, dust periods, caps.
STRENGTH_PLAIN = {"refs": 0.60, "shared": 0.25, "recency": 0.15}
STRENGTH_OPENS = {"refs": 0.50, "shared": 0.20, "recency": 0.15, "opens": 0.15}
REFS_FULL, SHARED_FULL, OPENS_FULL = 12, 3, 10
HALF_LIFE_DAYS = 180
BUCKETS = 12
NO_LANE = "none"


def item_meta(items: DataFrame, refs: DataFrame, children: DataFrame) -> DataFrame:
    """Items (uid, created, edited, created_by, text_length) with reference and child counts."""
    r = refs.groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("refs"))
    c = children.groupBy(F.col("parent").alias("uid")).agg(F.count("*").alias("children"))
    return items.join(r, "uid", "left").join(c, "uid", "left").na.fill(0, ["refs", "children"])


def card_stats(targets: DataFrame, refs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per target: distinct outside references, distinct boards of citing cards, open and done tasks below it.

    ``refs`` is (dst, src, board, outside); ``tasks`` (owner, uid, done).
    """
    cites = refs.groupBy(F.col("dst").alias("uid")).agg(
        F.count_distinct(F.when(F.col("outside"), F.col("src"))).alias("refs"), F.count_distinct("board").alias("boards")
    )
    work = tasks.groupBy(F.col("owner").alias("uid")).agg(
        F.count_distinct(F.when(~F.col("done"), F.col("uid"))).alias("open"), F.count_distinct(F.when(F.col("done"), F.col("uid"))).alias("done")
    )
    return targets.join(cites, "uid", "left").join(work, "uid", "left").na.fill(0, ["refs", "boards", "open", "done"])


def comment_index(comments: DataFrame, legacy: DataFrame) -> DataFrame:
    """Comments per cell once per thread, with the first thread; the native count wins over a legacy count."""
    once = comments.groupBy("cell", "thread").agg(F.max("n").alias("n"))
    native = once.groupBy("cell").agg(F.sum("n").alias("native"), F.count("*").alias("threads"), F.min("thread").alias("first_thread"))
    total = F.coalesce(F.when(F.col("native") > 0, F.col("native")), F.col("legacy"), F.lit(0))
    return native.join(legacy, "cell", "full_outer").select("cell", "threads", "first_thread", total.cast("long").alias("comments"))


def reference_span(refs: DataFrame) -> DataFrame:
    """Exact reference count with first and last time per target."""
    return refs.groupBy("target").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def newest_references(refs: DataFrame, cap: int | None = None) -> DataFrame:
    return top_per_key(refs, ["target"], [F.col("at").desc(), "uid"], cap)


def time_histogram(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Equal-width time buckets per owner, zero filled; a zero span puts all rows in bucket 0."""
    span = rows.groupBy("owner").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    width = F.col("hi") - F.col("lo")
    slot = F.when(width <= 0, 0).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col("at") - F.col("lo")) * buckets / width)))
    counts = rows.join(span, "owner").groupBy("owner", slot.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    frame = span.select("owner", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return frame.join(counts, ["owner", "bucket"], "left").na.fill(0, ["n"])


def strength_score(edges: DataFrame, now_ms: int, track_opens: bool = False) -> DataFrame:
    """Score of each edge (refs, shared, last_ms[, opens]) between 0 and 1."""
    w = STRENGTH_OPENS if track_opens else STRENGTH_PLAIN
    age_days = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.col("last_ms")) / DAY_MS)
    recency = F.coalesce(F.exp(-F.log(F.lit(2.0)) * age_days / HALF_LIFE_DAYS), F.lit(0.0))
    part = lambda c, full: F.least(F.coalesce(F.col(c), F.lit(0)), F.lit(full)) / full
    score = w["refs"] * part("refs", REFS_FULL) + w["shared"] * part("shared", SHARED_FULL) + w["recency"] * recency
    if track_opens:
        score = score + w["opens"] * part("opens", OPENS_FULL)
    return edges.withColumn("strength", score)


def dusty(items: DataFrame, period_days: int, now_ms: int) -> DataFrame:
    """Items whose newest of edit and creation is at least the period old; without any time they are not dusty."""
    newest = F.greatest("edited", "created")
    return items.withColumn("age_days", F.floor((F.lit(now_ms) - newest) / DAY_MS)).where(newest <= now_ms - period_days * DAY_MS)


def latest_edit(edits: DataFrame) -> DataFrame:
    """Newest edit per item over its subtree rows (item, user, at, uid)."""
    newest = edits.groupBy("item").agg(F.max(F.struct("at", "uid", "user")).alias("m"))
    return newest.select("item", F.col("m.at").alias("at"), F.col("m.user").alias("user"))


def changed_since(edits: DataFrame, visits: DataFrame) -> DataFrame:
    return latest_edit(edits).join(visits, "item").where(F.col("at") > F.col("seen"))


def timeline_days(mentions: DataFrame, cap: int | None = None) -> DataFrame:
    """Dated mentions (day, card, page, edited) per day: count, distinct cards, newest page; with ``cap`` the newest days only."""
    days = mentions.groupBy("day").agg(
        F.count("*").alias("mentions"), F.count_distinct("card").alias("cards"), F.max(F.struct("edited", "page"))["page"].alias("page")
    )
    days = days.withColumn("year", F.year("day"))
    return days if cap is None else days.orderBy(F.col("day").desc()).limit(cap)


def first_last_mention(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("card").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n"))


def month_steps(start: Column, end: Column) -> Column:
    """Array of instants: start, each month boundary between, end."""
    inner = F.sequence(F.add_months(F.trunc(start, "month"), 1), F.greatest(end, F.add_months(F.trunc(start, "month"), 1)), F.expr("interval 1 month"))
    return F.array_distinct(F.concat(F.array(start), F.filter(inner, lambda d: (d > start) & (d < end)), F.array(end)))


def _counted_until(per_day: DataFrame, asked: DataFrame) -> DataFrame:
    """(day, upto) for each asked day: the sum of ``n`` over days at or before it.

    Counted days and asked days go along one calendar with a running sum, so no
    day meets another by an inequality.
    """
    line = per_day.select("day", "n", F.lit(False).alias("ask")).unionByName(asked.select("day", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("ask")))
    run = split_running_sum(line.withColumn("__all", F.lit(0)), ["__all"], ["day", "ask"], F.trunc("day", "year"), F.col("n"), "upto")
    return run.where("ask").select("day", "upto")


def as_of_sets(items: DataFrame, edges: DataFrame, times: DataFrame, fresh_days: int = 7) -> DataFrame:
    """At each time: items still in the future, items fresh within the last days, and edges with a future end.

    Items and edges are counted per day first; each time reads running counts of
    the calendar at its own day and ``fresh_days`` before. Null days never count.
    """
    at = times.select("t").distinct().withColumn("day", F.to_date("t")).withColumn("since", F.date_sub("day", fresh_days))
    asked = at.select("day").unionByName(at.select(F.col("since").alias("day"))).distinct()
    per_day = items.where("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("n"))
    day_of = items.select("uid", "day")
    ends = edges.join(day_of.select(F.col("uid").alias("from_uid"), F.col("day").alias("d0")), "from_uid").join(
        day_of.select(F.col("uid").alias("to_uid"), F.col("day").alias("d1")), "to_uid"
    )
    edge_days = ends.select(F.greatest("d0", "d1").alias("day")).where("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("n"))
    known = _counted_until(per_day, asked).join(_counted_until(edge_days, asked).withColumnRenamed("upto", "edges_upto"), "day")
    total = per_day.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items")).join(edge_days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ends")), F.lit(True))
    now = at.join(known, "day").join(known.select(F.col("day").alias("since"), F.col("upto").alias("before")), "since").join(total, F.lit(True))
    return now.select("t", (F.col("items") - F.col("upto")).alias("future"), (F.col("upto") - F.col("before")).alias("fresh"), (F.col("ends") - F.col("edges_upto")).alias("hidden_edges"))


def calendar_slots(cards: DataFrame, year: int, month: int) -> DataFrame:
    """Cards of a month by day, with each card's place on the month's axis from 0 to 1."""
    first, last = f"make_date({year}, {month}, 1)", f"last_day(make_date({year}, {month}, 1))"
    rows = cards.where(F.col("day").between(F.expr(first), F.expr(last)))
    axis = F.round(F.datediff("day", F.expr(first)) / F.datediff(F.expr(last), F.expr(first)), 6)
    return rows.select("uid", F.dayofmonth("day").alias("slot"), axis.alias("axis"))


def kanban_columns(rows: DataFrame, fixed: Sequence[str] = ("To do", "Done"), rest: str = "No status") -> DataFrame:
    """Cards (uid, value, seq) grouped by value: fixed columns always, others in first-seen order, empty values last."""
    value = F.when(F.trim(F.coalesce("value", F.lit(""))) == "", rest).otherwise(F.trim("value"))
    counts = rows.withColumn("column", value).groupBy("column").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    frame = rows.sparkSession.createDataFrame([(c, i) for i, c in enumerate(fixed)], "column string, fixed int")
    group = F.when(F.col("fixed").isNotNull(), 0).when(F.col("column") == rest, 2).otherwise(1)
    return frame.join(counts, "column", "full_outer").withColumn("n", F.coalesce("n", F.lit(0))).select("column", group.alias("grp"), "fixed", "first_seq", "n")


def lane_bands(rows: DataFrame, stored: Sequence[str], cap: int | None = None) -> DataFrame:
    """Rows (uid, value, seq) in attribute lanes: stored values first, then by first sight; with ``cap`` values past so many lanes are in none."""
    order = F.array_position(F.array(*[F.lit(s) for s in stored]), F.col("value"))
    seen = rows.where(F.col("value").isNotNull()).groupBy("value").agg(F.min("seq").alias("first_seq"))
    keyed = seen.withColumn("stored", order == 0).withColumn("rank", F.when(order > 0, order).otherwise(F.col("first_seq")))
    lanes = (keyed if cap is None else keyed.orderBy("stored", "rank", "value").limit(cap)).select("value", F.col("stored").alias("is_new"), F.lit(True).alias("kept"))
    out = rows.join(lanes, "value", "left")
    return out.select("uid", F.when(F.col("kept"), F.col("value")).otherwise(NO_LANE).alias("lane"), F.coalesce("is_new", F.lit(False)).alias("is_new"))


def attribute_table(attributes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cards by attribute: first value per name. Names are given, so the pivot needs no pass of its own."""
    return attributes.groupBy("owner").pivot("name", list(names)).agg(F.min_by("value", "ord"))


def attribute_names(attributes: DataFrame) -> DataFrame:
    """Attribute columns in first-seen order with their use count."""
    return attributes.groupBy("name").agg(F.min(F.struct("owner", "ord")).alias("f"), F.count("*").alias("n")).select(
        "name", F.col("f.owner").alias("first_owner"), F.col("f.ord").alias("first_ord"), "n"
    )


def link_legend(links: DataFrame, styles: DataFrame, hidden: DataFrame) -> DataFrame:
    """Names on attribute links (name, seq) in first-seen order with style and shown flag."""
    names = links.where("kind = 'attr'").groupBy("name").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    off = hidden.select("name").distinct().withColumn("hidden", F.lit(True))
    return names.join(styles, "name", "left").join(off, "name", "left").select(
        "name", "first_seq", "n", F.coalesce("color", F.lit("gray")).alias("color"), F.coalesce("dash", F.lit("solid")).alias("dash"), F.col("hidden").isNull().alias("shown")
    )
