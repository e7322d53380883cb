"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source whose target is r times its size wants r copies of each document: the
whole part is taken outright, and the fractional part is rounded. Fractional
parts are rounded in pairs: of two probabilities, one takes as much of the
other's mass as makes one of the two 0 or 1, which of them at random in
proportion, so each keeps its expectation while their sum stays put. A fold
over a bounded group leaves one open document; the open ones of the groups meet
in the next level of a reduction tree, of which every level is one
pre-aggregatable shuffle of small rows. Groups hold documents of like size, so
what a group takes in words stays near its expectation too. A source with few
documents can still miss its target by a long document, so a few independent
roundings are made and each source uses the one nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.shared import Scratch, attach

GROUP = 256
MOST = 3.0
TRIES = 16
WORDS = "[^\\x20\\x09-\\x0D]+"


def draw(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its arguments."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST) -> DataFrame:
    """(src, source_size) -> with target: the whole size shared by weight, no source above ``most`` times its own.

    Sources in code-point order, null last, weigh ``weights`` in turn. Sharing an
    excess again and again by weight ends where target = min(most * size, level
    * weight) for one level; the level is read from running sums over sources
    ordered by the level at which they fill up. One row a source.
    """
    order = Window.orderBy(F.col("src").isNull(), "src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("cap") / F.col("w"))
    fill = Window.orderBy("full_at", F.col("src").isNull(), "src")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everyone).cast("double")).withColumn("all_w", F.sum("w").over(everyone))
    s = s.withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # The level, were this source the first that does not fill up; the true one is the first that is consistent.
    s = s.withColumn("level", (F.col("total") - F.col("filled")) / F.col("rest_w"))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everyone)["level"]
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("w")))
    return s.select("src", "source_size", target.alias("target"))


def _fold(entries: Column, seed: int, uid: str) -> Column:
    """One pass of pairwise pivotal steps over an array of (uid, size, p): the decided ones, and the one still open."""
    blank = F.struct(F.lit(None).cast(uid).alias("uid"), F.lit(0).cast("bigint").alias("size"), F.lit(0.0).alias("p"))
    kind = f"array<struct<uid:{uid},taken:int>>"
    begin = F.struct(F.array().cast(kind).alias("done"), blank.alias("open"))

    def step(acc: Column, x: Column) -> Column:
        a, b = acc["open"]["p"], x["p"]
        total = a + b
        u = draw(F.lit(seed), acc["open"]["uid"], x["uid"])
        # Below one: one of the two drops to 0 and hands over its mass. From one on: one is filled up to 1.
        x_stays = F.when(total < 1.0, u * total < b).otherwise(u * (2.0 - total) < (1.0 - b))
        decided = F.when(x_stays, acc["open"]["uid"]).otherwise(x["uid"])
        taken = F.when(total < 1.0, F.lit(0)).otherwise(F.lit(1))
        left = F.when(total < 1.0, total).otherwise(total - 1.0)
        keep = F.struct(
            F.when(x_stays, x["uid"]).otherwise(acc["open"]["uid"]).alias("uid"),
            F.when(x_stays, x["size"]).otherwise(acc["open"]["size"]).alias("size"),
            left.alias("p"),
        )
        first = F.struct(acc["done"].alias("done"), F.struct(x["uid"].alias("uid"), x["size"].alias("size"), x["p"].alias("p")).alias("open"))
        paired = F.struct(F.concat(acc["done"], F.array(F.struct(decided.alias("uid"), taken.alias("taken")))).alias("done"), keep.alias("open"))
        return F.when(acc["open"]["uid"].isNull(), first).otherwise(paired)

    return F.aggregate(entries, begin, step)


def size_band(size: Column) -> Column:
    return F.floor(F.log2(size + 1.0) * 8).cast("int")


def with_cells(df: DataFrame, by: list[Column], spread: Column, group: int = GROUP) -> DataFrame:
    """``df`` with ``cells``: into how many cells of about ``group`` rows its group of ``by`` is cut; null for one."""
    marked = df.withColumn("at", F.xxhash64(*by))
    many = marked.groupBy("at").agg(F.count("*").alias("c")).where(F.col("c") > group).select("at", F.ceil(F.col("c") / group).alias("cells"))
    return attach(marked, many, "at", spread, 16).drop("at")


def pivotal_rounding(scratch: Scratch, df: DataFrame, seed: int = 11, group: int = GROUP) -> DataFrame:
    """(uid, taken 0/1) for rows (key, size, uid, p, band, cells) with 0 < p < 1, summing to within one of the sum of p per ``key``.

    ``uid`` is a struct that tells the rows apart; its fields seed the draws.
    The first level folds within bands of like size, the others within keys. At
    each level a band or key is cut into as many cells as its own count asks
    for, so a hot one has many cells and a small one a single cell; the tree ends
    when every key has few enough open rows for one.
    """
    uid = df.schema["uid"].dataType.simpleString()
    decided: list[DataFrame] = []
    made, level = df, 0
    while True:
        last, cut = False, made
        if level:
            counts = made.groupBy("key").agg(F.count("*").alias("c"))
            last = (counts.agg(F.max("c")).first()[0] or 0) <= group
            cut = with_cells(made, [F.col("key")], F.col("uid"), group)
        keys = ["key", *(["band"] if level == 0 else []), F.pmod(F.xxhash64(F.lit(seed + level), "uid"), F.coalesce("cells", F.lit(1))).alias("cell")]
        entries = F.array_sort(F.collect_list(F.struct("size", "uid", "p")))
        folded = cut.groupBy(*keys).agg(entries.alias("e")).select("key", _fold("e", seed + level, uid).alias("f"))
        folded = scratch.keep(folded, f"level{level}")
        decided.append(folded.select(F.explode("f.done").alias("d")).select("d.uid", "d.taken"))
        made, level = folded.select("key", "f.open.uid", "f.open.size", "f.open.p"), level + 1
        if last:
            break
    out = made.select("uid", (draw(F.lit(seed), F.lit("close"), "uid") < F.col("p")).cast("int").alias("taken"))
    for d in decided:
        out = out.unionByName(d)
    return out


def mix_sources(
    df: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), id_col: str = "doc_id", text: str = "text", source: str = "source", most: float = MOST, seed: int = 11, tries: int = TRIES
) -> DataFrame:
    """The rows of ``df`` reduced to (id, source) with size, source_size, target, copies and taken words.

    Size is the number of runs of characters other than ASCII white space; a
    null or empty text has none and is never taken. A null source is a source of
    its own. Repeated rows are rounded each for itself (they are told apart by
    a count over equal ids). A source of size 0 has target 0. ``copies`` is at
    most the ceiling of target / source_size. The same input gives the same
    result, in any partitioning. An empty table gives no rows; other columns are
    ignored.
    """
    spark: SparkSession = df.sparkSession
    scratch = Scratch(spark, "mix")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint")
    sized = scratch.keep(df.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("src"), size.alias("size")), "sized")
    # Equal (id, source, size) rows are one row with a count; their copies are numbered when they are rounded.
    counted = sized.groupBy("id", "src", "size").agg(F.count("*").alias("times"))
    counted = scratch.keep(counted, "counted")
    sources = counted.groupBy("src").agg(F.sum(F.col("size") * F.col("times")).cast("bigint").alias("source_size"))
    targets = scratch.keep(source_targets(sources, weights, most).withColumn("key", F.xxhash64(F.col("src").isNull(), "src")), "targets")
    keyed = counted.withColumn("key", F.xxhash64(F.col("src").isNull(), "src"))
    met = attach(keyed, targets.drop("src"), "key", F.struct("id", "size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A ratio within rounding of a whole number is that number.
    near = F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(ratio)
    each = met.withColumn("whole", F.floor(near).cast("int")).withColumn("p", near - F.floor(near)).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    each = each.withColumn("uid", F.struct("id", "key", "size", "nth")).drop("times")
    each = scratch.keep(each, "each")
    open_rows = each.where((F.col("p") > 0) & (F.col("size") > 0)).withColumn("band", size_band(F.col("size")))
    # The tries of a source have the same groups, so these are counted and attached once, before the rows are repeated.
    celled = with_cells(open_rows, [F.col("key"), F.col("band")], F.col("uid"))
    tried = celled.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries)))).select(
        F.struct("key", "try").alias("key"), "size", F.struct("uid", "try").alias("uid"), "p", "band", "cells"
    )
    drawn = pivotal_rounding(scratch, scratch.keep(tried, "tried"), seed).select("uid.uid", "uid.try", "taken").withColumns({"key": F.col("uid.key"), "size": F.col("uid.size")})
    drawn = scratch.keep(drawn, "drawn")
    wanted = open_rows.groupBy("key").agg(F.sum(F.col("p") * F.col("size")).alias("wanted"))
    got = drawn.groupBy("key", "try").agg(F.sum(F.col("size") * F.col("taken")).alias("got"))
    best = got.join(wanted, "key").groupBy("key").agg(F.min(F.struct(F.round(F.abs(F.col("got") - F.col("wanted")), 3), "try"))["try"].alias("best"))
    rounded = attach(drawn, best, "key", F.col("uid")).where(F.col("try") == F.col("best")).select("uid", "taken")
    out = each.join(rounded, "uid", "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("taken", F.lit(0))).otherwise(F.lit(0))
    return out.select(
        F.col("id").alias(id_col), F.col("src").alias(source), "size", "source_size", "target", copies.alias("copies"), "nth",
        (copies * F.col("size")).cast("bigint").alias("taken"),
    )


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` repeated as the mix takes them; rows that it does not take go. Same columns."""
    id_col = options.get("id_col", "doc_id")
    source = options.get("source", "source")
    text = options.get("text", "text")
    plan = mix_sources(df, **options)
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint")
    copies = plan.groupBy(F.col(id_col).alias("__id"), F.col(source).alias("__src"), F.col("size").alias("__size")).agg(
        F.array_sort(F.collect_list(F.struct("nth", "copies"))).alias("__c")
    )
    rows = df.withColumn("__n", size).withColumn("__nth", F.row_number().over(Window.partitionBy(id_col, source, "__n").orderBy(text)))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source).cast("string").eqNullSafe(F.col("__src")) & (F.col("__n") == F.col("__size"))
    times = F.col("__c")[F.col("__nth") - 1]["copies"]
    met = rows.join(copies, same).withColumn("__t", times).where("__t > 0")
    return met.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__t")))).select(*[F.col(c) for c in df.columns])
