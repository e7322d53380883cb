"""Cell tables: dense grids, text forms, audits and repairs.

A cell row is (table_id, r, c, row_span, col_span, text, header). Rows of one
table are grouped by (table_id, r) or (table_id, c), never by the table alone,
so one large table spreads over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.windows import split_previous, split_row_number, top_per_key
from threadloom.session import written


def cells_from_lines(lines: DataFrame) -> DataFrame:
    """Order lines as cells, one row a line; a line with flag A has its first cell span two columns.

    A line's row is its rank within the order. Line numbers repeat, so they are
    only the first sort key. The window holds one order, the size of a table.
    """
    fields = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]
    rank = F.row_number().over(Window.partitionBy("table_id").orderBy("l_linenumber", *fields))
    # Named before they are dealt, so the cells of a table count as dealt by it and what groups them by table or row shuffles nothing.
    # A line is small for the cells it makes, so lines are dealt by number, which adaptive execution does not fold into few tasks.
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = lines.select(F.col("l_orderkey").alias("table_id"), "l_linenumber", *fields).repartition(tasks, "table_id")
    first = dealt.withColumn("r", rank - 1)
    wide = F.col("l_returnflag") == "A"
    cell = lambda c, text, span: F.struct(F.lit(c).alias("c"), text.alias("text"), span.alias("col_span"))
    one = F.lit(1)
    made = F.filter(
        F.array(
            cell(0, F.concat(F.lit("part, "), "l_partkey"), F.when(wide, 2).otherwise(1)),
            cell(1, F.when(~wide, F.col("l_quantity").cast("long").cast("string")), one),
            cell(2, F.concat(F.lit('"'), "l_returnflag", F.lit('"')), one),
            cell(3, F.col("l_linestatus"), one),
        ),
        lambda x: x["text"].isNotNull(),
    )
    return first.select("table_id", "r", F.explode(made).alias("x")).select(
        "table_id", "r", "x.c", F.lit(1).alias("row_span"), "x.col_span", "x.text", (F.col("r") == 0).alias("header")
    )


def grid_rows(cells: DataFrame) -> DataFrame:
    """Every row of every table (table_id, r, spanned, slots): a slot (c, state, text, header, row_span, col_span) is an anchor, covered or a hole.

    Where spans overlap the first anchor in reading order owns the slot;
    ``spanned`` says whether any cell of the table has a span. Cells meet once,
    with a mark for each row of the table, and slots are made in the row: they
    are neither joined nor shuffled. A group is as wide as the table, not as long.
    """
    anchor = F.struct("r", "c", "text", "header", "row_span", "col_span")
    spread = cells.select("table_id", F.explode(F.sequence(F.col("r"), F.col("r") + F.col("row_span") - 1)).alias("gr"), anchor.alias("a"))
    size = cells.groupBy("table_id").agg(
        F.max(F.col("r") + F.col("row_span")).alias("rows"), F.max(F.col("c") + F.col("col_span")).alias("cols"),
        F.bool_or((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("spanned"),
    )
    marks = size.select("table_id", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("gr"), "cols", "spanned")
    met = spread.unionByName(marks, allowMissingColumns=True).groupBy("table_id", "gr").agg(
        F.collect_list("a").alias("a"), F.max("cols").alias("cols"), F.bool_or("spanned").alias("spanned")
    )
    slot = lambda i, hole, a: F.struct(i.alias("i"), F.lit(hole).alias("hole"), a.alias("a"))
    lies = F.filter("a", lambda x: x["c"].isNotNull() & x["col_span"].isNotNull())
    taken = F.flatten(F.transform(lies, lambda x: F.transform(F.sequence(x["c"], x["c"] + x["col_span"] - 1), lambda i: slot(i, 0, x))))
    none = F.get(F.filter("a", lambda x: F.lit(False)), F.lit(0))
    holes = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda i: slot(i, 1, none))
    # The first of the entries of a slot is its owner; a slot without any has only the hole.
    sorted_ = met.where("cols IS NOT NULL").select("table_id", F.col("gr").alias("r"), "cols", "spanned", F.array_sort(F.concat(taken, holes)).alias("s"))
    first = F.filter("s", lambda x, k: (x["i"] >= 0) & (x["i"] < F.col("cols")) & ((k == 0) | (F.get("s", k - 1)["i"] != x["i"])))
    return sorted_.select("table_id", "r", "spanned", F.transform(first, lambda x: _slot_of(x, F.col("r"))).alias("slots"))


def _slot_of(x: Column, row: Column) -> Column:
    a = x["a"]
    state = F.when(a.isNull(), "hole").when((a["r"] == row) & (a["c"] == x["i"]), "anchor").otherwise("covered")
    return F.struct(
        x["i"].alias("c"), state.alias("state"), a["text"].alias("text"), F.coalesce(a["header"], F.lit(False)).alias("header"),
        F.coalesce(a["row_span"], F.lit(1)).alias("row_span"), F.coalesce(a["col_span"], F.lit(1)).alias("col_span"),
    )


def table_grid(cells: DataFrame) -> DataFrame:
    """Every slot of every table: state anchor, covered or hole, with the anchor's text and span.

    Where spans overlap the first anchor in reading order owns the slot.
    """
    return grid_rows(cells).select("table_id", "r", F.inline("slots"))


def csv_lines(cells: DataFrame, sep: str = ",") -> DataFrame:
    """Quoted records (table_id, r, line); covered and empty slots are blank."""
    special = r'["\t\r\n]' if sep == "\t" else r'[",\r\n]'

    def quoted(x: Column) -> Column:
        text = F.when(x["state"] == "anchor", F.coalesce(x["text"], F.lit(""))).otherwise("")
        return F.when(text.rlike(special), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return grid_rows(cells).select("table_id", "r", F.array_join(F.transform("slots", quoted), sep).alias("line"))


def _html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def markdown_lines(cells: DataFrame) -> DataFrame:
    """Pipe rows for plain tables, HTML rows for tables with any span (table_id, r, line)."""

    def plain(x: Column) -> Column:
        return F.regexp_replace(F.replace(F.coalesce(x["text"], F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")

    def html(x: Column) -> Column:
        tag = F.when(x["header"], "th").otherwise("td")
        span = lambda name: F.when(x[f"{name}_span"] > 1, F.concat(F.lit(f' {name}span="'), x[f"{name}_span"].cast("string"), F.lit('"'))).otherwise("")
        return F.when(x["state"] == "covered", "").otherwise(F.concat(F.lit("<"), tag, span("row"), span("col"), F.lit(">"), _html(F.coalesce(x["text"], F.lit(""))), F.lit("</"), tag, F.lit(">")))

    line = F.when(F.col("spanned"), F.concat(F.lit("<tr>"), F.array_join(F.transform("slots", html), ""), F.lit("</tr>"))).otherwise(
        F.concat(F.lit("| "), F.array_join(F.transform("slots", plain), " | "), F.lit(" |"))
    )
    return grid_rows(cells).where("table_id IS NOT NULL").select("table_id", "r", line.alias("line"))


def flat_rows(cells: DataFrame, repeat: bool = True) -> DataFrame:
    """Dense cells with the anchor text repeated over its span, or blank in covered slots."""
    keep = F.col("state") != "hole" if repeat else F.col("state") == "anchor"
    return table_grid(cells).select("table_id", "r", "c", F.when(keep, F.coalesce("text", F.lit(""))).otherwise("").alias("text"))


# Pieces of a numeric cell: signs that carry no value, a digit run with group commas, a note mark behind it.
_BLANKS = r"[%±]*"
_DIGITS = r"\d(?:,?[%±]*\d)*"
_VALUE = rf"{_BLANKS}[-+]?{_BLANKS}(?:{_DIGITS}{_BLANKS}(?:\.{_BLANKS}(?:{_DIGITS})?)?|\.{_BLANKS}{_DIGITS}){_BLANKS}(?:[eE][-+]?\d+)?{_BLANKS}"
_NOTE = r"(?:(?<=[\d%])\(\d+\))?\s*(?:\[[A-Za-z0-9]+\])?"
NUMBER_CELL = rf"^\s*(?:{_VALUE}|\(\s*{_VALUE}\s*\)){_NOTE}\s*$"


def is_number(text: Column) -> Column:
    """Whether a cell reads as one number, with group commas, percent, a note mark behind it or brackets for a negative."""
    return text.rlike(NUMBER_CELL)


def column_alignment(cells: DataFrame, header_rows: int = 1, share: float = 0.8) -> DataFrame:
    """Filled body cells per column and whether enough of them are numbers to align right."""
    body = cells.where((F.col("r") >= header_rows) & (F.trim("text") != ""))
    return body.groupBy("table_id", "c").agg(
        F.count("*").alias("filled"), (F.avg(is_number(F.col("text")).cast("int")) >= share).alias("align_right")
    )


def validate_parse(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Audit rows (table_id, r, c, error): cells out of range, bad confidence, overlapping spans, missing tables.

    ``tables`` is (table_id, rows, cols). The audit is a table of findings, not an exception.
    """
    sized = cells.join(tables, "table_id", "left")
    outside = (F.col("r") + F.col("row_span") > F.col("rows")) | (F.col("c") + F.col("col_span") > F.col("cols")) | (F.col("r") < 0) | (F.col("c") < 0)
    errors = F.array_compact(
        F.array(
            F.when(F.col("rows").isNull(), "unknown table"),
            F.when(outside, "out of range"),
            F.when((F.col("conf") < 0) | (F.col("conf") > 1), "confidence"),
            F.when((F.col("row_span") < 1) | (F.col("col_span") < 1), "span"),
        )
    )
    single = sized.select("table_id", "r", "c", F.explode(errors).alias("error"))
    good = cells.where("row_span >= 1 AND col_span >= 1")
    spread = good.withColumn("rr", F.explode(F.sequence(F.col("r"), F.col("r") + F.col("row_span") - 1))).withColumn(
        "cc", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("col_span") - 1))
    )
    crowded = spread.groupBy("table_id", F.col("rr").alias("r"), F.col("cc").alias("c")).agg(F.count("*").alias("n")).where("n > 1")
    return single.unionByName(crowded.select("table_id", "r", "c", F.lit("overlap").alias("error")))


def validate_order(order: DataFrame, blocks: DataFrame) -> DataFrame:
    """Order ids that repeat or name no block, and blocks missing from the order (doc, block_id, error)."""
    seen = order.groupBy("doc", "block_id").agg(F.count("*").alias("n"))
    twice = seen.where("n > 1").select("doc", "block_id", F.lit("duplicate in order").alias("error"))
    lost = seen.join(blocks, ["doc", "block_id"], "left_anti").select("doc", "block_id", F.lit("order without block").alias("error"))
    unlisted = blocks.join(seen, ["doc", "block_id"], "left_anti").select("doc", "block_id", F.lit("block without order").alias("error"))
    return twice.unionByName(lost).unionByName(unlisted)


# Characters read for digits, the repair threshold, texts that stand for an empty number.
CONFUSED = {"O": "0", "o": "0", "D": "0", "Q": "0", "B": "8", "S": "5", "s": "5", "l": "1", "I": "1", "|": "1", "Z": "2", "G": "6", "Б": "6", "б": "6", "А": "4"}
NUMERIC_SHARE = 0.8
LOW_CONF = 0.3
PLACEHOLDER = r"(?i)^(?:[-–—]{1,3}|\*{1,3}|n/?a|nn)$"

_LOOKALIKES = "".join(c for c in CONFUSED if c not in "А|")
_DIGITISH = r"[\d" + "".join(CONFUSED) + r".,()%+\-–—\s]+"


def repair_number(text: Column, decimal: Column | None = None, pad: Column | None = None, digitless: bool = True) -> Column:
    """The number a cell stands for: rule bars and inner spaces gone, look-alikes read as digits, the column's decimal mark; null when it is none.

    ``decimal`` is the column's mark (default a period) and ``pad`` whether a
    bare leading mark gets a zero. A placeholder stays as it is. With
    ``digitless`` two look-alikes around a decimal mark are a number without any
    digit ("D.OD").
    """
    decimal, pad = F.lit(".") if decimal is None else decimal, F.lit(True) if pad is None else pad
    # What glues to digits without meaning: cell rules on both sides or behind, blanks between digits and marks.
    bare = F.regexp_replace(F.trim(text), r"^\|+(?=\d[\d.,]*\|+$)|(?<=\d)\|+$|(?<=[\d.,])\s+(?=[\d.,])", "")
    read = F.translate(bare, "".join(CONFUSED), "".join(CONFUSED.values()))
    sure = bare.rlike(r"\d") | bare.rlike(rf"[{_LOOKALIKES}]\s*[.,]\s*[{_LOOKALIKES}]") if digitless else bare.rlike(r"\d")
    digitish = bare.rlike(f"^{_DIGITISH}$") & sure

    def styled(v: Column) -> Column:
        halves = F.split(v, "[.,]")
        swap = v.rlike(r"^\d+[.,]\d{1,2}$") & (F.substring(v, F.length(halves[0]) + 1, 1) != decimal)
        out = F.when(swap, F.concat_ws("", halves[0], decimal, halves[1])).otherwise(v)
        return F.when(pad & out.rlike(r"^[.,]\d"), F.concat(F.lit("0"), out)).otherwise(out)

    options = F.array(F.struct(styled(bare).alias("v"), F.lit(True).alias("may")), F.struct(styled(read).alias("v"), digitish.alias("may")))
    fits = F.filter(options, lambda o: o["may"] & (is_number(o["v"]) | (o["v"].rlike(PLACEHOLDER) & (o["v"] == styled(bare)))))
    return F.get(fits, F.lit(0))["v"]


def numeric_column_repair(cells: DataFrame, header_rows: int = 0, share: float = NUMERIC_SHARE, digitless: bool = True) -> DataFrame:
    """Cells of mostly numeric columns with confused characters fixed, dashes unified and the rest marked low confidence.

    The column verdict, its decimal mark and whether it writes leading zeros are
    one aggregate per (table, column) joined back. ``digitless``: as in ``repair_number``.
    """
    body = cells.where((F.col("r") >= header_rows) & (F.col("col_span") == 1) & (F.trim("text") != ""))
    number, blank = is_number(F.col("text")), F.trim("text").rlike(PLACEHOLDER)
    judged = body.withColumn("good", number | blank).withColumn("number", number).withColumn("fix", repair_number(F.col("text"), digitless=digitless))
    columns = judged.groupBy("table_id", "c").agg(
        F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if(~F.col("good") & F.col("fix").isNotNull()).alias("n_fix"),
        F.count_if(F.col("number") & F.col("text").rlike(r"\d\.\d")).alias("points"), F.count_if(F.col("number") & F.col("text").rlike(r"\d,\d{1,2}(?!\d)")).alias("commas"),
        F.count_if(F.col("number") & F.col("text").rlike(r"^[.,]\d")).alias("bare"),
    )
    numeric = columns.where((F.col("n") >= 2) & (F.col("n_good") > 0) & (F.col("n_good") + F.col("n_fix") >= share * F.col("n"))).select(
        "table_id", "c", F.when(F.col("commas") > F.col("points"), ",").otherwise(".").alias("mark"), (F.col("bare") == 0).alias("pad")
    )
    rows = judged.join(numeric, ["table_id", "c"]).withColumn("fix", repair_number(F.col("text"), F.col("mark"), F.col("pad"), digitless))
    dash = F.trim("text").rlike(r"^[-–—]{1,3}$")
    to = F.when(dash, "—").when(F.col("good"), F.col("text")).otherwise(F.coalesce("fix", "text"))
    state = F.when(F.col("good") | dash, "kept").when(F.col("fix").isNotNull(), "fixed").otherwise("unsure")
    return rows.select("table_id", "r", "c", "text", to.alias("repaired"), state.alias("state"))


def table_tidy(cells: DataFrame) -> DataFrame:
    """Tables without empty rows, trailing empty columns and third or later copies of a row; rows renumbered.

    A row is compared with the two before it through a hash of its cells. Row
    numbers and neighbours are taken in bands of 10,000 rows, so a long table is
    not handled by one task.
    """
    filled = cells.withColumn("text", F.coalesce("text", F.lit(""))).where(F.trim("text") != "")
    width = filled.groupBy("table_id").agg((F.max("c") + 1).alias("width"))
    rows = filled.groupBy("table_id", "r").agg(F.sort_array(F.collect_list(F.struct("c", "text"))).alias("cells"))
    rows = rows.withColumn("sig", F.sha2(F.to_json("cells"), 256))
    band = lambda c: F.floor(F.col(c) / 10_000)
    one = split_previous(rows, ["table_id"], ["r"], band("r"), F.struct("sig"), "before")
    two = split_previous(one, ["table_id"], ["r"], band("r"), F.col("before"), "two_before")
    kept = two.where(~F.coalesce((F.col("sig") == F.col("before.sig")) & (F.col("sig") == F.col("two_before.sig")), F.lit(False)))
    numbered = split_row_number(kept.select("table_id", "r", "cells"), ["table_id"], ["r"], band("r"), "row")
    out = numbered.join(width, "table_id").select("table_id", (F.col("row") - 1).alias("r"), "width", F.explode("cells").alias("x"))
    return out.select("table_id", "r", "x.c", "x.text", "width")


def chart_series_table(points: DataFrame, series: list[str], max_points: int | None = None) -> DataFrame:
    """Series points (chart, series, x, y, seq) as a wide table: the first of a repeated x wins; with ``max_points`` only so many x a chart.

    Numeric x ascend, other x keep first-seen order.
    """
    first = points.where(F.col("series").isin(series)).groupBy("chart", "x").pivot("series", series).agg(F.min_by("y", "seq"))
    seen = points.where(F.col("series").isin(series)).groupBy("chart", "x").agg(F.min("seq").alias("first_seq"))
    rows = first.join(seen, ["chart", "x"])
    numeric = F.expr("try_cast(x AS double)")
    order = [numeric.asc_nulls_last(), F.col("first_seq")]
    if max_points is not None:
        return top_per_key(rows, ["chart"], order, max_points)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("chart").orderBy(*order)))


def section_totals(components: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows whose parts (owner, value) add up to the labelled total within 0.55 or half a percent."""
    sums = components.groupBy("owner").agg(F.sum(F.col("value").cast("decimal(20,4)")).cast("double").alias("parts"))
    slack = F.greatest(F.lit(0.55), F.abs("total") * 0.005)
    return totals.join(sums, "owner").select("owner", "total", "parts", (F.abs(F.col("parts") - F.col("total")) <= slack).alias("ok"))


# Weights of the table reading score.
READING_WEIGHTS = {"row_coverage": 0.28, "row_fit": 0.16, "col_fit": 0.08, "numeric": 0.12, "header": 0.08, "single": 0.14, "tidy": 0.14}
CLEAR_WIN = 0.02
LARGE_PAGE = 100_000  # cells of all readings above which a page is dealt by its words
DEALS = 64


def arbitrate_tables(metrics: DataFrame, default: str = "rule", margin: float = CLEAR_WIN) -> DataFrame:
    """Best reading per table (page, reading, one column per metric); the default keeps ties and unclear wins."""
    score = sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in READING_WEIGHTS.items()), F.lit(0.0))
    scored = metrics.withColumn("score", F.round(score, 6))
    best = scored.groupBy("page").agg(
        F.max(F.struct("score", "reading")).alias("m"), F.max(F.when(F.col("reading") == default, F.col("score"))).alias("base")
    )
    clear = F.coalesce(F.col("m.score") > F.col("base") + margin, F.lit(True))
    return best.select("page", F.when(clear, F.col("m.reading")).otherwise(default).alias("reading"), F.when(clear, F.col("m.score")).otherwise(F.col("base")).alias("score"))


def _reading_fits(cells: DataFrame, evidence: DataFrame, place: list[str], dealt: bool = False) -> DataFrame:
    """(page, reading, row_fit, col_fit, found) of cells and page words (page, .., words, told) that meet at ``place``.

    They are dealt by it before words are cut, unless they are ``dealt`` so. There a word learns in how many rows of the page it stands, and its shares
    are summed per row and per column of the reading.
    """
    key = ["page", "reading"]
    rows = cells.unionByName(evidence, allowMissingColumns=True).withColumn("deal", F.pmod(F.xxhash64("words"), F.lit(DEALS)))
    met = (rows if dealt else rows.repartition(*place)).withColumn("word", F.explode("words")).groupBy(*place, "word", "reading", "r", "c", "row", "told").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(*place, "word", "reading").orderBy("r", "c")) == 1
    known = met.withColumn("first", first).withColumn("rows", F.count_if("told").over(Window.partitionBy(*place, "word"))).where("NOT told")
    hits = F.when(F.col("rows") > 0, F.col("n")).otherwise(0)
    share = lambda axis, i, s, n: F.struct(F.lit(axis).alias("axis"), i.cast("long").alias("i"), s.cast("long").alias("s"), n.cast("long").alias("n"))
    shares = [share("r", F.col("r"), hits, F.col("n")), share("c", F.col("c"), hits, F.col("n")), F.when(F.col("first") & (F.col("rows") > 0), share("w", F.lit(0), F.col("rows"), F.lit(1)))]
    sums = known.select(*key, F.explode(F.array_compact(F.array(*shares))).alias("x")).groupBy(*key, "x.axis", "x.i").agg(F.sum("x.s").alias("s"), F.sum("x.n").alias("n"))
    fit = lambda axis: F.avg(F.when(F.col("axis") == axis, F.col("s") / F.col("n")))
    return sums.groupBy(*key).agg(fit("r").alias("row_fit"), fit("c").alias("col_fit"), F.max(F.when(F.col("axis") == "w", F.col("s"))).alias("found"))


def reading_metrics(cells: DataFrame, evidence: DataFrame, dealt: bool = False) -> DataFrame:
    """Metrics of each table reading (page, reading, r, c, text) against the page's words (page, word, row).

    Cells and words of a page are shuffled once, by page, and cut there; a page
    of more than ``LARGE_PAGE`` cells is dealt by its words instead, so it
    spreads over tasks. With ``dealt`` both sides come dealt by page, in the same
    number of tasks, and only what is found about a reading is shuffled.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    key = ["page", "reading"]
    # At most one row for LARGE_PAGE cells of the input, so it may go to every task.
    large = written(cells.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") > LARGE_PAGE).select("page"))
    cut = cells.select(*key, "r", "c", words.alias("words"), F.lit(False).alias("told"))
    told = evidence.select("page", "row", F.array("word").alias("words"), F.lit(True).alias("told"))
    if large.isEmpty():
        fits = _reading_fits(cut, told, ["page"], dealt)
    else:
        large = F.broadcast(large)
        one_word = cut.join(large, "page", "left_semi").withColumn("words", F.explode(F.transform("words", lambda w: F.array(w))))
        fits = _reading_fits(cut.join(large, "page", "left_anti"), told.join(large, "page", "left_anti"), ["page"], dealt).unionByName(
            _reading_fits(one_word, told.join(large, "page", "left_semi"), ["page", "deal"])
        )
    total = evidence.select("page", "row", "word").distinct().groupBy("page").agg(F.count("*").alias("words"))
    text = F.trim(F.coalesce("text", F.lit("")))
    shape = cells.groupBy(*key).agg(
        F.avg(F.when(text != "", is_number(F.col("text")).cast("int"))).alias("numeric"),
        F.max(F.when((F.col("r") == 0) & (text != "") & ~is_number(F.col("text")), 1.0).otherwise(0.0)).alias("header"),
        F.avg(F.when(text != "", (~text.rlike(r"\d\s+\d")).cast("int"))).alias("single"),
        F.avg((text != "").cast("int")).alias("tidy"),
    )
    # What is known of a reading comes from three sides; they are put together by grouping, which needs no shuffle where all of them are dealt by page.
    sides = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (shape.withColumn("shaped", F.lit(True)), fits, total))
    known = [c for c in sides.columns if c not in key]
    rows = sides.groupBy(*key).agg(*[F.max(c).alias(c) for c in known]).withColumn("words", F.max("words").over(Window.partitionBy("page"))).where("shaped")
    named = F.col("page").isNotNull() & F.col("reading").isNotNull()
    coverage = F.when(named, F.col("found") / F.col("words")).alias("row_coverage")
    return rows.select(*shape.columns, F.when(named, F.col("row_fit")).alias("row_fit"), F.when(named, F.col("col_fit")).alias("col_fit"), coverage)
