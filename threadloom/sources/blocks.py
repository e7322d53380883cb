"""Text to typed blocks. Everything happens on arrays inside the row: no shuffle, whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line shapes of the plain Markdown the parser accepts.
HEADING = r"^(#{1,6})\s+(.*)$"
FENCE = r"^\s*```"
FORMULA = r"^\s*\$\$\s*$"
QUOTE = r"^\s*>"
LIST_ITEM = r"^(\s*)([-*+]|\d+\.)\s+(.*)$"
ANCHOR = r'(?i)^\s*<a\s+id="[^"]*"\s*/?\s*>(?:\s*</a>)?\s*$'
RULE = r"^\s*(-{3,}|\*{3,}|_{3,})\s*$"
TABLE_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$"


def _line_class(line: Column, following: Column) -> Column:
    return (
        F.when(line.rlike(FENCE), "fence")
        .when(line.rlike(FORMULA), "dollars")
        .when(line.rlike(r"^\s*$") | line.rlike(ANCHOR) | line.rlike(RULE), "blank")
        .when(line.rlike(HEADING), "heading")
        .when(line.rlike(QUOTE), "quote")
        .when(line.contains("|") & following.contains("|") & following.rlike(TABLE_RULE), "thead")
        .when(line.rlike(LIST_ITEM), "list")
        .when(line.contains("|"), "pipe")
        .otherwise("para")
    )


def _stage(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns as finished values. A plain projection could be folded into the
    lambdas that read it and computed once per element; a generator is not folded."""
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def _parity(marks: Column, at: Column) -> Column:
    """Whether an odd number of ``marks`` lie before position ``at``."""
    return F.size(F.filter(marks, lambda k: k < at)) % 2 == 1


def line_arrays(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``lines`` and ``cls`` (one class per line, code and formula bodies resolved)."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    df = _stage(df, lines=lines)
    raw = F.transform("lines", lambda x, i: _line_class(x, F.coalesce(F.get("lines", i + 1), F.lit(""))))
    df = _stage(df, __raw=raw)
    spots = lambda arr, cls: F.filter(F.sequence(F.lit(0), F.size(arr) - 1), lambda i: F.get(arr, i) == cls)
    df = df.withColumn("__fences", spots("__raw", "fence"))
    df = _stage(df, __fences=spots("__raw", "fence"))
    coded = F.transform("__raw", lambda c, i: F.when(_parity(F.col("__fences"), i) & (c != "fence"), "code").otherwise(c))
    df = _stage(df, __coded=coded)
    df = _stage(df, __dollars=spots("__coded", "dollars"))
    body = F.transform(
        "__coded", lambda c, i: F.when(_parity(F.col("__dollars"), i) & (c != "dollars") & (c != "code"), "formula").otherwise(c)
    )
    return _stage(df, cls=body).drop("__raw", "__fences", "__coded", "__dollars")


def _joins(cls: Column, before: Column) -> Column:
    """Whether a line of class ``cls`` continues the block of the line before it."""
    same = (cls == before) & cls.isin("para", "quote", "list", "code", "formula", "pipe", "table")
    pipes = cls.isin("pipe", "para", "table") & before.isin("para") & (cls == "pipe")
    return same | pipes | ((cls == "para") & (before == "pipe"))


def text_to_blocks(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, type, level, text): consecutive plain lines fold into one paragraph.

    Table blocks keep their source lines, one per line; code keeps its line
    breaks; list items are one block per run with one line per item.
    """
    rows = line_arrays(df.select(F.col(doc).alias("doc"), F.col(text).alias("text")))
    # a table is its head, the rule line and every following line that holds a pipe
    heads = F.filter(F.sequence(F.lit(0), F.size("cls") - 1), lambda i: F.get("cls", i) == "thead")
    rows = _stage(rows, __heads=heads)
    rows = _stage(
        rows,
        cls=F.when(F.size("__heads") == 0, F.col("cls")).otherwise(
            F.transform(
                "cls",
                lambda c, i: F.when(
                    F.exists(
                        "__heads",
                        lambda h: (h <= i)
                        & F.forall(F.slice("lines", h + 1, i - h + 1), lambda x: x.contains("|") & ~x.rlike(r"^\s*$")),
                    )
                    & ~c.isin("code", "formula", "fence", "dollars"),
                    "table",
                ).otherwise(c),
            )
        ),
    )
    starts = F.filter(
        F.sequence(F.lit(0), F.size("cls") - 1),
        lambda i: ~F.get("cls", i).isin("blank", "fence", "dollars")
        & ((i == 0) | ~F.coalesce(_joins(F.get("cls", i), F.get("cls", i - 1)), F.lit(False)) | (F.get("cls", i) == "heading")),
    )
    stops = F.filter(
        F.sequence(F.lit(0), F.size("cls") - 1),
        lambda i: ~F.get("cls", i).isin("blank", "fence", "dollars")
        & (
            (i == F.size("cls") - 1)
            | ~F.coalesce(_joins(F.get("cls", i + 1), F.get("cls", i)), F.lit(False))
            | (F.get("cls", i + 1) == "heading")
        ),
    )
    rows = _stage(rows, s=starts, e=stops)
    rows = _stage(rows, __runs=F.arrays_zip("s", "e"))
    out = rows.select("doc", "lines", "cls", F.posexplode("__runs").alias("pos", "run"))
    kind = F.get("cls", F.col("run.s"))
    body = F.slice("lines", F.col("run.s") + 1, F.col("run.e") - F.col("run.s") + 1)
    out = out.select("doc", "pos", F.when(kind == "pipe", "para").otherwise(kind).alias("kind"), body.alias("body"))
    first = F.get("body", F.lit(0))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(first, HEADING, 1))).when(
        F.col("kind") == "list",
        F.floor(F.length(F.regexp_replace(F.regexp_extract(first, LIST_ITEM, 1), "\t", "    ")) / 2).cast("int"),
    )
    joined = (
        F.when(F.col("kind") == "heading", F.regexp_extract(first, HEADING, 2))
        .when(F.col("kind") == "quote", F.array_join(F.transform("body", lambda x: F.regexp_replace(x, r"^\s*>\s?", "")), " "))
        .when(F.col("kind").isin("code", "table"), F.array_join("body", "\n"))
        .when(F.col("kind") == "list", F.array_join(F.transform("body", lambda x: F.regexp_extract(x, LIST_ITEM, 3)), "\n"))
        .otherwise(F.array_join("body", " "))
    )
    flat = F.when(F.col("kind").isin("code", "table", "list"), joined).otherwise(F.trim(F.regexp_replace(joined, r"[ \t]+", " ")))
    return out.select(
        "doc", "pos", F.when(F.col("kind") == "quote", "para").otherwise(F.col("kind")).alias("type"), level.alias("level"), flat.alias("text")
    ).where(F.col("text") != "")


def _cells(line: Column) -> Column:
    bare = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(bare, r"\|"), lambda c: F.trim(c))


def extract_pipe_tables(blocks: DataFrame) -> DataFrame:
    """(doc, table_id, r, c, text, header) out of table blocks; short rows are padded with empty cells."""
    tables = blocks.where(F.col("type") == "table").select("doc", F.col("pos").alias("table_id"), F.split("text", "\n").alias("lines"))
    body = F.filter(F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0))), lambda x: ~x.rlike(TABLE_RULE))
    rows = F.transform(F.concat(F.slice("lines", 1, 1), body), _cells)
    tables = tables.select("doc", "table_id", rows.alias("rows"))
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    cells = tables.select("doc", "table_id", width.alias("w"), F.posexplode("rows").alias("r", "row"))
    cols = F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda c: F.coalesce(F.get("row", c), F.lit("")))
    return cells.select("doc", "table_id", "r", F.posexplode(cols).alias("c", "text"), (F.col("r") == 0).alias("header"))


def document_markdown_lines(blocks: DataFrame) -> DataFrame:
    """Parsed blocks (doc, pos, type, level, text[, caption_for, block_id]) as Markdown, one row per block.

    A caption attached to a block of the same document is written with its
    target, not in the flow; footnotes go last. Rows stay separate so that a
    document of any size is written by position, not collected.
    """
    if "caption_for" in blocks.columns:
        attached = blocks.where((F.col("type") == "caption") & F.col("caption_for").isNotNull()).select(
            "doc", F.col("caption_for").alias("block_id"), F.col("text").alias("caption")
        )
        one = attached.groupBy("doc", "block_id").agg(F.min("caption").alias("caption"))
        targets = blocks.select("doc", F.col("block_id").alias("caption_for")).distinct()
        skipped = blocks.where(F.col("type") == "caption").join(targets, ["doc", "caption_for"], "left_semi").select("doc", "block_id")
        blocks = blocks.join(skipped, ["doc", "block_id"], "left_anti").join(one, ["doc", "block_id"], "left")
    else:
        blocks = blocks.withColumn("caption", F.lit(None).cast("string"))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))
    text = F.col("text")
    line = (
        F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(F.col("type") == "list", F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("- "), x)), "\n"))
        .when(F.col("type") == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(F.col("type") == "formula", F.concat(F.lit("$$"), text, F.lit("$$")))
        .otherwise(text)
    )
    full = F.concat_ws("\n", line, "caption")
    return blocks.select("doc", F.when(F.col("type") == "footnote", 1).otherwise(0).alias("part"), "pos", full.alias("line"))
