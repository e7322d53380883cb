"""JSON Canvas files in and out, JSON Lines ledgers, board outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits and words of the canvas format.
NODE_TYPES = ["text", "file", "link", "group"]
SIDES = ["top", "right", "bottom", "left"]

CANVAS_SCHEMA = (
    "nodes array<struct<id:string,type:string,x:double,y:double,width:double,height:double,color:string,text:string,"
    "file:string,url:string,label:string>>, "
    "edges array<struct<id:string,fromNode:string,toNode:string,fromSide:string,toSide:string,fromEnd:string,toEnd:string,"
    "color:string,label:string>>"
)


def _good_node(n: Column) -> Column:
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.coalesce(
        (n["id"] != "")
        & n["x"].isNotNull()
        & n["y"].isNotNull()
        & (n["width"] > 0)
        & (n["height"] > 0)
        & n["type"].isin(NODE_TYPES)
        & ((n["type"] != "link") | filled(n["url"]))
        & ((n["type"] != "file") | filled(n["file"])),
        F.lit(False),
    )


def parse_canvas(df: DataFrame, json: str = "json") -> DataFrame:
    """Adds ``kept_nodes``, ``kept_edges``, ``skipped`` and ``error`` to one row per file.

    All nodes and edges of a file are read. A file is one row, so the first of
    the nodes that share an id is found inside it.
    """
    rows = df.withColumn("__c", F.from_json(json, CANVAS_SCHEMA))
    rows = rows.withColumn("__n", F.coalesce(F.col("__c.nodes"), F.array())).withColumn("__e", F.coalesce(F.col("__c.edges"), F.array()))
    error = F.when(F.col("__c").isNull(), "not a canvas")
    rows = rows.withColumn("error", error).withColumn("__valid", F.filter("__n", _good_node))
    ids = F.transform("__valid", lambda n: n["id"])
    rows = rows.withColumn("__ids", ids)
    kept = F.filter("__valid", lambda n, i: F.array_position("__ids", n["id"]) == i + 1)
    good_edge = lambda e: F.coalesce(
        F.array_contains("__ids", e["fromNode"]) & F.array_contains("__ids", e["toNode"]) & (e["fromNode"] != e["toNode"]),
        F.lit(False),
    )
    rows = rows.withColumn("kept_nodes", F.when(F.col("error").isNull(), kept)).withColumn(
        "kept_edges", F.when(F.col("error").isNull(), F.filter("__e", good_edge))
    )
    skipped = F.size("__n") - F.size("kept_nodes") + F.size("__e") - F.size("kept_edges")
    return rows.withColumn("skipped", F.when(F.col("error").isNull(), skipped)).drop("__c", "__n", "__e", "__valid", "__ids")


def read_canvas(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("json"))
    return parse_canvas(files)


def write_canvas_rows(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Canvas content of boards as ordered JSON rows (board, part, rank, json).

    Groups come first, outer before inner, then the other nodes in board order;
    an edge is written when both ends were kept. Rows are not folded into one
    string per board: a board may be larger than a task.
    """
    kept = items.where((F.col("w") > 0) & (F.col("h") > 0))
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("long")
    is_group = F.col("type") == "section"
    node = F.to_json(
        F.struct(
            F.col("uid").alias("id"),
            whole("x").alias("x"),
            whole("y").alias("y"),
            F.greatest(F.lit(1), whole("w")).alias("width"),
            F.greatest(F.lit(1), whole("h")).alias("height"),
            F.when(is_group, "group").otherwise("text").alias("type"),
            F.when(is_group, F.col("title")).alias("label"),
            F.when(~is_group, F.col("title")).alias("text"),
        )
    )
    rank = F.when(is_group, F.format_string("0:%04d:%020d", "depth", "ord")).otherwise(F.format_string("1:0000:%020d", "ord"))
    nodes = kept.select("board", F.lit("node").alias("part"), rank.alias("rank"), node.alias("json"))
    ends = kept.select("board", "uid")
    ok = edges.join(ends.withColumnRenamed("uid", "from_uid"), ["board", "from_uid"], "left_semi").join(
        ends.withColumnRenamed("uid", "to_uid"), ["board", "to_uid"], "left_semi"
    )
    edge = F.to_json(F.struct(F.col("uid").alias("id"), F.col("from_uid").alias("fromNode"), F.col("to_uid").alias("toNode"), "label"))
    return nodes.unionByName(ok.select("board", F.lit("edge").alias("part"), F.col("uid").alias("rank"), edge.alias("json")))


def outline_markdown_lines(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Board outline as ordered lines (board, part, path, line).

    Sections become headings by depth, cards bullets in reading order (the path
    carries y then x), nested content is indented, and valid edges follow as a
    list of connections. ``items`` hold (board, path, role, depth, title).
    """
    title = F.trim(F.regexp_replace("title", r"\s+", " "))
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.col("depth") + 1)), F.lit(" "), title)
    bullet = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), title)
    body = items.where(title != "").select(
        "board", F.lit(0).alias("part"), "path", F.when(F.col("role") == "section", heading).otherwise(bullet).alias("line")
    )
    arrow = F.when(F.coalesce(F.col("label"), F.lit("")) != "", F.concat_ws(" -> ", "a", "label", "b")).otherwise(F.concat_ws(" -> ", "a", "b"))
    links = edges.select("board", F.lit(1).alias("part"), F.col("uid").alias("path"), arrow.alias("line"))
    return body.unionByName(links)


def parse_ledger(lines: DataFrame, schema: str, key: str = "uid", text: str = "value") -> DataFrame:
    """Rows of a JSON Lines ledger; torn lines and rows without a key are dropped."""
    parsed = lines.select(F.from_json(text, schema).alias("r")).select("r.*")
    return parsed.where(F.coalesce(F.col(key), F.lit("")) != "")


def read_jsonl_ledger(spark: SparkSession, path: str, schema: str, key: str = "uid") -> DataFrame:
    return parse_ledger(spark.read.text(path), schema, key)
