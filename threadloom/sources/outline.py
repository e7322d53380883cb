"""Nested outline exports: one JSON tree per row or file, flattened to one row per block."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import cut_lineage

# Block types that hold board parts instead of notes.
CONTAINER_TABLES = {"edge": "edges", "snapshot": "layouts", "region": "regions", "trail": "trails", "picture": "pictures"}


#: Fields of a block and the types they are read as; a value of another type reads as null.
FIELDS = {"uid": "string", "string": "string", "title": "string", "heading": "int", "open": "boolean", "create_time": "bigint", "edit_time": "bigint", "props": "map<string,string>"}


def _field(node: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(node, f"$.{name}", kind)


def _sorted_children(node: Column) -> Column:
    """Children by order; equal or missing orders keep their input position."""
    children = F.coalesce(_field(node, "children", "array<variant>"), F.array().cast("array<variant>"))
    keys = F.array_sort(F.transform(children, lambda c, i: F.struct(F.coalesce(_field(c, "order", "bigint"), i.cast("bigint")).alias("o"), i.alias("i"))))
    return F.transform(keys, lambda k: F.get(children, k["i"]))


def flatten_tree(df: DataFrame, json: str) -> DataFrame:
    """One row per block of each tree in column ``json``, with parent, position and depth, however deep the tree is.

    A tree is parsed once into a variant. Each round takes the blocks of one
    level out of their parents, inside the row and without a shuffle, and the
    rounds end when a level is empty. A null or malformed text gives no rows, a
    block without uid stays with a null one. ``table`` says which table a
    container block belongs to.
    """
    keep = [c for c in df.columns if c != json]
    level = df.select(*keep, F.try_parse_json(json).alias("__node"), F.lit(None).cast("string").alias("parent_uid"), F.lit(0).alias("ord")).where("__node IS NOT NULL")
    out = None
    for depth in count():
        level = cut_lineage(level)
        if depth and level.isEmpty():
            break
        here = level.select(*keep, *[_field(F.col("__node"), f, kind).alias(f) for f, kind in FIELDS.items()], "parent_uid", "ord", F.lit(depth).alias("depth"))
        out = here if out is None else out.unionByName(here)
        below = F.posexplode(_sorted_children(F.col("__node"))).alias("ord", "__child")
        level = level.select(*keep, _field(F.col("__node"), "uid", "string").alias("parent_uid"), below).withColumnRenamed("__child", "__node")
    table = F.element_at(F.create_map(*[F.lit(v) for kv in CONTAINER_TABLES.items() for v in kv]), F.element_at("props", "type"))
    return out.withColumn("table", F.coalesce(table, F.lit("nodes")))


def read_outline_json(spark: SparkSession, path: str) -> DataFrame:
    """Flatten export files, one tree per file."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return flatten_tree(files.withColumnRenamed("value", "json"), "json")
