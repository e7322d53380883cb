"""Table schemas of the note graph, parsed documents and logs, and a checked cast to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

NODES = (
    "uid string, kind string, title string, text string, page_uid string, parent_uid string, ord int, depth int, heading int, "
    "open boolean, created timestamp, edited timestamp, created_by string, edited_by string, props map<string,string>"
)
REFS = ("src_uid string, dst_uid string, dst_title string, via_attr string, created timestamp")
CLOSURE = ("anc string, desc string, depth int")
ATTRIBUTES = ("owner string, ord int, name string, value string")
ITEMS = (
    "board_uid string, uid string, type string, kind string, parent_uid string, ord int, x double, y double, w double, h double, "
    "color string, target_kind string, target_uid string, target_title string, src string, head string"
)
EDGES = ("board_uid string, uid string, from_uid string, to_uid string, dir string, label string, valid boolean")
DOC_BLOCKS = (
    "doc string, engine string, block_id string, type string, page int, pos int, level int, text string, bbox array<double>, "
    "caption_for string, confidence double"
)
CELLS = ("table_id string, r int, c int, row_span int, col_span int, text string, header boolean, conf double")
WORDS = (
    "doc string, page int, engine string, text string, conf double, x0 double, y0 double, x1 double, y1 double, size double, base double"
)
LINES = (
    "doc string, page int, page_h double, pos int, text string, x0 double, y0 double, x1 double, y1 double, base double, size double, "
    "bold boolean, italic boolean, chars int"
)
SOURCE_ROWS = ("owner string, uid string, ord string, text string")


def fields(ddl: str) -> list[StructField]:
    """Fields of a table schema; needs a running session."""
    return StructType.fromDDL(ddl).fields


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of the schema in order: unknown ones dropped, missing ones null, values that do not fit null."""
    have = set(df.columns)
    cols = [
        (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields(ddl)
    ]
    return df.select(*cols)
