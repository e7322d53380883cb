"""Read side of the public API: functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import relations
from threadloom.sources import blocks

VERSION = "1"


def boards_with(uids: DataFrame, direct: DataFrame, via: DataFrame, boards: DataFrame) -> DataFrame:
    """Boards that hold the given blocks (uid), directly or through a citing card."""
    keep = lambda df: df.join(uids.select("uid"), "uid", "left_semi")
    return relations.boards_with(keep(direct), keep(via), boards)


def tables_from_documents(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Cells of every table in parsed texts."""
    return blocks.extract_pipe_tables(blocks.text_to_blocks(documents, doc, text))


def board_rows(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cards of boards with their text, in board order columns (board, uid, type, ord, text)."""
    return items.join(nodes.select("uid", "text"), "uid", "left").select("board", "uid", "type", "ord", F.coalesce("text", F.lit("")).alias("text"))


def events_of(feed: DataFrame, board: str) -> DataFrame:
    """Changes of one board from a change feed, batch or stream."""
    return feed.where(F.col("board") == board)
