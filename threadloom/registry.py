"""Source kinds: named readers that list the items a board or section follows.

A reader takes a :class:`Graph` and its parameters and returns rows of
(owner, uid, ord, text), where ``owner`` names the followed source. The rows
feed ``follow_children`` / ``follow_diff``. Users add kinds of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import filters, ranking, relations
from threadloom.schemas import SOURCE_ROWS, conform, fields


@dataclass(frozen=True)
class Graph:
    """Tables a reader may use: nodes (uid, parent, page, ord, text, is_heading, day, time), refs (src, dst), closure (anc, desc, depth), items (board, uid)."""

    nodes: DataFrame
    refs: DataFrame
    closure: DataFrame
    items: DataFrame


Reader = Callable[..., DataFrame]
_KINDS: dict[str, Reader] = {}


def register_source_kind(name: str, reader: Reader) -> Callable[[], None]:
    """Adds or replaces a kind; the returned call removes it if it is still the same reader."""
    _KINDS[name] = reader

    def remove() -> None:
        if _KINDS.get(name) is reader:
            del _KINDS[name]

    return remove


def source_kinds() -> list[str]:
    return sorted(_KINDS)


def read_source(name: str, graph: Graph, cap: int | None = None, **params) -> DataFrame:
    """Items of a source, ``cap`` per owner, with blank and completeness flags."""
    if name not in _KINDS:
        raise KeyError(f"no source kind {name}; known: {', '.join(source_kinds())}")
    rows = _KINDS[name](graph, **params)
    missing = {f.name for f in fields(SOURCE_ROWS)} - set(rows.columns)
    if missing:
        raise ValueError(f"source kind {name} lacks columns {sorted(missing)}")
    return relations.follow_children(conform(rows, SOURCE_ROWS), cap)


def _listed(df: DataFrame, owner) -> DataFrame:
    return df.select(owner.alias("owner"), "uid", F.lpad(F.col("ord").cast("string"), 20, "0").alias("ord"), "text")


def _children(graph: Graph) -> DataFrame:
    return _listed(graph.nodes.where("parent IS NOT NULL"), F.col("parent"))


def _tree(graph: Graph, depth: int = 8) -> DataFrame:
    below = graph.closure.where(F.col("depth") <= depth).select(F.col("anc").alias("owner"), F.col("desc").alias("uid"))
    return _listed(graph.nodes.join(below, "uid"), F.col("owner"))


def _query(graph: Graph, tree) -> DataFrame:
    hits = filters.ref_query(graph.refs, tree).withColumnRenamed("src", "uid")
    return _listed(graph.nodes.join(hits, "uid", "left_semi"), F.lit("query"))


def _linked(graph: Graph) -> DataFrame:
    cites = graph.refs.select(F.col("src").alias("uid"), F.col("dst").alias("owner")).distinct()
    return _listed(graph.nodes.join(cites, "uid").where(F.col("uid") != F.col("owner")), F.col("owner"))


def _headings(graph: Graph) -> DataFrame:
    blocks = graph.nodes.where("page IS NOT NULL").select(F.col("page").alias("doc"), F.col("ord").alias("pos"), "uid", "is_heading", "text")
    under = ranking.heading_assign(blocks).where(F.col("heading").isNotNull()).withColumn("ord", F.col("pos"))
    return _listed(under, F.col("heading"))


def _board(graph: Graph) -> DataFrame:
    return _listed(graph.nodes.join(graph.items.select(F.col("board").alias("owner"), "uid"), "uid"), F.col("owner"))


def _inbox(graph: Graph, board: str) -> DataFrame:
    cites = graph.refs.where(F.col("dst") == board).select(F.col("src").alias("uid"))
    entries = graph.nodes.where("day IS NOT NULL").join(cites, "uid", "left_semi")
    new = ranking.inbox(entries, graph.items.where(F.col("board") == board)).select("uid")
    return _listed(graph.nodes.join(new, "uid", "left_semi"), F.lit(board))


def _journal(graph: Graph, last_day: str, days: int = 7) -> DataFrame:
    rows = ranking.journal_window(graph.nodes.where("day IS NOT NULL"), last_day, days)
    return _listed(rows, F.date_format("day", "yyyy-MM-dd"))


for _name, _reader in {
    "children": _children, "tree": _tree, "query": _query, "linked": _linked, "headings": _headings,
    "board": _board, "inbox": _inbox, "journal": _journal,
}.items():
    register_source_kind(_name, _reader)
