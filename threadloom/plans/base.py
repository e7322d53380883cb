"""Registry of queries over the given tables, each with its SQL check where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


WIDE_ROWS = {"documents", "pages"}


SPREAD = "threadloom.scan.partitions"


def widen(df: DataFrame) -> DataFrame:
    """Deals the rows of tables with long texts over the partitions that the session asks for.

    A session that reads one small file sets ``threadloom.scan.partitions``; without
    it a scan keeps its splits. Filters and column pruning still reach the scan.
    """
    wanted = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(wanted)) if wanted else df


class Tables:
    """Lazy readers for one data folder: ``t.lineitem`` is the Parquet table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return widen(df) if name in WIDE_ROWS else df


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, fn, sql)
        return fn

    return register
