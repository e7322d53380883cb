"""Queries over the extension surface: source kinds and the public read functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import api, registry
from threadloom.operators import filters
from threadloom.plans.base import query
from threadloom.plans.relations import cited


def graph(t) -> registry.Graph:
    """Orders are pages with their lines as blocks; urgent orders are headings of their customer."""
    o = F.concat(F.lit("o"), "o_orderkey")
    nodes = t.orders.select(
        o.alias("uid"), F.concat(F.lit("c"), "o_custkey").alias("parent"), F.concat(F.lit("c"), "o_custkey").alias("page"), F.col("o_orderkey").alias("ord"),
        F.col("o_orderpriority").alias("text"), (F.col("o_orderpriority") == "1-URGENT").alias("is_heading"), F.to_date("o_orderdate").alias("day"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("time"),
    )
    refs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.col("p_brand").alias("dst"))
    closure = nodes.select(F.col("parent").alias("anc"), F.col("uid").alias("desc"), F.lit(1).alias("depth"))
    items = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderstatus").alias("board"), o.alias("uid"))
    return registry.Graph(nodes, refs, closure, items)


@query(
    "register_source_kind",
    """
WITH o AS (SELECT concat('o', o_orderkey) AS uid, * FROM orders),
 h AS (SELECT uid, last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN uid END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS heading FROM o),
 x AS (SELECT 'children' AS kind, concat('c', o_custkey) AS owner, uid FROM o UNION ALL SELECT 'tree', concat('c', o_custkey), uid FROM o
  UNION ALL SELECT 'linked', b, uid FROM (SELECT DISTINCT p_brand AS b, concat('o', l_orderkey) AS uid FROM lineitem JOIN part ON p_partkey = l_partkey)
  UNION ALL SELECT 'query', 'query', concat('o', l_orderkey) FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey HAVING bool_or(p_brand = 'Brand#2') AND NOT bool_or(p_brand = 'Brand#9')
  UNION ALL SELECT 'headings', heading, uid FROM h WHERE heading IS NOT NULL
  UNION ALL SELECT 'board', 'F', uid FROM o WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'urgent', 'mine', uid FROM o WHERE o_orderpriority = '1-URGENT'),
 g AS (SELECT kind, owner, count(*) AS total FROM x GROUP BY 1, 2)
SELECT kind, owner, total AS shown, true AS complete FROM g""",
)
def _(t):
    g = graph(t)
    remove = registry.register_source_kind(
        "urgent", lambda gr: gr.nodes.where("is_heading").select(F.lit("mine").alias("owner"), "uid", F.col("ord").cast("string").alias("ord"), "text")
    )
    tree = filters.All((filters.Cites("Brand#2"), filters.Not(filters.Cites("Brand#9"))))
    rows = [
        registry.read_source(kind, g, **params).groupBy("owner").agg(F.count("*").alias("shown"), F.bool_and("complete").alias("complete")).select(F.lit(kind).alias("kind"), "*")
        for kind, params in (("children", {}), ("tree", {}), ("linked", {}), ("query", {"tree": tree}), ("headings", {}), ("board", {}), ("urgent", {}))
    ]
    remove()
    return reduce(DataFrame.unionByName, rows)


@query(
    "public_query_api",
    """
WITH r AS (SELECT l_partkey AS uid, o_custkey AS board, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE concat('o', o_orderkey) END AS card FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40))
SELECT uid, board, min(card) AS card, bool_or(card IS NULL) AS direct, c_name AS title FROM r JOIN customer ON board = c_custkey WHERE c_acctbal > 0 GROUP BY uid, board, c_name""",
)
def _(t):
    base = cited(t).select(F.col("l_partkey").alias("uid"), F.col("o_custkey").alias("board"), F.concat(F.lit("o"), "o_orderkey").alias("card"), "o_orderstatus")
    boards = t.customer.select(F.col("c_custkey").alias("board"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") > 0, 2).otherwise(1).alias("version"))
    wanted = t.part.where("p_size > 40").select(F.col("p_partkey").alias("uid"))
    return api.boards_with(wanted, base.where("o_orderstatus = 'F'"), base.where("o_orderstatus <> 'F'"), boards)
