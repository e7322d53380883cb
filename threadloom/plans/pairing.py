"""SQL of word boxes, their overlaps and one-to-one matching, for checks on DuckDB."""

from __future__ import annotations

UID_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def boxes_sql(cond: str = "true", dx: str = "0", text: str = "l_returnflag") -> str:
    """Order lines as word boxes: page = order, x from quantity, y from price."""
    return f"""SELECT l_orderkey AS page, {UID_SQL} AS uid, {text} AS text, CASE WHEN l_returnflag = 'R' THEN 0.4::DOUBLE ELSE 0.9::DOUBLE END AS conf, l_linestatus, l_returnflag AS flag,
  l_quantity::DOUBLE * 10 + {dx} AS x0, l_extendedprice::DOUBLE / 100 AS y0, l_quantity::DOUBLE * 10 + {dx} + 60 AS x1, l_extendedprice::DOUBLE / 100 + 40 AS y1 FROM lineitem WHERE {cond}"""


def overlap_sql(a: str, b: str) -> str:
    """(page, a, b, iou) of boxes that overlap."""
    w, h = "(least(p.x1, q.x1) - greatest(p.x0, q.x0))", "(least(p.y1, q.y1) - greatest(p.y0, q.y0))"
    area = lambda t: f"(greatest(0.0::DOUBLE, {t}.x1 - {t}.x0) * greatest(0.0::DOUBLE, {t}.y1 - {t}.y0))"
    return f"SELECT p.page, p.uid AS a, q.uid AS b, {w} * {h} / ({area('p')} + {area('q')} - {w} * {h}) AS iou FROM {a} p JOIN {b} q ON p.page = q.page AND {w} > 0 AND {h} > 0"


def match_sql(pairs: str, score: str, kind: str = "VARCHAR") -> str:
    """Tables ``turn`` and ``walk`` and the match (page, a, b): each page's pairs in order, a pair is taken if both ends are free."""
    return f"""turn AS MATERIALIZED (SELECT page, a, b, row_number() OVER (PARTITION BY page ORDER BY {score} DESC, a, b) AS k FROM {pairs}),
 walk(page, k, ua, ub, a, b) AS (SELECT DISTINCT page, 0::BIGINT, []::{kind}[], []::{kind}[], NULL::{kind}, NULL::{kind} FROM turn
  UNION ALL SELECT page, k, CASE WHEN free THEN list_append(ua, a) ELSE ua END, CASE WHEN free THEN list_append(ub, b) ELSE ub END, CASE WHEN free THEN a END, CASE WHEN free THEN b END
   FROM (SELECT t.page, t.k, t.a, t.b, ua, ub, NOT list_contains(ua, t.a) AND NOT list_contains(ub, t.b) AS free FROM walk w JOIN turn t ON t.page = w.page AND t.k = w.k + 1)),
 matched AS MATERIALIZED (SELECT page, a, b FROM walk WHERE a IS NOT NULL)"""


def boxes_matched_sql(a: str, b: str, least: float) -> str:
    """Tables ``ba``, ``bb`` and ``matched`` for the boxes that two queries give."""
    return f"WITH RECURSIVE ba AS MATERIALIZED ({a}), bb AS MATERIALIZED ({b}), near AS MATERIALIZED (SELECT * FROM ({overlap_sql('ba', 'bb')}) WHERE iou >= {least}),\n {match_sql('near', 'iou')}"
