"""Relation queries: lines cite parts, orders and customers hold them, suppliers and nations are boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import mentions
from threadloom.operators import relations as op
from threadloom.operators.extraction import closure_of_levels
from threadloom.plans.base import query
from threadloom.plans.extraction import tree_levels

UID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def cited(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("uid", F.expr(UID))


def customer_part_links(t):
    rows = cited(t)
    refs = rows.select(
        F.col("uid").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"),
        F.when(F.col("l_returnflag") == "R", "Returned").when(F.col("l_returnflag") == "A", "Accepted").alias("attr"),
    )
    holders = rows.select(F.col("uid").alias("src"), F.explode(F.array(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"))).alias("anc"))
    card = lambda df, letter, key: df.select(F.concat(F.lit(letter), key).alias("target"), F.concat(F.lit(letter), key).alias("card"))
    below = rows.where("o_orderstatus = 'P'").select(F.col("uid").alias("src"))
    return op.graph_links(refs, holders, card(t.customer, "c", "c_custkey"), card(t.part, "p", "p_partkey"), below)


LINKS_SQL = f"""SELECT concat('c', o_custkey) AS from_card, concat('p', l_partkey) AS to_card,
 CASE WHEN bool_or(l_returnflag <> 'N') THEN 'attr' ELSE 'ref' END AS kind,
 concat_ws(', ', CASE WHEN bool_or(l_returnflag = 'A') THEN 'Accepted' END, CASE WHEN bool_or(l_returnflag = 'R') THEN 'Returned' END,
   CASE WHEN bool_or(l_returnflag = 'N') THEN 'mentions' END) AS labels,
 count(DISTINCT {UID}) AS n_sources, min({UID}) AS first_source
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2"""


@query("graph_links", LINKS_SQL)
def _(t):
    return customer_part_links(t)


EDGES_SQL = "SELECT DISTINCT concat('p', l_partkey) AS from_uid, concat('c', o_custkey) AS to_uid FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 40"


def drawn_edges(t):
    return cited(t).where("l_quantity > 40").select(F.concat(F.lit("p"), "l_partkey").alias("from_uid"), F.concat(F.lit("c"), "o_custkey").alias("to_uid")).distinct()


@query(
    "filter_links",
    f"SELECT from_card, to_card, labels FROM ({LINKS_SQL}) WHERE kind = 'attr' AND (from_card, to_card) NOT IN (SELECT (to_uid, from_uid) FROM ({EDGES_SQL}))",
)
def _(t):
    visible, _covered = op.covered_by(op.filter_links(customer_part_links(t), "attributes"), drawn_edges(t))
    return visible.select("from_card", "to_card", "labels")


@query("covered_by", f"SELECT * FROM ({EDGES_SQL}) WHERE (to_uid, from_uid) IN (SELECT (from_card, to_card) FROM ({LINKS_SQL}))")
def _(t):
    return op.covered_by(customer_part_links(t), drawn_edges(t))[1]


CARD_REF_SQL = """SELECT concat('c', o_custkey) AS from_card, to_card, max(kind) AS kind_, bool_or(attr IS NOT NULL) AS a, bool_or(attr = 'Rush') AS rush, bool_or(attr IS NULL) AS m FROM (
  SELECT o_custkey, concat('p', l_partkey) AS to_card, 'x' AS kind, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Rush' END AS attr
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')
  UNION ALL SELECT o_custkey, concat('o', o_orderkey), 'x', CASE WHEN o_orderpriority = '1-URGENT' THEN 'Rush' END
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 300000) GROUP BY 1, 2"""
CARD_REF_OUT = f"""SELECT from_card, to_card, CASE WHEN a THEN 'attr' ELSE 'ref' END AS kind,
 concat_ws(', ', CASE WHEN rush THEN 'Rush' END, CASE WHEN m THEN 'mentions' END) AS labels FROM ({CARD_REF_SQL})"""


def card_links(t):
    texts = cited(t).select(
        F.concat(F.lit("c"), "o_custkey").alias("card"), "uid",
        F.expr("concat('[[part ', l_partkey, ']] ((ord', o_orderkey, ')) `[[part 1]]`')").alias("text"),
        F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN 'Rush' END").alias("attr"),
    )
    parts = t.part.where("p_brand = 'Brand#2'").select(F.lit("page").alias("dst_kind"), F.concat(F.lit("part "), "p_partkey").alias("dst"), F.concat(F.lit("p"), "p_partkey").alias("card"))
    orders = t.orders.where("o_totalprice > 300000").select(F.lit("block").alias("dst_kind"), F.concat(F.lit("ord"), "o_orderkey").alias("dst"), F.concat(F.lit("o"), "o_orderkey").alias("card"))
    return op.card_ref_links(texts, parts.unionByName(orders))


@query("card_ref_links", CARD_REF_OUT)
def _(t):
    return card_links(t).withColumn("labels", op._label_list(F.col("labels")))


def order_tree_links(t):
    cards = t.customer.where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("card"), F.concat(F.lit("c"), "c_custkey").alias("target"))
    kids = t.orders.where("o_totalprice > 200000").select(F.concat(F.lit("o"), "o_orderkey").alias("card"), F.concat(F.lit("o"), "o_orderkey").alias("target"))
    parents = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("uid"), F.concat(F.lit("c"), "o_custkey").alias("parent"))
    return op.tree_links(cards.unionByName(kids), parents)


TREE_LINK_SQL = "SELECT concat('c', o_custkey) AS from_card, concat('o', o_orderkey) AS to_card FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_totalprice > 200000"


@query("tree_links", f"SELECT *, 'tree' AS kind FROM ({TREE_LINK_SQL})")
def _(t):
    return order_tree_links(t).drop("labels")


@query(
    "merge_links",
    f"""SELECT coalesce(a.from_card, b.from_card) AS from_card, coalesce(a.to_card, b.to_card) AS to_card, coalesce(kind, 'tree') AS kind, coalesce(labels, '') AS labels
FROM ({CARD_REF_OUT}) a FULL JOIN ({TREE_LINK_SQL}) b ON a.from_card = b.from_card AND a.to_card = b.to_card""",
)
def _(t):
    return op.merge_links([card_links(t), order_tree_links(t)])


def neighbor_refs(t):
    rows = cited(t)
    title = lambda letter, key: F.concat(F.lit(letter), key)
    flag = F.when(F.col("l_returnflag") == "R", "Returned")
    out = rows.select(title("c", "o_custkey").alias("item"), title("c", "o_custkey").alias("item_title"), F.lit("out").alias("relation"), title("p", "l_partkey").alias("title"), flag.alias("attr"), F.col("l_partkey").alias("seq"))
    inn = rows.select(title("p", "l_partkey").alias("item"), title("p", "l_partkey").alias("item_title"), F.lit("in").alias("relation"), title("c", "o_custkey").alias("title"), flag.alias("attr"), F.col("o_custkey").alias("seq"))
    return out.unionByName(inn)


NEIGHBOR_SQL = """
WITH r AS (SELECT concat('c', o_custkey) AS item, CASE WHEN l_returnflag = 'R' THEN 'attr' ELSE 'out' END AS relation, concat('p', l_partkey) AS title, l_partkey AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 UNION ALL SELECT concat('p', l_partkey), 'in', concat('c', o_custkey), o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'),
 g AS (SELECT item, relation, title, count(*) AS n, min(seq) AS seq FROM r GROUP BY ALL),
 n AS (SELECT item, relation, title, n, row_number() OVER (PARTITION BY item, relation ORDER BY CASE WHEN relation = 'in' THEN -n ELSE seq END, title) AS pos FROM g)"""


@query("neighbors", NEIGHBOR_SQL + " SELECT * FROM n")
def _(t):
    return op.neighbors(neighbor_refs(t))


@query(
    "related",
    NEIGHBOR_SQL
    + """ SELECT * FROM (SELECT item, relation, title, n, row_number() OVER (PARTITION BY item ORDER BY CASE relation WHEN 'attr' THEN 0 WHEN 'out' THEN 1 ELSE 2 END, pos, title) AS pos FROM n)""",
)
def _(t):
    return op.related(op.neighbors(neighbor_refs(t))).drop("within", "section")


def part_refs(t):
    return cited(t).select(F.col("l_partkey").alias("target"), F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("page"), F.col("l_shipdate").alias("time"), F.col("uid").alias("line"))


@query("linked_refs", "SELECT DISTINCT l_partkey AS target, l_orderkey AS uid, o_custkey AS page FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey <> l_orderkey AND l_partkey <> o_custkey")
def _(t):
    return op.linked_refs(part_refs(t))


@query(
    "group_linked_refs",
    """
WITH g AS (SELECT l_partkey AS target, o_custkey AS page, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS first_uid, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS uids
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey <> l_orderkey AND l_partkey <> o_custkey GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, page) AS pos FROM g""",
)
def _(t):
    return op.group_linked_refs(part_refs(t), whole=True).withColumn("uids", F.array_join("uids", ","))


@query(
    "group_refs_by_year",
    f"""
WITH r AS (SELECT l_suppkey AS target, l_shipdate AS time, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, {UID}) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)
SELECT target, year(time) AS year, count(*) AS n, total, 0 AS hidden FROM r GROUP BY target, year(time), total""",
)
def _(t):
    refs = t.lineitem.select(F.col("l_suppkey").alias("target"), F.col("l_shipdate").alias("time"), F.expr(UID).alias("uid"))
    return op.group_refs_by_year(refs)


@query(
    "boards_with",
    f"""
WITH r AS (SELECT l_partkey AS uid, o_custkey AS board, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE {UID} END AS card FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT uid, board, min(card) AS card, bool_or(card IS NULL) AS direct, c_name AS title FROM r JOIN customer ON board = c_custkey WHERE c_acctbal > 0 GROUP BY uid, board, c_name""",
)
def _(t):
    rows = cited(t).withColumnRenamed("uid", "card")
    base = rows.select(F.col("l_partkey").alias("uid"), F.col("o_custkey").alias("board"), "card", "o_orderstatus")
    boards = t.customer.select(F.col("c_custkey").alias("board"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") > 0, 2).otherwise(1).alias("version"))
    return op.boards_with(base.where("o_orderstatus = 'F'"), base.where("o_orderstatus <> 'F'"), boards)


@query(
    "connection_index",
    f"""
WITH e AS (SELECT DISTINCT concat('e', {UID}) AS uid, concat('o', l_orderkey) AS from_uid, concat('p', l_partkey) AS to_uid, l_returnflag AS label,
   l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 40) AS valid,
   l_orderkey, l_partkey FROM lineitem),
 x AS (SELECT concat('x', l_orderkey) AS uid, min(uid) AS from_uid, concat('o', l_orderkey) AS to_uid, 'why' AS label, l_orderkey FROM e GROUP BY l_orderkey),
 y AS (SELECT concat('y', l_orderkey) AS uid, uid AS from_uid, to_uid, 'why why' AS label FROM x)
SELECT uid, from_uid, to_uid, label, valid FROM e
UNION ALL SELECT x.uid, x.from_uid, x.to_uid, x.label, e.valid AND x.l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') FROM x JOIN e ON e.uid = x.from_uid
UNION ALL SELECT uid, from_uid, to_uid, label, false FROM y""",
)
def _(t):
    named = t.lineitem.select(F.expr(f"concat('e', {UID})").alias("uid"), "l_orderkey", "l_partkey", "l_returnflag")
    base = named.distinct().select("uid", F.expr("concat('o', l_orderkey)").alias("from_uid"), F.expr("concat('p', l_partkey)").alias("to_uid"), F.col("l_returnflag").alias("label"))
    first = named.groupBy("l_orderkey").agg(F.min("uid").alias("edge"))
    above = first.selectExpr(
        "inline(array(struct(concat('x', l_orderkey) AS uid, edge AS from_uid, concat('o', l_orderkey) AS to_uid, 'why' AS label),"
        " struct(concat('y', l_orderkey) AS uid, concat('x', l_orderkey) AS from_uid, concat('o', l_orderkey) AS to_uid, 'why why' AS label)))"
    )
    items = t.orders.where("o_orderstatus <> 'P'").select(F.expr("concat('o', o_orderkey)").alias("uid")).unionByName(t.part.where("p_size < 40").select(F.expr("concat('p', p_partkey)").alias("uid")))
    return op.connection_index(base.unionByName(above), items)


@query(
    "connected_component",
    """
WITH RECURSIVE d AS MATERIALIZED (SELECT DISTINCT concat('c', o_custkey) AS a, concat('p', l_partkey) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 e AS MATERIALIZED (SELECT a, b FROM d UNION ALL SELECT b, a FROM d),
 cc(uid, component) USING KEY (uid) AS (SELECT DISTINCT a, a FROM e UNION
  (SELECT e.a, min(w.component) FROM recurring.cc u JOIN e ON e.a = u.uid JOIN recurring.cc w ON w.uid = e.b WHERE w.component < u.component GROUP BY e.a))
SELECT uid, component FROM cc""",
)
def _(t):
    edges = cited(t).select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return op.connected_components(edges)


TITLES_SQL = "SELECT DISTINCT trim(unnest(string_split(replace(text, chr(10), '. '), '. ')), ' .') AS title FROM benchmark"


@query(
    "unlinked_mentions",
    f"""SELECT doc_id AS uid, title AS title_uid, title FROM documents, ({TITLES_SQL}) WHERE length(title) >= 4 AND
 regexp_matches(text, '(?i)(^|[^A-Za-z0-9])\\Q' || title || '\\E($|[^A-Za-z0-9])')""",
)
def _(t):
    sentences = F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(". ")), r"\. "))
    titles = t.benchmark.select(sentences.alias("s")).select(F.expr("trim(BOTH ' .' FROM s)").alias("title")).distinct()
    texts = t.documents.select(F.col("doc_id").cast("string").alias("uid"), "text")
    out = mentions.unlinked_mentions(texts, titles.select(F.col("title").alias("uid"), "title"))
    return out.select(F.col("uid").cast("long").alias("uid"), "title_uid", F.col("title_uid").alias("title"))


@query(
    "suggest_pairs",
    r"""
WITH n AS (SELECT DISTINCT s_nationkey AS board, s_suppkey AS uid, l_partkey AS name FROM supplier JOIN lineitem ON l_suppkey = s_suppkey),
 p AS (SELECT board, x.uid AS a, y.uid AS b, min(name)::VARCHAR AS reason, 2 AS score FROM n x JOIN n y USING (board, name) WHERE x.uid < y.uid GROUP BY 1, 2, 3),
 o AS (SELECT s_nationkey AS board, min(s_suppkey) AS a, max(s_suppkey) AS b FROM supplier GROUP BY 1),
 t AS (SELECT s_nationkey AS board, s_suppkey AS uid, s_name AS title, regexp_replace(concat('Like ', lower(lag(s_name, 1) OVER w), ', not [[', lag(s_name, 2) OVER w, ']]; x', lag(s_name, 3) OVER w, ' or ', lag(s_name, 4) OVER w, '.'), '\[\[[^\]]*\]\]', '[[]]', 'g') AS text
  FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
 m AS (SELECT x.board, least(x.uid, y.uid) AS a, greatest(x.uid, y.uid) AS b, arg_min(y.title, (x.uid, y.title)) AS reason, 1 AS score FROM t x JOIN t y ON x.board = y.board AND x.uid <> y.uid
   AND regexp_matches(x.text, '(?i)(^|[^A-Za-z0-9])\Q' || y.title || '\E($|[^A-Za-z0-9])') GROUP BY 1, 2, 3),
 u AS (SELECT * FROM p UNION ALL SELECT * FROM m WHERE (board, a, b) NOT IN (SELECT (board, a, b) FROM p))
SELECT *, row_number() OVER (PARTITION BY board ORDER BY score DESC, a, b) AS pos FROM u WHERE (board, a, b) NOT IN (SELECT (board, a, b) FROM o)""",
)
def _(t):
    from pyspark.sql.window import Window

    cards = t.supplier.select(F.col("s_nationkey").alias("board"), F.col("s_suppkey").alias("uid"))
    names = cards.join(t.lineitem, F.col("uid") == F.col("l_suppkey")).select("board", "uid", F.col("l_partkey").alias("name"))
    ends = cards.groupBy("board").agg(F.max("uid").alias("a"), F.min("uid").alias("b"))
    near = lambda k: F.coalesce(F.lag("s_name", k).over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")), F.lit(""))
    text = F.concat(F.lit("Like "), F.lower(near(1)), F.lit(", not [["), near(2), F.lit("]]; x"), near(3), F.lit(" or "), near(4), F.lit("."))
    named = mentions.unlinked_mentions(t.supplier.select(F.col("s_suppkey").alias("uid"), text.alias("text")), t.supplier.select(F.col("s_suppkey").alias("uid"), F.col("s_name").alias("title")))
    titled = named.join(t.supplier.select(F.col("s_suppkey").alias("title_uid"), F.col("s_name").alias("title")), "title_uid")
    return op.suggest_pairs(cards, names, ends, ends.limit(0), mentions=titled)


FOLLOWS_SQL = "SELECT o_custkey AS board, max(struct_pack(p := l_extendedprice, k := l_partkey)).k AS follows FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"


@query(
    "mirror_cycles",
    f"""
WITH RECURSIVE f AS MATERIALIZED (SELECT board, follows FROM ({FOLLOWS_SQL})),
 w(origin, here, hop) AS (SELECT board, follows, 1 FROM f UNION ALL SELECT origin, follows, hop + 1 FROM w JOIN f ON f.board = w.here WHERE hop < 8 AND origin <> here)
SELECT origin AS board, CASE WHEN hop = 1 THEN 'self' ELSE 'cycle' END AS verdict, CASE WHEN hop = 1 THEN 0 ELSE hop END AS hops FROM w WHERE origin = here""",
)
def _(t):
    return op.mirror_cycles(cited(t).groupBy(F.col("o_custkey").alias("board")).agg(F.max(F.struct("l_extendedprice", "l_partkey"))["l_partkey"].alias("follows")))


@query(
    "company",
    """
WITH e AS (SELECT user_id AS owner, event_id AS uid, epoch_us(ts) AS at FROM events),
 j AS (SELECT a.owner, a.uid, b.uid AS other, row_number() OVER (PARTITION BY a.uid ORDER BY b.at, b.uid) AS pos FROM e a JOIN e b ON a.owner = b.owner AND a.uid <> b.uid AND abs(a.at - b.at) <= 86400000000)
SELECT * FROM j WHERE pos <= 6""",
)
def _(t):
    return op.company(t.events.select(F.col("user_id").alias("owner"), F.col("event_id").alias("uid"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")))


@query(
    "resurface",
    """
WITH r AS (SELECT o_orderkey AS uid, o_orderdate::DATE AS day FROM orders), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY uid) AS i FROM r) WHERE i <= 6),
 d AS (SELECT DISTINCT day AS page_day FROM r),
 h AS (SELECT page_day, n AS days_ago, uid, abs(date_diff('day', page_day - n::INTEGER, f.day)) AS delta FROM d, unnest([7, 30, 90, 365]) u(n) JOIN f ON f.day BETWEEN page_day - n::INTEGER - 1 AND page_day - n::INTEGER + 1)
SELECT strftime(page_day, '%Y-%m-%d') AS page_day, days_ago, uid, delta, pos FROM (SELECT *, row_number() OVER (PARTITION BY page_day, days_ago ORDER BY delta, uid) AS pos FROM h) WHERE pos <= 6""",
)
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("uid"), F.to_date("o_orderdate").alias("day"))
    out = op.resurface(rows.select(F.col("day").alias("page_day")).distinct(), rows)
    return out.withColumn("page_day", F.date_format("page_day", "yyyy-MM-dd"))


@query(
    "follow_sources",
    """
WITH o AS (SELECT c_nationkey AS owner, o_orderkey AS uid, o_orderkey AS ord, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderpriority END AS text FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT * FROM (SELECT *, trim(text) = '' AS blank, row_number() OVER (PARTITION BY owner ORDER BY ord, uid) AS pos, true AS complete FROM o)""",
)
def _(t):
    text = F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderpriority"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return op.follow_children(rows.select(F.col("c_nationkey").alias("owner"), F.col("o_orderkey").alias("uid"), F.col("o_orderkey").alias("ord"), text.alias("text")))


@query(
    "follow_diff",
    """
SELECT o_custkey AS owner, count(*) FILTER (NOT p AND NOT s AND NOT b) AS pending, count(*) FILTER (p) AS placed, count(*) FILTER (NOT p AND s) AS dismissed,
 count(*) FILTER (NOT p AND NOT s AND NOT b AND f) AS fresh FROM (
 SELECT o_custkey, o_orderstatus = 'F' AS p, o_orderpriority = '5-LOW' AS s, o_totalprice < 20000 AS b, o_orderdate >= TIMESTAMP '1998-01-01' AS f FROM orders) GROUP BY 1""",
)
def _(t):
    rows = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("uid"), "o_orderstatus", "o_orderpriority", (F.col("o_totalprice") < 20000).alias("blank"), (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("fresh"))
    return op.follow_diff(rows, rows.where("o_orderstatus = 'F'"), rows.where("o_orderpriority = '5-LOW'"))


@query(
    "dedupe_follow",
    """
WITH l AS (SELECT l_partkey AS item, l_suppkey AS lane_pos, bool_or(l_returnflag = 'R' AND l_quantity > 35) AS skipped FROM lineitem GROUP BY 1, 2),
 f AS (SELECT item, min(lane_pos) AS first_lane, arg_min(skipped, lane_pos) AS fs FROM l GROUP BY 1)
SELECT item, lane_pos, first_lane, CASE WHEN skipped AND lane_pos = first_lane THEN 'skip' WHEN lane_pos = first_lane THEN 'own' WHEN fs THEN 'suppressed' WHEN skipped THEN 'skip' ELSE 'hint' END AS role FROM l JOIN f USING (item)""",
)
def _(t):
    return op.dedupe_follow(t.lineitem.select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("lane_pos"), F.expr("l_returnflag = 'R' AND l_quantity > 35").alias("skipped")))


@query("moved_items", "SELECT o_orderkey AS uid, o_orderpriority AS was, '1-URGENT' AS now FROM orders WHERE o_totalprice > 250000 AND o_orderpriority <> '1-URGENT'")
def _(t):
    old = t.orders.select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("heading"))
    new = t.orders.select(F.col("o_orderkey").alias("uid"), F.expr("CASE WHEN o_totalprice > 250000 THEN '1-URGENT' ELSE o_orderpriority END").alias("heading"))
    return op.moved_items(old, new)


@query(
    "diff_boards",
    """
SELECT o_orderkey AS uid, CASE WHEN o_orderstatus = 'P' THEN 'added' WHEN o_orderpriority = '5-LOW' THEN 'removed' ELSE 'changed' END AS change,
 o_orderstatus = 'P' OR o_orderpriority = '5-LOW' OR o_totalprice > 400000 AS structural FROM orders
WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW') AND (o_orderstatus = 'P' OR o_orderpriority = '5-LOW' OR o_totalprice > 400000 OR o_orderstatus = 'F')""",
)
def _(t):
    prev = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("x"))
    nxt = t.orders.where("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("uid"), F.expr("CASE WHEN o_totalprice > 400000 THEN -1 ELSE o_custkey END").alias("parent"), F.col("o_orderkey").alias("ord"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END").alias("x"),
    )
    return op.diff_boards(prev, nxt, ["parent", "ord"], ["x"])


@query("layout_snapshots", "SELECT c_nationkey AS board, o_orderkey AS uid, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) <= 10 AS kept FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return op.partition_snapshots(rows.select(F.col("c_nationkey").alias("board"), F.col("o_orderkey").alias("uid"), F.col("o_orderdate").alias("at"))).drop("at")


@query(
    "restore_plan",
    """
WITH m AS (SELECT o_orderkey AS uid, o_custkey AS old_parent, o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS mv, o_totalprice > 300000 AS pr FROM orders)
SELECT uid, old_parent, 'move' AS op FROM m WHERE mv UNION ALL SELECT uid, old_parent, 'props' FROM m WHERE pr""",
)
def _(t):
    was = t.orders.select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("parent"), F.col("o_totalprice").alias("x"))
    now = t.orders.select(F.col("o_orderkey").alias("uid"), F.expr("CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_custkey END").alias("parent"), F.expr("least(o_totalprice, 300000D)").alias("x"))
    return op.plan_restore(was, now, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("uid")), ["x"])


@query(
    "namespace_parent",
    """WITH p AS (SELECT regexp_replace(url, '^https?://', '') AS title FROM pages), n AS (SELECT title, strpos(title, '/') AS cut FROM p)
SELECT substr(title, 1, cut - 1) AS parent, count(*) AS n FROM n WHERE cut > 1 AND cut < length(title) GROUP BY 1""",
)
def _(t):
    parent = op.namespace_parent(F.regexp_replace("url", "^https?://", ""))
    return t.pages.select(parent.alias("parent")).where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias("n"))


@query(
    "name_precedence",
    r"""
WITH r AS (SELECT page_id AS uid, CASE WHEN quality = 1 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) ELSE '' END AS page_title,
  split_part(text, chr(10), 1) AS parsed_title, regexp_extract(url, '([^/?#]+)[?#]?[^/]*$', 1) AS file_name, len(regexp_extract_all(html, '<a href=')) AS links
 FROM pages LEFT JOIN documents ON doc_id = page_id LEFT JOIN labels l ON l.doc_id = page_id)
SELECT uid, links, trim(CASE WHEN trim(page_title) <> '' THEN page_title WHEN trim(parsed_title) <> '' THEN parsed_title ELSE file_name END) AS name,
 CASE WHEN trim(page_title) <> '' THEN 'page_title' WHEN trim(parsed_title) <> '' THEN 'parsed_title' ELSE 'file_name' END AS name_from FROM r""",
)
def _(t):
    rows = t.pages.join(t.documents.select("doc_id", "text"), F.col("page_id") == F.col("doc_id"), "left").drop("doc_id")
    rows = rows.join(t.labels.select("doc_id", "quality"), F.col("page_id") == F.col("doc_id"), "left").select(
        F.col("page_id").alias("uid"),
        F.when(F.col("quality") == 1, F.regexp_extract("html", "<title>([^<]*)</title>", 1)).otherwise("").alias("page_title"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("parsed_title"),
        F.regexp_extract("url", r"([^/?#]+)[?#]?[^/]*$", 1).alias("file_name"),
        F.regexp_count("html", F.lit("<a href=")).alias("links"),
    )
    return op.named_by_precedence(rows, ["page_title", "parsed_title", "file_name"]).select("uid", "links", "name", "name_from")


@query(
    "expand_candidates",
    """
WITH n AS (SELECT o_custkey AS card, l_partkey AS uid, min(l_returnflag) AS zone, max(l_extendedprice) AS idx, max(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT * FROM (SELECT card, uid, zone, idx, CASE zone WHEN 'R' THEN 1 ELSE 2 END AS zone_rank, row_number() OVER (PARTITION BY card ORDER BY CASE zone WHEN 'R' THEN 1 ELSE 2 END, idx, uid) AS pos
 FROM n WHERE zone IN ('R', 'A') AND q <= 45)""",
)
def _(t):
    nodes = cited(t).groupBy(F.col("o_custkey").alias("card"), F.col("l_partkey").alias("uid")).agg(F.min("l_returnflag").alias("zone"), F.max("l_extendedprice").alias("idx"))
    placed = cited(t).where("l_quantity > 45").select(F.col("o_custkey").alias("card"), F.col("l_partkey").alias("uid"))
    return op.expand_candidates(nodes, placed, ["R", "A"])


@query(
    "arrow_homes",
    """
SELECT DISTINCT concat('o', o_orderkey) AS "end", CASE WHEN c_acctbal > 0 THEN concat('c', c_custkey) WHEN n_regionkey < 3 THEN concat('n', n_nationkey) END AS home,
 CASE WHEN c_acctbal > 0 THEN 1 WHEN n_regionkey < 3 THEN 2 END AS up
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P'""",
)
def _(t):
    ends = t.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("uid"))
    items = (
        t.customer.where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("uid"))
        .unionByName(t.nation.where("n_regionkey < 3").select(F.concat(F.lit("n"), "n_nationkey").alias("uid")))
        .unionByName(t.orders.where("o_orderstatus = 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("uid")))
    )
    return op.arrow_homes(ends, items, closure_of_levels(tree_levels(t)))


@query(
    "arrows_from_outside",
    """
WITH o AS (SELECT o_orderkey AS k, concat('o', o_orderkey) AS uid, concat('c', o_custkey) AS board, CASE WHEN o_orderstatus = 'P' THEN 'section' ELSE 'card' END AS type FROM orders),
 e AS (SELECT DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN 'n0' ELSE o.board END AS home, concat(l_orderkey, '-', l_linenumber) AS edge, o.uid AS f, concat('o', l_partkey) AS t FROM lineitem JOIN o ON l_orderkey = k),
 d AS (SELECT home, edge, f AS card, t AS other FROM e UNION SELECT home, edge, t, f FROM e)
SELECT DISTINCT c.board, card, edge, other, p.board AS place FROM d JOIN o c ON c.uid = card AND c.type = 'card' AND c.board <> home JOIN o p ON p.uid = other AND p.board <> c.board""",
)
def _(t):
    orders = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("board"), F.concat(F.lit("o"), "o_orderkey").alias("uid"), F.when(F.col("o_orderstatus") == "P", "section").otherwise("card").alias("type"))
    edges = cited(t).select(
        F.when(F.col("l_linenumber") % 3 == 0, "n0").otherwise(F.concat(F.lit("c"), "o_custkey")).alias("board"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge"), F.concat(F.lit("o"), "l_orderkey").alias("from"), F.concat(F.lit("o"), "l_partkey").alias("to"),
    )
    boards = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("uid")).unionByName(t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("uid")))
    return op.arrows_from_outside(orders, edges, boards, closure_of_levels(tree_levels(t)))
