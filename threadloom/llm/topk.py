"""Exact top-k by inner product with a pivot-distance index.

Adding one coordinate that gives every stored vector the same length turns the
largest inner product into the smallest distance. Each vector is keyed by its
nearest pivot and the distance to it; the keys are range-sorted and cut into
annuli. A query first searches the annuli of its own pivot around its own
distance, which gives it a k-th best score; then every annulus whose
triangle-inequality bound can still reach that score, nearest first. Bounds
carry a margin above the rounding of doubles, and scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.shared import Scratch, blocks_of

PIVOTS = 32
SAMPLE = 4096
BLOCK = 1024
SLOTS = 32


def _ints(cells: pd.Series) -> np.ndarray:
    return np.stack(list(cells)).astype(np.int64)


def _gaps(x: np.ndarray, level: float, pivots: np.ndarray, level_p: np.ndarray) -> np.ndarray:
    """Distances of lifted rows (length ``level`` less their own, per row) to the lifted pivots."""
    d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T + (np.asarray(level)[:, None] - level_p[None, :]) ** 2
    return np.sqrt(np.maximum(d2, 0))


def top_inner(
    df: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, pivots: int = PIVOTS
) -> DataFrame:
    """(query_id, rank from 1, id, score bigint): the ``k`` best inner products of each query row with every other row.

    Components become ``floor(scale * x)``. Ties go to the smaller id. Rows of
    one id are one vector (the smallest by components). A null id, or a vector
    that is null, empty or holds null or non-finite components, takes no part;
    vectors of different lengths don't meet; scores are taken as bigint. A query
    with fewer than ``k`` other vectors returns them all. Other columns are
    ignored. An empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "top-inner")
    rows = (
        df.select(F.col(id_col).cast("bigint").alias("vid"), is_query.alias("ask"), F.col(vector).cast("array<double>").alias("v"))
        .where("vid is not null and v is not null and size(v) > 0")
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .groupBy("vid").agg(F.min(F.struct(F.transform("v", lambda x: F.floor(x * scale)).alias("v"), F.coalesce("ask", F.lit(False)).alias("ask"))).alias("r"))
        .select("vid", "r.ask", "r.v", F.size("r.v").alias("dim"))
    )
    rows = scratch.keep(rows, "rows")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # Bounded by SAMPLE rows: pivots are picked far from one another among them.
    fit = rows.select("dim", "v").orderBy(F.xxhash64("vid")).limit(SAMPLE).toPandas()
    tops = {int(r["dim"]): float(r["m"]) for r in rows.groupBy("dim").agg(F.max(norm2).alias("m")).collect()} if len(fit) else {}
    model: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
    for dim, top in tops.items():
        sub = fit[fit["dim"] == dim]
        x = np.stack(list(sub["v"])).astype(np.float64) if len(sub) else np.zeros((1, dim))
        lift = np.sqrt(np.maximum(top - (x * x).sum(1), 0))
        picked = [0]
        near = _gaps(x, lift, x[:1], lift[:1])[:, 0]
        while len(picked) < min(pivots, len(x)) and near.max() > 0:
            picked.append(int(near.argmax()))
            near = np.minimum(near, _gaps(x, lift, x[picked[-1:]], lift[picked[-1:]])[:, 0])
        model[dim] = (x[picked], lift[picked], top)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for dim, sub in part.groupby("dim"):
                px, pl, top = model[int(dim)]
                x = _ints(sub["v"])
                xf = x.astype(np.float64)
                n2 = (xf * xf).sum(1)
                gap = _gaps(xf, np.sqrt(np.maximum(top - n2, 0)), px, pl)
                home = gap.argmin(1)
                yield pd.DataFrame(
                    {"dim": int(dim), "pivot": home, "r": gap[np.arange(len(x)), home], "vid": sub["vid"].to_numpy(), "v": [a.tobytes() for a in x]}
                )

    stored = scratch.keep(
        blocks_of(rows.mapInPandas(key, "dim int, pivot int, r double, vid bigint, v binary"), ["dim", "pivot"], "dim int, pivot int", "r", {"vid": "i8", "v": "bytes"}, BLOCK),
        "annuli",
    )

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries keyed by their nearest pivot; their distance to it takes the place of the radius."""
        for part in batches:
            for dim, sub in part.groupby("dim"):
                px, pl, top = model[int(dim)]
                x = _ints(sub["v"])
                xf = x.astype(np.float64)
                gap = _gaps(xf, np.zeros(len(x)), px, pl)
                home = gap.argmin(1)
                yield pd.DataFrame(
                    {"dim": int(dim), "pivot": home, "r": gap[np.arange(len(x)), home], "vid": sub["vid"].to_numpy(), "v": [a.tobytes() for a in x], "gaps": [g.tobytes() for g in gap]}
                )

    asked = scratch.keep(
        blocks_of(
            rows.where("ask").mapInPandas(ask, "dim int, pivot int, r double, vid bigint, v binary, gaps binary"),
            ["dim", "pivot"], "dim int, pivot int", "r", {"vid": "i8", "v": "bytes", "gaps": "bytes"}, 256,
        ),
        "asked",
    )

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Annuli of one query block arrive nearest first; the k-th best so far closes the rest."""
        now, state = None, None
        for part in batches:
            for r in part.itertuples(index=False):
                if r.qblk != now:
                    if state is not None:
                        yield state.rows()
                    now, state = r.qblk, _Best(r, k, model[int(r.dim)])
                state.meet(r)
        if state is not None:
            yield state.rows()

    best = "query_id bigint, vec_id bigint, score bigint, qblk bigint"
    annuli = stored.select("dim", "pivot", F.pmod("blk", F.lit(SLOTS)).alias("slot"), "lo", "hi", "blk")
    vectors = stored.select("blk", "pivot", "lo", "hi", F.col("vid").alias("b_vid"), F.col("v").alias("b_v"))
    slots = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot")

    def search(pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """Query and annulus blocks are paired by their bounds alone; only then do the vectors of a pair come together."""
        met = pairs.select("qblk", "blk", "bound").join(queries, "qblk").join(vectors, "blk")
        return met.select(*fields).sortWithinPartitions("qblk", "bound").mapInPandas(expand, best)

    fields = ["qblk", "bound", "dim", "pivot", "q_vid", "q_v", "gaps", "lo", "hi", "b_vid", "b_v", "known"]
    queries = asked.select("dim", F.col("blk").alias("qblk"), F.col("vid").alias("q_vid"), F.col("v").alias("q_v"), "gaps")
    homes = asked.select("dim", "pivot", F.col("blk").alias("qblk"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), slots)
    near = homes.join(annuli, ["dim", "pivot", "slot"]).where("lo <= q_hi and hi >= q_lo").withColumn("bound", F.lit(0.0))
    started = scratch.keep(search(near, queries.withColumn("known", F.lit(None).cast("binary"))), "first")

    # Each query's k-th best score so far, kept with its block.
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = started.withColumn("rk", F.row_number().over(w)).where(F.col("rk") == k).select("qblk", "query_id", "score")
    known = kth.groupBy("qblk").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("best"))

    def limit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for ids, got in zip(part["q_vid"], part["best"], strict=True):
                got = dict(got) if got is not None else {}
                out.append(np.array([got.get(i, np.iinfo(np.int64).min) for i in np.frombuffer(ids, np.int64).tolist()], np.int64).tobytes())
            yield part[["dim", "qblk", "q_vid", "q_v", "gaps"]].assign(known=out)

    limited = queries.join(known, "qblk", "left").mapInPandas(limit, "dim int, qblk bigint, q_vid binary, q_v binary, gaps binary, known binary")
    limited = scratch.keep(limited.select("dim", "qblk", "q_vid", "q_v", "gaps", "known"), "limited")

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For a query block and each pivot: the smallest and largest distance that any of its queries still needs."""
        for part in batches:
            for r in part.itertuples(index=False):
                low, high = _Best(r, k, model[int(r.dim)]).reach()
                yield pd.DataFrame({"dim": r.dim, "qblk": r.qblk, "pivot": np.arange(len(low), dtype=np.int32), "need_lo": low, "need_hi": high})

    wide = limited.mapInPandas(reach, "dim int, qblk bigint, pivot int, need_lo double, need_hi double")
    rest = wide.select("*", slots).join(annuli, ["dim", "pivot", "slot"]).where("hi >= need_lo and lo <= need_hi")
    # Nearest first: how far the annulus lies from the middle of what the block needs.
    middle = (F.col("need_lo") + F.col("need_hi")) / 2
    rest = rest.withColumn("bound", F.greatest(F.col("lo") - middle, middle - F.col("hi"), F.lit(0.0)))
    more = search(rest, limited)
    rank = F.row_number().over(w)
    everything = started.unionByName(more).select("query_id", "vec_id", "score").distinct()
    ranked = everything.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")


class _Best:
    """The best ``k`` scores of one block of queries, as annuli are met."""

    def __init__(self, r, k: int, model: tuple[np.ndarray, np.ndarray, float]):
        self.ids = np.frombuffer(r.q_vid, np.int64)
        self.q = np.frombuffer(r.q_v, np.int64).reshape(len(self.ids), -1)
        self.gaps = np.frombuffer(r.gaps).reshape(len(self.ids), -1)
        self.k, self.top, self.qblk = k, model[2], r.qblk
        self.n2 = (self.q.astype(np.float64) ** 2).sum(1)
        self.kth = np.frombuffer(r.known, np.int64).copy() if r.known is not None else np.full(len(self.ids), np.iinfo(np.int64).min)
        self.found: list[list[tuple[int, int]]] = [[] for _ in self.ids]

    def radius(self) -> np.ndarray:
        """No vector farther than this from a query can reach its k-th score."""
        kth = np.where(self.kth == np.iinfo(np.int64).min, -np.inf, self.kth.astype(np.float64))
        d2 = self.n2 + self.top - 2 * kth
        return np.sqrt(np.maximum(d2, 0)) * (1 + 1e-9) + 1e-3

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        r = self.radius()[:, None]
        return (self.gaps - r).min(0), (self.gaps + r).max(0)

    def meet(self, r) -> None:
        gap, rad = self.gaps[:, int(r.pivot)], self.radius()
        live = np.flatnonzero((gap - r.hi <= rad) & (r.lo - gap <= rad))
        if not len(live):
            return
        ids = np.frombuffer(r.b_vid, np.int64)
        v = np.frombuffer(r.b_v, np.int64).reshape(len(ids), -1)
        small = float(np.abs(self.q).max(initial=0)) * float(np.abs(v).max(initial=0)) * v.shape[1] < 2**53
        scores = (self.q[live].astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64) if small else self.q[live] @ v.T
        for row, at in zip(scores, live, strict=True):
            take = np.flatnonzero(row >= self.kth[at])
            if len(take) > self.k + 1:
                order = np.lexsort((ids[take], -row[take]))
                take = take[order[: self.k + 1]]
            mine = self.found[at]
            mine += [(int(row[t]), int(ids[t])) for t in take if ids[t] != self.ids[at]]
            mine.sort(key=lambda x: (-x[0], x[1]))
            del mine[self.k :]
            if len(mine) == self.k:
                self.kth[at] = max(self.kth[at], mine[-1][0])

    def rows(self) -> pd.DataFrame:
        out = [(int(q), i, s, self.qblk) for q, mine in zip(self.ids, self.found, strict=True) for s, i in mine]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "qblk"])
