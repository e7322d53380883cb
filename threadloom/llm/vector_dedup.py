"""Near-duplicate vectors by collision counting on one-dimensional projections.

Unit vectors are projected on a few orthonormal directions. The values on the
first direction are range-sorted and cut into blocks, so the window centred on
a vector touches few blocks; within two blocks that meet, the windows on the
other directions are counted per pair, and pairs with enough collisions are
verified by the exact cosine.

Calibration. Two unit vectors of cosine >= t are at most d = sqrt(2 - 2t)
apart. Orthonormal directions split the squared distance, so no direction
differs by more than d, and at most (d / w)**2 of them by more than w. Requiring
``m - floor((d / w)**2)`` collisions of m therefore keeps every link: recall is
1 by construction, and the exact cosine removes the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import Scratch, attach, blocks_of, components, forest

BLOCK = 1024
PROJECTIONS = 24
WINDOW_SIGMAS = 3.0
SLACK = 1e-9


def directions(dim: int, count: int, seed: int = 7) -> np.ndarray:
    """``count`` orthonormal directions (columns), the same on every executor."""
    return np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))[0][:, : min(count, dim)]


def near_vectors(
    df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", group: str = "label", projections: int = PROJECTIONS
) -> DataFrame:
    """(id, n_links bigint, component_id, kept): links are pairs of one ``group`` with cosine >= ``threshold`` (> 0).

    Rows of one id are one vector (the smallest by group, then components, if
    they differ). A null id, a null group, or a vector that is null, empty, zero
    or holds null or non-finite components links with nothing and is its own
    component; a null id comes back as one row. Vectors of different lengths
    don't link. Equal vectors are compared once and counted with their number.
    Columns other than these three are ignored. An empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "near-vectors")
    rows = (
        df.select(F.col(id_col).cast("bigint").alias("vid"), F.col(group).cast("string").alias("grp"), F.col(vector).cast("array<double>").alias("vec"))
        .groupBy("vid").agg(F.min(F.struct("grp", "vec")).alias("r")).select("vid", "r.grp", "r.vec")
    )
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vid").isNotNull() & F.col("grp").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    marked = rows.withColumn("cls", F.when(usable, F.sha2(F.concat_ws(",", F.col("grp"), F.to_json(F.transform("vec", lambda x: x + 0.0))), 256)))
    marked = scratch.keep(marked.withColumn("vec", F.when(usable, F.col("vec"))), "rows")
    classes = marked.where("cls is not null").groupBy("cls").agg(
        F.min(F.struct("vid", "grp", "vec")).alias("r"), F.count("*").alias("cnt")
    ).select("cls", F.col("r.vid").alias("rep"), F.col("r.grp").alias("grp"), F.col("r.vec").alias("vec"), "cnt")
    classes = scratch.keep(classes, "classes")

    far = float(np.sqrt(2 - 2 * threshold)) + SLACK

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            dims = part["vec"].map(len).to_numpy()
            for dim in np.unique(dims):
                sub = part[dims == dim]
                x = np.stack(list(sub["vec"])).astype(np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                p = x @ directions(int(dim), projections)
                yield pd.DataFrame(
                    {"grp": sub["grp"], "dim": int(dim), "k": p[:, 0], "rep": sub["rep"], "cnt": sub["cnt"], "unit": [v.tobytes() for v in x], "proj": [v.tobytes() for v in p]}
                )

    flat = classes.mapInPandas(project, "grp string, dim int, k double, rep bigint, cnt bigint, unit binary, proj binary")
    blocks = scratch.keep(
        blocks_of(flat, ["grp", "dim"], "grp string, dim int", "k", {"k": "f8", "rep": "i8", "cnt": "i8", "unit": "bytes", "proj": "bytes"}, BLOCK), "blocks"
    )
    # Two blocks can only hold a link if their ranges come within ``far``; they meet in the cell where the later of the two begins.
    cell = lambda c: F.floor(c / F.lit(far)).cast("bigint")
    left = blocks.withColumn("first", cell(F.col("lo"))).withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") + far))))
    right = blocks.withColumn("cell", cell(F.col("lo")))
    a = left.select("grp", "dim", "cell", *[F.col(c).alias(f"a_{c}") for c in ("blk", "lo", "hi", "k", "rep", "cnt", "unit", "proj")])
    b = right.select("grp", "dim", "cell", *[F.col(c).alias(f"b_{c}") for c in ("blk", "lo", "hi", "k", "rep", "cnt", "unit", "proj")])
    later = (F.col("b_lo") > F.col("a_lo")) | ((F.col("b_lo") == F.col("a_lo")) & (F.col("b_blk") >= F.col("a_blk")))
    met = a.join(b, ["grp", "dim", "cell"]).where(later & (F.col("b_lo") <= F.col("a_hi") + far))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for r in part.itertuples(index=False):
                links, ea, eb = _links(r, far, threshold)
                yield links
                if len(ea):
                    yield pd.DataFrame({"a": ea, "b": eb, "n": np.zeros(len(ea), np.int64)})

    def _links(r, far: float, threshold: float) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        dim = int(r.dim)
        pa, pb = np.frombuffer(r.a_proj).reshape(len(r.a_k) // 8, -1), np.frombuffer(r.b_proj).reshape(len(r.b_k) // 8, -1)
        m = pa.shape[1]
        wide = max(WINDOW_SIGMAS * far / np.sqrt(dim), far / np.sqrt(m))
        need = m - int(np.floor((far / wide) ** 2))
        count = np.zeros((len(pa), len(pb)), np.uint8)
        for k in range(m):
            count += np.abs(pa[:, k, None] - pb[None, :, k]) <= wide
        i, j = np.nonzero(count >= need)
        same = r.a_blk == r.b_blk
        if same:
            i, j = i[i < j], j[i < j]
        ra, rb = np.frombuffer(r.a_rep, np.int64), np.frombuffer(r.b_rep, np.int64)
        ca, cb = np.frombuffer(r.a_cnt, np.int64), np.frombuffer(r.b_cnt, np.int64)
        ua, ub = np.frombuffer(r.a_unit).reshape(len(ra), dim), np.frombuffer(r.b_unit).reshape(len(rb), dim)
        na, nb = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
        fa, fb = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s in range(0, len(i), 1 << 16):
            x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            true = (ua[x] * ub[y]).sum(axis=1) >= threshold
            x, y = x[true], y[true]
            np.add.at(na, x, cb[y])
            np.add.at(nb, y, ca[x])
            fa, fb = forest(np.concatenate([fa, ra[x]]), np.concatenate([fb, rb[y]]))
        ids, n = (np.concatenate([ra, rb]), np.concatenate([na, nb]))
        ids, n = ids[n > 0], n[n > 0]
        return pd.DataFrame({"a": ids, "b": np.full(len(ids), -1), "n": n}), fa, fb

    found = scratch.keep(met.mapInPandas(compare, "a bigint, b bigint, n bigint"), "found")
    linked = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    roots = components(scratch, found.where("n = 0")).withColumnRenamed("node", "rep")
    of_class = (
        classes.select("cls", "rep", "cnt").join(linked, "rep", "left").join(roots, "rep", "left")
        .select("cls", F.coalesce("root", "rep").alias("root"), (F.col("cnt") - 1 + F.coalesce("n", F.lit(0))).alias("n"), "cnt")
    )
    of_class = scratch.keep(of_class, "of_class")
    scratch.drop(blocks, found)
    # A class of one row is met by its own key in one row; larger ones are dealt over salts.
    slim = marked.select("vid", "cls")
    many = of_class.where("cnt > 1 or n > 0").select("cls", "root", "n")
    joined = attach(slim, many, "cls", F.col("vid"), 16)
    root = F.coalesce("root", "vid")
    return joined.select(
        F.col("vid").alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("vid"), F.lit(True)).alias("kept")
    )
