"""Exact Jaccard join of word n-gram sets with a prefix tree.

1. Shingles that no second document holds cannot be shared. Every block of
   documents sends its hashes, packed and split by hash range, to be compared;
   a document goes on only if enough of its shingles occur elsewhere. The hashes
   are cut to 32 bits within a range here, which can only let more documents on.
2. Documents with equal sets are one class from here on.
3. The shingles left are ordered by how many classes hold them, rarest first.
   Two classes that link share a shingle of both their prefixes.
4. Candidates meet in groups: first each class with the smallest class that
   shares a prefix shingle, then, where a prefix shingle still joins several
   components, the classes outside its largest component with those of its
   classes whose sizes and positions leave room for a link. Groups are split into
   chunks; shingles with the same classes count once.
5. In a chunk the stored sets form a trie along the global order. It is walked
   once for all probes, whose partial overlaps are shared by everything below a
   node, and a subtree is left when the remaining lengths cannot reach the
   threshold. What is found is exact, so no pair is verified again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import Scratch, attach, components, forest, lean, lean_group

WORDS = 5
PERCENT = 75
CHUNK = 512
BLOCK_DOCS = 60_000
BLOCK_SHINGLES = 1 << 20
SLICE_BYTES = 4 << 20
CELLS = 1 << 24
FACTORS = np.random.default_rng(5).integers(0, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each whole text's shingles; a shorter text is one shingle, one without words none."""
    import xxhash

    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, upto - at)))
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        of_word = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        h = of_word[coded.indices.to_numpy(zero_copy_only=False)[full]]
        grams = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            grams += h[k : len(h) - words + 1 + k] * FACTORS[k]
        grams = _mix(grams)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if e - s >= words:
                yield np.unique(grams[s : e - words + 1])
            elif e > s:
                yield _mix(np.array([(h[s:e] * FACTORS[: e - s]).sum() + np.uint64(e - s)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
        at = upto


def _doc_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        yield batch.column(0).to_pylist(), list(shingle_sets(batch.column(1), words))


def _survivors(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, enough): whether ``percent`` of the document's shingles may occur in another one."""
    spark = docs.sparkSession
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, sets, held = TaskContext.get().partitionId() << 32, [], [], 0

        def emit() -> pa.RecordBatch:
            keys = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            keys, owner = keys[order].astype(np.uint32), owner[order]
            rows = [(p, keys[ends[p] : ends[p + 1]].tobytes(), owner[ends[p] : ends[p + 1]].tobytes()) for p in range(parts)]
            # The block's own documents travel beside its hashes and are met again when the counts come back.
            sizes = np.array([len(s) for s in sets], np.int64)
            rows.append((parts + block % parts, np.array(ids, np.int64).tobytes(), sizes.tobytes()))
            p, k, o = zip(*rows, strict=True)
            return pa.record_batch([pa.array(p, pa.int32()), pa.array([block] * len(p), pa.int64()), pa.array(k, pa.binary()), pa.array(o, pa.binary())], names=["part", "block", "keys", "owner"])

        for docs_ids, docs_sets in _doc_sets(batches, words):
            for i, s in zip(docs_ids, docs_sets, strict=True):
                ids.append(i)
                sets.append(s)
                held += len(s)
                if held >= BLOCK_SHINGLES or len(ids) >= BLOCK_DOCS:
                    yield emit()
                    block, ids, sets, held = block + 1, [], [], 0
        if ids:
            yield emit()

    def count(part: pd.DataFrame) -> pd.DataFrame:
        if int(part["part"].iloc[0]) >= parts:
            return pd.DataFrame({"block": part["block"], "kind": 1, "a": part["keys"], "b": part["owner"]})
        keys = [np.frombuffer(k, np.uint32) for k in part["keys"]]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        same = ordered[1:] == ordered[:-1]
        met = np.zeros(len(every), bool)
        met[order[1:][same]] = True
        met[order[:-1][same]] = True
        out, at = [], 0
        for k, o in zip(keys, part["owner"], strict=True):
            out.append(np.bincount(np.frombuffer(o, np.uint16)[met[at : at + len(k)]]).astype(np.uint32).tobytes())
            at += len(k)
        return pd.DataFrame({"block": part["block"], "kind": 0, "a": out, "b": b""})

    def sum_up(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part["kind"] == 1].iloc[0]
        ids, n = np.frombuffer(own["a"], np.int64), np.frombuffer(own["b"], np.int64)
        total = np.zeros(len(ids), np.int64)
        for a in part["a"][part["kind"] == 0]:
            c = np.frombuffer(a, np.uint32)
            total[: len(c)] += c
        return pd.DataFrame({"doc_id": ids, "n": n, "enough": (100 * total >= percent * n) & (n > 0)})

    sent = docs.mapInArrow(lean(pieces), "part int, block bigint, keys binary, owner binary")
    counted = sent.groupBy("part").applyInPandas(lean_group(count), "block bigint, kind int, a binary, b binary")
    return counted.groupBy("block").applyInPandas(lean_group(sum_up), "doc_id bigint, n bigint, enough boolean")


class Trie:
    """Compressed prefix tree of ascending token arrays; nodes are stretches of a stored sequence."""

    def __init__(self, seqs: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">i8").tobytes())
        self.seqs, self.sizes, self.order = seqs, sizes, order
        common = [0]
        for a, b in zip(order[:-1], order[1:], strict=True):
            x, y = seqs[a], seqs[b]
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            common.append(int(differ[0]) if len(differ) else m)
        self.common = common

    def children(self, lo: int, hi: int, depth: int) -> Iterator[tuple[int, int, int]]:
        """(lo, hi, end depth) of each child below the rows lo..hi, which share their first ``depth`` tokens."""
        at = lo
        while at < hi:
            upto = at + 1
            while upto < hi and self.common[upto] > depth:
                upto += 1
            own = min(self.common[at + 1 : upto], default=len(self.seqs[self.order[at]])) if upto > at + 1 else len(self.seqs[self.order[at]])
            yield at, upto, own
            at = upto

    def join(self, probes: list[np.ndarray], probe_sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(probe, stored) positions of all pairs at or above the threshold."""
        words = np.unique(np.concatenate(self.seqs))
        step = max(1, CELLS // max(1, len(words)))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for s in range(0, len(probes), step):
            some = probes[s : s + step]
            has = np.zeros((len(some), len(words) + 1), np.uint8)
            for r, p in enumerate(some):
                at = np.searchsorted(words, p)
                at = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == p)]
                has[r, at] = 1
            found += self._walk(words, has, probe_sizes[s : s + step], percent, s)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def _walk(self, words, has, sizes, percent, base) -> list[tuple[np.ndarray, np.ndarray]]:
        found = []
        lengths = np.array([len(self.seqs[i]) for i in self.order])
        ns = self.sizes[self.order]
        left_in_probe = has.sum(1, dtype=np.int64)
        stack = [(0, len(self.order), 0, np.arange(len(has)), np.zeros(len(has), np.int64))]
        while stack:
            lo, hi, depth, live, overlap = stack.pop()
            for a, b, end in self.children(lo, hi, depth):
                segment = np.searchsorted(words, self.seqs[self.order[a]][depth:end])
                total = overlap + has[np.ix_(live, segment)].sum(1, dtype=np.int64)
                # Below this node a set has at most so many tokens left, and a probe so many that it has not met.
                ahead = np.minimum(lengths[a:b].max() - end, left_in_probe[live] - total)
                can = (100 + percent) * (total + ahead) >= percent * (sizes[live] + ns[a:b].min())
                rows, got = live[can], total[can]
                if not len(rows):
                    continue
                inner = a
                while inner < b and lengths[inner] == end:  # sets that end at this node come first
                    good = (100 + percent) * got >= percent * (sizes[rows] + ns[inner])
                    found.append((rows[good] + base, np.full(int(good.sum()), self.order[inner])))
                    inner += 1
                if inner < b:
                    stack.append((inner, b, end, rows, got))
        return found


def _trie_join(percent: int):
    """Groups (g, chunk) arrive sorted; each is joined once it is whole. Gives a forest of the links."""

    def join(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        probe = part["probe"].to_numpy(bool)
        stored, asks = part[~probe], part[probe]
        if not len(stored) or not len(asks):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        seqs = [np.asarray(k, np.int64) for k in stored["keys"]]
        q, s = Trie(seqs, stored["n"].to_numpy()).join([np.asarray(k, np.int64) for k in asks["keys"]], asks["n"].to_numpy(), percent)
        a, b = asks["rep"].to_numpy()[q], stored["rep"].to_numpy()[s]
        return forest(a[a != b], b[a != b])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for part in batches:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            g, c = held["g"].to_numpy(), held["chunk"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]))
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                a, b = join(held.iloc[s:e])
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b})
            held = held.iloc[starts[-1] :].reset_index(drop=True) if len(starts) else held
        if held is not None and len(held):
            a, b = join(held)
            yield pd.DataFrame({"a": a, "b": b})

    return run


def _meet(members: DataFrame, sets: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Links found in groups ``members`` (g, rep, probe): every probe row against every other row of its group.

    A group with more than ``chunk`` stored rows is split; each stored row is in
    one chunk and each probe goes to all of them.
    """
    sized = members.where("not probe").groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > chunk).select("g", F.ceil(F.col("c") / chunk).cast("int").alias("k"))
    cut = attach(members, sized, "g", F.col("rep"), 16).withColumn("k", F.coalesce("k", F.lit(1)))
    one = F.array(F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    dealt = cut.select("g", "rep", "probe", F.explode(F.when(F.col("probe"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(one)).alias("chunk"))
    filled = dealt.join(sets.select("rep", "n", "keys"), "rep")
    return filled.repartition("g", "chunk").sortWithinPartitions("g", "chunk").mapInPandas(lean(_trie_join(percent)), "a bigint, b bigint")


def _may_link(percent: int, a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Whether sets of sizes and positions (n, pos) can reach the threshold if the shingle at these positions is their first common one."""
    (n, pos), (m, at) = ([F.col(c) for c in x] for x in (a, b))
    return (100 + percent) * F.least(n - pos, m - at) >= percent * (n + m)


def _size_class(n: Column, percent: int) -> Column:
    """Classes of sizes, so wide that a set reaches few neighbouring ones. It rises with ``n``."""
    return F.floor(F.ln(n.cast("double")) / math.log(100 / percent)).cast("int")


def link_documents(
    df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when 100 * intersection >= ``percent`` * union of their shingle sets.

    A-Z are lower-cased and words are runs of characters other than ASCII white
    space. A text of fewer than ``words`` words is one shingle; a null, empty or
    blank one has none and links with nothing. Repeated rows of an id come back
    as often as they came. A null id gets a null component and links with
    nothing. Sets are compared by 64-bit hashes of their shingles (58 bits and
    the frequency class once ordered). Other columns are ignored. An empty table
    gives no rows.
    """
    scratch = Scratch(df.sparkSession, "ngrams")
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    some = docs.where("doc_id is not null")
    enough = scratch.keep(_survivors(some, words, percent).where("enough").select("doc_id").distinct(), "enough")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for ids, sets in _doc_sets(batches, words):
            sig = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "sig"])

    signed = scratch.keep(docs.mapInArrow(lean(sign), "doc_id bigint, n bigint, sig binary"), "signed")
    classes = signed.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("times"))
    reps = classes.select("rep").distinct().join(enough, F.col("rep") == F.col("doc_id"), "left_semi")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _doc_sets(batches, words):
            for s in range(0, len(ids), 500):
                keys = [x.view(np.int64) for x in sets[s : s + 500]]
                yield pa.record_batch([pa.array(ids[s : s + 500], pa.int64()), pa.array([len(k) for k in keys], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["rep", "n", "h"])

    # The chosen ids grow with the corpus, so texts and ids meet by a sorted merge at every size; repeated rows fold where they lie.
    chosen = some.hint("merge").join(reps.withColumnRenamed("rep", "__rep").hint("merge"), F.col("doc_id") == F.col("__rep"), "left_semi")
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"))
    raw = scratch.keep(chosen.mapInArrow(lean(sets_of), "rep bigint, n bigint, h array<bigint>"), "raw")
    each = raw.select("rep", F.explode("h").alias("h"))
    held = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # The global order: frequency class, then hash.
    rank = F.shiftleft(F.ceil(F.log2("df")).cast("bigint"), 57).bitwiseOR(F.shiftrightunsigned("h", 7))
    keyed = each.join(held, "h").groupBy("rep").agg(F.sort_array(F.collect_list(rank)).alias("keys"))
    sets = raw.select("rep", "n").join(keyed, "rep").where(100 * F.size("keys") >= percent * F.col("n"))
    # The prefix holds all shingles of no other class first; what is left of its length goes along the order.
    prefix = F.size("keys") + 1 - F.expr(f"(n * {percent} + 99) div 100")
    sets = scratch.keep(sets.withColumn("prefix", prefix.cast("int")).where("prefix > 0"), "sets")
    scratch.drop(raw)

    tokens = sets.select("rep", "n", (F.col("n") - F.size("keys")).alias("before"), F.posexplode(F.slice("keys", F.lit(1), F.col("prefix"))).alias("at", "token"))
    tokens = tokens.select("rep", "n", (F.col("before") + F.col("at")).alias("pos"), "token")
    # Shingles that the same classes hold stand for one another: the first of them is the only one that can be a pair's first common one.
    lists = tokens.groupBy("token").agg(
        F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("x"), F.sum(F.xxhash64(F.lit(1), "rep").cast("decimal(20,0)")).alias("y"), F.min(F.struct("rep", "n", "pos")).alias("low")
    ).where("c > 1")
    lists = lists.groupBy("c", "x", "y").agg(F.min(F.struct("token", "low")).alias("m"))
    lists = scratch.keep(lists.select("m.token", F.col("m.low.rep").alias("low"), F.col("m.low.n").alias("low_n"), F.col("m.low.pos").alias("low_pos")), "lists")
    kept = scratch.keep(attach(tokens, lists, "token", F.col("rep"), 16).where("low is not null and rep <> low"), "kept")

    pairs = kept.where(_may_link(percent, ("n", "pos"), ("low_n", "low_pos"))).select(F.col("low").alias("g"), "rep").distinct()
    star = pairs.withColumn("probe", F.lit(False)).unionByName(pairs.select("g", F.col("g").alias("rep")).distinct().withColumn("probe", F.lit(True)))
    links = scratch.keep(_meet(star, sets, percent, chunk), "links")
    joined = components(scratch, links).withColumnsRenamed({"node": "rep", "root": "comp"})
    # The smallest class of a shingle has met all others already; the others meet where they are of several components.
    placed = scratch.keep(kept.join(joined, "rep", "left").select("token", "rep", "n", "pos", F.coalesce("comp", "rep").alias("comp")), "placed")
    spread = placed.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp"))["comp"].alias("main")).where("comps > 1")
    members = attach(placed, spread.select("token", "main"), "token", F.col("rep"), 16).where("main is not null")
    # A probe goes to the classes of the sizes that it can link with from this position on.
    least, most = F.expr(f"(n * {percent} + 99) div 100"), F.expr(f"({100 + percent} * (n - pos) - {percent} * n) div {percent}")
    asks = members.where((F.col("comp") != F.col("main")) & (most >= least)).withColumn("cls", F.explode(F.sequence(_size_class(least, percent), _size_class(most, percent))))
    both = members.withColumn("cls", _size_class(F.col("n"), percent)).withColumn("probe", F.lit(False)).unionByName(asks.withColumn("probe", F.lit(True)))
    both = scratch.keep(both.select(F.xxhash64("token", "cls").alias("g"), "rep", "comp", "probe"), "both")
    useful = both.groupBy("g").agg(F.count_if("probe").alias("asks"), F.count_if(~F.col("probe")).alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    useful = useful.where("asks > 0 and held > 0 and low <> high").select("g", F.lit(True).alias("useful"))
    more = _meet(attach(both, useful, "g", F.col("rep"), 16).where("useful").select("g", "rep", "probe"), sets, percent, chunk)
    roots = components(scratch, links.unionByName(more)).withColumnsRenamed({"node": "rep", "root": "comp"})

    of_class = classes.join(roots, "rep", "left").where("times > 1 or comp is not null").select("sig", F.coalesce("comp", "rep").alias("comp"))
    out = attach(signed, of_class, "sig", F.col("doc_id"), 16)
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"))
