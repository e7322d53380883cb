"""Removal of byte strings that occur earlier, by longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier.
Every window of that length has an anchor, its smallest hashed k-gram, and
equal windows have equal anchors at equal offsets. Consecutive windows of one
anchor form a run.

1. Blocks of documents send a hash of each run's anchor and of its whole bytes,
   packed by hash range. Runs equal to an earlier run go at once, within the
   block before anything is sent, so a passage with very many copies is one
   entry a block. Runs whose anchor no other run has stay.
2. What is left are distinct runs that share an anchor: the ends of copies, and
   chance. Their bytes meet by anchor. A suffix array of them, cut at
   ``length`` bytes, gives each suffix its previous and next smaller position
   in suffix order; where one of the two shares ``length`` bytes, the longest
   previous factor is that long and the window goes.
3. The windows of a document are merged and cut from its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import Scratch, lean, lean_group

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 1 << 20
SUFFIXES = 1 << 19
TABLE = np.random.default_rng(9).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
ENTRY = np.dtype([("h", "u8"), ("c", "u8"), ("doc", "i8"), ("s", "i4"), ("n", "u1"), ("off", "u1")])
SPAN = np.dtype([("doc", "i8"), ("s", "i4"), ("n", "u1"), ("off", "u1"), ("ask", "u1"), ("h", "u8")])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    made, step = 1, base
    while made < n:
        k = min(made, n - made)
        out[made : made + k] = out[:k] * np.uint64(step)
        made, step = made + k, step * step % (1 << 64)
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(BASE)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of each ``width`` neighbours."""
    at, v, span = np.arange(len(values), dtype=np.int64), values, 1
    while span < width:
        step = min(span, width - span)
        later = v[step:] < v[:-step]
        v, at, span = np.where(later, v[step:], v[:-step]), np.where(later, at[step:], at[:-step]), span + step
    return at


def stretches(text: bytes, length: int, most: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(start, bytes) of stretches of a text that together hold each of its windows once. A long text is not one block."""
    for at in range(0, max(1, len(text) - length + 1), most):
        yield at, text[at : at + most + length - 1] if len(text) > most else text


def runs_of(docs: list[bytes], ids: np.ndarray, base: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """An ``ENTRY`` for each run of windows of a block: anchor hash, hash of all bytes of the run, document, first start, windows, anchor offset.

    ``docs`` are stretches of the documents ``ids`` that start at ``base``.
    """
    sizes = np.array([len(d) for d in docs], np.int64)
    data = np.frombuffer(b"".join(docs), np.uint8)
    if not len(data) or sizes.max() < length:
        return np.zeros(0, ENTRY)
    up, down = _powers(BASE, len(data)), _powers(INVERSE, len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up, out=prefix[1:])
    grams = _mix((prefix[gram:] - prefix[:-gram]) * down[: len(data) - gram + 1])
    anchor = _least(grams, length - gram + 1)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(docs)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= ends[owner]
    p = np.flatnonzero(inside)
    a = anchor[p]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
    n = np.diff(np.append(first, len(p)))
    s, a = p[first], a[first]
    # A run is at most length - gram + 1 windows: all of them hold the anchor.
    out = np.zeros(len(first), ENTRY)
    # Smallest hashes crowd at the low end; mixed again they spread over the hash ranges.
    out["h"], out["n"], out["off"] = _mix(grams[a]), n, a - s
    out["c"] = _mix((prefix[s + n + length - 1] - prefix[s]) * down[s] + (a - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + n.astype(np.uint64))
    out["doc"], out["s"] = ids[owner[s]], s - (ends - sizes)[owner[s]] + base[owner[s]]
    return out


def _first_of_each(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (h, c, doc, s), and where in it a run begins that differs from the one before."""
    order = np.lexsort((e["s"], e["doc"], e["c"], e["h"]))
    h, c = e["h"][order], e["c"][order]
    return order, np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])


def _later(e: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """In that order: whether an equal run starts earlier (repeats of one row do not)."""
    begin = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (e["doc"][order] != e["doc"][order][begin]) | (e["s"][order] != e["s"][order][begin])


def _spans(e: np.ndarray, ask: int) -> np.ndarray:
    out = np.zeros(len(e), SPAN)
    for f in ("doc", "s", "n", "off", "h"):
        out[f] = e[f]
    out["ask"] = ask
    return out


def _text_bytes(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [b"" if v is None else v for v in batch.column(at).cast(pa.binary()).to_pylist()]


def _candidates(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, spans): a document's runs that go (ask 0) and those to compare by bytes (ask 1), packed."""
    parts = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        held: list[bytes] = []
        base: list[int] = []
        size = 0

        def emit() -> pa.RecordBatch:
            e = runs_of(held, np.array(ids, np.int64), np.array(base, np.int64), length, gram)
            order, new = _first_of_each(e)
            late = _later(e, order, new)
            gone, e = e[order[late]], e[order[new]]  # sorted by hash
            part = ((e["h"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(part, np.arange(parts + 1))
            rows = [(p, e[ends[p] : ends[p + 1]].tobytes()) for p in range(parts) if ends[p + 1] > ends[p]]
            if len(gone):
                rows.append((parts + block % parts, _spans(gone, 0).tobytes()))
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "block", "data"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), _text_bytes(batch, 1), strict=True):
                for at, part in stretches(text, length):
                    ids.append(i)
                    held.append(part)
                    base.append(at)
                    size += len(part)
                    if size >= BLOCK_BYTES:
                        yield emit()
                        block, ids, held, base, size = block + 1, [], [], [], 0
        if ids:
            yield emit()

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        if int(part["part"].iloc[0]) >= parts:
            return part[["block", "data"]]
        each = [np.frombuffer(d, ENTRY) for d in part["data"]]
        e = np.concatenate(each)
        block = np.repeat(part["block"].to_numpy(), [len(x) for x in each])
        order, new = _first_of_each(e)
        late = _later(e, order, new)
        h = e["h"][order]
        # Distinct runs of an anchor: more than one means that their bytes have to be compared.
        anchors = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        kinds = np.add.reduceat(new.astype(np.int64), anchors)
        shared = np.repeat(kinds > 1, np.diff(np.append(anchors, len(h))))
        ask = shared & ~late & new
        # A repeated row is not later than itself, and its bytes are asked for once.
        spans = np.concatenate([_spans(e[order[late]], 0), _spans(e[order[ask]], 1)])
        of = np.concatenate([block[order[late]], block[order[ask]]])
        by = np.argsort(of, kind="stable")
        spans, of = spans[by], of[by]
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        ends = np.append(cuts, len(of))[1:] if len(of) else cuts
        return pd.DataFrame({"block": of[cuts], "data": [spans[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]})

    def by_document(part: pd.DataFrame) -> pd.DataFrame:
        spans = np.concatenate([np.frombuffer(d, SPAN) for d in part["data"]])
        spans = spans[np.argsort(spans["doc"], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], spans["doc"][1:] != spans["doc"][:-1]]))
        ends = np.append(cuts, len(spans))[1:]
        return pd.DataFrame({"doc_id": spans["doc"][cuts], "spans": [spans[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]})

    sent = docs.where("doc_id is not null").mapInArrow(lean(pieces), "part int, block bigint, data binary")
    decided = sent.groupBy("part").applyInPandas(lean_group(decide), "block bigint, data binary")
    return decided.groupBy("block").applyInPandas(lean_group(by_document), "doc_id bigint, spans binary")


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of ``starts`` by the first ``depth`` symbols of their suffixes, whether each shares all of them with the one before).

    Ranks of 1, 2, 4, ... symbols by prefix doubling; two overlapping ranks cover ``depth``.
    """
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    span = 1
    while span * 2 <= depth:
        ahead = np.full(len(rank), -1, np.int64)
        ahead[: len(rank) - span] = rank[span:]
        rank = np.unique(rank * (len(rank) + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        span *= 2
    key = rank[starts] * (len(rank) + 1) + rank[starts + depth - span]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    return order, np.concatenate([[False], sorted_key[1:] == sorted_key[:-1]]) if len(order) else np.zeros(0, bool)


def has_previous_factor(position: np.ndarray, order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For each suffix: whether its previous or next smaller position in suffix order shares the full depth.

    Inside a stretch of suffixes that share it, a previous smaller position is a
    running minimum below the suffix's own, and a next smaller one likewise from behind.
    """
    pos = position[order].astype(np.int64)
    stretch = np.cumsum(~same)
    wide = int(pos.max()) + 2 if len(pos) else 1
    before = np.minimum.accumulate(pos - stretch * wide)
    after = np.minimum.accumulate((pos - (stretch.max() - stretch if len(stretch) else 0) * wide)[::-1])[::-1]
    out = np.zeros(len(pos), bool)
    low = np.minimum(before + stretch * wide, after + ((stretch.max() - stretch) if len(stretch) else 0) * wide)
    out[order] = low < pos
    return out


def _compare(frames: list[pd.DataFrame], length: int) -> pd.DataFrame:
    """Windows of the given runs (whole anchor groups) that start earlier in another one, as (doc_id, s, n) ranges."""
    part = pd.concat(frames, ignore_index=True)
    runs = list(part["data"])
    sizes = np.array([len(r) for r in runs], np.int64)
    n = sizes - length + 1
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    text = np.frombuffer(b"".join(runs), np.uint8)
    of = np.repeat(np.arange(len(runs)), n)
    t = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
    starts = begin[of] + t
    doc, s = part["doc_id"].to_numpy()[of], part["s"].to_numpy()[of].astype(np.int64) + t
    rank = np.empty(len(of), np.int64)
    by = np.lexsort((s, doc))
    changed = np.concatenate([[0], ((doc[by][1:] != doc[by][:-1]) | (s[by][1:] != s[by][:-1])).astype(np.int64)]) if len(of) else np.zeros(0, np.int64)
    rank[by] = np.cumsum(changed)
    order, same = suffix_order(text, starts, length)
    gone = has_previous_factor(rank, order, same)
    at = np.flatnonzero(gone)
    if not len(at):
        return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "s": np.zeros(0, np.int32), "n": np.zeros(0, np.int32)})
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])]))
    return pd.DataFrame({"doc_id": doc[at[cut]], "s": s[at[cut]].astype(np.int32), "n": np.diff(np.append(cut, len(at))).astype(np.int32)})


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the intervals [start, end), touching ones joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return s[first], reach[np.append(first[1:], len(s)) - 1]


def drop_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text", gram: int = GRAM, as_text: bool = False) -> DataFrame:
    """``df`` with __kept (binary: the bytes that stay), __n_bytes, __n_removed and __n_spans.

    With ``as_text`` __kept is a string, without the bytes of characters that a
    cut went through.

    A byte goes if a ``length``-byte string covering it starts earlier: in a
    document of smaller id, or earlier in the same one. Strings are judged on
    the input, overlaps count, and nothing crosses documents. A null text is
    empty; a text below ``length`` bytes stays whole, and so does a row with a
    null id, which takes no part. Rows that repeat an id are one document, so
    they do not remove one another; where their texts differ, what goes from
    one goes from each. An empty table gives no rows. Other columns may have any
    name but those four.
    """
    scratch = Scratch(df.sparkSession, "repeats")
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    flagged = scratch.keep(_candidates(docs, length, gram), "flagged")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            a, b = [], []
            for data in part["spans"]:
                x = np.frombuffer(data, SPAN)
                a.append(x[x["ask"] == 0].tobytes())
                b.append(x[x["ask"] == 1].tobytes())
            yield pd.DataFrame({"doc_id": part["doc_id"], "gone": a, "asks": b})

    known = flagged.mapInPandas(lean(split), "doc_id bigint, gone binary, asks binary")
    asked = known.where("length(asks) > 0").groupBy("doc_id").agg(F.collect_list("asks").alias("asks"))

    def bytes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows: list[tuple] = []
            for doc, body, asks in zip(part["doc_id"], part["text"], part["asks"], strict=True):
                data, x = body.encode(), np.frombuffer(b"".join(asks), SPAN)
                for h, s, n in zip(x["h"].view(np.int64).tolist() if len(x) else [], x["s"].tolist(), x["n"].tolist(), strict=True):
                    run = data[s : s + n + length - 1]
                    if len(run) == n + length - 1:
                        rows.append((h, doc, s, run))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["h", "doc_id", "s", "data"])
                    rows = []
            yield pd.DataFrame(rows, columns=["h", "doc_id", "s", "data"])

    near = docs.where("text is not null").join(asked, "doc_id").mapInPandas(lean(bytes_of), "h bigint, doc_id bigint, s int, data binary").dropDuplicates(["h", "doc_id", "s"])

    def lpf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for part in batches:
            if not len(part):
                continue
            held.append(part)
            size += int(part["data"].map(len).sum())
            if size >= SUFFIXES:
                every = pd.concat(held, ignore_index=True)
                last = every["h"].iloc[-1]
                whole = every["h"] != last  # the last anchor's group may go on
                if whole.any():
                    yield from _in_chunks(every[whole], length)
                    held = [every[~whole]]
                    size = int(held[0]["data"].map(len).sum())
        if held:
            yield from _in_chunks(pd.concat(held, ignore_index=True), length)

    windows = near.repartition("h").sortWithinPartitions("h").mapInPandas(lean(lpf), "doc_id bigint, s int, n int")
    found = windows.select("doc_id", F.struct("s", "n").alias("w")).groupBy("doc_id").agg(F.collect_list("w").alias("windows"))
    gone = known.where("length(gone) > 0").groupBy("doc_id").agg(F.collect_list("gone").alias("gone"))
    cuts = gone.join(found, "doc_id", "full").withColumnRenamed("doc_id", "__id")
    names = df.columns
    # The caller's columns go under numbers while they meet the cuts, so no name of theirs can clash.
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    met = plain.join(cuts.toDF("id", "x0", "x1"), F.col(f"c{names.index(id_col)}").cast("bigint") == F.col("id"), "left").drop("id")
    schema = df.select(*[F.col(f"`{c}`") for c in names], (F.lit("") if as_text else F.lit(b"")).alias("__kept"), F.lit(0).cast("bigint").alias("__n_bytes"), F.lit(0).cast("bigint").alias("__n_removed"), F.lit(0).cast("bigint").alias("__n_spans")).schema
    at = names.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed, spans = [], [], [], []
            for data, packed, wins in zip(_text_bytes(batch, at), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                x = np.frombuffer(b"".join(packed or []), SPAN)
                w = np.array([(v["s"], v["n"]) for v in wins or []], np.int64).reshape(-1, 2)
                s = np.concatenate([x["s"].astype(np.int64), w[:, 0]])
                e = np.minimum(s + np.concatenate([x["n"].astype(np.int64), w[:, 1]]) + length - 1, len(data))
                s, e = merged(s[s < e], e[s < e])
                edges = [0, *np.stack([s, e], 1).reshape(-1).tolist(), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if len(s) else data)
                total.append(len(data))
                removed.append(int((e - s).sum()))
                spans.append(len(s))
            out = [*batch.columns[: len(names)], pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "__kept", "__n_bytes", "__n_removed", "__n_spans"])

    return met.select(*plain.columns, "x0", "x1").mapInArrow(lean(cut), schema)


def _in_chunks(part: pd.DataFrame, length: int) -> Iterator[pd.DataFrame]:
    """Whole anchor groups in chunks of about ``SUFFIXES`` bytes; a larger group is cut by a hash of each window, so equal windows stay together."""
    sizes = part["data"].map(len).to_numpy()
    h = part["h"].to_numpy()
    cuts = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h))
    group: list[pd.DataFrame] = []
    held = 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = int(sizes[a:b].sum())
        if own > 4 * SUFFIXES:
            yield from _by_window(part.iloc[a:b], length, -(-own * 4 // SUFFIXES))
            continue
        group.append(part.iloc[a:b])
        held += own
        if held >= SUFFIXES:
            yield _compare(group, length)
            group, held = [], 0
    if group:
        yield _compare(group, length)


def _by_window(part: pd.DataFrame, length: int, pieces: int) -> Iterator[pd.DataFrame]:
    """The windows of one large group in ``pieces`` by a hash of each, made once."""
    runs = list(part["data"])
    text = b"".join(runs)
    data, sizes = np.frombuffer(text, np.uint8), np.array([len(r) for r in runs], np.int64)
    n = sizes - length + 1
    of = np.repeat(np.arange(len(runs)), n)
    t = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
    starts = (np.cumsum(sizes) - sizes)[of] + t
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * _powers(BASE, len(data)), out=prefix[1:])
    piece = _mix((prefix[starts + length] - prefix[starts]) * _powers(INVERSE, len(data) + 1)[starts]) % np.uint64(pieces)
    doc, s = part["doc_id"].to_numpy(), part["s"].to_numpy().astype(np.int64)
    for k in range(pieces):
        at = np.flatnonzero(piece == k)
        if len(at):
            yield _compare([pd.DataFrame({"doc_id": doc[of[at]], "s": s[of[at]] + t[at], "data": [text[p : p + length] for p in starts[at].tolist()]})], length)
