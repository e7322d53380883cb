"""Packing documents into fixed-length token sequences with bounded space.

Each partition keeps a fixed number of open windows. A document gives whole
windows of its own while it is longer than one; what is left is placed best-fit
in the open windows, and when none fits the fullest is emitted and a new one
opened. What partitions leave open is merged in rounds of bounded groups, each
of which keeps no more open windows than one partition did.

Tokenizing. The tokenizer splits at white space before anything else, so a text
is cut there and its words are dictionary-encoded. Distinct words of ASCII and
Latin-1 letters are cut into the tokenizer's pieces in one Arrow call, other
words one by one, and only pieces that this worker has not met go through the library.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import Scratch, lean, lean_group

LENGTH = 2048
OPEN = 64
FAN_IN = 16
CACHE_WORDS = 100_000
CACHE_PIECES = 400_000
STEP = 10_000
SLICE_BYTES = 4 << 20
#: Fixed values of the tokenizer file: its split pattern, and the opening of its special tokens.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of visible ASCII and letters of Latin-1, which no normal form changes, and the same split pattern for them in lower case.
LATIN = r"\A[\x21-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+\z"
LATIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+|[0-9]|[^a-z0-9\x{df}-\x{f6}\x{f8}-\x{ff}]+"
SPECIAL = "<|"
WORD_END = "</w>"

PIECE_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()), ("ids", pa.binary()),
]
PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, open boolean, ids binary"


class WordTokenizer:
    """Ids of whole texts, exactly as the library gives them, through a bounded cache of words."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.pieces = regex.compile(PIECES)
        self.plain = regex.compile(r"[\x21-\x7e\p{L}]+")
        size = self.lib.get_vocab_size()
        self.ends = np.array([(self.lib.id_to_token(i) or "").endswith(WORD_END) for i in range(size)], bool)
        self.words: dict[str, bytes] = {}
        # Of pieces: the row of each, and the ids of all rows end to end.
        self.rows: dict[str, int] = {}
        self.store, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of each piece) through one long text: every piece ends in its one token that ends a word."""
        ids = np.array(self.lib.encode(" ".join(pieces), add_special_tokens=False).ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(pieces) or cuts[-1] != len(ids):
            return _joined(self._library(pieces))
        return ids, np.diff(cuts, prepend=0)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words that are not in the cache; the first ones met, which are mostly the frequent ones, stay in it."""
        cut: dict[str, list[str]] = {}
        whole = []
        for w in new:
            if self.plain.fullmatch(w):
                n = unicodedata.normalize("NFC", w)
                n = "".join(c.lower() for c in n) if "Σ" in n else n.lower()
                cut[w] = self.pieces.findall(n)
            else:
                whole.append(w)
        found: dict[str, bytes] = {}
        for s in range(0, len(whole), STEP):
            found.update(zip(whole[s : s + STEP], self._library(whole[s : s + STEP]), strict=True))
        place = {p: i for i, p in enumerate(dict.fromkeys(p for ps in cut.values() for p in ps))}
        ids, ends = self._of_pieces(list(place), np.array([place[p] for ps in cut.values() for p in ps], np.int64))
        raw, at = ids.tobytes(), 0
        for w, ps in cut.items():
            found[w] = raw[4 * ends[at] : 4 * ends[at + len(ps)]]
            at += len(ps)
        if len(self.words) < CACHE_WORDS:
            self.words.update(found)
        return found

    def _of_pieces(self, pieces: list[str], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces ``at`` end to end, their bounds) for distinct ``pieces``."""
        rows = np.fromiter(map(self.rows.get, pieces, repeat(-1)), np.int64, len(pieces))
        store, lens = self.store, self.lens
        new = np.flatnonzero(rows < 0)
        if len(new):
            names = [pieces[i] for i in new.tolist()]
            made = [self._pieces(names[s : s + STEP]) for s in range(0, len(names), STEP)]
            rows[new] = np.arange(len(lens), len(lens) + len(new))
            store, lens = np.concatenate([store, *[m[0] for m in made]]), np.concatenate([lens, *[m[1] for m in made]])
            if len(self.rows) < CACHE_PIECES:
                self.rows.update(zip(names, rows[new].tolist(), strict=True))
                self.store, self.lens = store, lens
        return _gathered(store, lens, rows[at])

    def _latin(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of each word) of ``LATIN`` words: they are cut all at once, and only distinct pieces are looked up."""
        lists = pc.split_pattern(pc.utf8_rtrim(pc.replace_substring_regex(pc.utf8_lower(words), LATIN_PIECES, r"\0 "), " "), " ")
        codes = lists.flatten().dictionary_encode()
        ids, ends = self._of_pieces(codes.dictionary.to_numpy(zero_copy_only=False).tolist(), codes.indices.to_numpy(zero_copy_only=False))
        return ids, np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts end to end, bounds of each text, places of texts left out as they hold ``SPECIAL``) for a string array without nulls."""
        odd = np.flatnonzero(pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False))
        if len(odd):
            texts = pc.if_else(pc.match_substring(texts, SPECIAL), "", texts)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        codes = lists.flatten().dictionary_encode()
        words = codes.dictionary
        latin = pc.match_substring_regex(words, LATIN)
        some, lens = self._latin(words.filter(latin))
        others = words.filter(pc.invert(latin)).to_pylist()
        known = self.words
        more = self._learn([w for w in others if w not in known])
        rest, rest_lens = _joined([more[w] if w in more else known[w] for w in others])
        # Words of the store: first the Latin ones, then the others.
        store, lens = np.concatenate([some, rest]), np.concatenate([lens, rest_lens])
        first = latin.to_numpy(zero_copy_only=False)
        place = np.where(first, np.cumsum(first) - 1, len(words) - len(others) + np.cumsum(~first) - 1)
        ids, ends = _gathered(store, lens, place[codes.indices.to_numpy(zero_copy_only=False)])
        return ids, ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()], odd


def _gathered(store: np.ndarray, lens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the entries ``at`` of ``store`` end to end, their bounds); entries of ``lens`` ids lie in the store in order."""
    first = np.cumsum(lens) - lens
    each = lens[at]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
    return store[np.repeat(first[at] - ends[:-1], each) + np.arange(ends[-1])], ends


def _joined(table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, number of each entry)."""
    return np.frombuffer(b"".join(table), np.uint32), np.fromiter((len(b) >> 2 for b in table), np.int64, len(table))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_arrays(path: str, texts: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each text (null: empty), in order."""
    coder = tokenizer(path)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
        part = texts.slice(at, upto - at)
        ids, bounds, odd = coder.encode(part)
        special = {int(i): np.frombuffer(b, np.uint32) for i, b in zip(odd, coder._library([part[int(i)].as_py() for i in odd]), strict=True)} if len(odd) else {}
        for i in range(len(part)):
            yield special[i] if i in special else ids[bounds[i] : bounds[i + 1]]
        at = upto


class OpenWindows:
    """At most ``most`` open windows of ``length`` tokens; an item is a list of pieces that stay together."""

    def __init__(self, length: int, most: int, base: int):
        self.length, self.most, self.base, self.count = length, most, base, 0
        self.room: list[tuple[int, int]] = []  # (free, key), sorted
        self.held: dict[int, list[tuple]] = {}
        self.keys = 0

    def place(self, size: int, pieces: list[tuple]) -> list[tuple]:
        """Puts an item in the window it fills best; returns the pieces of a window that had to go."""
        i = bisect.bisect_left(self.room, (size, -1))
        gone: list[tuple] = []
        if i == len(self.room):
            if len(self.room) >= self.most:
                gone = self.close(self.room.pop(0)[1])
            self.keys += 1
            self.held[self.keys] = []
            bisect.insort(self.room, (self.length, self.keys))
            i = len(self.room) - 1
        free, key = self.room.pop(i)
        self.held[key] += pieces
        if free == size:
            gone += self.close(key)
        else:
            bisect.insort(self.room, (free - size, key))
        return gone

    def close(self, key: int, still_open: bool = False) -> list[tuple]:
        out, at = [], 0
        for doc, start, ids, total in self.held.pop(key):
            out.append((doc, start, len(ids) >> 2, total, self.base + self.count, at, still_open, ids))
            at += len(ids) >> 2
        self.count += 1
        return out

    def rest(self, still_open: bool) -> Iterator[list[tuple]]:
        for _, key in self.room:
            yield self.close(key, still_open)
        self.room = []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in PIECE_FIELDS]
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, PIECE_FIELDS, strict=True)], names=[n for n, _ in PIECE_FIELDS])


def pack_documents(
    df: DataFrame, tokenizer_path: str, length: int = LENGTH, open_windows: int = OPEN, end_id: int = 1, id_col: str = "doc_id", text: str = "text", fan_in: int = FAN_IN
) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A document is its token ids and then ``end_id``; a null or empty text is
    ``end_id`` alone. Pieces of a sequence lie gapless from 0; a document longer
    than ``length`` is cut into whole windows and a rest. Repeated rows and
    null ids are packed like any other. Other columns are ignored. An empty
    table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "pack")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        windows = OpenWindows(length, open_windows, TaskContext.get().partitionId() << 32)
        rows, held = [], 0
        end = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), token_arrays(tokenizer_path, batch.column(1)), strict=True):
                data = ids.tobytes() + end
                total, start = len(data) >> 2, 0
                while total - start >= length:
                    rows.append((doc, start, length, total, windows.base + windows.count, 0, False, data[4 * start : 4 * (start + length)]))
                    windows.count += 1
                    start += length
                if start < total:
                    rows += windows.place(total - start, [(doc, start, data[4 * start :], total)])
                held += len(data)
                if held > 4 << 20 and rows:
                    yield _batch(rows)
                    rows, held = [], 0
        for left in windows.rest(True):
            rows += left
        if rows:
            yield _batch(rows)

    made = scratch.keep(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(pack), PIECE_SCHEMA), "pieces")
    closed = made.where("not open")
    left = made.where("open").withColumn("grp", F.shiftright("sequence_id", 32)).withColumn("win", F.col("sequence_id"))
    groups, turn = left.agg(F.max("grp")).first()[0], 0
    while groups is not None:
        turn += 1
        left = left.withColumn("grp", F.floor(F.col("grp") / fan_in).cast("bigint"))
        final = groups < fan_in
        merged = scratch.keep(left.groupBy("grp").applyInPandas(lean_group(_merger(length, open_windows, turn, final)), f"{PIECE_SCHEMA}, grp bigint, win bigint"), f"turn{turn}")
        closed = closed.unionByName(merged.where("not open").drop("grp", "win"))
        if final:
            break
        left, groups = merged.where("open"), groups // fan_in
    return closed.drop("open")


def _merger(length: int, most: int, turn: int, final: bool):
    def merge(part: pd.DataFrame) -> pd.DataFrame:
        grp = int(part["grp"].iloc[0])
        windows = OpenWindows(length, len(part) if final else most, ((turn << 24) | grp) << 32)
        part = part.sort_values(["win", "offset"])
        items = [
            (int(w["length"].sum()), [(None if pd.isna(d) else int(d), int(s), bytes(i), int(t)) for d, s, i, t in zip(w["doc_id"], w["start"], w["ids"], w["doc_tokens"], strict=True)])
            for _, w in part.groupby("win", sort=True)
        ]
        rows: list[tuple] = []
        for size, pieces in sorted(items, key=lambda x: -x[0]):  # the longest first: the rest fill the gaps
            rows += windows.place(size, pieces)
        for left in windows.rest(not final):
            rows += left
        out = pd.DataFrame(rows, columns=[n for n, _ in PIECE_FIELDS]).astype({"doc_id": "Int64"})
        return out.assign(grp=grp, win=out["sequence_id"])

    return merge


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequences, tokens, padded share): a sequence is padded to ``length`` unless its own length is a power of two."""
    own = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    padded = F.when(F.bit_count("n") == 1, F.col("n")).otherwise(F.lit(length))
    return own.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), (1 - F.sum("n") / F.sum(padded)).alias("padding"))
