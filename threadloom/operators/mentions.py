"""Titles that a text holds as whole words outside a link.

Titles go into a trie of tokens that every task walks once along each of its
texts, so a text never leaves its row and a word that is common in texts costs a
look-up, not a join. Titles are taken in blocks of bounded size; each block is
one pass over the texts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 4_000_000
TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]", re.DOTALL)
# What a link and a day title look like, and the length below which a title is no mention.
LINK = re.compile(r"\[\[[^\]]*\]\]")
DAY_TITLE = r"^(January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}(?:st|nd|rd|th), \d{4}$"
LEAST_TITLE = 4
END = None


def title_trie(titles: list[tuple[object, str]]) -> dict:
    """Nested dicts from lower-case token to the next level; under ``END`` the ids of the titles that end there."""
    root: dict = {}
    for key, title in titles:
        at = root
        for token in TOKEN.findall(title):
            at = at.setdefault(token.lower(), {})
        at.setdefault(END, []).append(key)
    return root


def mentioned(text: str, root: dict) -> set:
    """Ids of the titles that stand in ``text`` between non-word characters, at least once not inside a link."""
    spans = [(m.group().lower(), m.start(), m.end()) for m in TOKEN.finditer(text)]
    links = [m.span() for m in LINK.finditer(text)]
    opens = [a for a, _ in links]
    found: set = set()
    word = lambda i: 0 <= i < len(spans) and spans[i][0][0].isascii() and spans[i][0][0].isalnum()
    for i, (token, start, _) in enumerate(spans):
        at = root.get(token)
        if at is None or (not word(i) and word(i - 1)):
            continue
        k = i
        while at is not None:
            if END in at and not (word(k + 1) and not word(k)):
                link = bisect_right(opens, start) - 1
                if link < 0 or spans[k][2] > links[link][1]:
                    found.update(at[END])
            k += 1
            at = at.get(spans[k][0]) if k < len(spans) else None
    return found


def unlinked_mentions(texts: DataFrame, titles: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(uid, title_uid) for texts (uid, text) that name a title (uid, title) of another uid, once per pair of rows.

    Case does not matter. Titles that are days or under four characters do not
    count, blanks around a title are not part of it, and null texts, titles and
    ids name nothing. Titles are dealt over as many blocks as their summed length
    asks for, so what a task holds does not grow with the number of titles.
    """
    kept = titles.where("uid IS NOT NULL AND title IS NOT NULL").select("uid", F.trim("title").alias("title"))
    kept = kept.where((F.length("title") >= LEAST_TITLE) & ~F.col("title").rlike(DAY_TITLE))
    chars = kept.agg(F.coalesce(F.sum(F.length("title")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    kind = {"uid": texts.schema["uid"].dataType.simpleString(), "title_uid": titles.schema["uid"].dataType.simpleString()}
    rows = texts.where("uid IS NOT NULL AND text IS NOT NULL").select("uid", "text")
    out = None
    for block in range(blocks):
        mine = kept.where(F.pmod(F.xxhash64("uid", "title"), F.lit(blocks)) == block)
        shared = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in mine.collect()])  # about ``block_chars``
        found = rows.mapInArrow(_walker(shared), f"uid {kind['uid']}, title_uid {kind['title_uid']}")
        out = found if out is None else out.unionByName(found)
    return out.where("uid IS DISTINCT FROM title_uid") if kind["uid"] == kind["title_uid"] else out


def _walker(shared):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = title_trie(shared.value)
        for batch in batches:
            uids, found = [], []
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for key in mentioned(text.as_py(), root):
                    uids.append(uid)
                    found.append(key)
            yield pa.record_batch([pa.array(uids, batch.schema.field(0).type), pa.array(found)] if found else [batch.column(0)[:0], pa.array([], pa.null())], names=["uid", "title_uid"])

    return walk
