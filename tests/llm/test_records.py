"""Archives, packing and mixing: round trips and brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from threadloom.llm.mixing import mix_sources, mixed_documents
from threadloom.llm.packing import pack_documents, padding
from threadloom.llm.queries import tokenizer_path
from threadloom.llm.shared import Scratch
from threadloom.llm.warc import range_cuts, read_warc, write_warc

TOKENIZER = tokenizer_path("word_bpe_49k.json")
PAGES = "page_id long, url string, html string, sha string, top string"


def pages(spark):
    long = "<p>" + "é" * 1200
    rows = [(1, "http://a.org/x y\n", long), (7, None, long), (3, "http://b.org", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "n", long), (9, "u", ""), (4, "u", "short")]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES), rows


def test_archives_round_trip(spark):
    df, rows = pages(spark)
    scratch = Scratch(spark, "t")
    a, b = scratch.path("a"), scratch.path("b")
    first = write_warc(df, a, roll_bytes=700, shard_bytes=2000)
    second = write_warc(df.repartition(5), b, roll_bytes=700, shard_bytes=2000)
    files = sorted(map(tuple, first.collect()))
    assert len(files) > 2 and files == sorted(map(tuple, second.collect()))
    got = read_warc(spark, a).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    want = {i: (h or "").encode() for i, _, h in rows}
    for i, payload in want.items():
        for r in by[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
            if r.record_type == "response":
                assert bytes(r.payload) == payload
    assert {i: by[i][0].refers_to for i in by} == {1: 7, 3: 7, None: 7, 7: None, 4: None, 5: None, 6: None, 9: None}
    assert by[1][0].url == "http://a.org/x%20y%0A" and by[7][0].url is None


def test_archive_of_no_pages(spark):
    root = Scratch(spark, "t").path("none")
    df, _ = pages(spark)
    assert write_warc(df.limit(0), root).count() == 0
    assert read_warc(spark, root).count() == 0


def test_range_cuts_split_a_crowded_bucket(spark):
    df = spark.createDataFrame([(i,) for i in [*range(1000), 10**12]], "k long")
    from pyspark.sql import functions as F

    cuts = range_cuts(df, "k", F.lit(1), 100, buckets=8)
    edges = [-1, *cuts, 10**12]
    held = [sum(a < i <= b for i in [*range(1000), 10**12]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    assert sum(held) == 1001 and max(held) <= 225


def texts(spark, parts=3):
    rows = [(1, "Hello, World's  end"), (2, ""), (3, None), (4, "a <|endoftext|> b"), (None, "null id"), (5, "same"), (5, "same"), (6, "é" * 50 + " ΑΣ. " + "word " * 9000), (7, "x" * 40)]
    rows += [(100 + i, "some words here " * (i % 40)) for i in range(120)]
    return spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, start int, ids string").repartition(parts), rows


def test_packing_keeps_every_token_once(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    df, rows = texts(spark, 20)
    out = pack_documents(df, TOKENIZER, length=256, open_windows=3, fan_in=4)
    got = out.collect()
    want = defaultdict(int)
    for i, t in rows:
        want[i, np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], np.uint32).tobytes()] += 1
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
        assert r.length == len(r.ids) // 4
    for (i, data), times in want.items():
        mine = sorted(p for p in pieces[i, len(data) // 4] if p[1] == data[4 * p[0] : 4 * p[0] + len(p[1])])
        joined = b"".join(d for _, d in mine[::times])
        assert joined == data and len(mine) % times == 0
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 256
    share = padding(out, 256).first()
    assert share.tokens == sum(len(d) // 4 * n for (_, d), n in want.items()) and share.padding < 0.1
    assert pack_documents(df.limit(0), TOKENIZER).count() == 0


def test_digest_column_is_the_crc_of_the_ids(spark):
    from pyspark.sql import functions as F

    df, _ = texts(spark)
    for r in pack_documents(df, TOKENIZER).select("ids", F.crc32("ids").alias("c")).collect():
        assert r.c == zlib.crc32(bytes(r.ids))


def held_mb():
    import re

    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) / 1024


@pytest.mark.parametrize("grouped", [False, True])
def test_a_finished_function_gives_its_memory_back(grouped):
    from threadloom.llm.shared import lean, lean_group

    kept = []

    def work(part):
        before = [bytearray(100_000) for _ in range(2_000)]
        kept.append(bytearray(100_000))  # above what is freed, so the heap's end does not move
        return part, len(before)

    def run(batches):
        yield from map(work, batches)

    start = held_mb()
    got = [lean_group(work)(1)] if grouped else list(lean(run)([1]))
    assert got == [(1, 2_000)] and held_mb() - start < 60


def test_latin_words_are_cut_at_once_and_every_text_has_the_librarys_ids():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from threadloom.llm.packing import WordTokenizer, token_arrays

    lib, rng = Tokenizer.from_file(TOKENIZER), random.Random(5)
    odd = [*"abzAZ'stremvld09.,!~^`$<|>/ \t\n\x0b\x00\x1c\x7f\x85\xa0\xadÀÖ×ØÞßàö÷øÿµªºĀİıΣσςéÅﬁ漢字🙂\u3000\u200b٣Ⅷ", "\u0301", "\u212a", "'s", "'re", "<|"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "'sS's", "ÀÉß'S l'été"]
    assert [x.tolist() for x in token_arrays(TOKENIZER, pa.array(texts))] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    coder = WordTokenizer(TOKENIZER)
    plain = ["Été, l'hôtel's 42 straßen", None, "hôtel: straßen!"]
    ids, bounds, _ = coder.encode(pa.array([t or "" for t in plain]))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [lib.encode(t or "", add_special_tokens=False).ids for t in plain]
    assert set(coder.words) <= {""} and {"hôtel", "straßen", "'s", "4", "2"} <= set(coder.rows)


def water_fill(sizes, weights, most=3.0):
    """Targets by sharing the excess again and again."""
    total, fixed = float(sum(sizes)), {}
    while True:
        rest = total - sum(fixed.values())
        w = sum(weights[i] for i in range(len(sizes)) if i not in fixed)
        over = {i for i in range(len(sizes)) if i not in fixed and rest * weights[i] / w > most * sizes[i] + 1e-9}
        if not over:
            return [fixed[i] if i in fixed else rest * weights[i] / w for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}


def corpus(spark, parts=4):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 60)), "big") for i in range(400)]
    rows += [(1000 + i, "w " * int(rng.integers(1, 60)), s) for i in range(300) for s in [["Tiny", "a", "b", "c", None][i % 5]] if s != "Tiny" or i < 20]
    rows += [(5000, None, "a"), (5001, "", "b"), (5002, "\t \n", None), (1000, "w w", "void"), (None, "w w w", "c"), (7, "w w w", "rep"), (7, "w w w", "rep"), (5003, None, "nothing")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, lang string").repartition(parts), rows


def test_mix_meets_targets(spark):
    df, rows = corpus(spark)
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split())
    by = defaultdict(int)
    for _, t, s in rows:
        by[s] += size(t)
    order = sorted((s for s in by if s is not None)) + [None]
    want = dict(zip(order, water_fill([by[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == by[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        assert r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in ("big", "a", "b", None):
        assert taken[s] == pytest.approx(want[s], rel=0.05, abs=30)
    again = mix_sources(corpus(spark, 9)[0]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents_are_the_taken_copies(spark):
    df, _ = corpus(spark)
    want = {}
    for r in mix_sources(df).collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.copies
    out = mixed_documents(df)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, r.source] += 1
    assert {k: v for k, v in want.items() if v} == dict(got)
    assert mix_sources(df.limit(0)).count() == 0
