"""Scores that keep words in their part and texts in their page."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import evaluation


def test_placement_keeps_words_in_their_part(spark):
    parts = [("d", 30, ["a", "a", "b", None]), ("d", 31, ["b", "c", "x"]), ("d", 32, ["c", "b", "y"]), ("d", 34, ["c"]), ("e", 31, ["b"]), ("f", 1, []), ("g", 1, None), (None, 31, ["b"])]
    held = [("d", 31, ["b", "b", None]), ("d", 31, ["x"]), ("d", 33, ["y", "c"]), (None, 31, ["b"])]
    rows = lambda data: spark.createDataFrame(data, "doc string, pos int, words array<string>")
    got = sorted(tuple(r) for r in evaluation.placement_score(rows(parts), rows(held)).select(F.coalesce("doc", F.lit("-")), "total", "own", "neighbour").collect())
    assert got == [("-", 1, 0, 0), ("d", 11, 2, 5), ("e", 1, 0, 0)]


def test_distance_of_a_text_that_only_lacks_characters(monkeypatch):
    whole = "the quick brown fox jumps over the lazy dog " * 400
    monkeypatch.setattr(evaluation, "_places", lambda text: 1 / 0)  # the table of the whole text is not needed
    assert evaluation.text_distance(whole, whole.replace("e", "")) == whole.count("e")
    assert evaluation.text_distance(whole.replace("o", ""), whole) == whole.count("o")


def test_words_found_are_counted_in_their_pair(spark):
    pairs = spark.createDataFrame([(1, "a b b c", "b x B a"), (2, "a b", None), (3, None, "a"), (4, "", "a"), (5, "abc", "axc d")], "doc int, truth string, pred string")
    found = evaluation.cer_counts(pairs)
    got = sorted(tuple(r) for r in found.select("doc", "char_dist", "char_n", "found", "word_n").collect())
    assert got == [(1, 3, 4, 3, 4), (2, 2, 2, 0, 2), (3, 1, 0, 0, 0), (4, 1, 0, 0, 0), (5, 2, 3, 0, 1)]
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_furniture_is_judged_in_one_pass(spark):
    data = [
        ("a", "Page 1 .", True, False, False), ("a", "page 1.", False, True, True), ("a", "Foot", False, True, False), ("a", None, False, True, None), ("a", "", True, False, False),
        ("b", "x", False, False, True), ("c", "y", None, True, False), ("c", "Y", False, True, False), ("d", "z", True, True, True), ("d", "z", True, False, False),
    ]
    lines = spark.createDataFrame(data, "doc string, text string, removed boolean, truth boolean, body boolean")
    got = sorted(tuple(r) for r in evaluation.furniture_score(lines).select("doc", "removed", "missing", "leaked").collect())
    assert got == [("a", 2, 1, 1), ("c", 0, 1, 0), ("d", 1, 0, 1)]


def test_every_folded_form_is_seen(spark):
    forms = [*evaluation._WIDE, *evaluation._SMALL, *evaluation._LIGATURES, *"‐‑‒–—―−"]
    seen = spark.createDataFrame([(f"a{x}b",) for x in forms] + [("plain text, Größe façade ñ",)], "text string").select("text", F.col("text").rlike(evaluation._FOLDED).alias("seen"))
    assert [r["text"] for r in seen.collect() if not r["seen"]] == ["plain text, Größe façade ñ"]


def test_single_words_fold_as_before(spark):
    texts = ['"N"', "A-B.", "x\n", "Ab*", "a\x7f", "", "1,5", "ÄB", "word\t", "x5", "A 5", "µM", "it’s"]
    got = [r["k"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string").select("i", evaluation.norm_text(F.col("text")).alias("k")).orderBy("i").collect()]
    assert got == ['"n"', "a-b.", "x", "ab", "a\x7f", "", "1,5", "äb", "word", "x5", "a5", "μm", "it’s"]
