"""Title mentions against a scan of all titles, and mention reasons of pairs."""

from __future__ import annotations

import random
import re

import pytest

from threadloom.operators import mentions, relations


def _scan(text, title):
    """Start of an occurrence between non-word characters that no link holds."""
    links = [m.span() for m in re.finditer(r"\[\[[^\]]*\]\]", text)]
    for m in re.finditer(rf"(?=(?:^|(?<![A-Za-z0-9]))({re.escape(title)})(?![A-Za-z0-9]))", text, re.IGNORECASE):
        if not any(a <= m.start(1) and m.end(1) <= b for a, b in links):
            return True
    return False


@pytest.mark.parametrize("block", [4_000_000, 12])
def test_mentions_equal_a_scan_of_all_titles(spark, block):
    rng = random.Random(3)
    titles = ["road", "road map", "Road Map plan", "map plan", "the", "them", "a-b c", "-dash", "dash-", "C++", "Ärger", "x [[y", "[[road]]", "]] road", "two  blanks", "1234", "road.map"]
    words = ["road", "map", "plan", "the", "them", "roads", "a-b", "c", "-dash", "dash-", "C++", "Ärger", "x", "[[y", "[[road]]", "[[road map", "]]", "]] road", "two  blanks", "1234", "12345", "road.map", "\n", "ROAD", "ärger"]
    texts = [rng.choice(["", "q"]) + rng.choice([" ", "", ", "]).join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(400)] + ["", "road " * 20000, "[[" + "road " * 2000 + "]]"]
    df = spark.createDataFrame([*enumerate(texts), (None, "road"), (900, None)], "uid long, text string")
    names = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(titles)] + [("again", " road "), ("day", "May 1st, 2020"), ("short", "x"), (None, "road"), ("none", None)], "uid string, title string")
    got = sorted((r["uid"], r["title_uid"]) for r in mentions.unlinked_mentions(df, names, block).collect())
    usable = [(f"t{i}", t) for i, t in enumerate(titles) if len(t) >= 4] + [("again", "road")]
    assert got == sorted((i, key) for i, text in enumerate(texts) for key, t in usable if _scan(text, t))
    assert mentions.unlinked_mentions(df, names.limit(0)).count() == 0 and mentions.unlinked_mentions(df.limit(0), names).count() == 0
    same = spark.createDataFrame([(1, "road map"), (2, "a map")], "uid long, text string")
    own = spark.createDataFrame([(1, "road map"), (2, "road")], "uid long, title string")
    assert [(r["uid"], r["title_uid"]) for r in mentions.unlinked_mentions(same, own).collect()] == [(1, 2)]


def test_mention_is_the_weaker_reason(spark):
    cards = spark.createDataFrame([("x", i) for i in range(1, 6)] + [("y", 1), ("y", 2)], "board string, uid int")
    names = spark.createDataFrame([("x", 1, "n"), ("x", 2, "n"), ("x", 4, "m"), ("x", 5, "m")], "board string, uid int, name string")
    found = spark.createDataFrame([(1, 2, "Two"), (3, 1, "One"), (1, 3, "Three"), (4, 3, "Three"), (4, 9, "Nine")], "uid int, title_uid int, title string")
    none = cards.select("board", cards.uid.alias("a"), cards.uid.alias("b")).limit(0)
    gone = spark.createDataFrame([("x", 5, 4)], "board string, a int, b int")
    got = [tuple(r) for r in relations.suggest_pairs(cards, names, none, gone, mentions=found).select("board", "pos", "a", "b", "reason", "score").orderBy("board", "pos").collect()]
    assert got == [("x", 1, 1, 2, "n", 2), ("x", 2, 1, 3, "Three", 1), ("x", 3, 3, 4, "Three", 1), ("y", 1, 1, 2, "Two", 1)]
