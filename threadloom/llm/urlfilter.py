"""URL filters: allow and block rules, and a naive Bayes model over segmented names.

Host labels often run words together. A unigram model splits them by Viterbi
into the likeliest words, and a multinomial naive Bayes over the words of host
and path gives the chance that a page is unwanted. The model learns from urls
themselves: those whose host holds a word of a stated list are unwanted, all
others wanted. Rules go before the model; the longest rule that fits wins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VOCABULARY = 500_000
LONGEST_WORD = 24
LISTED_COUNT = 50
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that mark an unwanted host, and common words of host names; parameters with these defaults.
UNWANTED = ("adult", "ads", "bet", "bets", "casino", "farm", "loan", "loans", "pills", "porn", "poker", "spam", "track", "viagra", "warez", "xxx")
COMMON = ("best", "blog", "buy", "cheap", "com", "example", "free", "get", "mail", "my", "net", "news", "online", "org", "shop", "site", "the", "web", "win", "www")
#: The rules of the registered query: action, then host and path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://``; both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule whose host is the url's or a parent of it and whose path the url's begins with; else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def url_tokens(text: str) -> list[str]:
    """Runs of letters, lower-cased; a run of digits is the token 0."""
    return [t if t[0] not in "0123456789" else "0" for t in re.findall(r"[0-9]+|[^\W\d_]+", text.lower())]


@dataclass
class Model:
    words: dict[str, float]  # log probability
    total: float
    tokens: dict[str, tuple[float, float]]  # log likelihood (wanted, unwanted)
    unseen: tuple[float, float]
    prior: tuple[float, float]
    rare_words: DataFrame | None = None  # (w, n) of the words not in ``words``
    rare_tokens: DataFrame | None = None  # (w, odds) of the words not in ``tokens``

    def bare(self) -> Model:
        """Without the tables, for tasks."""
        return replace(self, rare_words=None, rare_tokens=None)

    def split(self, name: str, extra: dict[str, float] | None = None) -> list[str]:
        """Likeliest words of a run of letters; an unknown word costs ten times more for each letter."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - LONGEST_WORD), end):
                w = name[start:end]
                cost = self.words.get(w)
                if cost is None and extra:
                    cost = extra.get(w)
                if cost is None:
                    cost = math.log(10.0 / self.total) - len(w) * math.log(10.0)
                options.append((best[start][0] + cost, -start))
            score, start = max(options)
            best.append((score, -start))
        out, at = [], len(name)
        while at:
            out.append(name[best[at][1] : at])
            at = best[at][1]
        return out[::-1]

    def host_words(self, host: str, extra: dict[str, float] | None = None) -> list[str]:
        return [w for t in url_tokens(host) for w in ([t] if t == "0" else self.split(t, extra))]

    def odds(self, words: list[str]) -> float:
        pairs = [self.tokens.get(w, self.unseen) for w in words]
        return sum(u - w for w, u in pairs)


def _bounded(counts: DataFrame, n: str, most: int) -> tuple[pd.DataFrame, DataFrame | None]:
    """The ``most`` most frequent words of a table of counts, and a table of all others or None."""
    top = counts.orderBy(F.desc(n), "w").limit(most + 1).toPandas()
    if len(top) <= most:
        return top, None
    top = top.iloc[:most]
    last, word = int(top[n].iloc[-1]), F.lit(top["w"].iloc[-1])
    return top, counts.where((F.col(n) < last) | ((F.col(n) == last) & (F.col("w") > word)))


def _split_hosts(hosts: DataFrame, model: Model) -> DataFrame:
    """(host, words) of distinct hosts; words outside the tasks' vocabulary meet the parts of the hosts by a join."""
    shared = hosts.sparkSession.sparkContext.broadcast(model.bare())

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value.words
        for part in batches:
            for host in part["host"]:
                found = {t[i:j] for t in url_tokens(host) if t != "0" for i in range(len(t)) for j in range(i + 1, min(len(t), i + LONGEST_WORD) + 1)}
                rare = sorted(w for w in found if w not in known)
                yield pd.DataFrame({"host": [host] * len(rare), "w": rare}, dtype=object)

    met = hosts.mapInPandas(parts, "host string, w string").join(model.rare_words, "w")
    met = met.groupBy("host").agg(F.collect_list("w").alias("ws"), F.collect_list("n").alias("ns"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in batches:
            out = []
            for host, ws, ns in zip(part["host"], part["ws"], part["ns"], strict=True):
                extra = {} if ws is None else {w: math.log(n / m.total) for w, n in zip(ws, ns, strict=True)}
                out.append(m.host_words(host, extra))
            yield pd.DataFrame({"host": list(part["host"]), "words": out}, dtype=object)

    return hosts.join(met, "host", "left").mapInPandas(split, "host string, words array<string>")


def _with_words(rows: DataFrame, model: Model, host: str) -> DataFrame:
    """``rows`` with __words, the words of their hosts, or null where the tasks' vocabulary is the whole one."""
    if model.rare_words is None:
        return rows.withColumn("__words", F.lit(None).cast("array<string>"))
    words = _split_hosts(rows.select(F.col(host).alias("host")).distinct(), model)
    return rows.join(words.select(F.col("host").alias(host), F.col("words").alias("__words")), host)


def fit_urls(df: DataFrame, url: str = "url", vocabulary: int = VOCABULARY, unwanted=UNWANTED, common=COMMON) -> Model:
    """A model from the counts of all urls.

    Counts are tables made on Spark. The ``vocabulary`` most frequent words go to
    every task; further words stay in a table and reach their urls by a join, so
    the results do not depend on ``vocabulary``. The stated words enter the word
    model with a count of their own, so a table without urls gives a model too.
    """
    from threadloom.llm.shared import Scratch

    spark = df.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = split_url(F.col(url))
    rows = df.select(host.alias("host"), path.alias("path"))

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            c = Counter(t for text in [*part["host"], *part["path"]] for t in url_tokens(text))
            yield pd.DataFrame({"w": list(c.keys()), "n": list(c.values())}, dtype=object)

    listed_rows = spark.createDataFrame([(w, LISTED_COUNT) for w in (*unwanted, *common)], "w string, n bigint")
    counts = rows.mapInPandas(count_words, "w string, n bigint").unionByName(listed_rows).groupBy("w").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts, "words")
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    top, rare = _bounded(counts, "n", vocabulary)
    model = Model({w: math.log(n / total) for w, n in zip(top["w"], top["n"], strict=True)}, total, {}, (0.0, 0.0), (0.0, 0.0), rare)
    shared, listed = spark.sparkContext.broadcast(model.bare()), frozenset(unwanted)

    def count_classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = lru_cache(100_000)(lambda h: tuple(shared.value.host_words(h)))
        for part in batches:
            c: Counter = Counter()
            for host, path, given in zip(part["host"], part["path"], part["__words"], strict=True):
                w = words(host) if given is None else given
                bad = not listed.isdisjoint(w)
                for t in (*w, *url_tokens(path)):
                    c[bad, t] += 1
                c[bad, ""] += 1
            yield pd.DataFrame({"bad": [b for b, _ in c], "w": [t for _, t in c], "n": list(c.values())}, dtype=object)

    classes = _with_words(rows, model, "host").mapInPandas(count_classes, "bad boolean, w string, n bigint")
    classes = classes.unionByName(spark.createDataFrame([(True, w, 1) for w in sorted(listed)], "bad boolean, w string, n bigint"))
    of = lambda bad: F.sum(F.when(F.col("bad") == bad, F.col("n")).otherwise(0))
    tokens = scratch.keep(classes.groupBy("w").agg(of(False).alias("n0"), of(True).alias("n1"), F.sum("n").alias("n")), "tokens")
    found = tokens.where("w = ''").first()
    pages = [found["n0"], found["n1"]] if found else [0, 0]
    tokens = tokens.where("w <> ''")
    sums = tokens.agg(F.count("*"), F.sum("n0"), F.sum("n1")).first()
    sums = [(s or 0) + sums[0] + 1 for s in sums[1:]]
    top, rare = _bounded(tokens, "n", vocabulary)
    model.tokens = {w: (math.log((a + 1) / sums[0]), math.log((b + 1) / sums[1])) for w, a, b in zip(top["w"], top["n0"], top["n1"], strict=True)}
    if rare is not None:
        model.rare_tokens = rare.select("w", (F.log((F.col("n1") + 1) / F.lit(sums[1])) - F.log((F.col("n0") + 1) / F.lit(sums[0]))).alias("odds"))
    model.unseen = (math.log(1 / sums[0]),) * 2  # a word that no class has seen says nothing
    model.prior = tuple(math.log((p + 1) / (sum(pages) + 2)) for p in pages)
    return model


def _with_odds(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with __odds, the sum over words of host and path that are outside the tasks' vocabulary."""
    if model.rare_tokens is None:
        return rows.withColumn("__odds", F.lit(0.0))
    shared = rows.sparkSession.sparkContext.broadcast(model.bare())

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in batches:
            for host, path, given in zip(part["__host"], part["__path"], part["__words"], strict=True):
                words = m.host_words(host) if given is None else given
                c = Counter(w for w in (*words, *url_tokens(path)) if w not in m.tokens)
                yield pd.DataFrame({"__host": [host] * len(c), "__path": [path] * len(c), "w": list(c.keys()), "k": list(c.values())}, dtype=object)

    keys = ["__host", "__path"]
    urls = rows.select(*keys, "__words").dropDuplicates(keys)
    met = urls.mapInPandas(rare, "__host string, __path string, w string, k bigint").join(model.rare_tokens, "w")
    odds = met.groupBy(*keys).agg(F.sum(F.col("k") * F.col("odds")).alias("__odds"))
    return rows.join(odds, keys, "left").withColumn("__odds", F.coalesce("__odds", F.lit(0.0)))


def judge_urls(df: DataFrame, model: Model, url: str = "url", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with __host, __path, __rule, __verdict (allow or block) and __score, the model's chance of unwanted.

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and gets the model's prior. A host without letters has no words. Whole urls
    are read, however long; a host label is segmented in time linear in its length.
    """
    host, path = split_url(F.col(url))
    rows = df.withColumn("__host", host).withColumn("__path", path)
    rule, action = rule_for(F.col("__host"), F.col("__path"), rules)
    rows = rows.withColumn("__rule", rule).withColumn("__verdict", action)
    schema = StructType(list(rows.schema.fields)).add("__score", "double")
    rows = _with_odds(_with_words(rows, model, "__host"), model)
    columns = schema.fieldNames()
    shared = df.sparkSession.sparkContext.broadcast(model.bare())  # bounded by the vocabulary

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        of_host = lru_cache(100_000)(lambda h: m.odds(m.host_words(h)))
        prior = m.prior[1] - m.prior[0]
        for part in batches:
            of_words = [of_host(h) if w is None else m.odds(w) for h, w in zip(part["__host"], part["__words"], strict=True)]
            z = [prior + o + r + m.odds(url_tokens(p)) for o, r, p in zip(of_words, part["__odds"], part["__path"], strict=True)]
            s = pd.Series([1 / (1 + math.exp(-max(-500.0, min(500.0, v)))) for v in z], index=part.index, dtype=float)
            verdict = part["__verdict"].where(part["__verdict"].notna(), s.ge(threshold).map({True: "block", False: "allow"}))
            yield part.assign(__verdict=verdict, __score=s)[columns]

    return rows.mapInPandas(score, schema)
