"""URL filter: longest-match rules, and for the rest naive Bayes over the words of hosts and paths.

Hosts are written without spaces, so each label is split into words first: a Viterbi search over the
unigram counts of all words of all pages, where an unknown stretch costs more the longer it is.  Counts
and labels meet in a join, so none is left out at any size.  The classifier is multinomial naive Bayes
over these words, as often as they stand in a url.  It starts from two fixed lists of names (``BAD``,
``GOOD``), which are its labelled examples; urls that it is sure of by these (``SURE``) then count as
examples too, all of them, and the verdict is by the counts of both.  A word that stands in neither
class says nothing.  The rules' own verdicts are no labels: they go by country and section, where the
same hosts stand on both sides.

Null url or one without ``://``: host and path are empty, no rule fits, and the verdict is allow.  A rule
with a path from ``/`` does not fit a url whose path is empty.  Rules are compared by bytes.  Very long
urls are split whole.  Repeated rows are judged alike, and so are rows without page_id; an empty table
gives an empty result.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outrate.llm.common import LOWER, UPPER, hot_join, table

#: Rule -> verdict: host, then path from its first slash.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Names of unwanted sites, as words.
BAD = (
    "online casino bonus", "casino royal", "big win slots", "poker stars bet", "sports bets live", "best bets today", "free spins casino", "lottery jackpot win", "payday loans fast", "cheap loans online",
    "cheap meds online", "viagra pills shop", "cialis generic cheap", "online pharmacy discount pills", "adult cams live", "adult dating", "xxx videos free", "porn tube free", "sex chat adult", "nude girls cams",
    "spam mail blast", "link farm", "spam links", "content farm seo", "seo backlinks cheap", "free download crack", "warez torrent download", "keygen serial crack", "replica watches cheap", "fake rolex replica",
    "ads server click", "popup ads network", "banner ads pixel", "click track pixel", "ad tracker", "malware update", "phishing login verify", "hack tools free", "escort service adult", "gambling tips bet",
)
#: Names of other sites, as words.
GOOD = (
    "city library", "university research", "weather forecast today", "garden flowers", "organic farm market", "local news daily", "cooking recipes home", "travel guide europe", "history museum", "open source code",
    "health clinic", "school district", "music festival", "book reviews", "free library books", "job market report", "science journal", "bird watching club", "photo gallery art", "football club news",
    "train time table", "community center", "software documentation", "mountain hiking trails", "language learning", "family doctor", "car repair shop", "wine and cheese", "house and garden", "film archive",
    "math lessons", "town hall", "race track history", "win the marathon", "online dictionary", "radio live", "public health service", "cheap flights guide", "theatre tickets", "animal shelter",
)
#: Words of any host or path, which say nothing.
PLAIN = frozenset("www com org net example html htm php index http https blog m en de fr es ref page".split())
#: LONGEST word; what a rate of 0 in a class counts as; share of urls that are bad; log odds from which a url counts as an example.
LONGEST, LEAST, PRIOR, SURE = 20, 0.002, 0.1, 1.0
#: What each letter of an unknown stretch costs, and the share of all words that a word of the lists has at least.
UNKNOWN, KNOWN = 2.3, 1e-4


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = r.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(r)).otherwise(found)
    return found


def split(label: str, costs: dict[str, float], total: float) -> list[str]:
    """The cheapest split of a label into words; what is no word costs more the longer it is."""
    n, base = len(label), math.log(total)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - LONGEST), j):
            cost = best[i] + costs.get(label[i:j], base + UNKNOWN * (j - i))
            if cost < best[j]:
                best[j], back[j] = cost, i
    words, j = [], n
    while j:
        words.append(label[back[j] : j])
        j = back[j]
    return words[::-1]


def examples() -> list[tuple[str, int, int]]:
    """(word, bad, good): how often a word stands in the lists."""
    bad, good = (Counter(w for name in names for w in name.split() if w not in PLAIN) for names in (BAD, GOOD))
    return [(w, bad[w], good[w]) for w in sorted({*bad, *good})]


def unigrams(pages: DataFrame) -> DataFrame:
    """(word, n): counts of all words of all pages' visible text; words of the lists have a share of KNOWN at least."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^<>]*>", " "))
    counts = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).where(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))
    counts = table(counts, "counts")
    least = math.ceil(KNOWN * (counts.agg(F.sum("n")).first()[0] or 0)) or 1
    sure = pages.sparkSession.createDataFrame([(w, least) for w, _, _ in examples() if len(w) > 1], "word string, n long")
    return table(counts.union(sure).groupBy("word").agg(F.max("n").alias("n")), "unigrams")


def _split(total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [split(label, {x["word"]: math.log(total / x["n"]) for x in known}, total) for label, known in zip(b["label"].to_pylist(), b["known"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["label"], pa.array(out, pa.list_(pa.string()))], names=["label", "words"])

    return run


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """labels (label), each once -> label, words: its words in order.  Every part of a label that could be a word is looked up in
    the whole of counts by a join, and a task gets each label with what was found for it."""
    total = float((counts.agg(F.sum("n")).first()[0] or 0) + 1)
    # A long label is taken in stretches, so no row has more than 200 * LONGEST parts.
    stretch = F.explode(F.sequence(F.lit(0), F.length("label") - 1, F.lit(200))).alias("from")
    some = labels.select("label", stretch).select("label", F.expr(f"substring(label, from + 1, 200 + {LONGEST - 1})").alias("s"))
    at = "transform(sequence(1, least(200, length(s))), i -> transform(sequence(1, least({0}, length(s) - i + 1)), n -> substring(s, i, n)))".format(LONGEST)
    parts = some.select("label", F.explode(F.array_distinct(F.flatten(F.expr(at)))).alias("word")).where("length(word) > 1").distinct()
    known = hot_join(table(parts, "parts"), counts, ["word"]).groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return table(labels.join(known, "label", "left").select("label", F.coalesce("known", F.array().cast("array<struct<word:string,n:bigint>>")).alias("known")).mapInArrow(_split(total), "label string, words array<string>"), "split")


def odds(counts: DataFrame) -> DataFrame:
    """counts (word, b, g), words of bad and of good examples -> word, odds: log odds for bad, by the rates of both classes."""
    total = counts.agg(F.greatest(F.sum("b"), F.lit(1)).alias("nb"), F.greatest(F.sum("g"), F.lit(1)).alias("ng"))
    p, q = (F.log(F.col(x) / F.col(n) + LEAST) for x, n in (("b", "nb"), ("g", "ng")))
    return counts.crossJoin(F.broadcast(total)).select("word", (p - q).alias("odds"))  # one row of totals


def scores(words: DataFrame) -> DataFrame:
    """words (u1, u2, words), a written table -> u1, u2, score: log odds for bad of every url with words."""
    base = math.log(PRIOR / (1 - PRIOR))
    known = words.sparkSession.createDataFrame(examples(), "word string, b long, g long")
    each = words.select("u1", "u2", F.explode("words").alias("word"))
    first = each.join(F.broadcast(odds(known)), "word", "left")  # the words of the lists
    first = first.groupBy("u1", "u2").agg((F.lit(base) + F.coalesce(F.sum("odds"), F.lit(0.0))).alias("score"), F.collect_list("word").alias("words"))
    more = first.where(F.abs("score") > SURE).select((F.col("score") > 0).alias("bad"), F.explode("words").alias("word"))
    more = more.groupBy("word").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g"))
    every = table(known.union(more).groupBy("word").agg(F.sum("b").alias("b"), F.sum("g").alias("g")), "examples")
    found = hot_join(table(each, "url-words"), table(odds(every), "odds"), ["word"], "left")
    return found.groupBy("u1", "u2").agg((F.lit(base) + F.coalesce(F.sum("odds"), F.lit(0.0))).alias("score"))


def judge(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, host, path, rule, verdict, score (log odds for bad; null where a rule decides)."""
    host, path = parts(F.col("__url"))
    every = pages.select("page_id", F.col("url").alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    every = table(every.withColumns({"u1": F.xxhash64("host", "path"), "u2": F.xxhash64("path", "host")}), "urls")
    each = every.select("u1", "u2", "host", "path").dropDuplicates(["u1", "u2"])
    label = F.explode(F.split(F.lower(F.concat("host", F.lit(" "), "path")), r"[^\p{L}]+")).alias("label")
    labels = table(each.select("u1", "u2", label).where(F.col("label") != "").where(~F.col("label").isin(sorted(PLAIN))), "labels")
    words = hot_join(labels, segmented(labels.select("label").distinct(), unigrams(pages)), ["label"]).groupBy("u1", "u2").agg(F.flatten(F.collect_list("words")).alias("words"))
    words = table(words.withColumn("words", F.filter("words", lambda w: ~w.isin(sorted(PLAIN)))), "words")
    total, base = scores(words), math.log(PRIOR / (1 - PRIOR))
    out = hot_join(every, total, ["u1", "u2"], "left").withColumn("score", F.coalesce("score", F.lit(base))).withColumn("rule", rule(F.col("host"), F.col("path")))
    verdicts = reduce(lambda c, r: c.when(F.col("rule") == r, F.lit(RULES[r])), RULES, F.when(F.lit(False), ""))
    method = F.when((F.col("score") > 0) & (F.col("host") != ""), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdicts.otherwise(method).alias("verdict"), F.when(F.col("rule").isNull(), F.round("score", 6)).alias("score"))
