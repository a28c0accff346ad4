"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Counts are taken over whole texts.  Null or empty text: every count is 0 and the text is rejected by
``min_words``.  Null ids and repeated rows: each row is judged by itself.  An empty table gives an
empty result.  Extra columns are ignored by ``measure`` and carried along by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outrate.llm.common import words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is was be a that for on with as are by it this at or from an not he his which "
    "le la les de des du un une et en est que qui dans pour pas sur au avec par plus ce se "
    "der die das und ist ein eine zu den von mit sich auf nicht dem im es auch als "
    "el los las y del que una por con su para no lo al como mas"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects a text if ``scale * count > bound * per`` (or ``<`` for below), where ``per`` >= ``least``.

    Whole numbers on both sides, so that every engine decides alike.
    """

    name: str
    count: str
    bound: int
    per: str | None = None
    scale: int = 1
    below: bool = False
    least: int = 0

    def sql(self) -> str:
        left = f"{self.scale} * {self.count}"
        right = f"{self.bound} * {self.per}" if self.per else f"{self.bound}"
        test = f"({left} {'<' if self.below else '>'} {right})"
        return f"({self.per} >= {self.least} AND {test})" if self.per and self.least else test


#: The base rules; a text that fails one is always rejected.
BASE = (
    Rule("min_words", "n_words", 10, below=True),
    Rule("repeated_windows", "n_repeat_words", 20, "n_words", scale=100),
)
#: The method's own table: length, symbol, stop-word and line ratios.
TABLE = (
    Rule("short_words", "word_chars", 2, "n_words", below=True),
    Rule("long_words", "word_chars", 25, "n_words"),
    Rule("symbols", "n_symbols", 30, "n_words", scale=100),
    Rule("few_stop_words", "n_stop_words", 2, "n_words", scale=100, below=True, least=50),
    Rule("repeated_lines", "n_dup_lines", 50, "n_lines", scale=100, least=4),
)


def failed(rules: tuple[Rule, ...]) -> Column:
    return F.expr(reduce(lambda a, b: f"{a} OR {b}", (r.sql() for r in rules)))


def measure(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys plus the counts of each text.

    The intermediate arrays stand in projections of their own: each is used more than once, so the
    optimizer keeps them apart and nothing is evaluated anew inside a lambda.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(
        *keys,
        words(F.col(text)).alias("__w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("__lines"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    w, n = F.col("__w"), F.size("__w")
    second = first.select(
        *keys, "word_chars", "n_symbols",
        n.cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(n < WINDOW, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)])))
        .alias("__h"),
    )
    h = F.col("__h")
    counts = ["word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_stop_words"]
    third = second.select(
        *keys, *counts,
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("__s"),
    )
    s = F.col("__s")
    fourth = third.select(
        *keys, *counts,
        F.array_sort(F.filter(F.transform(s, lambda x, k: F.when(
            (F.when(k > 0, F.get(s, k - 1)["h"]) == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())).alias("__p"),
    )
    p = F.col("__p")
    step = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1), x + WINDOW) - x))
    repeated = F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0))
    return fourth.select(*keys, *counts, repeated.cast("long").alias("n_repeat_words"))


def judge(docs: DataFrame, keys: list[str], text: str = "text", table: tuple[Rule, ...] = TABLE) -> DataFrame:
    """measure() with base_failed and kept."""
    seen = measure(docs, keys, text)
    return seen.withColumn("base_failed", failed(BASE)).withColumn("kept", ~(F.col("base_failed") | failed(table)))


def keep(docs: DataFrame, text: str = "text", table: tuple[Rule, ...] = TABLE) -> DataFrame:
    """The rows of docs that pass, with their columns as they were; no join, no shuffle.

    A filter would be pushed through the projections and so repeat their expressions many times over;
    a generator keeps them below.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text).alias("__text"))
    judged = judge(whole, ["__row"], "__text", table)
    return judged.select(F.explode_outer(F.expr("if(kept, array(__row), array())")).alias("__row")).where("__row IS NOT NULL").select("__row.*")
