"""What holds from one step to another, counted at every step.

Clusterings that follow one another, cuts of a tree or growing eps, change little from step to step: a row keeps its cluster, and what the
cluster is like, for a span of steps.  So a table of spans stands for a label of each row at each step, and is far smaller.  Steps are
dealt out by chunks; in a chunk, spans are cut into aligned pieces of 1, 2, 4 ... steps, a few for each span, and a step looks into one
sorted list of pieces for each of these lengths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outrate.operators.state import importable, kept

#: Steps of a chunk, and spans that a task holds at once: more of a chunk's are dealt out to parts.
BITS, AT_ONCE = 12, 1 << 17


def _pieces(lo: np.ndarray, hi: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(which spans, blocks of 2 ** level steps) of the pieces of that length that spans lo <= step < hi are cut into."""
    left, right = (lo + (1 << level) - 1) >> level, hi >> level
    a, b = (np.flatnonzero((left < right) & (end & 1 == 1)) for end in (left, right))
    return np.concatenate([a, b]), np.concatenate([left[a], right[b] - 1])


def _counts(lo: np.ndarray, hi: np.ndarray, v: np.ndarray, name: np.ndarray, weights: list[np.ndarray], at: np.ndarray, of: np.ndarray, limits: np.ndarray) -> list[np.ndarray]:
    """For each step of ``at`` and each of its limits (rows of ``limits``): sums of weights of the spans of its name (``of``) that hold it and have
    v >= limit."""
    names, of = np.unique(of, return_inverse=True)
    code = np.searchsorted(names, name)
    order = np.argsort(v, kind="stable")
    order = order[names[np.minimum(code, len(names) - 1)][order] == name[order]]
    lo, hi, v, code, weights = lo[order], hi[order], v[order], code[order], [w[order] for w in weights]
    m, first = len(v) + 1, np.searchsorted(v, limits)
    out = [np.zeros(limits.shape, np.int64) for _ in weights]
    for level in range(BITS + 1):
        which, block = _pieces(lo, hi, level)
        if not len(which):
            continue
        key = (block * len(names) + code[which]) * m + which  # spans stand in the order of v
        order = np.argsort(key)
        key, which = key[order], which[order]
        own = ((at >> level) * len(names) + of)[:, None]
        begin, end = np.searchsorted(key, own * m + first), np.searchsorted(key, (own + 1) * m)
        for o, w in zip(out, weights):
            to = np.concatenate([[0], np.cumsum(w[which])])
            o += to[end] - to[begin]
    return out


def counted(spans: DataFrame, steps: DataFrame, ks: list[float] | None = None) -> DataFrame:
    """spans (lo, hi, v, p, tp), steps (step, base) -> (step, k, p, tp): sums of p and tp over the spans with lo <= step < hi and v >= base / ks[k]
    (no ks: v >= base, and k is 0).  Steps whose base is null have nothing above it and are left out.  Where both have a name (long), a step
    may have a row for each of several names, and looks at the spans of each name by itself.  spans should be a written table."""
    if "name" not in spans.columns:
        spans, steps = (df.withColumn("name", F.lit(0).cast("long")) for df in (spans, steps))
    importable(spans.sparkSession)
    ks = np.array(ks or [1.0])
    inside = spans.where("lo < hi").withColumn("chunk", F.explode(F.sequence(F.shiftright("lo", BITS), F.shiftright(F.col("hi") - 1, BITS))))
    # Spans that are the same within a chunk are one.
    start = F.shiftleft("chunk", BITS)
    inside = inside.groupBy("chunk", F.greatest("lo", start).alias("lo"), F.least("hi", start + (1 << BITS)).alias("hi"), "v", "name").agg(F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    inside = kept(inside)
    parts = inside.groupBy("chunk").agg(F.ceil(F.count("*") / AT_ONCE).cast("int").alias("parts"))
    inside = inside.join(F.broadcast(parts), "chunk").withColumn("part", F.pmod(F.xxhash64("lo", "hi", "v", "name"), "parts").cast("int")).drop("parts")  # a row for each chunk
    asked = steps.where("base IS NOT NULL").withColumn("chunk", F.shiftright("step", BITS)).join(F.broadcast(parts), "chunk")
    asked = asked.select("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "step", "name", "base")

    def run(s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if s.empty or t.empty:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("step", "k", "p", "tp")})
        at = t["step"].to_numpy()
        start = at[0] >> BITS << BITS
        p, tp = _counts(s["lo"].to_numpy() - start, s["hi"].to_numpy() - start, s["v"].to_numpy(), s["name"].to_numpy(), [s["p"].to_numpy(), s["tp"].to_numpy()], at - start, t["name"].to_numpy(), t["base"].to_numpy()[:, None] / ks)
        return pd.DataFrame({"step": np.repeat(at, len(ks)), "k": np.tile(np.arange(len(ks)), len(at)), "p": p.ravel(), "tp": tp.ravel()})

    found = inside.groupBy("chunk", "part").cogroup(asked.groupBy("chunk", "part")).applyInPandas(run, "step long, k long, p long, tp long")
    return found.groupBy("step", "k").agg(F.sum("p").alias("p"), F.sum("tp").alias("tp"))


def foremost(spans: DataFrame, steps: DataFrame, key: Column, what: Column, bits: int, *of: str) -> DataFrame:
    """(step, m): of the spans (lo, hi, ...) that hold a step, ``what`` of the one with the least key; steps are below 2 ** bits.  of: columns
    that a span and a step must have the same of."""
    ends = []
    for level in range(bits + 1):
        left, right = F.shiftright(F.col("lo") + (1 << level) - 1, level), F.shiftright("hi", level)
        ends += [F.when((left < right) & (left % 2 == 1), F.struct(F.lit(level).alias("level"), left.alias("block"))), F.when((left < right) & (right % 2 == 1), F.struct(F.lit(level).alias("level"), (right - 1).alias("block")))]
    pieces = spans.select(*of, F.struct(key.alias("key"), what.alias("what")).alias("m"), F.explode(F.filter(F.array(*ends), lambda e: e.isNotNull())).alias("e"))
    best = pieces.groupBy(*of, "e.level", "e.block").agg(F.min_by("m", "m.key").alias("m"))
    up = steps.select("step", *of, F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("step", k).alias("block")) for k in range(bits + 1)])).alias("e"))
    return up.select("step", *of, "e.*").join(best, [*of, "level", "block"]).groupBy("step").agg(F.min_by("m.what", "m.key").alias("m"))


def parted(spans: DataFrame, *of: str) -> DataFrame:
    """(of, start, stop) without overlap: where a span of the same ``of`` begins or ends, one of these ends and the next begins."""
    ends = spans.select(*of, F.explode(F.array("lo", "hi")).alias("start")).distinct()
    stop = F.lead("start").over(Window.partitionBy(*of).orderBy("start"))
    return ends.withColumn("stop", stop).where("stop IS NOT NULL")
