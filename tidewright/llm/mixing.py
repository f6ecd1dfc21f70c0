"""Mixing sources to target weights: cube-method balanced sampling.

Each source's target words follow from the weights by water filling (closed form over the sources sorted by
capacity for weight). Every document is taken ``floor(target / size)`` times, and once more with the fractional
inclusion probability, decided by the cube method: in groups of bounded size the probabilities move through the null
space of two constraints (the document total and the word total), three units at a time, each step making one unit
whole while both totals stand still. The two units that stay fractional in a group go on to the next round, where the
groups of a source merge; the last few of a source are landed on the subset whose words are nearest to their
expectation. A unit that outweighs its source's others can be left to the landing, which then misses the target by a part of
it; so, at last, a source exchanges some of its taken units for untaken ones of as many rows, which brings its words nearer and
leaves the documents as they are. Chance comes from hashes, so reruns agree.

A unit is all rows with equal id, source and text (one document, if ids are unique); they are taken alike.
Defined cases: a null or empty text has size 0 and adds no words; a null source is a source of its own, last in order;
a source without words has target 0; null ids are units of their own by text; an empty table gives no rows; extra columns
pass through ``mix`` untouched.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import table, written

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST = 2.0
#: Units that one group holds at about most.
GROUP_UNITS = 20_000
BLANKS = " \t\n\x0b\x0c\r"


def n_words(text):
    t = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of ``budget`` by weight, none above ``most`` times the size.

    Sources sorted by capacity for weight: the first whose share of what the ones before leave fits is where capping ends.
    Only the table of sources meets in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("rate", (budget * F.sum("source_size").over(Window.partitionBy()) - F.col("before")) / F.col("open"))
    s = s.withColumn("rate", F.min(F.when(F.col("rate") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("rate"))))
                     .over(Window.partitionBy())["rate"])
    return s.select("source", "source_size", F.when(F.col("rate").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("rate") * F.col("w"))).cast("double").alias("target"))


def flight(p: np.ndarray, docs: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves the probabilities ``p`` until at most two are fractional, with sum(p*docs) and sum(p*words) unchanged."""
    p, docs, words = p.tolist(), docs.tolist(), words.tolist()
    chance = iter(rng.random(len(p) + 4).tolist())
    eps = 1e-9
    open_: list[int] = []
    for k in range(len(p)):
        if p[k] <= eps or p[k] >= 1 - eps:
            p[k] = float(round(p[k]))
            continue
        open_.append(k)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (docs[b] * words[c] - docs[c] * words[b], docs[c] * words[a] - docs[a] * words[c], docs[a] * words[b] - docs[b] * words[a])
        if not any(u):  # the three are alike in both totals: trade two of them
            u = (1.0 / docs[a], -1.0 / docs[b], 0.0)
        up = down = math.inf
        for i, v in zip(open_, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, p[i] / -v), min(down, (1 - p[i]) / -v)
        step = up if next(chance) * (up + down) < down else -down
        for i, v in zip(open_, u, strict=True):
            p[i] += step * v
        whole = [i for i in open_ if p[i] <= eps or p[i] >= 1 - eps]
        if not whole:  # rounding left it a hair away
            whole = [min(open_, key=lambda i: min(p[i], 1 - p[i]))]
        for i in whole:
            p[i] = float(round(p[i]))
            open_.remove(i)
    return np.array(p)


def landing(p: np.ndarray, docs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The subset of the few fractional units whose words, and then documents, are nearest to their expectation."""
    at = np.flatnonzero((p > 0) & (p < 1))
    want_w, want_d = float(p[at] @ words[at]), float(p[at] @ docs[at])
    best = min(range(1 << len(at)), key=lambda m: (abs(sum(float(words[i]) for k, i in enumerate(at) if m >> k & 1) - want_w), abs(sum(float(docs[i]) for k, i in enumerate(at) if m >> k & 1) - want_d), m))
    out = p.copy()
    for k, i in enumerate(at):
        out[i] = best >> k & 1
    return out


def _round(seed: int):
    def run(units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["h", "doc_id", "size", "m"], kind="stable").reset_index(drop=True)
        first = units.iloc[0]
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{first['source']}|{first['g']}".encode()))
        p = flight(units["p"].to_numpy(float), units["m"].to_numpy(float), (units["m"] * units["size"]).to_numpy(float), rng)
        if first["parts"] == 1:
            p = landing(p, units["m"].to_numpy(float), (units["m"] * units["size"]).to_numpy(float))
        units["p"] = p
        return units[["doc_id", "source", "h", "size", "m", "p"]]

    return run


def exchanged(p: np.ndarray, docs: np.ndarray, words: np.ndarray, lack: float) -> np.ndarray:
    """Exchanges taken units (p = 1) for untaken ones of as many documents, the best exchange first, while that brings what
    words ``lack`` nearer to zero."""
    p = p.copy()
    while abs(lack) >= 0.5:
        best = (abs(lack), -1, -1)
        for d in np.unique(docs):
            out, into = (np.flatnonzero((docs == d) & (p == x)) for x in (1, 0))
            if not len(out) or not len(into):
                continue
            into = into[np.argsort(words[into], kind="stable")]
            want = words[out] + lack
            at = np.searchsorted(words[into], want)
            for near in (np.minimum(at, len(into) - 1), np.maximum(at - 1, 0)):
                miss = np.abs(want - words[into[near]])
                i = int(miss.argmin())
                best = min(best, (float(miss[i]), int(out[i]), int(into[near[i]])), key=lambda x: x[0])
        if best[1] < 0:
            break
        lack -= words[best[2]] - words[best[1]]
        p[best[1]], p[best[2]] = 0, 1
    return p


def _exchange(units: pd.DataFrame) -> pd.DataFrame:
    units = units.sort_values(["h", "doc_id", "size", "m"], kind="stable").reset_index(drop=True)
    p = exchanged(units["p"].to_numpy(float), units["m"].to_numpy(float), (units["m"] * units["size"]).to_numpy(float), float(units["lack"].iloc[0]))
    changed = units[p != units["p"]].copy()
    changed["q"] = 1 - changed["p"]
    return changed[["doc_id", "h", "q"]]


def repaired(before: DataFrame, after: DataFrame, seed: int = 0) -> DataFrame:
    """``after`` (units with p made 0 or 1) with exchanges within one group of each source, of bounded size, that bring its words
    near to those of ``before``."""
    want = before.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("m") * F.col("size") * F.col("p")).alias("want"))
    got = after.groupBy(F.col("source").alias("s2")).agg(F.sum(F.col("m") * F.col("size") * F.col("p")).alias("got"), F.ceil(F.count(F.lit(1)) / GROUP_UNITS).alias("parts"))
    off = want.join(got, F.col("s").eqNullSafe(F.col("s2"))).select("s", (F.col("want") - F.col("got")).alias("lack"), "parts").filter("abs(lack) >= 0.5")
    pool = after.join(off, F.col("source").eqNullSafe(F.col("s"))).filter(F.pmod(F.xxhash64("h", F.lit(seed + 991)), F.col("parts")) == 0)
    changed = written(pool.select("doc_id", "source", "h", "size", "m", "p", "lack").groupBy("source").applyInPandas(_exchange, "doc_id long, h long, q double"), "exchanged")
    changed = changed.select(F.col("doc_id").alias("d"), F.col("h").alias("hh"), "q")
    return after.join(changed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")), "left").select("doc_id", "source", "h", "size", "m", F.coalesce("q", "p").alias("p"))


_UNIT = "doc_id long, source string, h long, size long, m long, p double"


def balanced(units: DataFrame, seed: int = 0) -> DataFrame:
    """Units (doc_id, source, h, size, m, p) with every p made 0 or 1 by the cube method within each source."""
    done, k = [], 0
    while True:
        counts = units.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("s"), F.ceil(F.col("n") / GROUP_UNITS).alias("parts"))
        dealt = units.join(counts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        dealt = dealt.withColumn("g", F.pmod(F.xxhash64("h", F.lit(seed + k)), F.col("parts")))
        step = written(dealt.groupBy("source", "g").applyInPandas(_round(seed + k), _UNIT), "flight")
        done.append(step.filter("p = 0 or p = 1"))
        units = step.filter("p > 0 and p < 1")
        if units.isEmpty():
            break
        k += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def shares(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = 0) -> DataFrame:
    """One row per unit: doc_id, source, h (hash of the text), m (rows), size, source_size, target, copies (of each row)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(key, source, text).alias("h"), n_words(text).alias("size"))
    units = written(rows.groupBy("doc_id", "source", "h").agg(F.count(F.lit(1)).alias("m"), F.max("size").alias("size")), "units")
    sources = units.groupBy("source").agg(F.sum(F.col("m") * F.col("size")).alias("source_size"))
    aims = written(targets(sources, weights, budget, most), "targets").withColumnRenamed("source", "s")
    units = units.join(aims, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size"))
    units = units.withColumn("base", F.floor(rate + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), rate - F.col("base")))
    open_ = units.filter("p > 0").select("doc_id", "source", "h", "size", "m", "p")
    more = repaired(open_, written(balanced(open_, seed), "balanced"), seed)
    more = more.filter("p = 1").select(F.col("doc_id").alias("d"), F.col("h").alias("hh"), F.lit(1).alias("one"))
    units = units.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")), "left")
    return units.select("doc_id", "source", "h", "m", "size", "source_size", "target", (F.col("base") + F.coalesce("one", F.lit(0))).cast("long").alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mixture: each row of ``docs`` as many times as it is taken, all columns kept."""
    taken = shares(docs, key, source, text, **how).filter("copies > 0").select(F.col("doc_id").alias("id"), "h", "copies")
    # the row goes as one value, so that its columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("row_id"), F.xxhash64(f"`{key}`", f"`{source}`", f"`{text}`").alias("row_h"))
    found = rows.join(taken, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_h") == F.col("h")))
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("k")).select("row.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = shares(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = units.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
