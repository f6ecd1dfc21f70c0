"""Joins Spark SQL has no syntax for."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slices of values whose totals are carried on, at most.
SLICES = 500


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], prefix: str = "", slices: str | None = None) -> DataFrame:
    """Each left row with ``values`` of the latest right row of the same key at or before it: one shuffle and a running
    last value, no matter how many right rows a key has. Right rows without a time match nothing, and left rows without one get
    nulls.

    A key with very many rows is dealt by time as well if ``slices`` names a unit (day, month, ...): each slice runs for
    itself and starts from the last value of the slices before, of which there are few."""
    kind = right.select(F.struct(*values)).schema[0].dataType
    a = left.select(F.struct(*left.columns).alias("\x00l"), *by, F.col(on).alias("\x00t"), F.lit(1).alias("\x00side"), F.lit(None).cast(kind).alias("\x00r"))
    # a row without a time is before nothing
    right = right.filter(F.col(on).isNotNull())
    b = right.select(F.lit(None).cast(a.schema["\x00l"].dataType).alias("\x00l"), *by, F.col(on).alias("\x00t"), F.lit(0).alias("\x00side"), F.struct(*values).alias("\x00r"))
    both = a.unionByName(b)
    keys = list(by)
    if slices:
        both, keys = both.withColumn("\x00s", F.date_trunc(slices, "\x00t")), [*by, "\x00s"]
    w = Window.partitionBy(*keys).orderBy("\x00t", "\x00side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("\x00r", F.last("\x00r", ignorenulls=True).over(w)).filter(F.col("`\x00side`") == 1)
    if slices:
        per = both.groupBy(*keys).agg(F.max_by(F.when(F.col("\x00side") == 0, F.col("\x00r")), F.when(F.col("\x00side") == 0, F.col("\x00t"))).alias("\x00c"))
        run = Window.partitionBy(*by).orderBy("\x00s").rowsBetween(Window.unboundedPreceding, -1)
        carried = per.select(*[F.col(k).alias(f"\x00k{i}") for i, k in enumerate(keys)], F.last("\x00c", ignorenulls=True).over(run).alias("\x00c"))
        on_keys = F.lit(True)
        for i, k in enumerate(keys):
            on_keys = on_keys & F.col(k).eqNullSafe(F.col(f"\x00k{i}"))
        out = out.join(carried, on_keys, "left").withColumn("\x00r", F.coalesce("\x00r", "\x00c"))
    return out.select("`\x00l`.*", *[F.col(f"`\x00r`.`{v}`").alias(f"{prefix}{v}") for v in values])


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the half-open ranges they lie in, joined on cells instead of by a nested loop. A range goes to the level whose
    cells, ``width`` doubled as often as needed, are as wide as itself, and so to three cells at most, however long it is; a point
    looks into one cell of each level that is in use. Empty ranges and nulls match nothing; numbers may be fractional."""
    level_, cell_ = "\x00level", "\x00cell"
    bound = lambda c: F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), F.col(f"`{c}`").cast("double")))
    size = lambda level: F.lit(float(width)) * F.pow(F.lit(2.0), level)
    cell = lambda c, level: F.floor(F.greatest(F.lit(-4e18), F.least(F.lit(4e18), bound(c) / size(level)))).cast("bigint")
    # the widest level has cells for all numbers; what is wider than a number can say goes there, too
    long = F.col(f"`{high}`").cast("double") - F.col(f"`{low}`").cast("double")
    doublings = F.ceil(F.log2(F.greatest(long / F.lit(float(width)), F.lit(1e-300)))).cast("double")
    top = 1022 - max(0, math.ceil(math.log2(width)))
    own = F.when(long == float("inf"), F.lit(top)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(top)), doublings)).cast("int"))
    r = ranges.filter(F.col(f"`{low}`") < F.col(f"`{high}`")).withColumn(level_, own)
    used = [x[0] for x in r.select(level_).distinct().collect()]  # 1,001 at most
    r = r.withColumn(cell_, F.explode(F.sequence(cell(low, F.col(level_)), cell(high, F.col(level_)))))
    p = points.withColumn(level_, F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumn(cell_, cell(at, F.col(level_)))
    return p.join(r, [level_, cell_]).filter((F.col(f"`{at}`") >= F.col(f"`{low}`")) & (F.col(f"`{at}`") < F.col(f"`{high}`"))).drop(level_, cell_)


def totals_in_ranges(points: DataFrame, ranges: DataFrame, by: list[str], at: str, low: str, high: str, sums: dict[str, str]) -> DataFrame:
    """For each ``by`` of the ranges, over all pairs ``in_ranges`` would give: their number ``n``, and sums of the points' columns
    of whole numbers, by new name; groups without a pair are left out. No pair is made, so wide ranges over many points cost
    no more than narrow ones: totals below ``high`` less those below ``low`` are those between. Totals run along the distinct
    values of points and bounds in slices, each from the totals of the slices before, of which there are ``SLICES`` at most."""
    from pyspark.ml.feature import Bucketizer

    value, cut, cell, sign, count, names = "\x00v", "\x00d", "\x00c", "\x00sign", "\x00n", [f"\x00s{i}" for i in range(len(sums))]
    some = [f"\x00some{i}" for i in range(len(sums))]
    # totals of all points may be longer than those of a range
    p = points.filter(F.col(f"`{at}`").isNotNull()).select(F.col(f"`{at}`").alias(value), F.lit(1).alias(count), *[F.col(f"`{c}`").cast("decimal(38,0)").alias(s) for s, c in zip(names, sums.values(), strict=True)])
    r = ranges.filter(F.col(f"`{low}`") < F.col(f"`{high}`"))
    end = lambda c, side: r.select(*[F.col(f"`{k}`").alias(f"\x00k{i}") for i, k in enumerate(by)], F.col(f"`{c}`").alias(value), F.lit(side).alias(sign))
    bounds = end(low, -1).unionByName(end(high, 1))
    totals = [F.sum(count).alias(count), *[F.sum(F.coalesce(s, F.lit(0).cast("decimal(38,0)"))).alias(s) for s in names]]
    each = p.select("*", *[F.col(s).isNotNull().cast("int").alias(m) for s, m in zip(names, some, strict=True)]).unionByName(bounds.select(value).distinct().withColumn(count, F.lit(0)), allowMissingColumns=True)
    each = each.groupBy(value).agg(*totals, *[F.sum(F.coalesce(m, F.lit(0))).alias(m) for m in some]).withColumn(cut, F.col(value).cast("double"))
    cuts = sorted({x for x in each.approxQuantile(cut, [i / SLICES for i in range(1, SLICES)], 0.1 / SLICES) if math.isfinite(x)})
    each = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=cut, outputCol=cell, handleInvalid="keep").transform(each)
    added = [count, *names, *some]
    before = lambda w: [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in added]
    inner = Window.partitionBy(cell).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    run = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    carried = each.groupBy(cell).agg(*[F.sum(c).alias(c) for c in added]).select(F.col(cell).alias("\x00c2"), *[x.alias(f"{c}+") for x, c in zip(before(run), added, strict=True)])
    below = each.select(value, cell, *before(inner)).join(F.broadcast(carried), F.col(cell) == F.col("\x00c2")).select(F.col(value).alias("\x00v2"), *[(F.col(c) + F.col(f"{c}+")).alias(c) for c in added])
    out = bounds.join(below, F.col(value) == F.col("\x00v2")).groupBy(*[f"\x00k{i}" for i in range(len(by))]).agg(*[F.sum(F.col(sign) * F.col(c)).alias(c) for c in added])
    return out.filter(F.col(count) > 0).select(*[F.col(f"\x00k{i}").alias(k) for i, k in enumerate(by)], F.col(count).alias("n"), *[F.when(F.col(m) > 0, F.col(s)).cast("bigint").alias(name) for m, s, name in zip(some, names, sums, strict=True)])
