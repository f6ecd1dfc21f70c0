"""Columns of users may have any name that operators use inside."""

import threading
from datetime import timedelta

from pyspark.sql import functions as F

from tidewright.operators import gate, joins, keyed, publish
from tidewright.plans import catalogue
from tidewright.plans.compile import build
from tidewright.streaming import runner

INNER = ["_rank", "_event_time", "_salt", "_v", "_n", "_s", "_breaks", "_copies_k", "_bucket", "_k0", "_k_k", "_l", "_t", "_side", "_r", "_c", "_id", "_hash", "rank", "k0", "file", "row", "\x00rank", "\x00k0"]


def wide(df):
    """With a column of every inner name."""
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(INNER)])


def kept(df):
    assert [c for c in df.columns if c in INNER] == INNER, df.columns
    got = df.first()
    assert [got[n] for n in INNER] == list(range(len(INNER)))
    return df


def test_dedup_upsert_and_last_per_key(spark, tmp_path):
    df = wide(spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "k int, v int"))
    assert kept(build(df, [{"dedup": {"keys": ["k"], "order_by": ["v DESC"]}}])).count() == 2
    assert kept(keyed.last_per_key(df, ["k"], "v")).count() == 2
    assert kept(keyed.settled(df, ["k"])).count() == 2
    assert kept(keyed.upserted(df.filter("k = 2"), df.filter("k = 1"), ["k"], "v")).count() == 2
    visible = df.drop("\x00rank", "\x00k0")
    where = str(tmp_path / "t")
    for _ in range(2):
        publish.upsert_table(visible, where, ["k", "_rank"])
    assert publish.read(spark, where).columns == visible.columns and publish.read(spark, where).count() == 2


def test_gate(spark):
    df = wide(spark.createDataFrame([(1, 5), (1, -9), (2, 1), (None, 3)], "k int, v int"))
    rules = [gate.Rule("k", "unique"), gate.Rule("v", "min", 0), gate.Rule("_rank", "not_null")]
    good, bad = gate.split(df, rules)
    assert kept(good).count() == 2 and kept(bad).count() == 2
    assert gate.counts(df, rules).first().asDict() == {"unique:k": 1, "min:v": 1, "not_null:_rank": 0}


def test_joins(spark):
    left = wide(spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "k int, at int"))
    right = spark.createDataFrame([(1, 4, "a"), (1, 8, "b")], "k int, at int, value string")
    got = kept(joins.asof(left, right, ["k"], "at", ["value"])).select("k", "at", "value").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 5, "a"), (1, 9, "b"), (2, 1, None)]
    ranges = spark.createDataFrame([(0, 6, "low"), (-(10**15), 10**15, "all"), (7, 7, "none")], "a bigint, b bigint, name string")
    found = kept(joins.in_ranges(left, ranges, "at", "a", "b", 1)).select("at", "name").collect()
    assert sorted(map(tuple, found)) == [(1, "all"), (1, "low"), (5, "all"), (5, "low"), (9, "all")]


def test_ranges_of_any_width_take_few_cells(spark):
    points = spark.createDataFrame([(float(x),) for x in (-5e300, -1.0, 0.0, 0.25, 3.0, 1e12, 5e300)] + [(None,), (float("nan"),)], "x double")
    ranges = [(0.0, 1e12), (-1e308, 1e308), (0.25, 0.5), (float("-inf"), 0.0), (3.0, float("inf")), (2.0, 1.0), (None, 4.0)]
    r = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "g int, a double, b double")
    got = sorted((p.x, p.g) for p in joins.in_ranges(points, r, "x", "a", "b", 0.5).collect() if p.x == p.x)
    want = sorted((x, i) for (x,) in points.collect() if x is not None and x == x for i, (a, b) in enumerate(ranges) if a is not None and a <= x < b)
    assert got == want


def test_totals_in_ranges_are_those_of_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "SLICES", 5)
    inf, nan, big = float("inf"), float("nan"), 2**63 - 1
    xs = [-5e300, -1.0, 0.0, -0.0, 0.25, 0.25, 3.0, 1e12, inf, -inf, nan, None, *map(float, range(40))]
    points = spark.createDataFrame([(x, None if i % 7 == 4 else big - i) for i, x in enumerate(xs)], "at double, v long").repartition(3)
    ranges = [(0.0, 1e12), (-1e308, 1e308), (0.25, 0.5), (-inf, 0.0), (3.0, inf), (2.0, 1.0), (None, 4.0), (1.0, None), (5.0, nan), (0.0, 1e12), (41.0, 42.0), (7.5, 8.5)]
    r = spark.createDataFrame([(i % 10 if i != 3 else None, a, b) for i, (a, b) in enumerate(ranges)], "g int, a double, b double")
    pairs = points.crossJoin(r).filter("at >= a AND at < b").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("total"))
    # sums of all points may exceed what a long holds where those of a range do not
    fits = pairs.filter(f"total IS NULL OR total <= {big}").collect()
    of = r.join(F.broadcast(spark.createDataFrame([(x.g,) for x in fits], "h int")), F.col("g").eqNullSafe(F.col("h")))
    got = joins.totals_in_ranges(points, of, ["g"], "at", "a", "b", {"total": "v"}).collect()
    assert got and sorted(map(tuple, got)) == sorted((x.g, x.n, x.total) for x in fits)
    small = points.withColumn("v", F.col("v") - big)
    got = joins.totals_in_ranges(small, r, ["g"], "at", "a", "b", {"total": "v"}).collect()
    want = small.crossJoin(r).filter("at >= a AND at < b").groupBy("g").agg(F.count(F.lit(1)), F.sum("v"))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want.collect()), key=str) and {None, 8} <= {x.g for x in got}
    assert joins.totals_in_ranges(points.limit(0), r, ["g"], "at", "a", "b", {"total": "v"}).count() == 0
    assert joins.totals_in_ranges(points, r.limit(0), ["g"], "at", "a", "b", {"total": "v"}).count() == 0
    named = wide(points.filter("at < 100").selectExpr("1 AS k", "at")).withColumn("x", F.lit(2))
    ones = joins.totals_in_ranges(named, r.filter("g = 1"), ["g"], "at", "a", "b", {"total": "x"}).first()
    assert ones.total == 2 * ones.n


def test_wide_ranges_over_many_points_make_no_pairs(spark, tmp_path):
    """Over seven thousand million pairs: they would take many minutes."""
    spark.range(400_000).toDF("p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(40_000).toDF("s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    late = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = {r.s_suppkey: (r.n, r["keys"]) for r in catalogue.QUERIES["join_range_wide"](spark, str(tmp_path)).collect()}
    finally:
        late.cancel()
    sums = lambda a, b: (b - a, (a + b - 1) * (b - a) // 2)
    assert got == {s: sums(s, min(400_000, s + 10 ** (s % 13))) for s in range(40_000)}


def test_streams(spark, tmp_path):
    rows = wide(spark.createDataFrame([(1, "2024-01-01T10:00:00Z"), (2, "2024-01-01T09:00:00Z")], "k int, at string")).drop("\x00rank", "\x00k0")
    names = [n for n in INNER if "\x00" not in n]

    def poll(spark, position):
        return None if position else runner.Batch(rows, {"n": 1})

    stream = runner.Stream("s", poll, str(tmp_path / "out"), str(tmp_path / "state"), event_time="at", allowed_lateness=timedelta(0))
    assert runner.run(spark, stream)["rows"] == 2
    assert [c for c in spark.read.parquet(f"{tmp_path}/out/*").columns if c in names] == names
