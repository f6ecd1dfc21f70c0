import json

import pytest

from tidewright.errors import DataError, SpecError
from tidewright.functions.expressions import portability, to_spark
from tidewright.operators import publish, transform
from tidewright.operators.state import Store
from tidewright.plans.compile import build
from tidewright.plans.ir import canonical_hash, from_mapping, load, substituted
from tidewright.sources.union import read_parquet, union_by_name

#: Gauge readings: a missing station, one copied row, halves on both sides of zero, and levels that are exact decimals.
READINGS = """
SELECT * FROM VALUES
  ('north', 0.5D, CAST('0.5' AS decimal(6,2)), TIMESTAMP_NTZ '2021-07-01 06:00:00'),
  ('north', 1.5D, CAST('-0.5' AS decimal(6,2)), TIMESTAMP_NTZ '2021-07-01 18:30:00'),
  (NULL, -1.5D, CAST('1.25' AS decimal(6,2)), NULL),
  ('weir', -0.5D, NULL, TIMESTAMP_NTZ '2022-12-31 23:59:59'),
  ('weir', -0.5D, NULL, TIMESTAMP_NTZ '2022-12-31 23:59:59'),
  ('lock 9', 40.0D, CAST('99.99' AS decimal(6,2)), TIMESTAMP_NTZ '2022-01-15 00:00:00'),
  ('', NULL, CAST('0.00' AS decimal(6,2)), TIMESTAMP_NTZ '2021-02-28 12:00:00')
AS t(station, depth, level, taken)
"""


@pytest.fixture
def df(spark):
    return spark.sql(READINGS)


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def column(df, name):
    return sorted((r[name] for r in df.collect()), key=str)


def test_filter_keeps_copies_and_drops_unknowns(df):
    # a condition that is null keeps no row, and a copied row stays twice
    assert build(df, [{"filter": "depth < 0"}]).count() == 3
    assert build(df, [{"filter": "level >= 0 OR station = 'weir'"}]).count() == 6
    assert build(df, [{"filter": "NOT (level > 0)"}]).count() == 2


def test_map_gives_its_columns_alone_and_in_order(df):
    out = build(df, [{"map": {"z": "depth * 10", "a": "station"}}])
    assert out.dtypes == [("z", "double"), ("a", "string")]


def test_rename_puts_columns_last_and_makes_room(df):
    assert build(df, [{"rename": {"level": "height", "station": "gauge"}}]).columns == ["depth", "taken", "height", "gauge"]
    assert build(df, [{"rename": {"taken": "depth"}}]).columns == ["station", "depth", "level", "depth_1"]


def test_casts_to_whole_numbers(df, spark):
    whole = build(df, [{"cast": {"depth": "integer", "level": "bigint"}}])
    # doubles go to the even neighbour, decimals away from zero
    assert [(r.depth, r.level) for r in whole.collect()] == [(0, 1), (2, -1), (-2, 1), (0, None), (0, None), (40, 100), (None, 0)]
    texts = spark.sql("SELECT * FROM VALUES ('12.5'), ('-7.49'), (NULL) AS t(x)")
    assert column(build(texts, [{"cast": {"x": "integer"}}]), "x") == [-7, 13, None]


def test_casts_to_decimals_and_text(df, spark):
    assert build(df, [{"cast": {"depth": "decimal"}}]).schema["depth"].dataType.simpleString() == "decimal(38,9)"
    numbers = spark.sql("SELECT * FROM VALUES (250000000.0D), (0.375D), (-3.0D) AS t(x)")
    assert column(build(numbers, [{"cast": {"x": "varchar"}}]), "x") == ["-3.0", "0.375", "250000000.0"]


def test_derive_sees_earlier_columns_and_keeps_those_there(df):
    out = build(df, [{"derive": {"metres": "depth / 100", "flooded": "metres > 0.1"}}])
    assert out.columns[-2:] == ["metres", "flooded"] and column(out, "flooded").count(True) == 1
    clash = build(df, [{"derive": {"station": "upper(station)"}}])
    assert clash.columns == ["station", "depth", "level", "taken", "station_1"] and clash.filter("station = 'weir' AND station_1 = 'WEIR'").count() == 2


def test_expressions_of_the_other_dialect(df):
    body = {"year": "extract(year FROM taken)", "label": "coalesce(station, '?') || '/' || CAST(level AS VARCHAR)", "kind": "CASE WHEN depth >= 1 THEN 'deep' WHEN depth IS NULL THEN 'none' ELSE 'shallow' END"}
    got = values(build(df, [{"map": body}, {"filter": "year = 2021 OR year IS NULL"}]))
    assert got == sorted([(2021, "north/0.50", "shallow"), (2021, "north/-0.50", "deep"), (None, "?/1.25", "shallow"), (2021, "/0.00", "none")], key=str)


def test_dedup_takes_copies_or_the_first_in_order(df):
    assert build(df, [{"dedup": ["station", "depth"]}]).count() == 6
    latest = build(df, [{"dedup": {"keys": ["station"], "order_by": ["taken DESC", "depth"]}}])
    assert {r.station: r.depth for r in latest.collect()} == {"north": 1.5, None: -1.5, "weir": -0.5, "lock 9": 40.0, "": None}


def test_sql_and_python_steps(df):
    per = build(df, [{"sql": "SELECT station, count(*) AS n FROM {input} GROUP BY station HAVING count(*) > 1"}])
    assert values(per) == [("north", 2), ("weir", 2)]
    out = build(df, [{"python": {"python": "tidewright.functions.samples:initials", "args": ["station"], "output": "short"}}])
    assert {(r.station, r.short) for r in out.collect()} >= {("north", "NO"), (None, None)}


@pytest.mark.parametrize("bad", [{"filter": "a; b"}, {"sql": "SELECT 1"}, {"sql": "SELECT * FROM {input}; DROP TABLE x"}, {"cast": {"a": "blob"}}, {"rename": {"a": "x", "b": "x"}}, {"select": []}, {"python": {"python": "no", "output": "x"}}, {"join": "x"}])
def test_bad_steps(bad):
    with pytest.raises(SpecError):
        from_mapping({"name": "n", "input": "i", "output": "o", "steps": [bad]})


def test_unknown_columns_fail_before_output(df):
    for step in ({"select": ["nope"]}, {"rename": {"nope": "x"}}, {"cast": {"nope": "bigint"}}, {"dedup": ["nope"]}):
        with pytest.raises(SpecError):
            build(df, [step])
    # a semicolon in a text ends no statement
    assert build(df, [{"derive": {"mark": "concat('a;', station)"}}]).columns == [*df.columns, "mark"]


def test_expression_layer():
    assert to_spark("CAST(x AS VARCHAR) || 'VARCHAR //'") == "CAST(x AS STRING) || 'VARCHAR //'"
    assert to_spark("a // b") == "a  div  b"
    assert to_spark("strftime(d, '%Y-%m-%d')") == "date_format(d, 'yyyy-MM-dd')"
    assert portability("upper(a) IN ('x') AND (b > 1)") == []
    assert portability("list_contains(a, 1)") == ["function list_contains"]
    assert portability("a::int") == ["operator ::"]


def test_plan_round_trip_hash_and_environment(tmp_path):
    spec = {"name": "n", "input": "${IN}", "output": "o", "steps": [{"filter": "a > 1"}]}
    (tmp_path / "p.json").write_text(json.dumps(spec))
    plan = load(str(tmp_path / "p.json"), {"IN": "data"})
    assert plan.input == "data" and from_mapping(plan.to_mapping()).hash == plan.hash
    with pytest.raises(SpecError):
        substituted("${NOPE}", {})
    with pytest.raises(SpecError):
        canonical_hash(float("nan"))
    assert plan.placement() == ("neutral", [])
    assert "filter" in plan.explain()


def test_union_widens(spark):
    a = spark.sql("SELECT 1 AS id, 1 AS v, DATE '2024-01-01' AS d")
    b = spark.sql("SELECT CAST(2 AS bigint) AS ID, 2.5D AS v, TIMESTAMP_NTZ '2024-01-02 03:00:00' AS d, 'x' AS more")
    out = union_by_name([a, b])
    assert out.dtypes == [("id", "bigint"), ("v", "double"), ("d", "timestamp_ntz"), ("more", "string")] and out.count() == 2
    with pytest.raises(DataError):
        union_by_name([a, spark.sql("SELECT array(1) AS v")])


def test_refresh_modes(spark, tmp_path):
    src = tmp_path / "in"
    write = lambda n, rows: spark.createDataFrame(rows, "id bigint, value string").coalesce(1).write.parquet(str(src / n))
    write("a", [(1, "a"), (2, "a")])
    store = Store(str(tmp_path / "s.db"))
    spec = lambda **k: from_mapping({"name": k.pop("name", "p"), "input": str(src), "output": str(tmp_path / "out"), "steps": [{"filter": "id > 0"}], **k})
    full = spec()
    transform.run(spark, full)
    assert transform.output(spark, full).count() == 2
    bad = from_mapping({"name": "p", "input": str(src), "output": str(tmp_path / "out"), "steps": [{"filter": "nope > 0"}]})
    with pytest.raises(Exception):
        transform.run(spark, bad)
    assert transform.output(spark, full).count() == 2  # the old output stays

    keyed = from_mapping({"name": "k", "input": str(src), "output": str(tmp_path / "k"), "incremental": {"mode": "by_key", "key": "id"}})
    unit = from_mapping({"name": "u", "input": str(src), "output": str(tmp_path / "u"), "incremental": {"mode": "by_unit"}})
    for p in (keyed, unit):
        assert transform.run(spark, p, store)["files"] == 1
        assert transform.run(spark, p, store)["files"] == 0
    write("b", [(2, "b"), (3, "b")])
    for p in (keyed, unit):
        assert transform.run(spark, p, store) == {"mode": p.incremental[0], "reset": False, "files": 1}
    assert values(transform.output(spark, keyed)) == [(1, "a"), (2, "b"), (3, "b")]
    assert transform.output(spark, unit).count() == 4
    import shutil

    shutil.rmtree(src / "a")
    assert transform.run(spark, keyed, store)["reset"]
    assert values(transform.output(spark, keyed)) == [(2, "b"), (3, "b")]


def test_publish_swaps(spark, tmp_path):
    where = str(tmp_path / "t")
    publish.publish(spark.range(3).toDF("id"), where)
    old = publish.read(spark, where)
    publish.publish(spark.range(5).toDF("id"), where)
    assert old.count() == 3 and publish.read(spark, where).count() == 5
    assert read_parquet(spark, publish.current(where)).count() == 5


def test_asof_slices_give_the_same(spark):
    from tidewright.operators.joins import asof, in_ranges

    left = spark.sql("SELECT id, id % 3 AS k, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id * 7) AS t FROM range(60)")
    right = spark.sql("SELECT id AS r, id % 2 AS k, TIMESTAMP_NTZ '2024-01-01 12:00:00' + make_interval(0, 0, 0, 0, id * 31) AS t FROM range(12)")
    plain = {tuple(r) for r in asof(left, right, ["k"], "t", ["r"]).collect()}
    assert plain == {tuple(r) for r in asof(left, right, ["k"], "t", ["r"], slices="day").collect()}
    rows, want = right.collect(), {}
    for x in left.collect():
        have = [y for y in rows if y.k == x.k and y.t <= x.t]
        want[x.id] = max(have, key=lambda y: y.t).r if have else None
    assert {r[0]: r[-1] for r in plain} == want
    p, q = spark.range(100).toDF("x"), spark.sql("SELECT id AS g, id * 9 AS lo, id * 9 + 20 AS hi FROM range(8)")
    got = sorted((r.x, r.g) for r in in_ranges(p, q, "x", "lo", "hi", 16).collect())
    assert got == sorted((x, g) for x in range(100) for g in range(8) if g * 9 <= x < g * 9 + 20)
