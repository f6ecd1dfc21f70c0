"""Versions, upserts by several writers, and units."""

import os
import threading

import pytest

from tidewright.errors import ConflictError, DataError
from tidewright.operators import keyed_table, publish, transform
from tidewright.operators.state import Store, unit_id
from tidewright.plans.ir import from_mapping
from tidewright.sources.fs import Files


def rows(spark, where):
    return sorted((tuple(r) for r in publish.read(spark, where).collect()), key=str)


def test_four_writers_lose_nothing(spark, tmp_path):
    where, errors = str(tmp_path / "t"), []
    keyed_table.create(spark.range(100).selectExpr("id", "'old' AS v"), where, ["id"], file_rows=20)
    start = threading.Barrier(4)

    def write(k):
        try:
            start.wait()
            for j in range(2):
                new = spark.createDataFrame([(10 * k + j, f"w{k}{j}"), (1000 + 10 * k + j, f"w{k}{j}")], "id bigint, v string")
                keyed_table.upsert(new, where, ["id"], attempts=30)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not errors
    want = {i: "old" for i in range(100)} | {b + 10 * k + j: f"w{k}{j}" for k in range(4) for j in range(2) for b in (0, 1000)}
    assert rows(spark, where) == sorted(want.items(), key=str)
    assert publish.last_entry(where, spark).number == 9
    # what lost a race is gone, and so are versions that nobody needs
    kept = {d for d in os.listdir(where) if d.startswith("m-")}
    assert len(kept) == 3


def test_a_stale_writer_is_told(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "t")
    store = Store(str(tmp_path / "s.db"), clock=lambda: now[0])
    now = [0.0]
    old = store.acquire("t", "a", 10)
    publish.upsert_table(spark.createDataFrame([(1, "a")], "id int, v string"), where, ["id"], fence=old)
    now[0] = 20.0
    new = store.acquire("t", "b", 10)
    publish.upsert_table(spark.createDataFrame([(1, "b")], "id int, v string"), where, ["id"], fence=new)
    with pytest.raises(ConflictError):
        publish.upsert_table(spark.createDataFrame([(1, "late")], "id int, v string"), where, ["id"], fence=old)
    assert rows(spark, where) == [(1, "b")] and new > old
    # others that are always first end in a conflict, too
    monkeypatch.setattr(publish, "commit", lambda *_: False)
    with pytest.raises(ConflictError):
        publish.retrying(where, spark, lambda base: "x" if publish.commit() else None, attempts=3, sleep=lambda _: None)


def test_only_files_with_new_keys_are_rewritten(spark, tmp_path):
    where = str(tmp_path / "t")
    first = keyed_table.create(spark.range(10_000).selectExpr("id AS k", "0 AS v"), where, ["k"], file_rows=100)
    then = keyed_table.upsert(spark.range(5_000, 5_100).selectExpr("id AS k", "1 AS v"), where, ["k"])
    a, b = ({r.file: r for r in spark.read.parquet(m).collect()} for m in (first, then))
    assert len(a) >= 90 and len(set(a) - set(b)) <= 3 < 0.05 * len(a)
    for r in b.values():  # ranges say what the files hold
        got = spark.read.parquet(f"{where}/{r.file}").selectExpr("min(k)", "max(k)", "count(*)").first()
        assert tuple(got) == (r.low.k0, r.high.k0, r.rows)
    assert publish.read(spark, where).selectExpr("count(*)", "sum(v)", "sum(k)").first() == (10_000, 100, 49_995_000)
    # keys that lie within a file's range and are not there leave the file alone
    wide = keyed_table.create(spark.range(100).selectExpr("id * 2 AS k", "0 AS v"), str(tmp_path / "w"), ["k"], file_rows=10)
    odd = keyed_table.upsert(spark.createDataFrame([(31, 5), (33, 5)], "k bigint, v int"), str(tmp_path / "w"), ["k"])
    files = [{r.file for r in spark.read.parquet(m).collect()} for m in (wide, odd)]
    assert files[0] < files[1] and publish.read(spark, str(tmp_path / "w")).count() == 102


def test_keys_of_several_columns_nulls_and_wider_types(spark, tmp_path):
    where = str(tmp_path / "t")
    publish.upsert_table(spark.createDataFrame([(1, "a", 1.0), (None, "a", 2.0), (1, None, 3.0)], "n int, s string, x double"), where, ["n", "s"])
    publish.upsert_table(spark.createDataFrame([(None, "a", 20, "more"), (2**40, "a", 4, None), (1, None, 30, None), (1, None, 31, None)], "n bigint, s string, x int, y string"), where, ["n", "s"])
    got = publish.read(spark, where)
    assert got.dtypes == [("n", "bigint"), ("s", "string"), ("x", "double"), ("y", "string")]
    assert rows(spark, where) == sorted([(1, "a", 1.0, None), (None, "a", 20.0, "more"), (2**40, "a", 4.0, None), (1, None, 31.0, None)], key=str)
    publish.upsert_table(spark.createDataFrame([], "n bigint, s string"), where, ["n", "s"])
    assert publish.read(spark, where).count() == 4
    with pytest.raises(DataError):
        publish.upsert_table(spark.range(1), where, ["n"])


def test_a_run_that_stops_changes_nothing(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "t")
    publish.upsert_table(spark.createDataFrame([(1, "a")], "id int, v string"), where, ["id"])

    def stop(*_):
        raise KeyboardInterrupt

    real = publish.commit
    monkeypatch.setattr(publish, "commit", stop)
    with pytest.raises(KeyboardInterrupt):
        publish.upsert_table(spark.createDataFrame([(1, "b")], "id int, v string"), where, ["id"])
    monkeypatch.setattr(publish, "commit", real)
    assert rows(spark, where) == [(1, "a")]
    publish.upsert_table(spark.createDataFrame([(1, "c")], "id int, v string"), where, ["id"])
    assert rows(spark, where) == [(1, "c")]


def test_one_writer_alone_makes_a_file(spark, tmp_path):
    files, made = Files(str(tmp_path), spark), []
    where = f"{tmp_path}/once"
    threads = [threading.Thread(target=lambda k=k: made.append((files.create(where, str(k)), k))) for k in range(12)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    (winner,) = [k for ok, k in made if ok]
    assert files.read(where) == str(winner) and sorted(os.listdir(tmp_path)) == ["once"]


def jobs_of(spark, action):
    """The number of jobs an action runs."""
    group = f"g{os.urandom(4).hex()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_units_of_many_files_are_one_write(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import parquet as pq

    src = tmp_path / "in put"
    src.mkdir()
    for i in range(500):
        pq.write_table(pa.table({"id": [i, i, 1000 + i], "v": [1, 1, i]}), src / f"f {i:03d}+%.parquet")
    spec = lambda name: from_mapping({"name": name, "input": str(src), "output": str(tmp_path / name), "steps": [{"dedup": ["id"]}, {"filter": "v <> 7"}, {"select": ["id"]}], "incremental": {"mode": "by_unit"}})
    store, plan = Store(str(tmp_path / "s.db")), spec("u")
    jobs = jobs_of(spark, lambda: transform.run(spark, plan, store))
    assert jobs <= 6  # footers, the write, and broadcasts; not one for each file
    out = tmp_path / "u"
    assert sorted(d for d in os.listdir(out) if d.startswith("unit_")) == sorted(f"unit_{unit_id('u', str(src), str(src / f'f {i:03d}+%.parquet'))}" for i in range(500))
    assert transform.output(spark, plan).count() == 999 and transform.output(spark, plan).columns == ["id"]
    assert transform.run(spark, plan, store)["files"] == 0
    pq.write_table(pa.table({"id": [9000], "v": [1]}), src / "more.parquet")
    assert transform.run(spark, plan, store) == {"mode": "by_unit", "reset": False, "files": 1}
    assert transform.output(spark, plan).count() == 1000


def test_a_run_by_units_that_stops_repeats_no_row(spark, tmp_path, monkeypatch):
    for i in range(6):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    plan = from_mapping({"name": "u", "input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "steps": [{"filter": "id >= 0"}], "incremental": {"mode": "by_unit"}})
    store, real, moved = Store(str(tmp_path / "s.db")), publish.put_unit, []

    def stop(files, tmp, path, unit):
        if len(moved) == 2:
            raise KeyboardInterrupt
        moved.append(unit)
        return real(files, tmp, path, unit)

    monkeypatch.setattr(transform, "UNITS_AT_ONCE", 1)
    monkeypatch.setattr(publish, "put_unit", stop)
    with pytest.raises(KeyboardInterrupt):
        transform.run(spark, plan, store)
    monkeypatch.setattr(publish, "put_unit", real)
    transform.run(spark, plan, store)
    assert sorted(r.id for r in transform.output(spark, plan).collect()) == list(range(60))


def test_statements_over_all_rows_stay_within_a_unit(spark, tmp_path):
    for i in range(3):
        spark.range(i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    plan = from_mapping({"name": "s", "input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "steps": [{"sql": "SELECT count(*) AS n FROM {input}"}], "incremental": {"mode": "by_unit"}})
    transform.run(spark, plan, Store(str(tmp_path / "s.db")))
    assert sorted(r.n for r in transform.output(spark, plan).collect()) == [1, 2, 3]


def test_a_unit_written_again_takes_its_place_or_comes_back(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "u")
    publish.write_unit(spark.range(2), where, "x")
    publish.write_unit(spark.range(5), where, "x")
    assert spark.read.parquet(f"{where}/unit_x").count() == 5 and os.listdir(where) == ["unit_x"]
    real = Files.move

    def stop(self, old, new):
        if "_tmp" in old:
            raise OSError("no")
        real(self, old, new)

    monkeypatch.setattr(Files, "move", stop)
    with pytest.raises(OSError):
        publish.write_unit(spark.range(9), where, "x")
    assert spark.read.parquet(f"{where}/unit_x").count() == 5


def test_footers_of_two_thousand_files_in_one_job(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import parquet as pq

    from tidewright.sources import union

    for i in range(2000):
        pq.write_table(pa.table({"k": pa.array([i], pa.int32() if i % 2 else pa.int64()), **({"more": ["x"]} if i % 2 else {})}), tmp_path / f"{i:04d}.parquet")
    files = union.parquet_files(spark, str(tmp_path))
    assert jobs_of(spark, lambda: union._footers(spark, files)) == 1
    got = {}
    assert jobs_of(spark, lambda: got.update(df=union.read_parquet(spark, str(tmp_path)))) <= 3  # and one look at each of both types
    df = got["df"]
    assert sorted(df.dtypes) == [("k", "bigint"), ("more", "string")] and df.selectExpr("sum(k)", "count(more)").first() == (1999000, 1000)


def test_stores_open_to_spark_alone_are_merged_by_spark(spark, tmp_path, monkeypatch):
    from tidewright.sources import union

    spark.range(3).selectExpr("CAST(id AS int) AS k").write.mode("append").parquet(str(tmp_path / "t"))
    spark.range(3).selectExpr("id AS k", "'x' AS more").write.mode("append").parquet(str(tmp_path / "t"))
    monkeypatch.setattr(union, "footer", lambda _: None)
    assert union.read_parquet(spark, str(tmp_path / "t")).selectExpr("sum(k)", "count(more)").first() == (6, 3)


def test_small_files_are_merged_by_a_commit_in_any_store(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.heap.link./d", f"file://{tmp_path}")
    where = "viewfs://heap/d/t"
    for i in range(6):
        publish.upsert_table(spark.createDataFrame([(10 * i + j, i) for j in range(3)], "k bigint, v int"), where, ["k"])
    before = rows(spark, where)
    assert keyed_table.compact(spark, where, ["k"], file_rows=9) == {"files": 6, "rows": 18, "made": 2}
    assert rows(spark, where) == before
    assert keyed_table.compact(spark, where, ["k"], file_rows=9)["files"] == 0
    publish.upsert_table(spark.createDataFrame([(0, 99)], "k bigint, v bigint"), where, ["k"])
    assert rows(spark, where) == sorted([(0, 99), *before[1:]], key=str)
    with pytest.raises(DataError):
        keyed_table.compact(spark, str(tmp_path / "none"), ["k"])


def test_a_compaction_that_was_second_is_done_again(spark, tmp_path, monkeypatch):
    where, real, first = str(tmp_path / "t"), publish.commit, []
    for i in range(3):
        publish.upsert_table(spark.createDataFrame([(i, "old")], "k int, v string"), where, ["k"])

    def late(files, path, name, base, fence):
        if not first:
            first.append(name)
            publish.upsert_table(spark.createDataFrame([(1, "new")], "k int, v string"), where, ["k"])
        return real(files, path, name, base, fence)

    monkeypatch.setattr(publish, "commit", late)
    keyed_table.compact(spark, where, ["k"])
    assert rows(spark, where) == [(0, "old"), (1, "new"), (2, "old")]
