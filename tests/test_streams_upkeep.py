import random
from datetime import datetime, timedelta, timezone

import pytest

from tidewright.errors import ConflictError, DataError, SpecError
from tidewright.operators import gate, maintain, publish, query, transform
from tidewright.operators.state import Store
from tidewright.plans.ir import from_mapping
from tidewright.sources.union import read_parquet
from tidewright.streaming import runner, watermark


def poll_of(pages):
    def poll(spark, position):
        k = (position or {}).get("page", 0)
        return runner.Batch(spark.createDataFrame(pages[k], "id bigint, at string"), {"page": k + 1}, k + 1 == len(pages)) if k < len(pages) else None

    return poll


def stream(tmp_path, pages, **k):
    return runner.Stream("s", poll_of(pages), str(tmp_path / "out"), str(tmp_path / "state"), **k)


def test_crashes_give_neither_copies_nor_gaps(spark, tmp_path):
    pages = [[(10 * p + i, "2024-01-01T00:00:00Z") for i in range(10)] for p in range(8)]
    rng = random.Random(3)

    def crash(_):
        if rng.random() < 0.4:
            raise RuntimeError("killed")

    s = stream(tmp_path, pages, after_write=crash)
    for _ in range(60):
        try:
            runner.run(spark, s)
            break
        except RuntimeError:
            continue
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out" / "*")).collect()) == list(range(80))
    store = Store(str(tmp_path / "state" / "s.db"))
    assert [b["status"] for b in store.batches("s")].count("committed") == 8
    assert runner.run(spark, s)["batches"] == 0


@pytest.mark.parametrize(("policy", "rows"), [("drop", 3), ("quarantine", 3), ("append", 4)])
def test_late_rows(spark, tmp_path, policy, rows):
    pages = [[(1, "2024-01-01T10:00:00Z")], [(2, "2024-01-01T08:59:00Z"), (3, "2024-01-01T09:30:00Z"), (4, "2024-01-01T11:00:00+00:00")]]
    s = stream(tmp_path, pages, event_time="at", allowed_lateness=watermark.lateness("PT1H"), on_late=policy)
    got = runner.run(spark, s)
    assert got["rows"] == rows and got["late"] == 1
    assert Store(str(tmp_path / "state" / "s.db")).checkpoint("s")["watermark"] == datetime(2024, 1, 1, 10, tzinfo=timezone.utc).timestamp()


def test_times(spark):
    assert watermark.lateness("PT1H30M") == timedelta(minutes=90) and watermark.lateness("P") == timedelta(0)
    with pytest.raises(SpecError):
        watermark.lateness("P1D")
    with pytest.raises(DataError):
        watermark.with_event_time(spark.createDataFrame([("2024-01-01T00:00:00",)], "at string"), "at")
    with pytest.raises(DataError):
        watermark.with_event_time(spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS at"), "at")


def test_stream_rules(spark, tmp_path):
    pages = [[(1, "x"), (None, "y")]]
    s = stream(tmp_path / "a", pages, rules=[gate.Rule("id", "not_null")], on_violation="split")
    assert runner.run(spark, s)["rows"] == 1
    s = stream(tmp_path / "b", pages, rules=[gate.Rule("id", "not_null")])
    with pytest.raises(DataError):
        runner.run(spark, s)
    batches = Store(str(tmp_path / "b" / "state" / "s.db")).batches("s")
    assert maintain.health(batches, batches[-1]["at"], 60)[0] == "failing"
    with pytest.raises(SpecError):
        runner.table_cursor()


def test_reset_and_fence(tmp_path):
    now = [0.0]
    st = Store(str(tmp_path / "s.db"), lambda: now[0])
    fence = st.acquire("s", "a")
    st.plan_batch("b1", "s")
    st.commit_batch("b1", "s", {"p": 1}, None, 1, 0, ("s", "a", fence))
    with pytest.raises(ConflictError):
        st.reset("s")
    st.release("s", "a")
    assert st.reset("s")["generation"] == 1 and st.checkpoint("s")["generation"] == 0
    st.reset("s", confirm=True)
    assert st.checkpoint("s") == {"position": None, "generation": 1, "watermark": None}
    with pytest.raises(ConflictError):
        st.commit_batch("b2", "s", {}, None, 0, 0, ("s", "a", fence))


def test_structured_streaming(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(20).selectExpr("id", "CAST(id AS string) AS at").write.parquet(src)
    df = spark.readStream.schema("id bigint, at string").parquet(src)
    s = stream(tmp_path, [], rules=[gate.Rule("id", "min", 5)], on_violation="split")
    q = runner.structured(df, s, str(tmp_path / "ckpt"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "*")).count() == 15


def test_structured_streaming_sets_late_rows_aside(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    put = lambda name, rows: spark.createDataFrame(rows, "id bigint, at string").coalesce(1).write.parquet(str(src / name))
    put("a", [(1, "2024-01-01T10:00:00Z"), (2, "2024-01-01T12:00:00Z")])
    seen = []
    s = stream(tmp_path, [], event_time="at", after_write=seen.append)
    run = lambda: runner.structured(spark.readStream.schema("id bigint, at string").parquet(str(src / "*")), s, str(tmp_path / "ckpt")).awaitTermination(120)
    assert run()
    put("b", [(3, "2024-01-01T09:00:00Z"), (4, "2024-01-01T13:00:00Z")])
    assert run()
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out" / "*")).collect()} == {1, 2, 4} and len(seen) == 2
    late = [p for p in tmp_path.rglob("*.parquet") if "late" in str(p)]
    assert [r.id for p in late for r in spark.read.parquet(str(p)).collect()] == [3]


def test_compaction_keeps_partitions(spark, tmp_path):
    where = str(tmp_path / "t")
    for i in range(3):
        spark.createDataFrame([(i, "a", 1), (i + 10, "b", 1), (i + 20, "b", 2)], "id bigint, k string, n int").coalesce(1).write.mode("append").partitionBy("k", "n").parquet(where)
    spark.createDataFrame([(99, "c", 1)], "id bigint, k string, n int").coalesce(1).write.mode("append").partitionBy("k", "n").parquet(where)
    rows = lambda: sorted(tuple(r) for r in spark.read.parquet(where).select("id", "k", "n").collect())
    before = rows()
    assert maintain.compact(spark, where)["files"] == 10
    assert rows() == before and len(maintain.compaction_plan(where, 1 << 20, 1)) == 4
    assert sorted(read_parquet(spark, where).columns) == ["id", "k", "n"]
    job = maintain.Backfill(spark, where)
    job.run(lambda df: df.withColumn("id", df.id + 1))
    job.promote()
    assert rows() == [(i + 1, k, n) for i, k, n in before]


def test_publishing_through_another_file_system(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.box.link./d", f"file://{tmp_path}")
    where = "viewfs://box/d/t"
    publish.publish(spark.range(3).toDF("id"), where)
    publish.upsert_table(spark.createDataFrame([(2, "x"), (2, "y"), (7, None)], "id bigint, v string"), where, ["id"])
    assert sorted((r.id, r.v) for r in publish.read(spark, where).collect()) == [(0, None), (1, None), (2, "y"), (7, None)]
    publish.write_unit(spark.range(2).toDF("id"), "viewfs://box/d/u", "one")
    publish.write_unit(spark.range(4).toDF("id"), "viewfs://box/d/u", "one")
    assert spark.read.parquet("viewfs://box/d/u/unit_one").count() == 4
    spec = from_mapping({"name": "v", "input": "viewfs://box/d/u", "output": "viewfs://box/d/o", "incremental": {"mode": "by_unit"}})
    store = Store(str(tmp_path / "v.db"))
    assert transform.run(spark, spec, store)["files"] >= 1 and transform.run(spark, spec, store)["files"] == 0
    assert transform.output(spark, spec).count() == 4


def test_compaction_and_backfill(spark, tmp_path):
    where = str(tmp_path / "t")
    for i in range(4):
        spark.createDataFrame([(i, i * 2)], "id bigint, value bigint").coalesce(1).write.mode("append").parquet(where)
    assert maintain.compact(spark, where, dry_run=True)["files"] == 4
    maintain.compact(spark, where)
    assert len(maintain.compaction_plan(where, 1 << 20, 1)) == 1 and spark.read.parquet(where).count() == 4
    job = maintain.Backfill(spark, where)
    with pytest.raises(SpecError):
        job.promote()
    assert job.run(lambda df: df.selectExpr("id", "value + 1 AS value")) == 4
    assert spark.read.parquet(where).agg({"value": "sum"}).first()[0] == 12
    job.promote()
    assert spark.read.parquet(where).agg({"value": "sum"}).first()[0] == 16
    with publish.FileLock(str(tmp_path / "lock")), pytest.raises(ConflictError):
        publish.FileLock(str(tmp_path / "lock"), sleep=lambda _: None).__enter__()


def test_graphs():
    tasks = {"c": {"needs": ["a"]}, "a": {"priority": 2}, "b": {"priority": 1, "signals": ["go"]}, "d": {"window": (22, 4)}}
    assert maintain.ordered(tasks) == ["d", "b", "a", "c"]
    assert maintain.runnable(tasks, {"a"}, set(), 23) == ["d", "c"]
    with pytest.raises(SpecError):
        maintain.ordered({"a": {"needs": ["b"]}, "b": {"needs": ["a"]}})
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("d", "d")]
    assert maintain.walk(edges, "a") == {"b": 1, "c": 2} and maintain.walk(edges, "c", "up", 1) == {"b": 1}
    assert maintain.cycles(edges) == [["b", "c"], ["d"]]
    assert "n0 --> n1" in maintain.mermaid(edges)
    assert maintain.normal_uri("s3://u:p@b/x/*.parquet?v=1") == "s3://b/x"
    assert maintain.redacted("postgres://u:pw@h/db?token=abc&x=1") == "postgres://u:***@h/db?token=***&x=1"


def test_questions(spark, tmp_path):
    f = str(tmp_path / "o.parquet")
    spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string").write.parquet(f)
    assert query.run(spark, f"SELECT count(*) AS n FROM '{f}'").first()[0] == 2
    assert query.is_select("WITH x AS (SELECT 1) SELECT * FROM x") and not query.is_select("drop table x") and not query.is_select("SELECT 1; DROP TABLE x")
    answers = iter(["SELECT nope FROM t", f"```sql\nSELECT v FROM '{f}' ORDER BY v;\n```"])
    sql, df = query.answer(spark, "which v are there", {"o": "ids and v"}, lambda _: next(answers))
    assert [r["v"] for r in df.collect()] == ["a", "b"]
    assert query.rendered(df, "csv") == "v\na\nb\n" and query.rendered(df, "jsonl", 1) == '{"v": "a"}'
    assert query.retrieve({"orders": "order amount", "people": "names"}, "total amount of orders") == ["orders"]
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    assert query.run(spark, f"SELECT a FROM read_csv('{tmp_path}/c.csv')").first()[0] == 1


def test_paths_in_queries(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a|b\n1|x\n2|none\n")
    spark.range(3).write.parquet(str(tmp_path / "p"))
    c, p = f"{tmp_path}/c.csv", f"{tmp_path}/p"
    assert [tuple(r) for r in query.run(spark, f"SELECT a, b FROM read_csv('{c}', delim='|', nullstr='none') ORDER BY a").collect()] == [(1, "x"), (2, None)]
    for bad in ("skip=2", "header=false", "delim=3"):
        with pytest.raises(SpecError):
            query.run(spark, f"SELECT * FROM read_csv('{c}', {bad})")
    assert query.run(spark, f"SELECT extract(year FROM CAST('2020-01-01' AS date)) AS y, 'FROM a' AS s FROM '{p}' a, '{p}' AS b WHERE a.id = b.id AND a.id IN (1, 2)").collect() == [(2020, "FROM a")] * 2
    assert query.run(spark, f"WITH w AS (SELECT id FROM '{p}') SELECT count(*) FROM w JOIN (SELECT id FROM read_parquet('{p}', union_by_name=true)) x ON w.id = x.id AND 'a' <> 'b'").first()[0] == 3
    assert query.run(spark, f"SELECT extract(year FROM '2020-01-01') AS y FROM '{p}' LIMIT 1").first()[0] == 2020


def test_statements_in_answers():
    s = "SELECT 1"
    for text in (s, f"{s};", f"```sql\n{s};\n```", f"Try this:\n```\n{s}\n```\nor not", f"```{s}```", f"```sql\nDROP TABLE t\n```\n```sql\n{s}\n```", f"```SQL\n{s}"):
        assert query.extract_sql(text) == s
