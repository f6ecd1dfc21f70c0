"""Streams bound to their checkpoint, units counted as they are written, sources as a format, search, lineage, state and submissions."""

import json
import os
import sqlite3
import time

import pytest

from tidewright import cli
from tidewright.errors import ConflictError, SpecError
from tidewright.operators import gate, ingest, maintain, query, state
from tidewright.operators.catalog import Catalog
from tidewright.operators.submissions import ABSENT, Submissions
from tidewright.sources import spark_source
from tidewright.streaming import runner
from tests.test_keyed_tables import jobs_of


# streams
def test_another_checkpoint_takes_no_place(spark, tmp_path):
    src = tmp_path / "src"
    put = lambda name, n: spark.range(n).coalesce(1).write.parquet(str(src / name))
    put("a", 10)
    s = runner.Stream("s", lambda *_: None, str(tmp_path / "out"), str(tmp_path / "state"))
    run = lambda ckpt, s=s: runner.structured(spark.readStream.schema("id bigint").parquet(str(src / "*")), s, str(tmp_path / ckpt)).awaitTermination(120)
    count = lambda: spark.read.parquet(f"{tmp_path}/out/*").count()
    assert run("one") and count() == 10
    put("b", 3)
    assert run("one") and count() == 13  # a restart goes on
    assert run("two") and count() == 26  # another query adds its own rows and takes none away
    s.revision = "2"
    assert run("three") and count() == 39
    store = state.Store(str(tmp_path / "state" / "s.db"))
    assert store.con.execute("SELECT count(*) FROM meta WHERE key LIKE 'watermark:%'").fetchone()[0] == 3  # one a query, however many epochs


def test_an_epoch_that_runs_again_has_the_same_late_rows(spark, tmp_path):
    src, calls = tmp_path / "src", []
    put = lambda name, rows: spark.createDataFrame(rows, "id bigint, at string").coalesce(1).write.parquet(str(src / name))

    def after(unit):
        calls.append(unit)
        if len(calls) == 2:
            raise RuntimeError("stopped")

    s = runner.Stream("s", lambda *_: None, str(tmp_path / "out"), str(tmp_path / "state"), event_time="at", after_write=after)
    run = lambda: runner.structured(spark.readStream.schema("id bigint, at string").parquet(str(src / "*")), s, str(tmp_path / "ckpt")).awaitTermination(120)
    put("a", [(1, "2024-01-01T12:00:00Z")])
    assert run()
    put("b", [(2, "2024-01-01T11:00:00Z"), (3, "2024-01-01T14:00:00Z")])
    with pytest.raises(Exception):
        run()
    assert run() and len(set(calls)) == 2
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/out/*").collect()} == {1, 3}
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/state/late/s/*").collect()} == {2}


def test_content_tells_nulls_and_columns_apart(spark):
    of = lambda rows: runner.content_of(spark.createDataFrame(rows, "a string, b string, m map<string,int>"))[:2]
    texts = [[("x", None, None)], [(None, "x", None)], [("x", "x", None)], [("x", None, {"k": 1})], [("x", None, None)] * 2]
    assert len({of(t) for t in texts}) == len(texts)
    assert of([("x", None, None), ("y", "z", {})]) == of([("y", "z", {}), ("x", None, None)])


# units
def pipe(spark, tmp_path, policy, rows, rules, **more):
    df = spark.createDataFrame(rows, "k int, v int")
    return ingest.Pipeline("p", "src", lambda _: [("u", lambda s: df)], str(tmp_path / "out"), str(tmp_path / "state"), rules=rules, policy=policy, **more)


def test_a_warned_unit_is_one_job(spark, tmp_path):
    rules = [gate.Rule("v", "min", 0), gate.Rule("k", "not_null"), gate.Rule("v", "max", 8)]
    rows = [(1, 5), (None, -1), (2, 9), (3, 3)]
    p = pipe(spark, tmp_path, "warn", rows, rules, drift="allow")
    p.contract = None
    uid = state.unit_id("p", "src", "u")
    assert jobs_of(spark, lambda: ingest._load(p, spark.createDataFrame(rows, "k int, v int"), uid)) == 1
    assert spark.read.parquet(f"{tmp_path}/out/unit_{uid}").count() == 4 and os.listdir(tmp_path / "out") == [f"unit_{uid}"]
    watched, told = gate.watched(spark.createDataFrame(rows, "k int, v int"), rules)
    watched.write.format("noop").mode("overwrite").save()
    assert told() == (4, gate.counts(spark.createDataFrame(rows, "k int, v int"), rules).first().asDict())


@pytest.mark.parametrize("policy, loaded, aside", [("warn", 4, 0), ("split", 2, 2), ("quarantine", 0, 4)])
def test_policies_of_units_written_once(spark, tmp_path, policy, loaded, aside):
    p = pipe(spark, tmp_path, policy, [(1, 5), (None, -1), (2, -9), (3, 3)], [gate.Rule("v", "min", 0)])
    done = ingest.run(spark, p)
    assert done == {"loaded": int(loaded > 0), "skipped": 0, "quarantined": int(not loaded)}
    of = lambda where: spark.read.parquet(f"{where}/unit_*").count() if any(d.startswith("unit_") for d in os.listdir(where)) else 0
    assert of(tmp_path / "out") == loaded
    assert (of(tmp_path / "state" / "dlq" / "p") if aside else 0) == aside


def test_a_retry_of_a_split_unit_counts_all_rows(spark, tmp_path):
    p = pipe(spark, tmp_path, "split", [(i, i - 3) for i in range(10)], [gate.Rule("v", "min", 0)])
    ingest.run(spark, p)
    store = state.Store(str(tmp_path / "state" / "p.db"))
    assert store.metrics("p")["rows"] == 7
    store.acquire("p", "another")
    with pytest.raises(ConflictError):
        ingest.retry_set_aside(spark, p, lambda df: df.selectExpr("k", "0 AS v"))
    store.release("p", "another")
    assert ingest.retry_set_aside(spark, p, lambda df: df.selectExpr("k", "0 AS v")) == {"loaded": 1, "kept": 0}
    assert spark.read.parquet(f"{tmp_path}/out/*").count() == 10 and store.metrics("p")["rows"] == 10


# sources as a format
def test_a_source_is_a_format(spark):
    spark_source.register(spark)
    read = spark.read.format("tidewright").option("source", "tests.sample_sources:Numbers").option("units", "5")
    df = read.load()
    assert df.dtypes == [("id", "bigint"), ("unit", "int"), ("note", "string")] and df.rdd.getNumPartitions() == 5
    assert df.selectExpr("sum(id)", "count(note)", "count(DISTINCT unit)").first() == (190, 10, 5)
    assert read.schema("note string, id bigint").load().columns == ["note", "id"]
    for bad in ("tests.sample_sources:Nothing", "tests.sample_sources:Gone", "no.module:X", ""):
        with pytest.raises(Exception, match="source"):
            spark.read.format("tidewright").option("source", bad).schema("id bigint").load().count()


def test_a_stream_of_a_source_restarts_without_copies_or_gaps(spark, tmp_path):
    spark_source.register(spark)
    end = tmp_path / "end.json"

    def run(to, fail=False):
        end.write_text(json.dumps({"at": to}))
        df = spark.readStream.format("tidewright").option("source", "tests.sample_sources:Growing").option("where", str(end)).load()
        if fail:
            df = df.selectExpr("CASE WHEN id = 12 THEN raise_error('stop') ELSE id END AS id")
        q = df.selectExpr("CAST(id AS bigint) AS id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run(10)
    with pytest.raises(Exception):
        run(20, fail=True)
    run(25)
    run(25)
    run(31)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(31))
    assert json.loads((tmp_path / "done").read_text())["at"] >= 20


# catalogue and lineage
def specs(folder, n, drop=0):
    folder.mkdir(exist_ok=True)
    for f in folder.iterdir():
        f.unlink()
    for i in range(drop, n):
        (folder / f"s{i}.json").write_text(json.dumps({"name": f"n{i}", "source": f"raw/feed{i:05d}", "sink": f"lake/clean{i:05d}", "description": f"readings of river {i % 100} gauge", "contract": {"id": ["int64", False]}, "fresh_within_s": 60}))


def test_search_by_an_index(spark, tmp_path):
    cat = Catalog(str(tmp_path / "c.db"))
    specs(tmp_path / "specs", 10_000)
    cat.scan(str(tmp_path / "specs"))
    assert cat.con.execute("SELECT count(*) FROM found").fetchone()[0] == 20_000
    cat.search("river")
    began = time.perf_counter()
    got = cat.search("river gauge clean00042")
    assert time.perf_counter() - began < 0.05 and got == ["lake/clean00042"]
    assert cat.search("Readings 0042") == ["lake/clean00042", *(f"lake/clean0042{i}" for i in range(10))] and cat.search("zz nothing") == []
    assert "lake/clean00007" in cat.search("7 of gauge")  # terms of a letter or two
    cat.tag("lake/clean00042", "gold")
    assert cat.search("gold") == ["lake/clean00042"]
    specs(tmp_path / "specs", 50, drop=43)
    cat.scan(str(tmp_path / "specs"))
    assert cat.search("gold") == [] and cat.search("clean") == [f"lake/clean{i:05d}" for i in range(43, 50)]


def test_findings_of_contracts_and_freshness(spark, tmp_path):
    cat = Catalog(str(tmp_path / "c.db"))
    where = str(tmp_path / "t")
    (tmp_path / "specs").mkdir()
    (tmp_path / "specs" / "a.json").write_text(json.dumps({"name": "a", "source": "raw", "sink": where, "contract": {"id": ["int32", False], "gone": ["string", True]}, "fresh_within_s": 60}))
    cat.scan(str(tmp_path / "specs"))
    assert cat.findings(1000.0) == [("contract", where, "no schema was seen"), ("freshness", where, "unknown")]
    spark.range(2).write.parquet(where)
    cat.observe(spark, where)
    cat.seen(where, 900.0)
    assert cat.findings(1000.0) == [("contract", where, "gone is missing"), ("contract", where, "id is int64, not int32"), ("freshness", where, "100 s old; 60 s were promised")]
    assert ("freshness", where) not in {f[:2] for f in cat.findings(950.0)} and cat.search("id raw") == []


def test_cycles_of_many_edges():
    n = 25_000
    edges = [(i, i + 1) for i in range(n)] + [(i + 1, i) for i in range(0, n, 5)] + [(n, 0)] + [(10**6 + i, 10**6 + i + 1) for i in range(19_000)] + [("x", "x")]
    edges = [(f"{a}", f"{b}") for a, b in edges]
    began = time.perf_counter()
    got = maintain.cycles(edges)
    assert time.perf_counter() - began < 1.0
    assert sorted(map(len, got)) == [1, n + 1] and ["x"] in got


def test_cycles_match_plain_reach():
    import random

    rng = random.Random(6)
    for _ in range(60):
        edges = {(str(rng.randrange(9)), str(rng.randrange(9))) for _ in range(rng.randrange(1, 16))}
        nodes = sorted({x for e in edges for x in e})
        reach = {a: set(maintain.walk(edges, a)) | {a} for a in nodes}
        want = {tuple(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}
        assert maintain.cycles(edges) == sorted(list(g) for g in want if len(g) > 1 or (g[0], g[0]) in edges)


# state
def test_state_of_an_older_version_opens(tmp_path):
    path = str(tmp_path / "s.db")
    con = sqlite3.connect(path)
    for statement in state.STEPS[1]:
        con.execute(statement)
    con.execute("INSERT INTO meta VALUES('version', '1')")
    con.execute("INSERT INTO units(unit_id, pipeline, unit_key, status, rows) VALUES('u', 'p', 'k', 'done', 7)")
    con.commit()
    assert state.migrated(con, path, dry_run=True) == [2] and con.execute("SELECT value FROM meta WHERE key='version'").fetchone()[0] == "1"
    con.close()
    store = state.Store(path)
    assert store.meta("version") == "2" and store.metrics("p")["rows"] == 7 and not store.begin("u", "p", "k")
    copy = sqlite3.connect(f"{path}.v1.bak")
    assert copy.execute("SELECT value FROM meta WHERE key='version'").fetchone()[0] == "1" and copy.execute("SELECT rows FROM units").fetchone()[0] == 7
    store.con.close()
    again = state.Store(path)
    assert state.migrated(again.con, path) == []
    again.meta("version", "99")
    with pytest.raises(ConflictError):
        state.Store(path)


def test_a_step_that_fails_leaves_the_version_before(tmp_path, monkeypatch):
    path = str(tmp_path / "s.db")
    state.Store(path).con.close()
    monkeypatch.setitem(state.STEPS, 3, ("CREATE TABLE more(x)", "no statement"))
    with pytest.raises(sqlite3.OperationalError):
        state.Store(path)
    con = sqlite3.connect(path)
    assert con.execute("SELECT value FROM meta WHERE key='version'").fetchone()[0] == "2"
    assert not con.execute("SELECT 1 FROM sqlite_master WHERE name='more'").fetchone()


class Cluster:
    """Takes runs by token, and can be out of reach."""

    def __init__(self):
        self.runs, self.sure, self.states, self.ended = {}, True, {}, []

    def submit(self, manifest, token):
        self.runs[token] = f"job-{len(self.runs)}"
        return self.runs[token]

    def probe(self, token):
        return self.runs.get(token, ABSENT if self.sure else None)

    def made(self, store, after=lambda _: None):
        return Submissions(store, self.submit, self.probe, lambda h: self.states.get(h, "running"), self.ended.append, after=after)


@pytest.mark.parametrize("where", ["planned", "submitting", "submitted"])
def test_a_driver_that_dies_submits_once(tmp_path, where):
    def die(at):
        if at == where:
            raise KeyboardInterrupt

    cluster, store = Cluster(), state.Store(str(tmp_path / "s.db"))
    with pytest.raises(KeyboardInterrupt):
        cluster.made(store, die).start("r", {"plan": 1})
    store.con.close()
    store = state.Store(str(tmp_path / "s.db"))
    row = cluster.made(store).reconcile("r")
    assert row["status"] in ("submitted", "running") and len(cluster.runs) == 1 and row["handle"] == "job-0"
    cluster.states["job-0"] = "succeeded"
    assert cluster.made(store).reconcile("r")["status"] == "succeeded"
    assert cluster.made(store).start("r", {"plan": 1})["status"] == "succeeded" and len(cluster.runs) == 1


def test_nothing_is_submitted_again_until_absence_is_sure(tmp_path):
    def die(at):
        if at == "submitting":
            raise KeyboardInterrupt

    cluster, store = Cluster(), state.Store(str(tmp_path / "s.db"))
    with pytest.raises(KeyboardInterrupt):
        cluster.made(store, die).start("r", {"plan": 1})
    cluster.sure = False
    assert cluster.made(store).reconcile("r")["status"] == "submitting" and not cluster.runs
    cluster.sure = True
    row = cluster.made(store).reconcile("r")
    assert row["attempt"] == 2 and len(cluster.runs) == 1
    with pytest.raises(ConflictError):
        cluster.made(store).start("r", {"plan": 2})
    assert cluster.made(store).cancel("r")["status"] == "cancelled" and cluster.ended == ["job-0"]
    with pytest.raises(SpecError):
        cluster.made(store).reconcile("unknown")


# questions
def test_described_tables_and_documents(spark):
    df = spark.createDataFrame([(1, "a", None, 1.5), (2, "b", {"k": 1}, None), (2, "b", None, 2.5)], "`x.y` int, s string, m map<string,int>, d double")
    got = {r["column"]: tuple(r)[1:] for r in query.described(df).collect()}
    assert got["x.y"] == ("int", 3, 0, 2, "1", "2") and got["s"] == ("string", 3, 0, 2, "a", "b")
    assert got["m"][:3] == ("map<string,int>", 3, 2) and got["m"][4:] == (None, None) and got["d"][2] == 1
    assert query.profile(df.withColumnRenamed("s", "t.u")).collect() == [("t.u", "b", 2), ("t.u", "a", 1)]
    text = query.document(df, "A small table.")
    assert text.splitlines()[0] == "3 rows. A small table." and "- s string, 0 nulls, about 2 values, a to b, often b, a" in text and '"x.y": 1' in text
    assert query.document(df.limit(0)).startswith("0 rows.")


def test_paths_in_lists_and_joins_in_parentheses(spark, tmp_path):
    a, b = (str(tmp_path / n) for n in ("a.parquet", "b.parquet"))
    spark.range(3).write.parquet(a)
    spark.range(2).selectExpr("id", "'x' AS more").write.parquet(b)
    assert query.run(spark, f"SELECT count(*), count(more) FROM read_parquet(['{a}', '{b}'])").first() == (5, 2)
    assert query.run(spark, f"SELECT count(*) FROM ('{a}' x JOIN '{b}' y ON x.id = y.id), '{b}' z").first()[0] == 4
    assert query.run(spark, f"SELECT count(*) FROM (('{a}' x JOIN '{b}' y ON x.id = y.id) JOIN (SELECT 1 AS id) w ON w.id = x.id)").first()[0] == 1
    for bad in ("read_parquet(['a', 1])", "read_parquet([])", "read_parquet(x)"):
        with pytest.raises(SpecError):
            query.run(spark, f"SELECT * FROM {bad}")


def test_answers_are_judged_by_the_first_failure():
    one, two = [{"n": 1}], [{"m": 1.0000000001}]
    ok = {"needed": {"t"}, "retrieved": {"t", "u"}, "sql": "SELECT n FROM 'a.parquet'", "known": {"a.parquet"}, "want": one, "got": two}
    cases = {
        "CORRECT": {},
        "RETRIEVAL_MISS": {"retrieved": {"u"}, "sql": "DROP TABLE x"},
        "NON_SELECT": {"sql": "DROP TABLE 'b.parquet'"},
        "UNANSWERABLE": {"sql": "-- UNANSWERABLE"},
        "HALLUCINATED_TABLE": {"sql": "SELECT 1 FROM 'b.parquet'", "got": None},
        "HALLUCINATED_COLUMN": {"got": None, "error": "[UNRESOLVED_COLUMN.WITH_SUGGESTION] x"},
        "EXEC_ERROR": {"got": None, "error": "divide by zero"},
        "WRONG_RESULT": {"got": [{"n": 2}]},
        "WRONG_SHAPE": {"got": [{"n": 1}, {"n": 1}]},
    }
    assert {k: query.judged(**ok | v) for k, v in cases.items()} == {k: k for k in cases} and set(cases) == set(query.FAILURES)
    assert query.judged(**ok | {"want": None, "sql": "unanswerable"}) == "CORRECT" and query.judged(**ok | {"want": None}) == "WRONG_RESULT"


# project
def test_init_and_status(spark, tmp_path, capsys):
    assert cli.main(["init", str(tmp_path / "new")]) == 0 and os.path.isfile(tmp_path / "new" / "specs" / "first.json")
    assert cli.main(["init", str(tmp_path / "new")]) == 2
    capsys.readouterr()
    store = state.Store(str(tmp_path / "p.db"))
    store.begin("u", "p", "k")
    store.finish("u", "done", 5, ms=40)
    assert cli.main(["status", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out)["pipelines"]["p"]["mean_ms"] == 40
    store.begin("v", "p", "l")
    store.finish("v", "failed", error="x")
    store.begin("v", "p", "l")
    store.plan_batch("b", "s")
    store.fail_batch("b", "no")
    found = cli.status(str(tmp_path), 60)
    assert found["alert"] and found["streams"]["s"]["health"] == "failing" and found["pipelines"]["p"]["retries"] == 1
    assert cli.main(["status", str(tmp_path)]) == 1
