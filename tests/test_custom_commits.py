import pytest

from tidewright.errors import ConflictError, DataError, SpecError
from tidewright.operators import commits, ingest, publish
from tidewright.operators.state import Store
from tidewright.sources import custom
from tidewright.streaming import runner


class Numbers:
    def __init__(self, n=2):
        self.n = n

    def units(self):
        return [f"u{i}" for i in range(self.n)]

    def fetch(self, spark, unit):
        return spark.createDataFrame([(unit,)], "u string")


def test_sources_by_name_and_iterables(spark, tmp_path):
    source = custom.load("tests.test_custom_commits:Numbers", n=3)
    p = ingest.Pipeline("p", "src", lambda _: custom.units_of(source), str(tmp_path / "o"), str(tmp_path / "s"))
    assert ingest.run(spark, p)["loaded"] == 3
    for bad in ("nope:X", "tests.test_custom_commits:nope", "json:loads"):
        with pytest.raises((SpecError, TypeError)):
            custom.load(bad)
    q = ingest.Pipeline("q", "src", lambda _: custom.iterable_units(lambda: ({"id": i, "x": {"y": i}} for i in range(5)), 2), str(tmp_path / "o2"), str(tmp_path / "s"))
    assert ingest.run(spark, q)["loaded"] == 3
    assert spark.read.parquet(str(tmp_path / "o2" / "*")).selectExpr("sum(x.y)").first()[0] == 10


def test_polled_stream(spark, tmp_path):
    pages = {None: ({"r": [{"id": 1}, {"id": 2}], "n": "a"}, {}), "a": ({"r": [{"id": 3}], "n": None}, {})}
    poll = custom.Polled(lambda p: pages[p.get("cursor")], "r", "n", "id", schema="id bigint")
    s = runner.Stream("s", poll, str(tmp_path / "o"), str(tmp_path / "s"))
    assert runner.run(spark, s)["rows"] == 3 and runner.run(spark, s)["batches"] == 0
    with pytest.raises(DataError):
        custom.Polled(lambda p: ({"r": [{"id": 1}, {"id": 1}]}, {}), "r", "n", "id")(spark, None)


def test_outbox_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"e{i}", i, "I") for i in range(7)], "event_id string, sequence bigint, op string")
    s = runner.Stream("s", custom.outbox_poll(lambda _: rows, 3), str(tmp_path / "o"), str(tmp_path / "s"))
    assert runner.run(spark, s)["batches"] == 3
    assert spark.read.parquet(str(tmp_path / "o" / "*")).count() == 7


def test_tokens_are_fetched_once_more():
    got = []

    def send(params, headers):
        got.append(headers["Authorization"])
        return (401, None, {}) if len(got) == 1 else (200, [1], {})

    tokens = iter(["a", "b"])
    assert custom.Authorised(send, fetch_token=lambda: next(tokens))({}) == ([1], {}) and got == ["Bearer a", "Bearer b"]
    with pytest.raises(DataError):
        custom.Authorised(lambda *_: (403, None, {}), "t")({})


def test_commits(spark, tmp_path):
    where = str(tmp_path / "t")
    df = spark.range(3)
    first = commits.commit(df, where, "r1", "plan", 10.0)
    assert first.rows == 3 and commits.commit(spark.range(9), where, "r1", "plan", 10.0) == first
    with pytest.raises(ConflictError):
        commits.commit(df, where, "r1", "other", 10.0)
    with pytest.raises(ConflictError):
        commits.commit(df, where, "r0", "plan", 5.0)
    assert commits.commit(spark.range(4), where, "r2", "plan", 11.0).rows == 4 and publish.read(spark, where).count() == 4
    src = str(tmp_path / "in")
    df.write.parquet(src)
    mark = commits.fingerprint(commits.listing(src))
    assert commits.read_as_planned(spark, src, mark).count() == 3
    df.write.mode("append").parquet(src)
    with pytest.raises(ConflictError):
        commits.read_as_planned(spark, src, mark)
    with pytest.raises(SpecError):
        commits.SINKS["units"].require(delete_apply=True)


def test_exclusive_and_project(tmp_path):
    s = Store(str(tmp_path / "s.db"))
    with commits.exclusive({"w": s}, "me"), pytest.raises(ConflictError):
        s.acquire("w", "other")
    s.plan_batch("b", "w")
    with pytest.raises(ConflictError), commits.exclusive({"w": s}, "me"):
        pass
    assert commits.run_project({"pipelines": [("a", lambda: None)], "transforms": [("b", lambda: 1 / 0), ("c", lambda: None)]}) == {"ok": ["pipelines:a"], "failed": ("transforms", "b", "division by zero")}
