import sqlite3

import pytest

from tidewright.errors import ConflictError, DataError, SpecError
from tidewright.operators import gate, ingest, keyed
from tidewright.operators.state import Store, unit_id
from tidewright.sources import database, files, paged


def test_csv_types(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("id,zip,qty,neg,continent,amount,day,flag\n1,02139,0,-007,NA,1.5,2024-01-02,true\n2,10001,10,5,NA,,2024-01-03,false\n")
    df = files.read_csv(spark, str(f))
    assert dict(df.dtypes) == {"id": "bigint", "zip": "string", "qty": "bigint", "neg": "string", "continent": "string", "amount": "double", "day": "date", "flag": "boolean"}
    assert [r["amount"] for r in df.collect()] == [1.5, None]
    pinned = files.read_csv(spark, str(f), {"id": "string", "qty": "float64"}, null_values=["", "NA"])
    assert dict(pinned.dtypes)["id"] == "string" and pinned.filter("continent is null").count() == 2
    with pytest.raises(DataError):
        files.read_csv(spark, str(f), {"nope": "string"})
    with pytest.raises(Exception):
        files.read_csv(spark, str(f), {"zip": "date"}).collect()


def test_jsonl_and_units(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "d" / "a.jsonl").write_text('{"a": 1}\nnot json\n')
    assert [k for k, _ in files.units(str(tmp_path / "**" / "*.jsonl"))] == ["d/a.jsonl", "d/b.jsonl"]
    assert "@" in next(files.units(str(tmp_path / "d" / "*.jsonl"), detect_changes=True))[0]
    assert files.read(spark, str(tmp_path / "d" / "b.jsonl")).count() == 2
    with pytest.raises(Exception):
        files.read(spark, str(tmp_path / "d" / "a.jsonl")).collect()
    with pytest.raises(SpecError):
        files.read(spark, "x.xlsx")


def test_key_ranges(spark, tmp_path):
    path = str(tmp_path / "t.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t(id INTEGER, v TEXT)")
    con.executemany("INSERT INTO t VALUES(?,?)", [(i, str(i)) for i in range(1, 251)])
    con.commit()
    source = database.SqliteTable(path, "t", "id", 100)
    keys = [u[0] for u in source.units()]
    assert keys == ["key=1..101", "key=101..201", "key=201..251"]
    assert sum(source.fetch(spark, u).count() for u in source.units()) == 250
    con.executemany("INSERT INTO t VALUES(?,?)", [(i, str(i)) for i in range(251, 301)])
    con.commit()
    assert [u[0] for u in source.units()][-1] == "key=201..301"  # the last range opens again
    with pytest.raises(SpecError):
        database.identifier("t; drop")


def test_jdbc_key_ranges(spark, tmp_path, monkeypatch):
    url = f"jdbc:derby:{tmp_path}/base;create=true;user=app;password=hunter2"
    monkeypatch.setenv("TIDE_DSN", url)
    spark.range(1, 251).selectExpr("id", "CAST(id AS string) AS v").write.jdbc(url, "app.t", properties={"createTableColumnTypes": "v varchar(20)"})
    source = database.JdbcTable(spark, "TIDE_DSN", "APP.T", "id", size=100, parts=3)
    units = list(source.units())
    assert [u[0] for u in units] == ["key=1..101", "key=101..201", "key=201..251"]
    got = source.fetch(spark, units[1])
    assert got.rdd.getNumPartitions() == 3 and sorted(r.id for r in got.collect()) == list(range(101, 201))
    with pytest.raises(DataError) as e:
        list(database.JdbcTable(spark, "TIDE_DSN", "NOPE", "id").units())
    assert "hunter2" not in str(e.value)
    monkeypatch.delenv("TIDE_DSN")
    with pytest.raises(SpecError):
        list(source.units())
    with pytest.raises(SpecError):
        database.JdbcTable(spark, "TIDE_DSN", "t; drop", "id")


def pages(total, size):
    def transport(params):
        at = params.get("offset", (params.get("page", 1) - 1) * size)
        return {"data": {"items": [{"id": i} for i in range(at, min(at + size, total))]}}, {}

    return transport


def test_paged_modes():
    for mode in ("offset", "page"):
        got = list(paged.Paged(pages(5, 2), mode, 2, record_path="data.items").pages())
        assert [len(r) for _, r, _ in got] == [2, 2, 1] and got[-1][2] == paged.EXHAUSTED
    chain = {None: ([1], 0), 0: ([2], ""), }
    got = list(paged.Paged(lambda p: ({"r": chain[p.get("cursor")][0], "n": {"c": chain[p.get("cursor")][1]}}, {}), "cursor", record_path="r", cursor_path="n.c").pages())
    assert [k for k, _, _ in got] == ["cursor=", "cursor=0"]
    assert list(paged.Paged(lambda p: 1 / 0, "cursor", cursor_path="x").pages(paged.EXHAUSTED)) == []
    links = {None: ([1], {"Link": '<http://x/2>; rel="next"'}), "http://x/2": ([2], {})}
    assert [r for _, r, _ in paged.Paged(lambda p: links[p.get("url")], "link").pages()] == [[1], [2]]
    assert [x[2] for x in paged.batches([1, 2, 3, 4], 2)] == [False, True]
    slept = []
    bucket = paged.TokenBucket(2, clock=lambda: 0.0, sleep=slept.append)
    bucket.take()
    bucket.take()
    assert slept == [0.5]


def test_waits_and_posts():
    asked, slept = [], []
    answers = iter([({}, {"Retry-After": "3"}, 429), ({}, {"retry-after": "Thu, 01 Jan 1970 00:00:00 GMT"}, 503), ({"r": [{"id": 1}]}, {}, 200)])

    def transport(params, body):
        asked.append((params, body))
        return next(answers)

    got = list(paged.Paged(transport, "page", 5, record_path="r", body={"q": "x"}, sleep=slept.append).pages())
    assert [r for _, r, _ in got] == [[{"id": 1}]] and slept == [3.0, 0.0] and asked[0] == ({"page": 1, "per_page": 5}, {"q": "x"})
    with pytest.raises(ConnectionError):
        list(paged.Paged(lambda p: ({}, {}, 503), "page", 5, tries=2, sleep=slept.append).pages())


def test_units_set_aside_are_tried_again(spark, tmp_path):
    a = lambda s: s.createDataFrame([(1, 5), (2, -1)], "id bigint, amount bigint")
    p = pipe(spark, tmp_path, [("a", a)], rules=RULES)
    assert ingest.run(spark, p)["quarantined"] == 1
    assert ingest.retry_set_aside(spark, p) == {"loaded": 0, "kept": 1}
    calls = []

    def crash(uid):
        calls.append(uid)
        if len(calls) == 1:
            raise RuntimeError("killed")

    p.after_write = crash
    fix = lambda df: df.selectExpr("id", "abs(amount) AS amount")
    with pytest.raises(RuntimeError):
        ingest.retry_set_aside(spark, p, fix)
    assert ingest.retry_set_aside(spark, p, fix) == {"loaded": 1, "kept": 0}
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "*")).collect()) == [(1, 5), (2, 1)]
    assert ingest.retry_set_aside(spark, p, fix) == {"loaded": 0, "kept": 0}


RULES = [gate.Rule("id", "not_null"), gate.Rule("amount", "min", 0)]


def pipe(spark, tmp_path, units, **k):
    return ingest.Pipeline("p", "src", lambda cursor: units, str(tmp_path / "out"), str(tmp_path / "state"), **k)


def test_policies(spark, tmp_path):
    a = lambda s: s.createDataFrame([(1, 5), (2, -1), (3, 1)], "id bigint, amount bigint")
    b = lambda s: s.createDataFrame([(4, 5), (None, 3)], "id bigint, amount bigint")
    units = [("a", a), ("b", b)]
    assert ingest.run(spark, pipe(spark, tmp_path / "q", units, rules=RULES))["quarantined"] == 2
    assert ingest.run(spark, pipe(spark, tmp_path / "s", units, rules=RULES, policy="split"))["loaded"] == 2
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "s" / "out" / "*")).collect()) == [1, 3, 4]
    assert spark.read.parquet(str(tmp_path / "s" / "state" / "dlq" / "p" / "unit_*")).count() == 2
    with pytest.raises(DataError):
        ingest.run(spark, pipe(spark, tmp_path / "b", units, rules=RULES, policy="block"))
    assert ingest.run(spark, pipe(spark, tmp_path / "w", units, rules=RULES, policy="warn"))["loaded"] == 2


def test_crash_and_resume(spark, tmp_path):
    fetched = []

    def unit(k):
        return lambda s: (fetched.append(k), s.createDataFrame([(k,)], "id bigint"))[1]

    def crash(key):
        if key == "u2" and fetched.count(2) == 1:
            raise RuntimeError("killed")

    p = pipe(spark, tmp_path, [(f"u{i}", unit(i)) for i in range(1, 5)], after_write=crash)
    with pytest.raises(RuntimeError):
        ingest.run(spark, p)
    assert ingest.run(spark, p) == {"loaded": 3, "skipped": 1, "quarantined": 0}
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out" / "*")).collect()) == [1, 2, 3, 4]
    assert Store(str(tmp_path / "state" / "p.db")).metrics("p")["counts"] == {"done": 4}


def test_contract_and_drift(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (None, "y")], "id bigint, v string")
    assert gate.contract_breaches(df, {"id": ("int64", False), "w": ("string", True), "v": ("int64", True)}, extra=False) == ["missing: w", "type: v is string, not int64", "null: id has 1 nulls"]
    assert gate.contract_breaches(df, {"id": ("int64", True)}, extra=False) == ["unexpected: v"]
    p = pipe(spark, tmp_path, [("a", lambda s: df)], drift="block")
    ingest.run(spark, p)
    p2 = pipe(spark, tmp_path, [("b", lambda s: df.withColumnRenamed("v", "w"))], drift="block")
    with pytest.raises(DataError):
        ingest.run(spark, p2)
    assert "external_location = 's3://b/it''s'" in gate.external_table_ddl(df, "c.s.t", "s3://b/it's")
    with pytest.raises(SpecError):
        gate.external_table_ddl(spark.sql("SELECT array(1) AS a"), "t", "x")


def test_gate_counts_and_masks(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("a", 9.0), (None, None), (None, -1.0)], "k string, v double")
    got = gate.counts(df, [gate.Rule("k", "not_null"), gate.Rule("k", "unique"), gate.Rule("v", "max", 5), gate.Rule("v", "min", 0)]).first()
    assert list(got) == [2, 1, 1, 1]
    assert gate.split(df, [gate.Rule("k", "unique")])[1].count() == 2
    for bad in (gate.Rule("x", "not_null"), gate.Rule("k", "min", 0)):
        with pytest.raises(DataError):
            gate.counts(df, [bad])


def test_leases(tmp_path):
    now = [0.0]
    s = Store(str(tmp_path / "s.db"), lambda: now[0])
    fence = s.acquire("x", "a", 10)
    with pytest.raises(ConflictError):
        s.acquire("x", "b", 10)
    now[0] = 11
    assert s.acquire("x", "b", 10) == fence + 1
    with pytest.raises(ConflictError):
        s.assert_fence("x", "a", fence)
    assert unit_id("p", "s", "k") == unit_id("p", "s", "k") != unit_id("p", "sk", "")


def test_upsert_contract(spark):
    s = "a bigint, b bigint, v string, o bigint"
    old = spark.createDataFrame([(1, 1, "x", 0), (1, 2, "y", 0)], s)
    new = spark.createDataFrame([(1, 2, "z", 0), (1, 2, "w", 1), (2, 1, "n", 0)], s)
    out = keyed.upserted(old, new, ["a", "b"], "o")
    assert sorted((r.a, r.b, r.v) for r in out.collect()) == [(1, 1, "x"), (1, 2, "w"), (2, 1, "n")]
    again = keyed.upserted(out, new, ["a", "b"], "o")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, sequence bigint, op string, key struct<id: bigint>, payload struct<id: bigint, v: string>")


def test_change_events(spark):
    first = events(spark, [("e1", 1, "I", (1,), (1, "a")), ("e2", 2, "U", (1,), (1, "b")), ("e3", 3, "I", (2,), (2, "c"))])
    rows, ledger = keyed.applied(None, None, first, ["id"])
    assert sorted(map(tuple, rows.collect())) == [(1, "b"), (2, "c")]
    rows2, ledger2 = keyed.applied(rows, ledger, first, ["id"])
    assert sorted(map(tuple, rows2.collect())) == [(1, "b"), (2, "c")] and ledger2.count() == 3
    rows3, ledger3 = keyed.applied(rows2, ledger2, events(spark, [("e4", 4, "D", (1,), None), ("e5", 5, "D", (9,), None)]), ["id"])
    assert sorted(map(tuple, rows3.collect())) == [(2, "c")] and ledger3.count() == 5
    with pytest.raises(DataError):
        keyed.applied(rows3, ledger3, events(spark, [("e1", 1, "I", (1,), (1, "other"))]), ["id"])
    with pytest.raises(DataError):
        keyed.check_events(events(spark, [("e1", 1, "I", (1,), None), ("e1", 2, "X", (1,), None)]))


def test_outbound_changes(spark):
    ledger = spark.createDataFrame([], "key string, hash string, dead boolean")
    src = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    first = keyed.changes(src, ledger, "id")
    assert {r["action"] for r in first.collect()} == {"insert"}
    known = first.selectExpr("key", "hash", "key = '9' AS dead")
    now = spark.createDataFrame([(1, "a"), (3, "c"), (2, "z")], "id bigint, v string").filter("id <> 1")
    assert {(r["key"], r["action"]) for r in keyed.changes(now, known, "id", "mirror").collect()} == {("1", "delete"), ("2", "update"), ("3", "insert")}
    for bad in (src.union(src), src.union(spark.createDataFrame([(None, "x")], src.schema))):
        with pytest.raises(Exception, match="keys must"):
            keyed.changes(bad, ledger, "id").select("key", "action").collect()
    with pytest.raises(DataError):
        keyed.safe_to_send(first, 0, first_limit=1)
