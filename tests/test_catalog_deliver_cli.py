import json

import pytest

from tidewright import cli
from tidewright.errors import DataError
from tidewright.operators import deliver
from tidewright.operators.catalog import Catalog


def spec(tmp_path, file, **body):
    (tmp_path / "specs").mkdir(exist_ok=True)
    (tmp_path / "specs" / f"{file}.json").write_text(json.dumps(body))


def test_catalog(spark, tmp_path):
    spec(tmp_path, "a", name="a", input="s3://b/raw/*.parquet", output="s3://b/clean", steps=[{"filter": "x > 1"}])
    spec(tmp_path, "b", name="b", input="s3://b/clean", output="s3://b/out", steps=[], description="daily totals")
    spec(tmp_path, "c", source={"path": "in/*.csv"}, sink={"path": "s3://b/raw"})
    spec(tmp_path, "bad", what=1)
    cat = Catalog(str(tmp_path / "c.db"))
    assert cat.scan(str(tmp_path / "specs"))["specs"] == 3
    assert cat.scan(str(tmp_path / "specs"))["specs"] == 3
    assert ("s3://b/raw", "s3://b/clean") in cat.edges() and len(cat.edges()) == 3
    cat.tag("s3://b/clean", "gold", deprecated="use v2")
    assert cat.search("gold clean") == ["s3://b/clean"] and cat.search("totals") == ["s3://b/out"]
    assert any("deprecated" in w for w in cat.warnings())
    spec(tmp_path, "d", name="d", input="x", output="s3://b/out", steps=[])
    cat.scan(str(tmp_path / "specs"))
    assert any("2 writers" in w for w in cat.warnings())
    where = str(tmp_path / "t")
    spark.range(2).write.parquet(where)
    assert cat.observe(spark, where)["added"] == ["id"] and cat.observe(spark, where) is None
    assert cli.main(["lineage", "in", "--catalog", str(tmp_path / "c.db")]) == 0


def test_delivery(spark, tmp_path):
    ledger = deliver.Ledger(str(tmp_path / "l.db"))
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, v string")
    calls, slept = [], []

    def send(action, key, row, did):
        calls.append((action, key))
        if key == "2":
            return 422
        if key == "3" and calls.count((action, key)) == 1:
            return 503
        return 200

    assert deliver.deliver(spark, "d", src, "id", ledger, send, sleep=slept.append) == {"sent": 2, "failed": 1}
    assert slept == [0.5] and ("insert", "2") in calls
    calls.clear()
    assert deliver.deliver(spark, "d", src, "id", ledger, send) == {"sent": 0, "failed": 0}  # 2 is parked
    now = src.filter("id <> 1")
    assert deliver.deliver(spark, "d", now, "id", ledger, lambda *a: 404 if a[0] == "delete" else 200, mode="mirror") == {"sent": 1, "failed": 0}
    assert ledger.revive() == 1
    with pytest.raises(DataError):
        deliver.deliver(spark, "d", src, "id", ledger, lambda *a: 403)
    assert deliver.dispatch_id("a", "b", "c") != deliver.dispatch_id("a", "bc", "")


def test_cli(spark, tmp_path, capsys):
    spark.createDataFrame([(1, 2), (3, 4)], "id bigint, v bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    (tmp_path / "s.json").write_text(json.dumps({"name": "n", "input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "steps": [{"filter": "id > 1"}]}))
    assert cli.main(["compile", str(tmp_path / "s.json")]) == 0
    assert cli.main(["run", str(tmp_path / "s.json"), "--state", str(tmp_path / "st.db")]) == 0
    assert cli.main(["query", f"SELECT v FROM '{tmp_path}/out/v-*'", "--format", "jsonl"]) == 0
    assert '{"v": 4}' in capsys.readouterr().out
    (tmp_path / "bad.json").write_text("{}")
    assert cli.main(["compile", str(tmp_path / "bad.json")]) == 2
