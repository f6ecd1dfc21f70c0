"""Running a transform: full, by unit, or by key."""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewright.operators import keyed, keyed_table, publish
from tidewright.operators.state import Store, unit_id
from tidewright.plans.compile import build
from tidewright.plans.ir import Plan
from tidewright.sources.fs import Files
from tidewright.sources.union import parquet_status, read_parquet, union_by_name

#: Units moved, or written by jobs of their own, at once.
UNITS_AT_ONCE = 8
#: Files whose units' names are broadcast; more are joined by a shuffle.
BROADCAST_FILES = 100_000


def inputs(spark: SparkSession, plan: Plan) -> dict[str, str]:
    """Input files with size and time; what lies under the output is never input."""
    there = Files(plan.output, spark)
    out = there.fs.makeQualified(there._at(plan.output)).toString()
    found = {}
    files = Files(plan.input, spark)
    for f, mark in parquet_status(spark, plan.input):
        whole = files.fs.makeQualified(files._at(f)).toString()
        if not whole.startswith(out.rstrip("/") + "/"):
            local = files.plain(whole)
            found[local if files.local else whole] = f"{mark}:{os.stat(local).st_mtime_ns}" if files.local else mark
    return found


def _by_unit(spark: SparkSession, plan: Plan, pending: list[str]) -> None:
    """One part for each input file, named by the file: a run that stops half-way repeats no row. All files are one job, which
    deals rows by their file into folders that are then moved to the units' places; a file without rows left has no folder.
    Steps that are a statement over all rows of a file take a job for each."""
    unit = lambda f: unit_id(plan.name, plan.input, f)
    files = Files(plan.output, spark)
    files.make(plan.output)
    if any(s.kind == "sql" for s in plan.steps):
        write = lambda f: publish.write_unit(build(read_parquet(spark, plan.input, [f]), plan), plan.output, unit(f))
        with ThreadPoolExecutor(UNITS_AT_ONCE) as pool:
            list(pool.map(write, pending))
        return
    token = uuid.uuid4().hex[:12]
    at, tag, tmp = f"at_{token}", f"unit_{token}", f"{plan.output}/_tmp-{token}"
    names = spark.createDataFrame([(files.plain(f), unit(f)) for f in pending], f"path_{token} string, {tag} string")
    names = F.broadcast(names) if len(pending) <= BROADCAST_FILES else names
    rows = build(read_parquet(spark, plan.input, pending, at), plan, (at,))
    rows = rows.join(names, F.col(at) == F.col(f"path_{token}")).drop(at, f"path_{token}")
    rows.write.partitionBy(tag).option("compression", "zstd").parquet(tmp)
    found = [d for d in files.names(tmp) if d.startswith(f"{tag}=")]
    with ThreadPoolExecutor(UNITS_AT_ONCE) as pool:
        list(pool.map(lambda d: publish.put_unit(files, f"{tmp}/{d}", plan.output, d.removeprefix(f"{tag}=")), found))
    files.remove(tmp)


def run(spark: SparkSession, plan: Plan, store: Store | None = None) -> dict:
    files = inputs(spark, plan)
    if plan.incremental is None:
        publish.publish(build(read_parquet(spark, plan.input, sorted(files)), plan), plan.output)
        return {"mode": "full", "files": len(files)}
    known = dict(store.con.execute("SELECT path, signature FROM inputs WHERE plan=?", (plan.name,)).fetchall())
    mode, key = plan.incremental
    files_out = Files(plan.output, spark)
    there = publish.current(plan.output, spark) is not None if mode == "by_key" else any(d.startswith("unit_") for d in files_out.names(plan.output))
    fresh = store.meta(f"plan:{plan.name}") != plan.hash or (known and not there) or any(files.get(p) != s for p, s in known.items())
    pending = sorted(files) if fresh else sorted(p for p in files if p not in known)
    if fresh:
        store.con.execute("DELETE FROM inputs WHERE plan=?", (plan.name,))
        if mode == "by_unit":
            files_out.remove(plan.output)
    if pending and mode == "by_unit":
        _by_unit(spark, plan, pending)
    elif pending:
        new = build(read_parquet(spark, plan.input, pending), plan)
        if fresh:
            publish.publish(keyed.settled(new, list(key)), plan.output)
        else:
            keyed_table.upsert(new, plan.output, list(key))
    with store.transaction() as con:
        con.executemany("INSERT OR REPLACE INTO inputs VALUES(?,?,?)", [(plan.name, p, files[p]) for p in pending])
    store.meta(f"plan:{plan.name}", plan.hash)
    return {"mode": mode, "reset": bool(fresh), "files": len(pending)}


def output(spark: SparkSession, plan: Plan):
    """The published rows."""
    if publish.current(plan.output, spark) is not None:
        return publish.read(spark, plan.output)
    parts = [f"{plan.output}/{d}" for d in Files(plan.output, spark).names(plan.output) if d.startswith("unit_")]
    return union_by_name([spark.read.parquet(p) for p in parts])
