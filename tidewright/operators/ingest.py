"""Resumable ingestion: units in, checked, written, and only then marked done."""

from __future__ import annotations

import contextlib
import json
import os
import random
import shutil
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidewright.errors import DataError
from tidewright.operators import gate, publish
from tidewright.operators.state import Store, unit_id
from tidewright.sources.fs import Files


@dataclass
class Pipeline:
    """``units`` yields (key, fetch) or (key, fetch, next cursor); ``fetch(spark)`` gives a DataFrame or None."""

    name: str
    source: str
    units: Callable[[object], Iterable[tuple]]
    output: str
    state: str
    rules: list[gate.Rule] = field(default_factory=list)
    policy: str = "quarantine"
    contract: dict | None = None
    extra_columns: bool = True
    drift: str = "allow"
    sink: Callable[[DataFrame, str], None] | None = None
    after_write: Callable[[str], None] = lambda _: None


def retried(action: Callable, attempts: int = 5, first: float = 0.1, most: float = 60.0, retry=(ConnectionError, TimeoutError, OSError), sleep=time.sleep, jitter=random.random):
    """Exponential waits with jitter; the last error is raised."""
    for k in range(attempts):
        try:
            return action()
        except retry:
            if k + 1 == attempts:
                raise
            sleep(min(most, first * 2**k) * (0.5 + jitter() / 2))
    raise AssertionError


def set_aside(df: DataFrame, pipe: Pipeline, unit: str, reason: dict) -> None:
    where = os.path.join(pipe.state, "dlq", pipe.name)
    publish.write_unit(df, where, unit)
    with open(os.path.join(where, f"{unit}.json"), "w", encoding="utf-8") as f:
        json.dump(reason, f)


def retry_set_aside(spark: SparkSession, pipe: Pipeline, fix: Callable[[DataFrame], DataFrame] = lambda df: df, holder: str = "retry") -> dict:
    """Tries the units that were set aside again, after ``fix``, under the pipeline's lease. Rows that keep all rules are written
    under the unit's own retry name, and only then the unit leaves the folder; a run that stops in between writes the same name
    again. The ledger then has the rows of the unit and of its retry."""
    where, done = os.path.join(pipe.state, "dlq", pipe.name), {"loaded": 0, "kept": 0}
    store = Store(os.path.join(pipe.state, f"{pipe.name}.db"))
    store.acquire(pipe.name, holder)
    try:
        for name in sorted(os.listdir(where)) if os.path.isdir(where) else []:
            if not name.startswith("unit_"):
                continue
            uid = name.removeprefix("unit_")
            df = fix(spark.read.parquet(os.path.join(where, name)))
            broken = bool(pipe.rules) and any(gate.counts(df, pipe.rules).first().asDict().values())
            if broken or (pipe.contract and gate.contract_breaches(df, pipe.contract, pipe.extra_columns)):
                done["kept"] += 1
                continue
            rows = df.count()
            _sink(pipe)(df, f"{uid}-retry")
            pipe.after_write(uid)
            # what the unit had before its first retry, so that a retry that is done again does not count twice
            base = int(store.meta(f"retried:{uid}") or store.loaded(uid))
            store.meta(f"retried:{uid}", str(base))
            store.finish(uid, "done", base + rows)
            shutil.rmtree(os.path.join(where, name))
            with contextlib.suppress(FileNotFoundError):
                os.unlink(os.path.join(where, f"{uid}.json"))
            done["loaded"] += 1
            store.acquire(pipe.name, holder)
    finally:
        store.release(pipe.name, holder)
    return done


def run(spark: SparkSession, pipe: Pipeline, holder: str = "driver") -> dict:
    os.makedirs(pipe.state, exist_ok=True)
    store = Store(os.path.join(pipe.state, f"{pipe.name}.db"))
    store.acquire(pipe.name, holder)
    store.edge(pipe.name, pipe.source, pipe.output)
    done = {"loaded": 0, "skipped": 0, "quarantined": 0}
    checked_drift = False
    try:
        for unit in pipe.units(store.cursor(pipe.name)):
            key, fetch, cursor = (*unit, None)[:3] if len(unit) == 2 else unit
            uid = unit_id(pipe.name, pipe.source, key)
            moved = (pipe.name, cursor) if cursor is not None else None
            if not store.begin(uid, pipe.name, key):
                done["skipped"] += 1
                continue
            began = time.monotonic()
            try:
                df = retried(lambda: fetch(spark))  # noqa: B023
                rows = 0
                if df is not None:
                    if not checked_drift:
                        checked_drift = _drift(store, pipe, df)
                    if pipe.contract and (found := gate.contract_breaches(df, pipe.contract, pipe.extra_columns)):
                        _by_policy(pipe, df, uid, found, {})
                    rows = _load(pipe, df, uid)
                pipe.after_write(key)
                store.finish(uid, "done", rows, ms=int(1000 * (time.monotonic() - began)), cursor=moved)
                done["loaded"] += 1
            except Quarantined as e:
                store.finish(uid, "quarantined", error=str(e), cursor=moved)
                done["quarantined"] += 1
            except Exception as e:
                store.finish(uid, "failed", error=str(e)[:500])
                raise
            store.acquire(pipe.name, holder)
    finally:
        store.release(pipe.name, holder)
    return done


class Quarantined(DataError):
    """The unit is set aside; the run goes on."""


def _by_policy(pipe: Pipeline, df: DataFrame, uid: str, found, reason: dict) -> None:
    if pipe.policy == "warn":
        return
    if pipe.policy in ("quarantine", "split"):
        set_aside(df, pipe, uid, reason or {"contract": found})
        raise Quarantined(str(found))
    raise DataError(str(found))


def _load(pipe: Pipeline, df: DataFrame, uid: str) -> int | None:
    """Writes a unit by its rules; its rows, or None if it was set aside. With the sink of its own, a unit is written once, aside,
    and counted as it is written; then it is moved to its place, or to those set aside. Only unique values, a unit that is split,
    and a user's sink need the rows a second time."""
    once = all(r.kind != "unique" for r in pipe.rules)
    if pipe.sink is None and once:
        watched, told = gate.watched(df, pipe.rules)
        files, tmp = Files(pipe.output, df.sparkSession), f"{pipe.output}/_tmp-{uuid.uuid4().hex}"
        files.make(pipe.output)
        watched.write.option("compression", "zstd").parquet(tmp)
        rows, found = told()
        found = {k: v for k, v in found.items() if v}
        try:
            if not found or pipe.policy == "warn":
                if rows:
                    publish.put_unit(files, tmp, pipe.output, uid)
                return rows
            df = df.sparkSession.read.schema(df.schema).parquet(tmp)
            return _split(pipe, df, uid, found) if pipe.policy == "split" else _by_policy(pipe, df, uid, found, {"rules": found})
        finally:
            files.remove(tmp)
    df = df.persist()
    try:
        found = {k: v for k, v in gate.counts(df, pipe.rules).first().asDict().items() if v} if pipe.rules else {}
        if found and pipe.policy == "split":
            return _split(pipe, df, uid, found)
        if found and pipe.policy != "warn":
            return _by_policy(pipe, df, uid, found, {"rules": found})
        rows = df.count()
        if rows:
            _sink(pipe)(df, uid)
        return rows
    finally:
        df.unpersist()


def _sink(pipe: Pipeline) -> Callable[[DataFrame, str], object]:
    return pipe.sink or (lambda d, u: publish.write_unit(d, pipe.output, u))


def _split(pipe: Pipeline, df: DataFrame, uid: str, found: dict) -> int:
    good, bad = gate.split(df, pipe.rules)
    set_aside(bad, pipe, uid, {"rules": found})
    rows = good.count()
    if rows:
        _sink(pipe)(good, uid)
    return rows


def _drift(store: Store, pipe: Pipeline, df: DataFrame) -> bool:
    """Once a run, on its first batch with rows."""
    if df.isEmpty():
        return False
    now = gate.schema_of(df)
    last = store.schema(pipe.name)
    if last is not None and pipe.drift == "block" and any(gate.drift(last, now).values()):
        raise DataError(f"the schema changed: {gate.drift(last, now)}")
    store.schema(pipe.name, now)
    return True
