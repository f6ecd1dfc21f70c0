"""Micro-batches: poll, identify, check, write under the batch's own name, commit ledger and checkpoint under a fence."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.errors import DataError, SpecError
from tidewright.operators import gate, publish
from tidewright.operators.state import Store
from tidewright.plans.ir import canonical_hash
from tidewright.sources.fs import Files
from tidewright.streaming import watermark as wm

EXHAUSTED = "_exhausted"


@dataclass
class Batch:
    rows: DataFrame
    end: dict
    exhausted: bool = False


@dataclass
class Stream:
    """``poll(spark, position)`` gives the next Batch or None."""

    name: str
    poll: Callable[[SparkSession, dict | None], Batch | None]
    output: str
    state: str
    key: str | None = None
    event_time: str | None = None
    zoneless_is_utc: bool = False
    allowed_lateness: timedelta = timedelta(0)
    on_late: str = "quarantine"
    rules: list[gate.Rule] = field(default_factory=list)
    on_violation: str = "quarantine"
    revision: str = "1"
    sink: Callable[[DataFrame, str], None] | None = None
    after_write: Callable[[str], None] = lambda _: None


def content_of(df: DataFrame, *more) -> tuple[str, int, list]:
    """A hash of all rows as a bag (order and partitioning do not matter), their number, and what else is asked of them, in one pass.
    Columns are hashed as they are typed, nulls told from what stands beside them; maps go by their JSON form."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns) if c != wm.EVENT_TIME]
    parts = [F.to_json(c) if "map<" in df.select(c).schema[0].dataType.simpleString() else c for c in columns]
    row = F.xxhash64(*[x for c in parts for x in (c, c.isNull())]) if parts else F.lit(0)
    n, total, mixed, *rest = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row), *more).first()
    return canonical_hash([str(x) for x in (n, total, mixed)]), n, rest


def batch_id(stream: Stream, start, end, content: str, generation: int) -> str:
    body = {"stream": stream.name, "revision": stream.revision, "start": start, "end": end, "content": content}
    return canonical_hash(body | ({"generation": generation} if generation else {}))[:32]


def run(spark: SparkSession, stream: Stream, holder: str = "driver", max_batches: int | None = None, stop: Callable[[], bool] = lambda: False) -> dict:
    os.makedirs(stream.state, exist_ok=True)
    store = Store(os.path.join(stream.state, f"{stream.name}.db"))
    done = {"batches": 0, "rows": 0, "late": 0, "skipped": 0}
    fence = store.acquire(stream.name, holder)
    try:
        while not stop() and (max_batches is None or done["batches"] < max_batches):
            at = store.checkpoint(stream.name)
            if (at["position"] or {}).get(EXHAUSTED):
                break
            fence = store.acquire(stream.name, holder)
            batch = stream.poll(spark, at["position"])
            if batch is None:
                break
            rows = batch.rows.persist()
            bid = None
            try:
                end = batch.end | ({EXHAUSTED: True} if batch.exhausted else {})
                content, n, good, late, mark, n_late = _timed(stream, rows, at["watermark"])
                bid = batch_id(stream, at["position"], end, content, at["generation"])
                if not store.plan_batch(bid, stream.name):
                    done["skipped"] += 1
                    break
                good, n = _ruled(stream, good, bid, n)
                if n:
                    (stream.sink or (lambda d, b: publish.write_unit(d, stream.output, b)))(good, bid)
                if n_late and stream.on_late == "quarantine":
                    publish.write_unit(late, os.path.join(stream.state, "late", stream.name), bid)
                stream.after_write(bid)
                store.commit_batch(bid, stream.name, end, mark, n, n_late, (stream.name, holder, fence))
                done = {"batches": done["batches"] + 1, "rows": done["rows"] + n, "late": done["late"] + n_late, "skipped": done["skipped"]}
            except Exception as e:
                if bid:
                    store.fail_batch(bid, str(e)[:500])
                raise
            finally:
                rows.unpersist()
    finally:
        store.release(stream.name, holder)
    return done


def _timed(stream: Stream, rows: DataFrame, mark: float | None) -> tuple:
    """Content, number of rows to load, those rows, late rows, the watermark after the batch, and the number of late rows; one
    pass over the batch."""
    if not stream.event_time:
        content, n, _ = content_of(rows)
        return content, n, rows, None, mark, 0
    timed = wm.with_event_time(rows, stream.event_time, stream.zoneless_is_utc)
    before = None if mark is None else datetime.fromtimestamp(mark, timezone.utc)
    at = F.col(f"`{wm.EVENT_TIME}`")
    is_late = F.lit(False) if before is None else F.coalesce(at < F.lit(before), F.lit(False))
    content, n, (top, n_late) = content_of(timed, F.max(at.cast("double")), F.count_if(is_late))
    _, late = wm.parted(timed, before, "drop")
    good, _ = wm.parted(timed, before, stream.on_late)
    after = mark if top is None else max(top - stream.allowed_lateness.total_seconds(), mark if mark is not None else float("-inf"))
    return content, n if stream.on_late == "append" else n - n_late, good.drop(wm.EVENT_TIME), late.drop(wm.EVENT_TIME), after, n_late


def _ruled(stream: Stream, rows: DataFrame, bid: str, n: int) -> tuple[DataFrame, int]:
    """The rows of ``n`` that may be loaded, and their number."""
    if not stream.rules:
        return rows, n
    found = {k: v for k, v in gate.counts(rows, stream.rules).first().asDict().items() if v}
    if not found or stream.on_violation == "warn":
        return rows, n
    aside = os.path.join(stream.state, "dlq", stream.name)
    if stream.on_violation == "split":
        good, bad = gate.split(rows, stream.rules)
        publish.write_unit(bad, aside, bid)
        return good, good.count()
    if stream.on_violation == "quarantine":
        publish.write_unit(rows, aside, bid)
    raise DataError(f"batch breaks rules: {found}")


def table_cursor(*_):
    raise SpecError("a table read by a cursor cannot show deletes; read its outbox instead")


def structured(df: DataFrame, stream: Stream, checkpoint: str, **trigger):
    """The same rules for late rows, checks, sinks and hooks under Structured Streaming: ``foreachBatch`` under the engine's own
    offsets. Units and watermarks bear the name of the stream, its revision and the engine's id of the query, which lies in the
    checkpoint: a restart writes the same names, and a query with another checkpoint never takes the place of what this one wrote.
    The watermark before each epoch is kept until the next one is through, so an epoch that runs again has the same late rows."""
    files = Files(checkpoint, df.sparkSession)

    def write(rows: DataFrame, epoch: int) -> None:
        query = json.loads(files.read(f"{checkpoint}/metadata"))["id"]
        identity = canonical_hash({"stream": stream.name, "revision": stream.revision, "query": query})[:16]
        bid, key = f"{identity}-{epoch:012d}", f"watermark:{identity}"
        store = Store(os.path.join(stream.state, f"{stream.name}.db"))
        rows = rows.persist()
        try:
            marks = json.loads(store.meta(key) or "{}")
            _, n, good, late, after, n_late = _timed(stream, rows, marks.get(str(epoch)))
            good, _ = _ruled(stream, good, bid, n)
            (stream.sink or (lambda d, b: publish.write_unit(d, stream.output, b)))(good, bid)
            if n_late and stream.on_late == "quarantine":
                publish.write_unit(late, os.path.join(stream.state, "late", stream.name), bid)
            stream.after_write(bid)
            store.meta(key, json.dumps({str(epoch): marks.get(str(epoch)), str(epoch + 1): after}))
        finally:
            rows.unpersist()
            store.con.close()

    os.makedirs(stream.state, exist_ok=True)
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
