"""Sources users bring: a class by name, any iterable of records, and a polled endpoint for streams."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.errors import DataError, SpecError
from tidewright.sources.paged import at_path, batches


def load(name: str, **options):
    """An object of ``module:Class`` with ``units()`` and ``fetch(spark, unit)``."""
    module, _, attribute = name.partition(":")
    try:
        made = getattr(importlib.import_module(module), attribute)(**options)
    except (ImportError, AttributeError, ValueError) as e:
        raise SpecError(f"source {name} cannot be loaded") from e
    if not callable(getattr(made, "units", None)) or not callable(getattr(made, "fetch", None)):
        raise SpecError(f"source {name} has no units() and fetch()")
    return made


def units_of(source) -> Iterator[tuple[str, Callable]]:
    """The units of a loaded source as an ingestion run takes them."""
    for unit in source.units():
        key = unit if isinstance(unit, str) else unit[0]
        yield key, lambda spark, u=unit: source.fetch(spark, u)


def frame(spark: SparkSession, records: list[dict], schema: str | None = None) -> DataFrame | None:
    """Records of a page as a DataFrame; types come from the records unless given."""
    if not records:
        return None
    lines = spark.createDataFrame([(json.dumps(r, default=str),) for r in records], "value string")
    kind = schema or spark.range(1).select(F.schema_of_json(F.lit(json.dumps(_merged(records), default=str)))).first()[0]
    return lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _merged(records: list[dict]) -> dict:
    """One record with a value for every field that any record has."""
    out: dict = {}
    for r in records:
        for k, v in r.items():
            if v is not None and (out.get(k) is None or isinstance(v, float) or isinstance(out.get(k), int) and isinstance(v, str)):
                out[k] = v
            out.setdefault(k, None)
    return out


def iterable_units(records: Callable[[], Iterable[dict]], size: int, schema: str | None = None) -> Iterator[tuple[str, Callable]]:
    for key, part, _ in batches(records(), size):
        yield key, lambda spark, p=part: frame(spark, p, schema)


class Polled:
    """A stream over one cursor page a poll. Each record needs a stable id; ``on_null`` says what a missing cursor means:
    ``end`` of the stream, or go on from the last event's id."""

    def __init__(self, transport: Callable, record_path: str, cursor_path: str, event_id: str, on_null: str = "end", max_records: int = 10_000, max_bytes: int = 64 << 20, schema: str | None = None):
        if on_null not in ("end", "last_event_id"):
            raise SpecError(f"unknown on_null {on_null}")
        self.__dict__.update(transport=transport, record_path=record_path, cursor_path=cursor_path, event_id=event_id, on_null=on_null, max_records=max_records, max_bytes=max_bytes, schema=schema)

    def __call__(self, spark: SparkSession, position: dict | None):
        from tidewright.streaming.runner import Batch

        cursor = (position or {}).get("cursor")
        body, _ = self.transport({} if cursor is None else {"cursor": cursor})
        records = at_path(body, self.record_path)
        if not isinstance(records, list):
            raise DataError(f"no list of records at {self.record_path}")
        if len(records) > self.max_records or len(json.dumps(records, default=str)) > self.max_bytes:
            raise DataError("the page is larger than allowed")
        ids = [at_path(r, self.event_id) for r in records]
        if None in ids or len(set(map(str, ids))) != len(ids):
            raise DataError(f"{self.event_id} must be there and unique")
        nxt = at_path(body, self.cursor_path)
        end = nxt is None or nxt == ""
        if end and self.on_null == "last_event_id":
            if not records:
                return None
            nxt, end = ids[-1], False
        rows = frame(spark, records, self.schema)
        if rows is None:
            return None if not end else Batch(spark.createDataFrame([], self.schema or f"{self.event_id} string"), {"cursor": nxt}, True)
        return Batch(rows, {"cursor": nxt}, end)


def outbox_poll(read: Callable[[SparkSession], DataFrame], limit: int, sequence: str = "sequence"):
    """Polls an outbox table by its sequence; order and envelope are checked."""
    from tidewright.operators.keyed import check_events
    from tidewright.sources.database import outbox
    from tidewright.streaming.runner import Batch

    def poll(spark: SparkSession, position: dict | None):
        after = (position or {}).get(sequence, -1)
        page = outbox(read(spark), after, limit, sequence).persist()
        last = page.agg({sequence: "max"}).first()[0]
        if last is None:
            return None
        if {"event_id", "op"} <= set(page.columns):
            check_events(page)
        return Batch(page, {sequence: last})

    return poll


class Authorised:
    """A transport with a token: fixed, or fetched by client credentials and fetched once more after a 401."""

    def __init__(self, send: Callable, token: str | None = None, fetch_token: Callable[[], str] | None = None):
        self.send, self.token, self.fetch_token = send, token, fetch_token

    def __call__(self, params: dict):
        for again in (True, False):
            if self.token is None and self.fetch_token:
                self.token = self.fetch_token()
            status, body, headers = self.send(params, {"Authorization": f"Bearer {self.token}"} if self.token else {})
            if status == 401 and again and self.fetch_token:
                self.token = None
                continue
            if status >= 400:
                raise ConnectionError(f"status {status}") if status >= 500 or status == 429 else DataError(f"status {status}")
            return body, headers
        raise AssertionError
