"""Users' sources as a format of Spark's own readers: ``spark.read.format("tidewright")`` and ``spark.readStream``.

``source`` names a class as ``module:Class``; all other options are passed to it as keywords. Its objects go to executors, so
they are small and can be pickled. For batches it has ``units()``, a list of small values, each of which becomes a partition, and
``records(unit)``, which an executor calls for dicts or tuples. For streams it has ``first()`` and ``latest()``, offsets as dicts of
plain values, and ``between(start, end)``, the units of that range: the same for the same range, whenever it is asked. Offsets are
kept in the checkpoint by the engine, so a restart neither repeats nor skips a range. ``done(end)``, if there is one, is told what
was committed."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidewright.errors import SpecError

NAME = "tidewright"


def _made(options: dict, *needs: str):
    options = dict(options)
    where = options.pop("source", "")
    options.pop("path", None)
    module, _, name = where.partition(":")
    try:
        made = getattr(importlib.import_module(module), name)(**options)
    except (ImportError, AttributeError, ValueError, TypeError) as e:
        raise SpecError(f"source {where!r} cannot be loaded: {e}") from e
    if missing := [n for n in needs if not callable(getattr(made, n, None))]:
        raise SpecError(f"source {where!r} has no {', '.join(missing)}")
    return made


def _rows(source, unit, schema: StructType) -> Iterator[tuple]:
    names = schema.fieldNames()
    for r in source.records(unit):
        yield tuple(r.get(n) for n in names) if isinstance(r, dict) else tuple(r)


class _Batch(DataSourceReader):
    def __init__(self, source, schema: StructType):
        self.source, self.kind = source, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.source.units()]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        # a source without units still has one partition, without a value
        return _rows(self.source, partition.value, self.kind) if partition is not None else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, source, schema: StructType):
        self.source, self.kind = source, schema

    def initialOffset(self) -> dict:
        return self.source.first()

    def latestOffset(self) -> dict:
        return self.source.latest()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(u) for u in self.source.between(start, end)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(self.source, partition.value, self.kind)

    def commit(self, end: dict) -> None:
        if callable(getattr(self.source, "done", None)):
            self.source.done(end)


class TidewrightSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        made = _made(self.options)
        if not getattr(made, "schema", None):
            raise SpecError("say .schema(...), or give the source a schema")
        return made.schema() if callable(made.schema) else made.schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(_made(self.options, "units", "records"), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(_made(self.options, "first", "latest", "between", "records"), schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(TidewrightSource)
