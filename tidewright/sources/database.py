"""Tables by key range: half-open chunks of an integer key are units, so a table that grows only adds units."""

from __future__ import annotations

import os
import re
import sqlite3
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tidewright.errors import DataError, SpecError
from tidewright.operators.maintain import redacted

_IDENT = re.compile(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)?$")


def identifier(name: str) -> str:
    if not _IDENT.match(name):
        raise SpecError(f"not an identifier: {name!r}")
    return ".".join(f'"{p}"' for p in name.split("."))


def chunks(low: int | None, high: int | None, size: int) -> Iterator[tuple[str, int, int]]:
    """(unit key, from, to). The last chunk ends right behind the largest key, so it reopens when rows are added."""
    if low is None or high is None:
        return
    at = low
    while at <= high:
        end = min(at + size, high + 1)
        yield f"key={at}..{end}", at, end
        at += size


class SqliteTable:
    def __init__(self, path: str, table: str, key: str, size: int = 100_000):
        self.path, self.table, self.key, self.size = path, identifier(table), identifier(key), size

    def units(self) -> Iterator[tuple[str, int, int]]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f"SELECT min({self.key}), max({self.key}) FROM {self.table}").fetchone()
        yield from chunks(low, high, self.size)

    def fetch(self, spark: SparkSession, unit: tuple[str, int, int]) -> DataFrame:
        import pandas as pd

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            rows = pd.read_sql_query(f"SELECT * FROM {self.table} WHERE {self.key} >= ? AND {self.key} < ? ORDER BY {self.key}", con, params=unit[1:])
        return spark.createDataFrame(rows)


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """The same ranges as one distributed read, where a JDBC driver is on the class path."""
    identifier(table)
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high + 1, numPartitions=parts, properties=options)


class JdbcTable:
    """A table behind a JDBC driver by key range. The address with its secrets is read from an environment variable when it is
    needed, and stays out of specs, state and errors. A unit is one distributed read of ``parts`` ranges."""

    def __init__(self, spark: SparkSession, dsn_env: str, table: str, key: str, size: int = 1_000_000, parts: int = 8, **options: str):
        self.spark, self.dsn_env, self.options = spark, dsn_env, options
        self.table, self.key, self.size, self.parts = identifier(table), identifier(key), size, parts

    def _url(self) -> str:
        url = os.environ.get(self.dsn_env, "")
        if not url.startswith("jdbc:"):
            raise SpecError(f"{self.dsn_env} holds no jdbc: address")
        return url

    def _read(self, action):
        try:
            return action()
        except (PySparkException, Py4JJavaError) as e:
            raise DataError(redacted(str(e).replace(self._url(), f"${{{self.dsn_env}}}"))[:500]) from None

    def units(self) -> Iterator[tuple[str, int, int]]:
        ends = f"(SELECT min({self.key}) AS low_key, max({self.key}) AS high_key FROM {self.table}) q"
        low, high = self._read(lambda: self.spark.read.jdbc(self._url(), ends, properties=self.options).first())
        yield from chunks(None if low is None else int(low), None if high is None else int(high), self.size)

    def fetch(self, spark: SparkSession, unit: tuple[str, int, int]) -> DataFrame:
        _, low, high = unit
        step = max(1, -(-(high - low) // self.parts))
        ranges = [f"{self.key} >= {a} AND {self.key} < {min(a + step, high)}" for a in range(low, high, step)]
        return self._read(lambda: spark.read.jdbc(self._url(), self.table, predicates=ranges, properties=self.options))


def outbox(rows: DataFrame, after: int, limit: int, sequence: str = "sequence") -> DataFrame:
    """The next page of an outbox table: the first ``limit`` rows behind ``after``, in order."""
    return rows.filter(rows[sequence] > after).orderBy(sequence).limit(limit)
