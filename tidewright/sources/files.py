"""File sources: one file is one unit of work, keyed by its path below the fixed part of the glob."""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.errors import DataError, SpecError

#: Column types a CSV may pin (fixed values), as Spark types.
PINNED = {"string": "string", "int64": "bigint", "float64": "double", "bool": "boolean", "date": "date", "timestamp": "timestamp_ntz"}


def units(pattern: str, detect_changes: bool = False) -> Iterator[tuple[str, str]]:
    """(key, path) of all files, sorted. With ``detect_changes`` the key carries a digest of the content."""
    root = pattern
    while any(c in root for c in "*?["):
        root = os.path.dirname(root)
    root = root if os.path.isdir(root) else os.path.dirname(root)
    for path in sorted(glob.glob(pattern, recursive=True)):
        if os.path.isfile(path):
            key = os.path.relpath(path, root)
            if detect_changes:
                digest = hashlib.sha256()
                with open(path, "rb") as f:
                    for part in iter(lambda: f.read(1 << 20), b""):
                        digest.update(part)
                key += f"@{digest.hexdigest()[:16]}"
            yield key, path


def read_csv(spark: SparkSession, path: str, column_types: dict | None = None, null_values=("",), encoding: str = "utf-8", delimiter: str = ",") -> DataFrame:
    """All columns are read as text; a type is kept only if every value fits it. Numbers with leading zeros stay text."""
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding=encoding, sep=delimiter, mode="FAILFAST", multiLine=True, escape='"', nullValue="\x00", emptyValue="")
    text = raw.select(*[F.when(F.coalesce(F.col(f"`{c}`"), F.lit("")).isin(*null_values), None).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    pinned = column_types or {}
    if missing := set(pinned) - set(text.columns):
        raise DataError(f"columns {sorted(missing)} are not in {path}")
    if unknown := [t for t in pinned.values() if t not in PINNED]:
        raise SpecError(f"unknown column types {unknown}")
    free = [c for c in text.columns if c not in pinned]
    checks = {"bigint": r"^-?\d{1,18}$", "double": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", "boolean": r"^(?i)(true|false)$", "date": r"^\d{4}-\d{2}-\d{2}$", "timestamp_ntz": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?$"}
    asked = []
    for i, c in enumerate(free):
        col = F.col(f"`{c}`")
        asked += [F.max(F.when(col.isNotNull(), 1)).alias(f"s{i}"), F.max(F.when(col.rlike(r"^-?0\d+$"), 1)).alias(f"z{i}")]
        asked += [F.coalesce(F.bool_and(F.when(col.isNotNull(), col.rlike(p) & col.try_cast(t).isNotNull())), F.lit(True)).alias(f"{t}{i}") for t, p in checks.items()]
    got = text.agg(*asked).first() if asked else None
    types = {c: PINNED[t] for c, t in pinned.items()}
    for i, c in enumerate(free):
        types[c] = "string" if not got[f"s{i}"] or got[f"z{i}"] else next((t for t in checks if got[f"{t}{i}"]), "string")
    return text.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in text.columns])


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; a line that is none stops the read."""
    return spark.read.json(path, mode="FAILFAST")


def read_excel(*_):
    raise SpecError("Excel files cannot be read here: no reader is installed; save them as CSV")


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    low = path.lower()
    if low.endswith((".jsonl", ".ndjson")):
        return read_jsonl(spark, path)
    if low.endswith((".xlsx", ".xls")):
        return read_excel()
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path, **options)
