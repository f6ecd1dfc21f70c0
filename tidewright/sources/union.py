"""Parquet directories whose files differ in schema: columns by name, types widened, missing ones null."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.errors import DataError

_ORDER = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def widest(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type both fit."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    kinds = {type(a), type(b)}
    if kinds <= set(_ORDER):
        return max(a, b, key=lambda t: _ORDER.index(type(t)))
    if kinds <= {*_ORDER, T.FloatType, T.DoubleType}:
        return T.DoubleType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    if kinds <= {T.DateType, T.TimestampNTZType, T.TimestampType}:
        return T.TimestampType() if T.TimestampType in kinds else T.TimestampNTZType()
    if any(isinstance(x, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) for x in (a, b)):
        raise DataError(f"no common type for {a.simpleString()} and {b.simpleString()}")
    return T.StringType()


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns in the order first seen, matched without case, the first spelling kept."""
    names: dict[str, str] = {}
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema:
            low = f.name.lower()
            names.setdefault(low, f.name)
            kinds[low] = widest(kinds[low], f.dataType) if low in kinds else f.dataType
    out = None
    for df in frames:
        have = {c.lower(): c for c in df.columns}
        part = df.select(*[(F.col(f"`{have[k]}`") if k in have else F.lit(None)).cast(kinds[k] if not isinstance(kinds[k], T.NullType) else "string").alias(n) for k, n in names.items()])
        out = part if out is None else out.unionByName(part)
    return out


def parquet_files(spark: SparkSession, path: str) -> list[str]:
    """All Parquet files below a path, by Spark's own file systems."""
    return [f for f, _ in parquet_status(spark, path)]


def parquet_status(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The files with a signature of their size and time."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise DataError(f"{path} does not exist")
    mark = lambda s: f"{s.getLen()}:{s.getModificationTime()}"
    top = fs.getFileStatus(where)
    if top.isFile():
        return [(path, mark(top))]
    found, it = [], fs.listFiles(where, True)
    root = top.getPath().toString()
    while it.hasNext():
        status = it.next()
        p = status.getPath()
        parts = p.toString()[len(root) :].split("/")
        if p.getName().endswith(".parquet") and not any(x[:1] in ("_", ".") for x in parts if x):
            found.append((p.toString(), mark(status)))
    return sorted(found)


#: Files whose footers the driver reads itself; those of more are read on executors.
_FEW = 16
#: Files that are read one by one where their store is open to Spark alone and their schemas cannot be merged.
_ALONE = 64
_SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def footer(path: str) -> tuple[str, str | None] | None:
    """A digest of a Parquet file's schema, and its schema as Spark wrote it; None where the file cannot be opened from here."""
    from pyarrow import ArrowException, fs
    from pyarrow import parquet as pq

    try:
        if m := re.match(r"(?:file:(?://)?)?(/.*)", path):
            store, place = fs.LocalFileSystem(), m[1]
        else:
            store, place = fs.FileSystem.from_uri(quote(path, safe=":/@"))
        with store.open_input_file(place) as f:
            found = pq.ParquetFile(f).metadata
    except (OSError, ArrowException, ImportError):
        return None
    own = (found.metadata or {}).get(_SPARK_SCHEMA)
    shape = found.schema.to_arrow_schema().to_string(show_field_metadata=False, show_schema_metadata=False)
    return hashlib.sha256(shape.encode() + (own or b"")).hexdigest()[:24], own and own.decode()


def _footers(spark: SparkSession, files: list[str]) -> dict[str, tuple[list[str], str | None]] | None:
    """Files by the digest of their schema, in one job over all paths; None where a store is open to Spark alone. Each task tells a
    schema once."""
    if len(files) <= _FEW:
        with ThreadPoolExecutor(8) as pool:
            rows = [(i, *(x or (None, None))) for i, x in enumerate(pool.map(footer, files))]
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = set()
            for batch in batches:
                with ThreadPoolExecutor(8) as pool:
                    got = [x or (None, None) for x in pool.map(footer, batch.column(1).to_pylist())]
                own = [s if d not in known and not known.add(d) else None for d, s in got]
                yield pa.record_batch([batch.column(0), pa.array([d for d, _ in got], pa.string()), pa.array(own, pa.string())], names=["i", "digest", "own"])

        parts = min(math.ceil(len(files) / 50), 8 * spark.sparkContext.defaultParallelism)
        paths = spark.createDataFrame(pa.table({"i": range(len(files)), "path": files})).repartition(parts)
        rows = paths.mapInArrow(run, "i long, digest string, own string").collect()
    out: dict[str, tuple[list[str], str | None]] = {}
    for i, digest, own in sorted(rows, key=lambda r: r[0]):
        if digest is None:
            return None
        some, known = out.get(digest, ([], None))
        some.append(files[i])
        out[digest] = some, known or own
    return out


def _schemas(spark: SparkSession, read, files: list[str]) -> list[tuple[list[str], T.StructType]]:
    """Groups of files with a schema that fits all of a group."""
    found = _footers(spark, files)
    if found is None:
        return _merged_schemas(read, files)
    return [(some, T.StructType.fromJson(json.loads(own)) if own else read().parquet(some[0]).schema) for some, own in found.values()]


def _merged_schemas(read, files: list[str]) -> list[tuple[list[str], T.StructType]]:
    """The same by Spark's own merging: one distributed job where files agree; where they do not, halves, and at last file by file."""
    try:
        return [(files, read().option("mergeSchema", True).parquet(*files).schema)]
    except (PySparkException, Py4JJavaError):
        if len(files) == 1:
            raise
    if len(files) <= _ALONE:
        with ThreadPoolExecutor(8) as pool:
            return [([f], s) for f, s in zip(files, pool.map(lambda f: read().parquet(f).schema, files), strict=True)]
    half = len(files) // 2
    return _merged_schemas(read, files[:half]) + _merged_schemas(read, files[half:])


def path_of_file() -> Column:
    """The path, without its store, of the file a row of a scan comes from."""
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(whole, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")


def read_parquet(spark: SparkSession, path: str, files: list[str] | None = None, tag: str | None = None) -> DataFrame:
    """One scan per schema, so that files that agree are read together. Folders ``k=v`` below ``path`` give columns. A column
    ``tag``, if asked for, has each row's file."""
    files = parquet_files(spark, path) if files is None else files
    if not files:
        raise DataError(f"no Parquet files in {path}")
    parts = any("=" in x for f in files for x in f[f.find(path.rstrip("/")) + len(path.rstrip("/")) :].split("/")[:-1])

    def read():
        return spark.read.option("basePath", path) if parts else spark.read

    def tagged(df: DataFrame) -> DataFrame:
        return df.select("*", path_of_file().alias(tag)) if tag else df

    if len(files) == 1:
        return tagged(read().parquet(files[0]))
    groups: dict[str, list[str]] = defaultdict(list)
    for some, schema in _schemas(spark, read, files):
        groups[schema.json()] += some
    frames = [tagged(read().schema(T.StructType.fromJson(json.loads(k))).parquet(*v)) for k, v in groups.items()]
    if len(frames) == 1:
        return frames[0]
    both = union_by_name(frames)
    return both.select(*[F.col(f"`{c}`") for c in both.columns if c != tag], *([F.col(f"`{tag}`")] if tag else []))
