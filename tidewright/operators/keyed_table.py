"""Keyed tables of many files. A version is a manifest: which files it holds, with the rows and the least and greatest key of each.

An upsert reads keys only of files whose range meets new keys, rewrites only those that hold one, and carries the others over. It
commits against the version it read; if another writer was first, it is done again on that writer's version, so no update is
lost. Tables that were published as a whole folder get a manifest with their first upsert.

Nulls are keys like others, and come first. The new rows and the keys of the files they meet are joined by Spark; the driver
sees file names, and ``RANGES`` ranges of new keys at most."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.errors import DataError
from tidewright.operators import keyed, publish
from tidewright.plans.compile import free, q
from tidewright.sources.fs import Files
from tidewright.sources.union import parquet_files, path_of_file, read_parquet, widest

#: Ranges that stand for the new keys where files are left out by their least and greatest key.
RANGES = 256
#: Rows of a file where a table has none to go by.
FILE_ROWS = 1_000_000


def _manifest(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def _names(spark: SparkSession, path: str, name: str) -> list[str]:
    """Files of a version, relative to the table."""
    if name.startswith("m-"):
        return sorted(r[0] for r in _manifest(spark, path, name).select("file").collect())
    root = Files(path, spark)
    top = root.fs.makeQualified(root._at(path)).toString().rstrip("/")
    return [f[len(top) + 1 :] for f in parquet_files(spark, f"{top}/{name}")]


def rows_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a version, be it a whole folder or a manifest."""
    if name.startswith("m-"):
        return read_parquet(spark, path, [f"{path}/{f}" for f in _names(spark, path, name)])
    return spark.read.parquet(f"{path}/{name}")


def drop(spark: SparkSession, path: str, gone: list[str], held: set[str]) -> None:
    """Removes versions, and data files that only they hold."""
    files = Files(path, spark)
    if any(n.startswith("m-") for n in [*gone, *held]):
        kept = {f for n in held if files.exists(f"{path}/{n}") for f in _names(spark, path, n)}
        for f in {f for n in set(gone) - held if files.exists(f"{path}/{n}") for f in _names(spark, path, n)} - kept:
            files.remove(f"{path}/{f}")
        kept_folders = {f.split("/")[0] for f in kept}
    else:
        kept_folders = set()
    for n in set(gone) - held - kept_folders:
        files.remove(f"{path}/{n}")


def _ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    """(file, rows, low, high) of the files that ``df`` reads, ``file`` relative to the table."""
    key = F.struct(*[q(k).alias(f"k{i}") for i, k in enumerate(keys)])
    name = F.regexp_extract(path_of_file(), "([^/]+/[^/]+)$", 1)
    return df.select(name.alias("file"), key.alias("key")).groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))


def _write(df: DataFrame, path: str, folder: str, keys: list[str], rows: int, per_file: int) -> DataFrame:
    """Writes rows sorted by key into files of narrow ranges; gives their part of a manifest."""
    n = max(1, math.ceil(rows / per_file))
    df.repartitionByRange(n, *map(q, keys)).sortWithinPartitions(*map(q, keys)).write.option("compression", "zstd").parquet(f"{path}/{folder}")
    return _ranges(df.sparkSession.read.schema(df.schema).parquet(f"{path}/{folder}"), keys)


def create(df: DataFrame, path: str, keys: list[str], file_rows: int = FILE_ROWS, fence: int | None = None) -> str:
    """Publishes ``df``, of which each key has one row, as a table clustered by key; it takes the place of what is there."""
    spark, files = df.sparkSession, Files(path, df.sparkSession)
    files.make(path)
    token = uuid.uuid4().hex[:12]
    manifest = f"m-{token}"
    _write(df, path, f"d-{token}", keys, df.count(), file_rows).coalesce(1).write.parquet(f"{path}/{manifest}")
    publish.retrying(path, spark, lambda base: manifest if publish.commit(files, path, manifest, base, fence) else None)
    publish.expire(spark, path, 2)
    return f"{path}/{manifest}"


def _met(manifest: DataFrame, new: DataFrame, n_new: int, keys: list[str]) -> list:
    """Files whose range meets one of few ranges that hold all new keys."""
    own = manifest.schema["low"].dataType
    kind = ", ".join(f"k{i}: {widest(own[i].dataType, new.schema[k].dataType).simpleString()}" for i, k in enumerate(keys))
    key = F.struct(*[q(k).alias(f"k{i}") for i, k in enumerate(keys)]).cast(f"struct<{kind}>")
    ranges = new.select(key.alias("key")).repartitionByRange(max(1, min(RANGES, n_new // 50)), "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("a"), F.max("key").alias("b"))
    cut = manifest.select("file", "rows", F.col("low").cast(f"struct<{kind}>").alias("low"), F.col("high").cast(f"struct<{kind}>").alias("high"))
    return cut.join(F.broadcast(ranges.select("a", "b")), (F.col("a") <= F.col("high")) & (F.col("b") >= F.col("low")), "left_semi").select("file", "rows").collect()


def _holding(spark: SparkSession, path: str, names: list[str], new: DataFrame, keys: list[str]) -> set[str]:
    """Of some files, those that hold a key of ``new``; columns other than keys are not read."""
    (tag,) = free({*new.columns}, "file")
    files = read_parquet(spark, path, [f"{path}/{f}" for f in names], tag).select(*map(q, keys), q(tag))
    inner = free({*files.columns}, *[f"k{i}" for i in range(len(keys))])
    fresh = new.select(*[q(k).alias(n) for k, n in zip(keys, inner, strict=True)])
    same = reduce(lambda a, b: a & b, [q(k).eqNullSafe(q(n)) for k, n in zip(keys, inner, strict=True)])
    held = files.join(fresh, same, "left_semi").select(F.regexp_extract(q(tag), "([^/]+/[^/]+)$", 1)).distinct()
    return {r[0] for r in held.collect()}


def upsert(df: DataFrame, path: str, keys: list[str], order: str | None = None, fence: int | None = None, file_rows: int = FILE_ROWS, attempts: int = 10, keep: int = 3) -> str:
    """Puts the rows of ``df`` in place of those of the same keys; the folder of the new version. Of several new rows of a key the
    last by ``order`` wins, without one the greatest by all columns."""
    spark, files = df.sparkSession, Files(path, df.sparkSession)
    files.make(path)
    if missing := [k for k in keys if k not in df.columns]:
        raise DataError(f"no key columns {missing}")
    new = (keyed.last_per_key(df, keys, order) if order else keyed.settled(df, keys)).persist()
    try:
        n_new = new.count()

        def attempt(base: publish.Entry | None) -> str | None:
            token, done = uuid.uuid4().hex[:12], False
            try:
                if base is None:
                    parts = _write(new, path, f"d-{token}", keys, n_new, file_rows)
                else:
                    parts = _merged(spark, path, base.name, f"d-{token}", new, n_new, keys, file_rows)
                parts.coalesce(1).write.parquet(f"{path}/m-{token}")
                done = publish.commit(files, path, f"m-{token}", base, fence)
            except (PySparkException, Py4JJavaError):
                # files of a version that others left behind may be gone while it is read
                if publish.last_entry(path, spark) == base:
                    raise
            finally:
                if not done:
                    files.remove(f"{path}/d-{token}")
                    files.remove(f"{path}/m-{token}")
            return f"m-{token}" if done else None

        made = publish.retrying(path, spark, attempt, attempts)
    finally:
        new.unpersist()
    publish.expire(spark, path, keep)
    return f"{path}/{made}"


def _merged(spark: SparkSession, path: str, name: str, folder: str, new: DataFrame, n_new: int, keys: list[str], file_rows: int) -> DataFrame:
    """The manifest after the upsert; what is rewritten goes to ``folder``."""
    old = _manifest(spark, path, name) if name.startswith("m-") else _ranges(spark.read.parquet(f"{path}/{name}"), keys)
    if not n_new:
        return old
    met = _met(old, new, n_new, keys)
    touched = sorted(_holding(spark, path, [r.file for r in met], new, keys)) if met else []
    body = keyed.upserted(read_parquet(spark, path, [f"{path}/{f}" for f in touched]), new, keys) if touched else new
    known = old.agg(F.sum("rows"), F.count(F.lit(1))).first()
    per_file = max(1, min(file_rows, (known[0] or file_rows) // max(1, known[1])))
    rewritten = {*touched}
    fresh = _write(body, path, folder, keys, n_new + sum(r.rows for r in met if r.file in rewritten), per_file)
    gone = spark.createDataFrame([(f,) for f in touched], "gone string")
    kept = old.join(F.broadcast(gone), F.col("file") == F.col("gone"), "left_anti")
    bounds = [F.col(c).cast(fresh.schema[c].dataType).alias(c) for c in ("low", "high")]
    return kept.select("file", "rows", *bounds).unionByName(fresh)


def compact(spark: SparkSession, path: str, keys: list[str], file_rows: int = FILE_ROWS, least: int = 2, fence: int | None = None, attempts: int = 10, keep: int = 3) -> dict:
    """Files of less than half of ``file_rows`` rows become files of about so many, clustered by key, as a version of its own: readers
    see the one or the other, in any store, and a writer who was first is never undone."""
    files, done = Files(path, spark), {"files": 0, "rows": 0, "made": 0}

    def attempt(base: publish.Entry | None) -> str | None:
        if base is None:
            raise DataError(f"{path} holds no table")
        token, ok = uuid.uuid4().hex[:12], False
        old = _manifest(spark, path, base.name) if base.name.startswith("m-") else _ranges(spark.read.parquet(f"{path}/{base.name}"), keys)
        small = old.filter(F.col("rows") < file_rows / 2).select("file", "rows").collect()
        if len(small) < least:
            done.update(files=0, rows=0, made=0)
            return base.name
        try:
            body = read_parquet(spark, path, sorted(f"{path}/{r.file}" for r in small))
            rows = sum(r.rows for r in small)
            fresh = _write(body, path, f"d-{token}", keys, rows, file_rows)
            gone = spark.createDataFrame([(r.file,) for r in small], "gone string")
            bounds = [F.col(c).cast(fresh.schema[c].dataType).alias(c) for c in ("low", "high")]
            kept = old.join(F.broadcast(gone), F.col("file") == F.col("gone"), "left_anti").select("file", "rows", *bounds)
            kept.unionByName(fresh).coalesce(1).write.parquet(f"{path}/m-{token}")
            made = [r for r in _manifest(spark, path, f"m-{token}").filter(F.col("file").startswith(f"d-{token}/")).select("rows").collect()]
            if sum(r.rows for r in made) != rows:
                raise RuntimeError("compaction lost rows")
            done.update(files=len(small), rows=rows, made=len(made))
            ok = publish.commit(files, path, f"m-{token}", base, fence)
        except (PySparkException, Py4JJavaError):
            if publish.last_entry(path, spark) == base:
                raise
        finally:
            if not ok:
                files.remove(f"{path}/d-{token}")
                files.remove(f"{path}/m-{token}")
        return f"m-{token}" if ok else None

    publish.retrying(path, spark, attempt, attempts)
    publish.expire(spark, path, keep)
    return done
