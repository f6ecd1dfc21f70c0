"""Atomic publication of directories. What a table holds is said by numbered entries of its log: a new version is written aside,
and the entry after the one it was made from is created, which of several writers at once only one can. Readers take the last
entry. Paths may lie in any store Spark reads."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewright.errors import ConflictError
from tidewright.sources.fs import Files

_LOG = "_versions"


@dataclass(frozen=True)
class Entry:
    """Version ``number`` of a table: the folder ``name`` beside the log, and the fence of the lease it was written under."""

    number: int
    name: str
    fence: int = 0


def last_entry(path: str, spark: SparkSession | None = None) -> Entry | None:
    files = Files(path, spark)
    found = [n for n in files.names(f"{path}/{_LOG}") if n.isdigit()]
    return _entry(files, path, found[-1]) if found else None


def _entry(files: Files, path: str, number: str) -> Entry:
    body = json.loads(files.read(f"{path}/{_LOG}/{number}"))
    return Entry(int(number), body["name"], body["fence"])


def commit(files: Files, path: str, name: str, base: Entry | None, fence: int | None = None) -> bool:
    """Makes ``name`` the version after ``base``; False if another writer made one meanwhile. Under a ``fence`` lower than that of
    the last version the writer's lease was taken over: that is a ConflictError."""
    if fence is not None and base is not None and fence < base.fence:
        raise ConflictError(f"{path} was written under fence {base.fence}; this writer has {fence}")
    files.make(f"{path}/{_LOG}")
    body = {"name": name, "fence": max(fence or 0, base.fence if base else 0)}
    return files.create(f"{path}/{_LOG}/{(base.number if base else 0) + 1:020d}", json.dumps(body))


def retrying(path: str, spark: SparkSession, attempt: Callable[[Entry | None], str | None], attempts: int = 10, sleep=time.sleep) -> str:
    """Calls ``attempt`` with the last entry until it commits; it gives the committed folder, or None when another writer was first."""
    for k in range(attempts):
        done = attempt(last_entry(path, spark))
        if done is not None:
            return done
        sleep(min(2.0, 0.02 * 2**k))
    raise ConflictError(f"{path}: other writers were first {attempts} times")


def current(path: str, spark: SparkSession | None = None) -> str | None:
    """The folder of the published version, or None."""
    entry = last_entry(path, spark)
    return f"{path}/{entry.name}" if entry else None


def publish(df: DataFrame, path: str, keep: int = 1, fence: int | None = None) -> str:
    """Writes a version beside the published one, puts it in its place, and removes those before the ``keep`` last. Readers see the
    one or the other; of two that publish at once the second stands."""
    spark, files = df.sparkSession, Files(path, df.sparkSession)
    files.make(path)
    name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
    df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    retrying(path, spark, lambda base: name if commit(files, path, name, base, fence) else None)
    expire(spark, path, keep + 1)
    return f"{path}/{name}"


def expire(spark: SparkSession, path: str, keep: int) -> None:
    """Removes versions before the ``keep`` last, with files that no later one holds. What was never committed stays: it may
    belong to a writer at work."""
    from tidewright.operators import keyed_table

    files = Files(path, spark)
    numbers = [n for n in files.names(f"{path}/{_LOG}") if n.isdigit()]
    if len(numbers) <= keep:
        return
    there = lambda some: [_entry(files, path, n) for n in some if files.exists(f"{path}/{_LOG}/{n}")]
    gone, held = there(numbers[:-keep]), there(numbers[-keep:])
    keyed_table.drop(spark, path, [e.name for e in gone], {e.name for e in held})
    for e in gone:
        files.remove(f"{path}/{_LOG}/{e.number:020d}")


def read(spark: SparkSession, path: str) -> DataFrame | None:
    from tidewright.operators import keyed_table

    entry = last_entry(path, spark)
    return None if entry is None else keyed_table.rows_of(spark, path, entry.name)


def write_unit(df: DataFrame, path: str, unit: str) -> str:
    """One directory per unit: a unit written again takes the place of the first."""
    files = Files(path, df.sparkSession)
    files.make(path)
    tmp = f"{path}/_tmp-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(tmp)
    return put_unit(files, tmp, path, unit)


def put_unit(files: Files, tmp: str, path: str, unit: str) -> str:
    """Moves a written folder to the unit's place. One that is there is moved aside first, so that it can come back, and goes last."""
    final, aside = f"{path}/unit_{unit}", f"{path}/_old-{uuid.uuid4().hex}"
    files.make(path)
    there = files.exists(final)
    if there:
        files.move(final, aside)
    try:
        files.move(tmp, final)
    except BaseException:
        if there:
            files.move(aside, final)
        raise
    if there:
        files.remove(aside)
    return final


def upsert_table(df: DataFrame, path: str, keys: list[str], order: str | None = None, fence: int | None = None) -> str:
    """The published table at ``path`` with the rows of ``df`` in place of those of the same keys; of several new rows of a key the
    last by ``order`` wins, without one the greatest by all columns. A run that stops before it commits changes nothing."""
    from tidewright.operators import keyed_table

    return keyed_table.upsert(df, path, keys, order, fence)


class FileLock:
    """A lock file; a few attempts with doubling waits."""

    def __init__(self, path: str, attempts: int = 5, wait: float = 0.05, sleep=time.sleep):
        self.path, self.attempts, self.wait, self.sleep = path, attempts, wait, sleep

    def __enter__(self):
        for k in range(self.attempts):
            try:
                os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return self
            except FileExistsError:
                if k + 1 < self.attempts:
                    self.sleep(self.wait * 2**k)
        raise ConflictError(f"{self.path} is locked")

    def __exit__(self, *_):
        os.unlink(self.path)
