"""Helpers shared by the training-data operators: shared storage and vectorised word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text handed to numpy at once; one longer text makes a block of its own.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share (``spark.checkpoint.dir``); where it is unset, one in the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewright_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more; what was made from them must have been written, too."""
    for df in tables:
        path = getattr(df, "_tidewright_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _returned() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A task's function around which what is free goes back to the machine; a worker that serves many tasks would keep it, and
    that of another operator's tasks, too."""

    @functools.wraps(run)
    def wrapped(batches):
        _returned()
        try:
            yield from run(batches)
        finally:
            _returned()

    return wrapped


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of queries that end in this block go as each ends, instead of when the driver's heap is next collected.
    For queries that are collected or written once; a lost executor during them is made up for as ever."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Bound what one Arrow batch holds, as texts may be long; settings that are lower already stay. Results are lazy, so the
    settings must still hold when they are run."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``most`` bytes, so that memory does not follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = raw(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + most, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n + 1 offsets; a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts, wide = texts.cast(pa.large_string()), True
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return body, ends - ends[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words between white space, and of words of letters and digits.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def lowered(body: np.ndarray) -> np.ndarray:
    return _LOWER[body]


def words(body: np.ndarray, ends: np.ndarray, inside: np.ndarray = NOT_BLANK) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of bytes in ``inside``, none across texts, in order, and the n + 1 offsets of each text's words."""
    if not body.size:
        return pa.array([], pa.binary()), np.zeros(len(ends), np.int64)
    mask = inside[body]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    at = ends[:-1][ends[:-1] < body.size]
    begins[at] = mask[at]
    starts = np.flatnonzero(begins)
    offsets = np.empty(len(starts) + 1, np.int32)
    kept = body[mask]
    # rank of each start among the kept bytes
    offsets[:-1] = (np.cumsum(mask, dtype=np.int32) - 1)[starts] if len(starts) else 0
    offsets[-1] = kept.size
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return found, np.searchsorted(starts, ends).astype(np.int64)


def coded(found: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers within the block, and the distinct words."""
    if not len(found):
        return np.zeros(0, np.int32), []
    d = found.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHash:
    """64-bit hashes of words; the cache is bounded."""

    def __init__(self, most: int = 400_000):
        self.seen: dict[bytes, int] = {}
        self.most = most

    def __call__(self, distinct: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.seen) > self.most:
            self.seen.clear()
        seen, h = self.seen, xxhash.xxh3_64_intdigest
        out = np.empty(len(distinct), np.uint64)
        for i, w in enumerate(distinct):
            v = seen.get(w)
            if v is None:
                v = seen[w] = h(w)
            out[i] = v
        return out
