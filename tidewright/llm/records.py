"""Token ids as length-delimited binary records with masked checksums, and an offset index beside each file.

A record is: payload length (8 bytes), masked crc32 of those 8 bytes (4), payload, masked crc32 of the payload (4), all
little-endian. The payload is a byte 1 if the id is null, the document id (8), and the token ids, 2 bytes each when the
vocabulary allows, else 4. ``shard-k.idx`` holds the file offset of each record and the file's length, 8 bytes each, so
that a reader can fetch records in any order. Shards hold ascending ids, and so do the records in each.

Defined cases: a null or empty text is the end id alone; a null id comes first; repeated rows each get a record; an empty
table gives shards without records, and no rows; other columns are ignored. A task that runs again writes the same file
under another name and puts it in place at once, so lost executors leave no half file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import blocks, lean, raw, shared_path, small_batches, table
from tidewright.llm.tokens import encoder, vocabulary

_HEAD, _DOC = "<QI", "<Bq"
#: Bytes of text that make one shard at about most.
SHARD_BYTES = 256 << 20


def masked(crc: int) -> int:
    """Rotated and shifted, so that a checksum of data that holds checksums stays sound."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframed(data: memoryview, what: str = "record") -> memoryview:
    """The payload of one framed record; raises ValueError if a checksum or the length is wrong."""
    if len(data) < 16:
        raise ValueError(f"{what}: too short")
    size, crc = struct.unpack_from(_HEAD, data)
    if masked(zlib.crc32(data[:8])) != crc or size != len(data) - 16:
        raise ValueError(f"{what}: bad length")
    payload = data[12 : 12 + size]
    if masked(zlib.crc32(payload)) != struct.unpack_from("<I", data, 12 + size)[0]:
        raise ValueError(f"{what}: bad checksum")
    return payload


def _filesystem(where: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(where)


def _writer(where: str, path: str, end: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _filesystem(where)
        shard = TaskContext.get().partitionId()
        encode = encoder(path)
        kind = "<u2" if max(encode.size, end + 1) <= 1 << 16 else "<u4"
        offsets, at, tokens = [], 0, 0
        name, tmp = f"{top}/shard-{shard:06d}", f"{top}/_tmp-{shard:06d}-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{tmp}.rec") as out:
            for block in blocks(batches):
                ids, ends = encode(*raw(block.column(1)), end)
                data = memoryview(ids.astype(kind)).cast("B")
                wide = int(kind[-1])
                made = []
                for doc, a, b in zip(block.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    made.append(framed(struct.pack(_DOC, doc is None, doc or 0) + data[a * wide : b * wide]))
                    offsets.append(at)
                    at += len(made[-1])
                tokens += len(ids)
                out.write(b"".join(made))
        with store.open_output_stream(f"{tmp}.idx") as out:
            out.write(np.array([*offsets, at], "<u8").tobytes())
        store.move(f"{tmp}.idx", f"{name}.idx")
        store.move(f"{tmp}.rec", f"{name}.rec")
        yield pa.record_batch([pa.array([shard]), pa.array([len(offsets)]), pa.array([tokens]), pa.array([int(kind[-1])])], names=["shard", "records", "tokens", "width"])

    return run


def _bytes(rows: DataFrame) -> int:
    """The optimiser's estimate of the input's size: that of its files, when it reads files; 0 where it has none."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def write_records(docs: DataFrame, where: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 1) -> list:
    """Write all documents into ``where`` in ascending order of ``key``. Returns (shard, records, tokens, width) per file."""
    spark = docs.sparkSession
    small_batches(spark)
    store, top = _filesystem(where)
    store.create_dir(top, recursive=True)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # equal ids go by a hash of their text, within shards as between them, so that another run writes the same
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_bytes(rows) // SHARD_BYTES))
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    path = tokenizer or vocabulary("word_bpe_49k.json")
    return sorted(tuple(r) for r in dealt.mapInArrow(_writer(where, path, end), "shard long, records long, tokens long, width long").collect())


def _reader(where: str, most: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _filesystem(where)
        for batch in batches:
            for x in batch.to_pylist():
                name, start, width = f"{top}/shard-{x['shard']:06d}", x["start"], x["width"]
                with store.open_input_file(f"{name}.idx") as f:
                    at = np.frombuffer(f.read(), "<u8").astype(np.int64)
                with store.open_input_file(f"{name}.rec") as f:
                    i = 0
                    while i < len(at) - 1:
                        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
                        f.seek(int(at[i]))
                        data = memoryview(f.read(int(at[j] - at[i])))
                        out = []
                        for a, b in zip((at[i:j] - at[i]).tolist(), (at[i + 1 : j + 1] - at[i]).tolist(), strict=True):
                            body = unframed(data[a:b], name)
                            null, doc = struct.unpack_from(_DOC, body)
                            ids = np.frombuffer(body[struct.calcsize(_DOC) :], f"<u{width}").astype("<u4")
                            out.append((None if null else doc, start, len(ids), zlib.crc32(ids)))
                            start += len(ids)
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        i = j

    return run


def read_records(spark: SparkSession, where: str, shards: list) -> DataFrame:
    """Per record, in the files' order: doc_id, tokens before it, its tokens and the crc32 of its ids as 32-bit integers."""
    rows, before = [], 0
    for shard, records, tokens, width in shards:
        if records:
            rows.append((shard, before, width))
        before += tokens
    schema = "shard long, start long, width long"
    listed = spark.createDataFrame(rows, schema)
    if rows:
        listed = listed.repartition(len(rows))
    return listed.mapInArrow(_reader(where), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = shared_path(spark, "records")
    return read_records(spark, where, write_records(table(spark, sf_dir, "documents"), where))
