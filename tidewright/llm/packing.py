"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Each input partition is tokenised and best-fit packed where it is read, so no text is shuffled. Bins with at most
``slack`` free tokens are done. The others become items of the next round: they are dealt into groups of bounded size,
best-fit packed there, and again only underfull bins go on, until one group holds all that is left or a round merges
nothing. Items of later rounds are few: 24 bytes for each underfull bin. A group leaves one bin at most that is not over half
full, and every merge takes one of those, so rounds are few, too.

Defined cases: a null or empty text is the end id alone, one piece of length 1; documents longer than a sequence are cut
into full pieces with the shorter remainder first; repeated rows, ties and null ids are packed like any other row; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import blocks, lean, raw, small_batches, table, written
from tidewright.llm.tokens import encoder, vocabulary

CAPACITY = 2048
#: Items that one group of a merge round holds at about most.
GROUP_ITEMS = 100_000
#: Pieces that one task packs together; beyond it a new local packing begins.
LOCAL_PIECES = 200_000

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("place", pa.int64()), ("fill", pa.int64())])


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing. Returns each item's bin (from 0) and place in it, and the bins' fills.

    Open bins are kept by free space; a bit set of the free spaces in use finds the tightest one that still fits."""
    order = np.argsort(-sizes, kind="stable")
    which, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fills: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_in_use = 0
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = free_in_use >> s
        if fitting:
            free = s + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                free_in_use &= ~(1 << free)
        else:
            b, free = len(fills), capacity
            fills.append(0)
        which[i], place[i] = b, fills[b]
        fills[b] += s
        free -= s
        if free:
            by_free[free].append(b)
            free_in_use |= 1 << free
    return which, place, np.array(fills, np.int64)


def _local(path: str, end: int, capacity: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        encode, held, count, made = encoder(path), [], 0, 0

        def pack() -> pa.RecordBatch:
            nonlocal held, count, made
            cols = [np.concatenate(x) for x in list(zip(*held, strict=True))[1:]]
            ids = pa.concat_arrays([x[0] for x in held])
            which, place, fills = best_fit(cols[2], capacity)
            out = pa.record_batch([ids, *(pa.array(c) for c in cols), pa.array(which + (first + made)), pa.array(place), pa.array(fills[which])], schema=_SCHEMA)
            made += len(fills)
            held, count = [], 0
            return out

        for block in blocks(batches):
            ids, ends = encode(*raw(block.column(1)), end)
            sizes = np.diff(ends)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            head = sizes - (n - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            data = memoryview(ids.astype("<u4", copy=False)).cast("B")
            begin = (ends[row] + start) * 4
            crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), (begin + length * 4).tolist(), strict=True)), np.int64, len(row))
            held.append((block.column(0).take(pa.array(row)), piece.astype(np.int32), start, length, crc))
            count += len(row)
            if count >= LOCAL_PIECES:
                yield pack()
        if count:
            yield pack()

    return run


def _merged(capacity: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        which, place, fills = best_fit(items["fill"].to_numpy(), capacity)
        first = items["bin"].to_numpy()[np.unique(which, return_index=True)[1]]  # a merged bin goes by the id of its first item
        return pd.DataFrame({"bin": items["bin"].to_numpy(), "into": first[which], "shift": place, "fill": fills[which]})

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 0, capacity: int = CAPACITY, slack: int = 4) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or vocabulary("byte_bpe_50k.json")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    local = written(rows.mapInArrow(_local(path, end, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long"), "packed")
    under = local.filter(F.col("fill") < capacity - slack).select("bin", "fill").distinct()
    moves = merged(under, capacity, slack)
    if moves is None:
        return local.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    moves = moves.select(F.col("bin").alias("b"), "into", "shift")
    return local.join(moves, F.col("bin") == F.col("b"), "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))


def merged(under: DataFrame, capacity: int, slack: int) -> DataFrame | None:
    """(bin, into, shift) of the underfull bins (bin, fill): the bin that each goes into, and its place there; None if there
    are fewer than two."""
    moves = None
    under = written(under, "underfull")
    left = under.count()
    while left > 1:
        groups = -(-left // GROUP_ITEMS)
        # the count as seed deals the items anew each round
        dealt = under.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(left)), F.lit(groups)))
        step = written(dealt.groupBy("g").applyInPandas(_merged(capacity), "bin long, into long, shift long, fill long"), "merged")
        if moves is None:
            moves = step.select("bin", "into", "shift")
        else:
            on = step.select(F.col("bin").alias("b"), F.col("into").alias("i"), F.col("shift").alias("s"))
            moves = moves.join(on, F.col("into") == F.col("b"), "left").select("bin", F.coalesce("i", "into").alias("into"), (F.col("shift") + F.coalesce("s", F.lit(0))).alias("shift"))
        if groups == 1:
            break
        under = written(step.filter((F.col("bin") == F.col("into")) & (F.col("fill") < capacity - slack)).select("bin", "fill"), "underfull")
        before, left = left, under.count()
        if left == before:
            break
    return moves


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
