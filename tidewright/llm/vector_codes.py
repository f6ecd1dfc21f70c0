"""Product codes of vectors: each of four parts is named by the nearest entry of its own codebook, in integers throughout.

Vectors become columnar numpy blocks of one part block a position, a dimension a row, which are written once. A round is one RDD
``treeAggregate`` over them: distances to all entries of a part accumulate dimension by dimension, the nearest entry of each vector
is taken, and ``np.add.at`` adds its dimensions and a one to int64 tensors of sums and counts, which merge through a reduction tree.
The driver sees one such tensor a round, 8 bytes for each dimension of each entry, and no row but those that begin the codebooks.

Components are floor(SCALE * x), whole numbers, so sums do not depend on the order of rows and reruns agree. Distances use 32-bit
integers where the greatest component proves that they fit, 64-bit ones beyond, and Python's own where not even these would do; the
results are the same, but an error beyond a long is null.

Defined cases: rows whose vector is null, or holds a null or a component that is no number or infinite, are dropped; shorter vectors
count as if zeros followed, up to the longest vector and to a multiple of four (an empty one is all zeros); with fewer rows than
entries there are as many entries as rows; entries begin as the vectors of the least ids, nulls last, equal ids by their vectors;
repeated rows are vectors of their own; null labels are one label; an empty table gives no rows; columns beyond the three that are
named are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import removed, small_batches, table, written

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors in one block; its table of distances has so many rows of ``ENTRIES``.
ROWS = 1024
#: Labels whose sums are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 50_000


def whole(x: np.ndarray, kind) -> np.ndarray:
    """floor(SCALE * x), exactly, for finite numbers."""
    if kind is object:
        return np.array([math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in map(float, x.ravel())], object).reshape(x.shape)
    return np.floor(x.astype(np.float64) * SCALE).astype(kind)


def integers(top: float, dim: int, rows: int):
    """The integers in which all distances and errors of a vector are exact: of 32 or 64 bits, or Python's."""
    most = math.ceil(top) * SCALE + SCALE
    if 4 * most * most * max(dim, 1) < 1 << 31:
        return np.int32
    return np.int64 if 4 * most * most * max(dim, 1) < 1 << 62 and most * max(rows, 1) < 1 << 62 else object


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a part block (dimensions x vectors) the first of the nearest entries (dimensions x entries), and its distance."""
    far = np.zeros((part.shape[1], book.shape[1]), part.dtype)
    for values, entries in zip(part, book, strict=True):
        apart = values[:, None] - entries[None, :]
        apart *= apart
        far += apart
    at = far.argmin(axis=1)
    return at, far[np.arange(len(at)), at]


class Tensor:
    """Sums (part, dimension, entry) and counts (part, entry) of assigned vectors."""

    def __init__(self, dim: int, entries: int, kind):
        kind = object if kind is object else np.int64
        self.sums = np.zeros((PARTS, dim, entries), kind)
        self.counts = np.zeros((PARTS, entries), np.int64)

    def add(self, block: np.ndarray, books: np.ndarray) -> Tensor:
        for p in range(PARTS):
            at, _ = nearest(block[p], books[p])
            for j, values in enumerate(block[p]):
                np.add.at(self.sums[p, j], at, values.astype(self.sums.dtype))
            np.add.at(self.counts[p], at, 1)
        return self

    def merge(self, other: Tensor) -> Tensor:
        self.sums += other.sums
        self.counts += other.counts
        return self

    def means(self, books: np.ndarray) -> np.ndarray:
        """Componentwise floors of the means; entries without vectors stay."""
        used = self.counts > 0
        found = self.sums // np.maximum(self.counts, 1).astype(self.sums.dtype)[:, None, :]
        return np.where(used[:, None, :], found, books).astype(books.dtype)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columnar blocks: ids, labels, the longest length, the greatest component, and the components a dimension a row."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            rows = batch.slice(start, ROWS)
            vectors = rows.column(2)
            n, sizes = rows.num_rows, vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            dim = int(sizes.max(initial=0))
            body = np.zeros((n, dim), np.float64)
            body[np.arange(dim) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
            ends = pa.array([0, n], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, rows.column(k)) for k in (0, 1)]
            top = float(np.abs(body).max(initial=0.0))
            yield pa.record_batch([*lists, pa.array([n], pa.int64()), pa.array([dim], pa.int32()), pa.array([top]), pa.array([np.ascontiguousarray(body.T).tobytes()], pa.binary())], names=["ids", "labels", "n", "dim", "top", "body"])


def _unpacked(body: bytes, own: int, n: int, dim: int, kind) -> np.ndarray:
    """A block as part blocks (part, dimension, vector) of whole numbers."""
    found = np.zeros((PARTS * dim, n), np.float64)
    found[:own] = np.frombuffer(body, np.float64).reshape(own, n)
    return whole(found, kind).reshape(PARTS, dim, n)


def digest(books: np.ndarray) -> str:
    """Of all components in order of part, entry and place in the part."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.transpose(0, 2, 1).ravel()).encode()).hexdigest()


def trained(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, dimension, entry) after so many rounds over the written blocks."""
    dim, entries, kind = books.shape[1], books.shape[2], object if books.dtype == object else books.dtype.type
    columnar = blocks.select("body", "dim", "n").rdd.map(lambda r: _unpacked(r[0], r[1], r[2], dim, kind))
    for _ in range(rounds):
        now = columnar.context.broadcast(books)
        tensor = columnar.treeAggregate(Tensor(dim, entries, kind), lambda t, block, now=now: t.add(block, now.value), lambda a, b: a.merge(b), depth=2)
        now.destroy()
        books = tensor.means(books)
    return books


def encode(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(key, label, code, error, codebooks_sha256) of every vector that takes part."""
    spark = rows.sparkSession
    small_batches(spark, ROWS)
    if not 0 < entries <= 256:
        raise ValueError("a code has two digits: 1 to 256 entries")
    if len({key, label, "code", "error", "codebooks_sha256"}) < 5:
        raise ValueError(f"{key} and {label} must differ from each other and from the result's columns")
    x = F.col("x")
    kept = rows.select(rows[f"`{key}`"].alias("k"), rows[f"`{label}`"].alias("l"), rows[f"`{vector}`"].cast("array<double>").alias("x"))
    kept = kept.filter(x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    key_kind, label_kind = (kept.schema[c].dataType.simpleString() for c in ("k", "l"))
    spread = kept
    if kept.rdd.getNumPartitions() < (least := spark.sparkContext.defaultParallelism):
        spread = kept.repartition(least)  # a table of few files is dealt to all cores
    blocks = written(spread.mapInArrow(_blocks, f"ids array<{key_kind}>, labels array<{label_kind}>, n long, dim int, top double, body binary"), "vectors")
    found = blocks.agg(F.sum("n"), F.max("dim"), F.max("top")).first()
    n, longest, top = found[0] or 0, found[1] or 0, found[2] or 0.0
    dim = -(-longest // PARTS)
    kind = integers(top, PARTS * dim, n)
    first = kept.orderBy(F.col("k").asc_nulls_last(), "x").limit(entries).select("x").collect()
    seeds = np.zeros((len(first), PARTS * dim), np.float64)
    for i, r in enumerate(first):
        seeds[i, : len(r.x)] = r.x
    books = whole(seeds.T, kind).reshape(PARTS, dim, len(first))
    if n:
        books = trained(blocks, books, rounds)
    schema = f"k {key_kind}, l {label_kind}, code string, error long"
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, digits = shared.value, np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, n, own, _, body = (batch.column(c).slice(i, 1) for c in range(6))
                block = _unpacked(body[0].as_py(), own[0].as_py(), n[0].as_py(), dim, kind)
                codes, error = np.full(block.shape[2], ""), np.zeros(block.shape[2], object if kind is object else np.int64)
                for p in range(PARTS):
                    at, far = nearest(block[p], books[p])
                    codes, error = np.char.add(codes, digits[at]), error + far
                errors = [v if v < 1 << 63 else None for v in error.tolist()]
                yield pa.record_batch([ids.flatten(), labels.flatten(), pa.array(codes.tolist(), pa.string()), pa.array(errors, pa.int64())], names=["k", "l", "code", "error"])

    coded = written(blocks.mapInArrow(run, schema), "codes")
    removed(blocks)
    return coded.select(F.col("k").alias(key), F.col("l").alias(label), "code", "error", F.lit(digest(books)).alias("codebooks_sha256"))


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """With label_error: the errors of all rows of an equal label, nulls together; null beyond a long."""
    whole_sum = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = coded.groupBy(F.col(f"`{label}`").alias("l")).agg(whole_sum.alias("e")).select("l", F.expr("try_cast(e AS long)").alias("e"))
    sums = written(sums, "label_errors").toDF("\x00l", "label_error")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, coded[f"`{label}`"].eqNullSafe(sums["`\x00l`"])).drop("\x00l")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = label_errors(encode(table(spark, sf_dir, "embeddings")))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_ROUND = """
a{k} AS (SELECT r, p, min_by(e, [d, e]) AS e FROM (SELECT x.r, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{k} AS b ON x.p = b.p AND x.j = b.j GROUP BY x.r, x.p, b.e) GROUP BY r, p),
m{k} AS (SELECT x.p, a.e, x.j, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS c FROM x JOIN a{k} AS a ON x.r = a.r AND x.p = a.p GROUP BY x.p, a.e, x.j),
b{n} AS MATERIALIZED (SELECT b.p, b.e, b.j, CASE WHEN c IS NULL THEN v ELSE (s - (s % c + c) % c) // c END AS v FROM b{k} AS b LEFT JOIN m{k} AS m ON b.p = m.p AND b.e = m.e AND b.j = m.j),"""

#: The definition in plain SQL, one set of tables a round.
OP11_SQL = (
    """
WITH kept AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
w AS (SELECT (max(len(embedding)) + 3) // 4 AS w FROM kept),
i AS (SELECT r, embedding, w, unnest(range(4 * w)) AS i FROM kept, w),
x AS MATERIALIZED (SELECT r, i // w AS p, i % w AS j, CAST(floor(1024 * CAST(coalesce(embedding[i + 1], 0) AS DOUBLE)) AS BIGINT) AS v FROM i),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, j, v FROM x WHERE r <= 256),"""
    + "".join(_ROUND.format(k=k, n=k + 1) for k in range(ROUNDS))
    + """
f AS (SELECT r, p, min_by(e, [d, e]) AS e, min(d) AS d FROM (SELECT x.r, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b4 AS b ON x.p = b.p AND x.j = b.j GROUP BY x.r, x.p, b.e) GROUP BY r, p),
t AS (SELECT r, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, sum(d) AS error FROM f GROUP BY r),
h AS (SELECT sha256(string_agg(v, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN t ON kept.r = t.r, h
"""
)
