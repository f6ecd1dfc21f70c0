"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine ``least`` or more are at most ``2 - 2 * least`` apart in squared distance. Vectors are rotated by a
fixed random rotation and split into blocks of ``BLOCK`` dimensions; if every block were further apart than its share of
that budget, so would the vectors be, so some block is within its share. Each block is range-joined: a vector lives in one
cell of a grid and visits the cells its radius touches. A pair is tested where the vector with the smaller id lives, in
its first block within budget, so it is counted once.

Rows carry the rotated vector in 16-bit fixed point. Bounds on the rounding error decide pairs as links or not; the few
that the bounds leave open are checked on the vectors themselves in double precision. No list of pairs leaves a cell: a
cell gives counts per vector, and one edge per linked vector for the components. Equal vectors of one label are one class
from the start. Cells of more than ``CELL_ROWS`` rows are split into parts, and the parts are paired.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components, and one whose label is null, links
with nothing and is a component of its own; vectors of unequal length never link; repeated rows are separate vectors and
link with each other; a null id is never a component's name unless there is no other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import small_batches, table, written
from tidewright.llm.graph import components

BLOCK = 4
CELL_ROWS = 2048
#: Grid cells are this many radii wide; wider cells are visited by fewer vectors and hold more.
CELL_RADII = 4.0
SCALE = 32767.0
#: Largest rounding error of one coordinate, with room for that of the rotation.
ERROR = 0.51 / SCALE


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """A vector of the same direction whose squares neither over- nor underflow; a power of two changes no digit."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))


def fixed_point(x: np.ndarray) -> np.ndarray:
    """Rotated unit vectors in fixed point, padded to whole blocks."""
    x = x / np.linalg.norm(x, axis=1)[:, None]
    y = np.rint(x @ rotation(x.shape[1]) * SCALE).astype(np.int16)
    more = -y.shape[1] % BLOCK
    return np.pad(y, ((0, 0), (0, more))) if more else y


def radii(dim: int, least: float) -> tuple[float, float]:
    """The block's radius, its error margin included, and the cells' width, in fixed-point units."""
    blocks = -(-dim // BLOCK)
    radius = math.sqrt(max(0.0, 2 - 2 * least) / blocks) + 2 * ERROR * math.sqrt(BLOCK) + 1e-9
    return radius * SCALE, CELL_RADII * radius * SCALE


def _ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and fixed-point form of every row; nulls where a vector takes no part."""
    for batch in batches:
        cids, codes, dims = [], [], []
        for label, v in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            ok = label is not None and v.is_valid and len(v) > 0 and v.values.null_count == 0
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if ok else None  # -0 becomes 0
            ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
            cids.append(int.from_bytes(hashlib.blake2b(f"{label}|{len(x)}|".encode() + x.tobytes(), digest_size=8).digest(), "little", signed=True) if ok else None)
            codes.append(fixed_point(scaled(x)[None, :])[0].tobytes() if ok else None)
            dims.append(len(x) if ok else None)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cids, pa.int64()), pa.array(dims, pa.int32()), pa.array(codes, pa.binary())], names=["vec_id", "label", "cid", "dim", "code"])


_CELL = "label string, dim int, block int, cell long, home boolean, cid long, m long, code binary"


def _cells(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                codes = np.frombuffer(b"".join(part.column(4).to_pylist()), np.int16).reshape(part.num_rows, -1)
                radius, width = radii(int(dim), least)
                for b in range(codes.shape[1] // BLOCK):
                    x = codes[:, b * BLOCK : (b + 1) * BLOCK].astype(np.float64)
                    lo, hi, at = (np.floor((x + d) / width).astype(np.int64) for d in (-radius, radius, 0.0))
                    for up in itertools.product((0, 1), repeat=BLOCK):
                        up = np.array(up, bool)
                        rows = np.flatnonzero(((hi > lo) | ~up).all(axis=1))
                        if not len(rows):
                            continue
                        cell = np.where(up, hi, lo)[rows]
                        home = (cell == at[rows]).all(axis=1)
                        key = ((cell[:, 0] * 100_003 + cell[:, 1]) * 100_003 + cell[:, 2]) * 100_003 + cell[:, 3]
                        take = part.take(pa.array(rows))
                        yield pa.record_batch([take.column(1), take.column(3), pa.array(np.full(len(rows), b, np.int32)), pa.array(key), pa.array(home), take.column(0), take.column(2), take.column(4)], names=[f.split()[0] for f in _CELL.split(", ")])

    return run


_FOUND = "kind string, u long, v long, n long"


def _links(least: float):
    budget_total = max(0.0, 2 - 2 * least)

    def run(group: pa.Table) -> pa.Table:
        dim, block = group["dim"][0].as_py(), group["block"][0].as_py()
        cid, home = group["cid"].to_numpy(), group["home"].to_numpy(zero_copy_only=False)
        m, side = group["m"].to_numpy(), group["side"].to_numpy()
        one_part = group["i"][0].as_py() == group["j"][0].as_py()
        codes = np.frombuffer(b"".join(group["code"].to_pylist()), np.int16).reshape(len(cid), -1).astype(np.float32)
        radius, _ = radii(dim, least)
        n_blocks = codes.shape[1] // BLOCK
        near = math.sqrt(budget_total) * SCALE
        slack = (2 * ERROR * math.sqrt(codes.shape[1]) + 1e-6) * SCALE
        mine = codes[:, block * BLOCK : (block + 1) * BLOCK]
        norm = (mine * mine).sum(axis=1)
        count, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
        open_u, open_v, link_a, link_b = [], [], [], []
        rows = np.flatnonzero(home)
        for k in range(0, len(rows), 128):
            a_rows = rows[k : k + 128]
            apart = norm[a_rows][:, None] + norm[None, :] - 2 * (mine[a_rows] @ mine.T)
            close = (apart <= radius * radius * 1.0001 + 64) & (cid[a_rows][:, None] < cid[None, :])
            if not one_part:
                close &= side[a_rows][:, None] != side[None, :]
            a_all, b_all = np.nonzero(close)
            for t in range(0, len(a_all), 20_000):
                a, b = a_rows[a_all[t : t + 20_000]], b_all[t : t + 20_000]
                square = ((codes[a] - codes[b]) ** 2).reshape(len(a), n_blocks, BLOCK).sum(axis=2)
                total = np.sqrt(square.sum(axis=1, dtype=np.float64))
                within = square <= np.float32(radius * radius)
                keep = (within.argmax(axis=1) == block) & within[:, block] & (total <= near + slack)
                sure = keep & (total < near - slack)
                link_a.append(a[sure].astype(np.int32))
                link_b.append(b[sure].astype(np.int32))
                open_u += cid[a[keep & ~sure]].tolist()
                open_v += cid[b[keep & ~sure]].tolist()
        if link_a:
            a, b = np.concatenate(link_a), np.concatenate(link_b)
            np.add.at(count, a, m[b])
            np.add.at(count, b, m[a])
            while True:  # every linked row takes the smallest place it can reach
                low = np.minimum(label[a], label[b])
                new = label.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
        has = np.flatnonzero(count)
        kinds = ["link"] * len(has) + ["open"] * len(open_u)
        return pa.table({"kind": pa.array(kinds, pa.string()), "u": pa.array([*cid[has].tolist(), *open_u], pa.int64()), "v": pa.array([*cid[label[has]].tolist(), *open_v], pa.int64()), "n": pa.array([*count[has].tolist(), *[0] * len(open_u)], pa.int64())})

    return run


def _exact(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = (scaled(z.values.to_numpy(zero_copy_only=False).astype(np.float64)) for z in (x, y))
                if float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= least:
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep)).select(["u", "v", "mu", "mv"])

    return run


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    each = written(rows.mapInArrow(_ready, "vec_id long, label string, cid long, dim int, code binary"), "vectors")
    classes = each.filter("cid is not null").groupBy("cid").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("m"), F.first("dim").alias("dim"), F.first("code").alias("code"))
    classes = written(classes, "vector-classes")
    cells = classes.select("cid", "label", "m", "dim", "code").mapInArrow(_cells(least), _CELL)
    cells = written(cells, "cells")
    where = ["label", "dim", "block", "cell"]
    large = cells.groupBy(*where).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > CELL_ROWS)
    large = large.select(*[F.col(c).alias(f"l_{c}") for c in where], F.ceil(F.col("size") / CELL_ROWS).cast("int").alias("parts"))
    dealt = cells.join(large, (F.col("label") == F.col("l_label")) & (F.col("dim") == F.col("l_dim")) & (F.col("block") == F.col("l_block")) & (F.col("cell") == F.col("l_cell")), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    # part s meets the pairs (s, t) and (t, s); every pair of parts is a task of its own
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    found = dealt.select(*where, "i", "j", "side", "home", "cid", "m", "code").groupBy(*where, "i", "j").applyInArrow(_links(least), _FOUND)
    found = written(found, "found")

    # pairs that the rounding bounds leave open, on one vector of each class
    pairs = found.filter("kind = 'open'").select("u", "v").distinct()
    if not pairs.isEmpty():
        full = rows.mapInArrow(_with_class, "c long, vector array<double>")
        ends = pairs.select(F.explode(F.array("u", "v")).alias("e")).distinct()
        full = written(full.join(F.broadcast(ends) if ends.count() <= 100_000 else ends, F.col("c") == F.col("e"), "left_semi").dropDuplicates(["c"]), "open-vectors")
        size = classes.select("cid", "m")
        wide = pairs.join(size.select(F.col("cid").alias("c1"), F.col("m").alias("mu")), F.col("u") == F.col("c1")).join(size.select(F.col("cid").alias("c2"), F.col("m").alias("mv")), F.col("v") == F.col("c2")).select("u", "v", "mu", "mv")
        wide = wide.join(full.select(F.col("c").alias("f1"), F.col("vector").alias("x")), F.col("u") == F.col("f1")).join(full.select(F.col("c").alias("f2"), F.col("vector").alias("y")), F.col("v") == F.col("f2"))
        sure = written(wide.select("u", "v", "mu", "mv", "x", "y").mapInArrow(_exact(least), "u long, v long, mu long, mv long"), "exact")
        more = sure.select("u", "v", F.col("mv").alias("n")).unionByName(sure.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("mu").alias("n")))
        found = found.filter("kind = 'link'").select("u", "v", "n").unionByName(more)
    else:
        found = found.select("u", "v", "n")
    counts = found.groupBy(F.col("u").alias("x")).agg(F.sum("n").alias("links"))
    comp = components(found.select("u", "v")).withColumnRenamed("node", "y")
    same = classes.select(F.col("cid").alias("z"), "m")
    of = each.select("vec_id", "cid").join(same, F.col("cid") == F.col("z"), "left").join(counts, F.col("cid") == F.col("x"), "left").join(comp, F.col("cid") == F.col("y"), "left")
    of = of.select("vec_id", F.coalesce("comp", "cid").alias("comp"), (F.coalesce(F.col("m") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    least_id = of.filter("comp is not null").groupBy(F.col("comp").alias("k")).agg(F.min("vec_id").alias("least"))
    out = of.join(least_id, F.col("comp") == F.col("k"), "left").select("vec_id", "n_links", F.when(F.col("comp").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and vector of the rows that take part."""
    for batch in batches:
        for ready in _ready(iter([batch])):
            ok = ready.column(2).is_valid()
            yield pa.record_batch([ready.column(2).filter(ok), batch.column(2).filter(ok).cast(pa.list_(pa.float64()))], names=["c", "vector"])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
comp AS (SELECT u, min(w) AS c FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(comp.c, e.vec_id) AS component_id,
       coalesce(comp.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN comp ON e.vec_id = comp.u LEFT JOIN n ON e.vec_id = n.u
"""
