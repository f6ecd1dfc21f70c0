"""MinHash near-duplicates by a multi-index Hamming join.

Every distinct shingle set (one *class*, however many documents have it) gets a signature of ``CHUNKS * CHUNK`` 16-bit
symbols. Two signatures that differ in fewer than ``2 * CHUNKS`` symbols have a chunk with at most one differing symbol, so
enumerating the allowed error of each chunk (the chunk without one of its symbols, for each of them) gives keys of which
such a pair shares one: no pair under that distance is missed. At a similarity of 0.8 a pair without a common key has a
chance of 4e-8. Pairs with a common key go on if sizes allow 0.8 and a second signature of 256 bits differs in at most
``BITS_APART`` (at 0.8: mean 25.6, deviation 4.8), and are confirmed on their full sets.

Not all pairs of a bucket are needed for components. ``STARS`` rounds test each bucket's members against one of them, at first
the one that shares most keys with others and then one drawn anew each round, and merge what is confirmed; a large group of copies mostly falls into one component, at one test per
member. The last round tests what is left exactly. Two classes that are still alone are tested if they share a key: pair by pair
where few do, else in tasks of bounded size that give one edge for each class that has a link. A class that shares a key with a larger component visits it: tasks of bounded size compare some visitors with some members, and give
one link for each visitor that has any; no list of pairs is made.

Defined cases: a text without words, or null, has no shingles and links with nothing; with fewer words than ``width`` its
whole sequence is its one shingle; rows with equal id count as one document; a null id takes part and never names a
component unless all ids in it are null. ``deduplicated`` judges each row by its own text, whatever other rows its id has:
a component keeps one row, of the smallest id (a null one only if there is no other); rows without shingles all stay, but
those of one id and text only once; extra columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import WordHash, blocks, lean, mixed, removed, small_batches, table, written
from tidewright.llm.graph import components
from tidewright.llm.shingles import shingle_sets, signatures

CHUNKS, CHUNK = 10, 4
BITS = 256
BITS_APART = 52
STARS = 2
#: Members and visitors of a component that one task of the last round compares.
MEMBERS, VISITORS = 512, 256
#: Lone classes of one key up to which their pairs are listed; beyond, tasks of bounded size compare them.
LISTED = 12
#: Ids of documents whose sets are needed are broadcast up to this count, 16 bytes each.
BROADCAST_IDS = 1_000_000

_CLASS = "doc_id long, h long, n long, cid long, symbols binary, s1 long, s2 long, s3 long, s4 long"
_BITS = ["s1", "s2", "s3", "s4"]


def _cid(part: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8).digest(), "little", signed=True)


def _classes(width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for block in blocks(batches):
            sets, at = shingle_sets(block.column(1), width, hashed)
            all_ = signatures(sets, at, BITS)
            bits = np.packbits((all_ & 1).astype(np.uint8), axis=1).view(np.int64)
            symbols = np.ascontiguousarray(all_[:, : CHUNKS * CHUNK])
            n = np.diff(at)
            cids = [_cid(sets[a:b]) if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([block.column(0), block.column(2), pa.array(n), pa.array(cids, pa.int64()), pa.array([x.tobytes() for x in symbols], pa.binary()), *(pa.array(bits[:, k].copy()) for k in range(len(_BITS)))], names=["doc_id", "h", "n", "cid", "symbols", *_BITS])

    return run


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """The keys of each signature: every chunk without each one of its symbols."""
    n = len(symbols)
    wide = symbols.reshape(n, CHUNKS, CHUNK).astype(np.uint64)
    out = np.empty((n, CHUNKS, CHUNK), np.uint64)
    for left_out in range(CHUNK):
        key = np.zeros((n, CHUNKS), np.uint64)
        for k in range(CHUNK):
            if k != left_out:
                key = key * np.uint64(65536) + wide[:, :, k]
        place = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(left_out)
        out[:, :, left_out] = mixed(key * np.uint64(CHUNKS * CHUNK) + place[None, :])
    return out.reshape(n, CHUNKS * CHUNK)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            keys = chunk_keys(symbols)
            yield pa.record_batch([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "cid"])


def _set_rows(width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for block in blocks(batches):
            sets, at = shingle_sets(block.column(0), width, hashed)
            parts = [sets[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if b > a]
            yield pa.record_batch([pa.array([_cid(x) for x in parts], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["c", "shingles"])

    return run


def _confirm(percent: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            if keep:
                found = batch.take(pa.array(keep))
                yield pa.record_batch([found.column(0), found.column(1)], names=["u", "v"])

    return run


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the similarity, and near second signatures."""
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _BITS), F.lit(0))
    return sizes & (apart <= BITS_APART)


def _visits(percent: int):
    def run(unit: pa.Table) -> pa.Table:
        """One link (visitor, member) for each visitor that is similar enough to a member."""
        cid, visitor = unit["cid"].to_numpy(), unit["visitor"].to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in unit["shingles"]]
        members = np.flatnonzero(~visitor)
        out_u, out_v = [], []
        if len(members):
            hits = _met(sets, members, percent)
            for i in np.flatnonzero(visitor):
                found = hits(sets[i])
                if len(found):
                    out_u.append(cid[i])
                    out_v.append(cid[found[0]])
        return pa.table({"u": pa.array(out_u, pa.int64()), "v": pa.array(out_v, pa.int64())})

    return run


def _met(sets: list[np.ndarray], members: np.ndarray, percent: int):
    """A function from a set to the places in ``members`` of the similar ones."""
    sizes = np.array([len(sets[i]) for i in members], np.int64)
    flat, owner = np.concatenate([sets[i] for i in members]), np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]

    def hits(x: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        n = hi - lo
        places = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        both = np.bincount(owner[places], minlength=len(members))
        return members[100 * both >= percent * (sizes + len(x) - both)]

    return hits


def _among(percent: int):
    def run(unit: pa.Table) -> pa.Table:
        """An edge for each class that is similar to another in the unit, to the first one it reaches."""
        cid, side = unit["cid"].to_numpy(), unit["side"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in unit["shingles"]]
        label = np.arange(len(cid))
        first, second = np.flatnonzero(side == unit["i"][0].as_py()), np.flatnonzero(side == unit["j"][0].as_py())
        a, b = [], []
        if len(first) and len(second):
            hits = _met(sets, second, percent)
            for i in first:
                found = hits(sets[i])
                a.append(np.full(len(found), i))
                b.append(found)
            a, b = np.concatenate(a), np.concatenate(b)
            while True:
                low, new = np.minimum(label[a], label[b]), label.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
        moved = np.flatnonzero(label != np.arange(len(cid)))
        return pa.table({"u": pa.array(cid[moved]), "v": pa.array(cid[label[moved]])})

    return run


def _pairs_confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    pairs = written(pairs.select(F.least("a.cid", "b.cid").alias("u"), F.greatest("a.cid", "b.cid").alias("v")).distinct(), "pairs")
    full = pairs.join(sets, F.col("u") == F.col("c")).select("u", "v", F.col("shingles").alias("x")).join(sets, F.col("v") == F.col("c")).select("u", "v", "x", F.col("shingles").alias("y"))
    return full.mapInArrow(_confirm(percent), "u long, v long")


def _last_round(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a key: all there are between lone classes, one or none for each visitor."""
    # sizes meet the classes, one row each, and not their keys: a large component then makes no large task
    large = comp.groupBy(F.col("comp").alias("g")).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sized = written(comp.join(large, F.col("comp") == F.col("g")).select("node", "comp", "size"), "sizes")
    m = members.join(sized, F.col("cid") == F.col("node"), "left").withColumns({"comp": F.coalesce("comp", "cid"), "size": F.coalesce("size", F.lit(1))}).drop("node")
    m = written(m, "sized")
    alone = m.filter("size = 1").drop("size")
    per_key = alone.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("lone"), F.min("cid").alias("hub")).filter("lone > 1")
    alone = written(alone.join(per_key, F.col("key") == F.col("k")).drop("k"), "alone")
    few = alone.filter(F.col("lone") <= LISTED)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.cid") < F.col("b.cid")) & _may_link("a", "b", percent))
    lone = _pairs_confirmed(pairs, sets, percent)
    # many: all that share a key share its hub, the smallest of them, and meet there
    meet = written(alone.filter(F.col("lone") > LISTED).select("cid", "hub").distinct(), "hubs")
    counts = meet.groupBy(F.col("hub").alias("h")).agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("parts"))
    dealt = meet.join(counts, F.col("hub") == F.col("h")).withColumn("side", F.pmod(F.xxhash64("cid", F.lit(23)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    groups = dealt.join(sets, F.col("cid") == F.col("c")).select("hub", "i", "j", "side", "cid", "shingles")
    lone = lone.unionByName(groups.groupBy("hub", "i", "j").applyInArrow(_among(percent), "u long, v long"))
    hosts = m.filter("size > 1").groupBy(F.col("key").alias("k"), F.col("comp").alias("host")).agg(F.first("size").alias("host_size"), F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    smaller = (F.col("size") < F.col("host_size")) | ((F.col("size") == F.col("host_size")) & (F.col("comp") < F.col("host")))
    fits = (100 * F.col("n") >= percent * F.col("n_min")) & (100 * F.col("n_max") >= percent * F.col("n"))
    visits = m.join(hosts, (F.col("key") == F.col("k")) & smaller & fits).select("cid", "host", "host_size").distinct()
    visits = written(visits, "visits")
    parts = visits.groupBy(F.col("host").alias("h")).agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("v_parts"), F.ceil(F.first("host_size") / MEMBERS).cast("int").alias("m_parts"))
    parts = written(parts, "parts")
    part = lambda n: F.pmod(F.xxhash64("cid", F.lit(17)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(parts, F.col("host") == F.col("h")).select("host", part("v_parts").alias("vp"), every("m_parts").alias("mp"), "cid", F.lit(True).alias("visitor"))
    right = comp.select(F.col("node").alias("cid"), F.col("comp").alias("host")).join(parts, F.col("host") == F.col("h")).select("host", every("v_parts").alias("vp"), part("m_parts").alias("mp"), "cid", F.lit(False).alias("visitor"))
    units = left.unionByName(right).join(sets, F.col("cid") == F.col("c")).select("host", "vp", "mp", "cid", "visitor", "shingles")
    found = units.groupBy("host", "vp", "mp").applyInArrow(_visits(percent), "u long, v long")
    return lone.unionByName(found)


def _grouped(docs: DataFrame, key: str, text: str, width: int, percent: int, by_id: bool) -> DataFrame:
    """One row per document: doc_id, the text's hash h, n and comp, null without shingles; ``by_id`` links the texts of one id."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), _text_hash(text).alias("h"))
    each = written(rows.mapInArrow(_classes(width), _CLASS), "signatures")
    classes = each.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("symbols").alias("symbols"), *[F.first(x).alias(x) for x in _BITS])
    classes = written(classes, "classes")
    keys = written(classes.select("cid", "symbols").mapInArrow(_keys, "key long, cid long"), "keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("key").alias("k"), "c")
    shared_keys = members = written(keys.join(shared, F.col("key") == F.col("k")).select("key", "cid", "c"), "shared")
    # how many others a class meets over all its keys: the middle of a group of copies meets most
    meets = members.groupBy(F.col("cid").alias("m")).agg(F.sum("c").alias("meets"))
    info = classes.select(F.col("cid").alias("c"), "n", *_BITS).join(meets, F.col("c") == F.col("m")).drop("m")
    members = written(members.drop("c").join(info, F.col("cid") == F.col("c")).drop("c"), "buckets")

    # full sets, of one document for each class that shares a bucket
    need = classes.join(members.select(F.col("cid").alias("c")).distinct(), F.col("cid") == F.col("c"), "left_semi").select(F.col("rep").alias("r")).distinct()
    need = written(need, "need")
    if need.count() <= BROADCAST_IDS:
        need = F.broadcast(need)
    sets = written(rows.join(need, F.col("doc_id").eqNullSafe(F.col("r")), "left_semi").select("text").mapInArrow(_set_rows(width), "c long, shingles binary").dropDuplicates(["c"]), "sets")

    # classes of documents with one id count as one from the start
    links = each.filter("cid is not null and doc_id is not null").join(each.groupBy(F.col("doc_id").alias("d")).agg(F.min("cid").alias("v"), F.max("cid").alias("w")).filter("v <> w"), F.col("doc_id") == F.col("d")).select(F.col("cid").alias("u"), "v")
    if not by_id:
        links = spark.createDataFrame([], "u long, v long")
    links = written(links.distinct(), "confirmed")
    comp = written(components(links), "components")
    for k in range(STARS + 1):
        if k < STARS:
            with_comp = members.join(comp, F.col("cid") == F.col("node"), "left").select("key", "cid", "n", *_BITS, "meets", F.coalesce("comp", "cid").alias("comp"))
            with_comp = written(with_comp, "members")
            heads = with_comp.groupBy(F.col("key").alias("k")).agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min(F.struct((F.xxhash64("cid", F.lit(k)) if k else -F.col("meets")).alias("h"), "cid", "n", *_BITS, "comp")).alias("head")).filter("x <> y")
            a, b = with_comp.alias("a"), heads.select("k", "head.cid", "head.n", *[f"head.{x}" for x in _BITS], "head.comp").alias("b")
            pairs = a.join(b, (F.col("a.key") == F.col("b.k")) & (F.col("a.comp") != F.col("b.comp")) & _may_link("a", "b", percent))
            found = written(_pairs_confirmed(pairs, sets, percent), "confirmed")
            removed(with_comp)
        else:
            found = written(_last_round(members, comp, sets, percent), "confirmed")
        if found.isEmpty():
            continue
        # what was merged before, and the new links between its components
        old = comp.select(F.col("node").alias("u"), F.col("comp").alias("v"))
        comp, before = written(components(old.unionByName(found)), "components"), comp
        removed(found, before)
    # what follows reads only the classes of the rows and their components
    removed(classes, keys, shared_keys, members, sets, links)

    return each.join(comp, F.col("cid") == F.col("node"), "left").select("doc_id", "h", "n", F.coalesce("comp", "cid").alias("comp"))


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    of = _grouped(docs, key, text, width, percent, by_id=True)
    least = of.filter("comp is not null").groupBy(F.col("comp").alias("m")).agg(F.min("doc_id").alias("least"))
    out = of.join(least, F.col("comp") == F.col("m"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns: of each component of texts one row, of the smallest id."""
    rows = written(_grouped(docs, key, text, width, percent, by_id=False).groupBy("doc_id", "h", "comp").agg(F.count(F.lit(1)).alias("copies")), "verdicts")
    best = rows.filter("comp is not null").groupBy(F.col("comp").alias("m")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best"))
    judged = rows.join(best, F.col("comp") == F.col("m"), "left")
    stays = F.col("comp").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h")))
    judged = written(judged.select(F.col("doc_id").alias("id"), "h", stays.alias("stays"), ((F.col("copies") > 1) & (F.col("comp").isNotNull() | F.col("doc_id").isNotNull())).alias("again")), "judged")
    # names that no column of a stored table has
    id_, hash_ = "\x00id", "\x00hash"
    same = F.col(key).cast("long").eqNullSafe(F.col(f"`{id_}`")) & (_text_hash(text) == F.col(f"`{hash_}`"))
    left = docs.join(judged.filter("not stays").select("id", "h").toDF(id_, hash_), same, "left_anti")
    again = judged.filter("stays and again").select("id", "h").toDF(id_, hash_)
    if again.isEmpty():
        return left
    # only rows that are repeated as a whole are dealt out to find one of each
    once = left.join(again, same, "left_semi").dropDuplicates([key, text])
    return left.join(again, same, "left_anti").unionByName(once)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
