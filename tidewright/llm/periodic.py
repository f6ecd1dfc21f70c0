"""Periodic runs of words: maximal stretches that repeat a phrase at least ``times`` times, found on suffix trees.

Words of a block of texts are numbered. Stretches that can hold no run go first (below); the suffixes of the others are sorted by
prefix doubling, and their suffix tree is walked from its leaves up. At a node of depth d, with a smaller and a larger side, the
leaf list of the smaller side alone is read: a leaf i of it whose partner i + d or i - d is a leaf of the other side begins (or
ends) a branching tandem repeat, two copies of d words whose next words differ. As every pair of leaves that part at a node has
one of them in the smaller side, all are found in n log n steps. Each is then rotated to the left as far as its words repeat, which
gives a maximal run; of those with equal ends, which repeat one phrase in multiples, the least period stays. Nothing is shuffled.

Stretches that can hold no run: inside a run of period q and at least 2 q + 2 words, every three words running stand again q words
before or after. For periods of each doubling, stretches of places whose three words stand again within the longest of its periods
and that are long enough for its shortest are kept; every run lies within one such stretch.

Bounds: a block holds about 2 MB of text, or one longer text; of a text's kept words, memory holds about 100 bytes and 4 for each
doubling of the longest repeat. Leaf lists are read in parts of ``LEAVES``.

Defined cases: a null or empty text has no words and no runs; words are told apart by their bytes; rows are taken each for itself,
so repeated rows and null ids are kept; an empty table gives no rows; only the columns in ``keep`` are carried, of any name but
those of the result (n_words, runs, collapsed), which are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import blocks, mixed, raw, small_batches, table, words

#: A run has at least so many words, and its period so many times.
LEAST, TIMES = 6, 4
BLOCK_BYTES = 2 << 20
LEAVES = 1 << 20
#: Words that are looked at together; runs of three stand again a period away in every run of 2 q + 2 words.
_TOGETHER = 3


def _stretches(flags: np.ndarray, least: int) -> np.ndarray:
    """(begin, end) of maximal stretches of true values of at least that length."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    pairs = edges.reshape(-1, 2)
    return pairs[pairs[:, 1] - pairs[:, 0] >= least]


def candidates(codes: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(begin, end) of stretches of words, none across texts, that hold every run."""
    n = len(codes)
    if n < least:
        return np.zeros((0, 2), np.int64)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    key = mixed(codes.astype(np.uint64) + (owner.astype(np.uint64) << np.uint64(32)))
    for _ in range(_TOGETHER - 1):
        nxt = np.concatenate([key[1:], [0]]).astype(np.uint64)
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + nxt)
    # the last places of a text have no three words of their own
    m = n - _TOGETHER + 1
    inside = np.concatenate([owner[:m] == owner[_TOGETHER - 1 :], np.zeros(_TOGETHER - 1, bool)])
    bits = np.uint64(max(20, int(n).bit_length()))
    packed = np.sort((key & ~((np.uint64(1) << bits) - np.uint64(1))) | np.arange(n, dtype=np.uint64))
    at = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    same = packed[1:] >> bits == packed[:-1] >> bits
    far = np.iinfo(np.int32).max
    gap = np.where(same, np.minimum(np.diff(at), far), far).astype(np.int32)
    near = np.full(n, far, np.int32)
    near[at[1:]] = gap
    near[at[:-1]] = np.minimum(near[at[:-1]], gap)
    near[~inside] = far
    keep = np.zeros(n + 1, np.int32)
    longest, q = int(np.diff(ends).max(initial=0)), 1
    while times * q <= longest:
        # places of runs with a period from q to 2 q - 1; texts are parted by the places that have no three words
        found = _stretches(near <= 2 * q - 1, max(least, times * q) - _TOGETHER + 1)
        np.add.at(keep, found[:, 0], 1)
        np.add.at(keep, found[:, 1] + _TOGETHER - 1, -1)
        q *= 2
    held = np.cumsum(keep[:-1]) > 0
    # stretches of neighbouring texts may touch
    parts = _stretches(held, least)
    cuts = ends[1:-1]
    inner = cuts[np.searchsorted(parts[:, 0], cuts, "right") > np.searchsorted(parts[:, 1], cuts, "right")]
    begins, stops = np.sort(np.concatenate([parts[:, 0], inner])), np.sort(np.concatenate([parts[:, 1], inner]))
    pairs = np.stack([begins, stops], axis=1)
    return pairs[pairs[:, 1] - pairs[:, 0] >= least]


class SuffixTree:
    """Suffixes of several strings, no word of which occurs in another of them, and the tree of their common prefixes.

    ``levels[k][i]`` ranks the 2 ** k words from i on; the last level tells all suffixes apart."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray):
        n = self.n = len(codes)
        self.owner = owner
        stop = np.searchsorted(owner, owner, "right")  # where the string of each place ends
        _, first = np.unique(owner.astype(np.int64) << 32 | codes, return_inverse=True)
        rank, width = first.astype(np.int64) + 1, 1
        self.levels = []
        while True:
            self.levels.append(np.append(rank, 0).astype(np.int32))
            if rank.max(initial=0) == n:
                break
            then = np.zeros(n, np.int64)
            more = np.arange(n) + width < stop
            then[more] = rank[np.flatnonzero(more) + width]
            key = rank * (n + 1) + then
            order = np.argsort(key, kind="stable")
            new = np.ones(n, np.int64)
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            width *= 2
        self.place = rank - 1
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[self.place] = np.arange(n)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, which differ."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            step = (level[a] == level[b]).astype(np.int64) << k
            a, b, total = a + step, b + step, total + step
        return total

    def extended(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How far to the left the words before ``at`` equal those a period later."""
        moved = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, to = self.levels[k], moved - (1 << k)
            ok = to >= 0
            ok[ok] = (level[to[ok]] == level[to[ok] + period[ok]]) & (self.owner[to[ok]] == self.owner[at[ok]])
            moved = np.where(ok, to, moved)
        return moved

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Depth of every inner node but the root, where its leaves begin, where its right side begins, and where they end.
        A node of several children is a chain of nodes of one depth with two sides each."""
        depth = np.zeros(self.n, np.int64)
        depth[1:] = self.common(self.suffixes[:-1], self.suffixes[1:])
        left, right = [0] * self.n, [self.n] * self.n
        open_at, open_depth = [0], [-1]
        for k, d in enumerate(depth.tolist()):
            if not k:
                continue
            while open_depth[-1] > d:
                right[open_at.pop()] = k
                open_depth.pop()
            left[k] = open_at[-1]
            open_at.append(k)
            open_depth.append(d)
        inner = np.flatnonzero(depth > 0)
        return depth[inner], np.array(left, np.int64)[inner], inner, np.array(right, np.int64)[inner]

    def branching_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and period of all branching tandem repeats, from the smaller side's leaf list of every node."""
        depth, low, middle, high = self.nodes()
        small_left = middle - low <= high - middle
        begin, end = np.where(small_left, low, middle), np.where(small_left, middle, high)
        other, stop = np.where(small_left, middle, low), np.where(small_left, high, middle)
        sizes = np.cumsum(end - begin)
        starts, periods, a = [], [], 0
        while a < len(depth):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + LEAVES, "right")))
            count = (end - begin)[a:b]
            node = np.repeat(np.arange(a, b), count)
            leaf = self.suffixes[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + begin[node]]
            for way in (1, -1):
                partner = leaf + way * depth[node]
                ok = (partner >= 0) & (partner < self.n)
                at = self.place[np.where(ok, partner, 0)]
                ok &= (at >= other[node]) & (at < stop[node])
                starts.append(np.minimum(leaf, partner)[ok])
                periods.append(depth[node][ok])
            a = b
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(periods)

    def runs(self, least: int, times: int) -> np.ndarray:
        """(start, length, period) of all runs, by start and period."""
        at, period = self.branching_repeats()
        start = self.extended(at, period)
        end = at + 2 * period
        found = np.unique(np.stack([start, end, period], axis=1), axis=0)
        if len(found):
            # of equal stretches the least period comes first
            found = found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])]
        length = found[:, 1] - found[:, 0]
        found, length = found[ok := (length >= least) & (length >= times * found[:, 2])], length[ok]
        out = np.stack([found[:, 0], length, found[:, 2]], axis=1)
        return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(codes: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs in the texts of numbered words; starts are places in the block."""
    if times < 3 or least < 6:
        raise ValueError("a run has at least six words and three of its periods")
    parts = candidates(codes, ends, least, times)
    if not len(parts):
        return np.zeros((0, 3), np.int64)
    sizes = parts[:, 1] - parts[:, 0]
    owner = np.repeat(np.arange(len(parts)), sizes)
    shift = np.repeat(parts[:, 0] - (np.cumsum(sizes) - sizes), sizes)
    found = SuffixTree(codes[np.arange(len(owner)) + shift].astype(np.int64), owner).runs(least, times)
    found[:, 0] += shift[found[:, 0]]
    return found


def _block(texts: pa.Array, least: int, times: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of words, runs, and the text without repeats, of each text."""
    body, bounds = raw(texts)
    found, ends = words(body, bounds)
    codes = found.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    runs = runs_of(codes, ends, least, times)
    per_text = np.searchsorted(runs[:, 0], ends).astype(np.int32)
    owner = np.repeat(np.arange(len(texts)), np.diff(per_text))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    columns = [runs[:, 0] - ends[owner], runs[:, 1], runs[:, 2]]
    lists = pa.ListArray.from_arrays(pa.array(per_text), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(kind)))
    gone = np.zeros(len(codes) + 1, np.int32)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(gone[:-1]) == 0
    left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)])[ends], pa.int32()), found if kept.all() else found.filter(pa.array(kept)))
    return np.diff(ends), lists, pc.binary_join(left, b" ")


RUN = "array<struct<start:long,length:long,period:long>>"


def find(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns ``keep``, the number of words, all runs, and the words that are no repeat in a run, joined by one blank."""
    new = ("n_words", "runs", "collapsed")
    if len({*keep, *new}) < len(keep) + len(new) or any(docs.columns.count(c) != 1 for c in keep):
        raise ValueError(f"columns {keep} and {new} must be distinct, and each be there once")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "\x00text", BLOCK_BYTES):
            n_words, runs, left = _block(batch.column(batch.num_columns - 1), least, times)
            yield pa.record_batch([*batch.columns[:-1], pa.array(n_words), runs, left.view(pa.string())], names=[*keep, *new])

    rows = docs.select(*(docs[f"`{c}`"] for c in keep), docs[f"`{text}`"].cast("string").alias("\x00text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*kinds, "n_words long", f"runs {RUN}", "collapsed string"]))


def repeated_tails(doc_id: Column, text: Column) -> Column:
    """The text, whose words from some place on repeat the first of them where the id's checksum ends in 0."""
    quotient = lambda x, y: ((x - x % y) / y).cast("long")
    h = F.crc32(doc_id.cast("string"))
    found = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, g = F.size(found), quotient(h, F.lit(10))
    a = g % F.greatest(n, F.lit(1))
    p = 1 + quotient(n - a, 3 + g % 8)
    # an array of one bound value, as the words would be split anew for every place
    bound = F.array(F.struct(found.alias("w"), a.alias("a"), p.alias("p")))
    place = lambda x, i: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int")
    folded = F.transform(bound, lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.size(x["w"]) - 1), lambda i: F.get(x["w"], place(x, i))), " "))
    return F.when((h % 10 == 0) & (n > 0), F.get(folded, F.lit(0))).otherwise(text)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs.withColumn("text", repeated_tails(F.col("doc_id"), F.col("text"))))
    # of the runs by start and period, the first with the greatest length to period
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        ((1000 * F.col("best.length") - 1000 * F.col("best.length") % F.col("best.period")) / F.col("best.period")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


#: The definition in plain SQL: stretches of equal words a period apart, by every period. The checksum is worked out bit by bit.
OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(doc_id::VARCHAR)), lambda i: ord(substr(doc_id::VARCHAR, i::INTEGER + 1, 1))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM documents),
n AS (SELECT r, doc_id, w, len(w) AS n, coalesce(h % 10 = 0, false) AND len(w) > 0 AS folds, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN folds THEN g % n ELSE n END AS a, CASE WHEN folds THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM n),
i AS (SELECT r, doc_id, w, n, a, p, unnest(range(n)) AS i FROM a),
o AS (SELECT r, n, i, w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS w FROM i),
s AS (SELECT x.r, x.i, y.i - x.i AS q FROM o AS x JOIN o AS y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
k AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM s),
e AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM k GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
t AS (SELECT r, s, l, min(q) AS q FROM e GROUP BY r, s, l),
b AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, arg_min(struct_pack(s := s, l := l, q := q), struct_pack(x := -(l / q), s := s, q := q)) AS best FROM t GROUP BY r),
c AS (SELECT o.r, string_agg(o.w, ' ' ORDER BY o.i) AS kept FROM o LEFT JOIN (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM t) AS x ON x.r = o.r AND x.i = o.i WHERE x.r IS NULL GROUP BY o.r)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON d.r = b.r LEFT JOIN c ON d.r = c.r
"""
