"""LM scoring by a probabilistic suffix tree over words.

States are contexts of up to ``DEPTH`` words, told apart by their suffixes. The root is the add-one unigram distribution.
A context one word longer is a candidate if it and the word after it make up at least ``P_MIN`` of all training tokens;
as shares add up to one, no level has more than ``1 / P_MIN`` candidates, whatever the corpus, so these, the head, are broadcast. A
context is retained if its next-word distribution diverges from that of its longest shorter suffix by at least ``TEST``
nats in all over its occurrences. Its distribution is smoothed: absolute discounting, and what is left goes to the
parent's distribution, so every distribution sums to one. A text's score takes, at each token, the longest retained
suffix of what was read before (a text begins after an end token).

Contexts below that share are the tail, which grows with the corpus: wherever the longest context of the head is shorter than
``DEPTH``, all longer contexts, up to ``DEPTH`` words, are learned from all their occurrences, with the same test and smoothing;
words after them need ``LEAST`` occurrences, whatever the size of the corpus. The tail is never gathered in one place: every such place in a text goes by the hash of its longer
context to one of many parts, which counts, tests and scores; what it adds to each text's score comes back, in single
precision. A place is sent as the number of the head's context, the ranks of the words before it (a hash for each that is none
of the known words), the rank of the word after it (hash and count, if it is not known), and its text; the part finds the head's
probabilities itself. Not sent are contexts with a word that occurs less than ``LEAST`` times, as none of them has a word to
learn. No part is hot, as a context of the tail makes up less than ``P_MIN`` of all training tokens.

Texts are split into words once: every block of texts is written as the hashes of its distinct words and the numbers of its
tokens among them, about 3.5 bytes a token. All passes read these: first words and hashed pairs (pairs only as counts of
``BUCKETS`` buckets, which tells the pairs that can be frequent); then, level by level, exact counts of the runs that extend a
candidate; at last the scores. All counts are gathered by shuffles that grow with the input. Of the unigrams, the most
frequent words are broadcast: those that make up ``P_MIN``, and others while all are ``KNOWN`` at most. The other words of each
block are joined with the table of all words, and the block is written again with their counts, so ``c`` is exact for each.

Defined cases: a null or empty text is one end token; without training tokens every base term is log10(1/1); a null id is
never held out; rows that are repeated are counted as often in training and scored alike; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import WordHash, blocks, coded, freed_shuffles, lean, lowered, mixed, raw, removed, small_batches, table, words, written

DEPTH = 3
P_MIN = 1e-6
LEAST = 3
TEST = 40.0
DISCOUNT = 0.5
KNOWN = 300_000
BUCKETS = 1 << 22
_PARTS = 64
#: Keys gathered before they are counted together.
_GATHER = 500_000
#: Training tokens for each part of the tail.
_PART_TOKENS = 500_000
#: Parts of the tail at most, and the bits of contexts and ranks: parts, the head's contexts and ranks share 64 bits.
_PARTS_MOST, _CONTEXT_BITS, _RANK_BITS = 1 << 21, 23, 20
#: Stands for the rank of a word that is not known.
UNKNOWN = (1 << _RANK_BITS) - 1
#: Stands for the rank of a word that a context does not have, and of one whose hash and count are given.
NONE, LISTED = UNKNOWN - 1, UNKNOWN - 2
#: Rows of one Arrow batch.
_ROWS = 1 << 16

#: The number of the end token's own hash; no word has a blank in it.
END = b" end"


def token_codes(texts: pa.Array, hashed: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all tokens among the block's distinct ones, an end token after each text's words; the hashes of the
    distinct ones; and the texts' n + 1 offsets."""
    body, ends = raw(texts)
    found, at = words(lowered(body), ends)
    codes, distinct = coded(found)
    h = hashed([*distinct, END]).view(np.int64)
    bounds = at + np.arange(len(at))
    out = np.empty(int(bounds[-1]), np.int32)
    last = np.zeros(len(out), bool)
    last[bounds[1:] - 1] = True
    out[last] = len(distinct)
    out[~last] = codes
    return out, h, bounds


_BLOCK = "doc_id array<long>, held array<boolean>, sizes array<long>, codes binary, words binary"


@lean
def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of texts: its documents, the numbers of its tokens in two planes of 16 bits, and its words' hashes."""
    hashed = WordHash(200_000)
    for block in blocks(batches):
        codes, h, at = token_codes(block.column(2), hashed)
        planes = np.stack([codes & 0xFFFF, codes >> 16]).astype("<u2").tobytes()
        lists = [pa.array([x.to_pylist()], pa.list_(t)) for x, t in zip(block.columns[:2], (pa.int64(), pa.bool_()), strict=True)]
        yield pa.record_batch([*lists, pa.array([np.diff(at).tolist()], pa.list_(pa.int64())), pa.array([pa.compress(planes, "zstd", asbytes=True)], pa.binary()), pa.array([h.tobytes()], pa.binary())], names=[x.split()[0] for x in _BLOCK.split(", ")])


def _read(batches: Iterator[pa.RecordBatch], training: bool) -> Iterator[tuple]:
    """(row, codes, h, at) of each block, as ``token_codes`` gives them; of its texts for training alone, if that is asked for."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            sizes, h = row["sizes"].values.to_numpy(), np.frombuffer(row["words"].as_buffer(), np.int64)
            planes = np.frombuffer(pa.decompress(row["codes"].as_buffer(), 4 * int(sizes.sum()), "zstd"), "<u2").reshape(2, -1)
            codes = planes[0].astype(np.int32) | (planes[1].astype(np.int32) << 16)
            if training:
                mine = ~row["held"].values.to_numpy(zero_copy_only=False)
                codes, sizes = codes[np.repeat(mine, sizes)], sizes[mine]
            if len(sizes):
                yield row, codes, h, np.concatenate([[0], np.cumsum(sizes)])


def summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def _batches(keys: np.ndarray, n: np.ndarray, **more: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(key, n) rows in batches of bounded size, nulls in ``more``."""
    for i in range(0, len(keys), _ROWS):
        part = keys[i : i + _ROWS]
        yield pa.record_batch([pa.array(part), pa.array(n[i : i + _ROWS].astype(np.int64)), *(pa.nulls(len(part), t) for t in more.values())], names=["key", "n", *more])


def _gathered(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
    """(key, n) rows of what ``keys_of`` finds in each block, summed over many blocks at a time."""
    held, size = [], 0
    for _, codes, h, at in _read(batches, True):
        held.append(keys_of(codes, h, at))
        size += len(held[-1])
        if size > _GATHER:
            yield from _batches(*summed(np.concatenate(held)))
            held, size = [], 0
    if size:
        yield from _batches(*summed(np.concatenate(held)))


def before(tokens: np.ndarray, at: np.ndarray, first) -> np.ndarray:
    """What stands before each token; ``first`` at the begin of a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[at[:-1]] = first
    return out


def buckets(codes: np.ndarray, h: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """The bucket of each token and the one before it."""
    h = h.view(np.uint64)
    turned = mixed(h) * np.uint64(3)
    first = mixed(np.array([end], np.int64).view(np.uint64))[0] * np.uint64(3)
    return (mixed(before(turned[codes], at, first) + h[codes]) & np.uint64(BUCKETS - 1)).astype(np.int32)


@lean
def _words_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In one pass: (key, n) rows of words, and at the end (part, counts): the compressed parts of the counts of hashed pairs."""
    counts, held, size = np.zeros(BUCKETS, np.uint32), [], 0
    end, more = WordHash()([END]).view(np.int64)[0], {"part": pa.int32(), "counts": pa.binary()}
    for _, codes, h, at in _read(batches, True):
        n = np.bincount(codes, minlength=len(h))
        held.append((h[n > 0], n[n > 0]))
        size += len(held[-1][0])
        # a count of the buckets in use, so that no second table of all of them is needed
        found_in, pairs = np.unique(buckets(codes, h, at, end), return_counts=True)
        counts[found_in] += pairs.astype(np.uint32)
        if size > _GATHER:
            yield from _batches(*summed(*map(np.concatenate, zip(*held, strict=True))), **more)
            held, size = [], 0
    if size:
        yield from _batches(*summed(*map(np.concatenate, zip(*held, strict=True))), **more)
    width = BUCKETS // _PARTS
    for p in range(_PARTS):
        part = zlib.compress(counts[p * width : (p + 1) * width].tobytes(), 1)
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([p], more["part"]), pa.array([part], more["counts"])], names=["key", "n", *more])


def _frequent_buckets(threshold: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts come sorted by number; only one part's sum is held at a time."""
        now, total = None, None

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now]), pa.array([np.packbits(total >= threshold).tobytes()], pa.binary())], names=["part", "bits"])

        for batch in parts:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
                if part != now:
                    if now is not None:
                        yield done()
                    now, total = part, x.copy()
                else:
                    total += x
        if now is not None:
            yield done()

    return run


class Tree:
    """Known words, and per level the runs of level + 1 words that are frequent, with each context's share for its parent.

    A run of level k is known by the number of the run one shorter (without its last word) and its last word's number; runs
    of level 0 are the frequent words themselves."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, v: int, frequent: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.n, self.v, self.frequent = n, v, frequent
        number = np.full(len(order), -1, np.int64)
        often = np.flatnonzero(self.counts >= frequent)
        number[often] = np.arange(len(often))
        self.number, self.words = number, self.hashes[often]
        self.root = (self.counts[often] + 1.0) / (n + v + 1.0)
        #: known words by falling count, and back
        self.by_rank = np.lexsort((self.hashes, -self.counts)).astype(np.int32)
        self.rank = np.empty(len(order), np.uint32)
        self.rank[self.by_rank] = np.arange(len(order), dtype=np.uint32)
        self.end = WordHash()([END]).view(np.int64)[0]
        self.bits: np.ndarray | None = None
        #: per level: sorted keys, counts; the discounted share of the run's last word, and what its context leaves to the parent
        self.keys: list[np.ndarray] = []
        self.own: list[np.ndarray] = []
        self.left: list[np.ndarray] = []

    def known(self, tokens: np.ndarray) -> np.ndarray:
        """Places of tokens among the known words, -1 for others."""
        return found(self.hashes, tokens)

    def runs(self, number: np.ndarray, at: np.ndarray, end_number: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per level: tokens' places whose context is a run, that context's number, and the number of the run it makes (-1: none)."""
        where = np.flatnonzero(before(number, at, end_number) >= 0)
        context = before(number, at, end_number)[where]
        for level, keys in enumerate(self.keys):
            key = np.where(number[where] >= 0, (context << 32) | number[where], -1)
            run = found(keys, key)
            yield where, context, run
            if level + 1 == len(self.keys):
                return
            # a context one word longer ends at the token before: the run that made it there
            made = np.full(len(number), -1, np.int64)
            made[where] = run
            made = before(made, at, -1)
            where = np.flatnonzero(made >= 0)
            context = made[where]

    def last_contexts(self, number: np.ndarray, at: np.ndarray, end_number: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens' places and contexts one level above those known, for counting."""
        if not self.keys:
            context = before(number, at, end_number)
            where = np.flatnonzero(context >= 0)
            return where, context[where]
        *_, (where, _, run) = self.runs(number, at, end_number)
        made = np.full(len(number), -1, np.int64)
        made[where] = run
        made = before(made, at, -1)
        where = np.flatnonzero(made >= 0)
        return where, made[where]

    def numbers(self, tokens: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Places of tokens among the known words and, for frequent ones, their numbers; -1 for others. With ``codes``,
        ``tokens`` are the distinct ones that these number, and each is looked up once."""
        place = self.known(tokens)
        if codes is not None:
            place = place[codes]
        if not len(self.hashes):
            return place, place, -1
        end = found(self.hashes, np.array([self.end]))[0]
        return place, np.where(place >= 0, self.number[place], -1), int(self.number[end]) if end >= 0 else -1

    def grow(self, keys: np.ndarray, counts: np.ndarray, frequent: int) -> None:
        """Adds a level: all its frequent runs; tests each context against its parent."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(float)
        context, last = keys >> 32, keys & 0xFFFFFFFF
        level = len(self.keys)
        total = self.totals(level)[context] if len(keys) else np.zeros(0)
        parent = self.parent_p(level, context, last)
        share = counts / total
        n_contexts = len(self.words) if level == 0 else len(self.keys[level - 1])
        sums = lambda x: np.bincount(context, x, minlength=n_contexts).astype(float)
        gain = sums(counts * np.log(share / parent))
        rest = np.maximum(1e-12, 1 - sums(share))
        rest_parent = np.maximum(1e-12, 1 - sums(parent))
        all_ = self.totals(level)
        gain += np.where(rest > 1e-9, all_ * rest * np.log(rest / rest_parent), 0)
        keep = gain >= TEST
        self.own.append(np.where(keep[context], (counts - DISCOUNT) / total, 0.0) if len(keys) else np.zeros(0))
        self.left.append(np.where(keep, 1 - sums(self.own[level]), 1.0))
        self.keys.append(keys)
        self.run_counts = counts

    def totals(self, level: int) -> np.ndarray:
        """Occurrences of each context of a level; every token but the last end is followed by one, ends by the next text."""
        return self.counts[self.number >= 0].astype(float) if level == 0 else self.run_counts

    def parent_p(self, level: int, context: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The parent's probability of ``last`` for contexts of a level."""
        return self.along(level, context, last, self.root[last], level)

    def along(self, level: int, context: np.ndarray, last: np.ndarray, p: np.ndarray, lengths: int) -> np.ndarray:
        """The root's probabilities ``p`` of ``last`` (-1: no frequent word), led through the contexts' last 1 to ``lengths`` words."""
        suffix_words = self.spelled(level, context)
        for k in range(lengths):
            # the context's last k + 1 words as a run of level k
            run = suffix_words[:, -(k + 1)]
            for j in range(1, k + 1):
                run = found(self.keys[j - 1], (run << 32) | suffix_words[:, -(k + 1) + j])
            left, own = np.ones(len(p)), np.zeros(len(p))
            ok = run >= 0
            left[ok] = self.left[k][run[ok]]
            made = found(self.keys[k], np.where(ok & (last >= 0), (run << 32) | last, -1))
            own[made >= 0] = self.own[k][made[made >= 0]]
            p = own + left * p
        return p

    def spelled(self, level: int, run: np.ndarray) -> np.ndarray:
        """The words' numbers of runs of a level."""
        if level == 0:
            return run[:, None]
        key = self.keys[level - 1][run]
        return np.concatenate([self.spelled(level - 1, key >> 32), (key & 0xFFFFFFFF)[:, None]], axis=1)

    def occurrences(self, tokens: np.ndarray, rest: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """How often each token occurs in training; ``rest`` has places and counts of those that are not known, others occur never."""
        place = self.known(tokens)
        c = np.zeros(len(tokens), np.int64)
        c[place >= 0] = self.counts[place[place >= 0]]
        if rest is not None:
            c[rest[0]] = rest[1]
        return c

    def probabilities(self, tokens: np.ndarray, at: np.ndarray, codes: np.ndarray | None = None, rest: tuple | None = None) -> tuple:
        """Per token: its count, the root's probability and the head's."""
        _, number, end_number = self.numbers(tokens, codes)
        c = self.occurrences(tokens, rest)
        if codes is not None:
            c = c[codes]
        p0 = (c + 1.0) / (self.n + self.v + 1.0)
        p = p0.copy()
        for level, (where, context, run) in enumerate(self.runs(number, at, end_number)):
            own = np.zeros(len(where))
            own[run >= 0] = self.own[level][run[run >= 0]]
            p[where] = own + self.left[level][context] * p[where]
        return c, p0, p

    def starts(self) -> np.ndarray:
        """The first number of each level's contexts where those of all levels are numbered in a row; 0 is the root."""
        return np.cumsum([1, len(self.words), *(len(k) for k in self.keys[:-1])])

    def tail(self, tokens: np.ndarray, at: np.ndarray, codes: np.ndarray, rest: tuple | None = None) -> tuple:
        """Tokens that have a context one word longer than the longest in the head: their places, the numbers of the head's
        contexts, ranks of the words before those, nearest first, up to contexts of ``DEPTH`` words (rank ``NONE`` where a context
        has no such word, or one that occurs less than ``LEAST`` times), the ranks of the tokens themselves (``LISTED`` where they
        are not known and occur as often), a function that gives the hashes of words of rank ``UNKNOWN`` before them, and one that
        gives hashes and counts of listed tokens."""
        place, number, end_number = self.numbers(tokens, codes)
        often = self.occurrences(tokens, rest)
        length, context_of = np.zeros(len(codes), np.int8), np.zeros(len(codes), np.int64)
        for level, (where, context, _) in enumerate(self.runs(number, at, end_number)):
            length[where], context_of[where] = level + 1, self.starts()[level] + context
        # a text of j words up to the token has contexts of up to j + 1 tokens, the first of them an end
        j = np.arange(len(codes), dtype=np.int32) - np.repeat(at[:-1].astype(np.int32), np.diff(at))
        depth, rank = len(self.keys), self.ranks(place)
        rank[(rank == UNKNOWN) & (often >= LEAST)[codes]] = LISTED
        where = np.flatnonzero((length < depth) & (j >= length))
        end_at = np.flatnonzero(tokens == self.end)[0]
        # each distinct token's rank as a word before others
        as_older = np.where(often < LEAST, np.uint32(NONE), self.ranks(self.known(tokens)))

        def older_at(k: int, some: np.ndarray) -> np.ndarray:
            """The distinct tokens that stand k words before the head's contexts."""
            begins = j[where[some]] == length[where[some]] + k
            return np.where(begins, end_at, codes[where[some] - np.where(begins, 0, length[where[some]] + (k + 1))])

        where = where[as_older[older_at(0, np.arange(len(where)))] != NONE]
        older, some = [], np.arange(len(where))
        for k in range(depth):
            some = some[(j[where[some]] >= length[where[some]] + k) & (length[where[some]] + k < depth)]
            ranks = np.full(len(where), NONE, np.uint32)
            ranks[some] = as_older[older_at(k, some)]
            some = some[ranks[some] != NONE]
            older.append(ranks)

        def hashes(k: int, some: np.ndarray) -> np.ndarray:
            return tokens[older_at(k, some)].view(np.uint64)

        def listed(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            of = codes[where[some]]
            return tokens[of].view(np.uint64), often[of].astype(np.uint32)

        return where, context_of[where], older, rank[where], hashes, listed

    def ranks(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.rank[place], np.uint32(UNKNOWN)) if len(self.rank) else np.full(len(place), UNKNOWN, np.uint32)

    def head_p(self, context_of: np.ndarray, rank: np.ndarray, listed: np.ndarray) -> np.ndarray:
        """The head's probability of words after contexts numbered as by ``tail``; ranks beyond ``UNKNOWN`` are places in the
        counts of ``listed`` words, of which the head has none."""
        ok, starts = rank < UNKNOWN, self.starts()
        place = self.by_rank[rank[ok]]
        c, last = np.empty(len(rank)), np.full(len(rank), -1, np.int64)
        c[ok], last[ok], c[~ok] = self.counts[place], self.number[place], listed[rank[~ok] - np.uint32(UNKNOWN + 1)]
        p = (c + 1.0) / (self.n + self.v + 1.0)
        for level in range(len(self.keys)):
            mine = np.flatnonzero((context_of >= starts[level]) & (context_of < starts[level + 1] if level + 1 < len(starts) else True))
            p[mine] = self.along(level, context_of[mine] - starts[level], last[mine], p[mine], level + 1)
        return p

    def score(self, tokens: np.ndarray, at: np.ndarray, codes: np.ndarray | None = None, rest: tuple | None = None) -> tuple:
        """Per text: known tokens, base and score in log10."""
        c, p0, p = self.probabilities(tokens, at, codes, rest)
        return tuple(np.add.reduceat(x, at[:-1]) for x in ((c > 0).astype(np.int64), np.log10(p0), np.log10(p)))


def found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``; -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    i = np.searchsorted(keys, wanted)
    i[i == len(keys)] = 0
    return np.where(keys[i] == wanted, i, -1)


def _counted(tree, level: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value

        def keys_of(codes: np.ndarray, distinct: np.ndarray, at: np.ndarray) -> np.ndarray:
            _, number, end_number = t.numbers(distinct, codes)
            where, context = t.last_contexts(number, at, end_number)
            ok = number[where] >= 0
            where, context = where[ok], context[ok]
            if level == 0:
                may = t.bits[buckets(codes, distinct, at, t.end)[where]]
                where, context = where[may], context[may]
            return (context << 32) | number[where]

        yield from _gathered(batches, keys_of)

    return run


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def encoded(docs: DataFrame, key: str | None = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of tokenised documents, written once. Without ``key`` no text is held out."""
    small_batches(docs.sparkSession, size=8 << 20)
    name = F.lit(None).cast("long") if key is None else F.col(key).cast("long")
    held = F.lit(False) if key is None else held_out(key)
    rows = docs.select(name.alias("doc_id"), held.alias("held_out"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(_blocks_of, _BLOCK).withColumn("block", F.monotonically_increasing_id()), "encoded")


def learn(texts: DataFrame, depth: int = DEPTH) -> tuple[Tree, DataFrame]:
    """The tree, and the table of all training words (h, c), from ``encoded`` texts that are not held out."""
    with freed_shuffles(texts.sparkSession):
        return _learn(texts, depth)


def _learn(texts: DataFrame, depth: int) -> tuple[Tree, DataFrame]:
    spark = texts.sparkSession
    first = written(texts.mapInArrow(_words_and_pairs, "key long, n long, part int, counts binary"), "first-pass")
    all_words = written(first.filter("part is null").groupBy(F.col("key").alias("h")).agg(F.sum("n").alias("c")), "words")
    # how many words have each count: sqrt(2 * tokens) rows at most
    counts = all_words.groupBy("c").agg(F.count(F.lit(1)).alias("words")).toPandas().sort_values("c", ascending=False)
    n, v = int((counts["c"] * counts["words"]).sum()), int(counts["words"].sum())
    frequent = max(LEAST, math.ceil(P_MIN * n))
    # those of the head, 1 / P_MIN at most, are known in any case
    fits = counts[(counts["words"].cumsum() <= KNOWN) | (counts["c"] >= frequent)]
    top = all_words.filter(F.col("c") >= int(fits["c"].min()) if len(fits) else F.lit(False)).toPandas()
    tree = Tree(top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64), n, v, frequent)
    tables = first.filter("part is not null").select(F.col("part").cast("long").alias("part"), "counts").repartition("part").sortWithinPartitions("part")
    bits = {r["part"]: bytes(r["bits"]) for r in tables.mapInArrow(_frequent_buckets(frequent), "part long, bits binary").collect()}
    tree.bits = np.unpackbits(np.frombuffer(b"".join(bits[p] for p in sorted(bits)), np.uint8)).astype(bool)
    for level in range(depth):
        if not len(tree.bits):
            break
        shared = spark.sparkContext.broadcast(tree)
        counted = texts.mapInArrow(_counted(shared, level), "key long, n long")
        runs = counted.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= frequent).toPandas()
        shared.destroy()
        tree.grow(runs["key"].to_numpy(np.int64), runs["n"].to_numpy(np.int64), frequent)
    tree.bits = np.zeros(0, bool)
    removed(first)
    all_words._tidewright_training = texts  # the tail is learned where it is scored
    return tree, all_words


def train(texts: DataFrame, depth: int = DEPTH) -> tuple[Tree, DataFrame]:
    """The tree, and the table of all training words (h, c), from a DataFrame of one column ``text``."""
    return learn(encoded(texts, None), depth)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, each by planes of its bytes, compressed."""
    if not len(columns[0]):
        return b""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    return pa.compress(b"".join(planes), "zstd", asbytes=True)


_TAIL = {"contexts": np.uint32, **{f"older{k}": np.uint32 for k in range(DEPTH)}, "words": np.uint32, "docs": np.uint32}
_WORDS = {"hashes": np.uint64, "counts": np.uint32}
_GAIN = {"docs": np.uint32, "gains": np.float32}
_REST = {"places": np.uint32, "counts": np.uint32}


def _unpacked(data: pa.Buffer, n: int, columns: dict) -> list[np.ndarray]:
    types = [np.dtype(t) for t in columns.values()]
    if not n:
        return [np.zeros(0, t) for t in types]
    body, out, at = np.frombuffer(pa.decompress(data, n * sum(t.itemsize for t in types), "zstd"), np.uint8), [], 0
    for t in types:
        out.append(np.ascontiguousarray(body[at : at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).ravel())
        at += n * t.itemsize
    return out


def _others(shared):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's words that are not known."""
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.frombuffer(data.as_buffer(), np.int64)
                place = np.flatnonzero(shared.value.known(h) < 0)
                for i in range(0, len(place), _ROWS):
                    some = place[i : i + _ROWS]
                    yield pa.record_batch([pa.array(np.full(len(some), block)), pa.array(some.astype(np.int32)), pa.array(h[some])], names=["b", "i", "w"])

    return run


@lean
def _rest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block, with the places and counts of those of its words that were found; rows come sorted."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        place, c = (np.concatenate(x) for x in zip(*held, strict=True))
        data = _packed(np.diff(place, prepend=0).astype(np.uint32), c.astype(np.uint32))
        return pa.record_batch([pa.array([now], pa.int64()), pa.array([len(place)], pa.int64()), pa.array([data], pa.binary())], names=["b", "found", "rest"])

    for batch in batches:
        block, place, c = (x.to_numpy() for x in batch.columns)
        begins = np.flatnonzero(np.append(True, block[1:] != block[:-1]))[: len(block)]
        for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(block)], strict=False):
            if block[i] != now:
                if held:
                    yield done()
                now, held = int(block[i]), []
            held.append((place[i:j], c[i:j]))
    if held:
        yield done()


def counted(texts: DataFrame, tree: Tree, all_words: DataFrame, shared) -> DataFrame:
    """``encoded`` texts, written again with the counts of their words that are not known."""
    if len(tree.hashes) == tree.v:
        return texts.withColumns({"found": F.lit(0).cast("long"), "rest": F.lit(None).cast("binary")})
    with freed_shuffles(texts.sparkSession):
        others = texts.select("block", "words").mapInArrow(_others(shared), "b long, i int, w long")
        words_ = all_words.filter(F.col("c") < int(tree.counts.min())) if len(tree.counts) else all_words
        rows = others.join(words_, F.col("w") == F.col("h")).select("b", "i", "c")
        rest = written(rows.repartition("b").sortWithinPartitions("b", "i").mapInArrow(_rest_of, "b long, found long, rest binary"), "rest")
        out = written(texts.join(rest, F.col("block") == F.col("b"), "left").drop("b"), "counted")
    removed(rest)
    return out


def _rest(row: dict) -> tuple[np.ndarray, np.ndarray] | None:
    if row["rest"].as_py() is None:
        return None
    steps, c = _unpacked(row["rest"].as_buffer(), row["found"].as_py(), _REST)
    return np.cumsum(steps, dtype=np.int64), c


def _tails(shared, parts: int, trains: bool, scores: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block and part its places of the tail, sorted by context; a text's number carries whether it is for training."""
        tree = shared.value
        for row, codes, h, at in _read(batches, not scores):
            where, context, older, word, hashes, listed = tree.tail(h, at, codes, _rest(row))
            if not len(where):
                continue
            oldest = older[0].astype(np.uint64)
            other = np.flatnonzero(older[0] == UNKNOWN)
            oldest[other] = hashes(0, other) | np.uint64(1 << 63)
            part = (mixed(mixed(oldest) + context.astype(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort((part << np.uint64(_CONTEXT_BITS + _RANK_BITS)) | (context.astype(np.uint64) << np.uint64(_RANK_BITS)) | older[0])
            where, context, word, part, older = where[order], context[order], word[order], part[order], [x[order] for x in older]
            doc = np.repeat(np.arange(len(at) - 1, dtype=np.uint32), np.diff(at))[where]
            learned = ~row["held"].values.to_numpy(zero_copy_only=False)[doc] if trains and scores else np.full(len(doc), trains)
            doc = doc * np.uint32(2) + learned.astype(np.uint32)
            begins = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(part)], strict=True):
                steps = np.diff(context[i:j], prepend=0).astype(np.uint32)
                levels = [x[i:j] for x in older] + [np.full(j - i, NONE, np.uint32)] * (DEPTH - len(older))
                data = _packed(steps, *levels, word[i:j].astype(np.uint32), doc[i:j])
                others = np.concatenate([hashes(k, order[i:j][x[i:j] == UNKNOWN]) for k, x in enumerate(older)]).tobytes()
                given = _packed(*listed(order[i:j][word[i:j] == LISTED]))
                yield pa.record_batch([pa.array([part[i]], pa.int32()), pa.array([row["block"].as_py() if scores else None], pa.int64()), pa.array([j - i], pa.int64()), pa.array([data], pa.binary()), pa.array([others], pa.binary()), pa.array([given], pa.binary())], names=["part", "block", "size", "data", "hashes", "listed"])

    return run


def _gains(shared):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the tail adds to the scores of texts; chunks come sorted by part, and one part is held at a time."""
        now, chunks = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(0)[i].as_py() != now and chunks:
                    yield from _gains_of(shared.value, now, chunks)
                    chunks = []
                now = batch.column(0)[i].as_py()
                steps, *older, word, doc = _unpacked(batch.column(3)[i].as_buffer(), batch.column(2)[i].as_py(), _TAIL)
                head, hashes = np.cumsum(steps, dtype=np.uint64), np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                listed = _unpacked(batch.column(5)[i].as_buffer(), int((word == LISTED).sum()), _WORDS)
                chunks.append((batch.column(1)[i].as_py(), *_contexts(head, older, hashes), head.astype(np.uint32), word, doc, *listed))
        if chunks:
            yield from _gains_of(shared.value, now, chunks)

    return run


def _contexts(head: np.ndarray, older: list[np.ndarray], hashes: np.ndarray) -> list[np.ndarray]:
    """Names of the contexts one, two and more words longer than the head's; 0 where a context has no such word."""
    out, at, name, some = [], 0, head, np.arange(len(head))
    for ranks in older:
        there = ranks[some] != NONE
        some, name = some[there], name[there]
        word, other = ranks[some].astype(np.uint64), ranks[some] == UNKNOWN
        n = int(other.sum())
        word[other] = hashes[at : at + n] | np.uint64(1 << 63)
        at += n
        name = mixed(mixed(word) * np.uint64(3) + name) | np.uint64(1)
        whole = np.zeros(len(head), np.uint64)
        whole[some] = name
        out.append(whole)
    return out


def _grouped(name: np.ndarray, word: np.ndarray) -> tuple:
    """An order by context and word, and in it the number of each place's context and run."""
    order = np.lexsort((word, name))
    name, word = name[order], word[order]
    new_context = np.append(True, name[1:] != name[:-1])
    new_run = new_context | np.append(True, word[1:] != word[:-1])
    return order, np.cumsum(new_context) - 1, np.cumsum(new_run) - 1, np.flatnonzero(new_run)


def _retained(counts: np.ndarray, total: np.ndarray, context_of: np.ndarray, often: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which contexts pass the test, the runs' own shares, and what contexts leave to their parents (1 where they fail)."""
    sums = lambda x: np.bincount(context_of, np.where(often, x, 0.0), minlength=len(total))
    share = counts / np.maximum(total, 1)[context_of]
    gain = sums(counts * np.log(np.where(often, share / parent, 1.0)))
    rest, rest_parent = np.maximum(1e-12, 1 - sums(share)), np.maximum(1e-12, 1 - sums(parent))
    gain += np.where(rest > 1e-9, total * rest * np.log(rest / rest_parent), 0)
    keep = gain >= TEST
    own = np.where(often & keep[context_of], (counts - DISCOUNT) / np.maximum(total, 1)[context_of], 0.0)
    return keep, own, 1 - sums(own)


def _gains_of(tree: Tree, part: int, chunks: list[tuple]) -> Iterator[pa.RecordBatch]:
    blocks_ = [c[0] for c in chunks]
    scored_ = np.array([b is not None for b in blocks_])
    *names, head, word, doc, listed, listed_counts = (np.concatenate([c[k] for c in chunks]) for k in range(1, DEPTH + 6))
    chunk = np.repeat(np.arange(len(chunks), dtype=np.int32), [len(c[1]) for c in chunks])
    chunks.clear()
    # words that are not known get numbers here
    _, first, number = np.unique(listed, return_index=True, return_inverse=True)
    word[word == LISTED] = number.astype(np.uint32) + np.uint32(UNKNOWN + 1)
    listed_counts = listed_counts[first]
    # of every place, the head's probability where a run needs it, and by how much its contexts change it
    base, ratio = np.full(len(word), np.nan), np.ones(len(word))
    active, changed = np.arange(len(word)), np.zeros(len(word), bool)
    for name in names:
        # contexts that occur less often than any word must to be learned go first, with all longer ones; most do
        active = active[name[active] != 0]
        turn = np.argsort(name[active])
        active = active[turn]
        first = np.flatnonzero(np.append(True, np.diff(name[active]) != 0))[: len(active)]
        if not len(first):
            break
        total = np.add.reduceat((doc[active] & np.uint32(1)).astype(np.int64), first)
        active = active[np.repeat(total >= LEAST, np.diff(first, append=len(active)))]
        if not len(active):
            break
        order, of, run, begins = _grouped(name[active], word[active])
        active = active[order]
        learned = (doc[active] & np.uint32(1)).astype(float)
        total, counts = np.bincount(of, learned), np.bincount(run, learned)
        one = active[begins]  # a place of each run
        often = (word[one] != UNKNOWN) & (counts >= LEAST)
        new = often & np.isnan(base[one])
        p = base[one]
        p[new] = tree.head_p(head[one][new].astype(np.int64), word[one][new], listed_counts)
        base[active] = p[run]
        parent = np.where(often, p * ratio[one], 1.0)
        keep, own, left = _retained(counts, total, of[begins], often, parent)
        here = keep[of]
        ratio[active[here]] = (np.where(often, own / np.where(often, p, 1.0), 0.0)[run] + left[of] * ratio[active])[here]
        changed[active[here]] = True
    del names, name, head, word, base, active
    mine = np.flatnonzero(changed & scored_[chunk])
    if not len(mine):
        return
    more = np.log10(ratio[mine])
    keys, at = np.unique((chunk[mine].astype(np.int64) << 32) | (doc[mine] >> np.uint32(1)), return_inverse=True)
    more = np.bincount(at, more).astype(np.float32)
    begins = np.flatnonzero(np.append(True, keys[1:] >> 32 != keys[:-1] >> 32))
    for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(keys)], strict=True):
        data = _packed(np.diff(keys[i:j] & 0xFFFFFFFF, prepend=0).astype(np.uint32), more[i:j])
        yield pa.record_batch([pa.array([blocks_[keys[i] >> 32]], pa.int64()), pa.array([part], pa.int32()), pa.array([j - i], pa.int64()), pa.array([data], pa.binary())], names=["b", "part", "size", "data"])


@lean
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all gains of each text; rows come sorted by block."""
    now, total = None, np.zeros(0)

    def done() -> Iterator[pa.RecordBatch]:
        place = np.flatnonzero(total)
        for i in range(0, len(place), _ROWS):
            some = place[i : i + _ROWS]
            yield pa.record_batch([pa.array([now] * len(some), pa.int64()), pa.array(some.astype(np.int32)), pa.array(total[some])], names=["b", "o", "gain"])

    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column(0)[i].as_py() != now:
                yield from done()
                now, total = batch.column(0)[i].as_py(), np.zeros(0)
            steps, more = _unpacked(batch.column(3)[i].as_buffer(), batch.column(2)[i].as_py(), _GAIN)
            place = np.cumsum(steps, dtype=np.int64)
            if place[-1] >= len(total):
                total = np.append(total, np.zeros(place[-1] + 1 - len(total)))
            total[place] += more
    yield from done()


def tail_gains(texts: DataFrame, training: DataFrame, shared) -> DataFrame:
    """(b, o, gain): what the tail adds to the score of each text of ``texts``, by its block and place."""
    parts = min(math.ceil(shared.value.n / _PART_TOKENS), _PARTS_MOST)
    made = "part int, block long, size long, data binary, hashes binary, listed binary"
    if training is texts:
        chunks = texts.mapInArrow(_tails(shared, parts, True, True), made)
    else:
        chunks = texts.mapInArrow(_tails(shared, parts, False, True), made).unionByName(training.mapInArrow(_tails(shared, parts, True, False), made))
    gains = chunks.repartition("part").sortWithinPartitions("part").mapInArrow(_gains(shared), "b long, part int, size long, data binary")
    return gains.repartition("b").sortWithinPartitions("b", "part").mapInArrow(_added, "b long, o int, gain double")


_ROW = "block long, place int, doc_id long, held_out boolean, n_tokens long, known long, base double, full double"


def _scored(shared):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for row, codes, distinct, at in _read(batches, False):
            known, base, full = tree.score(distinct, at, codes, _rest(row))
            n = len(at) - 1
            out = pa.record_batch([pa.array([row["block"].as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), row["doc_id"].values, row["held"].values, pa.array(np.diff(at)), pa.array(known), pa.array(base), pa.array(full)], names=[x.split()[0] for x in _ROW.split(", ")])
            for i in range(0, out.num_rows, 1000):
                yield out.slice(i, 1000)

    return run


def score(docs: DataFrame, tree: Tree, all_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, base_score and score."""
    return scored(encoded(docs, key, text), tree, all_words)


def scored(texts: DataFrame, tree: Tree, all_words: DataFrame) -> DataFrame:
    """The same for ``encoded`` texts, which are removed once they are scored."""
    spark = texts.sparkSession
    shared, training = spark.sparkContext.broadcast(tree), getattr(all_words, "_tidewright_training", None)
    mine = counted(texts, tree, all_words, shared)
    # a context or word outside the head occurs less than tree.frequent times; with LEAST none of them has a word to learn
    tail = training is not None and tree.keys and tree.frequent > LEAST
    if hasattr(mine, "_tidewright_path"):
        removed(texts)
    each = written(mine.mapInArrow(_scored(shared), _ROW), "scored")
    if tail:
        learned = mine if training is texts else counted(training, tree, all_words, shared)
        with freed_shuffles(spark):
            gains = written(tail_gains(mine, learned, shared), "gains")
        if learned is not mine:
            removed(learned)
        each = each.join(gains, (F.col("block") == F.col("b")) & (F.col("place") == F.col("o")), "left").withColumn("full", F.col("full") + F.coalesce("gain", F.lit(0.0)))
    removed(texts, mine)
    shared.destroy()
    return each.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(int(tree.n)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("full").alias("score"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    tree, all_words = learn(texts)
    return scored(texts, tree, all_words)
