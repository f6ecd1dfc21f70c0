"""Byte-pair encoding and decoding of whole texts by forced-boundary splitting.

A vocabulary's merges say which byte pairs stand next to each other inside any token; a merge never crosses a pair that stands
in none. So a text is normalised, the end of each of its words is marked with a byte of its own (a blank, as words hold none),
and one look-up in a table of 256 x 256 pairs cuts all texts of a block into fragments that merge independently: after every
word's end, and inside words wherever a pair is in no token. Each distinct fragment of a block is merged once, lowest rank
first and leftmost among equals, and the ids of a text are those of its fragments, one after another. Nothing is shuffled.

Vocabularies: tokenizer files with a byte-level BPE model, an end-of-word suffix, and the normaliser and word pattern stated in
``tokens.SPLITS``; another kind is refused with a ValueError. Truncation and padding of the file are not applied. Added tokens
that stand in a raw text become their ids. Decoding gives the tokens of the ids joined by one blank, as such a file has no
decoder; the word-end suffix stays, so texts of different white space decode alike.

Bounds: a block holds about 2 MB of text; a longer text is cut at white space into pieces of that size, so memory follows the
longest run without white space; fragments known to a worker are forgotten beyond ``most`` or ``most_bytes``.

Defined cases: a null or empty text, and one of white space alone, has no ids and decodes to an empty text; nulls and repeats in
other columns stay; rows are encoded each for itself, so repeated rows and null ids of documents are kept; bytes that are not
UTF-8 count as the replacement character; null lists decode to an empty text, null or unknown ids are skipped; an empty table
gives no rows. Only the columns named in ``keep`` are carried; a name given twice, or one of the result's, is refused.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import blocks, small_batches, table
from tidewright.llm.tokens import _PLAIN, SPLITS, vocabulary

BLOCK_BYTES = 2 << 20
#: Marks the end of a word among its bytes.
END = 0x20
#: Fragments of more bytes are merged one by one, with a heap.
LONG = 40
_NEVER = np.iinfo(np.int32).max
_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN, _UNSEEN = range(6)
# fixed values: white space of the word pattern
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_GAP = re.compile("[" + "".join(f"\\u{c:04x}" for c in _WHITE) + "]")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Classes:
    """Classes of code points, looked up once each: letters, numbers, white space, others, and those unknown to this Python."""

    def __init__(self):
        self.of = np.full(0x110000, _UNSEEN, np.uint8)
        self.of[_WHITE] = _SPACE

    def __call__(self, points: np.ndarray) -> np.ndarray:
        found = self.of[points]
        if (found == _UNSEEN).any():
            for c in np.unique(points[found == _UNSEEN]).tolist():
                kind = unicodedata.category(chr(c))
                self.of[c] = _UNKNOWN if kind == "Cn" else {"L": _LETTER, "N": _NUMBER}.get(kind[0], _OTHER)
            found = self.of[points]
        return found


class Codec:
    """A vocabulary with its merges, its table of byte pairs inside tokens, and the fragments met so far."""

    def __init__(self, path: str, most: int = 600_000, most_bytes: int = 24 << 20):
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        model, added = form["model"], form["added_tokens"]
        suffix = model.get("end_of_word_suffix")
        if model.get("type", "BPE") != "BPE" or not suffix or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges") or (form["normalizer"], form["pre_tokenizer"]) != SPLITS[1] or form.get("post_processor") or form.get("decoder") or any(x[k] != v for x in added for k, v in _PLAIN.items()):
            raise ValueError(f"{path}: not a byte-level BPE vocabulary with word ends")
        self.path, vocab = path, model["vocab"]
        letters = byte_letters()
        if missing := [c for c in letters.values() if c not in vocab or c + suffix not in vocab]:
            raise ValueError(f"{path}: {len(missing)} bytes have no token")
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + suffix] for b in range(256)]
        self.added = {x["content"]: x["id"] for x in added if x["content"]}
        self.mark = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        words = [None] * self.size
        for word, i in chain(vocab.items(), self.added.items()):
            words[i] = word
        self.words = pa.array(words, pa.string())
        self._pairs(model["merges"], vocab)
        self.classes = Classes()
        self.most, self.most_bytes = most, most_bytes
        self._library = None
        self._forget()

    def _pairs(self, merges: list, vocab: dict) -> None:
        """Ranks of merges, and which byte pairs stand inside tokens: those where the two sides of a merge meet, and a last byte and its mark."""
        edge = {self.inner[b]: (b, b) for b in range(256)} | {self.final[b]: (b, END) for b in range(256)}
        self.inside = np.zeros(1 << 16, bool)
        self.inside[np.arange(256) << 8 | END] = True
        self.inside[END << 8 | END] = False  # no word holds a blank
        self.rank, self.made = {}, []
        for pair in merges:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[left], vocab[right]
            new = vocab[left + right]
            if edge[a][1] == END:
                raise ValueError(f"{self.path}: a token goes on after a word's end")
            self.inside[edge[a][1] << 8 | edge[b][0]] = True
            edge[new] = (edge[a][0], edge[b][1])
            self.rank.setdefault(a * self.size + b, len(self.made))
            self.made.append(new)
        self.keys = np.fromiter(sorted(self.rank), np.int64, len(self.rank))
        self.ranks = np.fromiter(map(self.rank.get, self.keys.tolist()), np.int32, len(self.rank))
        self.news = np.array(self.made, np.int32)

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment; a blank at its end marks the end of a word."""
        if fragment[-1] == END:
            now = [*map(self.inner.__getitem__, fragment[:-2]), self.final[fragment[-2]]]
        else:
            now = [*map(self.inner.__getitem__, fragment)]
        n, size, rank = len(now), self.size, self.rank
        heap = [r * n + i for i in range(n - 1) if (r := rank.get(now[i] * size + now[i + 1])) is not None]
        if not heap:
            return now
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if now[i] < 0 or (j := after[i]) >= n or rank.get(now[i] * size + now[j]) != r:
                continue  # what stood here has merged since
            now[i], now[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := rank.get(now[i] * size + now[k])) is not None:
                    heapq.heappush(heap, x * n + i)
            if (h := before[i]) >= 0 and (x := rank.get(now[h] * size + now[i])) is not None:
                heapq.heappush(heap, x * n + h)
        return [x for x in now if x >= 0]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * np.int64(self.size) + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NEVER)

    def merge_rows(self, now: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``merge``, of many fragments of one length at once: numbers of rows that are done, and their ids. Each round
        makes the first of the lowest merges of every row, so that each row gets one symbol shorter."""
        rows = np.arange(len(now))
        ranks = self._rank_of(now[:, :-1], now[:, 1:])
        while now.shape[1] > 1 and len(now):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(now)), at]
            done = best == _NEVER
            if done.any():
                yield rows[done], now[done]
                rows, now, ranks, at, best = rows[~done], now[~done], ranks[~done], at[~done], best[~done]
            m, n = now.shape
            if not m:
                return
            each, keep = np.arange(m), np.ones((m, n), bool)
            now[each, at] = self.news[best]
            keep[each, at + 1] = False
            now = now[keep].reshape(m, n - 1)
            keep = np.ones((m, n - 1), bool)
            keep[each, at] = False
            ranks = ranks[keep].reshape(m, n - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            ranks[before, at[before] - 1] = self._rank_of(now[before, at[before] - 1], now[before, at[before]])
            ranks[after, at[after]] = self._rank_of(now[after, at[after]], now[after, at[after] + 1])
        yield rows, now

    def _merged(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments, one after another, and how many each has."""
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        marked = np.fromiter((x[-1] == END for x in new), bool, len(new))
        sizes, found = np.zeros(len(new), np.int64), []
        inner, final = np.array(self.inner, np.int32), np.array(self.final, np.int32)
        for n in np.unique(lengths[lengths <= LONG]).tolist():
            for end in (False, True):
                which = np.flatnonzero((lengths == n) & (marked == end))
                if not len(which):
                    continue
                raw = np.frombuffer(b"".join([new[i] for i in which.tolist()]), np.uint8).reshape(-1, n)
                now = inner[raw[:, : n - end]]
                if end:
                    now[:, -1] = final[raw[:, n - 2]]
                for rows, ids in self.merge_rows(now):
                    found.append((which[rows], ids))
                    sizes[which[rows]] = ids.shape[1]
        for i in np.flatnonzero(lengths > LONG).tolist():
            found.append((np.array([i]), np.array([self.merge(new[i])], np.int32)))
            sizes[i] = found[-1][1].shape[1]
        out, starts = np.empty(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
        for rows, ids in found:
            out[starts[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, sizes

    def _learn(self, new: list[bytes]) -> None:
        got, sizes = self._merged(new)
        n = len(self.known)
        while n + len(new) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ends[n + 1 : n + len(new) + 1] = self.ends[n] + np.cumsum(sizes)
        total = int(self.ends[n + len(new)])
        while total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.ends[n] : total] = got
        self.known.update(zip(new, range(n, n + len(new)), strict=True))
        self.held += sum(map(len, new))

    def _normal(self, text: str) -> str:
        """The normalised text; white space stays as it is, since it only parts words."""
        if text.isascii():
            return text.lower()
        # lowered letter by letter: a sigma at the end of a word is one as any other
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    @property
    def library(self):
        """The library's own model, asked only about characters that are newer than this Python's tables."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _kind(self, letter: str) -> int:
        parts = self.library.pre_tokenizer.pre_tokenize_str
        return _LETTER if len(parts("a" + letter)) == 1 else _NUMBER if len(parts(letter * 2)) == 2 else _OTHER

    def _marked(self, parts: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the words of all normalised parts, each word's end marked, and the n + 1 offsets of the parts."""
        joined = "\n".join([*parts, ""])
        data = joined.encode("utf-8", "surrogatepass")
        body = np.frombuffer(data, np.uint8)
        plain = len(body) == len(joined)
        points = body if plain else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.classes(points)
        at = np.concatenate([[0], np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))])
        if (kinds == _UNKNOWN).any():
            odd = np.unique(np.searchsorted(at, np.flatnonzero(kinds == _UNKNOWN), "right") - 1).tolist()
            exact = {i: self.library.normalizer.normalize_str(texts[i]) for i in odd}
            if any(exact[i] != parts[i] for i in odd):
                return self._marked([exact.get(i, p) for i, p in enumerate(parts)], texts)
            kinds = kinds.copy()
            for c in np.unique(points[kinds == _UNKNOWN]).tolist():
                kinds[points == c] = self._kind(chr(c))
        solid = kinds != _SPACE
        begins = solid & (kinds == _NUMBER)
        begins[0] |= solid[0]
        begins[1:] |= solid[1:] & (kinds[1:] != kinds[:-1])
        self._contractions(points, kinds, begins)
        # the last character of a word: the next is white space (there is one at the end) or begins another
        last = solid.copy()
        last[:-1] &= ~solid[1:] | begins[1:]
        if plain:
            kept, final = body[solid], last[solid]
            places = np.concatenate([[0], np.cumsum(solid, dtype=np.int64) + np.cumsum(last)])[at]
        else:
            width = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)
            stops = np.cumsum(width)
            ends_here = np.zeros(len(body), bool)
            ends_here[stops[last] - 1] = True
            keep = np.repeat(solid, width)
            kept, final = body[keep], ends_here[keep]
            places = np.concatenate([[0], np.cumsum(width * solid + last)])[at]
        return np.insert(kept, np.flatnonzero(final) + 1, END), places

    @staticmethod
    def _contractions(points: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> None:
        """An apostrophe that begins a word takes s, t, m, d, re, ve or ll after it; what follows begins another word."""
        at = np.flatnonzero(points[:-1] == 0x27)
        at = at[(at == 0) | (kinds[at - 1] != _OTHER)]
        one = points[at + 1]
        two = points[np.minimum(at + 2, len(points) - 1)]
        takes = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        pairs = one.astype(np.int64) << 8 | np.where(two < 0x80, two, 0)
        takes[np.isin(pairs, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])] = 2
        at, takes = at[takes > 0], takes[takes > 0]
        begins[at + 1] = False
        after = at + 1 + takes
        begins[after[kinds[after] == _LETTER]] = True

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the texts' n + 1 offsets in them."""
        parts, owner, special = [], [], []
        for i, text in enumerate(texts):
            place = 0
            for m in self.mark.finditer(text) if self.mark else ():
                parts += [text[place : m.start()], ""]
                owner += [i, i]
                special += [-1, self.added[m[0]]]
                place = m.end()
            parts.append(text[place:] if place else text)
            owner.append(i)
            special.append(-1)
        out, places = self._marked([self._normal(p) for p in parts], parts)
        if len(out):
            cut = ~self.inside[out[:-1].astype(np.uint16) << np.uint16(8) | out[1:]]
            starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
            found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(out)).astype(np.int32)), pa.py_buffer(out)])
            coded = found.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(self.known) > self.most or self.held > self.most_bytes:
                self._forget()
            if new := [x for x in distinct if x not in self.known]:
                self._learn(new)
            known = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
            which = known[coded.indices.to_numpy(zero_copy_only=False)]
            first, sizes = self.ends[which], self.ends[which + 1] - self.ends[which]
            total = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.ids[np.repeat(first - total[:-1], sizes) + np.arange(total[-1])]
            bounds = total[np.searchsorted(starts, places)]
        else:
            ids, bounds = np.zeros(0, np.int32), np.zeros(len(parts) + 1, np.int64)
        special = np.array(special, np.int32)
        if (special >= 0).any():
            odd = np.flatnonzero(special >= 0)
            ids = np.insert(ids, bounds[odd], special[odd])
            bounds = bounds + np.concatenate([[0], np.cumsum(special >= 0)])
        return ids, bounds[np.searchsorted(np.array(owner), np.arange(len(texts) + 1))]

    def encode(self, text: str) -> list[int]:
        return self([text])[0].tolist()

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The text of each list of ids: its tokens joined by one blank."""
        flat = lists.flatten()
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ids = flat.fill_null(-1).to_numpy(zero_copy_only=False)
        ok = (ids >= 0) & (ids < self.size)
        words = self.words.take(pa.array(np.where(ok, ids, 0)))
        ok &= words.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(counts)])
        if not ok.all():
            words = words.filter(pa.array(ok))
            ends = np.concatenate([[0], np.cumsum(ok)])[ends]
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), words), " ")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process and vocabulary; it stays between tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def pieces(text: str, most: int = BLOCK_BYTES) -> Iterator[str]:
    """A text in pieces of about ``most`` characters, cut before white space, where neither words nor composed letters are parted."""
    start = 0
    while len(text) - start > most:
        cut = _GAP.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def _columns(df: DataFrame, keep: tuple, new: str) -> None:
    if len({*keep, new}) <= len(keep) or any(df.columns.count(c) != 1 for c in keep):
        raise ValueError(f"columns {keep} and {new} must be distinct, and each be there once")


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and the token ids of each whole text."""
    _columns(docs, keep, ids)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in blocks(batches, "\x00text", BLOCK_BYTES):
            texts = [(x or b"").decode("utf-8", "replace") for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            if len(texts) == 1 and len(texts[0]) > BLOCK_BYTES:
                stream = np.concatenate([code([p])[0] for p in pieces(texts[0])])
                ends = np.array([0, len(stream)])
            else:
                stream, ends = code(texts)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(stream, pa.int32()))
            yield pa.record_batch([*batch.columns[:-1], lists], names=[*keep, ids])

    rows = docs.select(*(docs[f"`{c}`"] for c in keep), docs[f"`{text}`"].cast("string").alias("\x00text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, ", ".join(filter(None, [kinds, f"`{ids}` array<int>"])))


def decode(rows: DataFrame, path: str, ids: str = "ids", keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and the text that the ids stand for."""
    _columns(rows, keep, text)
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in batches:
            yield pa.record_batch([*batch.columns[:-1], code.decode(batch.column(batch.num_columns - 1)).cast(pa.string())], names=[*keep, text])

    rows = rows.select(*(rows[f"`{c}`"] for c in keep), rows[f"`{ids}`"].cast("array<int>").alias("\x00ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, ", ".join(filter(None, [kinds, f"`{text}` string"])))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    coded = encode(table(spark, sf_dir, "documents"), path)
    back = decode(coded, path, keep=("doc_id", "ids"))
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
