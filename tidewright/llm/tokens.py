"""Token ids of whole texts by the tokenizers library, each distinct piece of a block encoded once.

A text is cut before every ASCII blank that follows a character which is surely no white space, and before ASCII
punctuation (but the apostrophe) that follows an ASCII letter. The two vocabularies used here part words at all such places
before they look for tokens (``SPLITS``), so the ids of the pieces, one after another, are the ids of the text. A vocabulary
that parts words in another way encodes whole texts. Added tokens (as ``<|endoftext|>``) that stand in a text become their ids,
as the library has it; a text that holds one is encoded whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_POINT = np.zeros(256, bool)
_POINT[[c for c in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_LEAD = np.zeros(256, bool)  # first bytes of two-byte characters none of which is white space
_LEAD[0xC3:0xE0] = True

# fixed values: the normalisers and pre-tokenisers that part words at every place where a text is cut
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SPLITS = [
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    ),
]
_PLAIN = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; any other file may be given to the operators instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(body: np.ndarray, ends: np.ndarray, whole=()) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts and each text's n + 1 offsets among them; texts of the numbers in ``whole`` are not cut."""
    if not body.size:
        return pa.array([], pa.binary()), np.zeros(len(ends), np.int64)
    cut = _BLANK[body]
    solid = _SOLID[body]
    solid[1:] |= _LEAD[body[:-1]]
    cut[1:] &= solid[:-1]
    cut[1:] |= _POINT[body[1:]] & _LETTER[body[:-1]]
    for i in whole:
        cut[ends[i] : ends[i + 1]] = False
    cut[0] = True
    cut[ends[:-1][ends[:-1] < body.size]] = True
    starts = np.flatnonzero(cut)
    offsets = np.append(starts, body.size).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
    return found, np.searchsorted(starts, ends).astype(np.int64)


class Encoder:
    """Ids of blocks of texts. Up to ``most`` pieces of ``most_bytes`` in all stay known between blocks; beyond that those that most
    blocks had stay, half of either at most. A known piece takes about 200 bytes."""

    def __init__(self, path: str, most: int = 600_000, most_bytes: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.size = self.model.get_vocab_size()
        self.most, self.most_bytes = most, most_bytes
        form = json.loads(self.model.to_str())
        added = form["added_tokens"]
        self.added = [x["content"].encode() for x in added if x["content"]]
        self.cuts = (form["normalizer"], form["pre_tokenizer"]) in SPLITS and all(x[k] == v for x in added for k, v in _PLAIN.items())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int32)
        self.seen = np.zeros(1 << 14, np.int32)  # blocks that had the piece

    def _shrink(self) -> None:
        """Forgets the pieces that the fewest blocks had, so that half of what may stay known is free."""
        n = len(self.known)
        pieces, seen = list(self.known), self.seen[:n]
        size = np.fromiter(map(len, pieces), np.int64, n)
        order = np.argsort(-seen, kind="stable")
        stay = np.arange(1, n + 1) <= self.most // 2
        stay &= np.cumsum(size[order]) <= self.most_bytes // 2
        stay &= seen[order] > 1
        kept = np.sort(order[stay])
        parts = [self.ids[self.ends[i] : self.ends[i + 1]] for i in kept.tolist()]
        ids, counts = (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), seen[kept]
        known = {pieces[i]: k for k, i in enumerate(kept.tolist())}
        ends = np.cumsum(self.ends[kept + 1] - self.ends[kept])
        self._forget()
        self.known, self.held = known, int(size[kept].sum())
        self._room(len(kept), len(ids))
        self.ids[: len(ids)], self.ends[1 : len(kept) + 1], self.seen[: len(kept)] = ids, ends, (counts + 1) // 2  # so that pieces of long ago go

    def _room(self, n: int, total: int) -> None:
        """Makes the arrays long enough for n pieces of ``total`` ids."""
        if n + 1 > len(self.ends):
            more = np.zeros(max(2 * len(self.ends), n + 1) - len(self.ends), np.int32)
            self.ends, self.seen = np.concatenate([self.ends, more]), np.concatenate([self.seen, more])
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(2 * len(self.ids), total) - len(self.ids), np.uint32)])

    def _learn(self, new: list[bytes]) -> None:
        for k in range(0, len(new), 4_000):
            part = new[k : k + 4_000]
            got = [e.ids for e in self.model.encode_batch_fast([x.decode("utf-8", "replace") for x in part], add_special_tokens=False)]
            n, sizes = len(self.known), np.fromiter(map(len, got), np.int64, len(got))
            total = int(self.ends[n]) + int(sizes.sum())
            self._room(n + len(part), total)
            self.ends[n + 1 : n + len(part) + 1] = self.ends[n] + np.cumsum(sizes)
            self.ids[self.ends[n] : total] = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
            self.known.update(zip(part, range(n, n + len(part)), strict=True))
            self.held += sum(map(len, part))

    def uncut(self, body: np.ndarray, ends: np.ndarray) -> list[int]:
        """The texts to encode whole."""
        if not self.cuts:
            return list(range(len(ends) - 1))
        data, found = body.tobytes(), set()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                i = int(np.searchsorted(ends, at, "right")) - 1
                if at + len(token) <= ends[i + 1]:
                    found.add(i)
                    at = int(ends[i + 1]) - 1
                at = data.find(token, at + 1)
        return sorted(found)

    def __call__(self, body: np.ndarray, ends: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``last`` after each, and the texts' n + 1 offsets in them."""
        found, per_text = pieces(body, ends, self.uncut(body, ends))
        n_texts = len(ends) - 1
        if not len(found):
            return np.full(n_texts, last, np.uint32), np.arange(n_texts + 1, dtype=np.int64)
        coded = found.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.most or self.held > self.most_bytes:
            self._shrink()
        places = list(map(self.known.get, distinct))
        if None in places:
            self._learn([x for x, k in zip(distinct, places, strict=True) if k is None])
            places = list(map(self.known.get, distinct))
        places = np.array(places, np.int32)
        self.seen[places] += 1
        at = places[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.ends[at + 1] - self.ends[at]
        total = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=total[1:])
        index = np.repeat(self.ends[at] - total[:-1], sizes)
        index += np.arange(total[-1], dtype=np.int32)
        stream = self.ids[index]
        bounds = total[per_text]
        out_ends = bounds + np.arange(n_texts + 1)
        out = np.empty(int(out_ends[-1]), np.uint32)
        is_last = np.zeros(len(out), bool)
        is_last[out_ends[1:] - 1] = True
        out[is_last] = last
        out[~is_last] = stream
        return out, out_ends


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary; it stays between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
