"""Word shingles of whole texts as sorted sets of 64-bit hashes, vectorised over blocks of texts."""

from __future__ import annotations

import numpy as np

from tidewright.llm.common import WordHash, coded, lowered, mixed, raw, words


def shingle_sets(texts, width: int, hashed: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending within it, and the n + 1 offsets of the texts.

    A text with fewer words than ``width`` has its whole sequence as its one shingle; one without words has none."""
    body, ends = raw(texts)
    found, at = words(lowered(body), ends)
    codes, distinct = coded(found)
    h = hashed(distinct)[codes]
    n = np.diff(at)
    m = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    owner = np.repeat(np.arange(len(n)), m)
    out_at = np.concatenate([[0], np.cumsum(m)])
    first = at[:-1][owner] + (np.arange(out_at[-1]) - out_at[:-1][owner])
    acc = np.full(len(first), 0x9E3779B97F4A7C15, np.uint64)
    last = at[1:][owner]
    for k in range(width):
        inside = first + k < last
        nxt = np.zeros(len(first), np.uint64)
        nxt[inside] = h[(first + k)[inside]]
        acc = mixed(acc * np.uint64(0xD6E8FEB86659FD93) + nxt + inside.astype(np.uint64))
    for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True):
        acc[a:b].sort()
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    return acc[new], np.concatenate([[0], np.cumsum(new)])[out_at]


def signatures(sets: np.ndarray, at: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """16-bit MinHash symbols, one row of ``size`` per set; rows of empty sets are zero."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, size, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, size, np.int64).astype(np.uint64)
    out = np.zeros((len(at) - 1, size), np.uint16)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        starts = at[:-1][full]
        for k in range(size):
            least = np.minimum.reduceat(sets * odd[k] + plus[k], starts)
            out[full, k] = (mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out
