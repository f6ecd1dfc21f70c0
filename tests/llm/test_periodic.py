import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ODD_TEXTS, no_documents, odd_documents
from tidewright.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6, times=4):
    """All runs by trying every period at every place."""
    found, n = set(), len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                found.add((i, j + q - i, q))
            i = j + 1
    # the same stretch has the multiples of its period, too
    return sorted(r for r in found if not any(x[:2] == r[:2] and x[2] < r[2] for x in found))


def runs_of(texts, **limits):
    codes = np.array([x for t in texts for x in t], np.int64)
    ends = np.cumsum([0, *map(len, texts)])
    got = periodic.runs_of(codes, ends, **limits)
    return [sorted((a - ends[i], n, q) for a, n, q in got.tolist() if ends[i] <= a < ends[i + 1]) for i in range(len(texts))]


PHRASE = st.builds(lambda w, k, c: (w * k)[: len(w) * k - c], st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 9), st.integers(0, 4))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(PHRASE | st.lists(st.integers(0, 2), max_size=6), max_size=6).map(lambda p: [x for y in p for x in y]), min_size=1, max_size=5))
def test_runs_match_brute_force(texts):
    assert runs_of(texts) == [brute(t) for t in texts]
    assert runs_of(texts, times=3) == [brute(t, times=3) for t in texts]


def test_nested_and_long_runs():
    rng = random.Random(8)
    inner = [1] * 9 + [2]
    long = [rng.randrange(400) for _ in range(700)]
    texts = [inner * 7, [5] * 5000, long * 5, [9, *long * 4, 9], long[:3] * 1000 + [7] + long[:3] * 1000, list(range(3000))]
    assert runs_of(texts) == [brute(t) for t in texts]


def test_tree_nodes_are_the_common_prefixes():
    rng = random.Random(2)
    w = [rng.randrange(3) for _ in range(60)]
    tree = periodic.SuffixTree(np.array(w, np.int64), np.zeros(len(w), np.int64))
    assert tree.suffixes.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
    for depth, low, middle, high in zip(*(x.tolist() for x in tree.nodes()), strict=True):
        held = [w[i : i + depth] for i in tree.suffixes[low:high].tolist()]
        assert all(x == held[0] and len(x) == depth for x in held) and low < middle < high
        sides = [{tuple(w[i + depth : i + depth + 1]) for i in tree.suffixes[a:b].tolist()} for a, b in ((low, middle), (middle, high))]
        assert not sides[0] & sides[1]
    # branching repeats: two copies, the word after which is not the one a period before it
    want = {(i, d) for d in range(1, 31) for i in range(len(w) - 2 * d + 1) if w[i : i + d] == w[i + d : i + 2 * d] and w[i + d : i + d + 1] != w[i + 2 * d : i + 2 * d + 1]}
    assert set(zip(*(x.tolist() for x in tree.branching_repeats()), strict=True)) == want


def test_parts_of_leaf_lists_change_nothing(monkeypatch):
    texts = [[1, 2, 3] * 20 + [4] * 30, [1, 2] * 9]
    want = runs_of(texts)
    monkeypatch.setattr(periodic, "LEAVES", 3)
    assert runs_of(texts) == want == [brute(t) for t in texts]


def test_limits():
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(9, np.int64), np.array([0, 9]), times=2)


def test_odd_rows(spark):
    docs = odd_documents(spark, ["a b " * 4, "x a b c a b c a b c a b c a y", "\x0b".join("pqpqpqpqp")])
    got = periodic.find(docs).collect()
    assert len(got) == docs.count()
    by_text = {r.collapsed: [tuple(x) for x in r.runs] for r in got}
    assert by_text["word"] == [(0, 9, 1)] and by_text["long"] == [(0, 30000, 1)]
    assert by_text["a b"] == [(0, 8, 2)] and by_text["x a b c y"] == [(1, 13, 3)] and by_text["p q"] == [(0, 9, 2)]
    assert by_text[""] == [] and sum(r.n_words == 0 for r in got) >= 4
    assert periodic.find(docs, keep=("doc_id", "source", "size")).columns == ["doc_id", "source", "size", "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError):
        periodic.find(docs.withColumnRenamed("bin", "runs"), keep=("doc_id", "runs"))
    assert periodic.find(no_documents(spark)).count() == 0


def row_of(doc_id, text):
    """The query's row by its definition."""
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    texts = ["".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))), " ".join(x for i, x in enumerate(w) if i not in gone)]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(t.encode()).hexdigest() for t in texts))


def test_query(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "dd", "\n"]) for _ in range(rng.randrange(90)))) for i in range(300)] + [(None, "k " * 8), (None, None)] + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS) if len(t or "") < 1000]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic.op13(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((row_of(*d) for d in docs), key=repr)
    assert sum(r[1] > 0 for r in got) > 20
