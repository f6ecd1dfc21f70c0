from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import no_documents, odd_documents
from tidewright.llm import mixing


def filled(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        give = {s: left * w[s] / total for s in free}
        left = 0.0
        for s in list(free):
            target[s] += give[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def test_shares_near_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_UNITS", 50)
    rows = [(i, "w " * (1 + (i * 7919) % 300), "abcdefg"[min(i % 10, 6)] if i % 11 else None) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.shares(docs).collect()
    again = {(r.doc_id, r.copies) for r in mixing.shares(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        assert 0 <= r.copies <= 2
    want = filled(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
    for s, t in taken.items():
        assert abs(t - want[s]) <= 5
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(r.copies for r in got) and mixed.columns == docs.columns


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    p, d, w = rng.random(500), np.ones(500), rng.integers(0, 400, 500).astype(float)
    q = mixing.flight(p, d, w, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-3 and abs(q @ w - p @ w) < 1e-2
    same = mixing.flight(np.full(9, 0.4), np.ones(9), np.full(9, 5.0), rng)
    assert abs(same.sum() - 3.6) < 1e-6


def test_one_long_document_does_not_move_its_source(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for group in (20_000, 30):
        monkeypatch.setattr(mixing, "GROUP_UNITS", group)
        rows = [(k * 1000 + i, "w " * int(n), f"s{k}") for k in range(6) for i, n in enumerate([5184, *rng.integers(20, 900, 60)])]
        sizes, taken, least = defaultdict(int), defaultdict(int), defaultdict(lambda: 10**9)
        for r in mixing.shares(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
            sizes[r.source] += r.size
            taken[r.source] += r.size * r.copies
            least[r.source] = min(least[r.source], r.size)
        for s, target in filled(sizes).items():
            assert abs(taken[s] - target) <= max(least[s], 0.01 * target)


def test_exchanges_keep_documents():
    rng = np.random.default_rng(5)
    p, d, w = rng.integers(0, 2, 400).astype(float), rng.integers(1, 3, 400).astype(float), rng.integers(0, 500, 400).astype(float)
    q = mixing.exchanged(p, d, w, 1234.0)
    assert q @ d == p @ d and abs(q @ w - p @ w - 1234) <= 1
    assert (mixing.exchanged(p, d, w, 0.2) == p).all() and (mixing.exchanged(np.ones(3), d[:3], w[:3], 50.0) == 1).all()


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = mixing.shares(docs).collect()
    assert sum(r.m for r in got) == docs.count()
    assert all(r.size == 0 for r in got if r.doc_id in (0, 1, 2))
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(no_documents(spark)).count() == 0


def test_water_filling_matches_resharing(spark):
    rng = np.random.default_rng(0)
    for _ in range(4):
        sizes = {f"s{i}": int(10 ** rng.uniform(0, 6)) for i in range(9)} | {"zero": 0, None: 50}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        want = filled(sizes)
        for r in mixing.targets(df).collect():
            assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)


def test_columns_of_any_name(spark):
    rows = [(i, f"word {i} " * 9, f"s{i % 2}", i, i, i, i, i, i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_n long, `a.b` long, id long, h long, copies long, row long")
    got = mixing.mix(docs)
    assert got.columns == docs.columns and got.count() >= 40
    assert all(len({r.doc_id, r._mix_n, r["a.b"], r.id, r.h, r.copies, r.row}) == 1 for r in got.collect())
