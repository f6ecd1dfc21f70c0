import hashlib
import math
import random

import numpy as np
import pytest

from tidewright.llm import vector_codes as q

SCHEMA = "vec_id long, embedding array<double>, label int, code int, n string, body double"


def brute(rows, entries=256, rounds=4):
    """Row by row in Python's integers: {(id, label): [(code, error)]} and the digest."""
    kept = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4)
    cut = lambda v: [[math.floor(1024 * c) if abs(c) < 1e300 else int(c) * 1024 for c in (list(v) + [0.0] * 4 * width)[p * width : (p + 1) * width]] for p in range(4)]
    vectors = [cut(v) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[vectors[k][p] for k in order] for p in range(4)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        at = [[near(p, v[p])[1] for v in vectors] for p in range(4)]
        for p in range(4):
            for e in set(at[p]):
                own = [v[p] for v, k in zip(vectors, at[p], strict=True) if k == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for (i, _, x), v in zip(kept, vectors, strict=True):
        found = [near(p, v[p]) for p in range(4)]
        out.append((i, x, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()


def run(spark, rows, partitions=3, **more):
    df = spark.createDataFrame([(i, v, x, 1, "n", 0.5) for i, v, x in rows], SCHEMA).repartition(partitions)
    return q.label_errors(q.encode(df, **more)).collect()


def same(got, rows, **more):
    want, digest = brute(rows, **more)
    sums = {}
    for _, x, _, e in want:
        sums[x] = sums.get(x, 0) + e
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in got), key=repr) == sorted(((i, x, c, e, sums[x]) for i, x, c, e in want), key=repr)
    assert {r.codebooks_sha256 for r in got} <= {digest}


@pytest.mark.parametrize("scale", [1.0, 4e4, 3e15])
def test_matches_brute_force(spark, scale):
    """With 32-bit, 64-bit and Python's integers."""
    rng = random.Random(7)
    kind = q.integers(scale, 8, 80)
    assert kind is {1.0: np.int32, 4e4: np.int64, 3e15: object}[scale]
    most = 1.0 if kind is object else scale  # so that errors still fit a long
    rows = [(rng.randrange(1000), [rng.uniform(-most, most) for _ in range(8)], rng.choice([None, 1, 2])) for _ in range(78)]
    rows += [(5000, [scale] + [0.0] * 7, 3), (5001, [scale] + [0.0] * 7, 3)]
    same(run(spark, rows, entries=16), rows, entries=16)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [nan] * 4, 1), (4, [0.0, inf, 0.0, 0.0], None), (5, [], None), (6, [0.5], 2), (7, [-1e-20, 1.0, 2.0, 3.0, 4.0], 2), (7, [-1e-20, 1.0, 2.0, 3.0, 4.0], 2), (None, [0.1] * 4, None), (9, [0.0] * 8, None), (9, [-0.5] * 8, 2)]
    got = run(spark, rows, entries=3)
    assert len(got) == 7
    same(got, rows, entries=3)
    assert run(spark, rows[:4]) == []
    assert q.label_errors(q.encode(spark.createDataFrame([], SCHEMA))).collect() == []
    only = run(spark, [(5, [], 1)])
    assert [(r.code, r.error) for r in only] == [("00000000", 0)]


def test_errors_beyond_a_long_are_null(spark):
    rows = [(1, [0.0] * 4, 1), (2, [1e200] * 4, 1), (3, [1.0] * 4, 2)]
    got = {r.vec_id: (r.error, r.label_error) for r in run(spark, rows, entries=1, rounds=0)}
    assert got == {1: (0, None), 2: (None, None), 3: (4 * 1024**2, 4 * 1024**2)}


def test_ties_go_to_the_lower_entry_and_unused_entries_stay(spark):
    rows = [(1, [0.0] * 4, 1), (2, [2 / 1024] * 4, 1), (3, [2 / 1024] * 4, 1), (4, [1 / 1024] * 4, 1)]
    got = run(spark, rows, entries=3, rounds=0)
    assert {r.vec_id: r.code for r in got} == {1: "00000000", 2: "01010101", 3: "01010101", 4: "00000000"}
    same(run(spark, rows, entries=3), rows, entries=3)


def test_results_do_not_follow_the_partitions(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(12)], i % 3) for i in range(300)]
    runs = [sorted(map(tuple, run(spark, rows, n))) for n in (1, 7)]
    assert runs[0] == runs[1]
    same(run(spark, rows), rows)


def test_refused_names(spark):
    with pytest.raises(ValueError):
        q.encode(spark.createDataFrame([], SCHEMA), label="code")
