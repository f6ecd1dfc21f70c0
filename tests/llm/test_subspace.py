import math
from collections import defaultdict

import numpy as np
import pytest

from tidewright.llm import subspace

SCHEMA = "vec_id long, embedding array<double>, label int, cid long"


def brute(rows, least):
    ok = [label is not None and v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) for _, v, label, _ in rows]
    links = defaultdict(set)
    for i, (_, x, lx, _) in enumerate(rows):
        for j in range(i):
            _, y, ly, _ = rows[j]
            if ok[i] and ok[j] and lx == ly and len(x) == len(y):
                a, b = np.array(x), np.array(y)
                if (a @ b) / math.sqrt((a @ a) * (b @ b)) >= least:
                    links[i].add(j)
                    links[j].add(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i not in seen:
            todo, part = [i], {i}
            while todo:
                for k in links[todo.pop()] - part:
                    part.add(k)
                    todo.append(k)
            seen |= part
            ids = [rows[k][0] for k in part if rows[k][0] is not None]
            for k in part:
                out[k] = (rows[k][0], len(links[k]), min(ids) if ids else None)
    return sorted(out, key=str)


@pytest.mark.parametrize(("dim", "least"), [(64, 0.98), (6, 0.9), (1, 0.98)])
def test_matches_brute_force(spark, monkeypatch, dim, least):
    monkeypatch.setattr(subspace, "CELL_ROWS", 40)
    rng = np.random.default_rng(dim)
    rows, centre = [], rng.normal(size=dim)
    for i in range(300):
        kind = i % 3
        v = centre + rng.normal(size=dim) * 0.11 * np.linalg.norm(centre) / math.sqrt(dim) if kind == 0 else rng.normal(size=dim)
        if kind == 1 and rows and rows[-1][1]:
            w = rng.normal(size=dim)
            u = np.array(rows[-1][1])
            if dim > 1 and len(u) == dim:  # right at the threshold, a hair on either side
                u, w = u / np.linalg.norm(u), w - (w @ u) / (u @ u) * u
                v = least * u + math.sqrt(1 - least**2) * (1 + 1e-7 * (-1) ** i) * w / np.linalg.norm(w)
        rows.append((1000 - i, v.tolist(), i % 2 if kind else 0, i))
    rows += [(5, None, 1, 0), (6, [], 1, 0), (7, [0.0] * dim, 1, 0), (8, [math.nan] * dim, 1, 0), (9, [math.inf] * dim, 1, 0), (10, [None] * dim, 1, 0), (11, rows[0][1], None, 0), (None, rows[0][1], 0, 0), (12, rows[0][1], 0, 0), (12, rows[0][1], 0, 0), (13, [1.0] * (dim + 1), 1, 0), (14, [-0.0] * (dim - 1) + [1.0], 3, 0), (15, [0.0] * (dim - 1) + [2.0], 3, 0)]
    got = subspace.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), least=least).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == brute(rows, least)


def test_empty(spark):
    assert subspace.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_vectors_whose_squares_over_or_underflow(spark):
    rows = [(1, [1e200, 0.0, 1e150, 0.0], 1), (2, [2.0, 0.0, 0.0, 0.0], 1), (3, [1e-200, 0.0, 0.0, 1e-310], 1), (4, [0.0, 5e-324, 0.0, 0.0], 1), (5, [0.0, 1e308, 1e300, 0.0], 1), (6, [0.0] * 4, 1)]
    got = subspace.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6)]
