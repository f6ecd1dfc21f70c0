import random
import re

import numpy as np
import pytest

from tests.llm.helpers import no_documents, odd_documents
from tidewright.llm import minhash
from tidewright.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else ({tuple(w)} if w else set())


def brute(docs):
    ids = [d for d, _ in docs]
    s = [sets_of(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= 80 * (len(s[i]) + len(s[j]) - both):
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
    comp = {}
    for i in range(len(docs)):
        comp.setdefault(find(i), []).append(ids[i])
    return {ids[i]: (len(s[i]), min(comp[find(i)])) for i in range(len(docs))}


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(n):
        if docs and rng.random() < 0.7:
            w = docs[rng.randrange(len(docs)) if rng.random() < 0.5 else 0].split()
            for _ in range(rng.randrange(0, max(1, len(w) // 9) + 1)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w))
        else:
            docs.append(" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 30, 100, 300]))))
    ids = rng.sample(range(10_000), n)
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize(("seed", "listed", "stars"), [(1, 12, 2), (2, 1, 0), (3, 2, 1)])
def test_components_match_brute_force(spark, monkeypatch, seed, listed, stars):
    monkeypatch.setattr(minhash, "LISTED", listed)
    monkeypatch.setattr(minhash, "STARS", stars)
    if not stars:
        monkeypatch.setattr(minhash, "VISITORS", 16)
        monkeypatch.setattr(minhash, "MEMBERS", 16)
    docs = [*corpus(seed), (20_000, None), (20_001, ""), (20_002, "A b"), (20_003, "a B")]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    want = brute(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_keys_cover_the_distance():
    rng = np.random.default_rng(5)
    size = minhash.CHUNKS * minhash.CHUNK
    for _ in range(300):
        a = rng.integers(0, 1 << 16, size).astype(np.uint16)
        b = a.copy()
        at = rng.choice(size, 2 * minhash.CHUNKS - 1, replace=False)
        b[at] += 1
        ka, kb = minhash.chunk_keys(np.stack([a, b]))
        assert set(ka) & set(kb)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert all(r.kept for r in got if r.n_shingles == 0 and r.doc_id is not None)
    by = {r.doc_id: r.component_id for r in got}
    assert by[5] == by[4] == 4
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(3) == 1 and 5 not in ids
    assert minhash.near_duplicates(no_documents(spark)).count() == 0


def test_rows_without_id_go_only_for_their_own_text(spark):
    rng = random.Random(11)
    new = lambda: " ".join(f"w{rng.randrange(100_000)}" for _ in range(60))
    a, b, c, d, e, f = (new() for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (7, c), (7, d), (8, d + " more"), (9, e), (9, f), (9, f), (None, f"{a} more"), (None, None), (None, ""), (None, None), (5, ""), (5, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, cid int").repartition(3)
    left = minhash.deduplicated(df)
    assert left.columns == df.columns
    got = sorted((r.cid for r in left.collect()))
    # a null-id text and a near copy of it: one of the two stays; of the equal rows 7 and 8, 13 and 14, one each
    texts = sorted((str(rows[k][0]), str(rows[k][1])) for k in got)
    first = a if 0 in got else f"{a} more"
    assert texts == sorted((str(i), str(t)) for i, t in [(None, first), (None, b), (7, c), (7, d), (9, e), (9, f), (None, None), (None, None), (None, ""), (5, "")])


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (300, 100), (7, 7), (500, 500)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert all(got[i] == 1 for i in range(1, 61)) and got[200] == got[300] == 100 and got[500] == 500


def test_columns_of_any_name(spark):
    texts = ["one two three four five six seven eight nine ten"] * 3 + ["all other words stand here and no copy of them"]
    docs = spark.createDataFrame([(i, t, i, i, i, i, i) for i, t in enumerate(texts)], "doc_id long, text string, _mh_id long, _mh_h long, id long, h long, stays long")
    got = minhash.deduplicated(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r._mh_id, r.id, r.stays) for r in got.collect()) == [(0, 0, 0, 0), (3, 3, 3, 3)]
