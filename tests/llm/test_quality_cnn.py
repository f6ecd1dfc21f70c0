import random
import zlib

import numpy as np
import pyarrow as pa

from tests.llm.helpers import no_documents, odd_documents
from tidewright.llm import quality_cnn as q
from tidewright.llm.common import raw

LABELS = "doc_id long, quality int, toxic int"


def made(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 200))]
        bad = rng.random() < 0.3
        rows.append((i, " ".join(x + "$$$" if bad else x for x in w), int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = made(500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], LABELS)
    model = q.train(docs, labels)
    got = {r.doc_id: r for r in q.scores(docs, model).withColumn("held", q.held_out()).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held == (i in set(held)) for i in got)
    right = np.mean([(got[i].score >= q.THRESHOLD) == bool(rows[i][2]) for i in held])
    assert len(held) > 50 and right >= 0.97
    flipped = spark.createDataFrame([(i, 1 - y if i in set(held) else y, 0) for i, _, y in rows], LABELS)
    same = {r.doc_id: r.score for r in q.scores(docs, q.train(docs, flipped)).collect()}
    assert all(same[i] == got[i].score for i in same)  # held-out labels are never learned


def test_score_matches_plain_convolution():
    model, rng = q.Model(3), np.random.default_rng(0)
    model.bias[:] = rng.normal(0, 0.2, q.FILTERS)
    texts = ["", "a", "x" * 255, "y" * 257, "".join(map(chr, rng.integers(32, 900, 3000))), "z" * 300_000]
    got = model.score(*raw(pa.array(texts)), model.pairs())
    for text, s in zip(texts, got):
        b = np.frombuffer(text.encode(), np.uint8)
        full = np.concatenate([b, np.zeros(q.WIDTH, np.uint8)])
        n = max(1, len(b))
        act = sum(model.filters[j][full[j : j + n]] for j in range(q.WIDTH)) + model.bias
        tops = [act[a : min(a + q.CHUNK, n)].max(axis=0) for a in range(0, max(1, n - (q.CHUNK - q.STRIDE)), q.STRIDE)]
        z = np.maximum(tops, 0).mean(axis=0) @ model.out + model.shift
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-4


def test_training_sees_all_of_a_long_text(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (90_000, 20_000, 257, 3)] + ["", "é" * 9000]
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][: len(texts)]
    seen = {}
    monkeypatch.setattr(q.Model, "fit", lambda self, chunks, y, w: seen.update(chunks=[np.array(chunks[i]) for i in range(len(chunks))], y=y) or self)
    q.train(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), spark.createDataFrame([(i, i % 2, 0) for i in ids], LABELS))
    assert seen["y"].tolist() == [i % 2 for i in ids]
    for text, x in zip(texts, seen["chunks"], strict=True):
        whole = b"".join(row[: q.STRIDE].tobytes() for row in x[:-1]) + x[-1].tobytes()
        assert whole == text.encode().ljust(len(whole), b"\0") and len(whole) >= len(text.encode())


def test_long_steps_go_in_groups_and_far_texts_are_read_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abc$ ") for _ in range(rng.choice([3, 900, 60_000]))), i % 2) for i in range(40)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y, 0) for i, _, y in rows], LABELS)
    monkeypatch.setattr(q, "EPOCHS", 2)
    monkeypatch.setattr(q.Model.fit, "__defaults__", (2, 0))
    whole = q.train(docs, labels)
    monkeypatch.setattr(q, "STEP_CHUNKS", 100)
    parts = q.train(docs, labels)
    assert np.allclose(whole.filters, parts.filters, atol=1e-4) and np.allclose(whole.out, parts.out, atol=1e-4)
    texts = [t.encode() for _, t, _ in rows]
    monkeypatch.setattr(q, "HELD", 70_000)
    near, far = q.Texts(texts), q.Texts(texts, lambda i, at, n: texts[i][at : at + n])
    assert sum(t is None for t in far.texts) > 5
    for i in range(len(texts)):
        assert (near[i] == far[i]).all()
        for own, counts, x in (g() for g in q._groups(far, np.array([i]))):
            assert counts.sum() == len(x) <= 100 and set(own.tolist()) == {0}
    read = []
    monkeypatch.setattr(q.Model, "fit", lambda self, chunks, y, w: read.append([np.array(chunks[i]) for i in (0, len(chunks) - 1)]) or self)
    q.train(docs, labels)
    held = sorted(i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5)
    assert (read[0][0] == near[held[0]]).all() and (read[0][1] == near[held[-1]]).all()


def test_odd_rows(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in q.scores(docs, q.train(docs, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (4, 0, 0), (None, 0, 1), (5, None, None), (999, 0, 0)], LABELS)
    model = q.train(docs, labels)
    assert q.scores(docs, model).count() == docs.count()
    assert q.good(docs, model).columns == docs.columns
    assert q.scores(no_documents(spark), model).count() == 0
