import random
from collections import Counter

import corpus_pipeline
from tests.llm.helpers import ODD_TEXTS, no_documents, odd_documents
from tests.llm.test_mixing import filled
from tests.llm.test_minhash import WORD


def made(tmp_path, spark, n=240):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(2000)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(15, 150))]
        bad = i % 6 == 0
        text = " ".join(x + "###" if bad else x for x in w)
        if i // 3 % 2:  # 40 pages of each host
            text += "\nthis line is on very many pages of the host and says nothing at all"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not bad), 0))
    rows += [(n + k, rows[7][1] + " " * k, "en", "s1", 1) for k in range(12)]
    rows += [(n + 100 + k, t, None, None, None) for k, t in enumerate(ODD_TEXTS)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows


def test_stages(spark, tmp_path):
    rows = made(tmp_path, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        seen.append(docs.collect())
    rules, good, unique, mixed, packed = seen
    by = {r.doc_id: r.text for r in rules}
    assert all("very many pages" not in t for t in by.values())  # the frequent line is gone, its documents are not
    assert {r[0] for r in rows if r[0] is not None and r[0] < 240} <= set(by) and not {240 + 100, 240 + 101} & set(by)
    assert not any(r.doc_id < 240 and r.doc_id % 6 == 0 for r in good)
    assert {r.doc_id for r in good} >= {i for i in range(240) if i % 6}
    ids = {r.doc_id for r in unique}
    assert 7 in ids and not ids & set(range(240, 252)) and ids >= {i for i in range(240) if i % 6}
    sizes, taken = Counter(), Counter()
    for r in unique:
        sizes[r.source] += len(WORD.findall(r.text))
    for r in mixed:
        taken[r.source] += len(WORD.findall(r.text))
    for s, target in filled(sizes).items():
        assert abs(taken[s] - target) <= 80
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed)


def test_stages_take_empty_tables(spark, tmp_path):
    made(tmp_path, spark, 12)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, no_documents(spark), str(tmp_path))
        assert out.count() == 0, name
        assert name == "best_fit_packing" or out.columns == corpus_pipeline.COLUMNS


def test_stages_take_odd_rows(spark, tmp_path):
    made(tmp_path, spark, 12)
    for name, stage in corpus_pipeline.STAGES:
        docs = odd_documents(spark)
        out = stage(spark, docs, str(tmp_path))
        assert name == "best_fit_packing" or out.columns == corpus_pipeline.COLUMNS
        assert out.count() >= 0


def test_run(spark, tmp_path):
    made(tmp_path, spark, 60)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
