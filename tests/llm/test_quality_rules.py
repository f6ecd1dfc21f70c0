import random
import re
from collections import defaultdict

from tests.llm.helpers import ODD_TEXTS, no_documents, odd_documents
from tidewright.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n


def normal(line):
    return re.sub(r"[ \t\x0b\f\r]+", " ", line.lower()).strip(" ")


def judged(rows, max_docs):
    """The whole method in plain Python."""
    held = defaultdict(set)
    docs = []
    for key, text, host in rows:
        docs.append((key, text, host, frozenset(x for x in map(normal, (text or "").split("\n")) if x)))
        for x in docs[-1][3]:
            held[host, x].add(docs[-1][3])
    frequent = {k for k, c in held.items() if len(c) > max_docs}
    out = []
    for key, text, host, _ in docs:
        gone = sum(len(normal(x).split(" ")) for x in (text or "").split("\n") if normal(x) and (host, normal(x)) in frequent)
        b = base(text)
        out.append((key, *b, not b[5] and b[0] - gone >= 10 and b[0] - gone >= 0.1 * b[0], gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["a#b", "é", "x|y"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    common = [line(8) for _ in range(4)]
    rows = []
    for i in range(150):
        parts = [line(rng.randrange(1, 15)) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(common).upper() if rng.random() < 0.3 else f"  {rng.choice(common)}\t")
        if rng.random() < 0.1:
            parts = [rng.choice(common), "one word"]
        if rng.random() < 0.2:
            parts += parts[:2]
        rows.append((i, "\n".join(parts), rng.choice(["h1", "h2", None])))
    copies = "\n".join(line(9) for _ in range(4))
    return rows + [(1000 + k, copies, "h1") for k in range(40)] + [(2000 + k, t, "h1") for k, t in enumerate(ODD_TEXTS)]


def test_matches_plain_python(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_removed_words) for r in q.judge(df, max_docs=5).collect())
        assert got == sorted(judged(rows, 5))
        assert any(r[-1] for r in got)
        assert all(r[-2] for r in got if 1000 <= r[0] < 1040)  # copies of one text are no boilerplate


def test_clean_removes_lines_and_documents(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], "doc_id long, text string, source string, n_words long, id string, kept int")
    cleaned = q.clean(df, max_docs=5)
    assert cleaned.columns == df.columns
    verdict = {r[0]: r for r in judged(rows, 5)}
    texts = {r[0]: r[1] for r in rows}
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert set(got) == {k for k, r in verdict.items() if r[-2]}
    for k, text in got.items():
        assert len(WORD.findall(text)) == verdict[k][1] - verdict[k][-1]
        if not verdict[k][-1]:
            assert text == texts[k]


def test_clean_takes_template_lines_from_distinct_pages(spark):
    rng = random.Random(7)
    line = lambda: " ".join(f"v{rng.randrange(10_000)}" for _ in range(8))
    rows, template, page = [], {}, "\n".join(line() for _ in range(4))
    for host, n in (("a", 5), ("b", 10)):
        template[host] = [line() for _ in range(n)]
        rows += [(len(rows) + k, "\n".join([*template[host], *(line() for _ in range(5))]), host) for k in range(60)]
    # two texts, copied very often, are no boilerplate; nor is a line that just max_docs pages hold
    rows += [(1000 + k, page, "a") for k in range(400)] + [(2000 + k, page + "\n" + line() * (k == 0), "a") for k in range(200)]
    few = line()
    rows += [(3000 + k, "\n".join([few, line(), line()]), "b") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r.text for r in q.clean(df).collect()}
    assert set(got) == {k for k, _, _ in rows}
    assert [(r.doc_id, r.n_removed_words) for r in q.judge(df).orderBy("doc_id").collect()] == [(k, sum(8 * (x in template[h]) for x in t.split("\n"))) for k, t, h in rows]
    for k, text, host in rows:
        want = "\n".join(x for x in text.split("\n") if x not in template[host])
        assert got[k] == want


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = q.judge(docs).collect()
    assert len(got) == docs.count() and all(not r.kept for r in got if r.n_words == 0)
    assert q.clean(docs).columns == docs.columns
    assert q.clean(docs).count() == sum(r.kept for r in got)
    assert q.judge(no_documents(spark)).count() == 0
