import random
import re

import pyarrow as pa

from tests.llm.helpers import ODD_TEXTS, no_documents, odd_documents
from tidewright.llm import licences as q

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_of(text):
    w = words_of(text)
    places = [(i, label) for p, label in q.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_matches_brute_force():
    rng = random.Random(4)
    parts = ["CC", "by", "BY", "general", "public", "License", "all", "rights", "reserved", "é", "x1", "\n", ".", "cc-by", "the"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(400)] + ODD_TEXTS + ["all rights", "reserved"]
    for text, got in zip(texts, q.Scanner().scan(pa.array(texts)), strict=True):
        assert got[:5] == base_of(text)


def test_matching_statistics_match_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        seqs = [[rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(3)]
        runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        auto = q.Automaton(seqs)
        t = [rng.randrange(5) for _ in range(40)]
        want = []
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                grows = (i and tuple(t[i - 1 : j]) in runs) or (j < len(t) and tuple(t[i : j + 1]) in runs)
                if tuple(t[i:j]) in runs and not grows:
                    want.append((i, j - i))
        got = auto.matches(t)
        assert sorted((a, n) for a, n, _ in got) == sorted(want)
        for a, n, state in got:
            holders = {k for k, s in enumerate(seqs) if any(s[i : i + n] == t[a : a + n] for i in range(len(s)))}
            assert set(auto.ends[state]) == holders
            for k, end in auto.ends[state].items():
                assert seqs[k][end - n + 1 : end + 1] == t[a : a + n]


def test_labels_and_spans():
    mit = dict((n, t) for n, t in reversed(q.TEMPLATES) if n == "mit")["mit"]
    texts = ["x. Released under the MIT License.", "y Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "under the license of the software", "a b c " + q.TEMPLATES[5][1].replace("free of charge", "gratis and free of charge") + " d", mit.upper()]
    got = q.Scanner().scan(pa.array(texts))
    assert [g[5] for g in got] == ["mit", "cc-by,cc-by-nc", "gpl", "apache-2.0", "", "mit", "mit"]
    assert got[0][7][0]["first"] == 1 and got[0][7][0]["last"] == 5 and got[0][6] == 1.0
    assert got[4][6] == 0.0 and 0.9 < got[5][6] <= 1.0


def test_runs_that_a_template_has_twice():
    apache = q.TEMPLATES[1][1]
    # a run that stands twice in the template, and one that stands elsewhere in it, between parts in order
    altered = "under the apache license version q the license you may not use q in compliance with q the license you may q obtain a copy of"
    stray = "licensed under the apache license version 2 0 the license you may not use this q a copy of q file except in compliance with the license you may obtain a copy"
    twice = f"{apache} x y z {apache} {apache}"
    got = q.Scanner(templates=[("apache-2.0", apache)], phrases={}).scan(pa.array([altered, stray, twice]))
    assert [g[5] for g in got] == ["apache-2.0"] * 3
    assert [(x["first"], x["last"]) for g in got[:2] for x in g[7]] == [(0, len(altered.split()) - 1), (0, len(stray.split()) - 1)]
    n = len(apache.split())
    assert [(x["first"], x["last"], x["covered"]) for x in got[2][7]] == [(k, k + n - 1, 1.0) for k in (0, n + 3, 2 * n + 3)]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = q.scan(docs).collect()
    assert len(got) == docs.count()
    assert all(r.labels == "" and r.score == 0 for r in got if r.n_words == 0)
    assert q.scan(no_documents(spark)).count() == 0
