import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import no_documents, odd_documents
from tidewright.llm import suffix_tree as q
from tidewright.llm.common import WordHash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    passage = "the quick brown fox jumps over the lazy dog and the cat".split()
    docs = []
    for i in range(n):
        w = [rng.choice(["the", "of", "and", "a"]) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.5:
            w[len(w) // 2 : len(w) // 2] = passage
        docs.append((i, " ".join(w)))
    return docs


def base(docs):
    train = [t for i, x in docs if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(x)]
    c, n = Counter(train), len(train)
    v = len(c)
    return [(i, len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x))) for i, x in docs]


@pytest.mark.parametrize("known", [300_000, 50])
def test_base_and_gain(spark, monkeypatch, known):
    monkeypatch.setattr(q, "KNOWN", known)
    docs = [*corpus(), (9000, None), (9001, ""), (9002, "never seen Words")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    tree, words = q.train(df.filter(~q.held_out()).select("text"))
    got = {r.doc_id: r for r in q.score(df, tree, words).collect()}
    for i, n, n_known, total, b in base(docs):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, n_known, total)
        assert r.base_score == pytest.approx(b, rel=1e-9, abs=1e-9)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.9


def test_distributions_sum_to_one_and_use_the_longest_suffix(spark):
    docs = corpus(300, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tree, words = q.train(df.select("text"))
    assert len(tree.keys) == q.DEPTH and (tree.left[0] < 1).any() and (tree.left[2] < 1).any()
    hashed = WordHash()
    vocab = [w for w in {t for _, x in docs for t in tokens(x)} if w is not None]
    for context in ("the quick brown", "and the", "of", "w1", "zzz"):
        texts = [f"{context} {w}" for w in [*vocab, "unseenword"]]
        codes, h, at = q.token_codes(pa.array([*texts, context]), hashed)
        t = h[codes]
        place, number, end_number = tree.numbers(t)
        p = np.where(place >= 0, (tree.counts[place] + 1.0) / (tree.n + tree.v + 1.0), 1.0 / (tree.n + tree.v + 1.0))
        for level, (where, ctx, run) in enumerate(tree.runs(number, at, end_number)):
            own = np.zeros(len(where))
            own[run >= 0] = tree.own[level][run[run >= 0]]
            p[where] = own + tree.left[level][ctx] * p[where]
        k = len(context.split())
        total = sum(p[at[:-2] + k]) + p[at[-1] - 1]  # every next word, the unseen one, and the end
        assert total == pytest.approx(1, abs=1e-9)
    codes, h, at = q.token_codes(pa.array(["the quick brown fox", "brown fox"]), hashed)
    assert tree.score(h, at, codes)[2][0] > -12


def plain_scores(train, texts, frequent, depth=q.DEPTH):
    """The whole method with dictionaries: counts of runs, contexts kept by their gain, and the scores of ``texts``. Contexts of
    fewer than ``frequent`` occurrences are learned with all words that follow them ``LEAST`` times."""
    sequences = [[None, *tokens(x)] for x in train]
    words = Counter(t for s in sequences for t in s[1:])
    n, v = sum(words.values()), len(words)
    runs = Counter(tuple(s[i : i + k + 1]) for s in sequences for k in range(1, depth + 1) for i in range(len(s) - k))
    every, followed = runs, Counter(tuple(s[i - k : i]) for s in sequences for i in range(1, len(s)) for k in range(1, min(depth, i) + 1))
    runs = {r: c for r, c in runs.items() if c >= frequent}
    followers = {}
    for r, c in runs.items():
        followers.setdefault(r[:-1], {})[r[-1]] = c
    total = lambda c: words[c[0]] if len(c) == 1 else runs[c]
    kept = {}

    def p(context, w):
        out = (words[w] + 1) / (n + v + 1)
        for k in range(1, len(context) + 1):
            if context[-k:] in kept:
                own, left = kept[context[-k:]]
                out = own.get(w, 0.0) + left * out
        return out

    for k in range(1, depth + 1):
        for c in [c for c in followers if len(c) == k]:
            parent = {w: p(c[1:], w) for w in followers[c]}
            gain = sum(m * math.log(m / total(c) / parent[w]) for w, m in followers[c].items())
            rest = 1 - sum(followers[c].values()) / total(c)
            if rest > 1e-9:
                gain += total(c) * rest * math.log(rest / max(1e-12, 1 - sum(parent.values())))
            if gain >= q.TEST:
                own = {w: (m - q.DISCOUNT) / total(c) for w, m in followers[c].items()}
                kept[c] = own, 1 - sum(own.values())
    known = {(w,) for w in words if words[w] >= frequent} | runs.keys()
    for k in range(1, depth + 1):
        tail = {}
        for r, c in every.items():
            if len(r) == k + 1 and c >= q.LEAST and r[:-1] not in known:
                tail.setdefault(r[:-1], {})[r[-1]] = c
        beyond = {}
        for c, after in tail.items():
            n_c, parent = followed[c], {w: p(c[1:], w) for w in after}
            gain = sum(m * math.log(m / n_c / parent[w]) for w, m in after.items())
            rest = 1 - sum(after.values()) / n_c
            if rest > 1e-9:
                gain += n_c * rest * math.log(rest / max(1e-12, 1 - sum(parent.values())))
            if gain >= q.TEST:
                own = {w: (m - q.DISCOUNT) / n_c for w, m in after.items()}
                beyond[c] = own, 1 - sum(own.values())
        kept |= beyond
    out = []
    for x in texts:
        s = [None, *tokens(x)]
        out.append(sum(math.log10(p(tuple(s[max(0, i - depth) : i]), s[i])) for i in range(1, len(s))))
    return out, kept


def test_scores_match_a_plain_tree(spark):
    docs = [*corpus(500, 9), (9000, None), (9001, "The quick brown fox never seen"), (9002, "the " * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in q.score(df, *q.train(df.filter(~q.held_out()).select("text"))).collect()}
    want, kept = plain_scores([x for i, x in docs if zlib.crc32(str(i).encode()) % 7 != 2], [x for _, x in docs], q.LEAST)
    assert {len(c) for c in kept} == {1, 2, 3}
    for (i, _), w in zip(docs, want, strict=True):
        assert got[i] == pytest.approx(w, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("apart", [False, True])
def test_tail_matches_a_plain_tree(spark, monkeypatch, apart):
    monkeypatch.setattr(q, "P_MIN", 0.004)
    monkeypatch.setattr(q, "_PART_TOKENS", 2_000)
    docs = [*corpus(600, 3), (9000, None), (9001, "The quick brown fox never seen"), (9002, "the " * 50)]
    docs += [(10_000 + i, f"rare pair number{i % 9} stands here") for i in range(60)]
    train = [x for i, x in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    frequent = math.ceil(q.P_MIN * sum(len(tokens(x)) for x in train))
    assert frequent > 10 * q.LEAST
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    if apart:
        got = q.score(df, *q.train(df.filter(~q.held_out()).select("text")))
    else:
        texts = q.encoded(df)
        got = q.scored(texts, *q.learn(texts))
    got = {r.doc_id: r.score for r in got.collect()}
    want, kept = plain_scores(train, [x for _, x in docs], frequent)
    assert sum("rare" in x for x in train if x) < frequent and ("rare",) in kept and {len(c) for c in kept} == {1, 2, 3}
    # contexts longer than a known one, too
    assert any(len(c) > 1 and sum(" ".join(map(str, c)) in x.lower() for x in train if x) < frequent for c in kept)
    for (i, _), w in zip(docs, want, strict=True):
        assert got[i] == pytest.approx(w, rel=1e-6, abs=1e-5)


@pytest.mark.parametrize("apart", [False, True])
def test_words_that_are_not_known_are_learned(spark, monkeypatch, apart):
    """Words beyond the known ones are predicted by contexts, and stand in contexts, as all others."""
    monkeypatch.setattr(q, "P_MIN", 0.004)
    monkeypatch.setattr(q, "KNOWN", 10)
    monkeypatch.setattr(q, "_PART_TOKENS", 2_000)
    docs = [*corpus(600, 3), (9000, None), (9001, "The quick brown fox never seen"), (9002, "the " * 50), (9003, "the stands here")]
    docs += [(10_000 + i, f"rare pair number{i % 9} stands here") for i in range(60)]
    docs += [(20_000 + i, f"once{i} scarce the match number{i % 9}") for i in range(40)]
    train = [x for i, x in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(t for x in train for t in tokens(x))
    frequent = math.ceil(q.P_MIN * sum(counts.values()))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    if apart:
        tree, words = q.train(df.filter(~q.held_out()).select("text"))
        got = [q.score(df, tree, words), q.score(df, tree, words)][1]
    else:
        texts = q.encoded(df)
        tree, words = q.learn(texts)
        got = q.scored(texts, tree, words)
    got = {r.doc_id: r for r in got.collect()}
    # all words of the head are known, and none else
    assert sorted(tree.counts) == sorted(c for c in counts.values() if c >= frequent) and len(tree.counts) >= q.KNOWN
    want, kept = plain_scores(train, [x for _, x in docs], frequent)
    own = {(c, w) for c, (own, _) in kept.items() for w in own}
    assert any(q.LEAST <= counts[w] < frequent and counts[c[-1]] < frequent for c, w in own) and any(counts[w] < frequent <= counts[c[-1]] for c, w in own)
    for (i, x), w, b in zip(docs, want, base(docs), strict=True):
        assert got[i].score == pytest.approx(w, rel=1e-6, abs=1e-5), x
        assert got[i].n_known == b[2] and got[i].base_score == pytest.approx(b[4], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("share", [1e-9, 0.03])
def test_phrases_are_learned_whatever_the_size(spark, monkeypatch, share):
    """Contexts below the share, which a larger corpus makes a larger count, are learned at every length by an absolute count."""
    monkeypatch.setattr(q, "_PART_TOKENS", 5_000)
    rng = random.Random(4)
    texts = [" ".join(f"n{rng.randrange(300)}" for _ in range(44)) for _ in range(800)]
    texts += [f"{x} n{rng.randrange(300)}" for x in ["x a b c"] * 400 + ["y a b d"] * 400]
    texts = [f"u{i} {t}" for i, t in enumerate(texts)]  # nothing follows the end of a text, which is frequent at any size, three times
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(q, "P_MIN", share)
    asked = ["u1 x a b c n2", "u3 y a b d", "u4 a b c", "u5 x a b d n6"]
    tree, words = q.train(train.select("text"))
    assert tree.frequent == (3 if share < 1e-6 else math.ceil(share * tree.n)) and (share < 1e-6 or tree.frequent > 1000)
    got = {r.doc_id: r.score for r in q.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), tree, words).collect()}
    want, kept = plain_scores(texts, asked, q.LEAST)
    assert ("x", "a", "b") in kept
    for i, w in enumerate(want):
        assert got[i] == pytest.approx(w, abs=1e-3)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    tree, words = q.train(docs.filter(~q.held_out()).select("text"))
    got = q.score(docs, tree, words).collect()
    want = Counter((i, n, k, t, round(b, 6)) for i, n, k, t, b in base([(r.doc_id, r.text) for r in docs.collect()]))
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    empty = no_documents(spark)
    tree, words = q.train(empty.select("text"))
    assert q.score(empty, tree, words).count() == 0
    assert q.score(docs, tree, words).filter("base_score <> 0").count() == 0
