import hashlib
import json
import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import ODD_TEXTS, no_documents, odd_documents
from tests.llm.test_tokens import PARTS
from tidewright.llm import bpe
from tidewright.llm.tokens import vocabulary

PATH = vocabulary("word_bpe_49k.json")
MODEL = Tokenizer.from_file(PATH)
CODEC = bpe.codec(PATH)
WORDS = st.sampled_from(["'re", "'ve", "'ll", "'d", "'m", "'t", "''s", "-'s", "don't", "S'ound", "12'st", "ΑΣ", "Σ", "Å", "Å", "́", "ﬁ", "привет", "日本", "Ᲊ", "Ɤ", "՘", "ǅ", "\xa0", " ", "\x0b", "\x1f", "²", "Ⅷ", "１", "q" * 30])


def ids_of(text):
    return MODEL.encode(text, add_special_tokens=False).ids


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(PARTS | WORDS | st.characters(exclude_categories=["Cs"]), max_size=14).map("".join), min_size=1, max_size=4))
def test_ids_and_texts_are_the_librarys(texts):
    stream, ends = CODEC(texts)
    for i, t in enumerate(texts):
        assert stream[ends[i] : ends[i + 1]].tolist() == ids_of(t)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(stream))
    assert CODEC.decode(lists).to_pylist() == [MODEL.decode(ids_of(t), skip_special_tokens=False) for t in texts]


def test_characters_of_every_kind():
    rng = random.Random(3)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x600 or rng.random() < 0.02 or unicodedata.category(chr(c)) == "Cn" and rng.random() < 0.01)]
    texts = [f"a{chr(c)}b{chr(c)}{chr(c)}'s" for c in points]
    stream, ends = CODEC(texts)
    wrong = [hex(c) for i, (c, t) in enumerate(zip(points, texts, strict=True)) if stream[ends[i] : ends[i + 1]].tolist() != ids_of(t)]
    assert not wrong


def test_cuts_are_between_pairs_of_no_token():
    vocab = json.load(open(PATH))["model"]["vocab"]
    back = {c: b for b, c in bpe.byte_letters().items()}
    pairs = set()
    for token in vocab:
        raw = bytes(back[c] for c in token[:-4]) + b" " if token.endswith("</w>") and len(token) > 4 else bytes(back[c] for c in token)
        pairs |= set(zip(raw, raw[1:], strict=False))
    made = {tuple(divmod(int(k), 256)) for k in CODEC.inside.nonzero()[0]}
    assert made <= pairs | {(b, 0x20) for b in range(256)} and len(pairs - made) < 50  # what no merge makes is no bar
    assert not any(a == 0x20 for a, _ in made)
    assert len(made) < 0.2 * 65536


def test_long_fragments_and_texts():
    rng = random.Random(5)
    solid = "".join(rng.choice("abcdefgh") for _ in range(60_000))
    mixed = " ".join("".join(rng.choice("abcé中x1'") for _ in range(rng.randrange(1, 9))) for _ in range(30_000))
    for text in (solid, "a" * 20_000, mixed):
        assert CODEC.encode(text) == ids_of(text)
    parts = list(bpe.pieces(mixed, 1000))
    assert "".join(parts) == mixed and max(map(len, parts)) < 1100
    assert [i for p in parts for i in CODEC.encode(p)] == ids_of(mixed)


def test_forgetting_changes_nothing():
    small = bpe.Codec(PATH, most=3, most_bytes=20)
    for text in ["one two three four five", "six seven one", "two eight nine ten <|endoftext|>"] * 2:
        assert small.encode(text) == ids_of(text)


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.Codec(vocabulary("byte_bpe_50k.json"))


def test_unknown_and_null_ids():
    lists = pa.array([[0, None, 10**6, -5, 1], None, []], pa.list_(pa.int32()))
    assert CODEC.decode(lists).to_pylist() == ['! "', "", ""]


def test_odd_rows(spark):
    docs = odd_documents(spark, ["cut <|endoftext|> here", "DON'T"]).withColumnRenamed("bin", "ids")
    coded = bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "ids"] and coded.count() == docs.count()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in coded.collect())
    want = sorted((r.doc_id is not None, r.doc_id or 0, ids_of(r.text or "")) for r in docs.collect())
    assert got == want
    assert bpe.encode(no_documents(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs, PATH, keep=("doc_id", "ids"))
    both = bpe.decode(bpe.encode(docs, PATH, keep=("doc_id", "text"), ids="out"), PATH, ids="out", keep=("doc_id",), text="text")
    assert sorted(r.text for r in both.collect()) == sorted(MODEL.decode(ids_of(r.text or ""), skip_special_tokens=False) for r in docs.collect())


def test_query(spark, tmp_path):
    docs = odd_documents(spark, ODD_TEXTS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op12(spark, str(tmp_path)).collect())
    want = []
    for r in docs.collect():
        ids = ids_of(r.text or "")
        want.append((r.doc_id or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(MODEL.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
