import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewright.llm.common import raw
from tidewright.llm.tokens import Encoder, encoder, vocabulary

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PARTS = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "\u0085", "é", "é", "ß", "İ", "'s", "'", "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "<|EndOfText|>", "1", "中", "🙂", "\x1c", "\x00", "!", "...", ",", "-", "|", "_", "$", "Z", "\u0301", "x" * 40])


def direct(name):
    return Tokenizer.from_file(vocabulary(name))


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_the_ids_of_whole_texts(name):
    model, ours = direct(name), encoder(vocabulary(name))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(PARTS, max_size=12).map("".join), min_size=1, max_size=4))
    def check(texts):
        ids, ends = ours(*raw(pa.array(texts)), 7)
        for i, t in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == [*model.encode(t, add_special_tokens=False).ids, 7]

    check()


@pytest.mark.parametrize("name", NAMES)
def test_added_tokens(name):
    model, ours = direct(name), encoder(vocabulary(name))
    for token in [t["content"] for t in json.loads(model.to_str())["added_tokens"]]:
        texts = [f"hello {token} world", token, token * 2, f"a{token}b {token}.{token}", f"{token[:5]} {token[5:]}", "plain words, and more", token[:-1], token[-1] + " tail"]
        ids, ends = ours(*raw(pa.array(texts)), 7)
        for i, t in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == [*model.encode(t, add_special_tokens=False).ids, 7]
        assert model.token_to_id(token) in ids[: ends[1]]


def test_other_vocabularies_encode_whole_texts(tmp_path):
    form = json.loads(direct(NAMES[0]).to_str())
    form["pre_tokenizer"]["use_regex"] = False  # tokens may now span blanks
    vocab = form["model"]["vocab"]
    vocab["dĠa"], vocab["<=>"] = len(vocab), len(vocab) + 1
    form["model"]["merges"].insert(0, ["d", "Ġa"])
    form["model"]["merges"].insert(0, ["Ġ", "a"])
    path = tmp_path / "other.json"
    path.write_text(json.dumps(form))
    model, ours = Tokenizer.from_file(str(path)), encoder(str(path))
    texts = ["red apples and a dog", "", "bad and sad"]
    ids, ends = ours(*raw(pa.array(texts)), 7)
    assert not ours.cuts
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == [*model.encode(t, add_special_tokens=False).ids, 7]
    assert vocab["dĠa"] in ids


def test_nulls_and_slices():
    ours = encoder(vocabulary(NAMES[0]))
    texts = pa.array(["drop", None, "", "two words", None]).slice(1)
    ids, ends = ours(*raw(texts), 0)
    assert np.diff(ends).tolist()[:2] == [1, 1] and np.diff(ends).tolist()[3] == 1
    assert zlib.crc32(ids[:1].astype("<u4")) == zlib.crc32(b"\0\0\0\0")


@pytest.mark.parametrize("name", NAMES)
def test_pieces_of_many_blocks_stay_known_and_others_go(name, monkeypatch):
    model, ours = direct(name), Encoder(vocabulary(name), most=120, most_bytes=4000)
    learned, real = [], ours._learn
    monkeypatch.setattr(ours, "_learn", lambda new: (learned.append(set(new)), real(new)))
    often = "the same words stand in every text"
    for k in range(40):
        texts = [often, *(f"{often} n{'abcdefghij'[k % 10]}{'klmno'[i % 5]}{chr(97 + k // 10)}q{'x' * i}" for i in range(30))]
        ids, ends = ours(*raw(pa.array(texts)), 7)
        assert len(ours.known) <= 120 + 40 and ours.held == sum(map(len, ours.known)) <= 4000 + 2000
        for i, t in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == [*model.encode(t, add_special_tokens=False).ids, 7]
    assert sum(len(x) for x in learned) > 1000
    assert sum(b" stand" in x for x in learned) == 1  # learned once; it never goes


def test_more_pieces_of_many_blocks_than_may_stay():
    model, ours = direct(NAMES[0]), Encoder(vocabulary(NAMES[0]), most=20)
    texts = [" ".join(f"{chr(97 + i)}{chr(97 + j)}z" for j in range(20)) for i in range(6)]
    for _ in range(5):
        ids, ends = ours(*raw(pa.array(texts)), 7)
        for i, t in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == [*model.encode(t, add_special_tokens=False).ids, 7]
        ours._shrink()
        assert len(ours.known) <= 10
