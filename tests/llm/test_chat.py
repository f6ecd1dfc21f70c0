import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import chat

BITS = st.sampled_from([*chat.CONTROL, "\\", "<", "|", "<\\|im_end|>", "a", "\n", "[", "INST]", "é", "</", "s>", "|im_start|>"])


@settings(max_examples=500, deadline=None)
@given(st.lists(BITS, max_size=10).map("".join), st.lists(BITS, max_size=5).map("".join))
def test_escapes_are_undone_and_hide_marks(text, role):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)
    turn, a, b = chat.segment(role, text)
    assert chat.parsed(turn) == (role, text) and chat.unescape(turn[a:b]) == text


EVENTS = "conv_id long, seq long, kind string, msg string, role string, text string"


def turns(spark, events):
    got = defaultdict(list)
    for r in chat.render(spark.createDataFrame(events, EVENTS)).orderBy("conv_id", "position").collect():
        got[r.conv_id].append((*chat.parsed(r.formatted), r.loss_start is not None))
    return dict(got)


def test_fold(spark):
    got = turns(spark, [
        (1, 0, "message", "u1", "user", "hi"),
        (1, 1, "delta", "a1", "assistant", "He"),
        (1, 2, "delta", "a1", None, "llo"),
        (1, 3, "message", "u2", "user", "and?"),
        (1, 4, "delta", "a2", "assistant", "bad"),
        (1, 5, "regenerate", "a2", None, None),
        (1, 6, "delta", "a2", "assistant", "good"),
        (2, 0, "message", "u1", "user", "old"),
        (2, 1, "message", "a1", "assistant", "answer"),
        (2, 2, "edit", "u1", "user", "new"),
        (None, None, None, None, None, None),
        (3, 0, "message", None, "user", "same"),
        (3, 0, "message", None, "user", "same"),
    ])
    assert got[1] == [("user", "hi", False), ("assistant", "Hello", True), ("user", "and?", False), ("assistant", "good", True)]
    assert got[2] == [("user", "new", False)]
    assert got[None] == [("", "", False)]
    assert got[3] == [("user", "same", False)] * 2


def test_digests_match_brute_force(spark, tmp_path):
    rows = [(c, t, ["user", "assistant"][t % 2], ["plain", None, "</s>x<|im_end|>\n", "é" * t][(c + t) % 4]) for c in range(20) for t in range(c % 7 + 1)]
    rows += [(99, t, ["user", "assistant"][t % 2], "x" * (t % 5)) for t in range(3000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op9(spark, str(tmp_path)).collect()}
    by = defaultdict(list)
    for c, t, role, text in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[c].append((t, role, text or ""))
    assert set(got) == set(by)
    for c, said in by.items():
        said.sort()
        loss = "".join(x for _, role, x in said if role == "assistant")
        assert got[c].n_turns == len(said) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in said).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_empty(spark):
    assert chat.read_back(chat.render(spark.createDataFrame([], EVENTS))).count() == 0
