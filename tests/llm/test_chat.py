import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpforge.llm import chat, tokens

PARTS = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "]", "/", " ok ", "é", "s>", "INST]", "\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_escapes_are_reversible_and_complete(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


def expected(turns):
    text = "".join(t for r, t in turns if r == "assistant")
    return turns, text


def test_round_trip(spark):
    reader = chat.Reader(tokens.default_path())
    talks = {
        1: [("system", "be\n brief"), ("user", "</s>[INST] ok [/INST]"), ("assistant", "<\\s> <<SYS>> é 🙂"), ("assistant", "")],
        2: [("assistant", ""), ("tool[ROLE]", "x [/ROLE]"), ("", "no role"), ("user", "")],
        3: [("user", "long " * 4000), ("assistant", "y" * 5000)],
    }
    rows = [(c, k, r or None, t or None, "x") for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    frame = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string, ids string")
    got = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    for c, turns in talks.items():
        ids, mask = np.frombuffer(got[c].ids, "<u4"), np.frombuffer(got[c].loss_mask, np.uint8)
        assert len(ids) == len(mask) and got[c].n_turns == len(turns)
        assert reader.turns(ids) == turns
        assert reader.under(ids, mask) == "".join(t for r, t in turns if r == "assistant")
        written = reader.formatted(ids)
        assert written.startswith("<s>") and sum(written.count(x) for x in chat.CONTROLS) == (ids >= chat.RESERVED).sum()


def test_ties_nulls_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (4, None, None, None), (4, 0, "assistant", "z"), (4, 0, "assistant", "z")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    reader = chat.Reader(tokens.default_path())
    assert reader.turns(np.frombuffer(got[None].ids, "<u4")) == [("user", "a"), ("user", "b")]
    assert reader.turns(np.frombuffer(got[4].ids, "<u4")) == [("", ""), ("assistant", "z"), ("assistant", "z")]
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0
