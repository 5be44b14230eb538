from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from askloom.llm import chat

ROLES = ["user", "assistant", "system", "tool", "", "a]b", "x!", "us\\er", "[INST]", "</s>"]
TEXTS = ["", " ", "plain", chat.PROBE, "a </s>", "[/INST", " [/INST]", "\\", "\\\\[INST]\\", "<\\s>", "<<SYS>> x <</SYS>>", "[ROLE a] b [/ROLE]", "é\n[ANS!] "]


@pytest.mark.parametrize("role", ROLES)
@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(role, text):
    piece, start, end, escaped = chat.format_turn(role, text)
    assert list(chat.parse(piece)) == [(role, text, start, end, len(piece))]
    assert not chat.CONTROL.search(piece[start:end])
    assert escaped or piece[start:end] == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES) | st.text("[]<>\\!ROLE/s ", max_size=9), st.text("[]<>/\\!sINSTANSYROLE \n", max_size=25)), max_size=5))
def test_whole_conversations_parse(turns):
    text = chat.BEGIN + "".join(chat.format_turn(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, *_ in chat.parse(text, len(chat.BEGIN))] == turns


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi </s>"), (1, None, None, "first"), (2, 0, "user", "same"), (2, 0, "user", "same")]
    rows += [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (None, 0, "user", "nobody"), (3, 5, "tool", "x" * 200_000)]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(3000)]
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as piece", "2 as escaped").repartition(6)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op4_chat_format(spark, str(tmp_path)).collect()}
    turns = defaultdict(list)
    for conv, turn, role, text in rows + [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]:
        if conv is not None:
            turns[conv].append((turn is not None, turn, role or "", text or ""))
    assert set(got) == set(turns)
    for conv, own in turns.items():
        own.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        r = got[conv]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r.n_turns == len(own) and r.turns_sha256 == sha("".join(f"{x}\n{t}\n" for *_, x, t in own))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == 3 + sum(len(chat.format_turn(x, t)[0]) for *_, x, t in own)


def test_spans_cut_the_assistant_texts(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "the [INST] answer")]
    pieces = chat.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    spans = {r.role: (r.loss_start, r.loss_end, r.piece) for r in pieces}
    assert spans["user"][0] is None
    a, b, piece = spans["assistant"]
    assert chat.unescape(piece[a:b]) == "the [INST] answer"


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.formatted(none)).collect() == []
