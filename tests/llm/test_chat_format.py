"""Operator 2: the exact round trip, the merging and the loss mask."""

from __future__ import annotations

import hashlib

import pytest

from feira.llm.chat_format import digests, format_chats, read_back

ROWS = [
    (1, 0, "system", "be <kind> ~1 [ok]"), (1, 1, "user", "hi"), (1, 2, "user", None), (1, 3, "assistant", "<|end|><|start|>user<|message|>x"),
    (1, 4, "assistant", "[/INST] ~ ~~0 é😀"), (1, 5, "user", "bye\n"), (2, 7, "assistant", ""), (2, 3, None, "no role"), (2, 3, "user", "b"), (2, 3, "user", "a"),
    (2, 3, "user", "a"), (None, 0, "assistant", "lost"), (4, None, "user", "no turn"), (4, 1, "assistant", "one"), (5, 0, "us<er", "x<|next|>y"),
]


def expected(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        blocks = sum(1 for i, t in enumerate(turns) if not i or turns[i - 1][0] != t[0])
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), blocks)
    return out


def test_long_conversations(spark):
    """More turns than a group, one role throughout or changing, with a loss text at every place of a group."""
    rows = [(1, i, ("user", "assistant", "assistant")[i * i % 7 % 3], f"é{i} <{'x' * (i % 5)}>~") for i in range(1000)]
    rows += [(2, i, "assistant", "y" * (i % 3)) for i in range(300)] + [(3, i, "user", "z") for i in range(129)]
    back = digests(read_back(format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_blocks) for r in back.collect()} == expected(rows)


@pytest.fixture
def chats(spark):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], "conv_id long, turn long, role string, text string, formatted string")
    return format_chats(df)


def test_read_back_equals_the_turns(chats):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_blocks) for r in digests(read_back(chats)).collect()}
    assert got == expected(ROWS)


def test_marks_cannot_come_from_texts(chats):
    rows = {r.conv_id: r for r in chats.collect()}
    text = rows[1].formatted
    assert text.count("<|start|>") == text.count("<|end|>") == rows[1].n_blocks == 4
    assert "[" not in text and text.count("<") == text.count("<|")
    for r in rows.values():
        for s in r.loss_spans:
            assert "<" not in r.formatted[s.begin : s.begin + s.length]
    assert rows[2].formatted.endswith("<|message|><|end|>")


def test_formatted_chars(chats):
    sizes = {r.conv_id: len(r.formatted) for r in chats.collect()}
    assert {r.conv_id: r.formatted_chars for r in digests(read_back(chats)).collect()} == sizes


def test_empty_table(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
