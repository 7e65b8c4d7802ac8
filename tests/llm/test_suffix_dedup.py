"""Operator 5 against a set of all byte strings in plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from feira.llm.suffix_dedup import remove_repeats, window_size


def brute(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, length):
    rows = remove_repeats(df, length).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str)


@pytest.fixture
def rows(rng, text):
    passage, other = text(90), text(160)
    exact = passage[:400]
    out = [
        None, "", "short", passage[:399], text(120) + " " + exact, exact + " " + text(80), text(30) + passage + text(30) + passage,
        other, other, other[:500] + "!" + other[500:], other[:390] + "?" + other[390:], text(50) + other[37:437] + text(50), text(50) + other[37:436] + "§" + text(50),
        "a" * 1300, "ab" * 500, "a" * 399, "é" * 500, "é" * 300 + text(100), passage.replace(" ", "  "), text(400), text(700),
    ]
    long = text(600)
    for _ in range(12):
        words = long.split(" ")
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = "edit"
        out.append(" ".join(words))
    out += [text(100) + passage + text(60) for _ in range(8)]
    out += [long[k : k + 450 + k] for k in (1, 60, 133)]
    return list(enumerate(out))


@pytest.mark.parametrize("length", [400, 150])
def test_against_all_strings(spark, rows, length):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, rk long, name string").repartition(3)
    assert result(df, length) == brute(rows, length)


def test_repeated_rows_and_null_ids(spark, text):
    t = text(120)
    rows = [(1, t), (1, t), (None, t[5:]), (2, text(120)), (2, text(130)), (None, None)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), 400) == brute(rows, 400)


def test_same_row_twice_alone(spark, text):
    rows = [(1, text(120))] * 2 + [(3, text(90))]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), 400) == brute(rows, 400)


def test_empty_table_and_nothing_repeated(spark, text):
    assert result(spark.createDataFrame([], "doc_id long, text string"), 400) == []
    rows = [(i, text(150)) for i in range(4)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), 400) == brute(rows, 400)


def test_kept_text(spark, text):
    t = text(130)
    df = spark.createDataFrame([(1, "head " + t), (2, t + " tail"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in remove_repeats(df, 400, with_text=True).collect()}
    assert got == {1: "head ", 2: " tail", 3: ""}


def test_window_needs_room():
    assert window_size(400) == 88
    with pytest.raises(ValueError):
        window_size(70)
