"""Operator 11 against all pairs in plain Python."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest

from feira.llm import spelling
from feira.llm.spelling import near, pivots, variants

SCHEMA = "doc_id long, text string, word string, n long, form string, g long"


def counts(rows):
    out = collections.Counter()
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = counts(rows)
    close = {a: [b for b in n if a != b and one_apart(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(close[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= 10 * n[a] else None

    def root(a):
        while form[a] is not None:
            a = form[a]
        return a

    return {a: (form[a], root(a), n[a], len(close[a]), n[form[a]] if form[a] else None) for a in n}


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)
    got = [tuple(r) for r in variants(df.repartition(3)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def changed(rng, word: str, letters: str) -> str:
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])


@pytest.fixture
def rows(rng):
    letters = "abcdéÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 12]))) for _ in range(40)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "ababababa", "bababab", "zzzzzzzq", "qzzzzzzz"]
    words = []
    for w in base:
        words += [w] * rng.choice([2, 3, 30, 400])
        for _ in range(6):
            v = changed(rng, w, letters)
            words += [v] * rng.choice([1, 2, 3, 25])
            words += [changed(rng, v, letters)] * 2
    rng.shuffle(words)
    out = [(i, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words[i::60])) for i in range(60)]
    return out + [(None, base[0] + "," + base[1]), (None, None), (100, ""), (101, "12 34 中文 short"), out[0], out[0]]


def test_against_all_pairs(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_long_lists_are_split(spark, rows, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_BYTES", 300)
    monkeypatch.setattr(spelling, "PAIRS_AT_ONCE", 5)
    assert run(spark, rows) == brute(rows)


def test_ties_chain_and_length(spark):
    """Ties go to the smaller word; forms are followed; a run of 3,000 letters is a word."""
    long = "xy" * 1500
    text = " ".join(["tieword"] * 2 + ["tiewordb"] * 20 + ["tieworda"] * 20 + ["chainaa"] * 2 + ["chainab"] * 20 + ["chainbb"] * 200 + ["chaincbb"] * 2000 + [long] * 3 + [long[:-1]] * 40)
    rows = [(1, text)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(v[1] != v[0] and v[0] is not None for v in got.values())


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, None), (2, "")]) == {}
    assert run(spark, [(1, "onlyonce")]) == {}


def test_pivots_are_the_cheapest_disjoint_pair(rng):
    cost = np.array([[rng.choice([1, 2, 5, np.inf, 9]) for _ in range(8)] for _ in range(200)])
    chosen = pivots(cost)
    for c, (i, j) in zip(cost, chosen):
        best = min(c[a] + c[b] for a in range(8) for b in range(a + 2, 8))
        assert best == np.inf or (j >= i + 2 and c[i] + c[j] == best)


def test_near(rng):
    pool = ["abcdefg", "abcdefgh", "abcdfg", "xbcdefg", "abcdegf", "aabcdefg", "abcdefx", "bcdefg", "abcxdefg", "abxcdexfg"]
    for a in pool:
        for b in pool:
            if abs(len(a) - len(b)) <= 1:
                m = [np.frombuffer(x.encode(), np.uint8)[None, :] for x in (a, b)]
                assert bool(near(*m)[0]) == one_apart(a, b)
