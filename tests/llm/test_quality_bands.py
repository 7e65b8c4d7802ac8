"""Operator 6: base statistics against plain Python, and the compression bands."""

from __future__ import annotations

import random
import re

from feira.llm.quality_bands import band, quality_bands

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    n = len(words)
    grams = [tuple(words[i : i + 5]) for i in range(n - 4)]
    inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>") if text else 0, len(lines) - len(set(lines)), len(inside),
            n < 10 or 100 * len(inside) > 20 * n)


def test_base_statistics(spark, text):
    t = text(40)
    texts = [None, "", " \n\t", "one", "a b c d e f g h i", "a b c d e f g h i j", t, t + "\n" + t, "x y z v w " * 9, "l\nl\n\n \nl\nm", "é# *$ %& |< > 😀",
             t + "\n#\n#", "a\x0bb\x0cc\rd e", " a  b", text(300)]
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words int").repartition(2)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_bands(df).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_bands(spark, text):
    rnd = random.Random(1)
    noise = " ".join("".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(2000))
    near = " ".join(f"{i % 7}word{i}" for i in range(20000))
    slow = "".join(f"alpha beta gamma delta number {i}\n" for i in range(20000))
    rows = [(1, text(30)), (2, text(3000)), (3, noise), (4, slow), (5, near)]
    got = {r.doc_id: r for r in quality_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in (1, 2, 3)] == [True, True, False]
    assert not got[4].kept
    assert got[3].ratio > band(len(noise.encode()))[1]
    assert got[3].n_chunks == -(-len(noise.encode()) // 4096)


def test_noise_is_rejected(spark, text):
    rnd = random.Random(2)
    letters = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 10))) for _ in range(18000))
    codes = " ".join(f"{rnd.getrandbits(32):08x}" for _ in range(12000))
    counted = " ".join(f"{i % 7}word{i}" for i in range(20000))
    prose = "".join(chr(ord(c) + rnd.randrange(2)) if c > " " else c for c in text(4000))  # about 0.4
    noise = [letters[:2100], letters[:4000], letters[:10000], letters, codes[:5000], codes[:10000], codes[:100000],
             prose[:4096] + letters[:4096], prose[:8192] + letters[:8192], counted]
    plain = [prose[:n] for n in (600, 1500, 3000, 4096, 4100, 8000, 8300, 15000)]
    rows = list(enumerate(noise + plain))
    got = {r.doc_id: r for r in quality_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [i for i in range(len(noise)) if got[i].kept] == []
    assert [(len(t), got[i].ratio) for i, t in rows[len(noise):] if not got[i].kept] == []


def test_empty_table_and_repeats(spark, text):
    assert quality_bands(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = text(20)
    assert quality_bands(spark.createDataFrame([(None, t), (1, t), (1, t)], "doc_id long, text string")).where("kept").count() == 3
