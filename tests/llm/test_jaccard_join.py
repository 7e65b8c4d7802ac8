"""Operator 1 against all pairs in plain Python."""

from __future__ import annotations

import re

import pytest

from feira.llm.graph import components
from feira.llm.jaccard_join import Bands, Threshold, jaccard_join, link_counts, tile_keys
from feira.llm.textops import U64, mix

SCHEMA = "doc_id long, text string, n long, sig string, component_id long"


def shingle_set(text: str | None, k: int) -> set:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    if len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, limit: Threshold) -> dict:
    sets = {i: shingle_set(t, limit.k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and limit.den * len(sets[x] & sets[y]) >= limit.num * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[words[at] + "q"], [], [words[at], "zz"]])
    return " ".join(words)


@pytest.fixture
def rows(rng, text):
    out = ["", None, " \t\n", "One", "one", "one two", "one two three", "ONE two\nthree"]
    for size in (9, 10, 12, 20, 21, 40, 90, 200, 400, 900):
        base = text(size)
        out += [base, base.upper(), base + "\n"]
        out += [edited(rng, base, e) for e in (1, 1, 2, 3, size // 40, size // 30, size // 25, size // 20)]
    chain = text(120)
    for _ in range(12):
        chain = edited(rng, chain, 1)
        out.append(chain)
    shared = text(150)
    out += [shared + " " + text(k) for k in (10, 14, 18, 22, 30, 5, 4, 3)]
    out += [text(60) for _ in range(20)]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(3 * place + 1, out[i]) for place, i in enumerate(order)]


@pytest.mark.parametrize("limit", [Threshold(3, 90, 100), Threshold(5, 80, 100), Threshold(1, 50, 100)])
def test_against_all_pairs(spark, rows, limit):
    df = spark.createDataFrame([(i, t, 1, "x", -1) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, limit).collect()}
    assert got == brute(rows, limit)


def test_second_round_alone_finds_links(spark, rows, monkeypatch):
    """With blocks of two sets the pairs of blocks must still cover each tile."""
    from feira.llm import jaccard_join as j

    monkeypatch.setattr(j, "BLOCK", 2)
    limit = Threshold()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    profiles = j.profile(df, limit, "doc_id", "text")
    tiles = j._shared_tiles(j._keys(df, limit, "doc_id", "text")).selectExpr("key", "doc_id AS rep", "doc_id AS component").distinct()
    sizes = profiles.where("sig IS NOT NULL").selectExpr("doc_id AS rep", "n", "sig")
    pairs = j._candidates(tiles, sizes, limit)
    links = {(r.a, r.b) for r in j._verified(pairs, df, limit, "doc_id", "text").collect()}
    sets = {i: shingle_set(t, 3) for i, t in rows if shingle_set(t, 3)}
    first = {}  # a task offers equal sets once
    want = set()
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    reps = {frozenset(sets[i]): i for i in sets}
    for x in sets.values():
        for y in sets.values():
            if x != y and 100 * len(x & y) >= 90 * len(x | y):
                want.add(frozenset((frozenset(x), frozenset(y))))
    got = {frozenset((frozenset(sets[a]), frozenset(sets[b]))) for a, b in links}
    assert reps and want <= got


def test_link_counts_against_all_pairs(spark, rows):
    limit = Threshold()
    again, other = rows[0], (rows[1][0], rows[9][1])  # a repeated row, and an id with a second text
    rows = [*rows, again, other, (None, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_links) for r in link_counts(df, limit).collect()), key=str)
    docs = list(dict.fromkeys((i, t or "") for i, t in rows if i is not None))
    sets = [shingle_set(t, limit.k) for _, t in docs]
    n = {d: sum(1 for j, y in enumerate(sets) if j != i and x and y and 100 * len(x & y) >= 90 * len(x | y)) for i, (d, x) in enumerate(zip(docs, sets))}
    assert got == sorted(((i, None if i is None else n[i, t or ""]) for i, t in rows), key=str)
    assert link_counts(df.where("doc_id = -1")).count() == 0


def test_linked_sets_share_a_tile(rng):
    """Random sets at the threshold, of every small size: none is missed."""
    import numpy as np

    for limit in (Threshold(3, 90, 100), Threshold(5, 80, 100)):
        bands = Bands(limit)
        for size in list(range(1, 60)) + [100, 333, 1000]:
            for _ in range(6):
                a = {rng.getrandbits(64) for _ in range(size)}
                b = set(a)
                for _ in range(rng.randrange(size // 8 + 2)):
                    if rng.random() < 0.5 and len(b) > 1:
                        b.remove(rng.choice(sorted(b)))
                    else:
                        b.add(rng.getrandbits(64))
                if limit.linked(len(a), len(b), len(a & b)):
                    x, y = (set(tile_keys(np.array(sorted(s), U64), bands).tolist()) for s in (a, b))
                    assert x & y, (limit, size, len(a), len(b))


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (9, "A b c d"), (9, "A b c d")], "doc_id long, text string")
    got = sorted(jaccard_join(df).collect(), key=str)
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [(4, 2, 4), (9, 2, 4), (9, 2, 4), (None, 2, None)]


def test_null_id_before_its_copy_hides_no_link(spark, text):
    t = text(60)
    rows = [(None, t), (1, t), (2, t + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard_join(df).collect()}
    assert got == {None: None, 1: 1, 2: 1}


def test_components(spark, rng):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 300), (500, 501), (501, 500)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 300: 0, **{k: 100 for k in range(100, 140)}, 500: 500, 501: 500}


def test_mix_is_a_bijection_on_a_sample():
    import numpy as np

    assert len(np.unique(mix(np.arange(100000, dtype=U64)))) == 100000


def test_repeated_rows_are_one(spark, text):
    """Rows that repeat id and text multiply neither the signatures nor the verified sets."""
    a, b = text(80), text(60)
    df = spark.createDataFrame([(1, a, 1, "x", 2)] * 400 + [(2, a + " end", 1, "x", 2)] * 400 + [(3, b, 1, "x", 2)], SCHEMA).repartition(4)
    got = jaccard_join(df, Threshold(3, 90, 100)).collect()
    assert len(got) == 801 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}


def test_words_that_meet_in_polynomial_hashes(spark):
    """Complementary Thue-Morse words of 1,024 letters aren't one word."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x {word} y"), (2, f"x {other} y"), (3, f"X {word} y")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    assert {r.doc_id: r.component_id for r in jaccard_join(df, Threshold(3, 90, 100)).collect()} == {1: 1, 2: 2, 3: 1}


def test_near_copies_of_one_text(spark, rng, text):
    """A group of near copies around the threshold: pairs come in rounds, each block giving fewer than its components."""
    base = text(100)
    rows = [(i, edited(rng, base, rng.choice([1, 2, 4, 6, 8]))) for i in range(150)]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(3)
    limit = Threshold(5, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, limit).collect()} == brute(rows, limit)


def test_compared_blocks_are_not_compared_again(spark, rng, text, monkeypatch):
    """The first round has compared all pairs of tiles of three sets; a block whose given pairs all link is done."""
    from feira.llm import jaccard_join as j

    rounds, verified = [], j._verified
    monkeypatch.setattr(j, "_verified", lambda *a: (rounds.append(1), verified(*a))[1])
    limit = Threshold()
    few = [(10 * f + i, edited(rng, base, 12)) for f, base in enumerate([text(150) for _ in range(4)]) for i in range(3)]
    df = spark.createDataFrame(few, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, limit).collect()} == brute(few, limit)
    assert len(rounds) == 1
    rounds.clear()
    base = text(300)
    near = [(i, edited(rng, base, 1)) for i in range(40)]
    df = spark.createDataFrame(near, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, limit).collect()} == brute(near, limit)
    assert len(rounds) <= 2


def test_few_texts_in_pairs_shuffle_no_others(spark, text, monkeypatch):
    from feira.llm import jaccard_join as j

    plans, kept = [], j.stored
    monkeypatch.setattr(j, "stored", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df))[1])
    docs = spark.createDataFrame([(i, text(20)) for i in range(30)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert j._verified(pairs, docs, Threshold(), "doc_id", "text").count() == 0
    semi = [p for p in plans if "LeftSemi" in p]
    assert len(semi) == 1 and "rightHint=(strategy=broadcast)" in semi[0]


def test_stars_need_no_further_round(spark, monkeypatch):
    from feira.llm import graph

    written, kept = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: (written.append(1), kept(df))[1])
    edges = spark.createDataFrame([(1, 5), (6, 1), (8, 7), (7, 7)], "a long, b long")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(1, 1), (5, 1), (6, 1), (7, 7), (8, 7)}
    assert len(written) == 1
    chain = spark.createDataFrame([(1, 2), (3, 2), (3, 4)], "a long, b long")
    assert {(r.node, r.component) for r in components(chain).collect()} == {(i, 1) for i in range(1, 5)}


def test_near_copies_are_compared_once(spark, rng, text, monkeypatch):
    """Texts that share very many tiles with a group of near copies without a link to it: few rows are dealt out for all these tiles."""
    from feira.llm import jaccard_join as j

    dealt, possible = [], j.possible_rows
    monkeypatch.setattr(j, "possible_rows", lambda blocks, *a: (dealt.append(blocks.count()), possible(blocks, *a))[1])
    base = text(300)
    rows = [(i, edited(rng, base, 2)) for i in range(40)] + [(100 + i, edited(rng, base, 30)) for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    limit = Threshold(5, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, limit).collect()} == brute(rows, limit)
    assert len(dealt) == 1 and dealt[0] <= 10 * len(rows)
