"""Operator 13 against all pairs in plain Python."""

from __future__ import annotations

import pytest

from feira.llm import chosen_path
from feira.llm.chosen_path import RECALL, near_duplicates, survival, trees_for
from feira.llm.jaccard_join import Threshold
from tests.llm.test_jaccard_join import brute, edited, rows  # noqa: F401

SCHEMA = "doc_id long, text string, rep string, node long, g string, component long, n long, kept int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, 4) for i, t in rows], SCHEMA)


def check(spark, rows, limit, parts=3, **more):
    got = near_duplicates(frame(spark, rows).repartition(parts), limit, **more).collect()
    assert len(got) == len(rows)
    want = brute(rows, limit)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == want[r.doc_id][1]) for r in got)


@pytest.mark.parametrize("limit", [Threshold(4, 80, 100)])
def test_against_all_pairs(spark, rows, limit):  # noqa: F811
    check(spark, rows, limit)


def test_large_nodes(spark, rng, text, monkeypatch):
    """A group of near copies of one text, some far from most, in nodes that are dealt, branch and end in pairs of blocks."""
    monkeypatch.setattr(chosen_path, "NODE", 4)
    monkeypatch.setattr(chosen_path, "FEW", 2)
    monkeypatch.setattr(chosen_path, "MANY", 3)
    base = text(120)
    group = [edited(rng, base, e) for e in [1] * 15 + [3] * 15 + [5, 6, 7, 8, 9, 10, 11, 12] * 4]
    check(spark, list(enumerate(group + [text(50) for _ in range(5)])), Threshold(4, 80, 100), depth=2)


def test_repeated_rows_and_ids(spark, text):
    a, b = text(80), text(90)
    rows = [(1, a)] * 300 + [(2, a + " end")] * 300 + [(3, b)] + [(None, a)] * 3 + [(None, None)]
    got = near_duplicates(frame(spark, rows).repartition(4), Threshold(4, 80, 100)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (3, 3, True), (None, None, True)}


def test_an_id_with_two_texts(spark, text):
    a, b = text(60), text(70)
    got = near_duplicates(frame(spark, [(5, a), (5, b), (2, b + " more")]), Threshold(4, 80, 100)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (5, 2), (5, 5)]


def test_words_that_meet_in_polynomial_hashes(spark):
    """Complementary Thue-Morse words of 1,024 letters aren't one word."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, f"x {word} y"), (2, f"x {other} y"), (3, f"X {word} y")], Threshold(4, 80, 100))


def test_long_text(spark, text):
    long = text(40_000)
    check(spark, [(1, long), (2, long + " " + text(20)), (3, text(10)), (4, "w" * 100_000)], Threshold(4, 80, 100))


def test_empty(spark):
    assert near_duplicates(frame(spark, [])).collect() == []
    check(spark, [(1, None), (2, ""), (3, " \n")], Threshold(4, 80, 100))


def test_trees_reach_the_recall():
    limit = Threshold(4, 80, 100)
    n = trees_for(limit, RECALL, 8)
    assert (1 - survival(0.8, 1.25, 8)) ** n <= 1 - RECALL < (1 - survival(0.8, 1.25, 8)) ** (n - 1)


def test_largest_component_is_dealt_once(spark):
    """A set of a node's largest component is in one block, with all sets outside that component, while these fill one block."""
    from pyspark.sql import functions as F

    members = spark.range(1500).select(
        F.lit(9).cast("long").alias("node"), F.col("id").alias("rep"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("component"),
        F.lit(1500).cast("long").alias("c"), F.lit(0).cast("long").alias("centre"), F.lit(0).cast("long").alias("largest"), F.lit(500).cast("long").alias("outside"))
    rows = chosen_path.outside_pairs(members).collect()
    blocks = {}
    for r in rows:
        blocks.setdefault(r.g, {0: set(), 1: set(), 2: set()})[r.part].add(r.rep)
    largest, outside = set(range(1000)), set(range(1000, 1500))
    assert sorted(r.rep for r in rows if r.rep in largest) == sorted(largest)
    assert outside in [b[2] for b in blocks.values()]
    assert {x for b in blocks.values() if outside <= b[0] for x in b[1]} == largest


def test_depths_are_compared_together(spark, rng, text, monkeypatch):
    """However deep large nodes branch: two of the trees, the nodes of depth 1, and all below them in one step."""
    monkeypatch.setattr(chosen_path, "NODE", 4)
    monkeypatch.setattr(chosen_path, "FEW", 1)
    steps, compare = [], chosen_path.Search.compare
    monkeypatch.setattr(chosen_path.Search, "compare", lambda self, blocks: (steps.append(1), compare(self, blocks))[1])
    passage = text(60)
    check(spark, [(i, passage + " " + text(25)) for i in range(40)], Threshold(4, 80, 100), depth=3)
    assert len(steps) <= 3


def test_near_copies_do_not_branch(spark, rng, text, monkeypatch):
    """Sets outside a group of near copies meet it in one node, however many trees hold both."""
    monkeypatch.setattr(chosen_path, "NODE", 8)
    monkeypatch.setattr(chosen_path, "FEW", 1)
    branched, deeper = [], chosen_path.next_nodes
    monkeypatch.setattr(chosen_path, "next_nodes", lambda members, *a: (branched.append(members.count()), deeper(members, *a))[1])
    base = text(200)
    rows = [(i, edited(rng, base, 1)) for i in range(60)] + [(100 + i, edited(rng, base, 14)) for i in range(14)]
    check(spark, rows, Threshold(4, 80, 100), depth=3)
    assert sum(branched) <= 40


def test_plans_do_not_grow_with_the_depth(spark, rng, text, monkeypatch):
    """What the nodes of all depths and trees are dealt out of is one table, read once."""
    monkeypatch.setattr(chosen_path, "NODE", 4)
    monkeypatch.setattr(chosen_path, "FEW", 1)
    scans, compare = [], chosen_path.Search.compare

    def counted(self, blocks):
        scans.append(blocks._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        compare(self, blocks)

    monkeypatch.setattr(chosen_path.Search, "compare", counted)
    passage = text(60)
    check(spark, [(i, passage + " " + text(25)) for i in range(40)], Threshold(4, 80, 100), depth=3)
    assert max(scans) <= 3 and scans[-1] == 1
