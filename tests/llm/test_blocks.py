"""Nodes merged at their largest component, and what is dealt out of them."""

from __future__ import annotations

from collections import defaultdict

import pytest

from feira.llm import blocks


def pairs_of(rows):
    parts = defaultdict(lambda: defaultdict(set))
    for r in rows:
        parts[r.g][r.part].add(r.rep)
    out = set()
    for p in parts.values():
        out |= {(a, b) for a in p[2] for b in p[2] if a < b}
        out |= {(min(a, b), max(a, b)) for a in p[0] for b in p[1]}
    return out


def dealt_out(spark, nodes, component, most=512):
    rows = [(k, x, component(x)) for k, sets in nodes.items() for x in sets]
    merged, others = blocks.merged_nodes(blocks.open_nodes(spark.createDataFrame(rows, "node long, rep long, component long")), most)
    return rows, merged.count(), blocks.all_pairs(merged, most).union(blocks.all_pairs(others, most)).collect()


@pytest.mark.parametrize("most", [512, 16])
def test_nodes_of_near_copies_are_one(spark, rng, most):
    """Fifty nodes that mostly hold the same sets deal out as many rows as one of them, and no pair of two components is lost."""
    nodes = {k: sorted(rng.sample(range(60), 48) + rng.sample(range(100, 120), 15)) for k in range(50)}
    rows, merged, dealt = dealt_out(spark, nodes, lambda x: 0 if x < 60 else x, most)
    assert merged == 80
    assert len(dealt) <= (80 if most == 512 else 80 * 6) < len(rows)
    met = pairs_of(dealt)
    assert all((a, b) in met for s in nodes.values() for a in s for b in s if a < b and b >= 100)


def test_nodes_of_unrelated_sets_stay_apart(spark):
    """One component of two sets in nodes that share nothing else: together they would deal out more rows, and have no half of them."""
    nodes = {k: [0, 1, *range(100 * k, 100 * k + 40)] for k in range(1, 9)}
    rows, merged, dealt = dealt_out(spark, nodes, lambda x: 0 if x < 2 else x)
    assert merged == 0 and len(dealt) == len(rows)
    met = pairs_of(dealt)
    assert all((a, b) in met for s in nodes.values() for a in s for b in s if a < b and (a, b) != (0, 1))


def test_merging_never_deals_out_more(spark):
    """Half of each node is in a component of which every node has another part, and the other half meets nobody else."""
    nodes = {k: [*range(8 * k, 8 * k + 8), *range(1000 + 8 * k, 1000 + 8 * k + 8)] for k in range(20)}
    rows, merged, dealt = dealt_out(spark, nodes, lambda x: 0 if x < 1000 else x, 16)
    assert merged == 0 and len(dealt) == len(rows)


def test_a_name_with_two_sets(spark):
    """Rows that share an id: each of its sets is compared, and a name goes on once."""
    import numpy as np

    def row(name, values):
        u = np.array(sorted(values), blocks.U64)
        return name, len(u), blocks.bitmap(u).tobytes(), u.tobytes()

    sets = spark.createDataFrame([row(1, range(50)), row(1, range(900, 950)), row(2, range(900, 951)), row(3, range(51))], "rep long, n long, sig binary, elements binary")
    block = spark.createDataFrame([(7, 2, i, i) for i in (1, 2, 3)], "g long, part long, rep long, component long")
    limit = blocks.Threshold(3, 90, 100)
    possible = blocks.possible_rows(block, sets, limit)
    assert sorted(r.rep for r in possible.collect()) == [1, 2, 3]
    links = {frozenset((r.a, r.b)) for r in blocks.block_links(possible, sets, limit).collect()}
    assert links == {frozenset((1, 2)), frozenset((1, 3))}


def test_all_pairs_reads_its_members_once(spark):
    """Whole nodes and pairs of blocks come out of one pass over the members."""
    nodes = {k: [*range(100 * k, 100 * k + 20 * k)] for k in range(1, 4)}
    rows = [(k, x, 0 if x % 100 < 10 else x) for k, sets in nodes.items() for x in sets]
    dealt = blocks.all_pairs(blocks.open_nodes(spark.createDataFrame(rows, "node long, rep long, component long")), 20)
    assert dealt._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    met = pairs_of(dealt.collect())
    assert met >= {(a, b) for s in nodes.values() for a in s for b in s if a < b and b % 100 >= 10}
