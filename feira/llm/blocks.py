"""Nodes of sets, dealt into blocks of bounded size and compared there (operators 1 and 13).

A node is any group of sets that may link: a tile of operator 1, a node of operator 13's trees. ``members`` has a row
(node, rep, component) for every set ``rep`` of a node, with the component known so far. A node with one component is done. In the
others the sets outside the largest component are compared with each other and with those in it, in blocks of at most about
``many`` sets or in pairs of such blocks. Near copies of one text meet in very many nodes, mostly the same sets again; nodes of which one component
has at least half the sets are therefore made one node for each such component, where that deals out fewer rows.

In a block bitmaps bound each overlap from above first; rows with a possible partner are then given their full sets and
decided by intersecting them. A block gives fewer links than it has components, so no stage writes more rows than were dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm.textops import U64, column_runs, map_arrow, stored

MOST_BROADCAST = 1_000_000  # set names (8 bytes each) that are broadcast; beyond, all sets are shuffled
MANY = 512  # sets of a block
MAX_BITMAP_BITS = 1 << 18


@dataclass(frozen=True)
class Threshold:
    """Linked: den * intersection >= num * union."""

    k: int = 3
    num: int = 90
    den: int = 100

    def linked(self, size_a: int, size_b: int, shared: int) -> bool:
        return self.den * shared >= self.num * (size_a + size_b - shared)

    def least_shared(self, size_a: int, size_b: int) -> int:
        return -(-self.num * (size_a + size_b) // (self.num + self.den))


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    """A bitmap (uint64 words) folded to fewer words: the bits of the hash modulo the smaller size."""
    while len(sig) > words:
        sig = sig[: len(sig) // 2] | sig[len(sig) // 2 :]
    return sig


def may_link(limit: Threshold, n_a: np.ndarray, sig_a: np.ndarray, n_b: np.ndarray, sig_b: np.ndarray) -> np.ndarray:
    """Whether the bit counts leave room for enough shared elements; bitmaps broadcast against each other, words last."""
    only_a = np.bitwise_count(sig_a & ~sig_b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(sig_b & ~sig_a).sum(axis=-1, dtype=np.int64)
    bound = np.minimum(n_a - only_a, n_b - only_b)
    return limit.den * bound >= limit.num * (n_a + n_b - bound)


def bitmap(values: np.ndarray) -> np.ndarray:
    """Bit (hash modulo bits) for every element, four bits or more an element, as 64-bit words."""
    bits = min(MAX_BITMAP_BITS, max(64, 1 << (4 * len(values) - 1).bit_length()))
    flags = np.zeros(bits, np.uint8)
    flags[(values & U64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(U64)


class Joined:
    """Union-find over the components present in one block."""

    def __init__(self, labels: np.ndarray):
        self.label, self.of = np.unique(labels, return_inverse=True)
        self.up = list(range(len(self.label)))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def possible_pairs(part: np.ndarray, comp: np.ndarray, n: np.ndarray, maps: list[np.ndarray], limit: Threshold) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of a block the sets of other components it is to be compared with whose sizes and bitmaps allow a link; every pair comes once.

    Sets of the block meet each other where ``part`` is 2, else those of part 0 meet those of part 1.
    """
    words = np.array([len(x) for x in maps])
    for w in np.unique(words):
        smallest = np.flatnonzero(words == w)
        have = np.flatnonzero((words >= w) & (limit.num * n <= limit.den * n[smallest].max()))
        folds = np.stack([folded(maps[i], w) for i in have])
        for i in smallest:
            ok = ((part[have] == 2) | (part[have] != part[i])) & (comp[have] != comp[i])
            ok &= (words[have] > w) | (have > i)
            ok &= limit.den * np.minimum(n[have], n[i]) >= limit.num * np.maximum(n[have], n[i])
            at = np.flatnonzero(ok)
            if len(at):
                own = folds[np.searchsorted(have, i)]
                at = at[may_link(limit, n[i], own, n[have[at]], folds[at])]
            if len(at):
                yield int(i), have[at]


def open_nodes(members: DataFrame, beyond: int = 1) -> DataFrame:
    """(node, rep, component) of nodes of more than ``beyond`` sets that hold more than one component, with the node's size c, its least set, its largest component and
    the number of its sets outside that."""
    sizes = members.groupBy("node", "component").agg(F.count("*").alias("m"), F.min("rep").alias("least"))
    # both sides are stored, so the join is a plain one, which Spark splits at a hot node
    top = stored(sizes.groupBy(F.col("node").alias("t_node")).agg(
        F.sum("m").alias("c"), F.min("least").alias("centre"), F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("ways"))
        .where((F.col("ways") > 1) & (F.col("c") > beyond)).select("t_node", "c", "centre", F.col("top.component").alias("largest"), (F.col("c") - F.col("top.m")).alias("outside")))
    return stored(members.join(top, F.col("node") == F.col("t_node")).drop("t_node"))


def dealt_rows(c: Column, outside: Column, many: int) -> Column:
    """The rows that ``all_pairs`` deals a node of c sets out into."""
    few_blocks, many_blocks = F.ceil(outside / many), F.ceil((c - outside) / many)
    return F.when(c <= many, c).otherwise(outside * (few_blocks + many_blocks) + (c - outside) * few_blocks)


def merged_nodes(members: DataFrame, many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """Open nodes whose largest component has at least half the sets, as one node for each such component where that deals out
    fewer rows; and the members of all others."""
    half = F.col("outside") * 2 <= F.col("c")
    sets = stored(members.where(half).select("largest", "rep", "component").distinct())
    apart = members.where(half & (F.col("rep") == F.col("centre"))).groupBy(F.col("largest").alias("a_largest")).agg(
        F.min("node").alias("hub"), F.sum(dealt_rows(F.col("c"), F.col("outside"), many)).alias("apart"))
    sizes = sets.groupBy(F.col("largest").alias("h_largest")).agg(
        F.count("*").alias("c"), F.sum(F.when(F.col("component") != F.col("largest"), 1).otherwise(0)).alias("outside"))
    # stored, so that the joins below are plain ones, which Spark splits at a hot component
    hubs = stored(sizes.join(apart, F.col("h_largest") == F.col("a_largest")).where(dealt_rows(F.col("c"), F.col("outside"), many) <= F.col("apart"))
                  .select("h_largest", "hub", "c", "outside"))
    merged = sets.join(hubs, F.col("largest") == F.col("h_largest")).select(F.col("hub").alias("node"), "rep", "component", "c", "largest", "outside")
    others = members.join(hubs.select("h_largest"), half & (F.col("largest") == F.col("h_largest")), "left_anti")
    return stored(merged), stored(others)


def all_pairs(members: DataFrame, many: int = MANY) -> DataFrame:
    """(g, part, rep, component): every node as one block, or a larger one as pairs of blocks."""
    return outside_pairs(members, many, F.col("c") <= many)


def outside_pairs(members: DataFrame, most: int = MANY, whole: Column | None = None) -> DataFrame:
    """(g, part, rep, component): pairs of blocks in which every set outside a node's largest component meets all other sets of
    the node; nodes for which ``whole`` holds are one block. ``part`` is 2 in a block met with itself, else 0 and 1 for the two blocks.

    One pass over the members, so a plan that deals many of them out stays small."""
    whole = F.lit(False) if whole is None else whole
    out = F.col("component") != F.col("largest")
    few, many = F.ceil(F.col("outside") / most), F.ceil((F.col("c") - F.col("outside")) / most)
    # a set outside is in a pair of blocks with each block of such sets, then with each of the largest component's; one of the latter with each of the former
    times = F.when(F.col("whole"), 1).when(F.col("out"), F.col("few") + F.col("many")).otherwise(F.col("few"))
    t = members.select("node", "rep", "component", whole.alias("whole"), out.alias("out"), few.alias("few"), many.alias("many")).select(
        "*", F.pmod(F.xxhash64("rep"), F.when(F.col("out"), F.col("few")).otherwise(F.col("many"))).alias("own"),
        F.explode(F.sequence(F.lit(0).cast("long"), times.cast("long") - 1)).alias("o"))
    among = F.col("out") & (F.col("o") < F.col("few"))
    g = (F.when(F.col("whole"), F.xxhash64("node", F.lit(0)))
         .when(among, F.xxhash64("node", F.least("own", "o"), F.greatest("own", "o"), F.lit(1)))
         .when(F.col("out"), F.xxhash64("node", "own", F.col("o") - F.col("few"), F.lit(2))).otherwise(F.xxhash64("node", "o", "own", F.lit(2))))
    part = (F.when(F.col("whole") | (among & (F.col("own") == F.col("o"))), 2)
            .when(among, F.when(F.col("own") < F.col("o"), 0).otherwise(1)).when(F.col("out"), 0).otherwise(1))
    return t.select(g.alias("g"), part.cast("long").alias("part"), "rep", "component")


def _grouped(blocks: DataFrame, other: DataFrame, column: str) -> DataFrame:
    wanted = blocks.select(F.col("rep").alias("w_rep")).distinct()
    if wanted.count() <= MOST_BROADCAST:  # few of the sets are in blocks: the others needn't be shuffled to find that out
        other = other.join(F.broadcast(wanted), F.col("rep") == F.col("w_rep"), "left_semi")
    o = other.select(F.col("rep").alias("o_rep"), "n", column)
    return blocks.join(o, F.col("rep") == F.col("o_rep")).select("g", "part", "rep", "component", "n", column).repartition("g").sortWithinPartitions("g", "rep")


def possible_rows(blocks: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """(g, part, rep, component): the sets of a block that have a possible partner there in another component, each once. ``sets`` has rep, n and
    sig; a name with several sets (rows that share an id) has a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in column_runs(batches, "g", flush_rows=2048):
            cols, rep = {c: table[c].to_numpy() for c in ("part", "component", "n")}, table["rep"].to_numpy()
            maps = [np.frombuffer(x, U64) for x in table["sig"].to_pylist()]
            keep = np.zeros(table.num_rows, bool)
            for lo, hi in zip(starts[:-1], starts[1:]):
                comp, n, part = (cols[c][lo:hi] for c in ("component", "n", "part"))
                if comp.min() == comp.max():
                    continue
                own = np.zeros(hi - lo, bool)
                for i, to in possible_pairs(part, comp, n, maps[lo:hi], limit):
                    own[i] = own[to] = True
                at = np.flatnonzero(own)
                keep[lo + at[np.unique(rep[lo:hi][at], return_index=True)[1]]] = True
            yield from table.select(["g", "part", "rep", "component"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return stored(map_arrow(_grouped(blocks, sets, "sig"), run, "g long, part long, rep long, component long"))


def block_links(candidates: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """(a, b): components that a link joins, found on the full sets; a block gives fewer links than it has components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in column_runs(batches, "g", flush_rows=512):
            part_all, comp_all, n_all = (table[c].to_numpy() for c in ("part", "component", "n"))
            out: list[tuple[int, int]] = []
            for lo, hi in zip(starts[:-1], starts[1:]):
                part, n = part_all[lo:hi], n_all[lo:hi]
                sets = [np.frombuffer(x, U64) for x in table["elements"].slice(lo, hi - lo).to_pylist()]
                joined = Joined(comp_all[lo:hi])
                for i, to in possible_pairs(part, comp_all[lo:hi], n, [bitmap(u) for u in sets], limit):
                    for j in to:
                        x, y = joined.find(joined.of[i]), joined.find(joined.of[j])
                        if x != y and limit.linked(n[i], n[j], len(np.intersect1d(sets[i], sets[j], assume_unique=True))):
                            joined.up[y] = x
                            out.append((int(joined.label[x]), int(joined.label[y])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out]), pa.array([b for _, b in out])], ["a", "b"])

    return stored(map_arrow(_grouped(candidates, sets, "elements"), run, "a long, b long"))
