"""Near-duplicate groups by chosen-path set similarity join (operator 13).

A document's set holds the hashes of its distinct k-word shingles (A-Z lowered). Documents link when
den * |intersection| >= num * |union|. Exactly equal sets form a class, and one document of a class goes on.

Trees. A set's embedding is its least element under each of ``COORDINATES`` hash orders (minwise tokens). A
node of a tree chooses one or two coordinates, by its own hash alone, so that the expected number of branches is the inverse of
the least similarity; its sets branch by the tokens they hold there. Two sets of similarity s go
the same way at a coordinate with probability s, so a linked pair stays together down to depth d with the
probability ``survival`` computes. Independent trees are repeated until a pair at the threshold gets into one node of the
greatest depth in at least one of them with the probability ``recall``. Sets whose nodes are all compared at depth 1, which
are almost all, need only the trees that reach the recall there; the further trees hold the sets whose node branched on.

Nodes. Small nodes are compared exhaustively: bitmaps bound each overlap from above, and what passes is decided on
the full sorted sets, inside the task. Sets known to be in one component aren't compared again, and a task
gives at most one link less than it has sets. Larger nodes of depth 1 are first dealt at random into blocks of bounded
size, each with the node's least set as its centre, which are compared in the same way and joined into components; two of the trees before the
others, so a group of near copies is mostly one component when the rest see it. From then on
nodes of one component are closed. Those that have at least half their sets in the same largest component are compared as one node (see
``blocks``), as near copies of one text are in most trees' nodes. In one with few sets outside its largest component those are compared with all others; the
rest branch on, and at the greatest depth are compared in that way too. The blocks of all depths and trees below are compared
together at the end. The sets outside a largest component and those in it are dealt into blocks of one bounded size, every one of the former with every one of the
latter, so where the former fill one block no set of the latter is dealt twice. A node's sets are never collected together.

Defined cases: rows are the documents; a null or empty text, or one without words, has size 0 and links with
nothing; fewer than k words are one shingle; a null id keeps its row, with a null component, and is kept; of rows that
share an id each has its own set. Long texts are hashed as a whole, by chunks of a batch. Ties need no rule, as a component's least id is unique. Other columns are
not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm.blocks import Threshold, all_pairs, bitmap, block_links, merged_nodes, open_nodes, outside_pairs, possible_rows  # noqa: F401
from feira.llm.graph import components
from feira.llm.jaccard_join import sets_of
from feira.llm.textops import U64, map_arrow, mix, mix_int, stored

COORDINATES = 64
DEPTH = 8
RECALL = 0.999999
FIRST_TREES = 2
NODE = 64  # sets that are compared exhaustively
FEW, MANY = 128, 512  # a node with up to 4 * FEW sets outside its largest component doesn't branch; sets of a block


def least_similarity(limit: Threshold) -> float:
    return limit.num / limit.den


def survival(similarity: float, branches: float, depth: int) -> float:
    """Probability that two sets share a node at ``depth``, if a node chooses one coordinate, or two with probability ``branches`` - 1."""
    p, two = 1.0, branches - 1
    for _ in range(depth):
        stay = similarity * p
        p = (1 - two) * stay + two * (1 - (1 - stay) ** 2)
    return p


def trees_for(limit: Threshold, recall: float, depth: int) -> int:
    low = least_similarity(limit)
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(low, min(2.0, 1 / low), depth)))


def choices(path: np.ndarray, limit: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node: its first coordinate, its second one, and whether it uses that too."""
    h = mix(path ^ U64(mix_int(41)))
    first = (h % U64(COORDINATES)).astype(np.int64)
    second = (first + 1 + (mix(h) % U64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    use = (mix(h ^ U64(mix_int(42))) >> U64(11)).astype(np.float64) / float(1 << 53) < min(2.0, 1 / least_similarity(limit)) - 1
    return first, second, use


def branches(path: np.ndarray, tokens: np.ndarray, limit: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of every branch that the rows, each at a node with an embedding, follow."""
    first, second, use = choices(path, limit)
    rows = np.arange(len(path))
    row = np.concatenate([rows, rows[use]])
    at = np.concatenate([first, second[use]])
    child = mix(mix(path[row] + U64(mix_int(44)) * (at.astype(U64) + U64(1))) ^ tokens[row, at].astype(U64))
    return row, child


def embedding(sets: list[np.ndarray]) -> np.ndarray:
    """The upper half of each set's least hash under every order; sets aren't empty."""
    if not sets:
        return np.zeros((0, COORDINATES), np.int32)
    flat = np.concatenate(sets)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), COORDINATES), np.int32)
    for j in range(COORDINATES):
        order = (flat ^ U64(mix_int(200 + j))) * U64(mix_int(300 + j) | 1)
        out[:, j] = (np.minimum.reduceat(order, begin) >> U64(32)).astype(np.uint32).view(np.int32)
    return out


def class_sets(docs: DataFrame, limit: Threshold, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, rep) of every document, and (rep, d, th, n, tokens, sig) of every class; ``rep`` is the row number that
    names a class, ``d`` and ``th`` the id and a hash of the text where its set can be made again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()  # sets that this task has given already
        for b in batches:
            names, fresh = [], []
            for named, u in zip(b.column(0).is_valid().to_pylist(), sets_of(b.column(1), limit.k)):
                h = (int(mix(u ^ U64(mix_int(51))).sum(dtype=U64).view(np.int64)), int(mix(u ^ U64(mix_int(52))).sum(dtype=U64).view(np.int64)))
                new = bool(named and len(u) and h not in met)
                if new:
                    met.add(h)
                names.append((len(u), *h))
                fresh.append(u if new else None)
            tokens = iter(embedding([u for u in fresh if u is not None]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), *(pa.array([x[i] for x in names], pa.int64()) for i in range(3)),
                 pa.array([None if u is None else next(tokens).tobytes() for u in fresh], pa.binary()),
                 pa.array([None if u is None else bitmap(u).tobytes() for u in fresh], pa.binary())],
                ["doc_id", "th", "n", "h1", "h2", "tokens", "sig"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("th"))
    rows = stored(map_arrow(picked, run, "doc_id long, th long, n long, h1 long, h2 long, tokens binary, sig binary").withColumn("row", F.monotonically_increasing_id()))
    # stored, so that the joins below are plain ones, which Spark splits where one class has very many documents
    reps = stored(rows.where("tokens IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("row").alias("rep"))
                  .select(F.col("n").alias("c_n"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), "rep"))
    same = (F.col("n") == F.col("c_n")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & F.col("doc_id").isNotNull()
    member = stored(rows.join(reps, same, "left").select("doc_id", "n", "rep"))
    sets = rows.where("tokens IS NOT NULL").join(reps.select(F.col("rep").alias("r")), F.col("row") == F.col("r"), "left_semi")
    return member, sets.select(F.col("row").alias("rep"), F.col("doc_id").alias("d"), "th", "n", "tokens", "sig")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col))


def elements(docs: DataFrame, sets: DataFrame, limit: Threshold, id_col: str, text_col: str) -> DataFrame:
    """(rep, n, elements): the sorted hashes of the given classes' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(sets_of(b.column(1), limit.k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(u) for u in found], pa.int64()), pa.array([u.tobytes() for u in found], pa.binary())], ["rep", "n", "elements"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("t")).where("doc_id IS NOT NULL")
    texts = texts.dropDuplicates(["doc_id", "t"])  # a row repeated very often is reduced before the shuffle
    wanted = sets.select("rep", "d", "th")
    return stored(map_arrow(texts.join(wanted, (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("th"))).select("rep", "text"), run, "rep long, n long, elements binary"))


def first_nodes(sets: DataFrame, trees: range, limit: Threshold) -> DataFrame:
    """(tree, node, rep): the nodes of depth 1 of the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.array(trees, np.int64)
        top = mix(number.astype(U64) + U64(mix_int(43)))
        for b in batches:
            if not b.num_rows:
                continue
            tokens = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            row, node = branches(np.tile(top, b.num_rows), np.repeat(tokens, len(top), axis=0), limit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[row % len(top)]), pa.array(node.view(np.int64)), pa.array(b.column(0).to_numpy()[row // len(top)])], ["tree", "node", "rep"])

    return map_arrow(sets.select("rep", "tokens"), run, "tree long, node long, rep long")


def shared_first_nodes(sets: DataFrame, trees: range, limit: Threshold) -> DataFrame:
    """The rows of ``first_nodes`` whose node has another set, with the node's size c and least set; the nodes are made twice, which costs less than storing them."""
    every = first_nodes(sets, trees, limit)
    counts = stored(every.groupBy(F.col("node").alias("c_node")).agg(F.count("*").alias("c"), F.min("rep").alias("centre")).where("c > 1"))
    return stored(every.join(counts, F.col("node") == F.col("c_node")).drop("c_node"))


def next_nodes(members: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """(node, rep, component): the children of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tokens = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            row, node = branches(b.column(0).to_numpy().view(U64), tokens, limit)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *(pa.array(b.column(i).to_numpy()[row]) for i in (1, 2))], ["node", "rep", "component"])

    s = sets.select(F.col("rep").alias("s_rep"), "tokens")
    return map_arrow(members.join(s, F.col("rep") == F.col("s_rep")).select("node", "rep", "component", "tokens"), run, "node long, rep long, component long")


def with_components(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """The members with their class's component so far."""
    if found is None:
        return members.withColumn("component", F.col("rep"))
    return members.join(found, F.col("rep") == F.col("node_"), "left").select(
        *members.columns, F.coalesce("component_", "rep").alias("component"))


def dealt(members: DataFrame) -> DataFrame:
    """(g, part, rep, component): every node as one block, large ones dealt at random into several, each with the node's centre."""
    blocks = F.ceil(F.col("c") / NODE)
    here = F.array(F.pmod(F.xxhash64("rep", "node"), blocks))
    at = F.when(F.col("rep") == F.col("centre"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(here)
    t = members.withColumn("at", F.explode(at))
    return t.select(F.xxhash64("node", "at").alias("g"), F.lit(2).cast("long").alias("part"), "rep", "component")


class Search:
    """The components found so far, as (node_, component_), and how blocks extend them."""

    def __init__(self, sets: DataFrame, full: DataFrame, limit: Threshold):
        self.sets, self.full, self.limit = sets, full, limit
        self.found: DataFrame | None = None
        self.edges: DataFrame | None = None

    def compare(self, blocks: DataFrame) -> None:
        candidates = possible_rows(blocks, self.sets, self.limit)
        if candidates.isEmpty():
            return
        links = block_links(candidates, self.full, self.limit)
        if not links.isEmpty():
            # a component is named by one of its classes, so all links together give the new components
            self.edges = links if self.edges is None else self.edges.union(links)
            self.found = stored(components(self.edges).select(F.col("node").alias("node_"), F.col("component").alias("component_")))

    def labelled(self, members: DataFrame) -> DataFrame:
        return stored(with_components(members.select("node", "rep"), self.found))

    def descend(self, members: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame | None]:
        """The nodes to compare of the given open ones of depth 1 and of the large ones' descendants, and (rep) of the sets that branched."""
        nodes, branched = [], None
        for level in range(1, depth + 1):
            ends = F.lit(level == depth) | (F.col("outside") <= 4 * FEW)
            merged, others = merged_nodes(members.where(F.col("c") > NODE), MANY)
            nodes += [t.select("node", "rep", "component", "c", "largest", "outside") for t in (members.where(F.col("c") <= NODE), merged, others.where(ends))]
            members = others.where(~ends)
            if members.isEmpty():
                break
            branched = stored(members.select("rep").distinct()) if branched is None else branched
            members = open_nodes(stored(next_nodes(members.select("node", "rep", "component"), self.sets, self.limit)))
        return nodes, branched


def near_duplicates(
    docs: DataFrame, limit: Threshold = Threshold(k=5, num=80, den=100), id_col: str = "doc_id", text_col: str = "text",
    recall: float = RECALL, depth: int = DEPTH,
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, its own included), kept: a row per document."""
    member, sets = class_sets(docs, limit, id_col, text_col)
    shallow = trees_for(limit, recall, 1)
    first = shared_first_nodes(sets, range(shallow), limit)
    active = first.select(F.col("rep").alias("a_rep")).distinct()
    sets = stored(sets.join(active, F.col("rep") == F.col("a_rep"), "left_semi"))
    state = Search(sets, elements(docs, sets, limit, id_col, text_col), limit)
    early = first.where(F.col("tree") < FIRST_TREES).withColumn("component", F.col("rep"))
    state.compare(dealt(early))
    wide = open_nodes(state.labelled(first.where((F.col("tree") >= FIRST_TREES) | (F.col("c") > NODE))))
    merged, others = merged_nodes(wide.where(F.col("c") > NODE), MANY)
    state.compare(dealt(wide.where(F.col("c") <= NODE)).union(dealt(others)).union(all_pairs(merged, MANY)))
    # the small and the merged nodes are done; what parted from another one below depth 1 needs the trees that reach the recall there
    large = open_nodes(state.labelled(others))
    nodes, branched = state.descend(large, depth)
    if branched is not None:
        deep = stored(sets.join(branched.withColumnRenamed("rep", "b_rep"), F.col("rep") == F.col("b_rep"), "left_semi"))
        more = shared_first_nodes(deep, range(shallow, trees_for(limit, recall, depth)), limit)
        nodes += state.descend(open_nodes(state.labelled(more)), depth)[0]
    # stored, so that the plans of the comparison read one table, however many depths there were
    state.compare(all_pairs(stored(reduce(DataFrame.union, nodes)), MANY))

    labelled = with_components(member, state.found)
    least = stored(labelled.where("component IS NOT NULL").groupBy(F.col("component").alias("l_component")).agg(F.min("doc_id").alias("least")))
    out = labelled.join(least, F.col("component") == F.col("l_component"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
