"""N-gram Jaccard join (operator 1): size-banded tiles, hashed bitmap signatures, exact intersection.

A document's set holds the hashes of its distinct k-word shingles (A-Z lowered).
Documents link when den * |intersection| >= num * |union|. Exactly equal sets
form a class first, and only one document of a class goes on.

Tiles. Sets fall into size bands; a band and, where a smaller set can still reach
the threshold, the next one are searched. Two linked sets of a band's search differ in
at most ``d`` elements (from the band's sizes and the threshold). The hash
space is cut into ``d + 1 + spare`` slices, so linked sets agree wholly in more than
``spare`` slices; a tile is (band, slice, hash of the set's elements in that slice).
A set with at most ``spare`` empty slices thus shares a tile of a filled slice with each
of its links. Sets with more empty slices are also tiled under further hash seeds, and
under the last one with their empty slices too, so no link is lost at any size.

Pairs. Only tiles with two or more sets remain. A first round compares each
set of a tile with the one before it and with the first one, which are all pairs of up to three sets; what links is joined into components.
Larger tiles whose sets still lie in different components are then compared in one round of blocks of bounded size (see ``blocks``):
near copies of one text share very many tiles, so tiles with the same largest component become one node where that deals out fewer rows. Pairs inside one component can't change the
result and aren't compared (``link_counts``, which gives the links of every document, compares all pairs of a tile). In both rounds a pair's bitmaps come first: elements
are hashed into bits, and a bit of A missing from B is an element missing from B, so
|A| less the count of such bits bounds the intersection from above. Pairs that
pass are decided by intersecting their sorted hash arrays.

Defined cases: a null or empty text, or one without words, has size 0 and links with
nothing; fewer than k words are one shingle; a null id keeps its row, with a null component. Ids name
documents: of rows that share an id, each gets the least component of them. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feira.llm.blocks import MOST_BROADCAST, Threshold, all_pairs, bitmap, block_links, folded, may_link, merged_nodes, open_nodes, possible_rows
from feira.llm.graph import components
from feira.llm.textops import U64, chunks, column_runs, map_arrow, mix, mix_int, shingles, stored, word_hashes

BAND_RATIO = 1.35
SEEDS = 6
SPARE_FROM = 24  # sets below this size rely on further seeds instead of spare slices
BLOCK = 512  # sets of a tile compared at once
FIRST_ROUND = 3  # sets of a tile of which the first round compares all pairs
SALT_1, SALT_2, SALT_SLICE = U64(mix_int(11)), U64(mix_int(12)), U64(mix_int(13))


class Bands:
    """The size bands and each one's slices."""

    def __init__(self, limit: Threshold):
        self.limit, self.low, self.cuts = limit, [1], {}

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            last = self.low[-1]
            self.low.append(max(last + 1, math.ceil(last * max(BAND_RATIO, 1.02 * self.limit.den / self.limit.num))))
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def slices(self, band: int) -> tuple[int, int, np.ndarray]:
        """(slices, spare, first hash of each slice) of a band's search."""
        if band not in self.cuts:
            self.of(self.low[band] if band < len(self.low) else 1)
            while len(self.low) <= band + 1:
                self.of(self.low[-1])
            low, high = self.low[band], self.low[band + 1] - 1
            num, den = self.limit.num, self.limit.den
            least = max(1, -(-low * num // den))
            need = 2 * high * (den - num) // (num + den) + 1  # |A| + |B| less twice the least intersection, and one more
            spare = 0
            if least >= SPARE_FROM:
                empty = lambda k: k * (1 - 1 / k) ** least
                while spare < empty(need + spare) + 3 * math.sqrt(empty(need + spare)) and spare < need:
                    spare += 1
            k = need + spare
            edges = np.array([-(-(i << 64) // k) for i in range(k)], dtype=U64)
            self.cuts[band] = (k, spare, edges)
        return self.cuts[band]

    def searched(self, n: int) -> list[int]:
        band = self.of(n)
        nxt = self.low[band + 1]
        return [band, band + 1] if self.limit.den * n >= self.limit.num * nxt else [band]


def tile_keys(values: np.ndarray, bands: Bands) -> np.ndarray:
    """The tiles of one set of sorted distinct hashes."""
    out = []
    for band in bands.searched(len(values)):
        k, spare, edges = bands.slices(band)
        v = values
        for seed in range(SEEDS):
            if seed:
                v = np.sort(mix(values ^ U64(mix_int(100 + seed))))
            begin = np.searchsorted(v, edges)
            sums = np.zeros(len(v) + 1, U64)
            np.cumsum(mix(v ^ SALT_SLICE), out=sums[1:])
            end = np.append(begin[1:], len(v))
            code = mix(U64(mix_int((band << 8) + seed)) + np.arange(k, dtype=U64))
            keys = mix((sums[end] - sums[begin]) ^ code)
            sparse = int((begin == end).sum()) > spare
            out.append(keys if sparse and seed == SEEDS - 1 else keys[end > begin])
            if not sparse:
                break
    return np.concatenate(out).view(np.int64)


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for c in chunks(column):
        hashes, begin = shingles(*word_hashes(c, lower=True), k)
        for i in range(len(c)):
            yield np.unique(hashes[begin[i] : begin[i + 1]])


def _named_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def profile(docs: DataFrame, limit: Threshold, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, h1, h2 (hashes of the whole set) and sig (null where the id is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, sig = [], [], [], []
            for named, u in zip(b.column(0).is_valid().to_pylist(), sets_of(b.column(1), limit.k)):
                n.append(len(u))
                h1.append(int(mix(u ^ SALT_1).sum(dtype=U64).view(np.int64)))
                h2.append(int(mix(u ^ SALT_2).sum(dtype=U64).view(np.int64)))
                sig.append(bitmap(u).tobytes() if named and len(u) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n", "h1", "h2", "sig"])

    return stored(map_arrow(_named_texts(docs, id_col, text_col), run, "doc_id long, n long, h1 long, h2 long, sig binary"))


def _keys(docs: DataFrame, limit: Threshold, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, keys): the tiles of each named document's set, once for equal sets of a task. They are made from the texts again where they
    are dealt out, as eight bytes for each of some hundred tiles would be several times the text on disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, met = Bands(limit), set()
        for b in batches:
            keys = []
            for named, u in zip(b.column(0).is_valid().to_pylist(), sets_of(b.column(1), limit.k)):
                h = (int(mix(u ^ SALT_1).sum(dtype=U64)), int(mix(u ^ SALT_2).sum(dtype=U64)))
                new = named and len(u) and h not in met
                if new:
                    met.add(h)
                keys.append(tile_keys(u, bands) if new else np.zeros(0, np.int64))
            off = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))], ["doc_id", "keys"])

    return map_arrow(_named_texts(docs, id_col, text_col), run, "doc_id long, keys array<long>")


def _shared_tiles(keys: DataFrame) -> DataFrame:
    """(key, doc_id) of the tiles that hold more than one set; streams over sorted rows, holding two at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_id, open_run = None, None, False
        for b in batches:
            if not b.num_rows:
                continue
            key, ident = b.column(0).to_numpy(), b.column(1).to_numpy()
            joined = np.empty(len(key), bool)  # same key as the row before
            joined[0] = last_key is not None and key[0] == last_key
            joined[1:] = key[1:] == key[:-1]
            keep = joined.copy()
            keep[:-1] |= joined[1:]
            out_key, out_id = key[keep], ident[keep]
            if joined[0] and not open_run:  # the last row of the batch before begins this run
                out_key, out_id = np.append(out_key, last_key), np.append(out_id, last_id)
            open_run = bool(joined[-1])
            last_key, last_id = key[-1], ident[-1]
            yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array(out_id)], ["key", "doc_id"])

    rows = keys.where("doc_id IS NOT NULL").select(F.explode("keys").alias("key"), "doc_id")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, doc_id long")


def _pair_blocks(tiles: DataFrame, block: int) -> DataFrame:
    """Rows of each tile dealt into groups ``g``: the pairs (i <= j) of its blocks, ``side`` telling a group's first block."""
    # the count is stored, so that the join is a plain one, which Spark splits at a hot tile
    count = stored(tiles.groupBy(F.col("key").alias("c_key")).agg(F.count("*").alias("c")).where("c > 1"))
    t = tiles.join(count, F.col("key") == F.col("c_key"))
    t = t.withColumn("b", F.pmod(F.xxhash64("rep"), F.floor((F.col("c") - 1) / block) + 1))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / block)))
    t = t.withColumn("o", other)
    i, j = F.least("b", "o"), F.greatest("b", "o")
    return t.select(F.xxhash64("key", i, j).alias("g"), F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1).alias("side"), "rep", "component")


def _candidates(tiles: DataFrame, sizes: DataFrame, limit: Threshold) -> DataFrame:
    """Distinct pairs (a < b) of a tile whose components differ and whose sizes and bitmaps allow a link."""
    return _block_pairs(_pair_blocks(tiles, BLOCK), sizes, limit).distinct()


def _block_pairs(blocks: DataFrame, sizes: DataFrame, limit: Threshold) -> DataFrame:
    """(a, b): pairs (a < b) of a block whose components differ and whose sizes and bitmaps allow a link; a pair comes
    once for each block that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in column_runs(batches, "g", flush_rows=4096):
            side, rep, comp, n = (table[c].to_numpy() for c in ("side", "rep", "component", "n"))
            sigs = [np.frombuffer(x, U64) for x in table["sig"].to_pylist()]
            out_a, out_b = [], []
            for lo, hi in zip(starts[:-1], starts[1:]):
                if comp[lo:hi].min() == comp[lo:hi].max():
                    continue
                words = min(len(x) for x in sigs[lo:hi])
                s = np.stack([folded(x, words) for x in sigs[lo:hi]])
                left = range(lo, hi) if side[lo] == 2 else [i for i in range(lo, hi) if side[i] == 0]
                for i in left:
                    if side[i] == 2:
                        to = np.arange(i + 1, hi)
                    else:
                        to = lo + np.flatnonzero(side[lo:hi] == 1)
                    to = to[(comp[to] != comp[i]) & (limit.den * np.minimum(n[to], n[i]) >= limit.num * np.maximum(n[to], n[i]))]
                    if len(to):
                        to = to[may_link(limit, n[i], s[i - lo], n[to], s[to - lo])]
                    if len(to):
                        out_a.append(np.minimum(rep[to], rep[i]))
                        out_b.append(np.maximum(rep[to], rep[i]))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b)], ["a", "b"])

    rows = blocks.join(sizes, "rep").repartition("g").sortWithinPartitions("g", "rep")
    return map_arrow(rows.select("g", "side", "rep", "component", "n", "sig"), run, "a long, b long")


def _bitmap_filter(pairs: DataFrame, sizes: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs whose sizes and bitmaps allow a link."""
    a = sizes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    b = sizes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    near = (F.least("n_a", "n_b") * limit.den >= F.greatest("n_a", "n_b") * limit.num)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n_a, n_b = t.column(2).to_numpy(), t.column(3).to_numpy()
            keep = np.zeros(t.num_rows, bool)
            for i, (x, y) in enumerate(zip(t.column(4).to_pylist(), t.column(5).to_pylist())):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                words = min(len(x), len(y))
                keep[i] = may_link(limit, n_a[i], folded(x, words), n_b[i], folded(y, words))
            yield pa.RecordBatch.from_arrays([pa.array(t.column(j).to_numpy()[keep]) for j in (0, 1)], ["a", "b"])

    both = pairs.join(a, "a").join(b, "b").where(near).select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
    return map_arrow(both, run, "a long, b long")


def _full_sets(ids: DataFrame, docs: DataFrame, limit: Threshold, id_col: str, text_col: str) -> DataFrame:
    """(rep, n, elements): the sorted hash arrays of the texts of the ids ``w``; only these texts are read into arrays again."""
    ids = stored(ids.distinct())
    if ids.count() <= MOST_BROADCAST:  # few of the texts are wanted: the others needn't be shuffled to find that out
        ids = F.broadcast(ids)
    wanted = _named_texts(docs, id_col, text_col).join(ids, F.col("doc_id") == F.col("w"), "left_semi")
    wanted = wanted.withColumn("t", F.xxhash64("text")).dropDuplicates(["doc_id", "t"]).drop("t")  # repeated rows are one

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(sets_of(b.column(1), limit.k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(u) for u in found], pa.int64()), pa.array([u.tobytes() for u in found], pa.binary())], ["rep", "n", "elements"])

    return stored(map_arrow(wanted, arrays, "rep long, n long, elements binary"))


def _verified(pairs: DataFrame, docs: DataFrame, limit: Threshold, id_col: str, text_col: str) -> DataFrame:
    """The pairs that link, by intersecting their sorted hash arrays."""
    sets = _full_sets(pairs.select(F.col("a").alias("w")).union(pairs.select(F.col("b").alias("w"))), docs, limit, id_col, text_col)
    a = sets.select(F.col("rep").alias("a"), F.col("elements").alias("x"))
    b = sets.select(F.col("rep").alias("b"), F.col("elements").alias("y"))

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            for i, (x, y) in enumerate(zip(t.column(2).to_pylist(), t.column(3).to_pylist())):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                keep[i] = limit.linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([pa.array(t.column(j).to_numpy()[keep]) for j in (0, 1)], ["a", "b"])

    return stored(map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y"), intersect, "a long, b long"))


def _classes(docs: DataFrame, limit: Threshold, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The profiles, (doc_id, rep) of every document's class, (key, rep) of the shared tiles, and (rep, n, sig)."""
    profiles = profile(docs, limit, id_col, text_col)
    usable = profiles.where("n > 0 AND doc_id IS NOT NULL")
    # stored, so that the join below is a plain one, which Spark splits where one class has very many documents
    classes = stored(usable.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")))
    c = classes.select(F.col("n").alias("c_n"), F.col("h1").alias("c_h1"), F.col("h2").alias("c_h2"), "rep")
    member = stored(usable.select("doc_id", "n", "h1", "h2").join(
        c, (F.col("n") == F.col("c_n")) & (F.col("h1") == F.col("c_h1")) & (F.col("h2") == F.col("c_h2"))).select("doc_id", "rep").distinct())
    to_rep = member.withColumnRenamed("doc_id", "m_id")
    tiles = stored(_shared_tiles(_keys(docs, limit, id_col, text_col)).join(to_rep, F.col("doc_id") == F.col("m_id")).select("key", "rep").distinct())
    shared = tiles.select(F.col("rep").alias("s_rep")).distinct()
    sizes = profiles.where("sig IS NOT NULL").join(shared, F.col("doc_id") == F.col("s_rep"), "left_semi")
    sizes = stored(sizes.dropDuplicates(["doc_id", "n", "h1", "h2"]).select(F.col("doc_id").alias("rep"), "n", "sig"))
    return profiles, member, tiles, sizes


def link_counts(docs: DataFrame, limit: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_links (the other documents it links with, those of equal sets included): a row per document.

    All pairs of a tile's class representatives are compared, in the blocks of the second round, and a link of two
    representatives counts once for each document of the other's class. Unlike components, the pairs of a
    group grow with the square of its different sets. A document here is an id with a text (rows that repeat both are
    one, an id with two texts is two); a null id keeps its row, with null links, and counts for no other.
    """
    node = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), node.alias("node"), F.col(text_col).alias("text"))
    _, member, tiles, sizes = _classes(named, limit, "node", "text")
    pairs = stored(_candidates(tiles.withColumn("component", F.col("rep")), sizes, limit))
    links = _verified(pairs, named, limit, "node", "text").distinct()
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = stored(member.groupBy(F.col("rep").alias("w_rep")).agg(F.count("*").alias("weight")))
    other = both.join(weight, F.col("b") == F.col("w_rep")).groupBy(F.col("a").alias("o_rep")).agg(F.sum("weight").alias("other"))
    per_class = stored(weight.join(other, F.col("w_rep") == F.col("o_rep"), "left").select(
        "w_rep", (F.col("weight") - 1 + F.coalesce("other", F.lit(0))).alias("n")))
    single = member.join(per_class, F.col("rep") == F.col("w_rep")).select(F.col("doc_id").alias("m_node"), "n")
    n_links = F.when(F.col("node").isNotNull(), F.coalesce("n", F.lit(0)).cast("long"))
    return named.join(single, F.col("node") == F.col("m_node"), "left").select("doc_id", n_links.alias("n_links"))


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, F.col("rep") == F.col("node"), "left").select(*rows.columns, F.coalesce("component", "rep").alias("component"))


def jaccard_join(docs: DataFrame, limit: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, its own included): a row per document."""
    profiles, member, tiles, sizes = _classes(docs, limit, id_col, text_col)

    in_tile = Window.partitionBy("key").orderBy("rep")
    near = tiles.select(F.lag("rep").over(in_tile).alias("before"), F.first("rep").over(in_tile).alias("first"), "rep")
    near = near.where("before IS NOT NULL").select(F.explode(F.array("before", "first")).alias("a"), F.col("rep").alias("b")).distinct()
    links = _verified(stored(_bitmap_filter(near, sizes, limit)), docs, limit, id_col, text_col)
    found = components(links)

    labelled = stored(_with_component(tiles, found))
    merged, others = merged_nodes(open_nodes(labelled.withColumnRenamed("key", "node"), beyond=FIRST_ROUND), BLOCK)
    possible = possible_rows(all_pairs(merged, BLOCK).union(all_pairs(others, BLOCK)), sizes, limit)
    if not possible.isEmpty():
        more = block_links(possible, _full_sets(possible.select(F.col("rep").alias("w")), docs, limit, id_col, text_col), limit)
        if not more.isEmpty():  # a component is named by one of its sets
            found = components(links.union(more))

    named = member.join(found, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("c"))
    named = named.groupBy(F.col("doc_id").alias("n_id")).agg(F.min("c").alias("c"))
    return profiles.select("doc_id", F.col("n").alias("n_shingles")).join(named, F.col("doc_id") == F.col("n_id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
