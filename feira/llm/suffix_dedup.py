"""Removal of long repeated byte strings by recursive naming at content-defined anchors (operator 5).

Every byte covered by an ``length``-byte string that also starts anywhere else goes.

The dealt method sorts sampled suffixes and compares neighbours; here no order is made and nothing is sorted: of the
difference-cover algorithm only the sampled triples, the recursion on names and a last step by whole prefixes remain, with
equal names found by grouping.

Sampled suffixes. The suffixes compared start at anchors: positions whose 48-byte
gram has the least hash (leftmost among equals) of some ``window`` consecutive positions, so that equal strings
have the same anchors inside. A document's anchors are numbered, and the difference cover
{1, 2} modulo 3 samples two of each three: of the first three anchors x0, x1, x2 in
a string, wherever it occurs, at least one is sampled in both of any two occurrences.
1. Triples: the three 45-byte symbols at each sampled anchor are its triple; equal triples
   get equal names, by grouping (partial aggregation before the shuffle) and joining the
   names back. Names that occur once end there: their suffixes repeat nothing.
2. Recursion on names: a surviving name is joined with the bytes of all strings
   that the anchor stands for (from the first to the end of the last that has it
   among its three anchors), which is a longer name. If that recurs, all those strings repeat. Where a name
   has several longer names, the suffixes part somewhere inside: one occurrence of
   each longer name goes on, cut into cells of 64, then 8 starts on a grid aligned with the anchor. All strings
   that start in a cell share a core of bytes; the core's name joins the cell's, so a cell
   goes on only while its core occurs with several continuations.
3. Merging the rest: at the last level every remaining suffix has the name of its own whole
   ``length``-byte prefix, relative to its sampled anchor, and equal prefixes meet.
At each level a group's key is the anchor's name, the place relative to the
anchor and the core, then a hash of all the bytes, and only counts and one occurrence of a group are kept: no
group, however large, is collected anywhere.

Names are 64-bit hashes; a decision rests on two of them of different byte ranges, one of a polynomial and one XXH3 of all the
bytes. A document is known by one 64-bit hash of its id and text. Defined cases: a
null text is empty; shorter texts than ``length`` lose nothing but count as they
are; identical rows, ids included, are occurrences of their own; a null id keeps its row. If bytes
left over aren't UTF-8 (a character lost a part), ``kept_text`` drops the broken rest of it.
Empty tables give empty results; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm.textops import U64, Chunk, Prefix, chunks, map_arrow, mix, mix_int, ranges, stored

LENGTH = 400
GRAM = 48
LEAST_WINDOW = 8
LEVELS = (None, 64, 8, 1)  # starts of a cell at each level; None: all of an anchor's


def symbol_size(length: int) -> int:
    """Bytes of a symbol, three of which are a sampled anchor's triple (45 at a length of 400)."""
    return max(8, min(45, length // 8 - 4))


def window_size(length: int) -> int:
    """Consecutive gram positions that hold an anchor: three anchors, and the triple at the last one, fit into any string, and
    so do the windows that decide them (4 * window + GRAM <= length + 2, 3 * window + 3 symbols <= length + 1)."""
    w = min((length + 2 - GRAM) // 4, (length + 1 - 3 * symbol_size(length)) // 3)
    if w < LEAST_WINDOW:
        raise ValueError(f"strings of {length} bytes are too short for {LEAST_WINDOW} grams of {GRAM} bytes and three anchors")
    return w


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


class Anchors:
    """The anchors of a chunk's texts and the strings each sampled one stands for."""

    def __init__(self, chunk: Chunk, length: int):
        self.chunk, self.length = chunk, length
        w = window_size(length)
        off, size = chunk.offsets, len(chunk.data)
        self.prefix = Prefix(chunk.data)
        text_of = self._texts(size)
        end = off[1:][text_of] if size else np.zeros(0, np.int64)
        n = size - GRAM + 1
        none = np.zeros(0, np.int64)
        self.at = self.text = self.number = none
        self.first_start = self.last_start = none
        if n < w:
            return
        at = np.arange(n)
        packed = self.prefix.hashes(at, at + GRAM) & U64(0xFFFFFFFF00000000) | at.astype(U64)
        packed[at + GRAM > end[:n]] = U64(0xFFFFFFFFFFFFFFFF)
        least, have = packed, 1  # least of `have` positions from each one on
        while 2 * have <= w:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < w:
            least = np.minimum(least[: len(least) - (w - have)], least[w - have :])
        starts = np.arange(len(least))
        inside = starts + w - 1 + GRAM <= end[: len(least)]
        starts, anchor = starts[inside], (least[inside] & U64(0xFFFFFFFF)).astype(np.int64)
        if not len(anchor):
            return
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        self.at = anchor[new]
        self.text = text_of[self.at]
        begin = np.searchsorted(self.text, np.arange(len(chunk)))
        self.number = np.arange(len(self.at)) - begin[self.text]
        # strings whose first anchor this is: starts lo .. hi, as far as they fit into the text
        lo = starts[new]
        hi = np.append(lo[1:] - 1, 0)
        same = np.append(self.text[1:] == self.text[:-1], False)
        last = off[1:][self.text] - length  # last start of a whole string
        hi = np.where(same, hi, last)
        self.lo, self.hi = lo, np.minimum(hi, last)
        # an anchor stands for the strings that have it among their first three
        back = np.minimum(self.number, 2)
        self.first_start = self.lo[np.arange(len(self.at)) - back]
        self.last_start = self.hi

    def _texts(self, size: int) -> np.ndarray:
        return np.repeat(np.arange(len(self.chunk)), np.diff(self.chunk.offsets))

    def sampled(self) -> np.ndarray:
        """Indices of the sampled anchors that stand for a string."""
        if not len(self.at):
            return self.at
        return np.flatnonzero((self.number % 3 != 0) & (self.last_start >= self.first_start))

    def names(self, which: np.ndarray) -> np.ndarray:
        """Names of the triples of symbols at these anchors."""
        h, size = np.zeros(len(which), U64), symbol_size(self.length)
        for j in range(3):
            p = self.at[which] + j * size
            h = mix(h + self.prefix.hashes(p, p + size) * U64(mix_int(300 + j) | 1))
        return h

    def long_names(self, which: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Names of the bytes of the strings that start in first .. last, relative to the anchors."""
        data = memoryview(self.chunk.data)
        h = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (last + self.length).tolist())), U64, len(first))
        return mix(h + mix((self.at[which] - first).astype(U64)) * U64(mix_int(310) | 1))


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def sampled_triples(docs: DataFrame, length: int) -> DataFrame:
    """rk, names: the names of each document's sampled triples, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1), 1 << 20):
                a = Anchors(c, length)
                which = a.sampled()
                counts = np.bincount(a.text[which], minlength=len(c))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, len(c)), _lists(_signed(a.names(which)), counts, pa.int64())], ["rk", "names"])

    return map_arrow(docs.select("rk", "text"), run, "rk long, names array<long>").where(F.size("names") > 0)


def _keyed(flagged: DataFrame, length: int, step: int | None) -> DataFrame:
    """(k1, k2, rk, o, f, l): the keys of a level of the recursion and what stands there.

    ``flagged`` has rk, text and ``places``: structs of a sampled anchor's ordinal ``o`` and the first and last
    start ``f`` and ``l`` that go on (ignored where ``step`` is None: all that the anchor stands for).
    ``k1`` names the anchor's triple, the cell and its core, ``k2`` all its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1), 1 << 20):
                a = Anchors(c, length)
                which = a.sampled()
                begin = np.searchsorted(a.text[which], np.arange(len(c)))
                base = c.offsets[:-1]
                places = b.column(2).slice(c.lo, len(c))
                flat = places.flatten()
                texts = np.repeat(np.arange(len(c)), places.value_lengths().to_numpy())
                o, f, l = (flat.field(x).to_numpy() for x in ("o", "f", "l"))  # noqa: E741
                at = which[begin[texts] + o]
                name = a.names(at)
                if step is None:
                    first, last = a.first_start[at], a.last_start[at]
                else:
                    low, high = base[texts] + f, base[texts] + l
                    from_cell, to_cell = (a.at[at] - high) // step, (a.at[at] - low) // step
                    rep = np.repeat(np.arange(len(at)), to_cell - from_cell + 1)
                    cell = ranges(from_cell, to_cell - from_cell + 1)
                    anchor = a.at[at][rep]
                    nearest = anchor - cell * step  # the cell's last possible start; its core is in all its strings
                    first, last = np.maximum(low[rep], nearest - (step - 1)), np.minimum(high[rep], nearest)
                    core = a.prefix.hashes(nearest, nearest - (step - 1) + length)
                    name = mix(name[rep] + mix(cell.astype(U64)) * U64(mix_int(320 + step) | 1) + core * U64(mix_int(321) | 1))
                    at, texts, o = at[rep], texts[rep], o[rep]
                long = a.long_names(at, first, last)
                rk = b.column(0).slice(c.lo, len(c)).to_numpy()[texts]
                arrays = [_signed(name), _signed(long), rk, o, first - base[texts], last - base[texts]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["k1", "k2", "rk", "o", "f", "l"])

    return stored(map_arrow(flagged.select("rk", "text", "places"), run, "k1 long, k2 long, rk long, o long, f long, l long"))


def _level(flagged: DataFrame, length: int, step: int | None, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rk, first, last) of starts that repeat at this level, and (rk, places) of what goes on to the next one."""
    keyed = _keyed(flagged, length, step)
    # rows with one key are several occurrences of it
    weighed = keyed.join(copies, F.col("rk") == F.col("copy_rk"), "left")
    groups = stored(weighed.groupBy("k1", "k2").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("n"), F.min(F.struct("rk", "o", "f", "l")).alias("one")))
    again = groups.where("n > 1").select(F.col("k1").alias("g1"), F.col("k2").alias("g2"))
    repeats = keyed.join(again, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2"))).select("rk", F.col("f").alias("first"), F.col("l").alias("last"))
    parted = groups.groupBy(F.col("k1").alias("p1")).agg(F.count("*").alias("ways")).where("ways > 1")
    on = groups.join(parted, F.col("k1") == F.col("p1"), "left_semi").select("one.*")
    return stored(repeats), stored(on.groupBy("rk").agg(F.collect_list(F.struct("o", "f", "l")).alias("places")))


def repeated_starts(keyed_docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """For documents with a row key ``rk`` and ``text``: (rk, first, last) ranges of starts of
    repeated strings, and the stored (rk, text) of the documents that may have any."""
    names = stored(sampled_triples(keyed_docs, length))
    rows = names.select("rk", F.posexplode("names").alias("ordinal", "name"))
    # stored, so that the join below is a plain one, which Spark splits where one name has very many rows
    common = stored(rows.groupBy(F.col("name").alias("c_name")).agg(F.count("*").alias("n")).where("n > 1").select("c_name"))
    unset = F.lit(-1).cast("long")
    place = F.struct(F.col("ordinal").cast("long").alias("o"), unset.alias("f"), unset.alias("l"))
    hits = stored(rows.join(common, F.col("name") == F.col("c_name")).groupBy(F.col("rk").alias("h_rk")).agg(F.collect_set(place).alias("places")))
    copies = stored(names.groupBy(F.col("rk").alias("copy_rk")).agg(F.count("*").alias("copies")).where("copies > 1"))
    flagged = keyed_docs.join(hits, F.col("rk") == F.col("h_rk")).select("rk", "text", "places")
    flagged = stored(flagged.dropDuplicates(["rk"]) if not copies.isEmpty() else flagged)
    texts = flagged.select("rk", "text")
    found, on = _level(flagged, length, LEVELS[0], copies)
    for step in LEVELS[1:]:
        deeper = on.withColumnRenamed("rk", "o_rk")
        repeats, on = _level(texts.join(deeper, F.col("rk") == F.col("o_rk")), length, step, copies)
        found = found.union(repeats)
    return found, texts


def removed_runs(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (begin, end) of the bytes covered by strings that start in the given ranges."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate((last + length)[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]]) if len(begin) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return begin[at], end[np.append(at[1:], len(begin)) - 1] if len(at) else end


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), with_text: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, then ``kept_text`` if asked for and the columns ``keep``
    as k0, k1, ..: a row per document."""
    carried = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    keyed = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("rk"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carried)
    found, texts = repeated_starts(keyed.select("rk", "text"), length)
    ranges = found.groupBy(F.col("rk").alias("r_rk")).agg(F.collect_set(F.struct("first", "last")).alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, spans, sha, kept_texts = [], [], [], []
            for text, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode()
                begin, end = removed_runs(np.array([s["first"] for s in starts], np.int64), np.array([s["last"] for s in starts], np.int64), length)
                edges = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                removed.append(len(raw) - len(kept))
                spans.append(len(begin))
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode("utf-8", "ignore") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(kept_texts, pa.string())],
                ["x_rk", "x_removed", "x_spans", "x_sha", "x_text"])

    cut_rows = map_arrow(texts.join(ranges, F.col("rk") == F.col("r_rk")).select("rk", "text", "starts"), cut,
                         "x_rk long, x_removed long, x_spans long, x_sha string, x_text string")
    unchanged = [F.col("text")] if with_text else []
    base = keyed.select("doc_id", "rk", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
                        *unchanged, *(f"k{i}" for i in range(len(keep))))
    out = base.join(cut_rows, F.col("rk") == F.col("x_rk"), "left")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("x_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("x_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("x_sha", "sha").alias("kept_sha256"), *([F.coalesce("x_text", "text").alias("kept_text")] if with_text else []),
        *(f"k{i}" for i in range(len(keep))),
    )
