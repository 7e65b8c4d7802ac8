"""Grouping of spelling variants by pivotal grams (operator 11).

Words are the letter runs of all texts; two are near if one code point inserted, deleted or replaced turns one into
the other. A bigram's rank is its place among all bigrams of the vocabulary, rarest first.

Prefix. A word's gram prefix is its three rarest bigrams, with all that tie with the third: one edit changes at most two
bigrams of a word.
Pivots. Of the prefix, two disjoint bigrams with the least total frequency are chosen by dynamic programming over the
positions. One edit reaches at most one of them, so the other also stands in any near word, at a place that differs by
the edit at most; if the near word's last prefix rank is not below the own one, it stands in that word's prefix.
Index. So pivots are looked up among the other words' prefixes by (bigram, position, length): at the same place for equal
lengths, and for lengths one apart at the same place (edit behind) or one on (edit before). A list of the index that
is too long for one task is split by what else the two words must share: the edit lies in one of
four regions (half of what is before the bigram or half of what is behind it), and all outside it is equal, so the words are
dealt by a hash of that, once for each region.
Verify. Within a list candidates are the words equal outside a region, found by sorting; common prefixes and
suffixes decide.

A word's form is its most frequent near word, if at least ``ratio`` times as frequent; forms are followed by pointer doubling.

Defined cases: null or empty texts and texts without letters hold no words; a null id counts as the empty text
before the colon of the changed run's hash; repeated rows count each time; of near words that tie in frequency the smallest in
code-point order is the form. Very long texts and runs are taken whole. Other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm.textops import U64, column_runs, map_arrow, mix, mix_int, stored

LETTERS = "a-z\\u00C0-\\u00FF"
LEAST_LENGTH = 7
CODES = 1 << 16  # two code points below 256
BLOCK_BYTES = 1 << 20  # of the words of a list that one task compares
PAIRS_AT_ONCE = 1 << 18

# How a near word's length and the bigram's place in it differ, seen from the pivot's word: (length, place).
SHIFTS = ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))


def runs_of(text: Column, least: int) -> Column:
    """The maximal letter runs of at least so many code points, A-Z lowered."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))


def word_counts(docs: DataFrame, id_col: str, text_col: str, deletes: int = 31, least: int = LEAST_LENGTH) -> DataFrame:
    """word, n of every word with two occurrences or more; a shorter run can't become a word, as at most one code point goes."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs_of(F.col(text_col), least)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    size = F.char_length("run")
    at = F.pmod(h, size).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(h % deletes == 0, short).otherwise(F.col("run"))
    return stored(runs.select(word.alias("word")).where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2"))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of code points) for every length among the words, which have no code point above 255."""
    raw = [w if isinstance(w, bytes) else w.encode("latin-1") for w in column.to_pylist()]
    size = np.array([len(w) for w in raw], np.int64)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        yield rows, np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), length)


def grams(words: np.ndarray) -> np.ndarray:
    return (words[:, :-1].astype(np.int64) << 8) | words[:, 1:]


def gram_ranks(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rank, frequency) of each of the 65,536 pairs of code points; the table's size doesn't depend on the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES, np.int64)
        for b in batches:
            for _, m in by_length(b.column(0)):
                total += np.bincount(grams(m).ravel(), minlength=CODES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "f"])

    rows = map_arrow(words.select("word"), run, "gram long, f long").groupBy("gram").agg(F.sum("f").alias("f")).collect()
    freq = np.zeros(CODES, np.int64)
    for r in rows:
        freq[r.gram] = r.f
    order = np.lexsort((np.arange(CODES), freq))
    rank = np.empty(CODES, np.int64)
    rank[order] = np.arange(CODES)
    return rank, freq


def pivots(cost: np.ndarray) -> np.ndarray:
    """(word, 2): the places of two disjoint bigrams of least total cost (inf: not to be chosen), by dynamic programming over the places."""
    n, places = cost.shape
    one, one_at = np.full(n, np.inf), np.zeros(n, np.int64)  # the best first bigram up to two places back
    two, out = np.full(n, np.inf), np.zeros((n, 2), np.int64)
    for j in range(2, places):
        new = cost[:, j - 2] < one
        one[new], one_at[new] = cost[new, j - 2], j - 2
        total = one + cost[:, j]
        new = total < two
        two[new] = total[new]
        out[new, 0], out[new, 1] = one_at[new], j
    return out


def index_key(gram: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(mix(gram.astype(U64) + U64(mix_int(61))) ^ (place.astype(U64) << U64(32)) ^ length.astype(U64))


def entries(words: DataFrame, rank: np.ndarray, freq: np.ndarray) -> DataFrame:
    """(key, kind, place, last, word, n): the prefix bigrams of every word (kind -1) and the lookups of its pivots, one for each of
    ``SHIFTS`` (kind 0 to 4); ``place`` is where the bigram stands in the word found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_numpy()
            for rows, m in by_length(b.column(0)):
                g = grams(m)
                r = rank[g]
                last = np.sort(r, axis=1)[:, 2]
                prefix = r <= last[:, None]
                chosen = pivots(np.where(prefix, freq[g], np.inf))
                row, place = np.nonzero(prefix)
                length = np.full(len(row), m.shape[1])
                parts = [(row, g[row, place], place, length, np.full(len(row), -1))]
                row = np.repeat(np.arange(len(rows)), 2)
                at = chosen.ravel()
                for kind, (longer, on) in enumerate(SHIFTS):
                    ok = at + on >= 0
                    parts.append((row[ok], g[row[ok], at[ok]], at[ok] + on, np.full(int(ok.sum()), m.shape[1] + longer), np.full(int(ok.sum()), kind)))
                row, gram, place, length, kind = (np.concatenate(x) for x in zip(*parts))
                raw = np.array([x.tobytes() for x in m], object)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index_key(gram, place, length).view(np.int64)), pa.array(kind, pa.int64()), pa.array(place, pa.int64()),
                     pa.array(last[row], pa.int64()), pa.array(raw[row], pa.binary()), pa.array(n[rows][row], pa.int64())],
                    ["key", "kind", "place", "last", "word", "n"])

    return map_arrow(words.select("word", "n"), run, "key long, kind long, place long, last long, word binary, n long")


def regions(place: int, length: int, kind: int) -> list[tuple[int, int, int]]:
    """(number, begin, end): the parts of a found word of this length, with the bigram at ``place``, in which the edit may lie."""
    on = SHIFTS[kind][1] if kind >= 0 else 0
    longer = SHIFTS[kind][0] if kind >= 0 else 0
    before, behind = place // 2, place + 2 + (length - place - 2) // 2
    out = []
    if kind < 0 or longer == 0 or on != 0:
        out += [(0, 0, before), (1, before, place)]
    if kind < 0 or longer == 0 or on == 0:
        out += [(2, place + 2, behind), (3, behind, length)]
    return out


def outside(words: np.ndarray, begin: int, tail: int) -> np.ndarray | None:
    """Hashes of the first ``begin`` and the last ``tail`` code points of the words; None where those would overlap."""
    size = words.shape[1]
    if begin + tail > size:
        return None
    left = np.concatenate([words[:, :begin], words[:, size - tail :]], axis=1).astype(U64) + U64(1)
    code = mix(np.arange(left.shape[1], dtype=U64) + U64(mix_int(62))) | U64(1)
    return mix((left * code).sum(axis=1, dtype=U64))


def split_lists(rows: DataFrame) -> DataFrame:
    """The entries with their list ``g`` and region ``part`` (-1: all): lists above ``BLOCK_BYTES`` are dealt out by region and
    by the hash of what lies outside it, into as many lists as their bytes ask for."""
    weight = F.sum(F.octet_length("word") + 32)
    sizes = stored(rows.groupBy(F.col("key").alias("w_key")).agg(weight.alias("w"), F.min("kind").alias("lo"), F.max("kind").alias("hi"))
                   .where("lo < 0 AND hi >= 0").select("w_key", F.ceil(F.col("w") / BLOCK_BYTES).alias("lists")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, kind, place, last, n, lists = (b.column(i).to_numpy() for i in (0, 1, 2, 3, 5, 6))
            row, part, g = [np.flatnonzero(lists == 1)], [], []
            part.append(np.full(len(row[0]), -1))
            g.append(mix(key[row[0]].view(U64)))
            hot = np.flatnonzero(lists > 1)
            for at, m in by_length(b.column(4).take(pa.array(hot))) if len(hot) else ():
                at = hot[at]
                for k, p in {(int(k), int(p)) for k, p in zip(kind[at], place[at])}:
                    here = np.flatnonzero((kind[at] == k) & (place[at] == p))
                    length = m.shape[1] + (SHIFTS[k][0] if k >= 0 else 0)
                    for number, begin, end in regions(p, length, k):
                        h = outside(m[here], begin, length - end)
                        if h is not None:
                            row.append(at[here])
                            part.append(np.full(len(here), number))
                            g.append(mix(key[at[here]].view(U64) ^ U64(mix_int(70 + number)) ^ mix(h % lists[at[here]].astype(U64))))
            row, part, g = np.concatenate(row), np.concatenate(part), np.concatenate(g)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.view(np.int64)), pa.array(part, pa.int64()), pa.array(kind[row]), pa.array(place[row]), pa.array(last[row]),
                 b.column(4).take(pa.array(row)), pa.array(n[row])], ["g", "part", "kind", "place", "last", "word", "n"])

    joined = rows.join(sizes, F.col("key") == F.col("w_key")).select("key", "kind", "place", "last", "word", "n", "lists")
    return map_arrow(joined, run, "g long, part long, kind long, place long, last long, word binary, n long")


def near(pivot: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether the words of each row, of lengths at most one apart, differ by exactly one inserted, deleted or replaced code point."""
    a, b = pivot.shape[1], found.shape[1]
    if a == b:
        return (pivot != found).sum(axis=1) == 1
    short = min(a, b)
    head = np.logical_and.accumulate(pivot[:, :short] == found[:, :short], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate(pivot[:, ::-1][:, :short] == found[:, ::-1][:, :short], axis=1).sum(axis=1)
    return head + tail >= short


def list_pairs(words: list[bytes], kind: np.ndarray, place: np.ndarray, last: np.ndarray, part: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pivots' rows, found words' rows) of the near pairs of one list."""
    size = np.array([len(w) for w in words])
    for length, at in {(int(x), int(p)) for x, p in zip(size[kind < 0], place[kind < 0])}:
        index = np.flatnonzero((kind < 0) & (size == length) & (place == at))
        found = np.frombuffer(b"".join(words[i] for i in index), np.uint8).reshape(len(index), length)
        for k, (longer, _) in enumerate(SHIFTS):
            look = np.flatnonzero((kind == k) & (size == length - longer) & (place == at))
            if not len(look):
                continue
            mine = np.frombuffer(b"".join(words[i] for i in look), np.uint8).reshape(len(look), length - longer)
            for number, begin, end in regions(at, length, k):
                if part not in (-1, number):
                    continue
                h, f = outside(mine, begin, length - end), outside(found, begin, length - end)
                if h is None or f is None:
                    continue
                order = np.argsort(f, kind="stable")
                lo, hi = np.searchsorted(f[order], h, "left"), np.searchsorted(f[order], h, "right")
                upto = np.cumsum(hi - lo)
                first = 0
                while first < len(look):  # a bounded number of candidates at once
                    stop = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS_AT_ONCE, "right")))
                    count = (hi - lo)[first:stop]
                    p = np.repeat(np.arange(first, stop), count)
                    c = order[np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[first:stop], count)]
                    ok = last[look[p]] <= last[index[c]]
                    p, c = p[ok], c[ok]
                    ok = near(mine[p], found[c])
                    yield look[p[ok]], index[c[ok]]
                    first = stop


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of near words once, a < b in code-point order."""
    rank, freq = gram_ranks(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in column_runs(batches, "g"):
            kind, place, last, part, n = (table[c].to_numpy() for c in ("kind", "place", "last", "part", "n"))
            words_here = table["word"].to_pylist()
            a, b = [], []
            for lo, hi in zip(starts[:-1], starts[1:]):
                if hi - lo > 1:
                    for x, y in list_pairs(words_here[lo:hi], kind[lo:hi], place[lo:hi], last[lo:hi], int(part[lo])):
                        a.append(x + lo)
                        b.append(y + lo)
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                order = [(i, j) if words_here[i] < words_here[j] else (j, i) for i, j in zip(a.tolist(), b.tolist())]
                order = list({(words_here[i], words_here[j]): (i, j) for i, j in order}.values())
                for at in range(0, len(order), 50_000):
                    some = order[at : at + 50_000]
                    cols = [[words_here[i].decode("latin-1") for i, _ in some], n[[i for i, _ in some]],
                            [words_here[j].decode("latin-1") for _, j in some], n[[j for _, j in some]]]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1]), pa.array(cols[2], pa.string()), pa.array(cols[3])], ["a", "n_a", "b", "n_b"])

    lists = split_lists(entries(words, rank, freq)).repartition("g").sortWithinPartitions("g")
    found = map_arrow(lists, run, "a string, n_a long, b string, n_b long")
    return stored(found.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")))


def roots(forms: DataFrame) -> DataFrame:
    """(w, root) of every word with a form, from (word, form): forms are followed to the last by pointer doubling."""
    at = stored(forms.select(F.col("word").alias("w"), F.col("form").alias("root")))
    while True:
        on = at.select(F.col("w").alias("x"), F.col("root").alias("next"))
        moved = stored(at.join(on, F.col("root") == F.col("x"), "left").select("w", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("w", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row per word."""
    words = word_counts(docs, id_col, text_col)
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("w"), F.col("b").alias("o"), F.col("n_b").alias("o_n")),
                                          F.struct(F.col("b").alias("w"), F.col("a").alias("o"), F.col("n_a").alias("o_n")))).alias("p")).select("p.*")
    best = both.groupBy("w").agg(F.count("*").alias("near"), F.min(F.struct((-F.col("o_n")).alias("minus"), F.col("o"))).alias("best"))
    linked = words.join(best, F.col("word") == F.col("w"), "left")
    frequent = -F.col("best.minus") >= ratio * F.col("n")
    linked = stored(linked.select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.o")).alias("form"), F.when(frequent, -F.col("best.minus")).alias("form_n")))
    last = roots(linked.where("form IS NOT NULL"))
    return linked.join(last, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
