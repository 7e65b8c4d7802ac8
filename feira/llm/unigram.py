"""SentencePiece encoding and decoding (operator 10): unigram Viterbi over a double-array trie.

The pieces and their log scores come from a model file (a parameter); the
segmentation is the one with the highest sum of scores. The pieces' bytes
form a double-array trie (arrays base and check; value holds piece ids). Texts
follow SentencePiece's identity normaliser: one space is put before a
non-empty text and every space is the whitespace mark. A character that no
piece covers is spelled in byte pieces, at the score of an unknown character.

No piece holds a space after another character or one of the bytes in
``alone``, so the best path of a text is the joined best paths of its segments: a run
of spaces with the non-spaces after it, or one such byte. The distinct
segments of some megabytes of text are solved together, position by position,
walking the trie for all of them at once in numpy. Equal scores go to the path whose last piece
begins earlier, as in SentencePiece.

Decoding joins the pieces' bytes, whitespace marks as spaces, and drops the first one.

Defined cases: a null text gives null ids, null ids a null text; an empty text no ids. U+2581
in a text isn't a space: it is spelled in bytes, so that decoding restores it.
Ids outside the vocabulary decode to nothing, as do control pieces. Repeated rows and empty
tables pass through; work and memory per task follow the batch (16 MB, or one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm.textops import Chunk, chunks, map_arrow, range_hashes, ranges

MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0  # below the least score, as in SentencePiece
NONE = -1


@dataclass
class Vocabulary:
    """The trie and what decoding needs; its size is that of the vocabulary file."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece id at the end of a piece, else -1
    scores: np.ndarray
    byte_ids: np.ndarray  # piece of each byte, or the unknown piece
    unknown_score: float
    alone: np.ndarray  # bytes that occur in no ordinary piece
    piece_bytes: np.ndarray  # all pieces' decoded bytes
    piece_at: np.ndarray  # where each piece's bytes begin (n + 1 entries)
    is_byte: np.ndarray


def double_array(keys: Sequence[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie; the child of state s by byte b is base[s] + b if its check is s."""
    tree: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for key, ident in keys:
        node = 0
        for b in key:
            if b not in tree[node]:
                tree[node][b] = len(tree)
                tree.append({})
            node = tree[node][b]
        ends.setdefault(node, ident)
    size = max(1024, 2 * len(tree) + 512)
    base, check, value = np.zeros(size, np.int32), np.full(size, NONE, np.int32), np.full(size, NONE, np.int32)
    check[0] = 0
    free = 257  # every slot below is taken or too low for some child code
    todo = [(0, 0)]
    while todo:
        node, state = todo.pop()
        value[state] = ends.get(node, NONE)
        if not tree[node]:
            continue
        codes = np.array(sorted(tree[node]))
        while check[free] != NONE:
            free += 1
        at, window = 0, 256
        while not at:  # the first place where all children fit, among the next free slots
            if free + window + 512 >= len(check):
                base, check, value = (np.concatenate([a, np.full(len(a), fill, np.int32)]) for a, fill in ((base, 0), (check, NONE), (value, NONE)))
            slots = free + np.flatnonzero(check[free : free + window] == NONE) - codes[0]
            slots = slots[slots > 0]
            fits = slots[(check[slots[:, None] + codes] == NONE).all(axis=1)] if len(slots) else slots
            at = int(fits[0]) if len(fits) else 0
            window *= 4
        base[state] = at
        check[at + codes] = state
        todo += [(tree[node][int(b)], at + int(b)) for b in codes]
    return np.concatenate([base, np.zeros(512, np.int32)]), np.concatenate([check, np.full(512, NONE, np.int32)]), np.concatenate([value, np.full(512, NONE, np.int32)])


def vocabulary(pieces: Sequence[tuple[str, float, str]]) -> Vocabulary:
    """From (piece, log score, kind) in the order of ids; kind is normal, byte, unknown or control."""
    normal = [(p.replace("▁", " ").encode(), i) for i, (p, _, kind) in enumerate(pieces) if kind == "normal" and p]
    if any(b" " in k.lstrip(b" ") for k, _ in normal):
        raise ValueError("a piece holds a space after another character")
    scores = np.array([s for _, s, _ in pieces], float)
    unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == "unknown"), 0)
    byte_ids = np.full(256, unknown, np.int32)
    is_byte = np.zeros(len(pieces), bool)
    decoded = []
    for i, (p, _, kind) in enumerate(pieces):
        if kind == "byte":
            byte_ids[int(p[3:5], 16)] = i
            is_byte[i] = True
            decoded.append(bytes([int(p[3:5], 16)]))
        else:
            decoded.append(p.replace("▁", " ").encode() if kind == "normal" else b"")
    used = np.zeros(256, bool)
    used[np.frombuffer(b"".join(k for k, _ in normal), np.uint8)] = True
    alone = ~used & (np.arange(256) < 128)
    alone[32] = False
    least = min((pieces[i][1] for _, i in normal), default=0.0)
    return Vocabulary(
        *double_array(normal), scores, byte_ids, least - UNKNOWN_PENALTY, alone,
        np.frombuffer(b"".join(decoded), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in decoded])]).astype(np.int64), is_byte,
    )


def load_vocabulary(model_file: str) -> Vocabulary:
    """The pieces of a SentencePiece model file that the driver can read."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: "byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "control" if m.is_control(i) or m.is_unused(i) else "normal"
    return vocabulary([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])


def viterbi(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best pieces of each segment data[start:end]: all ids in order, and how many each segment has."""
    n, sizes = len(starts), ends - starts
    order = np.argsort(-sizes, kind="stable")  # at any position the segments that reach it are a prefix
    s, size = starts[order], sizes[order]
    cell = np.concatenate([[0], np.cumsum(size + 1)])  # cells of segment i: one for each byte position and the end
    best = np.full(cell[-1], -np.inf)
    best[cell[:-1]] = 0.0
    step = np.zeros(cell[-1], np.int32)  # bytes of the piece that ends here on the best path
    piece = np.full(cell[-1], NONE, np.int32)
    lead = (data & 0xC0) != 0x80
    wide = np.ones(256, np.int32)  # bytes of the character that a lead byte begins
    wide[0xC0:], wide[0xE0:], wide[0xF0:] = 2, 3, 4
    for p in range(int(size[0]) if n else 0):
        live = int(np.searchsorted(-size, -p, side="left"))  # segments longer than p
        seg = np.arange(live)
        seg = seg[lead[s[:live] + p]]
        if not len(seg):
            continue
        here = best[cell[seg] + p]
        state, at, base_score, who = np.zeros(len(seg), np.int32), s[seg] + p, here, seg
        single = np.zeros(len(seg), bool)  # a piece of just this character was found
        index = np.arange(len(seg))
        char = wide[data[at]]
        length = 0
        while len(who):
            child = v.base[state] + data[at + length]
            good = v.check[child] == state
            good &= child != 0
            who, state, at, base_score, index = who[good], child[good], at[good], base_score[good], index[good]
            length += 1
            ident = v.value[state]
            hit = np.flatnonzero(ident >= 0)
            if len(hit):
                target = cell[who[hit]] + p + length
                score = base_score[hit] + v.scores[ident[hit]]
                better = score > best[target]
                t, h = target[better], hit[better]
                best[t], step[t], piece[t] = score[better], length, ident[h]
                single[index[hit[char[index[hit]] == length]]] = True
            more = size[who] > p + length
            who, state, at, base_score, index = who[more], state[more], at[more], base_score[more], index[more]
        lost = np.flatnonzero(~single)
        if len(lost):
            width = np.minimum(char[lost], size[seg[lost]] - p)
            target = cell[seg[lost]] + p + width
            score = here[lost] + v.unknown_score
            better = score > best[target]
            best[target[better]], step[target[better]], piece[target[better]] = score[better], width[better], NONE
    # walk back from the ends, all segments at once, writing ids from the back; unknown characters become bytes
    taken, ids_rev, owner_rev = cell[1:] - 1, [], []
    active = np.flatnonzero(taken > cell[:-1])
    pos = taken.copy()
    while len(active):
        c = pos[active]
        ident, width = piece[c], step[c]
        if not width.all():
            raise ValueError("a position that no path reaches: the text isn't UTF-8")
        known = ident >= 0
        ids_rev.append(ident[known])
        owner_rev.append(active[known])
        for back in range(1, 5):
            spell = active[~known & (width >= back)]
            ids_rev.append(v.byte_ids[data[s[spell] + (pos[spell] - cell[spell]) - back]])
            owner_rev.append(spell)
        pos[active] = c - width
        active = active[pos[active] > cell[active]]
    ids = np.concatenate(ids_rev)[::-1] if ids_rev else np.zeros(0, np.int32)
    owner = np.concatenate(owner_rev)[::-1] if owner_rev else np.zeros(0, np.int64)
    ids = ids[np.argsort(owner, kind="stable")]
    counts = np.bincount(owner, minlength=n)
    # from length order back to the given order
    place = np.concatenate([[0], np.cumsum(counts)])[:-1]
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return ids[ranges(place[back], counts[back])], counts[back]


def distinct_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one range of each distinct byte string, and which of these every range equals: found by hashes, decided on the bytes."""
    _, one, which = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes, twin = ends - starts, one[which]
    alike = (sizes == sizes[twin]).all() and np.array_equal(data[ranges(starts, sizes)], data[ranges(starts[twin], sizes)])
    if not alike:  # two strings share a hash
        names: dict[bytes, int] = {}
        which = np.array([names.setdefault(data[a:b].tobytes(), len(names)) for a, b in zip(starts, ends)], np.int64)
        _, one = np.unique(which, return_index=True)
    return one, which


def encode_chunk(v: Vocabulary, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts of the chunk in order, and how many each has."""
    n = len(chunk)
    sizes = np.diff(chunk.offsets)
    filled = sizes > 0
    data = np.insert(chunk.data, chunk.offsets[:-1][filled], 32)
    off = np.concatenate([[0], np.cumsum(sizes + filled)])
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    space, alone = data == 32, v.alone[data]
    begin = alone.copy()
    begin[1:] |= alone[:-1] | (space[1:] & ~space[:-1])
    begin[off[:-1][filled]] = True
    starts = np.flatnonzero(begin)
    ends = np.concatenate([starts[1:], [len(data)]])
    one, which = distinct_ranges(data, starts, ends)
    ids, counts = viterbi(v, data, starts[one], ends[one])
    place = np.concatenate([[0], np.cumsum(counts)])[:-1]
    per_segment = counts[which]
    flat = ids[ranges(place[which], per_segment)]
    upto = np.concatenate([[0], np.cumsum(per_segment)])
    return flat, np.diff(upto[np.searchsorted(starts, off)])


def decode_flat(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all decoded texts, and the n + 1 offsets."""
    ids = np.where((ids >= 0) & (ids < len(v.scores)), ids, -1)
    width = np.where(ids >= 0, v.piece_at[ids + 1] - v.piece_at[ids], 0)
    data = v.piece_bytes[ranges(v.piece_at[ids], width)]
    upto = np.concatenate([[0], np.cumsum(width)])
    off = upto[np.concatenate([[0], np.cumsum(counts)])]
    filled = off[1:] > off[:-1]
    first = off[:-1][filled]
    drop = first[data[first] == 32]
    keep = np.ones(len(data), bool)
    keep[drop] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], kept[off]


def _carry(df: DataFrame, keep: dict[str, str], last: str) -> tuple[DataFrame, str]:
    picked = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(last).alias("_in"))
    kinds = dict(picked.dtypes)
    return picked, "".join(f"k{i} {kinds[f'k{i}']}, " for i in range(len(keep)))


def _named(df: DataFrame, keep: dict[str, str], out: str) -> DataFrame:
    return df.select(*[F.col(f"k{i}").alias(name) for i, name in enumerate(keep.values())], out)


def encode(docs: DataFrame, v: Vocabulary, keep: dict[str, str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (column: its name in the result) and ``ids`` array<int>."""
    picked, fields = _carry(docs, keep, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for c in chunks(texts):
                flat, counts = encode_chunk(v, c)
                off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                null = texts.slice(c.lo, len(c)).is_null()
                ids = pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32()), mask=null if null.true_count else None)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(c.lo, len(c)) for i in range(b.num_columns - 1)), ids], [*b.schema.names[:-1], "ids"])

    return _named(map_arrow(picked, run, fields + "ids array<int>"), keep, "ids")


def decode(tokens: DataFrame, v: Vocabulary, keep: dict[str, str], ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``decoded``, the text of the ids; bytes that aren't UTF-8 become U+FFFD."""
    picked, fields = _carry(tokens, keep, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.num_columns - 1)
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            data, off = decode_flat(v, flat, counts)
            raw = data.tobytes()
            none = ids.is_null().to_pylist()
            texts = [None if x else raw[off[i] : off[i + 1]].decode("utf-8", "replace") for i, x in enumerate(none)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(texts, pa.string())], [*b.schema.names[:-1], "decoded"])

    return _named(map_arrow(picked, run, fields + "decoded string"), keep, "decoded")
