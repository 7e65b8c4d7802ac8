"""Operator 10 against SentencePiece itself (on a unigram model made from the public pieces) and a brute-force search."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from feira.llm import unigram
from feira.llm.queries import PIECE_MODEL, TOKENIZER_DIR
from feira.llm.textops import U64, chunks  # noqa: F401

KINDS = {1: "normal", 2: "unknown", 3: "control", 4: "normal", 5: "control", 6: "byte"}
TEXTS = ["", "a", " a", "  ", "Hello  world\nfoo 日本語 😀 x\t\ty ", "é" * 40, "x" * 300, "the quick brown fox", None, "under▁score", "\n\n a\r\n"]


def encoded(v, texts):
    out = []
    for c in chunks(pa.array(texts, pa.string())):
        flat, counts = unigram.encode_chunk(v, c)
        out += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    return out


def brute(pieces, text):
    """Best score by trying every piece at every place."""
    table = {p.replace("▁", " "): s for p, s, k in pieces if k == "normal"}
    unknown = min(table.values()) - unigram.UNKNOWN_PENALTY
    text = " " + text if text else ""
    best = [0.0] + [-math.inf] * len(text)
    for i in range(len(text)):
        single = text[i] in table
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in table:
                best[j] = max(best[j], best[i] + table[text[i:j]])
        if not single:
            best[i + 1] = max(best[i + 1], best[i] + unknown)
    return best[-1]


def small(rng):
    letters = "ab é"
    words = {"".join(rng.choice(letters.strip()) for _ in range(rng.randrange(1, 5))) for _ in range(30)} | {"▁a", "▁b", "▁ab", "▁", "▁▁", "b"}
    words = {w.replace(" ", "") for w in words}
    pieces = [("<unk>", 0.0, "unknown"), ("<s>", 0.0, "control")] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    return pieces + [(w, -rng.uniform(1, 9), "normal") for w in sorted(words - {"a"})]


def test_best_score_of_random_texts():
    rng = random.Random(3)
    for _ in range(8):
        pieces = small(rng)
        v = unigram.vocabulary(pieces)
        texts = ["".join(rng.choice("aab é  \n😀") for _ in range(rng.randrange(0, 25))) for _ in range(60)]
        for text, ids in zip(texts, encoded(v, texts)):
            score, spelled = 0.0, b""
            unknown = v.unknown_score
            for i in ids:
                if v.is_byte[i]:
                    spelled += bytes([i - 2])
                else:
                    score += v.scores[i]
            assert score + unknown * len(spelled.decode()) == pytest.approx(brute(pieces, text))


def test_agrees_with_sentencepiece():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(os.path.join(TOKENIZER_DIR, PIECE_MODEL), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for i, p in enumerate(m.pieces):
        if p.type == 1:
            p.score = -float(int(64 * math.log(2 + i)))  # whole numbers: exact in single precision as well
    theirs = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    ours = unigram.vocabulary([(p.piece, p.score, KINDS[p.type]) for p in m.pieces])
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    texts = [t for t in texts if t] + [t for t in TEXTS if t is not None and "▁" not in t]
    assert encoded(ours, texts) == theirs.encode(texts)


@pytest.fixture(scope="module")
def public():
    return unigram.load_vocabulary(os.path.join(TOKENIZER_DIR, PIECE_MODEL))


def test_round_trip(spark, public):
    rows = [(i, t, [1]) for i, t in enumerate(TEXTS)] + [(0, "", [1]), (None, "twice", [1]), (None, "twice", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>").repartition(2)
    tokens = unigram.encode(df, public, {"doc_id": "doc_id", "text": "text"})
    got = unigram.decode(tokens, public, {"doc_id": "doc_id", "text": "text", "ids": "ids"}).collect()
    assert len(got) == len(rows) and all(r.decoded == r.text for r in got)
    assert all(r.ids is None for r in got if r.text is None) and all(r.ids == [] for r in got if r.text == "")


def test_odd_ids_decode_to_nothing(spark, public):
    df = spark.createDataFrame([(1, [-5, 10**6, 1, 2]), (2, [None, 3 + ord("A")]), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in unigram.decode(df, public, {"doc_id": "doc_id"}).collect()}
    assert got == {1: "", 2: "A", 3: None}


def test_empty_table(spark, public):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert unigram.encode(df, public, {"doc_id": "doc_id"}).count() == 0


def test_pieces_across_spaces_are_refused():
    with pytest.raises(ValueError):
        unigram.vocabulary([("<unk>", 0.0, "unknown"), ("a▁b", -1.0, "normal")])


def test_strings_that_meet_in_hashes_stay_apart(monkeypatch):
    """Distinct segments are decided on their bytes, also where hashes meet."""
    import numpy as np

    from feira.llm import unigram

    data = np.frombuffer(b"abcabdabcxyab", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 11]), np.array([3, 6, 9, 11, 13])
    for hashes in (unigram.range_hashes, lambda d, s, e: np.zeros(len(s), np.uint64)):
        monkeypatch.setattr(unigram, "range_hashes", hashes)
        one, which = unigram.distinct_ranges(data, starts, ends)
        assert [data[starts[one[w]] : ends[one[w]]].tobytes() for w in which] == [b"abc", b"abd", b"abc", b"xy", b"ab"] and len(one) == 4
