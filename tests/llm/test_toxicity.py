"""Operator 4: the automaton against edit distances, contexts, and held-out accuracy."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from feira.llm import toxicity
from feira.llm.queries import op4_toxicity

SF = "/root/testdata/sf0.1"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance(rng):
    terms = ["scum", "idiot", "moron", "moros", "abcde", "abcdef", "étéété"]
    trie = toxicity.FuzzyTrie(terms)
    words = {"".join(rng.choice("abcdeé") for _ in range(rng.randrange(3, 8))) for _ in range(400)}
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice("abcdios")]])
            words.add("".join(w))
    for w in words:
        near = sorted((distance(w, t), i) for i, t in enumerate(terms) if distance(w, t) <= (1 if len(t) >= toxicity.FUZZY_FROM else 0))
        assert trie.match(w) == ((near[0][1], near[0][0]) if near else None), w


def test_stems_match_all_their_forms():
    trie = toxicity.FuzzyTrie(["lowe", "idiot", "lowers"], [True, False, False])
    got = {w: trie.match(w) for w in ("lowe", "loweiei", "low", "lewe", "idiot", "idiots", "lowers", "xlowe", "")}
    assert got == {"lowe": (0, 0), "loweiei": (0, 0), "low": None, "lewe": None, "idiot": (1, 0), "idiots": (1, 1), "lowers": (0, 0), "xlowe": None, "": None}


def test_context_separates_quotation():
    scan = toxicity.Scanner(toxicity.Lexicon(["idiot", "moron"], [3.0, 3.0]))
    exact, fuzzy, quoted = (scan.features(t)[:3] for t in ("you idiot !", "you idlot !", 'they wrote "you idiot" there'))
    assert exact[0] > 0 and exact[1] == exact[2] == 0
    assert fuzzy[1] > 0 and fuzzy[0] == fuzzy[2] == 0
    assert quoted[2] > 0 and quoted[0] == quoted[1] == 0
    assert scan.features(None)[:3] == scan.features("")[:3] == [0, 0, 0]


def test_memory_limit_changes_nothing(monkeypatch, rng):
    lexicon = toxicity.Lexicon(["idiot"], [2.0])
    texts = ["".join(p) + " idiott x" for p in itertools.product("abc", repeat=3)]
    want = [toxicity.Scanner(lexicon).features(t) for t in texts]
    monkeypatch.setattr(toxicity, "SEEN_WORDS", 4)
    scan = toxicity.Scanner(lexicon)
    assert [scan.features(t) for t in texts] == want


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op4_toxicity(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = got.join(labels, "doc_id").where("held_out")
    n, right, toxic, caught, clean, wrong = held.agg(
        F.count("*"), F.count_if(F.col("toxic") == F.col("predicted")), F.sum("toxic"), F.count_if(F.expr("toxic = 1 AND predicted = 1")),
        F.count_if(F.expr("toxic = 0")), F.count_if(F.expr("toxic = 0 AND predicted = 1"))).first()
    assert right >= 0.95 * n and caught >= 0.8 * toxic and wrong <= 0.02 * clean


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_nothing_to_learn(spark, labels):
    docs = spark.createDataFrame([(1, "a b", 0.5), (2, None, 0.5), (None, "", 0.5)], "doc_id long, text string, score double")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, table, train_on=F.lit(True))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 3 and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in rows)
    assert toxicity.score(docs.where("doc_id = 9"), model).count() == 0
