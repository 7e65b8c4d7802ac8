"""Toxicity scores from misspelling-tolerant lexicon matches in context (operator 4).

``learn`` takes a bounded sample of labelled rows (``SAMPLE`` of them, chosen by a
hash of the id). From one half it learns the lexicon: words, and stems of ``STEMS`` letters that stand for
all their inflected forms, much commoner in toxic documents (``MAX_TERMS`` at most, each with its log odds).
A trie of these terms,
intersected with a Levenshtein automaton (one edit for terms of ``FUZZY_FROM``
letters or more, none below and none in stems), finds terms and their misspellings; the product is made
deterministic state by state as words need it, so most words die within a few steps.
Every occurrence has a context window of ``CONTEXT`` words to each side on its line: inside quotation marks, or near a
word of reporting, it counts as quotation, else as abuse. On the other half of the
sample a logistic model learns from six features of a document: exact and
misspelled abuse, quotation, their density, the distinct terms, and length.

Defined cases: a null or empty text has no matches and the model's score for
none; without labelled rows every score is 0. Repeated rows give repeated rows;
labels of a repeated or unknown id count once for each joined row; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm.textops import map_arrow, stored

SAMPLE = 20_000
MAX_TERMS = 1200
MIN_DOCS = 4  # toxic documents of the half that a term must be in, or
MIN_SHARE = 0.01  # this share of them, if that is more
STEMS = (4, 5)
MIN_LOG_ODDS = 1.5
FUZZY_FROM = 5
CONTEXT = 6
SEEN_WORDS = 300_000  # words whose outcome a task remembers
EDGES = ".,;:!?\"'()[]{}«»“”„‚‘’*_-–—…<>|"
QUOTES = "\"“”„«»"
# words that report what someone else said
REPORTING = frozenset(
    "said says say wrote writes called quoted quote quotes term word words phrase dit écrit mot appelé cité sagte schrieb wort "
    "zitat genannt dijo escribió palabra llamó cita".split()
)
N_FEATURES = 6
_token = regex.compile(r"\S+")


@dataclass
class Lexicon:
    terms: list[str]
    weights: list[float]
    stems: list[bool] | None = None  # which terms are stems; None: none


class FuzzyTrie:
    """The trie of the terms intersected with the automata of their allowed edits.

    A state is a set of (trie node, edits so far), where a passed stem stays as the node -1 - term; states get
    numbers and their transitions are kept, so a word costs one dictionary lookup a letter.
    """

    DEAD = 0

    def __init__(self, terms: list[str], stems: list[bool] | None = None):
        stems = stems or [False] * len(terms)
        self.stem: dict[int, int] = {}  # the stem that ends at a node
        self.child: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]
        self.allowed: list[int] = [0]  # most edits of any term below this node
        self.limit = [1 if len(t) >= FUZZY_FROM and not stem else 0 for t, stem in zip(terms, stems)]
        for i, t in enumerate(terms):
            node = 0
            for c in t:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.end.append(-1)
                    self.allowed.append(0)
                node = self.child[node][c]
            if stems[i]:
                self.stem[node] = i
            else:
                self.end[node] = i
        for i, t in enumerate(terms):
            node = 0
            for c in ["", *t]:
                node = self.child[node][c] if c else 0
                self.allowed[node] = max(self.allowed[node], self.limit[i])
        self.states: list[frozenset] = [frozenset()]
        self.number: dict[frozenset, int] = {frozenset(): self.DEAD}
        self.moves: dict[tuple[int, str], int] = {}
        self.accept: list[tuple[int, int] | None] = [None]
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        todo = list(pairs)
        while todo:  # a letter of the term left out
            node, e = todo.pop()
            if node < 0:
                continue
            if e == 0 and node in self.stem:
                pairs.add((-1 - self.stem[node], 0))
            for nxt in self.child[node].values():
                if e < self.allowed[nxt] and (nxt, e + 1) not in pairs:
                    pairs.add((nxt, e + 1))
                    todo.append((nxt, e + 1))
        key = frozenset((n, e) for n, e in pairs if e == 0 or (n, 0) not in pairs)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            found = [(e, self.end[n]) for n, e in key if n >= 0 and self.end[n] >= 0 and e <= self.limit[self.end[n]]]
            found += [(0, -1 - n) for n, _ in key if n < 0]
            self.accept.append((min(found)[1], min(found)[0]) if found else None)
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        pairs = set()
        for node, e in self.states[state]:
            if node < 0:
                pairs.add((node, 0))
                continue
            for letter, nxt in self.child[node].items():
                if letter == c:
                    pairs.add((nxt, e))
                elif e < self.allowed[nxt]:
                    pairs.add((nxt, e + 1))
            if e < self.allowed[node]:
                pairs.add((node, e + 1))  # a letter too many
        got = self._state(pairs) if pairs else self.DEAD
        self.moves[state, c] = got
        return got

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term within its allowed edits, ties to the earlier term; or None."""
        state, moves = self.start, self.moves
        for c in word:
            nxt = moves.get((state, c))
            if nxt is None:
                nxt = self._move(state, c)
            if nxt == self.DEAD:
                return None
            state = nxt
        return self.accept[state]


class Scanner:
    """Features of texts, remembering the words that match nothing."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.trie = lexicon, FuzzyTrie(lexicon.terms, lexicon.stems)
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def _known(self, words: set[str]) -> set[str]:
        for w in words.difference(self.clean):
            if w not in self.hits:
                got = self.trie.match(w.strip(EDGES))
                if got is None:
                    self.clean.add(w)
                else:
                    self.hits[w] = got
        found = words.intersection(self.hits)
        if len(self.clean) + len(self.hits) > SEEN_WORDS:
            self.clean = set()
            self.hits = {w: self.hits[w] for w in found}
        return found

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        tokens = low.split()
        found = self._known(set(tokens)) if self.lexicon.terms else set()
        exact = fuzzy = quoted = 0.0
        terms, count = set(), 0
        if found:
            for line in low.split("\n"):
                words = [(m.group(), m.start()) for m in _token.finditer(line)]
                for i, (w, at) in enumerate(words):
                    if w not in found:
                        continue
                    term, edits = self.hits[w]
                    weight = self.lexicon.weights[term]
                    count += 1
                    near = {x.strip(EDGES) for x, _ in words[max(0, i - CONTEXT) : i + CONTEXT + 1]}
                    begin = words[max(0, i - CONTEXT)][1]
                    before = sum(line.count(q, begin, at + 1) for q in QUOTES)
                    if before % 2 or near & REPORTING:
                        quoted += weight
                    elif edits:
                        fuzzy += weight
                        terms.add(term)
                    else:
                        exact += weight
                        terms.add(term)
        size = np.log1p(len(tokens))
        strength = sum(self.lexicon.weights[t] for t in terms)
        return [np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), strength / (1 + size), float(min(count, 20)) / 5, size / 5]


@dataclass
class Model:
    lexicon: Lexicon
    coef: np.ndarray  # bias first; empty if nothing was learnt


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(b))
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(
    docs: DataFrame, labels: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE,
) -> Model:
    """Learn from about ``sample`` labelled documents whose id meets ``train_on`` (a condition on the label table)."""
    usable = labels.where(train_on & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    n = usable.count()
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_003))
    ids = usable.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("toxic"), place.alias("place"))
    ids = stored(ids.dropDuplicates(["l_id", "toxic"]).where(F.col("place") < F.lit(1_000_003.0 * min(1.0, sample / max(n, 1)))))
    # the sample's ids are bounded (16 bytes each of about ``sample``): the documents needn't be shuffled to meet them
    rows = docs.select(F.col(id_col).alias("d_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(
        F.broadcast(ids), F.col("d_id") == F.col("l_id")).select("text", "toxic", (F.col("place") % 2 == 0).alias("first"))
    rows = stored(rows.dropDuplicates(["text", "toxic", "first"]))  # repeated rows don't make the sample larger
    letters = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: F.length(w) >= 3)
    begins = [F.transform(F.filter(letters, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS]  # noqa: B023
    words = rows.where("first").dropDuplicates(["text"]).select("toxic", F.explode(F.array_distinct(F.concat(letters, *begins))).alias("word"))
    sums = rows.where("first").dropDuplicates(["text"]).agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_tox, n_all = int(sums[0]), int(sums[1])
    if not n_tox or n_tox == n_all:
        return Model(Lexicon([], []), np.zeros(0))
    counted = words.groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    counted = counted.where(F.col("a") >= max(MIN_DOCS, MIN_SHARE * n_tox))
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    odds = F.log(a / (n_tox + 1)) - F.log(b / (n_all - n_tox + 1)) - F.sqrt(1 / a)
    top = counted.select("word", odds.alias("odds")).where(F.col("odds") >= MIN_LOG_ODDS).orderBy(F.desc("odds"), "word").limit(MAX_TERMS).collect()
    lexicon = Lexicon([r["word"].rstrip("*") for r in top], [float(r["odds"]) for r in top], [r["word"].endswith("*") for r in top])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(lexicon)
        for t in batches:
            x = np.array([scan.features(s) for s in t.column(0).to_pylist()], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([t.column(1), *(pa.array(x[:, j]) for j in range(N_FEATURES))], ["toxic", *(f"f{j}" for j in range(N_FEATURES))])

    schema = "toxic int, " + ", ".join(f"f{j} double" for j in range(N_FEATURES))
    got = map_arrow(rows.where("NOT first").select("text", "toxic"), gather, schema).toArrow()
    y = got["toxic"].to_numpy().astype(float)
    x = np.stack([got[f"f{j}"].to_numpy() for j in range(N_FEATURES)], axis=1)
    order = np.lexsort(x.T)  # the same sum whatever the order in which tasks ended
    return Model(lexicon, _fit(x[order], y[order]) if len(y) else np.zeros(0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted, and the features abuse, misspelled and quoted, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(model.lexicon)
        for b in batches:
            x = np.array([scan.features(t) for t in b.column(1).to_pylist()], float).reshape(-1, N_FEATURES)
            z = model.coef[0] + x @ model.coef[1:] if len(model.coef) else np.full(len(x), -30.0)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *(pa.array(x[:, j]) for j in range(3))],
                ["doc_id", "score", "predicted", "abuse", "misspelled", "quoted"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(picked, run, "doc_id long, score double, predicted int, abuse double, misspelled double, quoted double")
