"""Language identification by nearest centroid (operator 7).

A text becomes a TF-IDF vector of hashed byte 2- and 3-grams (ASCII letters
lowered, every other ASCII byte read as one space, so digits and punctuation
carry nothing), normalised to length one. Training takes a bounded sample of
labelled rows (``per_language`` rows of each language, chosen by hash), forms
``CLUSTERS`` centroids per language by spherical k-means, and measures how
far the sample's texts lie from their nearest centroid. A text gets the
language of the centroid with the highest cosine; it is rejected if that
cosine is below ``min_cosine`` - a fraction of a low quantile of the sample's
own cosines for its length class, so that short clean texts aren't rejected for being short.

Defined cases: a null text, or one without any Unicode letter, has the
language ``und``, score 0 and is rejected. An empty training set makes every
text ``und``. Ties go to the language first in code-point order. Rows without
a language aren't trained on. Empty tables give empty results; repeated rows
give repeated rows; no columns but those named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm.textops import LOWER, Chunk, chunks, map_arrow, mix

DIM = 2048
CLUSTERS = 3
ROUNDS = 12
PER_LANGUAGE = 600
REJECT_QUANTILE = 0.005
REJECT_FRACTION = 0.6
LENGTH_CLASSES = (64, 256, 1024)  # bytes
UND = "und"
SCHEMA = "lang_pred string, score double, cosine double, rejected boolean"

_letter = regex.compile(r"\p{L}")
_FOLD = LOWER.copy()
_FOLD[:128] = [c if 97 <= c <= 122 else 32 for c in LOWER[:128].tolist()]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (languages * clusters, DIM), rows of length one
    owner: np.ndarray  # language index of each centroid
    min_cosine: np.ndarray  # by length class


def length_class(n_bytes: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTH_CLASSES, n_bytes, side="right")


def counts(chunk: Chunk) -> np.ndarray:
    """Hashed gram counts, one row of DIM per text; grams don't cross texts."""
    n = len(chunk)
    data = _FOLD[chunk.data].astype(np.uint64)
    if len(data) < 2:
        return np.zeros((n, DIM), np.float32)
    texts = np.repeat(np.arange(n), np.diff(chunk.offsets))
    out = np.zeros(n * DIM, np.float32)
    for order in (2, 3):
        if len(data) < order:
            break
        m = len(data) - order + 1
        gram = data[:m].copy()
        for j in range(1, order):
            gram = gram << np.uint64(8) | data[j : m + j]
        inside = texts[:m] == texts[order - 1 :]
        blank = gram == (0x2020 if order == 2 else 0x202020)
        keep = inside & ~blank
        slot = (mix(gram[keep] | np.uint64(order << 32)) % np.uint64(DIM)).astype(np.int64)
        out += np.bincount(texts[:m][keep] * DIM + slot, minlength=n * DIM).astype(np.float32)
    return out.reshape(n, DIM)


def vectors(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(raw) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def _centroids(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means with farthest-first seeds, from the sample in its given order."""
    seeds = [int(np.argmax(v @ v.sum(axis=0)))]
    near = v @ v[seeds[0]]
    while len(seeds) < min(k, len(v)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[seeds[-1]])
    c = v[seeds]
    for _ in range(ROUNDS):
        label = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[label == j].sum(axis=0) if (label == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def train(
    docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> Model:
    """Fit on about ``per_language`` rows of each language among the rows where ``train_on`` holds.

    The rows are chosen by a hash of id and text; only their gram counts (DIM
    bytes or so each) come to the driver, so the sample's size bounds what it holds.
    """
    rows = docs.where(train_on & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(4))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    chosen = rows.where((F.pmod("h", F.lit(1_000_003)) / 1_000_003.0) < share[F.col("lang")])
    chosen = chosen.dropDuplicates(["lang", "h"])  # a repeated row would come whole

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1), max_rows=256):
                raw = np.minimum(counts(c), 65535).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.lo, len(c)), pa.array(np.diff(c.offsets)),
                     pa.array([r.tobytes() for r in raw], pa.binary()), b.column(2).slice(c.lo, len(c))],
                    ["lang", "size", "grams", "h"],
                )

    sample = map_arrow(chosen, gather, "lang string, size long, grams binary, h long").toArrow()
    sample = sample.sort_by([("lang", "ascending"), ("h", "ascending")])
    langs = np.array(sample["lang"].to_pylist(), object)
    raw = np.stack([np.frombuffer(x, "<u2") for x in sample["grams"].to_pylist()] or [np.zeros(DIM, "<u2")]).astype(np.float32)
    raw = raw[: len(langs)]
    idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))) + 1).astype(np.float32)
    v = vectors(raw, idf)
    names = sorted(set(langs))
    parts = [_centroids(v[langs == x], CLUSTERS) for x in names]
    centroids = np.concatenate(parts) if parts else np.zeros((0, DIM), np.float32)
    owner = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    best = (v @ centroids.T).max(axis=1) if len(v) else np.zeros(0)
    classes = length_class(sample["size"].to_numpy())
    low = [np.quantile(best[classes == j], REJECT_QUANTILE) if (classes == j).sum() >= 20 else 0.0
           for j in range(len(LENGTH_CLASSES) + 1)]
    return Model(names, idf, centroids.astype(np.float32), owner, REJECT_FRACTION * np.array(low))


def predict(model: Model, chunk: Chunk, texts: list[str | None]) -> dict[str, list]:
    """Language, score (cosine rescaled against the runner-up language), cosine and rejection of each text."""
    n, k = len(chunk), len(model.languages)
    cos = vectors(counts(chunk), model.idf) @ model.centroids.T
    by_lang = np.full((n, max(k, 1)), -1.0)
    for j in range(k):
        by_lang[:, j] = cos[:, model.owner == j].max(axis=1)
    pick = by_lang.argmax(axis=1)
    best = by_lang[np.arange(n), pick]
    rest = np.sort(np.clip(by_lang, 0, 1), axis=1)[:, -2] if k > 1 else np.zeros(n)
    score = np.clip(best / np.maximum(best + rest, 1e-9), 0, 1)
    limit = model.min_cosine[length_class(np.diff(chunk.offsets))]
    out: dict[str, list] = {"lang_pred": [], "score": [], "cosine": [], "rejected": []}
    for i, t in enumerate(texts):
        known = bool(k) and t is not None and _letter.search(t) is not None
        out["lang_pred"].append(model.languages[pick[i]] if known else UND)
        out["score"].append(float(score[i]) if known else 0.0)
        out["cosine"].append(float(max(best[i], 0.0)) if known else 0.0)
        out["rejected"].append(not known or bool(best[i] < limit[i]))
    return out


def identify(docs: DataFrame, model: Model, keep: dict[str, str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (column: its name in the result) of every document, with lang_pred, score, cosine, rejected."""
    picked = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.num_columns - 1)
            for c in chunks(column, max_rows=512):
                got = predict(model, c, column.slice(c.lo, len(c)).to_pylist())
                arrays = [b.column(i).slice(c.lo, len(c)) for i in range(b.num_columns - 1)]
                arrays += [pa.array(got["lang_pred"], pa.string()), pa.array(got["score"], pa.float64()),
                           pa.array(got["cosine"], pa.float64()), pa.array(got["rejected"], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names[:-1], *got])

    kinds = dict(picked.dtypes)
    schema = ", ".join([*(f"k{i} {kinds[f'k{i}']}" for i in range(len(keep))), SCHEMA])
    found = map_arrow(picked, run, schema)
    return found.select(*[F.col(f"k{i}").alias(name) for i, name in enumerate(keep.values())],
                        "lang_pred", "score", "cosine", "rejected")
