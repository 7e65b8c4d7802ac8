"""Quality rules with compression bands (operator 6).

``quality_bands`` returns one row per document with five word statistics, the
base rules' verdict, and a verdict from zstandard compression: the ratio
compressed / raw bytes of the whole document, and of each fixed chunk of
it, must lie inside a band that depends on the length (short inputs compress
badly, so their band lies higher and is wider). A ratio below the band means
repetitive text, one above it incompressible text (random letters, encoded
binary data). A document fails if its whole ratio leaves the band of its
length, or if more than ``MAX_BAD_CHUNKS`` of its chunks leave theirs.

Defined cases: a null text counts as empty: no words, ratio 1.0, base_failed.
Empty tables give empty results, repeated rows give repeated rows, and
columns other than the two named are not read. Work and memory per task
follow the batch (16 MB at most, or one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm.textops import SPACE, Chunk, chunks, map_arrow, mix, shingles, word_hashes

LEVEL = 3
CHUNK = 4096
MAX_BAD_CHUNKS = 0.2
SHORT_TAIL = 128  # a last chunk up to this size is mostly frame header and isn't judged
WINDOW = 5
# (bytes of text up to, least ratio, greatest ratio): a text of n bytes has the first row's band with n <= bytes.
# From the ratios of sf0.1's texts that pass the base rules, by length: the greatest is the 99.9th percentile and
# 0.04, rounded up; the least is half the 0.1st percentile, rounded down (0.15 up to 256 bytes, where few texts
# spread widely; 0.25 to 512). The last row takes the limits of the row before, as one text there is no spread.
BANDS = (
    (128, 0.15, 1.25),
    (256, 0.15, 0.97),
    (512, 0.25, 0.79),
    (1024, 0.23, 0.73),
    (2048, 0.21, 0.62),
    (4096, 0.20, 0.56),
    (8192, 0.19, 0.52),
    (16384, 0.18, 0.50),
    (65536, 0.17, 0.47),
    (float("inf"), 0.17, 0.47),
)

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


def band(size: int) -> tuple[float, float]:
    return next((lo, hi) for limit, lo, hi in BANDS if size <= limit)


def _between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Count of set flags inside each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeat_words(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Per text: words that lie in a k-word window occurring at least twice in that text."""
    n = len(first) - 1
    keys, begin = shingles(hashes, first, k)
    counts = np.diff(first)
    texts = np.repeat(np.arange(n), np.diff(begin))
    keys = keys ^ mix(texts.astype(np.uint64) + np.uint64(1))  # the same window in two texts differs
    full = counts[texts] >= k
    at = (np.arange(len(keys)) - begin[:-1][texts] + first[:-1][texts])[full]  # first word of each window
    keys = keys[full]
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.subtract.at(cover, at[twice] + k, 1)
    return _between(np.cumsum(cover[:-1]) > 0, first)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _compression(text: bytes, press: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Whole ratio, chunks, chunks outside their band, and whether the bands hold."""
    if not text:
        return 1.0, 0, 0, False
    ratio = len(press.compress(text)) / len(text)
    lo, hi = band(len(text))
    parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)] if len(text) > CHUNK else []
    bad = 0
    for part in parts:
        low, high = band(len(part))
        bad += len(part) > SHORT_TAIL and not low <= len(press.compress(part)) / len(part) <= high
    return ratio, len(parts), bad, lo <= ratio <= hi and bad <= MAX_BAD_CHUNKS * len(parts)


def _measure(chunk: Chunk, press: zstandard.ZstdCompressor) -> dict[str, object]:
    hashes, first = word_hashes(chunk, lower=False)
    n_words = np.diff(first)
    lead = (chunk.data & 0xC0) != 0x80
    texts = [chunk.text(i) for i in range(len(chunk))]
    repeats = repeat_words(hashes, first, WINDOW)
    base = (n_words < 10) | (100 * repeats > 20 * n_words)
    ratio, n_chunks, bad, holds = zip(*[_compression(t, press) for t in texts])
    return {
        "n_words": n_words,
        "word_chars": _between(lead & ~SPACE[chunk.data], chunk.offsets),
        "n_symbols": _between(SYMBOL[chunk.data], chunk.offsets),
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeats,
        "base_failed": base,
        "kept": ~base & np.array(holds, bool),
        "ratio": np.array(ratio, float),
        "n_chunks": np.array(n_chunks, np.int64),
        "n_bad_chunks": np.array(bad, np.int64),
    }


def quality_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base statistics, base_failed, and kept by the compression bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            ids = b.column(0)
            for c in chunks(b.column(1)):
                got = _measure(c, press)
                arrays = [ids.slice(c.lo, len(c)), *(pa.array(v) for v in got.values())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *got])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(picked, run, SCHEMA)
