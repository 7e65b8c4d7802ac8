"""Embedding whitening by polarisation covariance (operator 12).

Every entry c becomes the integer x = floor(scale * c) + a constant. With n vectors and sums S per dimension, all
variances and cross-covariances follow from sums of squares of centred integers alone: var(i), var(j) and
var(i + j) give cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. So one aggregation takes the exact
squares of every dimension and of every sum of two dimensions. Values are centred at the whole part
of the mean before they are squared; what the fraction of the mean takes away, the integer n * R * R' of its remainders, is
subtracted exactly. Sums are integers of any size throughout (decimals of 38 digits between tasks, Python's on the driver),
so the covariance matrix is exact until it is divided once into doubles for ``eigh``.

What travels. A task adds its squares up first and gives d * (d + 1) / 2 rows, which are summed by pair: no
task merges more than the partial sums of its pairs, and the driver gets one row per pair of dimensions, whose number doesn't depend
on the rows. The transform (d * components numbers) goes to the tasks with the function.

Defined cases: vectors that are null, empty or hold null or non-finite entries are dropped; vectors of another length than
the commonest (ties: the longest) are too; entries beyond 2^52 / scale count as that bound. A null id keeps its
row; repeated rows count each time; ties between eigenvalues leave the order that ``eigh`` gives.
Components whose eigenvalue isn't above rounding (equal vectors, a constant dimension, fewer rows than dimensions) can't
be whitened and have no rows. ``deviation`` is null if it doesn't fit into a long. Other columns are not
read. No vectors left: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm.textops import map_arrow, stored

SCALE = 64  # x = floor(64 * c) + 1,000,000; the constant shift leaves all results as they are
COMPONENTS = 32
BOUND = float(1 << 52)
SAFE = float(1 << 62)


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: its size, the whole and the remaining part of the mean (S = n * whole + rest), and the transform."""

    n: int
    whole: list[int]
    rest: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: the vectors without null or non-finite entries, of the commonest length, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(v.isNotNull() & (F.size(v) > 0) & ~bad)
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), F.desc("d")).first()
    return rows.where(F.size("v") == (most.d if most else 0))


def matrix(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * c) of a batch, as 64-bit integers."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(flat.reshape(len(lists), -1) * scale), -BOUND, BOUND).astype(np.int64)


def exact(x: np.ndarray, bound: float) -> np.ndarray:
    """The integers as they are where results stay below ``bound`` of a long, else as Python's integers."""
    return x if bound < SAFE else x.astype(object)


def sums(rows: DataFrame, scale: float) -> tuple[int, list[int]]:
    """n and the sum of floor(scale * c) per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                y = matrix(b.column(0), scale)
                part = exact(y, float(np.abs(y.astype(np.float64)).max()) * len(y)).sum(axis=0)
                total = [int(x) + (total[i] if total else 0) for i, x in enumerate(part)]
                n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int64()), pa.array([str(n), *map(str, total)])], ["i", "s"])

    found = map_arrow(rows.select("v"), run, "i long, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r.i: int(r.s) for r in found}
    return by.get(-1, 0), [by[i] for i in range(len(by) - 1)] if by else []


def squares(rows: DataFrame, whole: list[int], scale: float) -> dict[tuple[int, int], int]:
    """The sums of z_i squared, at (i, i), and of (z_i + z_j) squared, at (i, j): z is floor(scale * c) less the whole part of its mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(whole)
        upper = [np.arange(i + 1, d) for i in range(d)]
        total: dict[int, list[int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            y = matrix(b.column(0), scale)
            far = float(np.abs(y.astype(np.float64)).max()) + max(abs(w) for w in whole)
            z = exact(y, 4 * far * far * len(y)) - np.array(whole, dtype=np.int64 if 4 * far * far * len(y) < SAFE else object)
            for i in range(d):
                both = z[:, i : i + 1] + z[:, upper[i]]
                part = [int((z[:, i] * z[:, i]).sum()), *((int(x) for x in (both * both).sum(axis=0)) if len(upper[i]) else ())]
                total[i] = [x + y for x, y in zip(total[i], part)] if i in total else part
        if total:
            i = np.repeat(np.arange(d), np.arange(d, 0, -1))
            j = np.concatenate([np.arange(k, d) for k in range(d)])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([str(x) for k in range(d) for x in total[k]])], ["i", "j", "q"])

    found = map_arrow(rows.select("v"), run, "i long, j long, q string").groupBy("i", "j").agg(F.sum(F.col("q").cast("decimal(38,0)")).alias("q")).collect()
    return {(r.i, r.j): int(r.q) for r in found}


def covariance(n: int, rest: list[int], q: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariances (divisor n) by polarisation, each divided once: centring at the mean takes R_i * R_j / n off a sum of products."""
    d = len(rest)
    centred = {(i, j): n * q[i, j] - (rest[i] if i == j else rest[i] + rest[j]) ** 2 for i in range(d) for j in range(i, d)}  # n times the squares' sum
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = centred[i, i] / (n * n)
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (centred[i, j] - centred[i, i] - centred[j, j]) / (2 * n * n)
    return out


def fit(rows: DataFrame, scale: float = SCALE, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all the given vectors; None if there are none."""
    n, total = sums(rows, scale)
    if not n:
        return None
    whole = [s // n for s in total]
    rest = [s - n * w for s, w in zip(total, whole)]
    v = covariance(n, rest, squares(rows, whole, scale))
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    able = int((values > max(values[0], 0.0) * len(values) * np.finfo(float).eps * 16).sum())
    k = min(components, able)
    return Whitening(n, whole, rest, values[:k].copy(), vectors[:, :k].copy(), float(np.trace(v)))


def project(batch: pa.RecordBatch, w: Whitening, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(floor(scale * c) less the whole part of the mean, the whitened vectors) of a batch with the vectors in column 1."""
    y = matrix(batch.column(1), scale)
    far = float(np.abs(y.astype(np.float64)).max(initial=0.0)) + max(map(abs, w.whole))
    z = exact(y, 2 * far) - np.array(w.whole, dtype=np.int64 if 2 * far < SAFE else object)
    return z, (z.astype(np.float64) - np.array([r / w.n for r in w.rest])) @ w.projection


def identity_error(rows: DataFrame, w: Whitening, scale: float = SCALE) -> float:
    """The largest absolute entry of the whitened vectors' own covariance minus the identity, measured over all rows."""
    k = len(w.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                _, p = project(b, w, scale)  # centred already: the mean is zero but for rounding
                total += p.sum(axis=0)
                products += p.T @ p
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.vstack([products, total]).ravel())], ["i", "j", "s"])

    found = map_arrow(rows.select("vec_id", "v"), run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    s = np.zeros((k + 1, k))
    for r in found:
        s[r.i, r.j] = r.s
    mean = s[k] / w.n
    return float(np.abs(s[:k] / w.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, components: int = COMPONENTS,
) -> DataFrame:
    """vec_id, component (from 1), n, deviation (sum over dimensions of (n * x - S)^2), whitened, explained, identity_error: a row per vector and component.

    A constant added to every x moves the mean alike and changes no result, so none is added.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = stored(usable(embeddings, id_col, vector_col))
    w = fit(rows, scale, components)
    if w is None or not len(w.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, w, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        rest = np.array(w.rest, object)
        share = w.values / w.trace
        for b in batches:
            if not b.num_rows:
                continue
            z, p = project(b, w, scale)
            far = (float(np.abs(z.astype(np.float64)).max()) + 1) * w.n
            part = z * w.n - rest.astype(np.int64) if far * far * z.shape[1] < SAFE else z.astype(object) * w.n - rest
            deviation = [int(x) if x < 1 << 63 else None for x in (part * part).sum(axis=1)]
            m = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                 pa.array(np.full(m * k, w.n), pa.int64()), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(p.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows.select("vec_id", "v"), run, schema)
