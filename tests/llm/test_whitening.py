"""Operator 12 against numpy over all rows, and its defined cases."""

from __future__ import annotations

import numpy as np
import pytest

from feira.llm import queries
from feira.llm.whitening import covariance, fit, usable, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n long, v string, component string, i int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "v", "c", 2) for i, v in rows], SCHEMA)


def check(got, rows, components=32):
    x = np.array([np.floor(64.0 * np.array(v, np.float32).astype(float)) for _, v in rows]).astype(np.int64) + 1_000_000
    n, d = x.shape
    s = x.sum(axis=0)
    big = x.astype(object) * n - s.astype(object)
    v = np.array([[int((big[:, i] * big[:, j]).sum()) / n**3 for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, d)
    assert len(got) == n * k
    want = ((x - s / n) @ vectors[:, :k]) / np.sqrt(values[:k])
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    signs = {}
    for at, (i, _) in enumerate(rows):
        assert sorted(by[i]) == list(range(1, k + 1))
        for c, r in by[i].items():
            assert r.n == n and r.deviation == int((big[at] ** 2).sum())
            assert abs(r.explained - values[c - 1] / np.trace(v)) <= 1e-9 * r.explained + 1e-15
            assert r.identity_error <= 1e-9
            signs.setdefault(c, []).append((r.whitened, want[at, c - 1]))
    for pairs in signs.values():
        a, b = np.array(pairs).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(40, 40))
    rows = [(i, (rng.normal(size=40) @ mix).astype(np.float32)) for i in range(300)]
    check(whiten(frame(spark, rows).repartition(5)).collect(), rows)


def test_defined_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).astype(np.float32)) for i in range(30)]
    rows += [(99, rows[0][1])]  # the same vector again
    bad = [(200, None), (201, []), (202, [1, None, 2, 3, 4]), (203, [1, float("nan"), 2, 3, 4]), (204, [1, float("inf"), 2, 3, 4]), (205, [1, 2, 3])]
    got = whiten(frame(spark, rows + bad)).collect()
    check(got, rows)
    twice = whiten(frame(spark, rows + [(0, rows[0][1]), (None, rows[1][1])])).collect()
    assert sum(r.vec_id == 0 for r in twice) == 10 and sum(r.vec_id is None for r in twice) == 5


def test_empty_and_equal(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None)])).collect() == []
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # nothing varies
    got = whiten(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [2.0, 2.0])])).collect()
    assert {r.component for r in got} == {1} and {r.explained for r in got} == {1.0}  # the constant dimension has no component


def test_large_values_stay_exact(spark):
    """Sums beyond a long: the covariance and deviations don't wrap."""
    rows = [(i, [float(2**40 * (i % 7)), float(-(2**41) * (i % 5)), float(i)]) for i in range(40)]
    got = whiten(frame(spark, rows)).collect()
    x = np.array([[int(64 * a) for a in v] for _, v in rows], object)
    n = len(rows)
    big = x * n - x.sum(axis=0)
    want = {i: int((big[at] ** 2).sum()) for at, (i, _) in enumerate(rows)}
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None) for r in got)
    assert all(r.identity_error < 1e-4 for r in got)


def test_polarisation_is_exact():
    rng = np.random.default_rng(5)
    z = rng.integers(-1000, 1000, size=(50, 4)).astype(object)
    n, s = len(z), z.sum(axis=0)
    whole, rest = [int(a) // n for a in s], [int(a) % n for a in s]
    y = z - np.array(whole, object)
    q = {(i, j): int(((y[:, i] if i == j else y[:, i] + y[:, j]) ** 2).sum()) for i in range(4) for j in range(i, 4)}
    c = z * n - s
    want = [[int((c[:, i] * c[:, j]).sum()) / n**3 for j in range(4)] for i in range(4)]
    assert np.array_equal(covariance(n, rest, q), np.array(want))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(queries.op12_whitening(spark, sf).collect(), rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).astype(np.float32)) for i in range(80)]
    w = fit(usable(frame(spark, rows).repartition(parts), "vec_id", "embedding"))
    x = np.array([np.floor(64.0 * v.astype(float)) for _, v in rows])
    assert np.allclose(w.values, np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1], rtol=1e-9)
