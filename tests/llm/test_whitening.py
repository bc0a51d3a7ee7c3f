from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickfold.llm import whitening
from clickfold.llm.queries import op11_whitening


def brute(x):
    """Whole numbers, eigenvalues and eigenvectors (falling) of their covariance, by the whole matrix."""
    x = np.floor(1024 * np.asarray(x, dtype=np.float64)).astype(np.int64) + 100_000
    centred = (x * len(x) - x.sum(0)) / len(x)
    e, c = np.linalg.eigh(centred.T @ centred / len(x))
    return x, centred, e[::-1], c[:, ::-1]


def check(got, ids, vectors, k=8):
    x, centred, e, c = brute(vectors)
    n = len(x)
    place = {i: at for at, i in enumerate(ids)}
    white = np.full((n, k), np.nan)
    for r in got:
        at = place[r.vec_id]
        white[at, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[at], x.sum(0)))
        assert abs(r.explained - e[r.component - 1] / e.sum()) <= 1e-9 * r.explained and r.identity_error <= 1e-9
    for j in range(k):
        want = centred @ c[:, j] / math.sqrt(e[j])
        sign = np.sign(want @ white[:, j])
        assert np.abs(sign * white[:, j] - want).max() < 1e-7


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = op11_whitening(spark, sf).collect()
    assert len(got) == 8 * len(rows)
    check(got, [r.vec_id for r in rows], [r.embedding for r in rows])


def test_steep_and_repeated_variances(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 12)) * np.array([900, 200, 60, 20, 7, 5, 3, 2, 1, 1, 1, 0.5])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    check(whitening.whiten(table).collect(), list(range(300)), x)


def test_odd_vectors_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i * i % 11), float(i % 3)]) for i in range(30)]
    odd = [(90, None), (91, []), (92, [1.0, nan, 2.0]), (93, [inf, 0.0, 0.0]), (94, [None, 1.0, 1.0]), (95, [1.0, 2.0]), (96, [1e300, 0.0, 0.0])]
    table = spark.createDataFrame(good + odd + [(None, [1.0, 2.0, 0.5])], "vec_id long, embedding array<double>")
    for name in ("id", "x", "dim", "n", "component", "whitened", "deviation"):
        table = table.withColumn(name, F.lit("?"))
    got = whitening.whiten(table).collect()
    assert {r.vec_id for r in got} == {i for i, _ in good} | {None} and {r.component for r in got} == {1, 2, 3}
    check(got, [i for i, _ in good] + [None], [v for _, v in good] + [[1.0, 2.0, 0.5]], k=3)


def test_axes_without_variance_give_no_component(spark):
    def components(rows):
        df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
        return sorted({r.component for r in whitening.whiten(df).collect()})
    assert components([]) == [] and components([[1.0, 2.0]]) == [] and components([[1.0, 2.0]] * 5) == []
    assert components([[float(i), 2.0 * i, 5.0] for i in range(9)]) == [1]
    assert components([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]) == [1, 2]  # equal variances


@pytest.mark.parametrize("row, n", [([0, 0], 1), ([5, -7], 10), ([2 ** 40, 3], 7), ([2 ** 20, 1], 2 ** 9)])
def test_exact_deviations(row, n):
    rest = [3, 1]
    total = sum((n * x - r) ** 2 for x, r in zip(row, rest))
    assert whitening._deviation(np.array(row, dtype=np.int64), n, rest) == (total if total < 2 ** 63 else None)
