import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.llm import whitening
from crestline.llm.common import table


def frame(spark, vectors):
    rows = [(i if i % 9 else None, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit("own") for c in ("x", "n", "i", "size", "component")})


def brute(vectors):
    """Exact sums and covariance; eigenvalues and vectors of its doubles."""
    x = [tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    cov = np.array([[float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit), n ** 3))
                     for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    return x, n, sums, cov, values[::-1], axes[:, ::-1]


def check(got, vectors, components=16, rank=None):
    x, n, sums, cov, values, axes = brute(vectors)
    k = min(components, rank or len(sums))
    assert len(got) == len(vectors) * k
    assert {r["n"] for r in got} == {n}
    deviation = sorted(sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x for _ in range(k))
    assert sorted(r["deviation"] for r in got) == deviation
    assert max(r["identity_error"] for r in got) < 1e-9
    for c in range(k):
        mine = [r for r in got if r["component"] == c + 1]
        assert mine[0]["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
        want = [math.fsum(float(Fraction(n * e - s, n)) * a for e, s, a in zip(v, sums, axes[:, c])) / math.sqrt(values[c]) for v in x]
        have = sorted(r["whitened"] for r in mine)
        worst = min(np.abs(np.array(have) - np.sort(sign * np.array(want))).max() for sign in (1, -1))
        assert worst < 1e-6


def fitted(spark, vectors, parts=3, **options):
    x = whitening.whole_vectors(frame(spark, vectors).repartition(parts))
    return whitening.whiten(x, whitening.fit(x, **options)).collect()


def test_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(200, 6)) @ np.diag([9, 5, 3, 1, 0.3, 0.1]) @ rng.normal(size=(6, 6))).tolist()
    vectors += [vectors[0]] * 150  # a hot vector counts once
    check(fitted(spark, vectors), vectors)
    check(fitted(spark, vectors, components=2), vectors, components=2)


def test_far_apart_scales_and_far_mean(spark):
    """Deviations of 1e6 and of 1 next to each other, far from zero."""
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 4)) * [20000, 200, 2, 0.05] + [5e5, -3e4, 100, 7]).tolist()
    check(fitted(spark, vectors), vectors)


def test_directions_without_variance(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(-40, 40, size=(120, 3)).astype(float)
    vectors = np.column_stack([a, np.full(120, 3.0), a[:, 0] + a[:, 1], 2 * a[:, 2]]).tolist()
    check(fitted(spark, vectors), vectors, rank=3)
    few = rng.normal(size=(3, 8)).tolist()
    check(fitted(spark, few), few, rank=2)


def test_rows_that_take_no_part(spark):
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], [3.0, -1.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    check(fitted(spark, good + bad), good)


def test_nothing_to_whiten(spark):
    assert fitted(spark, []) == [] and fitted(spark, [None, []]) == []
    assert fitted(spark, [[1.0, 2.0]] * 5) == []


def test_given_table(spark, sf):
    vectors = [r["embedding"] for r in table(spark, sf, "embeddings").collect()]
    x = whitening.whole_vectors(table(spark, sf, "embeddings"))
    w = whitening.fit(x)
    _, n, sums, cov, values, axes = brute([v for v in vectors if v is not None])
    assert (w.n, w.sums) == (n, sums) and w.identity_error < 1e-9
    assert np.allclose(w.values, values[:16], rtol=1e-9)
    assert np.allclose(np.abs(w.vectors.T @ axes[:, :16]), np.eye(16), atol=1e-7)
