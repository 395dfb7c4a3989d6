import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyfield.llm import centroids as ce


def plain(rows, k, rounds, size, scale):
    """(id, cluster, distance) of each row and the centroids, with all distances in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), n) for n, w in enumerate(c))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for n in range(len(c)):
            of = [v for (_, v), m in zip(kept, mine) if m == n]
            if of:
                c[n] = [sum(col) // len(of) for col in zip(*of)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), c


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 6), st.sampled_from([1, 3, 1000, 2**26]))
def test_nearest_is_the_nearest_with_ties_to_the_smaller(seed, k, size, spread):
    rng = np.random.default_rng(seed)
    values, x = rng.integers(-spread, spread + 1, (k, size)), rng.integers(-spread, spread + 1, (50, size))
    number, best, measured = ce.Centroids(values).nearest(x)
    far = ((x[:, None] - values) ** 2).sum(2)
    assert best.tolist() == far.min(1).tolist() and number.tolist() == far.argmin(1).tolist() and measured <= far.size


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (40, 64)) + rng.normal(0, 300, (40, 1))
    x = np.floor(centres[rng.integers(0, 40, 2000)] + rng.normal(0, 40, (2000, 64))).astype(np.int64)
    assert ce.Centroids(np.floor(centres).astype(np.int64)).nearest(x)[2] < 0.25 * 2000 * 40


@pytest.mark.parametrize("n, k", [(60, 5), (3, 5), (0, 5)])
def test_clusters_equal_a_plain_run(spark, n, k):
    rng = np.random.default_rng(n)
    rows = [(int(i) if i % 7 else None, [float(x) for x in rng.normal(0, 1, 4).round(1)]) for i in range(n)]
    rows += [(1, r[1]) for r in rows[:3]] + [(1, None), (2, [1.0]), (3, [1.0, None, 1.0, 1.0]), (4, [float("inf")] * 4), (5, [float("nan")] * 4), (6, [])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    got, c = ce.cluster(df, k=k, rounds=3, size=4, scale=8)
    want, centres = plain(rows, k, 3, 4, 8)
    assert c.tolist() == centres and sorted((tuple(r) for r in got.collect()), key=str) == want


def test_without_ids_there_is_no_centroid(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ce.cluster(df, size=2)[0].collect()] == [(None, None, None)]


def test_too_great_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit in 64 bits"):
        ce.cluster(df, size=2)
