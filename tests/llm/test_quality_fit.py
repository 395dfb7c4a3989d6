import numpy as np
from pyspark.sql import functions as F
from tallyfield.llm import quality


def sample(n=400, features=12, seed=3):
    rng = np.random.default_rng(seed)
    dense = rng.random((n, features)) < 0.3
    true = rng.normal(size=features) * 2
    score = dense @ true + rng.logistic(size=n)
    grades = np.digitize(score, [-0.5, 1.0])
    return [np.nonzero(r)[0] * 1000 for r in dense], dense.astype(float), grades


def plain_loss(dense, grades, w, theta, ridge):
    """Row by row."""
    total = 0.0
    for x, g in zip(dense, grades):
        le = [0.0, *(1 / (1 + np.exp(-(t - x @ w))) for t in theta), 1.0]
        total -= np.log(le[g + 1] - le[g])
    return total / len(grades) + ridge / 2 * (w @ w)


def test_gradient_equals_differences_of_a_plain_loss():
    rows, dense, grades = sample()
    start, loss, split = quality.objective(rows, grades, 3, 1e-2, 1)
    p = start + np.random.default_rng(1).normal(size=len(start)) * 0.3
    value, gradient = loss(p)
    of = lambda q: plain_loss(dense, grades, split(q)[0][::1000][: dense.shape[1]], split(q)[1], 1e-2)
    assert np.isclose(value, of(p))
    for i in range(len(p)):
        step = np.zeros(len(p))
        step[i] = 1e-5
        assert np.isclose(gradient[i], (of(p + step) - of(p - step)) / 2e-5, atol=1e-6)


def test_fit_equals_a_plain_dense_solver():
    """Newton steps with differences of the gradient, on the dense matrix."""
    rows, dense, grades = sample()
    model = quality.fit_rows(rows, grades, 3, ridge=1e-2, least=1)
    start, loss, split = quality.objective(rows, grades, 3, 1e-2, 1)
    p = start.copy()
    for _ in range(30):
        value, g = loss(p)
        h = np.array([(loss(p + 1e-5 * e)[1] - loss(p - 1e-5 * e)[1]) / 2e-5 for e in np.eye(len(p))])
        d, step = np.linalg.solve(h + 1e-9 * np.eye(len(p)), g), 1.0
        while loss(p - step * d)[0] > value and step > 1e-6:
            step /= 2
        p = p - step * d
    weights, theta = split(p)
    assert np.abs(loss(p)[1]).max() < 1e-6
    assert np.allclose(model.weights, weights, atol=2e-2) and np.allclose(model.thresholds, theta, atol=2e-2)


def test_repeated_ids_do_not_widen_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_rows", lambda rows, grades, count: seen.append(len(rows)))
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    quality.fit(docs, spark.createDataFrame([(0, 0), (1, 2), (2, 1)], "doc_id long, grade int"), F.col("grade"), max_rows=50)
    assert seen == [50]


def test_the_driver_holds_few_bytes_for_a_feature(monkeypatch):
    """Of 2 million features the objective and a step take 40 MB beside the rows; blocks give the same numbers as one block."""
    import tracemalloc

    rng = np.random.default_rng(5)
    rows, grades = [np.sort(rng.choice(50_000, 500, replace=False)).astype(np.int32) for _ in range(4000)], rng.integers(0, 3, 4000)
    tracemalloc.start()
    start, loss, _ = quality.objective(rows, grades, 3, 1e-4, 5)
    p = start + 0.01
    value, gradient = loss(p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    monkeypatch.setattr(quality, "BLOCK", 1 << 40)
    whole = quality.objective(rows, grades, 3, 1e-4, 5)[1](p)
    assert np.isclose(value, whole[0]) and np.allclose(gradient, whole[1])
