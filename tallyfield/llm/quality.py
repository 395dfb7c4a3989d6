"""Quality by ordinal cumulative-link regression on graded ratings.

Grades are whole numbers from 0. Every text has one score, the sum of the weights of its hashed features; ordered
thresholds cut the scores into grades: P(grade <= g) = sigmoid(threshold_g - score). All thresholds share the
weights. The expected grade is the sum of the tail probabilities, and P(grade >= g) serves for selection.

Features, each counted once for a text: its words in lower case, their first four letters, their form (case,
marks at their ends), and, in tenths, the shares of upper-case words, of words with marks, of words equal to the
one before, and of distinct words.

The fit reads a bounded sample: at most ``max_rows`` rated texts (``MAX_ROWS`` by default), chosen by a hash of
their ids, with their whole texts, and of those features only that ``least`` of them share. Ids that stand on many rows don't widen
it: of the rows that meet a rating the ``max_rows`` of the smallest hashes of text are learned from. Scoring covers all rows.

Cases: a null text counts as empty; it has no features but its shares. Ratings that are null, or of ids without
a document, aren't learned from; of repeated ratings each counts. Without two different grades among the ratings
there is nothing to learn, and every text has the highest grade seen, or 0, for certain. Other columns pass
through; ``expected_grade``, ``tail`` and ``selected`` replace columns of those names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bounded_batches, set_aside, table

WIDTH = 1 << 18
MAX_ROWS, BLOCK = 10_000, 1 << 17
#: A text is selected if its chance of the highest grade reaches this.
MINIMUM = 0.8
ADDED = (T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("selected", T.BooleanType()))


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & (WIDTH - 1)


class Features:
    def __init__(self, keep: int = 200_000):
        self.of, self.keep = {}, keep

    def _word(self, word: str) -> tuple[int, ...]:
        core = word.strip(".,;:!?$%&#|*()[]\"'")
        low = core.lower()
        form = ("U" if core.isupper() and len(core) > 1 else "x") + ("+" if word[len(core) :].strip(".,;:") else "")
        return (_hash("w" + low), _hash("f" + form), *((_hash("p" + low[:4]),) if len(low) > 4 else ()))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if len(self.of) > self.keep:
            self.of = {}
        found: set[int] = set()
        distinct = set(words)
        for w in distinct:
            got = self.of.get(w)
            if got is None:
                got = self.of[w] = self._word(w)
            found.update(got)
        n = max(1, len(words))
        upper = sum(map(str.isupper, words))
        marks = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words)
        same = sum(map(str.__eq__, words, words[1:]))
        for name, value in (("upper", upper / n), ("marks", marks / n), ("same", same / n), ("distinct", len(distinct) / n)):
            found.add(_hash(f"{name}:{int(10 * value)}"))
        return np.fromiter(found, dtype=np.int64, count=len(found))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= g) of each score, for all g but the highest."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None] - score[:, None], -500, 500)))


def minimise(f, x: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking; ``f`` gives the value and the gradient."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, stack = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            stack.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(stack)):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope = g @ d
        step = 1.0 if past else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        for _ in range(25):
            at = x + step * d
            new, grad = f(at)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        if (at - x) @ (grad - g) > 1e-12:
            past = [*past[1 - memory :], (at - x, grad - g)]
        done = value - new < 1e-7 * max(1.0, abs(value))
        x, value, g = at, new, grad
        if done:
            return x
    return x


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, grade_count: int, rounds: int = 100, ridge: float = 1e-4, least: int = 5) -> Model:
    """Least mean negative log-likelihood with a quadratic penalty on the weights. Steps between thresholds are exponentials, so they
    stay in order."""
    start, loss, split = objective(rows, grades, grade_count, ridge, least)
    w, theta = split(minimise(loss, start, rounds))
    return Model(w.astype(np.float32), theta)


def objective(rows: list[np.ndarray], grades: np.ndarray, grade_count: int, ridge: float, least: int):
    """The start, the loss with its gradient, and a function that parts parameters into the weights and thresholds. Only columns that are used have parameters."""
    seen = np.zeros(WIDTH, dtype=np.int64)
    for r in rows:
        np.add.at(seen, r, 1)
    used = np.flatnonzero(seen >= least)
    place = np.full(WIDTH, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    # rows in blocks of about BLOCK features: the place and the row of each feature that is used; what a step makes beside these is as large as one block
    blocks, first = [], 0
    while first < len(rows):
        last, count = first, 0
        while last < len(rows) and count < BLOCK:
            count, last = count + len(rows[last]), last + 1
        at = [place[r] for r in rows[first:last]]
        owner, index = np.repeat(np.arange(last - first, dtype=np.int32), [len(r) for r in at]), np.concatenate(at)
        blocks.append((first, last, owner[index >= 0], index[index >= 0]))
        first = last
    n = len(used)
    cuts = grade_count - 1
    share = np.array([(grades <= g).mean() for g in range(cuts)]).clip(1e-3, 1 - 1e-3)
    theta0 = np.log(share / (1 - share))
    row = np.arange(len(rows))

    def thresholds(p):
        return p[n] + np.concatenate([[0], np.cumsum(np.exp(p[n + 1 :]))])

    def split(p):
        weights = np.zeros(WIDTH)
        weights[used] = p[:n]
        return weights, thresholds(p)

    def loss(p):
        w, theta = p[:n], thresholds(p)
        score = np.concatenate([np.bincount(owner, weights=w[index], minlength=last - first) for first, last, owner, index in blocks])
        f = 1 / (1 + np.exp(-np.clip(theta[None] - score[:, None], -500, 500)))
        f = np.hstack([np.zeros((len(rows), 1)), f, np.ones((len(rows), 1))])
        d = f * (1 - f)
        prob = np.maximum(f[row, grades + 1] - f[row, grades], 1e-12)
        up, down = d[row, grades + 1] / prob / len(rows), d[row, grades] / prob / len(rows)
        by_theta = np.array([down[grades == g + 1].sum() - up[grades == g].sum() for g in range(cuts)])
        by_weight, pull = ridge * w, up - down
        for first, last, owner, index in blocks:
            by_weight += np.bincount(index, weights=pull[first:last][owner], minlength=n)
        steps = np.exp(p[n + 1 :]) * np.cumsum(by_theta[::-1])[::-1][1:]
        return -np.log(prob).mean() + ridge / 2 * (w @ w), np.concatenate([by_weight, [by_theta.sum()], steps])

    start = np.concatenate([np.zeros(n), theta0[:1], np.log(np.maximum(np.diff(theta0), 1e-3))])
    return start, loss, split


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, max_rows: int = MAX_ROWS, text: str = "text") -> Model:
    """Learn from ``docs`` (doc_id, text) rated by ``ratings`` (doc_id and the columns of ``grade``)."""
    rated = ratings.select(F.col("doc_id").alias("_id"), grade.cast("int").alias("_grade")).where("_id is not null and _grade >= 0")
    n = rated.count()
    share = min(1.0, max_rows / max(1, n))
    rated = rated.where(F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64(F.col("_id").cast("string"))).limit(max_rows)
    picked = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(rated), F.col("doc_id") == F.col("_id"))
    picked = picked.select("_grade", "text", F.xxhash64(F.col("_id").cast("string"), "text", "_grade").alias("_order"))

    def features(batches):
        make = Features()
        for batch in bounded_batches(batches):
            rows = [make(t).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], type=pa.binary()), batch.column(2)], names=["grade", "features", "order"])

    got = picked.mapInArrow(features, "grade int, features binary, order long").orderBy("order").limit(max_rows).toArrow()
    grades = got.column("grade").to_numpy().astype(np.int64) if got.num_rows else np.zeros(0, dtype=np.int64)
    if len(np.unique(grades)) < 2:
        top = int(grades.max(initial=0))
        return Model(np.zeros(WIDTH, dtype=np.float32), np.full(top, -1e3))
    rows = [np.frombuffer(b, dtype=np.int32) for b in got.column("features").to_pylist()]
    del got
    order = sorted(range(len(rows)), key=lambda i: (int(grades[i]), rows[i].tobytes()))  # the order of arrival doesn't matter
    return fit_rows([rows[i] for i in order], grades[order], int(grades.max()) + 1)


def rate(docs: DataFrame, model: Model, at_least: int | None = None, minimum: float = MINIMUM, text: str = "text") -> DataFrame:
    """``docs`` with the expected grade, P(grade >= ``at_least``) (the highest, if none) and whether that reaches ``minimum``."""
    rest = [f for f in docs.schema.fields if f.name.lower() not in {a.name for a in ADDED}]
    place, names = [f.name for f in rest].index(text), [*(f.name for f in rest), *(a.name for a in ADDED)]
    g = len(model.thresholds) if at_least is None else at_least
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches):
        own, make = Model(*held.value), Features()
        for batch in bounded_batches(batches, column=place):
            score = np.array([float(own.weights[make(t)].sum(dtype=np.float64)) for t in batch.column(place).to_pylist()])
            le = own.at_most(score)
            tail = np.ones(len(score)) if g <= 0 else np.zeros(len(score)) if g > le.shape[1] else 1 - le[:, g - 1]
            expected = (1 - le).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in (expected, tail, tail >= minimum))], names=names)

    return docs.select(*(F.col(f"`{f.name}`") for f in rest)).mapInArrow(run, T.StructType([*rest, *ADDED]))


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are selected, with its columns and no others, whatever their names."""
    rows, back = set_aside(docs, {a.name for a in ADDED})
    return back(rate(rows, model, text=text).where("selected"))


def grade_of_labels() -> Column:
    """Three grades from the two labels: 0 poor or both, 1 good but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), grade_of_labels())
    return rate(docs, model).select("doc_id", "expected_grade", "tail", "selected")


QUERIES, ORACLE = {"op5_ordinal_quality": op5_ordinal_quality}, {}
