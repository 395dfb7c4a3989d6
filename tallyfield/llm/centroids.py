"""Centroid clustering by equal-average equal-variance search.

Vectors of exactly ``size`` components become integers floor(scale x). Each round assigns every vector to its nearest centroid and moves each
centroid that has vectors to the floor of their mean. The nearest is found without measuring all: centroids are sorted by the sum of
their components, and a vector scans outward from its own sum, nearer sums first. With sums s, t, components k and lengths u, v of the
deviations from the means, the squared distance is at least (s - t)^2 / k + (u - v)^2. So the scan ends where (s - t)^2 / k alone exceeds the
best distance, passes over centroids whose whole bound exceeds it, and measures the rest in integers. A bound that equals the best distance is
measured, so that of equal distances the smaller number wins. All vectors of a batch take their steps together.

A task holds one batch and the centroids. Each round returns one row of sums for each task and centroid, which Spark adds up; the driver holds
the centroids only. The integers are landed once, so that each round sees the same rows and nothing before them runs again.

Cases: vectors that are null, of another length, or with a component that is null or not finite take no part. Rows of null id are clustered,
but can't start a centroid; if no row can, number and distances are null. Repeated ids and rows each count. Fewer kept rows than ``k`` give
fewer centroids. Components must stay below 2^27 in size as integers, so that squared distances fit in 64 bits: a greater one raises
an error, as rounding would be silent. Columns other than id and vector are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import land, table

SIZE, SCALE, COUNT, ROUNDS, SEED = 64, 256, 40, 5, 2
BATCH = 4096
LARGEST = 1 << 27


class Centroids:
    """Centroids in the order of their sums, with what the bounds need."""

    def __init__(self, values: np.ndarray):
        sums = values.sum(1)
        self.number = np.argsort(sums, kind="stable")
        self.values, self.sums, self.deviation = values[self.number], sums[self.number], deviation(values)[self.number]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each row, and how many distances were measured."""
        n, k, size = len(x), len(self.values), x.shape[1]
        sums, spread = x.sum(1), deviation(x)
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        rows, measured = np.arange(n), 0
        for _ in range(k):
            below = np.where(low[rows] >= 0, sums[rows] - self.sums[np.maximum(low[rows], 0)], np.iinfo(np.int64).max)
            above = np.where(high[rows] < k, self.sums[np.minimum(high[rows], k - 1)] - sums[rows], np.iinfo(np.int64).max)
            at = np.where(below <= above, low[rows], high[rows])
            low[rows] -= below <= above
            high[rows] += below > above
            least = np.minimum(below, above).astype(np.float64) ** 2 / size
            near = may(least, best[rows])  # the others' sums are all further off
            rows, at, least = rows[near], at[near], least[near]
            if not len(rows):
                break
            close = may(least + (spread[rows] - self.deviation[at]) ** 2, best[rows])
            to, c = rows[close], at[close]
            measured += len(to)
            far = ((x[to] - self.values[c]) ** 2).sum(1)
            mine = self.number[c]
            better = (far < best[to]) | ((far == best[to]) & (mine < number[to]))
            best[to[better]], number[to[better]] = far[better], mine[better]
        return number, best, measured


def deviation(x: np.ndarray) -> np.ndarray:
    """Length of each row's deviation from its mean, in doubles."""
    return np.sqrt(((x - x.mean(1, keepdims=True)) ** 2).sum(1))


def may(bound: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Whether a bound, with the rounding of doubles allowed for, leaves room for a distance of ``best``."""
    return bound * (1 - 1e-9) - 1e-3 <= best


def integers(vectors: DataFrame, id: str, vector: str, size: int, scale: int) -> DataFrame:
    """(id, v) of the vectors that take part: floor(scale x) of their components."""

    def whole(batches):
        for batch in batches:
            lists = batch.column(1)
            fit = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), -1)) == size
            part = batch.filter(pa.array(fit))
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)  # null becomes nan
            fine = np.isfinite(x).all(1)
            x = np.floor(x[fine] * scale)
            if (np.abs(x) >= LARGEST).any():
                raise ValueError(f"components must be below {LARGEST} as integers, so that distances fit in 64 bits")
            flat = pa.array(x.astype(np.int32).ravel())
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(fine)), v], names=["id", "v"])

    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(whole, "id long, v array<int>")


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The rows with the ``k`` smallest hashes of seed and id; of repeated ids those with the smaller components."""
    hashed = rows.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in hashed.orderBy("h", "v").limit(k).collect()], dtype=np.int64)


def _blocks(batches, size: int):
    """(ids, integer matrix) of at most ``BATCH`` rows each."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = batch.slice(start, BATCH)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, size = centroids.shape

    def sums(batches):
        held, count, search = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64), Centroids(centroids)
        for _, x in _blocks(batches, size):
            number = search.nearest(x)[0]
            order = np.argsort(number, kind="stable")
            mine, start = np.unique(number[order], return_index=True)
            held[mine] += np.add.reduceat(x[order], start)
            count += np.bincount(number, minlength=k)
        some = np.nonzero(count)[0]
        totals = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * size + 1, size, dtype=np.int32)), pa.array(held[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), totals], names=["c", "n", "total"])

    parts = rows.mapInArrow(sums, "c int, n long, total array<long>")
    exact = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    out = centroids.copy()
    for r in parts.groupBy("c").agg(F.sum("n").alias("n"), *exact).collect():  # at most k rows
        out[r["c"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
    return out


def cluster(vectors: DataFrame, k: int = COUNT, rounds: int = ROUNDS, id: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each vector that takes part, landed, and the final centroids."""
    rows = land(integers(vectors, id, vector, size, scale), "vectors")
    centroids = first_centroids(rows, k, seed).reshape(-1, size)
    if not len(centroids):
        return rows.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(rows, centroids)

    def assigned(batches):
        search = Centroids(centroids)
        for ids, x in _blocks(batches, size):
            number, best, _ = search.nearest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    return land(rows.mapInArrow(assigned, "id long, cluster int, distance long"), "clusters"), centroids


def op11_equal_average_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # at most one row for each centroid
    facts = [(c, inertia.get(c, 0), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    of = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string"))
    every = sum(inertia.values()) if len(centroids) else None
    return rows.withColumnRenamed("id", "vec_id").join(of, "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(every).cast("long").alias("inertia"), "centroid_sha256")


def _sql() -> str:
    """Each round as tables of its own: products of doubles are exact for these integers."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
      WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM
      (SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {COUNT}))"""]  # fmt: skip
    for i in range(ROUNDS + 1):
        steps.append(f"""d{i} AS (SELECT v.r, c.c, list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e) AS d FROM v CROSS JOIN c{i} c),
a{i} AS MATERIALIZED (SELECT r, CAST(min(d) AS BIGINT) AS d, min_by(c, d * {COUNT} + c) AS c FROM d{i} GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (SELECT c, p, floor(sum(x) / count(*)) AS x FROM (SELECT a.c, generate_subscripts(v.e, 1) AS p, unnest(v.e) AS x FROM a{i} a JOIN v USING (r)) GROUP BY c, p),
m{i} AS (SELECT c, list(x ORDER BY p) AS e FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (c))""")
    last = ROUNDS
    return "WITH " + ",\n".join(steps) + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{last} a JOIN v USING (r) JOIN c{last} c USING (c)"""


QUERIES = {"op11_equal_average_variance": op11_equal_average_variance}
ORACLE = {"op11_equal_average_variance": _sql()}
