"""Exact top-k inner products by branch and bound on ball trees.

Vectors are quantised to floor(64 x). Each bounded run of rows of a partition is a shard with a ball tree:
nodes have a centre, a radius and their smallest id. A node's inner products with q are at most
q.centre + |q| radius. The queries stand in blocks, a task each. A block reads the shards from the shared folder one after the other, those of
the greatest root bound first, and keeps its k best so far; the current k-th score, shared by all shards, prunes shards unread and nodes
unopened. Within a tree the nodes wait in a queue ordered by their upper bounds, and leaves are scored as they come up, so that the k-th score
rises early. A node whose bound equals the k-th score is only taken if it holds a smaller id than the k-th's.

A block and one shard are all that a task holds. Shards aren't shuffled: each is written once and read by each block of the stated query set
that its bound doesn't rule out.

Cases: vectors that are null or hold a null or a component that isn't finite take no part. Vectors of unequal
lengths aren't compared. An empty vector scores zero with its like. A query doesn't meet its own row, but all others, those of its id too; with
repeated ids each row is a query of its own, so their ranks repeat. The search keeps k + 1 rows, and of these one that has the query's id and its
score with itself is taken out: its own row, or one with the same id and score. Rows of null id take no part. Scores are exact while they fit 64 bits. Columns other than id and vector are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import io
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import files_of, groups_of, land, table

SHARD_ROWS = 4096
LEAF = 128
BLOCK = 256


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict:
    """Nodes in breadth-first order; ``child`` is the first of two, or -1. Rows are sorted so that a node is a slice."""
    order = np.lexsort((ids,))
    ids, x = ids[order], vectors[order].astype(np.float64)
    place = np.arange(len(ids))
    spans, child = [(0, len(ids))], [-1]
    at = 0
    while at < len(spans):
        a, b = spans[at]
        if b - a > leaf:
            mine = x[place[a:b]]
            far = mine[((mine - mine.mean(0)) ** 2).sum(1).argmax()]
            other = mine[((mine - far) ** 2).sum(1).argmax()]
            side = mine @ (other - far)
            if side.size and side.max() > side.min():
                half = np.argsort(side, kind="stable")
                place[a:b] = place[a:b][half]
                child[at] = len(spans)
                spans += [(a, (a + b) // 2), ((a + b) // 2, b)]
                child += [-1, -1]
        at += 1
    x, ids = x[place], ids[place]
    centre = np.array([x[a:b].mean(0) for a, b in spans])
    radius = np.array([np.sqrt(((x[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(spans, centre)])
    small = np.int8 if np.abs(vectors).max(initial=0) < 128 else np.int32 if np.abs(vectors).max(initial=0) < 2**31 else np.int64
    return {"ids": ids, "x": vectors[order][place].astype(small), "span": np.array(spans), "child": np.array(child), "centre": centre, "radius": radius, "least": np.array([ids[a:b].min() for a, b in spans])}


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where they hold them, else in 64-bit integers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


LOWEST = np.iinfo(np.int64).min


class Best:
    """The k best (score, id) of each query of a block, its own row among them; empty places hold the lowest score."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.score = np.full((len(ids), k), LOWEST)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.visited = 0

    def bound(self, at: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
        """Upper bounds of the whole scores in a ball, rounding allowed for."""
        bound = self.q[at].astype(np.float64) @ centre + self.norm[at] * radius
        return np.floor(bound + 1e-6 + 1e-9 * np.abs(bound) + 1e-9 * self.norm[at] * (1 + np.abs(centre).max(initial=0)))

    def search(self, tree: dict) -> None:
        if tree["x"].shape[1] != self.q.shape[1]:
            return
        queue: list[tuple[float, int, np.ndarray, np.ndarray]] = []

        def wait(node: int, at: np.ndarray) -> None:
            bound = self.bound(at, tree["centre"][node], tree["radius"][node])
            keep = self.may(at, bound, tree["least"][node])
            if keep.any():
                heapq.heappush(queue, (-float(bound[keep].max()), node, at[keep], bound[keep]))

        wait(0, np.arange(len(self.q)))
        while queue:
            _, node, at, bound = heapq.heappop(queue)
            at = at[self.may(at, bound, tree["least"][node])]  # the k-th scores may have risen
            if not len(at):
                continue
            self.visited += 1
            if tree["child"][node] < 0:
                a, b = tree["span"][node]
                self.take(at, tree["ids"][a:b], _dot(self.q[at], tree["x"][a:b]))
            else:
                for child in (int(tree["child"][node]), int(tree["child"][node]) + 1):
                    wait(child, at)

    def may(self, at, bound, least) -> np.ndarray:
        kth = self.score[at, -1]
        return (kth == LOWEST) | (bound > kth) | ((bound == kth) & (least < self.found[at, -1]))

    def without_own(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids without the query's own row, else without the last place."""
        own = (self.found == self.ids[:, None]) & (self.score == (self.q.astype(np.int64) ** 2).sum(1)[:, None])
        cut = np.where(own.any(1), own.argmax(1), self.k - 1)[:, None]
        rest = np.arange(self.k - 1)[None] + (np.arange(self.k - 1)[None] >= cut)
        return np.take_along_axis(self.score, rest, 1), np.take_along_axis(self.found, rest, 1)

    def take(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        kth, kth_id = self.score[at, -1][:, None], self.found[at, -1][:, None]
        better = ((scores > kth) | ((scores == kth) & (ids[None] < kth_id)))
        rows = better.any(1)
        if not rows.any():
            return
        at, some = at[rows], np.nonzero(better[rows].any(0))[0]
        s = np.where(better[rows][:, some], scores[rows][:, some], LOWEST)
        i = np.where(better[rows][:, some], ids[some][None], np.iinfo(np.int64).max)
        s, i = np.hstack([self.score[at], s]), np.hstack([self.found[at], i])
        first = np.lexsort((i, ~s), axis=1)[:, : self.k]  # ~s falls as s rises, and can't overflow
        self.score[at], self.found[at] = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)


def quantised(vectors: DataFrame, id: str, vector: str, scale: int = 64) -> DataFrame:
    fine = F.col(id).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    return vectors.where(fine).select(F.col(id).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrices(batches, rows: int):
    """(ids, matrix) of runs of at most ``rows`` vectors of one length each."""
    held: dict[int, list] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            size = np.asarray(pa.compute.list_value_length(part.column(1)))
            flat, ids = part.column(1).flatten().to_numpy(zero_copy_only=False), part.column(0).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(size)])
            for n in np.unique(size):
                mine = np.nonzero(size == n)[0]
                held.setdefault(int(n), []).append((ids[mine], flat[(first[mine][:, None] + np.arange(n)).ravel()].reshape(len(mine), n)))
                while sum(len(x[0]) for x in held[int(n)]) >= rows:
                    ids_, x = (np.concatenate([y[i] for y in held[int(n)]]) for i in (0, 1))
                    yield ids_[:rows], x[:rows]
                    held[int(n)] = [(ids_[rows:], x[rows:])] if len(ids_) > rows else []
    for parts in held.values():
        if parts:
            yield tuple(np.concatenate([y[i] for y in parts]) for i in (0, 1))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, id, score: for each row of ``queries``, which are rows of ``vectors``, its ``k`` best others."""

    def trees(batches):
        import pyarrow.compute  # noqa: F401

        for ids, x in _matrices(batches, shard_rows):
            t = build_tree(ids, x)
            cells = ([_pack(centre=t["centre"][0], radius=t["radius"][0], least=t["least"][0])], [_pack(**t)])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.binary()) for c in cells], names=["root", "data"])

    landed = land(quantised(vectors, id, vector).mapInArrow(trees, "root binary, data binary"), "ball-trees", **{"parquet.block.row.count.limit": "1"})
    # all roots in few files, with the places of their shards: a row is a row group
    roots = files_of(land(landed.select("root", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("number")), "roots"))
    asked = land(quantised(queries, id, vector), "queries")
    blocks = max(1, -(-asked.count() // block))

    def search(batches):
        import pyarrow.compute  # noqa: F401

        for ids, x in _matrices(batches, 2 * block):
            best, order, every = Best(ids, x, k + 1), [], np.arange(len(ids))
            for part in (read("root", "path", "number") for file in roots for read in groups_of(file)):
                for root, path, number in zip(*(part.column(i).to_pylist() for i in range(3))):
                    root = _unpack(root)
                    if len(root["centre"]) == x.shape[1]:
                        order.append((-float(np.max(best.bound(every, root["centre"], float(root["radius"])))), path, number))
            for bound, path, number in sorted(order):
                if (best.may(every, np.full(len(every), -bound), np.iinfo(np.int64).min)).any():
                    for read in islice(groups_of(path), number, number + 1):
                        for data in read("data").column(0):
                            best.search(_unpack(data.as_py()))
            yield rows(best)

    def rows(best):
        score, found = best.without_own()
        full = score != LOWEST
        rank = np.broadcast_to(np.arange(1, k + 1), full.shape)[full]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(best.ids, full.sum(1))), pa.array(rank.astype(np.int32)), pa.array(found[full]), pa.array(score[full])], names=["query_id", "rank", "vec_id", "score"])

    return asked.repartition(blocks).mapInArrow(search, "query_id long, rank int, vec_id long, score long")


def op6_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op6_ball_tree_top_k": op6_ball_tree_top_k}
ORACLE = {
    "op6_ball_tree_top_k": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
}
