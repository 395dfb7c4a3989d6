"""Second-order boosted trees, grown leaf by leaf from histograms that Spark adds up.

Features are cut at quantiles into at most ``BINS`` bins, and a table of rows as bytes of bins is written once. For each tree and pass, tasks
find the gradients of their rows and the node that each row is in, and return sums for each (node, feature, bin) asked for; Spark adds
them up in a tree of tasks, and the driver gets as many sums as there are nodes asked for, features and bins, whatever the number of rows. What a tree sees (bins and gradients of its drawn rows) is
found once for the tree and kept, so a pass reads no more than that and applies no trees but its own. From these it splits the leaf of
the greatest gain until there are ``leaves`` of them. A pass asks for all leaves that may be split next, so a tree takes about as
many passes as it is deep. The scores of the rows are kept from tree to tree, and written every ``REFRESH`` trees, so what is lost is never more than those away.

Where a pass would be shorter than the job that it is, one task is faster than many: a table of up to ``TASK_ROWS`` rows is boosted by one task, which holds it as small
numbers and adds up the same sums for the same ``grow``, so a fit is one job. Larger tables take the passes.

A split's gain is GL^2/(HL + penalty) + GR^2/(HR + penalty) - G^2/(H + penalty) for sums of gradients and second derivatives, a leaf's value is
-G/(H + penalty), times the step. A side of fewer than ``leaf`` rows isn't split off. Of equal gains the first feature, then the
first bin counts. Each tree sees a share of the rows, drawn by a hash of row and tree, and a share of the features.

Cases: a null or NaN feature counts as 0 (by the assembler); a single value of a feature, or of the label, or an empty table gives trees of one leaf.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import fresh

BINS, REFRESH, BREADTH = 64, 20, 64
#: A table of up to so many rows, and so many bytes in a task, is boosted by one task; of each row there are ``ROW_BYTES`` and twice its bins. A pass over
#: a larger one has one task for each core, or more, of at most ``MOST_ROWS``.
TASK_ROWS, HELD, ROW_BYTES, MOST_ROWS = 2_000_000, 256 << 20, 48, 2_000_000


@dataclass
class Tree:
    """Nodes in the order of growth: feature (-1 in a leaf), the last bin that goes left, the left child (the right one follows) and the value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int) -> int:
        self.feature[node], self.bin[node], self.left[node] = feature, bin, len(self.feature)
        for _ in range(2):
            self.feature.append(-1), self.bin.append(0), self.left.append(0), self.value.append(0.0)
        return self.left[node]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while len(rows := rows[feature[at[rows]] >= 0]):
            here = at[rows]
            at[rows] = left[here] + (bins[rows, feature[here]] > cut[here])
        return at

    def apply(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    step: float = 0.03
    leaves: int = 15
    leaf: int = 40
    penalty: float = 5.0
    rows: float = 0.8
    features: float = 0.8
    seed: int = 7


def drawn(ids: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    """Whether the tree sees the rows: a mix of row, tree and seed against the share."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 1_000_003 + settings.seed) % (1 << 63))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < settings.rows * 2**53


def looked_at(count: int, tree: int, settings: Settings) -> np.ndarray:
    """The features that the tree may split, in order."""
    most = max(1, round(settings.features * count))
    return np.sort(np.random.default_rng((settings.seed, tree)).permutation(count)[:most])


def gradients(score: np.ndarray, y: np.ndarray, weight: np.ndarray, chance: bool) -> tuple[np.ndarray, np.ndarray]:
    if not chance:
        return weight * (score - y), weight
    p = 1 / (1 + np.exp(-score))
    return weight * (p - y), weight * p * (1 - p)


def best_split(sums: np.ndarray, features: np.ndarray, settings: Settings) -> tuple[float, int, int]:
    """Gain, feature and bin of a node's best split, from sums (feature, bin, [g, h, rows]); gain 0 if there is none."""
    left = sums[features].cumsum(1)
    whole = left[:, -1:, :]
    right = whole - left
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + settings.penalty + 1e-300)
    gain = np.where((left[..., 2] >= settings.leaf) & (right[..., 2] >= settings.leaf), worth(left) + worth(right) - worth(whole), 0.0)
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), int(features[f]), b) if gain[f, b] > 1e-12 else (0.0, -1, 0)


def grow(histograms, features: np.ndarray, settings: Settings) -> Tree:
    """The tree of at most ``settings.leaves`` leaves that takes the split of greatest gain first. ``histograms`` (tree, nodes) gives the sums of
    these leaves of a tree; it is asked for several at once: those that would be split if no split found so far had a better successor."""
    tree = Tree()
    known: dict[int, np.ndarray] = histograms(tree, [0])
    splits = {0: best_split(known[0], features, settings)}
    while True:
        leaves, taken, wanted = [0], [], []
        while len(leaves) < settings.leaves:
            node = max(leaves, key=lambda n: (splits[n][0] if n in splits else 0.0, -n))
            if node not in splits or splits[node][0] <= 0:
                break
            leaves.remove(node)
            taken.append(node)
            if tree.feature[node] < 0:
                tree.split(node, *splits[node][1:])
            child = tree.left[node]
            leaves += [child, child + 1]
            if child not in splits:
                wanted.append((node, child))
        if not wanted:
            return finished(tree, taken, known, settings)
        smaller = [child if left_rows(known[node], splits[node]) * 2 <= known[node][0, :, 2].sum() else child + 1 for node, child in wanted]
        sums = histograms(tree, smaller)
        for (node, child), one in zip(wanted, smaller):
            other = child + child + 1 - one
            known[one], known[other] = sums[one], known[node] - sums[one]
            for n in (child, child + 1):
                splits[n] = best_split(known[n], features, settings)


def left_rows(sums: np.ndarray, split: tuple[float, int, int]) -> float:
    return sums[split[1], : split[2] + 1, 2].sum()


def finished(tree: Tree, taken: list[int], known: dict[int, np.ndarray], settings: Settings) -> Tree:
    """The tree with the taken splits only, and the values of its leaves."""
    out, at = Tree(), {0: 0}
    for node in taken:
        child = out.split(at[node], tree.feature[node], tree.bin[node])
        at[tree.left[node]], at[tree.left[node] + 1] = child, child + 1
    for node, place in at.items():
        if out.feature[place] < 0:
            g, h = known[node][0, :, 0].sum(), known[node][0, :, 1].sum()
            out.value[place] = float(-settings.step * g / (h + settings.penalty + 1e-300))
    return out


@dataclass
class Booster:
    """Cuts of the features, first score and trees."""

    cuts: list[list[float]]
    chance: bool
    first: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The number of a feature's cuts that are below its value."""
        return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        return self.first + sum((t.apply(bins) for t in self.trees), np.zeros(len(x)))

    def text(self) -> str:
        return json.dumps([self.cuts, self.chance, self.first, [[t.feature, t.bin, t.left, t.value] for t in self.trees]])

    @staticmethod
    def of(text: str) -> Booster:
        cuts, chance, first, trees = json.loads(text)
        return Booster(cuts, chance, first, [Tree(*t) for t in trees])


def cuts_of(rows: DataFrame, features: int, bins: int = BINS) -> list[list[float]]:
    """Different quantiles of each feature of the vector ``_x``, the greatest left out: a bin holds the values up to its cut and above the one before."""
    if not features:
        return []
    x = vector_to_array("_x")
    at = F.array(*(F.lit((i + 1) / bins) for i in range(bins)))
    found = rows.agg(*(F.percentile_approx(x[i], at, 10_000).alias(f"q{i}") for i in range(features))).first()
    return [sorted(set(q or []))[:-1] for q in found]


BLOCK = "rows long, id binary, y binary, weight binary, bins binary, score binary"


def binned(rows: DataFrame, label: str, booster: Booster) -> DataFrame:
    """The table of ``BLOCK``, a row for up to some thousand rows, written to the shared folder: ids are given once, and what came before isn't run again."""
    features = len(booster.cuts)

    def pack(batches):
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
            cells = [batch.column(i).to_numpy(zero_copy_only=False).tobytes() for i in range(3)]
            cells += [booster.bins(x).tobytes(), np.full(batch.num_rows, booster.first).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), *(pa.array([c], type=pa.binary()) for c in cells)], names=["rows", "id", "y", "weight", "bins", "score"])

    packed = rows.where(F.col(label).isNotNull()).select(F.monotonically_increasing_id(), F.col(label).cast("double"), F.col("weight").cast("double"), vector_to_array("_x"))
    return _written(packed.mapInArrow(pack, BLOCK))


def _written(blocks: DataFrame) -> DataFrame:
    path = fresh(blocks.sparkSession, "boosting")
    blocks.write.parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def _arrays(row, features: int) -> tuple[np.ndarray, ...]:
    """ids, y, weight, bins and score of a block."""
    return (np.frombuffer(row[1], np.int64), np.frombuffer(row[2]), np.frombuffer(row[3]), np.frombuffer(row[4], np.uint8).reshape(-1, features), np.frombuffer(row[5]))


def with_tree(blocks: RDD, booster: Booster) -> RDD:
    """The blocks with their scores after the last tree."""
    tree, features = booster.trees[-1], len(booster.cuts)

    def add(row):
        *_, bins, score = _arrays(row, features)
        return (*row[:5], (score + tree.apply(bins)).tobytes())

    return blocks.map(add)


def seen_by(blocks: RDD, booster: Booster, number: int, settings: Settings) -> RDD:
    """Bins, feature by feature, gradients and second derivatives of the rows that tree ``number`` sees."""
    features, chance = len(booster.cuts), booster.chance

    def see(row):
        ids, y, weight, bins, score = _arrays(row, features)
        mine = drawn(ids, number, settings)
        return (bins[mine].T.tobytes(), *(x.tobytes() for x in gradients(score[mine], y[mine], weight[mine], chance)))

    return blocks.map(see)


def added_up(seen: RDD, booster: Booster, tree: Tree, nodes: list[int]) -> dict[int, np.ndarray]:
    """Sums (feature, bin, [g, h, rows]) of the rows of ``seen_by`` in each of ``nodes``. Each task adds up its blocks, and
    tasks' sums are added in a tree of fixed breadth, so that the driver adds few of them. It is one short job, without a plan to be made for each pass."""
    features, width = len(booster.cuts), max(map(len, booster.cuts)) + 1
    shape, above = (len(nodes), features, width), {tree.left[n] + k: n for n in range(len(tree.left)) if tree.feature[n] >= 0 for k in (0, 1)}
    wanted = set(nodes)
    for node in nodes:
        while node in above:
            node = above[node]
            wanted.add(node)

    def sums(rows):
        held = np.zeros((3, *shape))
        for row in rows:
            bins, g, h = np.frombuffer(row[0], np.uint8), np.frombuffer(row[1]), np.frombuffer(row[2])
            bins, todo = bins.reshape(features, -1), [(0, slice(None))]
            while todo:  # down to the nodes asked for; other rows are left where their way parts
                node, mine = todo.pop()
                if node in place:
                    for f in range(features):
                        cell = bins[f][mine].astype(np.intp)
                        for k, of in enumerate((g[mine], h[mine], None)):
                            held[k, place[node], f] += np.bincount(cell, of, width)
                    continue
                left = bins[tree.feature[node]][mine] <= tree.bin[node]
                for child, goes in ((tree.left[node], left), (tree.left[node] + 1, ~left)):
                    if child in wanted:
                        at = np.flatnonzero(goes)
                        todo.append((child, at if isinstance(mine, slice) else mine[at]))
        yield held

    place = {n: i for i, n in enumerate(nodes)}
    tasks, parts = seen.getNumPartitions(), seen.mapPartitions(sums)
    if tasks > BREADTH:
        parts = parts.treeReduce(lambda a, b: a + b, math.ceil(math.log(tasks, BREADTH)))
    total = parts if tasks > BREADTH else sum(parts.collect(), np.zeros((3, *shape)))
    return dict(zip(nodes, np.moveaxis(total, 0, -1)))


def narrow(values: np.ndarray) -> np.ndarray:
    """``values`` as small whole numbers if they are such, or as one number where all are equal."""
    if len(values) and (values == values[0]).all():
        return np.broadcast_to(values[0], len(values))
    with np.errstate(all="ignore"):
        small = values.astype(np.int8)
    return small if (small == values).all() else values


class Held:
    """The rows of a table in one task: bins feature by feature."""

    def __init__(self, blocks, booster: Booster):
        features = len(booster.cuts)
        ids, y, weight, bins, score = zip(*sorted((_arrays(row, features) for row in blocks if row[0]), key=lambda b: b[0][0]))  # as numbered, however they are read
        self.ids, self.y, self.weight, self.score = np.concatenate(ids), narrow(np.concatenate(y)), narrow(np.concatenate(weight)), np.concatenate(score)
        self.bins, self.width = np.concatenate([b.T for b in bins], axis=1), max(map(len, booster.cuts)) + 1

    @staticmethod
    def parted(tree: Tree, node: int, bins: np.ndarray, rows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a node that go left and right; None are all."""
        of = bins[tree.feature[node]]
        left = (of if rows is None else of.take(rows)) <= tree.bin[node]
        at = [np.flatnonzero(goes) for goes in (left, ~left)]  # faster than by a mask
        return tuple(at if rows is None else (rows.take(x) for x in at))

    def tree(self, booster: Booster, number: int, settings: Settings) -> Tree:
        mine = np.flatnonzero(drawn(self.ids, number, settings))
        bins, at = np.take(self.bins, mine, axis=1), {0: None}
        g, h = gradients(self.score[mine], self.y[mine].astype(float), self.weight[mine].astype(float), booster.chance)

        def histograms(tree: Tree, nodes: list[int]) -> dict[int, np.ndarray]:
            out = {}
            for node, child in enumerate(tree.left):
                if child and node in at:
                    at[child], at[child + 1] = self.parted(tree, node, bins, at.pop(node))
            for node in nodes:
                rows, sums = at[node], np.zeros((len(bins), self.width, 3))
                own = (g, h) if rows is None else (g.take(rows), h.take(rows))
                for f in range(len(bins)):
                    cell = (bins[f] if rows is None else bins[f].take(rows)).astype(np.intp)
                    for k, of in enumerate((*own, None)):
                        sums[f, :, k] = np.bincount(cell, of, self.width)
                out[node] = sums
            return out

        return grow(histograms, looked_at(len(bins), number, settings), settings)

    def add(self, tree: Tree) -> None:
        """The scores after a tree."""
        todo = [(0, None)]
        while todo:
            node, rows = todo.pop()
            if tree.feature[node] < 0:
                self.score[slice(None) if rows is None else rows] += tree.value[node]
            else:
                left, right = self.parted(tree, node, self.bins, rows)
                todo += [(tree.left[node], left), (tree.left[node] + 1, right)]


def boosted_in_one(table: DataFrame, booster: Booster, settings: Settings) -> Booster:
    """The booster with all its trees, grown by one task."""

    def fit(blocks):
        held = Held(blocks, booster)
        for number in range(settings.rounds):
            booster.trees.append(held.tree(booster, number, settings))
            held.add(booster.trees[-1])
        yield booster.text()

    return Booster.of(table.coalesce(1).rdd.map(tuple).mapPartitions(fit).collect()[0])


def boost(rows: DataFrame, label: str, features: int, chance: bool, settings: Settings = Settings(), cuts: list[list[float]] | None = None) -> Booster:
    """Fit on rows with the vector ``_x`` and ``weight``: chances of a 0/1 label by log loss, or values by squares."""
    booster = Booster(cuts if cuts is not None else cuts_of(rows, features), chance)
    mean = rows.agg((F.sum(F.col("weight") * F.col(label)) / F.sum("weight"))).first()[0] or 0.0
    if chance:
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        mean = float(np.log(mean / (1 - mean)))
    booster.first = float(mean)
    if not any(booster.cuts):  # nothing can be split
        return booster
    table = binned(rows, label, booster)
    count, cores = table.agg(F.sum("rows")).first()[0] or 0, table.sparkSession.sparkContext.defaultParallelism
    if 0 < count <= min(TASK_ROWS, HELD // (ROW_BYTES + 2 * features)):
        return boosted_in_one(table, booster, settings)
    tasks = max(1, min(count, max(cores, -(-count // MOST_ROWS))))
    held = lambda rdd: rdd.persist(StorageLevel.MEMORY_AND_DISK)  # noqa: E731 what is lost is found again from the table
    blocks, older = held(table.repartition(tasks).rdd.map(tuple)), []
    for number in range(settings.rounds):
        seen = held(seen_by(blocks, booster, number, settings))
        booster.trees.append(grow(lambda tree, nodes: added_up(seen, booster, tree, nodes), looked_at(features, number, settings), settings))  # noqa: B023
        seen.unpersist()
        for old in older:  # nothing is read from these any more, as the tree that was just grown read what came after them
            old.unpersist()
        older, blocks = [blocks], held(with_tree(blocks, booster))
        if (number + 1) % REFRESH == 0 and number + 1 < settings.rounds:
            table = _written(table.sparkSession.createDataFrame(blocks, BLOCK))
            older.append(blocks)
            blocks = held(table.repartition(tasks).rdd.map(tuple))
    for old in (*older, blocks):
        old.unpersist()
    return booster


class BoostedTrees(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted booster as a Spark ML model: from the vector ``_x`` to ``prediction``, and ``probability`` of a 0/1 label."""

    booster = Param(Params._dummy(), "booster", "the trees as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, booster: str = ""):
        super().__init__()
        self._set(booster=booster)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = dataset.sparkSession.sparkContext.broadcast(self.getOrDefault(self.booster))
        chance = Booster.of(held.value).chance
        parsed: list[Booster] = []

        def score(x: pd.Series) -> pd.Series:
            if not parsed:
                parsed.append(Booster.of(held.value))
            return pd.Series(parsed[0].scores(np.stack(x.to_numpy()))) if len(x) else pd.Series([], dtype="float64")

        scored = dataset.withColumn("prediction", F.pandas_udf(score, "double")(vector_to_array("_x")))
        if not chance:
            return scored
        p = 1 / (1 + F.exp(-F.col("prediction")))
        return scored.withColumn("probability", array_to_vector(F.array(1 - p, p))).withColumn("prediction", (p >= 0.5).cast("double"))
