"""Benchmark decontamination with suffix arrays of the training shards.

A shard is a bounded run of documents of one partition. Its words become numbers (those of the benchmark
block; all others one number that matches nothing) and its suffix array is built: the positions whose first
words can match at all, sorted by the words that follow, up to the window's length. Every test suffix is
binary-searched in it, so each finds the range of shard suffixes that begin with it. Hits on one diagonal
(document position minus item position) join to verbatim matches; the longest for each document and item is
kept with its place. No row is shuffled: shards are searched where they are read.

The benchmark's suffixes are sorted by Spark in blocks of about ``block_chars`` characters, which are written to the shared folder once. There
is one pass over the documents, whatever the size of the benchmark: a task searches each shard for one block after the other. Blocks stay in
a task's memory while they have at most ``HELD`` bytes in all, and are read again for each shard beyond.

Cases: a null text or item has no words; an item of fewer words than the window is one window. Items of
equal id count once in ``items``; a null id is left out. Repeated documents are treated each by itself. An
empty benchmark finds nothing. Other columns pass through; ``n_words``, ``hits``, ``matches`` replace
columns of those names.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bounded_batches, files_of, groups_of, land, set_aside, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("item_start", T.LongType()), T.StructField("words", T.LongType())])
RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def words(text: str | None) -> list[str]:
    """Lower-cased A to Z; runs of letters, digits and all beyond ASCII."""
    return WORD.findall((text or "").translate(_UPPER) if not (text or "").isascii() else (text or "").lower())


class Tests:
    """The suffixes of a block of items, as keys: the words' numbers, big end first, 16 bits each, or 32 where those don't hold them."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window, self.number = window, {}
        starts: dict[bytes, list[tuple[int, int]]] = {}
        self.ids = [i for i, _ in items]
        every = [[self.number.setdefault(w, len(self.number) + 1) for w in words(text)] for _, text in items]
        self.kind = np.dtype(">u2" if len(self.number) < 1 << 16 else ">u4")
        self.shift = 8 * self.kind.itemsize
        for k, coded in enumerate(every):
            if coded:
                array = np.array(coded, dtype=self.kind)
                for j in range(max(1, len(coded) - window + 1)):
                    starts.setdefault(array[j : j + window].tobytes(), []).append((k, j))
        keys = sorted(starts)
        self.length = np.array([len(k) // self.kind.itemsize for k in keys], dtype=np.int64)
        flat = [x for k in keys for x in starts[k]]
        self.item, self.at = np.array([x[0] for x in flat], dtype=np.int64), np.array([x[1] for x in flat], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(starts[k]) for k in keys])]).astype(np.int64)
        wide = self.kind.itemsize * window
        self.low = np.array([k.ljust(wide, b"\0") for k in keys], dtype=f"S{wide}")
        self.high = np.array([k.ljust(wide, b"\xff") for k in keys], dtype=f"S{wide}")
        self.short = int(self.length.min()) if keys else 0
        self.pair = np.array(sorted({int.from_bytes(k[: 2 * self.kind.itemsize], "big") for k in keys}), dtype=np.int64)

    def search(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the shard, numbers of the test suffixes) of all matches. ``coded`` ends with ``window`` zeros."""
        n = len(coded) - self.window
        some = np.nonzero(coded[:n])[0]
        if self.short >= 2:
            some = some[np.isin(coded[some].astype(np.int64) << self.shift | coded[some + 1], self.pair)]
        if not len(some):
            return some, some
        big = coded.astype(self.kind)
        keys = np.ascontiguousarray(big[some[:, None] + np.arange(self.window)]).view(f"S{self.kind.itemsize * self.window}").ravel()
        order = np.argsort(keys, kind="stable")  # the suffix array of the shard
        array, keys = some[order], keys[order]
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        return array[np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(which))], which


def shard_matches(texts: list[list[str]], tests: Tests):
    """For each text, given as its words: hit ranges of words, and longest match for each item."""
    coded, sizes = [], []
    get = tests.number.get
    for ws in texts:
        sizes.append(len(ws))
        coded += [get(w, 0) for w in ws]
        coded.append(0)
    coded += [0] * tests.window
    start = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64) + 1)])
    hits, matches = [[] for _ in texts], [[] for _ in texts]
    if not len(tests.length):
        return hits, matches
    at, which = tests.search(np.array(coded, dtype=tests.kind.newbyteorder("=")))
    doc = np.searchsorted(start, at, "right") - 1
    order = np.lexsort((tests.length[which], at))
    last = -1
    for p, d, n in zip(at[order].tolist(), doc[order].tolist(), tests.length[which[order]].tolist()):
        p -= int(start[d])
        if d == last and p <= hits[d][-1][1]:
            hits[d][-1][1] = max(hits[d][-1][1], p + n)
        else:
            hits[d].append([p, p + n])
        last = d
    count = tests.first[which + 1] - tests.first[which]  # a test suffix may stand in several items
    spot = np.repeat(tests.first[which] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    doc, pos, item, off, size = np.repeat(doc, count), np.repeat(at, count), tests.item[spot], tests.at[spot], np.repeat(tests.length[which], count)
    order = np.lexsort((pos, pos - off, item, doc))
    doc, pos, item, off, size = (x[order] for x in (doc, pos, item, off, size))
    if len(doc):
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - off[1:] != pos[:-1] - off[:-1]) | (pos[1:] != pos[:-1] + 1)
        head = np.nonzero(new)[0]
        end = np.append(head[1:], len(doc)) - 1
        long = pos[end] + size[end] - pos[head]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, i, p, o, n in zip(doc[head].tolist(), item[head].tolist(), pos[head].tolist(), off[head].tolist(), long.tolist()):
            if n > best.get((d, i), (0,))[0]:
                best[d, i] = (n, p - int(start[d]), o)
        for (d, i), (n, p, o) in best.items():
            matches[d].append((tests.ids[i], p, o, n))
    return hits, matches


HELD = 64_000_000


def blocks(benchmark: DataFrame, window: int, block_chars: int) -> list[str]:
    """The files of the test suffixes, a block in each row. One item longer than the bound is a block of its own."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0

    def build(batches):
        held, size = [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and size + len(text) > block_chars:
                    yield pack(held)
                    held, size = [], 0
                held.append((i, text))
                size += len(text)
        if held:
            yield pack(held)

    def pack(held):
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Tests(held, window))], type=pa.binary())], names=["data"])

    return files_of(land(items.repartition(max(1, -(-chars // block_chars))).mapInArrow(build, "data binary"), "test-suffixes", **{"parquet.block.row.count.limit": "1"}))


def _each(files: list[str]):
    """A function that gives all blocks one after the other, anew for each call."""
    kept, size = [], 0

    def read():
        for path in files:
            for group in groups_of(path):
                yield from (x.as_py() for x in group("data").column(0))

    for data in read():
        size += len(data)
        if size > HELD:
            return lambda: map(pickle.loads, read())
        kept.append(data)
    tests = [pickle.loads(data) for data in kept]
    return lambda: tests


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 1_000_000, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (ranges of hit words, in order, not touching) and ``matches`` (the longest
    for each item with its place)."""
    added = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(RANGE)), T.StructField("matches", T.ArrayType(MATCH))]
    rest = [f for f in docs.schema.fields if f.name.lower() not in {"n_words", "hits", "matches"}]
    schema, place = T.StructType(rest + added), [f.name for f in rest].index(text)
    names = [f.name for f in schema.fields]
    kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())])))
    files = blocks(benchmark, window, block_chars)

    def run(batches):
        every = _each(files)
        for batch in bounded_batches(batches, rows=4096, chars=4_000_000, column=place):
            shard = [words(t) for t in batch.column(place).to_pylist()]
            hits, matches = [[] for _ in shard], [[] for _ in shard]
            for tests in every():
                more = shard_matches(shard, tests)
                hits, matches = ([a + b for a, b in zip(old, new)] for old, new in zip((hits, matches), more))
            cells = ([len(w) for w in shard], [[{"start": a, "end": b} for a, b in _union(h)] for h in hits], [[dict(zip(("item_id", "start", "item_start", "words"), x)) for x in _longest(m)] for m in matches])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, type=k) for c, k in zip(cells, kinds))], names=names)

    return docs.select(*(F.col(f"`{f.name}`") for f in rest)).mapInArrow(run, schema)


def _union(ranges: list) -> list:
    out: list = []
    for x, y in sorted(ranges):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def _longest(found: list) -> list:
    best: dict = {}
    for x in found:
        if x[0] is not None and (x[0] not in best or (-x[3], x[1]) < (-best[x[0]][3], best[x[0]][1])):
            best[x[0]] = x
    return [best[i] for i in sorted(best)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """``docs`` without those that hold a window of the benchmark."""
    rows, back = set_aside(docs, {"n_words", "hits", "matches"})
    return back(find_matches(rows, benchmark, window, text=text).where(F.size("hits") == 0))


def op2_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    items = F.array_sort(F.transform("matches", lambda m: m["item_id"]))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("matches").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


QUERIES, ORACLE = {"op2_suffix_decontamination": op2_suffix_decontamination}, {}
