"""Near copies by the Jaccard similarity of word shingles: candidates from MinHash bands, then exact verification.

A text is the set of its shingles of ``SHINGLE`` words. ``BANDS`` keys of ``ROWS`` minima each are taken of a set; texts
that share a key are candidates, which two of similarity 0.8 miss with chance (1 - 0.8**5)**20 = 0.0004. Each candidate pair that is
taken up is verified on the whole sets of both texts. SimHash can't give these candidates: two texts of similarity 0.8
differ in ten of 64 bits on average, so in most pairs no positional byte is sure to be equal.

Only distinct sets get keys. In a list of at most ``SMALL`` sets all pairs are taken up. A longer one has a leader, the member whose
lists are the longest together (so the lists of one group of copies mostly have one leader, and its pairs count once): all are compared with it, and those not linked to it make up the list's next round with eight times as many leaders, until none is left.
So a list of copies of one text takes one round, and the work is quadratic only in the texts unlike each other of one list. A pair whose
members are told apart by the leaders of all its lists is missed unless others join it; the README has the measured recall.
Sets whose sizes rule out the similarity aren't compared, nor are, in these longer lists,
those that share fewer than ``AGREE`` of all ``BANDS * ROWS`` minima, which sets of similarity 0.8 do with chance 0.0002. The comparisons of one leader are dealt out in parts of ``PART``, each with the leader's text.

Cases: texts of fewer words than a shingle are one shingle; null texts and texts without words are copies of each
other. Rows of one id with different texts, and rows of null id, belong to the groups of their texts. Of each group one row
stays, that of the smallest id, null last; of equal ids that of the smallest hash. Columns of any other name pass through.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .groups import grouped, keep_heads, row_keys, units
from .store import SMALL_TABLE, bounded_batches, join_hot, land

SHINGLE = 5
SIMILAR = 0.8
BANDS = 20
ROWS = 5
AGREE = 65
SMALL = 8
PART = 256

_ODD = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles_of(text: bytes | None) -> np.ndarray:
    """The distinct shingles as sorted hashes."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(11)), dtype=np.uint64))


def keys_of(shingles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sets, bands) keys of sets that aren't empty, and a byte of each of their minima."""
    every, start = np.concatenate(shingles), np.cumsum([0, *map(len, shingles[:-1])])
    out, minima = np.empty((len(shingles), BANDS), dtype=np.uint64), np.empty((len(shingles), BANDS * ROWS), dtype=np.uint8)
    for band in range(BANDS):
        key = np.full(len(shingles), band, dtype=np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat(every * _ODD[k], start)
            minima[:, k] = least & np.uint64(255)
            key = (key ^ least) * _MIX
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out, minima


def marks(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, k1, k2 (row keys), unit (id of the shingle set), its size, keys and minima."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for batch in bounded_batches(batches, column=3):
            sets = [shingles_of(t) for t in batch.column(3).cast(pa.binary()).to_pylist()]
            ids = np.fromiter((xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets), dtype=np.uint64, count=len(sets))
            full = [s for s in sets if len(s)]
            found = keys_of(full) if full else None
            keys, minima = (iter(found[0].view(np.int64).tolist()), iter(found[1].view(np.int8).tolist())) if full else (iter([]), iter([]))
            cells = [pa.array(ids.view(np.int64)), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([next(keys) if len(s) else [] for s in sets], type=pa.list_(pa.int64()))]
            cells.append(pa.array([next(minima) if len(s) else [] for s in sets], type=pa.list_(pa.int8())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cells], names=["doc_id", "k1", "k2", "unit", "size", "keys", "minima"])

    rows = docs.select("doc_id", *row_keys(text), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, rows.drop("text").schema.add("unit", "long").add("size", "long").add("keys", T.ArrayType(T.LongType())).add("minima", T.ArrayType(T.ByteType())))


def _bounded(df: DataFrame) -> DataFrame:
    """For the join of a landed table: broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL_TABLE else df


def _verify(batches):
    """Rows arrive sorted: a leader's text, then those to compare with it."""
    lead = None
    for batch in batches:
        a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        found: list[tuple[int, int]] = []
        for i, (other, text) in enumerate(zip(b, batch.column(2).cast(pa.binary()))):
            mine = shingles_of(text.as_py())
            if other is None:
                lead = mine
                continue
            both = len(np.intersect1d(lead, mine, assume_unique=True))
            if both >= SIMILAR * (len(lead) + len(mine) - both) - 1e-9:
                found.append((int(a[i]), other))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=pa.int64()) for i in (0, 1)], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, part: int = PART) -> DataFrame:
    """Those of ``pairs`` (a, b: sets) whose texts (set, text) are similar."""
    spark = pairs.sparkSession
    many = land(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > part), "many-pairs")
    chunk = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / part)))
    dealt = land(pairs.join(_bounded(many), "a", "left").select("a", "b", chunk.cast("long").alias("chunk")), "pairs")
    lead = dealt.select("a", "chunk").distinct().join(texts.withColumnRenamed("set", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "text", "chunk")
    rest = dealt.join(texts.withColumnRenamed("set", "b"), "b").select("a", "b", "text", "chunk")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stacked = lead.unionByName(rest).repartition(parts, "a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").isNotNull())

    def run(batches):
        return _verify(x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256))

    return stacked.mapInArrow(run, "a long, b long")


def _sizes_fit(a: str, b: str):
    """Whether sets of these sizes can be similar at all."""
    return F.least(a, b) >= SIMILAR * F.greatest(a, b) - 1e-9


def links(postings: DataFrame, texts: DataFrame, minima: DataFrame, small: int = SMALL, part: int = PART) -> DataFrame:
    """Links (a, b) between similar sets. ``postings``: the lists, as landed rows (key, set, size)."""
    found, leaders = None, 1
    while not postings.isEmpty():
        lists = land(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
        held = land(postings.join(_bounded(lists), "key"), "held")
        short, long = held.where(F.col("n") <= small).select("key", F.struct("set", "size").alias("set")), held.where(F.col("n") > small)
        each = short.groupBy("key").agg(F.array_sort(F.collect_list("set")).alias("s"))  # at most ``small`` of each
        pair = each.select(F.posexplode("s").alias("i", "a"), "s").select("a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("b"))
        pair = pair.where(_sizes_fit("a.size", "b.size")).select(F.col("a.set").alias("a"), F.col("b.set").alias("b"))
        weights = land(long.groupBy("set").agg(F.sum("n").alias("weight")).join(minima, "set"), "weights")
        long = land(long.join(_bounded(weights), "set").select("key", "set", "size", "weight", "minima"), "long")
        place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("weight"), "set"))
        first = land(long.withColumn("place", place).where(F.col("place") <= leaders).select("key", F.col("set").alias("lead"), F.col("weight").alias("most"), F.col("size").alias("room"), F.col("minima").alias("led")), "leaders")
        after = (F.col("most") > F.col("weight")) | ((F.col("most") == F.col("weight")) & (F.col("lead") < F.col("set")))
        agree = F.aggregate(F.zip_with("minima", "led", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        star = long.join(_bounded(first), "key").where(after & _sizes_fit("size", "room") & (agree >= AGREE)).select(F.col("lead").alias("a"), F.col("set").alias("b"))
        good = land(verified(land(pair.unionByName(star).distinct(), "candidates"), texts, part), "links")
        found = good if found is None else found.unionByName(good)
        led = first.join(good.withColumnRenamed("a", "lead"), "lead").select("key", F.col("b").alias("set"))
        done = first.select("key", F.col("lead").alias("set")).unionByName(led)
        postings = land(long.select("key", "set", "size").join(done, ["key", "set"], "left_anti"), "postings")
        leaders *= 8
    return found if found is not None else postings.select(F.col("key").alias("a"), F.col("set").alias("b"))


def _known(docs: DataFrame, text: str, small: int, part: int) -> tuple[DataFrame, DataFrame]:
    """The marked rows, and each set with its first row, and the first of its group."""
    marked = land(marks(docs, text), "marks")
    one = units(marked, F.any_value("size").alias("size"), F.any_value("keys").alias("keys"), F.any_value("minima").alias("minima"))
    lists = land(one.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-keys")
    postings = land(one.select(F.col("unit").alias("set"), "size", F.explode("keys").alias("key")).join(_bounded(lists), "key").select("key", "set", "size"), "postings")
    wanted = land(one.join(postings.select(F.col("set").alias("unit")).distinct(), "unit", "left_semi").select(F.col("unit").alias("set"), "first.k1", "first.k2", "minima"), "candidate-sets")
    whole = docs.select(F.col(f"`{text}`").alias("text"), *row_keys(text)).join(_bounded(wanted.drop("minima")), ["k1", "k2"]).select("set", "text")
    texts = land(whole.dropDuplicates(["set"]), "candidate-texts")
    return marked, grouped(one, links(postings, texts, wanted.select("set", "minima"), small, part))


def near_groups(docs: DataFrame, text: str = "text", small: int = SMALL, part: int = PART) -> DataFrame:
    """doc_id and component_id, the smallest id that links lead to, of every row."""
    marked, known = _known(docs, text, small, part)
    return join_hot(marked.select("doc_id", "unit"), known, "unit").select("doc_id", F.col("head.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, text: str = "text", small: int = SMALL, part: int = PART) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id."""
    return keep_heads(docs, *_known(docs, text, small, part), text)


def keep_first_of_both(docs: DataFrame, text: str = "text", bits: int = simhash.BITS) -> DataFrame:
    """``docs`` with one row of each group that SimHash links, of fingerprints, and the similarity of sets join together.

    The index of fingerprints, op7's, makes the groups; a set links the groups of its fingerprints, and similar sets link theirs."""
    prints = land(simhash.fingerprints(docs, text), "fingerprints")
    one = units(prints)
    near = simhash.links(one.select(F.col("unit").alias("fp")), bits)
    marked, sets = _known(docs, text, SMALL, PART)
    heads = land(sets.select("unit", "n", F.struct("head.k1", "head.k2").alias("set")), "set-heads")
    of_row = join_hot(marked.select("k1", "k2", "unit"), heads, "unit").select("k1", "k2", "set").distinct()
    met = land(prints.select("k1", "k2", F.col("unit").alias("fp")).distinct().join(of_row, ["k1", "k2"]).select("set", "fp").distinct(), "met")
    least = land(met.groupBy("set").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1"), "set-prints")
    joined = join_hot(met, least, "set").select("a", F.col("fp").alias("b")).where("a <> b")
    return keep_heads(docs, prints, grouped(one, near.unionByName(joined)), text)
