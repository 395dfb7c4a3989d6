"""Near-duplicates by SimHash: an inverted index of positional bytes with count filtering.

A fingerprint has eight positional bytes. Two that differ in at most four bits differ in at most four bytes, so
they share at least four: that is the guaranteed minimum. Lists of single (position, byte) pairs would hold a
256th of all fingerprints each, so pairs would grow with the square of the input. The index therefore lists
three positions at a time, all 56 triples: a list has but a 2**24th of unrelated fingerprints, and a pair that shares
the positions of a set S meets in the lists of all triples within S. A posting is the whole fingerprint, so where a pair meets its shared positional bytes are
tallied at once; pairs with a tally under four go, those of a triple alone; the others are verified by counting bits. All three steps are taken in the list,
so that no pair moves before it is a link.

Only distinct fingerprints are indexed: exact copies cost nothing. Lists of over ``SHORT`` members come from dense groups and aren't
spelled out in pairs: such a list is searched breadth-first, each fingerprint meeting only those not reached yet, with the same tally
and check, and gives one link less than it has members at most. Lists of over ``LONG`` members are dealt out in chunks by hash, each
pair of chunks a list of its own, so no task holds a long list. A pair that meets in a long list is tallied there in full, so it isn't lost
if it meets in short ones too.

Cases: a null or empty text has fingerprint zero and is linked like any other. A null id takes no part in
the smallest id of its component; if all ids of a component are null, so is its component id. Repeated rows are
copies. Columns that clash with names used here are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .groups import components, grouped, keep_heads, row_keys, units
from .store import SMALL_TABLE, bounded_batches, join_hot, land, table

SHINGLE = 4
BITS = 4
SHORT = 32
LONG = 4096

TRIPLES = tuple(combinations(range(8), 3))


def fingerprints_of(texts: list[bytes | None]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    for k, text in enumerate(texts):
        words = (text or b"").lower().split()
        n = max(1, len(words) - SHINGLE + 1) if words else 0
        if not n:
            continue
        total, step = np.zeros(64, dtype=np.int64), 100_000
        for a in range(0, n, step):
            part = words[a : a + step + SHINGLE - 1]
            shingles = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
            h = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), dtype="<u8")
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * total > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, k1, k2 (row keys) and unit, the fingerprint as a long."""

    def run(batches):
        for batch in bounded_batches(batches, column=3):
            fp = fingerprints_of(batch.column(3).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp.view(np.int64))], names=["doc_id", "k1", "k2", "unit"])

    rows = docs.select("doc_id", *row_keys(text), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, rows.drop("text").schema.add("unit", "long"))


def forest(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links that join all members of a list which are joined by pairs of at most ``bits`` differing bits."""
    links, rest = [], np.unique(fps)
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            differ = rest ^ x
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            near = shared >= 8 - bits
            near[near] = np.bitwise_count(differ[near]) <= bits
            if near.any():
                links += [(int(x), int(y)) for y in rest[near]]
                front += list(rest[near])
                rest = rest[~near]
    return links


def _links_of_lists(batches, bits: int):
    """Lists arrive sorted by key; one is held at a time."""
    held_key, held = None, []

    def flush():
        links = forest(np.concatenate(held), bits) if held and sum(map(len, held)) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array(np.array([x[i] for x in links], dtype=np.uint64).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)])
        fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.nonzero((key[:, 1:] != key[:, :-1]).any(0))[0] + 1
        size = np.diff(np.concatenate([[0], cuts, [len(fp)]]))
        starts = np.concatenate([[0], cuts])
        last = len(starts) - 1
        for j in np.nonzero((size > 1) | (np.arange(len(size)) == 0) | (np.arange(len(size)) == last))[0]:
            mine = tuple(key[:, starts[j]])
            if mine != held_key:
                if held:
                    yield flush()
                held_key, held = mine, []
            held.append(fp[starts[j] : starts[j] + size[j]])
    if held:
        yield flush()


#: How many positional bytes two fingerprints share, as SQL.
TALLY = "(" + " + ".join(f"IF((a ^ b) & {255 << 8 * p if p < 7 else -(1 << 56)} = 0, 1, 0)" for p in range(8)) + ")"


def steps(bits: int) -> tuple[str, str]:
    """What a pair that meets must pass, in order: its tally reaches the guaranteed minimum, and its bits are counted."""
    return f"{TALLY} >= {8 - bits}", f"bit_count(a ^ b) <= {bits}"


def met(lists: DataFrame, *passes: str) -> DataFrame:
    """Different pairs (a, b) that meet in short lists (members) and pass, tested in the lists."""
    test = " AND ".join(passes) or "true"
    rows = lists.select(F.posexplode("members").alias("i", "a"), "members")
    return rows.select("a", F.explode(F.expr(f"filter(slice(members, i + 2, size(members)), b -> {test})")).alias("b")).distinct()


def short_lists(held: DataFrame, short: int) -> DataFrame:
    return held.where(F.col("n") <= short).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("members"))  # at most ``short`` of each


def indexed(fps: DataFrame) -> DataFrame:
    """(key, fp, n): the postings of lists of more than one, with the length of their list."""
    byte = lambda p: F.call_function("shiftrightunsigned", F.col("fp"), F.lit(8 * p)).bitwiseAND(F.lit(255))
    keys = [F.lit(i << 24).cast("long") + byte(t[0]) * 65536 + byte(t[1]) * 256 + byte(t[2]) for i, t in enumerate(TRIPLES)]
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    size = land(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    return land(postings.join(F.broadcast(size) if size.count() <= SMALL_TABLE else size, "key"), "postings")


def links(fps: DataFrame, bits: int = BITS, short: int = SHORT, long: int = LONG) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``fps`` (fp long), enough to join all that are joined."""
    if bits > 4:
        raise ValueError("four shared positions, which name themselves by triples, are sure for at most four differing bits")
    held = indexed(fps)
    few = met(short_lists(held, short), *steps(bits))

    zero = F.lit(0).cast("long")
    chunks = F.ceil(F.col("n") / (long // 2)).cast("long")
    mine, whole = F.pmod(F.xxhash64("fp"), chunks), F.col("n") <= long
    other = F.explode(F.when(whole, F.array(zero)).otherwise(F.sequence(zero, chunks - 1)))
    spread = held.where(F.col("n") > short).select("fp", "key", F.when(whole, zero).otherwise(mine).alias("mine"), other.alias("other"))
    dense = spread.select("key", F.least("mine", "other").alias("c"), F.greatest("mine", "other").alias("d"), "fp")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = dense.repartition(parts, "key", "c", "d").sortWithinPartitions("key", "c", "d").mapInArrow(lambda it: _links_of_lists(it, bits), "a long, b long")
    return few.unionByName(many)


def _known(docs: DataFrame, text: str, bits: int, short: int, long: int) -> tuple[DataFrame, DataFrame]:
    marked = land(fingerprints(docs, text), "fingerprints")
    one = units(marked)
    return marked, grouped(one, links(one.select(F.col("unit").alias("fp")), bits, short, long))


def near_groups(docs: DataFrame, text: str = "text", bits: int = BITS, short: int = SHORT, long: int = LONG) -> DataFrame:
    """doc_id, fp and component_id, the smallest id that links lead to."""
    marked, known = _known(docs, text, bits, short, long)
    return join_hot(marked.select("doc_id", "unit"), known, "unit").select("doc_id", F.col("unit").alias("fp"), F.col("head.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, text: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id, null last; of equal ids that of the smallest hash."""
    return keep_heads(docs, *_known(docs, text, bits, SHORT, LONG), text)


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES, ORACLE = {"op7_simhash_groups": op7_simhash_groups}, {}
