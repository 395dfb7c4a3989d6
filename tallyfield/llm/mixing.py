"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, three rounds long at most. A copy's virtual
finish time is the number of words its queue has given with it, divided by the source's target. The mix is
the start of the range of all copies by finish time, cut where its words would pass the total budget.

Nothing is sorted in one task. Running sums are split: a source's shuffle keys fall into ranges of about a
thousand documents, the ranges into coarse ones of about the square root of their number, and windows run inside
either only. The global order is a range sort in two levels: bins of finish time, of fixed number, whose sums
show the bin where the budget ends; and that bin's copies, sorted over as many range partitions as a shuffle has,
whose sums show the one partition where the order is cut.

Targets: weights 5, 2, 1 repeat over the sources by code point, null last, and share the sum of all sizes; a
target stops at three times its source's size and the excess is shared again by weight. The level at which
that ends is the greatest of the levels that stopping the first k sources, by size over weight, would need.

Cases: a null text has no words; documents of no words take nothing. Rows that share an id, or have none, are numbered by
source, size and text; the shuffle key is that of id and number, so each has a place of its own in the order and they are spread over it.
Numbering is by range partitions with offsets, so an id on very many rows isn't held by one task. An empty table gives an empty mix.
``mix`` reads no columns beyond ``doc_id``, ``source`` and the text; ``take`` passes all through, and its result columns replace those of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import land, table

WEIGHTS = (5, 2, 1)
ROUNDS = 3
RANGE_ROWS = 1000


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, n, rank and target of each source. Their number is that of a catalogue, not of documents."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    every = W.partitionBy()
    ranked = by.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (1 + (F.col("rank") - 1) % len(WEIGHTS)).cast("int")).cast("long")
    ranked = ranked.withColumn("w", weight)
    before = W.orderBy(F.col("source_size") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    stopped = F.coalesce(F.sum(ROUNDS * F.col("source_size")).over(before), F.lit(0))
    level = (F.sum("source_size").over(every) - stopped) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(every))
    target = F.least((ROUNDS * F.col("source_size")).cast("double"), F.col("level") * F.col("w"))
    return ranked.select("source", "source_size", "n", "rank", target.alias("target"))


def _finish(k: int) -> Column:
    return (F.col("done") + k * F.col("source_size")) / F.col("target")


def _bin(finish: Column) -> Column:
    """4,096 bins below two, and 64 for each doubling beyond."""
    return F.when(finish < 2, F.floor(finish * 2048)).otherwise(4096 + F.floor(F.log2(finish) * 64)).cast("long")


def _sums_before(sums: DataFrame) -> DataFrame:
    """rank, range and ``_before``, the sum of the source's ranges before."""
    inside, above = W.partitionBy("rank", "coarse").orderBy("range"), W.partitionBy("rank").orderBy("coarse")
    so_far = [F.sum("_sum").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum") for w in (inside, above)]
    coarse = sums.groupBy("rank", "coarse").agg(F.sum("_sum").alias("_sum")).select("rank", "coarse", so_far[1].alias("_above"))
    fine = sums.select("rank", "coarse", "range", so_far[0].alias("_within"))
    return fine.join(coarse, ["rank", "coarse"]).select("rank", "range", (F.col("_above") + F.col("_within")).alias("_before"))


def _last_within(edge: DataFrame, order: tuple[str, ...], room: int) -> Row | None:
    """The last row of ``edge`` in ``order`` up to which sizes sum to at most ``room``."""
    parts = int(edge.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = land(edge.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "edge")
    upto = ranged.groupBy("part").agg(F.sum("size").alias("s")).withColumn("upto", F.sum("s").over(W.orderBy("part")))
    cut = upto.where(F.col("upto") > room).orderBy("part").select("part", (F.col("upto") - F.col("s")).alias("before")).first()
    down = [F.col(c).desc() for c in order]
    if cut is None:
        return ranged.orderBy(*down).select(*order).first()
    mine = ranged.where(F.col("part") == cut["part"]).withColumn("s", F.sum("size").over(W.orderBy(*order)))
    last = mine.where(F.col("s") + F.lit(cut["before"]) <= room).orderBy(*down).select(*order).first()
    return last or ranged.where(F.col("part") < cut["part"]).orderBy(*down).select(*order).first()


def _numbered(sized: DataFrame) -> DataFrame:
    """``sized`` with ``number``, from 1 within each doc_id (null is one), and the shuffle ``key`` of both."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("number") > 1, F.concat(F.lit(":"), F.col("number").cast("string"))).otherwise(""))
    key = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long").alias("key")
    if sized.groupBy("doc_id").count().where("count > 1").isEmpty():
        numbered = sized.withColumn("number", F.lit(1).cast("long"))
    else:
        parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = [F.col("source").asc_nulls_last(), "size", "hash", "row"]
        ranged = land(sized.repartitionByRange(parts, "doc_id", *order).withColumn("part", F.spark_partition_id()), "ranged")
        counts = ranged.groupBy("doc_id", "part").agg(F.count("*").alias("c"))
        counts = counts.withColumn("before", F.sum("c").over(W.partitionBy("doc_id").orderBy("part")) - F.col("c")).where("before > 0")
        counts = counts.select(F.col("doc_id").alias("_id"), F.col("part").alias("_part"), "before")  # of ids that cross a border, so fewer than parts
        local = F.row_number().over(W.partitionBy("part", "doc_id").orderBy(*order)).cast("long")
        joined = ranged.withColumn("local", local).join(F.broadcast(counts), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part")), "left")
        numbered = joined.withColumn("number", F.col("local") + F.coalesce("before", F.lit(0)))
    return land(numbered.select("row", "doc_id", "source", "size", "number", key), "sized")


def _counted(prefix: str, text: str) -> list[Column]:
    body = f"{prefix}`{text}`"
    return [F.col(f"{prefix}doc_id").alias("doc_id"), F.col(f"{prefix}source").alias("source"), size_of(body).alias("size"), F.xxhash64(F.col(body)).alias("hash")]


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    return _mixed(land(docs.select(*_counted("", text), F.monotonically_increasing_id().alias("row")), "counted")).drop("row")


def take(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole, with ``copies`` and the words ``taken``."""
    names = [c for c in docs.columns if c.lower() not in ("copies", "taken")]
    rows = land(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    taken = _mixed(rows.select(*_counted("doc.", text), "row"))
    return rows.hint("merge").join(taken.where("copies > 0").select("row", "copies", "taken"), "row").select(*(F.col(f"doc.`{c}`").alias(c) for c in names), "copies", "taken")


def _mixed(counted: DataFrame) -> DataFrame:
    sized = _numbered(counted)
    targets = land(source_targets(sized), "targets")
    rows = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.n", "t.rank", "t.target")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / RANGE_ROWS))).cast("int")
    rows = rows.withColumn("range", F.call_function("shiftright", F.col("key"), 60 - bits))
    sums = _sums_before(rows.groupBy("rank", "range", F.call_function("shiftright", F.col("range"), F.ceil(bits / 2).cast("int")).alias("coarse")).agg(F.sum("size").alias("_sum")))
    inside = F.sum("size").over(W.partitionBy("rank", "range").orderBy("key", "doc_id", "number"))
    rows = rows.withColumn("_inside", inside).join(sums, ["rank", "range"]).withColumn("done", F.col("_before") + F.col("_inside"))
    queued = land(rows.select("row", "doc_id", "source", "size", "source_size", "target", "rank", "key", "number", "done"), "queued")

    budget = sized.agg(F.sum("size")).first()[0] or 0
    live = queued.where("size > 0").withColumn("k", F.explode(F.array(*map(F.lit, range(ROUNDS)))))
    copies = live.withColumn("finish", (F.col("done") + F.col("k") * F.col("source_size")) / F.col("target")).withColumn("bin", _bin(F.col("finish")))
    bins = copies.groupBy("bin").agg(F.sum("size").alias("s")).withColumn("upto", F.sum("s").over(W.orderBy("bin")))
    cut = bins.where(F.col("upto") > budget).orderBy("bin").select("bin", (F.col("upto") - F.col("s")).alias("before")).first()
    taken = F.lit(0)
    if cut is None:
        taken = F.lit(ROUNDS)
    else:
        order = ("finish", "rank", "key", "doc_id", "number", "k")
        last = _last_within(copies.where(F.col("bin") == cut["bin"]).select(*order, "size"), order, budget - cut["before"])
        for k in range(ROUNDS):
            finish = _finish(k)
            whole = _bin(finish) < cut["bin"]
            if last is not None:
                mine = F.struct(finish.alias("a"), F.col("rank").alias("b"), F.col("key").alias("c"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.col("number").alias("e"), F.lit(k).alias("f"))
                its = F.struct(F.lit(last["finish"]).alias("a"), F.lit(last["rank"]).alias("b"), F.lit(last["key"]).cast("long").alias("c"), F.lit(-(2**63) if last["doc_id"] is None else last["doc_id"]).cast("long").alias("d"), F.lit(last["number"]).cast("long").alias("e"), F.lit(last["k"]).alias("f"))
                whole = whole | ((_bin(finish) == cut["bin"]) & (mine <= its))
            taken = taken + whole.cast("int")
    out = queued.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(0).cast("int"))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op10_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op10_fair_queue_mix": op10_fair_queue_mix}
ORACLE = {
    "op10_fair_queue_mix": r"""
WITH e AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source NULLS LAST, size) AS number FROM e),
d AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN number > 1 THEN ':' || number ELSE '' END), 1, 15) AS BIGINT) AS key FROM f),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
      FROM w WINDOW b AS (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, rank, least((3 * source_size)::DOUBLE, max(level) OVER () * w) AS target FROM l),
q AS (SELECT d.*, source_size, rank, target, sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id, number)::BIGINT AS done
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, k, (done + k * source_size) / target AS finish FROM q, (VALUES (0), (1), (2)) AS r(k) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, key, doc_id, number, k) AS upto FROM c),
n AS (SELECT doc_id, number, count(*) AS copies FROM o WHERE upto <= (SELECT sum(size) FROM d) GROUP BY doc_id, number)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target, CAST(coalesce(n.copies, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id AND q.number = n.number
"""
}
