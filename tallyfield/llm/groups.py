"""Groups of rows that links join, and the choice of one row of each group.

A row belongs to a unit (a fingerprint, or a set of shingles), and links join units. A row is told from others by two
64-bit hashes of its id and text, so rows of one id with different texts, and rows without id, count by themselves.

No key is left hot: counts of rows for each key are made by partial aggregates, and ``join_hot`` broadcasts the few keys that hold
over a ``MOST``th of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import SMALL_TABLE, join_hot, land


def row_keys(text: str) -> list[Column]:
    """``k1`` and ``k2``: hashes of a row's text, and of its id and text."""
    return [F.xxhash64(F.col(f"`{text}`")).alias("k1"), F.xxhash64(F.lit(1), F.col("doc_id"), F.col(f"`{text}`")).alias("k2")]


def components(edges: DataFrame) -> DataFrame:
    """node and root of every node that has an edge (a, b): equal roots are joined.

    By contraction: each node joins the smallest of its neighbours, pointers are shortened once, edges are renamed, until none is left.
    """

    def tidy(e):
        return land(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    def follow(rows, by, moved):
        """``rows`` with ``by`` replaced by what ``moved`` (node, up) says of it, where it says something."""
        moved = moved.withColumnRenamed("node", by)
        if moved.count() <= SMALL_TABLE:
            found = rows.join(F.broadcast(moved), by, "left").withColumn("to", F.coalesce("up", by))
        else:
            counts = rows.groupBy(by).agg(F.count("*").alias("n"))
            found = join_hot(rows, land(counts.join(moved, by, "left").select(by, "n", F.coalesce("up", by).alias("to")), "moves"), by)
        return found.withColumn(by, F.col("to")).select(*rows.columns)

    e, labels = tidy(edges), None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = land(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "parents")
        up = land(follow(up.select("node", F.col("up").alias("at")), "at", up).select("node", F.col("at").alias("up")), "parents")
        labels = up.select("node", F.col("up").alias("root")) if labels is None else land(follow(labels, "root", up), "roots")
        e = tidy(follow(follow(e, "a", up), "b", up))
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def units(marked: DataFrame, *more: Column) -> DataFrame:
    """For each unit of ``marked`` (doc_id, k1, k2, unit) its number ``n`` of rows and its ``first`` row: that of the smallest id, null last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2"))
    return land(marked.groupBy("unit").agg(first.alias("first"), F.count("*").alias("n"), *more), "units")


def grouped(units: DataFrame, links: DataFrame) -> DataFrame:
    """unit, first, n, and ``head``: the first row of all units that links (a, b) join with it."""
    roots = land(components(links).select(F.col("node").alias("unit"), "root").join(units.select("unit", "first", "n"), "unit"), "joined")
    heads = land(roots.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("n")), "heads")
    linked = join_hot(roots.select("unit", "root"), heads, "root").select("unit", "head")
    return land(units.select("unit", "first", "n").join(linked, "unit", "left").withColumn("head", F.coalesce("head", "first")), "grouped")


def keep_heads(docs: DataFrame, marked: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """One row of ``docs`` for each group of ``known``. Texts move once, and those of rows repeated very often not at all."""
    heads = land(known.where("first = head").select("first.k1", "first.k2"), "kept")
    counts = land(marked.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    n = marked.count()
    hot = counts.where(F.col("n") > n / 1000).select("k1", "k2")  # fewer than a thousand
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("row"), *row_keys(text))
    cold = keyed.join(F.broadcast(hot), ["k1", "k2"], "left_anti").join(heads.join(F.broadcast(hot), ["k1", "k2"], "left_anti"), ["k1", "k2"], "left_semi")
    often = keyed.join(F.broadcast(hot.join(heads, ["k1", "k2"], "left_semi")), ["k1", "k2"], "left_semi")
    return cold.dropDuplicates(["k1", "k2"]).unionByName(often.dropDuplicates(["k1", "k2"])).select("row.*")
