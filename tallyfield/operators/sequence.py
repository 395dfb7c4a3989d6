"""Windows over an entity's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(rows: DataFrame, name: str, order: Column, k: int = 5, id: str = "pred_id") -> DataFrame:
    """The first ``k`` rows in ``order`` as a named list. The limit comes first, so the ranking sees ``k`` rows."""
    first = rows.orderBy(order, id).limit(k).select(id, F.row_number().over(W.orderBy(order, id)).alias("k"))
    return first.select(F.lit(name).alias("list"), id, "k")


def history(keys: list[str], order: list[str], before: int | None = None) -> W:
    """The rows before the current one: all, or the last ``before``."""
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding if before is None else -before, -1)


def form(rows: DataFrame, value: str, into: str, last: int, keys: list[str], order: list[str]) -> DataFrame:
    """Mean of the last values before each row."""
    return rows.withColumn(into, F.avg(value).over(history(keys, order, last)))


def rest_days(rows: DataFrame, at: str, keys: list[str], order: list[str], most: int = 21, default: int = 14) -> DataFrame:
    """Whole days since the row before, at most ``most``; ``default`` for the first (``least`` alone would skip its null); and the number of rows before."""
    last = F.lag(at).over(W.partitionBy(*keys).orderBy(*order))
    days = F.floor(F.timestamp_diff("SECOND", last, F.col(at)) / 86400)
    return rows.withColumn("rest", F.when(days.isNull(), default).otherwise(F.least(days, F.lit(most))).cast("long")).withColumn("prior", F.count("*").over(history(keys, order)))


def starter_share(rows: DataFrame, keys: list[str], order: list[str], starter: str, attempts: str) -> DataFrame:
    """Share of all attempts so far by the starter so far (1 if none), and whether the last two starters differ."""
    own = F.sum(attempts).over(W.partitionBy(*keys, starter).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    every = F.sum(attempts).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    before = F.lag(starter).over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("share", F.when(every > 0, own / every).otherwise(1.0)).withColumn("changed", F.coalesce((F.col(starter) != before).cast("int"), F.lit(0)))


def latest_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def islands(rows: DataFrame, keys: list[str], order: list[str], by: str, into: str = "island") -> DataFrame:
    """Number of the run of equal values of ``by`` within each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = (~F.col(by).eqNullSafe(F.lag(by).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    return rows.withColumn("_new", new).withColumn(into, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
