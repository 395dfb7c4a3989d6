"""Walk-forward folds, weights by age, and resampling by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(rows: DataFrame, share: float, most: int | None, least: int | None = None, at: str = "kickoff", id: str = "game_id") -> DataFrame:
    """The newest rows: a share of all, at most or at least so many. ``id`` tells rows apart."""
    return split_newest(rows, share, most, least, at, id)[1]


def split_newest(rows: DataFrame, share: float, most: int | None, least: int | None = None, at: str = "kickoff", id: str = "game_id") -> tuple[DataFrame, DataFrame]:
    """The older rows and the newest ones, which begin with one row, so that both are filters. The day of the cut is found by counts of days, and only its rows are sorted."""
    n = rows.count()
    k = int(n * share)
    k = min(k, most) if most is not None else k
    k = min(n, max(k, least)) if least is not None else k
    day = F.to_date(at)
    counts = rows.groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(W.orderBy(F.desc("_day"))))
    cut = upto.where(F.col("_upto") >= k).orderBy(F.desc("_day")).select("_day", (F.col("_upto") - F.col("_n")).alias("_before")).first()
    if k <= 0 or cut is None:
        none = rows.limit(0)
        return (rows, none) if k <= 0 else (none, rows)
    last = rows.where(day.eqNullSafe(F.lit(cut["_day"]))).select(F.col(at).alias("_at"), F.col(id).alias("_id")).orderBy(F.desc("_at"), F.desc("_id")).limit(k - cut["_before"])
    first = last.orderBy("_at", "_id").select(F.col("_at").cast("string"), "_id").first()
    if first["_at"] is None:  # rows without a time are the oldest
        new = F.col(at).isNotNull() | (F.col(id) >= F.lit(first["_id"]))
    else:
        start = F.lit(first["_at"]).cast(rows.schema[at].dataType)
        new = F.coalesce((F.col(at) > start) | ((F.col(at) == start) & (F.col(id) >= F.lit(first["_id"]))), F.lit(False))
    return rows.where(~new), rows.where(new)


def folds(rows: DataFrame, n: int, share: float = 0.45, most: int = 3000, at: str = "kickoff", id: str = "game_id") -> DataFrame:
    """The evaluation window, at most ``most`` rows, in ``n`` blocks of near-equal size in time order."""
    return newest(rows, share, most, at=at, id=id).withColumn("fold", F.ntile(n).over(W.orderBy(at, id)) - 1)


def training_sizes(rows: DataFrame, blocks: DataFrame, at: str = "kickoff", avail: str = "avail") -> DataFrame:
    """For each fold its first start, its size, and how many rows were available by then."""
    starts = blocks.groupBy("fold").agg(F.min(at).alias("start"), F.count("*").alias("n_test"))
    joined = rows.select(avail).join(F.broadcast(starts), F.col(avail) <= F.col("start"))
    return starts.join(joined.groupBy("fold").agg(F.count("*").alias("n_train")), "fold", "left").fillna(0, ["n_train"])


def recency(rows: DataFrame, half_life_days: float, at: str = "kickoff") -> DataFrame:
    """``weight``: halved for each half-life of age from the newest row."""
    latest = rows.agg(F.max(at).alias("_latest"))
    age = F.timestamp_diff("SECOND", F.col(at), F.col("_latest")) / 86400
    return rows.join(F.broadcast(latest)).withColumn("weight", F.pow(F.lit(0.5), age / half_life_days)).drop("_latest")


def hashed_integer(*parts) -> Column:
    """An integer below 2^60 from the MD5 hash of the parts, as text joined by colons."""
    text = F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def block_bootstrap(gains: DataFrame, reps: int, block: str = "week", seed: int = 42) -> DataFrame:
    """Interval and p of the mean gain, drawing blocks with replacement. A draw is the hash of seed, repeat and place, taken modulo the number of
    blocks: draws are independent of each other, and a rerun draws alike. The tables hold one row per block, not per observation."""
    w = gains.groupBy(block).agg(F.sum("gain").alias("s"), F.count("*").alias("n"))
    w = w.withColumn("i", F.row_number().over(W.orderBy(block)) - 1).withColumn("k", F.count("*").over(W.partitionBy()))
    each = w.select("i", "k", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    drawn = each.select("rep", (hashed_integer(F.lit(seed), "rep", "i") % F.col("k")).alias("i"))
    boots = drawn.join(w.select(F.col("i").cast("long").alias("i"), "s", "n"), "i").groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("gain"))
    return boots.agg(F.percentile("gain", F.lit(0.05)).alias("low"), F.percentile("gain", F.lit(0.95)).alias("high"), F.avg((F.col("gain") <= 0).cast("double")).alias("p_value"), F.count("*").alias("reps"))
