"""Point in time: when facts become known, and what is visible at a cutoff."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def minutes(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n), F.lit(0))


def with_availability(contests: DataFrame, duration: int = 270, at: str = "kickoff", seen: str = "collected") -> DataFrame:
    """``avail``: start and duration in minutes, or the recorded time if that lies between the two."""
    end = F.col(at) + minutes(duration)
    return contests.withColumn("avail", F.when((F.col(seen) > F.col(at)) & (F.col(seen) < end), F.col(seen)).otherwise(end))


def visible(facts: DataFrame, cutoff: Column, avail: str = "avail") -> DataFrame:
    return facts.where(F.col(avail) <= cutoff)


def leaks(used: DataFrame, cutoff: str = "cutoff", avail: str = "avail") -> DataFrame:
    """One row: how many of the joined facts weren't available at their cutoff, and the latest of them."""
    late = F.col(avail) > F.col(cutoff)
    return used.agg(F.count("*").alias("used"), F.count_if(late).alias("violations"), F.max(F.when(late, F.col(avail))).alias("latest"))


def assert_no_leaks(used: DataFrame, cutoff: str = "cutoff", avail: str = "avail") -> DataFrame:
    found = leaks(used, cutoff, avail).first()
    if found["violations"]:
        raise ValueError(f"{found['violations']} facts used before they were available, the latest of {found['latest']}")
    return used


def local_day(at: Column, zone: str, hour: int = 5) -> Column:
    """The local day that begins at ``hour``, of an instant in UTC."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), at) - minutes(60 * hour))


def training_cutoff(at: Column, zone: str = "America/New_York", hour: int = 5) -> Column:
    """``hour`` o'clock local time on the event's local day, in UTC, and not after the event."""
    local = F.date_trunc("day", F.convert_timezone(F.lit("UTC"), F.lit(zone), at)).cast("timestamp_ntz") + minutes(60 * hour)
    return F.least(F.convert_timezone(F.lit(zone), F.lit("UTC"), local), at)


def running_asof(targets: DataFrame, facts: DataFrame, keys: list[str], aggregates: dict[str, Callable], cutoff: str = "cutoff", avail: str = "avail", target_id: list[str] | None = None, order: list[str] | None = None, greatest: tuple[str, Column, int] | None = None) -> DataFrame:
    """For each target, aggregates over the facts of its keys with ``avail <= cutoff``: targets and facts are stacked and a
    window runs over both, so the work grows with their sum and not with the pairs. An aggregate is a function of that window;
    the facts' columns have a leading underscore there. Facts of one key and ``avail`` come in the order of the columns ``order``, of all if
    none is given; what a window takes as the last one is defined only if these tell the facts apart. ``greatest`` (name, value, k) adds name_1 to name_k, the k greatest values so far."""
    ids = target_id or [c for c in targets.columns if c not in keys and c != cutoff]
    values = [c for c in facts.columns if c not in keys and c != avail]
    stacked = targets.select(*keys, F.col(cutoff).alias("_at"), F.lit(1).alias("_kind"), *ids, *(F.lit(None).cast(facts.schema[c].dataType).alias(f"_{c}") for c in values))
    stacked = stacked.unionByName(facts.select(*keys, F.col(avail).alias("_at"), F.lit(0).alias("_kind"), *(F.col(c).alias(f"_{c}") for c in values)), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("_at", "_kind", *(f"_{c}" for c in order or values)).rowsBetween(W.unboundedPreceding, 0)
    more = []
    if greatest:
        name, value, k = greatest
        stacked = running_greatest(stacked, value, w, name, k)
        more = [f"{name}_{i + 1}" for i in range(k)]
    out = stacked.select(*keys, "_at", "_kind", *ids, *more, *(f(w).alias(n) for n, f in aggregates.items()))
    return out.where("_kind = 1").withColumnRenamed("_at", cutoff).drop("_kind")


def running_greatest(rows: DataFrame, value: Column, window: WindowSpec, name: str, k: int) -> DataFrame:
    """``rows`` with name_1 to name_k, the k greatest values (nulls don't count) from the start of the window to each row. A row keeps k values and
    no list: where a value comes, the lesser of it and the greatest so far goes on to the next place, which treats it likewise."""
    before = window.rowsBetween(W.unboundedPreceding, -1)
    coming = F.col("_coming")
    rows = rows.withColumn("_coming", value)
    for i in range(k):
        rows = rows.withColumn("_top", F.max("_coming").over(before)).withColumn(f"{name}_{i + 1}", F.greatest("_top", "_coming"))
        rows = rows.withColumn("_coming", F.when(coming.isNotNull() & F.col("_top").isNotNull(), F.least("_top", "_coming")))
    return rows.drop("_coming", "_top")


def range_asof(targets: DataFrame, facts: DataFrame, keys: list[str], cutoff: str = "cutoff", avail: str = "avail") -> DataFrame:
    """The raw facts visible to each target: equal keys and ``avail <= cutoff``."""
    return targets.join(facts, keys).where(F.col(avail) <= F.col(cutoff))


def visible_counts(cutoffs: DataFrame, facts: DataFrame, cutoff: str = "cutoff", avail: str = "avail") -> DataFrame:
    """Number of facts available at each distinct cutoff. Facts and cutoffs are counted by day first; the global running
    count is over days, and a window inside each day does the rest."""
    c = cutoffs.select(F.col(cutoff).alias("_at"), F.lit(0).alias("_n"), F.lit(1).alias("_kind")).distinct()
    f = facts.groupBy(F.col(avail).alias("_at")).agg(F.count("*").cast("int").alias("_n")).withColumn("_kind", F.lit(0))
    both = c.unionByName(f).withColumn("_day", F.to_date("_at"))
    days = both.groupBy("_day").agg(F.sum("_n").alias("_sum"))
    before = days.select("_day", (F.sum("_sum").over(W.orderBy("_day")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_n").over(W.partitionBy("_day").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0))
    out = both.withColumn("_inside", inside).join(before, "_day").where("_kind = 1")
    return out.select(F.col("_at").alias(cutoff), (F.col("_before") + F.col("_inside")).alias("visible"))


def find_contest(asked: DataFrame, schedule: DataFrame, hours: int, days: int) -> DataFrame:
    """For each asked pair (query_id, a, b, at) the earliest contest of the two, either way round, from ``hours`` before to
    ``days`` after."""
    pair = lambda x, y: (F.least(x, y).alias("_x"), F.greatest(x, y).alias("_y"))
    q = asked.select("query_id", "at", *pair("a", "b"))
    s = schedule.select("game_id", "kickoff", "home_id", *pair("home_id", "away_id"))
    near = q.join(s, ["_x", "_y"]).where((F.col("kickoff") > F.col("at") - minutes(60 * hours)) & (F.col("kickoff") <= F.col("at") + minutes(1440 * days)))
    first = F.row_number().over(W.partitionBy("query_id").orderBy("kickoff", "game_id"))
    return near.withColumn("_k", first).where("_k = 1").select("query_id", "game_id", "kickoff", "home_id")


def divisions(contests: DataFrame, main: int = 80, least: int = 4) -> DataFrame:
    """Division of an entity in a season by the feed of most of its contests."""
    sides = contests.select("season", F.col("home_id").alias("team"), "feed_group").unionByName(contests.select("season", F.col("away_id").alias("team"), "feed_group"))
    by = sides.groupBy("season", "team").agg(F.count("*").alias("n"), F.avg((F.col("feed_group") == main).cast("int")).alias("share"))
    return by.select("season", "team", F.when(F.col("share") > 0.5, "FBS").when(F.col("n") >= least, "FCS").otherwise("OTHER").alias("division"))


def division_of(rows: DataFrame, known: DataFrame, back: int = 2, default: str = "OTHER") -> DataFrame:
    """``rows`` (season, team) with the division of that season or one of the ``back`` before."""
    every = known.select("team", "division", F.inline(F.array(*(F.struct((F.col("season") + k).alias("season"), F.lit(k).alias("_k")) for k in range(back + 1)))))
    latest = every.groupBy("season", "team").agg(F.min_by("division", "_k").alias("_d"))  # by season and side, so the rows are joined once
    return rows.join(latest, ["season", "team"], "left").withColumn("division", F.coalesce("_d", F.lit(default))).drop("_d")
