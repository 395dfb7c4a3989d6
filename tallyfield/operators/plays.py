"""Ordered sequences of plays: scores, drives, expected points, and statistics per event and side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S


@dataclass(frozen=True)
class Rules:
    """What the sport calls its plays. Fixed values of a domain are parameters here."""

    rush: tuple[str, ...] = ("click",)
    passing: tuple[str, ...] = ("view", "signup")
    touchdown: tuple[str, ...] = ("purchase",)
    kick: tuple[str, ...] = ("error",)
    sack: str = "signup"
    garbage: tuple[tuple[int, int], ...] = ((2, 38), (3, 28), (4, 22))
    explosive_pass: int = 16
    explosive_rush: int = 12


#: Kinds of plays whose points belong to the score before them (a fixed pattern).
POINT_AFTER = "Extra|Two|2pt|Conversion"


def scores(plays: DataFrame, event: str = "event_key", order: str = "seq", home: str = "hs", away: str = "as", kind: str = "type", point_after: str = POINT_AFTER) -> DataFrame:
    """``prev_h``, ``prev_a`` (the last known score before; 0 at the start) and ``score_value``: the change read as 7 (from 6 on), 3 (from 3 on), 2 or 1 by its
    size, positive for home. One of at most 2 on a play whose ``kind`` matches ``point_after`` counts 0. Missing scores are filled from before."""
    w = W.partitionBy(event).orderBy(order)
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    out = plays
    for c, name in ((home, "h"), (away, "a")):
        out = out.withColumn(f"now_{name}", F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(0))).withColumn(f"prev_{name}", F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(0)))
    change = (F.col("now_h") - F.col("prev_h")) - (F.col("now_a") - F.col("prev_a"))
    size = F.abs(change)
    after = F.coalesce(F.col(kind).rlike(point_after), F.lit(False)) if kind in plays.columns else F.lit(False)
    return out.withColumn("score_value", F.signum(change).cast("int") * F.when(after & (size <= 2), 0).when(size >= 6, 7).when(size >= 3, 3).otherwise(size).cast("int"))


def next_score(plays: DataFrame, value: str = "score_value", event: str = "event_key", order: str = "seq", period: str = "period") -> DataFrame:
    """The next value that isn't zero in the same half, this row included; 0 if none."""
    w = W.partitionBy(event, "half").orderBy(order).rowsBetween(0, W.unboundedFollowing)
    return plays.withColumn("half", S.half_of(F.col(period))).withColumn("next_score", F.coalesce(F.first(F.nullif(F.col(value), F.lit(0)), ignorenulls=True).over(w), F.lit(0)))


def margin_before(plays: DataFrame, value: str = "score_value", event: str = "event_key", order: str = "seq", side: str = "off_side", home: str = "A") -> DataFrame:
    """Margin before the play from the side that has the ball. ``value`` counts for that side."""
    signed = F.when(F.col(side) == home, F.col(value)).otherwise(-F.col(value))
    total = F.coalesce(F.sum(signed).over(W.partitionBy(event).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return plays.withColumn("pre_margin", F.when(F.col(side) == home, total).otherwise(-total))


def scrimmage(types: tuple[str, ...]) -> Column:
    ok = F.col("type").isin(*types) & F.col("down").between(1, 4) & F.col("dist").between(1, 99) & F.col("ytez").between(1, 99)
    return F.coalesce(ok, F.lit(False))


def garbage_time(rules: Rules) -> Column:
    """The margin is out of reach for the period."""
    hit = F.lit(False)
    for period, most in rules.garbage:
        hit = hit | ((F.col("period") == period) & (F.abs("pre_margin") > most))
    return F.coalesce(hit, F.lit(False))


def buckets(down: str = "down", ytez: str = "ytez", dist: str = "dist") -> list[Column]:
    return [S.down_bucket(F.col(down)).alias("b_down"), S.field_bucket(F.col(ytez)).alias("b_field"), S.distance_bucket(F.col(dist)).alias("b_dist")]


def expected_points(plays: DataFrame, k: float = 30.0, y: str = "next_score_off") -> DataFrame:
    """The whole 4 x 20 x 5 grid of means of ``y``, each drawn toward the mean of its field bucket by ``k`` pseudo-plays."""
    b = plays.select(*buckets(), F.col(y).cast("double").alias("y"))
    cells = b.groupBy("b_down", "b_field", "b_dist").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    field = b.groupBy("b_field").agg(F.avg("y").alias("m"))
    spark = plays.sparkSession
    grid = spark.range(400).select((F.col("id") % 4 + 1).cast("int").alias("b_down"), F.floor(F.col("id") / 20).cast("int").alias("b_field"), (F.floor(F.col("id") / 4) % 5).cast("int").alias("b_dist"))
    full = grid.join(F.broadcast(field), "b_field", "left").join(cells, ["b_down", "b_field", "b_dist"], "left")
    m = F.coalesce("m", F.lit(0.0))
    return full.select("b_down", "b_field", "b_dist", ((F.coalesce("s", F.lit(0.0)) + k * m) / (F.coalesce("n", F.lit(0)) + k)).alias("ep"))


def look_up(plays: DataFrame, grid: DataFrame, into: str, down: Column, ytez: Column, dist: Column) -> DataFrame:
    """Expected points of a state; the grid has 400 rows."""
    g = grid.select(*(F.col(c).alias(f"_{c}") for c in ("b_down", "b_field", "b_dist")), F.col("ep").alias(into))
    on = (S.down_bucket(down) == F.col("_b_down")) & (S.field_bucket(ytez) == F.col("_b_field")) & (S.distance_bucket(dist) == F.col("_b_dist"))
    return plays.join(F.broadcast(g), on, "left").drop("_b_down", "_b_field", "_b_dist")


def added_points(plays: DataFrame, grid: DataFrame, rules: Rules, event: str = "event_key", order: str = "seq", side: str = "off_side") -> DataFrame:
    """``epa``: what the score or the next state is worth, less what this state was; the next state counts against if the ball
    changes sides; within ten points. With success, explosive, sack and pass flags."""
    w = W.partitionBy(event).orderBy(order)
    p = plays.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in (side, "down", "ytez", "dist")))
    p = look_up(p, grid, "ep0", F.col("down"), F.col("ytez"), F.col("dist"))
    p = look_up(p, grid, "_same", F.col("next_down"), F.col("next_ytez"), F.col("next_dist"))
    p = look_up(p, grid, "_flip", F.lit(1), F.col("next_ytez"), F.lit(10))
    known = F.col("next_ytez").between(1, 99)
    keeps = F.coalesce((F.col(f"next_{side}") == F.col(side)) & F.col("next_down").between(1, 4) & known, F.lit(False))
    flips = F.coalesce((F.col(f"next_{side}") != F.col(side)) & known, F.lit(False))
    after = F.when(F.col("score_value") != 0, F.col("score_value").cast("double")).when(keeps, F.col("_same")).when(flips, -F.col("_flip")).otherwise(0.0)
    passing = F.col("type").isin(*rules.passing)
    yds = F.coalesce("yds", F.lit(0))
    return p.select(
        *plays.columns, S.clip(after - F.col("ep0"), -10, 10).alias("epa"), S.success(F.col("down"), F.col("dist"), F.col("yds")).cast("int").alias("success"), passing.alias("is_pass"),
        F.when(passing, yds >= rules.explosive_pass).otherwise(yds >= rules.explosive_rush).cast("int").alias("explosive"), (F.col("type") == rules.sack).cast("int").alias("sack"), flips.cast("int").alias("turnover"),
    )


def efficiency(plays: DataFrame, keys: list[str]) -> DataFrame:
    """Means over all plays, and over rushes and passes, in one aggregate."""
    rush, passing = (lambda c: F.avg(F.when(~F.col("is_pass"), F.col(c)))), (lambda c: F.avg(F.when(F.col("is_pass"), F.col(c))))
    return plays.groupBy(*keys).agg(
        F.count("*").alias("plays"), F.avg("epa").alias("epa_pp"), F.avg("success").alias("sr"), F.avg("yds").alias("ypp"), F.avg("explosive").alias("expl"), F.avg("turnover").alias("to_rate"),
        rush("epa").alias("rush_epa"), rush("success").alias("rush_sr"), passing("epa").alias("pass_epa"), passing("success").alias("pass_sr"), passing("sack").alias("sack_rate"),
    )


def drives(plays: DataFrame, rules: Rules, event: str = "event_key", order: str = "seq", side: str = "off_side") -> DataFrame:
    """Each run of plays of one side: its first and best position, whether it scored, and whether it came within 40 and 20."""
    from .sequence import islands

    p = islands(plays, [event], [order], side, "drive")
    live = F.col("type").isin(*rules.rush, *rules.passing) & F.col("ytez").between(1, 99)
    d = p.groupBy(event, "drive", side).agg(
        F.min_by(F.when(live, F.col("ytez")), F.when(live, F.col(order))).alias("start"), F.min(F.when(live, F.col("ytez"))).alias("best"), F.max(F.col("type").isin(*rules.touchdown)).alias("td"), F.max(F.col("type").isin(*rules.kick)).alias("fg")
    )
    d = d.where("best IS NOT NULL")
    return d.withColumn("pts", F.when(F.col("td"), 7).when(F.col("fg"), 3).otherwise(0)).withColumn("opp", F.col("best") <= 40).withColumn("rz", F.col("best") <= 20)


def drive_summary(drives_: DataFrame, keys: list[str]) -> DataFrame:
    return drives_.groupBy(*keys).agg(
        F.count("*").alias("drives"), F.avg("pts").alias("pts_per_drive"), F.avg(100 - F.col("start")).alias("start_fp"), F.count_if("rz").alias("rz_trips"),
        F.avg(F.when(F.col("opp"), F.col("pts"))).alias("ppo"), F.avg(F.when(F.col("rz"), F.col("td").cast("int"))).alias("rz_td_rate"),
    )


def most_attempts(athletes: DataFrame, keys: list[str], attempts: str = "att", place: str = "place") -> DataFrame:
    """The athlete of most attempts; of equals, the first listed."""
    k = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(attempts).desc_nulls_last(), F.col(place)))
    return athletes.withColumn("_k", k).where("_k = 1").drop("_k")


def box_rows(entities: DataFrame, play_stats: DataFrame, drive_stats: DataFrame, keys: list[str], counts: tuple[str, ...] = ("fg_att", "fg_made")) -> DataFrame:
    """Every entity of the box document with what its plays and drives gave; missing counts are 0."""
    both = play_stats.join(drive_stats, keys, "full")
    out = entities.join(both, keys, "left")
    return out.fillna(0, [c for c in counts if c in out.columns])
