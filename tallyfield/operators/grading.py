"""Grading of predictions and diagnosis of errors, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S


def grade(predictions: DataFrame, results: DataFrame, high: float = 0.75) -> DataFrame:
    """Each prediction of a decided contest with its errors. A tie counts as not won, and is marked."""
    r = results.select("game_id", (F.col("home_score") > F.col("away_score")).cast("int").alias("home_win"), (F.col("home_score") == F.col("away_score")).alias("tie"), (F.col("home_score") - F.col("away_score")).alias("margin"), (F.col("home_score") + F.col("away_score")).alias("total"))
    p, y = F.col("p_home"), F.col("home_win")
    correct = (p >= 0.5) == (y == 1)
    return predictions.join(r, "game_id").select(
        *predictions.columns, "home_win", "tie", "margin", "total", correct.cast("int").alias("correct"), S.brier(p, y).alias("brier"), S.log_loss(p, y).alias("logloss"),
        (F.col("pred_margin") - F.col("margin")).alias("margin_error"), (F.col("pred_total") - F.col("total")).alias("total_error"), ((S.pick_probability(p) >= high) & ~correct).cast("int").alias("high_conf_miss"),
    )


def summary(p: Column, y: Column, margin_error: Column | None = None, total_error: Column | None = None) -> list[Column]:
    """n, accuracy, Brier, log loss, and errors of margins and totals: aggregates for one ``agg``."""
    out = [F.count("*").alias("n"), F.avg(((p >= 0.5) == (y == 1)).cast("double")).alias("accuracy"), F.avg(S.brier(p, y)).alias("brier"), F.avg(S.log_loss(p, y)).alias("log_loss")]
    if margin_error is not None:
        out += [F.avg(F.abs(margin_error)).alias("margin_mae"), F.sqrt(F.avg(margin_error * margin_error)).alias("margin_rmse"), F.avg(margin_error).alias("margin_bias")]
    if total_error is not None:
        out += [F.avg(F.abs(total_error)).alias("total_mae"), F.avg(total_error).alias("total_bias")]
    return out


def calibration_table(rows: DataFrame, keys: list[str], bins: int = 10, p: str = "p_home", y: str = "home_win") -> DataFrame:
    """Equal bins, closed on the left, the last on both sides."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def expected_calibration_error(table: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")
    return table.groupBy(*keys).agg(gap.alias("ece"))


def calibration_slope(rows: DataFrame, p: str = "p_home", y: str = "home_win", steps: int = 10, tolerance: float = 1e-10) -> dict[str, float]:
    """Intercept and slope of a logistic fit on logit(p) with their standard errors. Each Newton step is one aggregate of five
    sums; only those reach the driver."""
    x = S.logit(F.col(p), 1e-4)
    base = rows.select(x.alias("x"), F.col(y).cast("double").alias("y"))
    a, b = 0.0, 1.0
    for _ in range(steps):
        q = S.expit(F.lit(a) + F.lit(b) * F.col("x"))
        w, r = q * (1 - q), F.col("y") - q
        s = base.agg(F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x")), F.sum(r), F.sum(r * F.col("x"))).first()
        if s is None or s[0] is None:
            return {"intercept": 0.0, "slope": 1.0, "intercept_se": float("nan"), "slope_se": float("nan")}
        h11, h12, h22 = s[0] + 1e-9, s[1], s[2] + 1e-9
        det = h11 * h22 - h12 * h12
        da, db = (h22 * s[3] - h12 * s[4]) / det, (h11 * s[4] - h12 * s[3]) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < tolerance:
            break
    return {"intercept": a, "slope": b, "intercept_se": (h22 / det) ** 0.5, "slope_se": (h11 / det) ** 0.5}


def calibration_finding(slope: dict[str, float], ece: float, most: float = 0.02) -> dict[str, object]:
    """Over- or under-confident by the slope, else the side of the bias by the intercept."""
    flag = None
    if abs(slope["slope"] - 1) > 2 * slope["slope_se"]:
        flag = "over-confident" if slope["slope"] < 1 else "under-confident"
    elif abs(slope["intercept"]) > 2 * slope["intercept_se"]:
        flag = "biased toward home" if slope["intercept"] < 0 else "biased toward away"
    return {"flag": flag, "needs_recalibration": flag is not None or ece > most}


def latest(rows: DataFrame, keys: list[str], order: str = "created", tie: str = "pred_id") -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc(), F.col(tie).desc()))
    return rows.withColumn("_last", last).where("_last = 1").drop("_last")


def high_confidence(rows: DataFrame, keys: list[str], high: float) -> DataFrame:
    """Misses among confident picks: observed, expected, z and its one-sided p."""
    pick = S.pick_probability(F.col("p_home"))
    miss = ((F.col("p_home") >= 0.5) != (F.col("home_win") == 1)).cast("int")
    out = rows.where(pick >= high).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(miss).alias("observed"), F.sum(1 - pick).alias("expected"), F.sum(pick * (1 - pick)).alias("variance"))
    z = F.when(F.col("variance") > 0, (F.col("observed") - F.col("expected")) / F.sqrt("variance")).otherwise(0.0)
    return out.withColumn("z", z).withColumn("p_value", 1 - S.normal_cdf(F.col("z")))


def melt_groups(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """One row for each group that a row is in."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in groups.items())))
    return rows.withColumn("subgroup", F.explode(names))


def subgroup_bias(rows: DataFrame, groups: dict[str, Column], least: int) -> DataFrame:
    """Bias of wins with a binomial z and of margins with a one-sample t, for groups of at least ``least`` rows."""
    p, y, e = F.col("p_home"), F.col("home_win"), F.col("margin") - F.col("pred_margin")
    out = melt_groups(rows, groups).groupBy("subgroup").agg(
        F.count("*").alias("n"), F.avg(y - p).alias("win_bias"), F.sum(p * (1 - p)).alias("_v"), F.avg(e).alias("margin_bias"), F.stddev_samp(e).alias("_s"), F.avg(S.log_loss(p, y)).alias("log_loss")
    )
    out = out.where(F.col("n") >= least).withColumn("z", F.col("win_bias") * F.col("n") / F.sqrt("_v")).withColumn("t", F.col("margin_bias") * F.sqrt("n") / F.col("_s"))
    return out.withColumn("win_p", 2 * (1 - S.normal_cdf(F.abs("z")))).withColumn("margin_p", S.t_two_sided(F.col("t"), F.col("n") - 1)).drop("_v", "_s")


def residual_correlation(rows: DataFrame, features: list[str], least: int = 100) -> DataFrame:
    """Correlation of each feature with the residuals of wins and margins; constant features are left out."""
    long = rows.select((F.col("home_win") - F.col("p_home")).alias("rw"), (F.col("margin") - F.col("pred_margin")).alias("rm"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("_f"))
    long = long.select("rw", "rm", "_f.feature", "_f.x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    out = long.groupBy("feature").agg(F.count("*").alias("n"), F.stddev_pop("x").alias("_s"), F.corr("x", "rw").alias("r_win"), F.corr("x", "rm").alias("r_margin")).where((F.col("n") >= least) & (F.col("_s") > 0)).drop("_s")
    for k in ("win", "margin"):
        r = F.col(f"r_{k}")
        out = out.withColumn(f"p_{k}", S.t_two_sided(r * F.sqrt((F.col("n") - 2) / (1 - r * r)), F.col("n") - 2))
    return out


def adjusted(rows: DataFrame, p: str, into: str = "q", tie: str = "subgroup") -> DataFrame:
    """Benjamini-Hochberg. ``rows`` are the tests, a short table."""
    rank = F.row_number().over(W.orderBy(p, tie))
    n = F.count("*").over(W.partitionBy())
    out = rows.withColumn("_r", rank).withColumn("_q", F.col(p) * n / F.col("_r"))
    return out.withColumn(into, F.least(F.lit(1.0), F.min("_q").over(W.orderBy(F.col("_r").desc()).rowsBetween(W.unboundedPreceding, 0)))).drop("_r", "_q")


def drift(rows: DataFrame) -> DataFrame:
    """Newest fold against the earlier ones: sample variance there, population variance here."""
    newest = rows.agg(F.max("fold").alias("_newest"))
    r = rows.join(F.broadcast(newest)).withColumn("ll", S.log_loss(F.col("p_home"), F.col("home_win")))
    new, old = F.when(F.col("fold") == F.col("_newest"), F.col("ll")), F.when(F.col("fold") != F.col("_newest"), F.col("ll"))
    out = r.agg(F.avg(new).alias("last_fold"), F.count(new).alias("n_last"), F.avg(old).alias("earlier"), F.count(old).alias("n_earlier"), F.var_samp(new).alias("_vn"), F.var_pop(old).alias("_vo"))
    return out.withColumn("z", (F.col("last_fold") - F.col("earlier")) / F.sqrt(F.col("_vn") / F.col("n_last") + F.col("_vo") / F.col("n_earlier"))).drop("_vn", "_vo")


def by_member(rows: DataFrame, members: list[str], keys: list[str]) -> DataFrame:
    """The same measures for each probability column."""
    long = rows.select(*keys, "home_win", F.explode(F.array(*(F.struct(F.lit(m).alias("member"), F.col(m).alias("p")) for m in members))).alias("_m"))
    return long.groupBy(F.col("_m.member").alias("member"), *keys).agg(*summary(F.col("_m.p"), F.col("home_win")))
