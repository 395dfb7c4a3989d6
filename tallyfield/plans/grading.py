"""Queries on logged predictions: grading, calibration, diagnosis, and the functions they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grading as G
from ..sources.shared import checkpointed
from .registry import query

HIGH = 0.75


def subgroups():
    """Named predicates; built on call, as columns need a session."""
    return {
        "neutral": F.col("neutral") == 1,
        "conference": F.col("conf_game") == 1,
        "home_favourite": F.col("p_home") >= 0.5,
        "road_favourite": F.col("p_home") < 0.5,
        "close": F.abs(2 * F.col("p_home") - 1) < 0.2,
    }


_SUBGROUPS_SQL = "(VALUES ('neutral'), ('conference'), ('home_favourite'), ('road_favourite'), ('close')) AS s(subgroup)"
_IN_GROUP = """CASE subgroup WHEN 'neutral' THEN neutral = 1 WHEN 'conference' THEN conf_game = 1 WHEN 'home_favourite' THEN p_home >= 0.5
  WHEN 'road_favourite' THEN p_home < 0.5 ELSE abs(2 * p_home - 1) < 0.2 END"""
_LL = "-(home_win * ln(least(greatest(p_home, 1e-4), 1 - 1e-4)) + (1 - home_win) * ln(1 - least(greatest(p_home, 1e-4), 1 - 1e-4)))"
_CORRECT = "((p_home >= 0.5) = (home_win = 1))"


def rounded(df, digits: int = 6):
    """Doubles rounded, so that the order of additions doesn't show."""
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


_BINS = f"""WITH g AS (SELECT *, CAST(least(floor(p_home * 10), 9) AS INTEGER) AS bin FROM graded)
SELECT model_version, bin, count(*) AS n, round(avg(p_home), 6) AS mean_p, round(avg(home_win), 6) AS rate FROM g GROUP BY 1, 2"""


@query("flagship_calibration", f"""WITH g AS (SELECT *, CAST(least(floor(p_home * 10), 9) AS INTEGER) AS bin FROM graded),
b AS (SELECT model_version, bin, count(*) AS n, avg(p_home) AS mean_p, avg(home_win) AS rate FROM g GROUP BY 1, 2),
v AS (SELECT model_version, avg(CAST({_CORRECT} AS DOUBLE)) AS accuracy, avg((p_home - home_win) * (p_home - home_win)) AS brier, avg({_LL}) AS log_loss FROM graded GROUP BY 1),
e AS (SELECT model_version, sum(n * abs(mean_p - rate)) / sum(n) AS ece FROM b GROUP BY 1)
SELECT model_version, bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, round(accuracy, 6) AS accuracy, round(brier, 6) AS brier,
  round(log_loss, 6) AS log_loss, round(ece, 6) AS ece FROM b JOIN v USING (model_version) JOIN e USING (model_version)""")
def flagship(t):
    rows = G.grade(t["prediction"], t["contest"])
    bins = G.calibration_table(rows, ["model_version"])
    overall = rows.groupBy("model_version").agg(*G.summary(F.col("p_home"), F.col("home_win"))).drop("n")
    return rounded(bins.join(overall, "model_version").join(G.expected_calibration_error(bins, ["model_version"]), "model_version"))


@query("agg_7_metric_summary", f"""SELECT model_version, count(*) AS n, round(avg(CAST({_CORRECT} AS DOUBLE)), 6) AS accuracy,
round(avg((p_home - home_win) * (p_home - home_win)), 6) AS brier, round(avg({_LL}), 6) AS log_loss, round(avg(abs(pred_margin - margin)), 6) AS margin_mae,
round(sqrt(avg((pred_margin - margin) * (pred_margin - margin))), 6) AS margin_rmse, round(avg(pred_margin - margin), 6) AS margin_bias,
round(avg(abs(pred_total - total)), 6) AS total_mae, round(avg(pred_total - total), 6) AS total_bias FROM graded GROUP BY 1""")
def agg_7(t):
    g = G.grade(t["prediction"], t["contest"])
    return rounded(g.groupBy("model_version").agg(*G.summary(F.col("p_home"), F.col("home_win"), F.col("margin_error"), F.col("total_error"))))


@query("agg_8_calibration_table", _BINS)
def agg_8(t):
    return rounded(G.calibration_table(t["graded"], ["model_version"]))


@query("agg_9_calibration_error", "WITH g AS (SELECT model_version, least(floor(p_home * 10), 9) AS b, count(*) AS n, avg(p_home) - avg(home_win) AS gap FROM graded GROUP BY 1, 2) SELECT model_version, round(sum(n * abs(gap)) / sum(n), 6) AS ece FROM g GROUP BY 1")
def agg_9(t):
    return rounded(G.expected_calibration_error(G.calibration_table(t["graded"], ["model_version"]), ["model_version"]))


def _slopes(t):
    out, graded = None, checkpointed(t["graded"].select("model_version", "p_home", "home_win"))  # read in every step of both fits
    for version in ("v1.0", "v1.1"):
        mine = graded.where(F.col("model_version") == version)
        s = G.calibration_slope(mine)
        ece = G.expected_calibration_error(G.calibration_table(mine, ["model_version"]), ["model_version"])
        row = ece.select("model_version", "ece", *(F.lit(v).alias(k) for k, v in s.items()))
        out = row if out is None else out.unionByName(row)
    return out


def _newton_sql(steps=10):
    """The same Newton steps spelled out, one table of two numbers for each."""
    l = "ln(least(greatest(p_home, 1e-4), 1 - 1e-4) / (1 - least(greatest(p_home, 1e-4), 1 - 1e-4)))"  # noqa: E741
    text = f"WITH b AS (SELECT model_version AS v, {l} AS x, CAST(home_win AS DOUBLE) AS y FROM graded), n0 AS (SELECT v, 0e0 AS a, 1e0 AS b, 0e0 AS h11, 0e0 AS h22, 1e0 AS det FROM b GROUP BY v)"
    for i in range(steps):
        text += f""", q{i} AS (SELECT b.v, n.a, n.b, b.x, b.y, 1 / (1 + exp(-(n.a + n.b * b.x))) AS q FROM b JOIN n{i} n ON n.v = b.v),
s{i} AS (SELECT v, a, b, sum(q * (1 - q)) + 1e-9 AS h11, sum(q * (1 - q) * x) AS h12, sum(q * (1 - q) * x * x) + 1e-9 AS h22, sum(y - q) AS r, sum((y - q) * x) AS rx FROM q{i} GROUP BY v, a, b),
n{i + 1} AS (SELECT v, a + (h22 * r - h12 * rx) / (h11 * h22 - h12 * h12) AS a, b + (h11 * rx - h12 * r) / (h11 * h22 - h12 * h12) AS b, h11, h22, h11 * h22 - h12 * h12 AS det FROM s{i})"""
    return text + f", slopes AS (SELECT v AS model_version, a AS intercept, b AS slope, sqrt(h22 / det) AS intercept_se, sqrt(h11 / det) AS slope_se FROM n{steps})"


@query("agg_10_calibration_slope", _newton_sql() + " SELECT model_version, round(intercept, 6) AS intercept, round(slope, 6) AS slope, round(intercept_se, 6) AS intercept_se, round(slope_se, 6) AS slope_se FROM slopes")
def agg_10(t):
    return rounded(_slopes(t).drop("ece"))


@query("agg_30_calibration_finding", _newton_sql() + """, bins AS (SELECT model_version, least(floor(p_home * 10), 9) AS bin, count(*) AS n, abs(avg(p_home) - avg(home_win)) AS gap FROM graded GROUP BY 1, 2),
e AS (SELECT model_version, sum(n * gap) / sum(n) AS ece FROM bins GROUP BY 1),
f AS (SELECT model_version, ece, CASE WHEN abs(slope - 1) > 2 * slope_se THEN (CASE WHEN slope < 1 THEN 'over-confident' ELSE 'under-confident' END)
  WHEN abs(intercept) > 2 * intercept_se THEN (CASE WHEN intercept < 0 THEN 'biased toward home' ELSE 'biased toward away' END) END AS flag FROM slopes JOIN e USING (model_version))
SELECT model_version, flag, flag IS NOT NULL OR ece > 0.02 AS needs_recalibration FROM f""")
def agg_30(t):
    off_slope, off_side = F.abs(F.col("slope") - 1) > 2 * F.col("slope_se"), F.abs("intercept") > 2 * F.col("intercept_se")
    flag = F.when(off_slope, F.when(F.col("slope") < 1, "over-confident").otherwise("under-confident")).when(off_side, F.when(F.col("intercept") < 0, "biased toward home").otherwise("biased toward away"))
    return _slopes(t).select("model_version", flag.alias("flag"), (flag.isNotNull() | (F.col("ece") > 0.02)).alias("needs_recalibration"))


@query("agg_11_grading", f"""SELECT pred_id, home_win, CAST({_CORRECT} AS INTEGER) AS correct, round((p_home - home_win) * (p_home - home_win), 6) AS brier, round({_LL}, 6) AS logloss,
pred_margin - margin AS margin_error, pred_total - total AS total_error, CAST(greatest(p_home, 1 - p_home) >= {HIGH} AND NOT {_CORRECT} AS INTEGER) AS high_conf_miss FROM graded""")
def agg_11(t):
    return rounded(G.grade(t["prediction"], t["contest"], HIGH).select("pred_id", "home_win", "correct", "brier", "logloss", "margin_error", "total_error", "high_conf_miss"))


@query("agg_12_live_record", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY game_id, model_version, origin ORDER BY created DESC, pred_id DESC) AS k FROM graded)
SELECT origin, model_version, count(*) AS n, round(avg(CAST({_CORRECT} AS DOUBLE)), 6) AS accuracy, round(avg((p_home - home_win) * (p_home - home_win)), 6) AS brier,
round(avg({_LL}), 6) AS log_loss, CAST(sum(CASE WHEN greatest(p_home, 1 - p_home) >= {HIGH} AND NOT {_CORRECT} THEN 1 ELSE 0 END) AS BIGINT) AS high_conf_misses FROM l WHERE k = 1 GROUP BY 1, 2""")
def agg_12(t):
    g = G.latest(G.grade(t["prediction"], t["contest"], HIGH), ["game_id", "model_version", "origin"])
    return rounded(g.groupBy("origin", "model_version").agg(*G.summary(F.col("p_home"), F.col("home_win")), F.sum("high_conf_miss").alias("high_conf_misses")))


@query("agg_13_high_confidence_misses", f"""WITH h AS (SELECT model_version, greatest(p_home, 1 - p_home) AS pp, CASE WHEN {_CORRECT} THEN 0 ELSE 1 END AS miss FROM graded),
a AS (SELECT model_version, count(*) AS n, CAST(sum(miss) AS BIGINT) AS observed, sum(1 - pp) AS expected, sum(pp * (1 - pp)) AS variance FROM h WHERE pp >= {HIGH} GROUP BY 1),
z AS (SELECT *, CASE WHEN variance > 0 THEN (observed - expected) / sqrt(variance) ELSE 0 END AS z FROM a)
SELECT model_version, n, observed, round(expected, 6) AS expected, round(variance, 6) AS variance, round(z, 6) AS z, round(1 - {S.normal_cdf_sql('z')}, 6) AS p_value FROM z""")
def agg_13(t):
    return rounded(G.high_confidence(t["graded"], ["model_version"], HIGH))


@query("agg_14_subgroup_bias", f"""WITH m AS (SELECT g.*, subgroup FROM graded g, {_SUBGROUPS_SQL} WHERE model_version = 'v1.0' AND {_IN_GROUP})
SELECT subgroup, count(*) AS n, round(avg(home_win - p_home), 6) AS win_bias, round(avg(home_win - p_home) * count(*) / sqrt(sum(p_home * (1 - p_home))), 6) AS z,
round(avg(margin - pred_margin), 6) AS margin_bias, round(avg(margin - pred_margin) * sqrt(count(*)) / stddev_samp(margin - pred_margin), 6) AS t, round(avg({_LL}), 6) AS log_loss
FROM m GROUP BY 1 HAVING count(*) >= 30""")
def agg_14(t):
    return rounded(G.subgroup_bias(t["graded"].where("model_version = 'v1.0'"), subgroups(), 30).drop("win_p", "margin_p"))


_FEATURES = ["neutral", "conf_game", "pred_margin", "season", "home_id", "away_id"]


@query("agg_15_residual_correlation", "WITH l AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, home_win - p_home AS rw, margin - pred_margin AS rm FROM graded WHERE model_version = 'v1.0'" for f in _FEATURES) + ") SELECT feature, count(*) AS n, round(corr(x, rw), 6) AS r_win, round(corr(x, rm), 6) AS r_margin FROM l WHERE x IS NOT NULL GROUP BY 1 HAVING count(*) >= 100 AND stddev_pop(x) > 0")
def agg_15(t):
    return rounded(G.residual_correlation(t["graded"].where("model_version = 'v1.0'"), _FEATURES).drop("p_win", "p_margin"))


@query("agg_16_adjusted_p", f"""WITH m AS (SELECT g.*, subgroup FROM graded g, {_SUBGROUPS_SQL} WHERE {_IN_GROUP}),
a AS (SELECT model_version || ':' || subgroup AS subgroup, abs(avg(home_win - p_home) * count(*) / sqrt(sum(p_home * (1 - p_home)))) AS z FROM m GROUP BY 1),
p AS (SELECT subgroup, 2 * (1 - {S.normal_cdf_sql('z')}) AS p FROM a), r AS (SELECT *, row_number() OVER (ORDER BY p, subgroup) AS k, count(*) OVER () AS n FROM p)
SELECT subgroup, round(p, 6) AS p, round(least(1, min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def agg_16(t):
    a = G.melt_groups(t["graded"], subgroups()).groupBy(F.concat_ws(":", "model_version", "subgroup").alias("subgroup")).agg(F.abs(F.avg(F.col("home_win") - F.col("p_home")) * F.count("*") / F.sqrt(F.sum(F.col("p_home") * (1 - F.col("p_home"))))).alias("z"))
    return rounded(G.adjusted(a.select("subgroup", (2 * (1 - S.normal_cdf(F.col("z")))).alias("p")), "p"))


@query("agg_17_drift", f"""WITH g AS (SELECT season AS fold, {_LL} AS ll FROM graded WHERE model_version = 'v1.0'), n AS (SELECT max(fold) AS f FROM g)
SELECT round(avg(ll) FILTER (fold = f), 6) AS last_fold, count(*) FILTER (fold = f) AS n_last, round(avg(ll) FILTER (fold <> f), 6) AS earlier, count(*) FILTER (fold <> f) AS n_earlier,
round((avg(ll) FILTER (fold = f) - avg(ll) FILTER (fold <> f)) / sqrt(var_samp(ll) FILTER (fold = f) / count(*) FILTER (fold = f) + var_pop(ll) FILTER (fold <> f) / count(*) FILTER (fold <> f)), 6) AS z FROM g, n""")
def agg_17(t):
    return rounded(G.drift(t["graded"].where("model_version = 'v1.0'").withColumn("fold", F.col("season"))))


@query("agg_18_degradation", f"SELECT model_version, count(*) AS n, round((avg({_LL}) - 5e-1) / (stddev_samp({_LL}) / sqrt(count(*))), 6) AS z FROM graded WHERE origin = 'live' GROUP BY 1 HAVING count(*) >= 150")
def agg_18(t):
    ll = S.log_loss(F.col("p_home"), F.col("home_win"))
    out = t["graded"].where("origin = 'live'").groupBy("model_version").agg(F.count("*").alias("n"), ((F.avg(ll) - 0.5) / (F.stddev_samp(ll) / F.sqrt(F.count("*")))).alias("z"))
    return rounded(out.where("n >= 150"))


@query("agg_19_new_contests", "SELECT count(*) AS n FROM contest_avail WHERE avail > TIMESTAMP '1998-06-01' AND avail <= TIMESTAMP '2000-01-01'")
def agg_19(t):
    from ..operators.availability import with_availability

    a = with_availability(t["contest"], 270)
    return a.agg(F.count_if((F.col("avail") > F.lit("1998-06-01").cast("timestamp_ntz")) & (F.col("avail") <= F.lit("2000-01-01").cast("timestamp_ntz"))).alias("n"))


_MEMBERS = "SELECT season, home_win, p_home, 1 / (1 + exp(-pred_margin / 10)) AS p_margin, 5e-1 AS p_even FROM graded"


@query("agg_20_member_comparison", f"WITH m AS ({_MEMBERS}), l AS (SELECT 'p_home' AS member, season, home_win, p_home FROM m UNION ALL SELECT 'p_margin', season, home_win, p_margin FROM m UNION ALL SELECT 'p_even', season, home_win, p_even FROM m) SELECT member, season, count(*) AS n, round(avg(CAST({_CORRECT} AS DOUBLE)), 6) AS accuracy, round(avg((p_home - home_win) * (p_home - home_win)), 6) AS brier, round(avg({_LL}), 6) AS log_loss FROM l GROUP BY 1, 2")
def agg_20(t):
    m = t["graded"].select("season", "home_win", "p_home", S.expit(F.col("pred_margin") / 10).alias("p_margin"), F.lit(0.5).alias("p_even"))
    return rounded(G.by_member(m, ["p_home", "p_margin", "p_even"], ["season"]))


@query("agg_27_status_counts", "SELECT origin, count(*) AS n, count(*) FILTER (c.game_id IS NULL) AS pending FROM prediction p LEFT JOIN (SELECT game_id FROM contest WHERE game_id % 3 <> 0) c ON p.game_id = c.game_id GROUP BY 1")
def agg_27(t):
    known = t["contest"].where("game_id % 3 <> 0").select("game_id", F.lit(True).alias("known"))
    return t["prediction"].join(known, "game_id", "left").groupBy("origin").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("pending"))


@query("agg_28_scorecard", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY game_id, model_version ORDER BY created DESC, pred_id DESC) AS k FROM graded)
SELECT model_version, season, CAST(sum(CASE WHEN {_CORRECT} THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(sum(greatest(p_home, 1 - p_home)), 4) AS expected, round(avg((p_home - home_win) * (p_home - home_win)), 6) AS brier,
round(avg({_LL}), 6) AS log_loss, round(avg(abs(pred_margin - margin)), 6) AS margin_mae FROM l WHERE k = 1 GROUP BY 1, 2""")
def agg_28(t):
    g = G.latest(G.grade(t["prediction"], t["contest"]), ["game_id", "model_version"]).withColumn("season", F.year("kickoff"))
    out = g.groupBy("model_version", "season").agg(F.sum("correct").alias("correct"), F.round(F.sum(S.pick_probability(F.col("p_home"))), 4).alias("expected"), F.avg("brier").alias("brier"), F.avg("logloss").alias("log_loss"), F.avg(F.abs("margin_error")).alias("margin_mae"))
    return rounded(out)


# --- functions


@query("sca_1_clip_logit", "SELECT pred_id, round(ln(least(greatest(p_home, 1e-4), 1 - 1e-4) / (1 - least(greatest(p_home, 1e-4), 1 - 1e-4))), 6) AS l, round(1 / (1 + exp(-pred_margin / 10)), 6) AS p FROM prediction")
def sca_1(t):
    return rounded(t["prediction"].select("pred_id", S.logit(F.col("p_home")).alias("l"), S.expit(F.col("pred_margin") / 10).alias("p")))


@query("sca_2_row_losses", f"SELECT pred_id, round({_LL}, 6) AS ll, round((p_home - home_win) * (p_home - home_win), 6) AS b FROM graded")
def sca_2(t):
    return rounded(t["graded"].select("pred_id", S.log_loss(F.col("p_home"), F.col("home_win")).alias("ll"), S.brier(F.col("p_home"), F.col("home_win")).alias("b")))


@query("sca_8_consistent_margin", f"WITH c AS (SELECT pred_id, pred_margin, least(greatest(p_home, 0.001), 0.999) AS p FROM prediction) SELECT pred_id, round(0.5 * pred_margin + 0.5 * 16 * {S.normal_quantile_sql('p')}, 6) AS m FROM c")
def sca_8(t):
    return rounded(t["prediction"].select("pred_id", S.consistent_margin(F.col("pred_margin"), F.col("p_home"), 16.0).alias("m")))


@query("sca_9_normal_cdf", f"SELECT pred_id, round({S.normal_cdf_sql('(pred_margin / 16e0)')}, 6) AS p, round(2 * (1 - {S.normal_cdf_sql('abs(pred_margin / 16e0)')}), 6) AS two_sided FROM prediction")
def sca_9(t):
    z = F.col("pred_margin") / 16
    return rounded(t["prediction"].select("pred_id", S.normal_cdf(z).alias("p"), (2 * (1 - S.normal_cdf(F.abs(z)))).alias("two_sided")))


_SD = "abs(p_home - 1 / (1 + exp(-pred_margin / 10))) / sqrt(2e0)"
_SPLIT = "CASE WHEN (p_home >= 0.5) <> (pred_margin >= 0) THEN 1 ELSE 0 END"


def _members(t):
    p, m = F.col("p_home"), S.expit(F.col("pred_margin") / 10)
    members = F.array(p, m)
    mean = (p + m) / 2
    sd = F.sqrt(F.aggregate(members, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / (F.size(members) - 1))
    return t["prediction"].select("*", F.least(p, m).alias("low"), F.greatest(p, m).alias("high"), sd.alias("sd"), ((p >= 0.5) != (m >= 0.5)).cast("int").alias("split"))


@query("sca_10_confidence", f"SELECT pred_id, round(least(greatest(10 * power(abs(2 * p_home - 1), 0.75) - 10 * {_SD} - {_SPLIT} - 0.75 * (pred_id % 2), 1), 10), 6) AS confidence FROM prediction")
def sca_10(t):
    return rounded(_members(t).select("pred_id", S.confidence(F.col("p_home"), F.col("sd"), F.col("split"), F.col("pred_id") % 2, F.lit(0)).alias("confidence")))


@query("sca_11_projected_scores", "SELECT pred_id, greatest((pred_total + pred_margin) / 2, 0) AS home, greatest((pred_total - pred_margin) / 2, 0) AS away, CASE WHEN p_home >= 0.5 THEN 'home' ELSE 'away' END AS pick, round(least(p_home, 1 - p_home), 6) AS upset FROM prediction")
def sca_11(t):
    p, m, s = F.col("p_home"), F.col("pred_margin"), F.col("pred_total")
    return rounded(t["prediction"].select("pred_id", F.greatest((s + m) / 2, F.lit(0.0)).alias("home"), F.greatest((s - m) / 2, F.lit(0.0)).alias("away"), F.when(p >= 0.5, "home").otherwise("away").alias("pick"), F.least(p, 1 - p).alias("upset")))


@query("sca_12_member_spread", f"SELECT pred_id, round(least(p_home, 1 / (1 + exp(-pred_margin / 10))), 6) AS low, round(greatest(p_home, 1 / (1 + exp(-pred_margin / 10))), 6) AS high, round({_SD}, 6) AS sd, {_SPLIT} AS split FROM prediction")
def sca_12(t):
    return rounded(_members(t).select("pred_id", "low", "high", "sd", "split"))


@query("sca_13_disagreement", f"SELECT pred_id, {_SD} >= 0.08 OR {_SPLIT} = 1 AS disagrees, game_id % 12 < 4 AS thin FROM prediction")
def sca_13(t):
    return _members(t).select("pred_id", ((F.col("sd") >= 0.08) | (F.col("split") == 1)).alias("disagrees"), (F.col("game_id") % 12 < 4).alias("thin"))


@query("sca_14_season", "SELECT game_id, CAST(year(kickoff) - CASE WHEN month(kickoff) < 7 THEN 1 ELSE 0 END AS INTEGER) AS s FROM contest")
def sca_14(t):
    return t["contest"].select("game_id", S.season_of(F.col("kickoff")).alias("s"))


@query("sca_15_iso_week", "SELECT game_id, strftime(kickoff, '%G-%V') AS week FROM contest")
def sca_15(t):
    return t["contest"].select("game_id", S.iso_week(F.col("kickoff")).alias("week"))


@query("sca_16_local_time", "SELECT game_id, strftime(timezone('America/New_York', timezone('UTC', kickoff)), '%Y-%m-%d %H:%M') AS l FROM contest")
def sca_16(t):
    return t["contest"].select("game_id", F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("kickoff")), "yyyy-MM-dd HH:mm").alias("l"))


@query("sca_17_normal_names", "SELECT p_partkey, trim(regexp_replace(regexp_replace(strip_accents(lower(replace(p_name, 'e', 'É-'))), '[^a-z0-9&() ]', ' ', 'g'), ' +', ' ', 'g')) AS n FROM part")
def sca_17(t):
    return t["part"].select("p_partkey", S.normal_name(F.replace(F.col("p_name"), F.lit("e"), F.lit("É-"))).alias("n"))


@query("sca_18_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || '}' AS j FROM events")
def sca_18(t):
    return t["events"].select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("j"))


@query("sca_19_sha256", "SELECT event_id, sha256(event_type || ':' || event_id) AS h FROM events")
def sca_19(t):
    return t["events"].select("event_id", F.sha2(F.concat_ws(":", "event_type", F.col("event_id").cast("string")), 256).alias("h"))


@query("sca_20_patterns", "SELECT event_id, regexp_matches(event_type, '^(click|view)') AS m, contains(props, '9') AS c FROM events")
def sca_20(t):
    return t["events"].select("event_id", F.col("event_type").rlike("^(click|view)").alias("m"), F.contains("props", F.lit("9")).alias("c"))


_ASKED = "SELECT game_id, CASE game_id % 3 WHEN 0 THEN 'Supplier ' || home_id || ' vs Supplier ' || away_id WHEN 1 THEN 'Supplier ' || away_id || ' @ Supplier ' || home_id ELSE 'nothing' END AS q FROM contest"


@query("sca_21_pair_queries", f"SELECT game_id, regexp_extract(q, '^(.+?) +(vs|@) +(.+)$', 1) AS a, regexp_extract(q, '^(.+?) +(vs|@) +(.+)$', 3) AS b, contains(q, '@') AS b_hosts FROM ({_ASKED}) WHERE regexp_matches(q, '^(.+?) +(vs|@) +(.+)$')")
def sca_21(t):
    pattern = r"^(.+?)\s+(vs\.?|@|at)\s+(.+)$"
    part = lambda i: F.regexp_extract("q", pattern, i)
    return t.sql(_ASKED).where(F.col("q").rlike(pattern)).select("game_id", part(1).alias("a"), part(3).alias("b"), part(2).isin("@", "at").alias("b_hosts"))


@query("sca_22_config_difference", """WITH a AS (SELECT CAST(user_id AS VARCHAR) || '.' || event_type AS k, count(*) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1),
b AS (SELECT CAST(user_id AS VARCHAR) || '.' || event_type AS k, count(*) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS key, a.v AS was, b.v AS now FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def sca_22(t):
    from ..operators.tables import difference

    def config(odd):
        e = t["events"].where(F.col("event_id") % 2 == odd)
        by = e.groupBy("user_id", "event_type").agg(F.count("*").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
        return by.select(F.explode("m").alias("k", "v"), "user_id").select(F.concat_ws(".", F.col("user_id").cast("string"), "k").alias("key"), "v")

    return difference(config(0), config(1))


# --- sorts and short lists


@query("srt_2_worst_misses", f"SELECT pred_id, round({_LL}, 6) AS ll FROM graded ORDER BY {_LL} DESC, pred_id LIMIT 10")
def srt_2(t):
    return rounded(t["graded"].select("pred_id", S.log_loss(F.col("p_home"), F.col("home_win")).alias("ll")).orderBy(F.desc("ll"), "pred_id").limit(10))


@query("srt_3_highlights", """WITH s AS (SELECT pred_id, p_home, greatest(p_home, 1 - p_home) AS pp FROM prediction WHERE model_version = 'v1.1'),
a AS (SELECT 'confident' AS list, pred_id, row_number() OVER (ORDER BY pp DESC, pred_id) AS k FROM s), b AS (SELECT 'closest' AS list, pred_id, row_number() OVER (ORDER BY pp, pred_id) AS k FROM s),
c AS (SELECT 'upset' AS list, pred_id, row_number() OVER (ORDER BY 1 - pp DESC, pred_id) AS k FROM s WHERE 1 - pp >= 0.35)
SELECT list, pred_id, CAST(k AS INTEGER) AS k FROM (FROM a UNION ALL FROM b UNION ALL FROM c) WHERE k <= 5""")
def srt_3(t):
    from ..operators.sequence import top

    s = t["prediction"].where("model_version = 'v1.1'").select("pred_id", S.pick_probability(F.col("p_home")).alias("pp"))
    lists = top(s, "confident", F.desc("pp")), top(s, "closest", F.asc("pp")), top(s.where(1 - F.col("pp") >= 0.35), "upset", (1 - F.col("pp")).desc())
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


@query("srt_4_recent", "SELECT pred_id, model_version FROM graded ORDER BY kickoff DESC, pred_id LIMIT 25")
def srt_4(t):
    return t["graded"].orderBy(F.desc("kickoff"), "pred_id").select("pred_id", "model_version").limit(25)


@query("win_10_latest_prediction", "SELECT pred_id, game_id FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY created DESC, pred_id DESC) AS k FROM prediction) WHERE k = 1")
def win_10(t):
    return G.latest(t["prediction"], ["game_id"]).select("pred_id", "game_id")


# --- joins of logs and results


@query("join_1_completed", "SELECT c.game_id, o.o_orderstatus FROM contest c JOIN orders o ON c.game_id = o.o_orderkey")
def join_1(t):
    o = t["orders"].select(F.col("o_orderkey").alias("game_id"), "o_orderstatus")
    return t["contest"].select("game_id", "kickoff").join(o, "game_id").orderBy("kickoff", "game_id").select("game_id", "o_orderstatus")


@query("join_2_stats_json", "SELECT e.event_id, p.type, CAST(json_extract(e.props, '$.k') AS BIGINT) AS k FROM events e JOIN play p ON e.user_id = p.event_key AND e.ts = p.ts AND e.event_type = p.type")
def join_2(t):
    e = t["events"].select("event_id", "ts", F.col("user_id").alias("event_key"), F.col("event_type").alias("type"), F.from_json("props", "k BIGINT").alias("j"))
    return t["play"].select("event_key", "ts", "type").join(e, ["event_key", "ts", "type"]).select("event_id", "type", "j.*")


@query("join_3_evaluated", f"SELECT pred_id, model_version, CAST({_CORRECT} AS INTEGER) AS correct FROM graded")
def join_3(t):
    return t["prediction"].select("pred_id", "model_version").join(G.grade(t["prediction"], t["contest"]).select("pred_id", "correct"), "pred_id")


@query("join_4_pending", "SELECT pred_id FROM prediction WHERE game_id NOT IN (SELECT game_id FROM contest WHERE game_id % 4 <> 0) AND pred_id % 5 <> 0")
def join_4(t):
    results, void = t["contest"].where("game_id % 4 <> 0").select("game_id"), t["prediction"].where("pred_id % 5 = 0").select("pred_id")
    return t["prediction"].join(results, "game_id", "left_anti").join(void, "pred_id", "left_anti").select("pred_id")


@query("join_11_scorecard_split", "SELECT p.pred_id, CASE WHEN c.game_id IS NULL THEN 'pending' ELSE 'done' END AS status FROM prediction p LEFT JOIN (SELECT game_id FROM contest WHERE season < 2000) c ON c.game_id = p.game_id")
def join_11(t):
    done = t["contest"].where("season < 2000").select("game_id", F.lit("done").alias("status"))
    return t["prediction"].join(done, "game_id", "left").select("pred_id", F.coalesce("status", F.lit("pending")).alias("status"))


# --- gates and tests of candidates

_HALF = "CASE WHEN season < 1998 THEN 'select' ELSE 'confirm' END"


@query("ml_17_block_bootstrap", f"""WITH d AS (SELECT a.game_id, strftime(a.kickoff, '%G-%V') AS week, ll_a - ll_b AS gain FROM (SELECT *, {_LL} AS ll_a FROM graded WHERE model_version = 'v1.0') a
  JOIN (SELECT game_id, {_LL} AS ll_b FROM graded WHERE model_version = 'v1.1') b ON a.game_id = b.game_id),
w AS (SELECT week, sum(gain) AS s, count(*) AS n, row_number() OVER (ORDER BY week) - 1 AS i, count(*) OVER () AS k FROM d GROUP BY week),
r AS (SELECT range AS rep FROM range(2000)), x AS (SELECT rep, w.k, CAST('0x' || left(md5('42:' || rep || ':' || w.i), 15) AS BIGINT) % w.k AS pick FROM r, w),
b AS (SELECT rep, sum(w.s) / sum(w.n) AS gain FROM x JOIN w ON x.pick = w.i GROUP BY rep)
SELECT round(quantile_cont(gain, 0.05), 6) AS low, round(quantile_cont(gain, 0.95), 6) AS high, round(avg(CASE WHEN gain <= 0 THEN 1e0 ELSE 0e0 END), 6) AS p_value, count(*) AS reps FROM b""")
def ml_17(t):
    from ..operators.folds import block_bootstrap

    g = t["graded"].withColumn("ll", S.log_loss(F.col("p_home"), F.col("home_win")))
    a = g.where("model_version = 'v1.0'").select("game_id", "kickoff", F.col("ll").alias("a"))
    d = a.join(g.where("model_version = 'v1.1'").select("game_id", F.col("ll").alias("b")), "game_id")
    return rounded(block_bootstrap(d.select(S.iso_week(F.col("kickoff")).alias("week"), (F.col("a") - F.col("b")).alias("gain")), reps=2000))


@query("ml_18_promotion_gates", f"""WITH m AS (SELECT model_version, count(*) AS n, avg({_LL}) AS ll, avg((p_home - home_win) * (p_home - home_win)) AS b FROM graded GROUP BY 1)
SELECT c.n >= 1000 AS min_sample, a.ll - c.ll >= 0.002 AS effect_size, c.b <= a.b AS brier_not_worse FROM m a, m c WHERE a.model_version = 'v1.0' AND c.model_version = 'v1.1'""")
def ml_18(t):
    by = t["graded"].groupBy().pivot("model_version", ["v1.0", "v1.1"]).agg(F.count("pred_id").alias("n"), F.avg(S.log_loss(F.col("p_home"), F.col("home_win"))).alias("ll"), F.avg(S.brier(F.col("p_home"), F.col("home_win"))).alias("b"))
    c = lambda v, k: F.col(f"`{v}_{k}`")
    return by.select((c("v1.1", "n") >= 1000).alias("min_sample"), (c("v1.0", "ll") - c("v1.1", "ll") >= 0.002).alias("effect_size"), (c("v1.1", "b") <= c("v1.0", "b")).alias("brier_not_worse"))


@query("ml_19_selection", f"WITH h AS (SELECT model_version, {_HALF} AS part, {_LL} AS ll FROM graded) SELECT model_version, part, count(*) AS n, round(avg(ll), 6) AS ll FROM h GROUP BY 1, 2")
def ml_19(t):
    part = F.when(F.col("season") < 1998, "select").otherwise("confirm")
    return rounded(t["graded"].groupBy("model_version", part.alias("part")).agg(F.count("*").alias("n"), F.avg(S.log_loss(F.col("p_home"), F.col("home_win"))).alias("ll")))


@query("srt_6_best_candidate", f"WITH h AS (SELECT model_version, avg({_LL}) AS ll FROM graded WHERE season < 1998 GROUP BY 1) SELECT arg_min(model_version, ll) AS best, round(min(ll), 6) AS ll FROM h WHERE model_version <> 'v1.0' AND ll < (SELECT ll FROM h WHERE model_version = 'v1.0')")
def srt_6(t):
    h = t["graded"].where("season < 1998").groupBy("model_version").agg(F.avg(S.log_loss(F.col("p_home"), F.col("home_win"))).alias("ll"))
    champion = h.where("model_version = 'v1.0'").select(F.col("ll").alias("_c"))
    better = h.where("model_version <> 'v1.0'").join(F.broadcast(champion)).where("ll < _c")
    return rounded(better.agg(F.min_by("model_version", "ll").alias("best"), F.min("ll").alias("ll")))


@query("ml_21_due", f"WITH z AS (SELECT (avg({_LL}) - 5e-1) / (stddev_samp({_LL}) / sqrt(count(*))) AS z FROM graded WHERE origin = 'live' AND model_version = 'v1.1'), n AS (SELECT count(*) AS n FROM contest_avail WHERE avail > TIMESTAMP '1998-06-01') SELECT n, z > 3 OR n >= 100 AS due FROM z, n")
def ml_21(t):
    ll = S.log_loss(F.col("p_home"), F.col("home_win"))
    z = t["graded"].where("origin = 'live' AND model_version = 'v1.1'").agg(((F.avg(ll) - 0.5) / (F.stddev_samp(ll) / F.sqrt(F.count("*")))).alias("z"))
    n = t["contest_avail"].where(F.col("avail") > F.lit("1998-06-01").cast("timestamp_ntz")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(z)).select("n", ((F.col("z") > 3) | (F.col("n") >= 100)).alias("due"))
