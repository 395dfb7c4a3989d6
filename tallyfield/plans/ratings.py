"""Queries on ratings and features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import availability as A
from ..operators import features as X
from ..operators import ratings as R
from ..operators import sequence as Q
from ..sources.parted import PartedTable
from ..sources.shared import checkpointed, fresh, stored
from .grading import rounded
from .registry import query

POINT = (36.0, 45.0, 0.25)


def _grid(t, points):
    return t.spark.createDataFrame(points, "k double, home double, revert double")


def _pooled(t):
    """Contests with their pools, which are the connected groups of sides, and the divisions of both sides."""
    t.keep("contest")
    known = A.divisions(t["contest"])
    c = R.pools(t["contest_avail"])
    for side in ("home", "away"):
        c = A.division_of(c.withColumn("team", F.col(f"{side}_id")), known).withColumnRenamed("division", f"{side}_division").drop("team")
    return c


@query("rat_1_elo")
def rat_1(t):
    return rounded(R.elo(_pooled(t), _grid(t, [POINT])))


@query("rat_2_season_regression")
def rat_2(t):
    """Ratings at the first contest of each entity's season, which follow the regression."""
    e = R.elo(_pooled(t), _grid(t, [POINT, (36.0, 45.0, 0.0)]))
    return rounded(R.season_starts(e).select("pool", "revert", "season", "team", "first_rating"), 3)


@query("rat_3_elo_grid")
def rat_3(t):
    points = [(k, h, r) for k in (24.0, 36.0, 48.0) for h in (30.0, 45.0) for r in (0.25, 0.4)]
    c = _pooled(t).withColumns({"flat": F.col("neutral"), "y": (F.col("home_score") > F.col("away_score")).cast("int")})
    e = R.elo(c, _grid(t, points), carry=("flat", "y")).where("season >= 1997")
    p = S.expit((F.col("elo_home") + F.when(F.col("flat") == 1, 0).otherwise(F.col("home")) - F.col("elo_away")) / 400 * F.log(F.lit(10.0)))
    by = e.groupBy("k", "home", "revert").agg(F.avg(S.log_loss(p, F.col("y"))).alias("ll"))
    return rounded(by.agg(F.min_by(F.struct("k", "home", "revert"), "ll").alias("best"), F.min("ll").alias("ll")).select("best.*", "ll"))


@query("rat_4_rating_asof")
def rat_4(t):
    history = R.rating_history(R.elo(_pooled(t), _grid(t, [POINT])))
    targets = t["contest"].select("game_id", F.col("home_id").alias("team"), F.col("kickoff").alias("cutoff"))
    return rounded(A.running_asof(targets, history, ["team"], {"rating": lambda w: F.last("_rating", ignorenulls=True).over(w)}, target_id=["game_id"], order=["kickoff", "game_id"]).select("game_id", "rating"))


@query("rat_5_ridge")
def rat_5(t):
    return rounded(R.ridge_per_group(t["obs"], ["season"], 8.0))


@query("rat_5_ridge_sweeps")
def rat_5_sweeps(t):
    return rounded(R.ridge_by_sweeps(t["obs"], ["season"], 8.0), 3)


def _memo(t):
    """An empty memo of solutions."""
    return PartedTable(t.spark, fresh(t.spark, "finals"), t.spark.createDataFrame([], R.FINALS).schema, "season")


def _divisions(t):
    """The division of each side in each season that it plays in, from this season or one of the two before."""
    c = t["contest"]
    sides = c.select("season", F.col("home_id").alias("team")).unionByName(c.select("season", F.col("away_id").alias("team"))).distinct()
    return A.division_of(sides, A.divisions(c))


@query("rat_6_priors_by_season")
def rat_6(t):
    """Ratings by points at the end of each season, from priors that are the finals before, shrunk to the mean of the side's division."""
    t.keep("contest")
    obs = stored(t["obs"].select("season", "avail", "off_id", "def_id", "loc", "y", F.lit("points").alias("metric")), "obs")
    ends = obs.groupBy("season").agg(F.max("avail").alias("cutoff"))
    return rounded(R.ratings_at(obs, ends, _divisions(t), _memo(t)).drop("cutoff", "metric"))


_STATS = ["price_pp", "disc_rate", "return_rate", "tax_f"]


def _observed(t):
    """Each side's row of a contest beside its four statistics."""
    stats = t["entity_stats"].select("game_id", F.col("team_id").alias("off_id"), *_STATS)
    return t["obs"].select("season", "kickoff", "game_id", "off_id", "def_id", "loc").join(stats, ["game_id", "off_id"])


def _long(rows):
    """A row for each statistic that is there."""
    return rows.unpivot([c for c in rows.columns if c not in _STATS], _STATS, "metric", "y").where("y IS NOT NULL")


def _metrics(t):
    """Observations of each metric: the points, and four statistics of the entity. Rows move before they become four."""
    t.keep("contest")
    return _long(_observed(t))


@query("rat_7_metrics")
def rat_7(t):
    return rounded(R.ridge_per_group(_metrics(t), ["metric", "season"], 8.0))


def _all_metrics(t):
    """Points and the statistics of the entities, as rows of a metric, when they become available."""
    t.keep("contest")
    o = t["obs"].select("season", "avail", "game_id", "off_id", "def_id", "loc", "y")
    stats = _long(_observed(t).join(o.select("game_id", "off_id", "avail"), ["game_id", "off_id"]))
    points = o.withColumn("metric", F.lit("points"))
    return points.unionByName(stats.select(*points.columns))


@query("rat_7_ratings_at_cutoffs")
def rat_7_cutoffs(t):
    """Ratings of all metrics at the beginning of each month in which a season is played."""
    t.keep("contest")
    cutoffs = t["contest"].select("season", F.date_trunc("month", "kickoff").cast("timestamp_ntz").alias("cutoff")).distinct()
    return rounded(R.ratings_at(stored(_all_metrics(t).drop("game_id"), "obs"), cutoffs, _divisions(t), _memo(t)))


@query("rat_8_weekly_table")
def rat_8(t):
    """Ratings of each metric before each week of a season, from what was played in its earlier weeks."""
    t.keep("contest")
    y = t["obs"].select("season", "kickoff", "off_id", "def_id", "loc", F.lit("points").alias("metric"), "y")
    every = y.unionByName(_metrics(t).select(*y.columns)).withColumn("week", F.floor((F.dayofyear("kickoff") - 1) / 7).cast("int"))
    return rounded(R.ridge_before(every, ["metric", "season"], "week", 8.0))


# --- features

_MEANS = "r AS (SELECT season, off_id AS team, avg(y) AS o, avg(margin) AS m FROM obs GROUP BY 1, 2), a AS (SELECT season, def_id AS team, avg(y) AS d FROM obs GROUP BY 1, 2), s AS (SELECT season, team, o, d, m FROM r JOIN a USING (season, team))"
_SIDED = f"{_MEANS}, x AS (SELECT c.*, h.o AS o_h, h.d AS d_h, h.m AS m_h, v.o AS o_a, v.d AS d_a, v.m AS m_a FROM contest c LEFT JOIN s h ON h.season = c.season AND h.team = c.home_id LEFT JOIN s v ON v.season = c.season AND v.team = c.away_id)"


def _sided(t):
    r = t["obs"].groupBy("season", F.col("off_id").alias("team")).agg(F.avg("y").alias("o"), F.avg("margin").alias("m"))
    a = t["obs"].groupBy("season", F.col("def_id").alias("team")).agg(F.avg("y").alias("d"))
    return X.both_sides(t["contest"], r.join(a, ["season", "team"]), ["season"], ["o", "d", "m"])


@query("fea_1_expected_points", f"WITH {_SIDED}, p AS (SELECT game_id, 1 + o_h + d_a + CASE WHEN neutral = 1 THEN 0 ELSE 2 END AS h, 1 + o_a + d_h - CASE WHEN neutral = 1 THEN 0 ELSE 2 END AS v FROM x) SELECT game_id, round(h, 6) AS pp_home, round(v, 6) AS pp_away, round(h - v, 6) AS pts_margin, round(h + v, 6) AS pts_total, round(abs(h - v), 6) AS abs_margin FROM p")
def fea_1(t):
    ep = X.expected_points(F.lit(1.0), F.lit(2.0), F.col("neutral"), *(F.col(c) for c in ("o_home", "d_home", "o_away", "d_away")))
    return rounded(_sided(t).select("game_id", *(c.alias(k) for k, c in ep.items())))


@query("fea_2_matchups", f"WITH {_SIDED} SELECT game_id, round((o_h + d_a) - (o_a + d_h), 6) AS mx_y FROM x")
def fea_2(t):
    names = {f"{k}_{s}": f"{k}_y_{s}" for k in "od" for s in ("home", "away")}
    return rounded(_sided(t).withColumnsRenamed(names).select("game_id", *X.matchups(["y"])))


_METRICS = ("disc_rate", "points", "price_pp", "return_rate", "tax_f")
_MEAN_RATINGS = """lg AS (SELECT o.season, o.off_id, o.def_id, u.metric, u.v FROM obs o JOIN (SELECT game_id, team_id, 'price_pp' AS metric, price_pp AS v FROM entity_stats UNION ALL SELECT game_id, team_id, 'disc_rate', disc_rate FROM entity_stats
  UNION ALL SELECT game_id, team_id, 'return_rate', return_rate FROM entity_stats UNION ALL SELECT game_id, team_id, 'tax_f', tax_f FROM entity_stats) u ON u.game_id = o.game_id AND u.team_id = o.off_id
  UNION ALL SELECT season, off_id, def_id, 'points', y FROM obs),
ro AS (SELECT season, off_id AS team, metric, avg(v) AS o FROM lg GROUP BY 1, 2, 3), rd AS (SELECT season, def_id AS team, metric, avg(v) AS d FROM lg GROUP BY 1, 2, 3), rr AS (SELECT season, team, metric, o, d FROM ro JOIN rd USING (season, team, metric)),
wd AS (SELECT season, team, """ + ", ".join(f"max({u}) FILTER (metric = '{m}') AS {u}_{m}" for m in _METRICS for u in "od") + " FROM rr GROUP BY 1, 2)"
_UNITS = ", ".join(f"round({k}.{u}_{m} + 1e-10, 6) AS {u}_{m}_{s}" for m in _METRICS for u in "od" for k, s in (("h", "home"), ("v", "away")))
_MX = ", ".join(f"round((h.o_{m} + v.d_{m}) - (v.o_{m} + h.d_{m}) + 1e-10, 6) AS mx_{m}" for m in _METRICS)
_ENV = ", ".join(f"round({a}.o_{m} + {b}.d_{m} + 1e-10, 6) AS env_{m}_{s}" for m in ("price_pp", "return_rate") for a, b, s in (("h", "v", "home"), ("v", "h", "away")))


@query("fea_2_unit_ratings", f"WITH {_MEAN_RATINGS} SELECT c.game_id, {_UNITS}, {_MX}, {_ENV} FROM contest c LEFT JOIN wd h ON h.season = c.season AND h.team = c.home_id LEFT JOIN wd v ON v.season = c.season AND v.team = c.away_id")
def fea_2_units(t):
    """Units of both sides by the season's means of all metrics, their matchups, and the environment of two metrics."""
    t.keep("contest")
    stats = t["entity_stats"].select("game_id", F.col("team_id").alias("off_id"), *(m for m in _METRICS if m != "points"))
    every = t["obs"].select("game_id", "season", "off_id", "def_id", F.col("y").alias("points")).join(stats, ["game_id", "off_id"], "left")
    out = X.units(t["contest"], X.mean_units(every, list(_METRICS)), list(_METRICS), ["price_pp", "return_rate"])
    return rounded(out.select("game_id", *((F.col(c) + 1e-10).alias(c) for c in out.columns if c != "game_id")))  # halves of the last digit all go up


@query("fea_3_form_and_rest", """WITH f AS (SELECT game_id, off_id AS team, avg(margin) OVER (PARTITION BY off_id, season ORDER BY kickoff, game_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS form3,
count(*) OVER (PARTITION BY off_id, season ORDER BY kickoff, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM obs)
SELECT c.game_id, round(coalesce(h.form3, 0) - coalesce(a.form3, 0), 6) AS form_diff, CAST(h.prior + a.prior < 4 AS INTEGER) AS early FROM contest c JOIN f h ON h.game_id = c.game_id AND h.team = c.home_id JOIN f a ON a.game_id = c.game_id AND a.team = c.away_id""")
def fea_3(t):
    o = t["obs"].withColumnRenamed("off_id", "team")
    f = Q.rest_days(Q.form(o, "margin", "form3", 3, ["team", "season"], ["kickoff", "game_id"]), "kickoff", ["team", "season"], ["kickoff", "game_id"])
    x = X.both_sides(t["contest"], f.select("game_id", "team", "form3", "prior"), ["game_id"], ["form3", "prior"])
    form = F.coalesce("form3_home", F.lit(0.0)) - F.coalesce("form3_away", F.lit(0.0))
    return rounded(x.select("game_id", form.alias("form_diff"), (F.col("prior_home") + F.col("prior_away") < 4).cast("int").alias("early")))


def _targets(t):
    return t["contest"].select("game_id", "season", "kickoff", (F.col("kickoff") - A.minutes(60)).alias("cutoff"), "home_id", "away_id", "neutral")


def _ratings_asof(obs):
    """Ratings from earlier seasons, known when the season begins."""
    final = R.ridge_per_group(obs, ["season"], 8.0)
    ended = obs.groupBy("season").agg(F.max("avail").alias("as_of"))
    return final.join(ended, "season").withColumn("season", F.col("season") + 1)


@query("fea_4_point_in_time_build")
def fea_4(t):
    obs = checkpointed(t["obs"])  # read three times
    return rounded(X.build(checkpointed(_targets(t)), obs, _ratings_asof(obs)))


@query("fea_5_stale_rows", """WITH v AS (SELECT kickoff AS cutoff, (SELECT count(*) FROM contest_avail a WHERE a.avail <= k.kickoff AND a.game_id % 50 <> 3) AS was, (SELECT count(*) FROM contest_avail a WHERE a.avail <= k.kickoff) AS visible FROM (SELECT DISTINCT kickoff FROM contest) k),
c AS (SELECT game_id, was FROM contest JOIN v ON cutoff = kickoff WHERE game_id % 7 <> 0 UNION ALL SELECT -1, 5), l AS (SELECT game_id, visible FROM contest JOIN v ON cutoff = kickoff)
SELECT game_id, CASE WHEN l.visible IS NULL THEN 'drop' ELSE 'build' END AS action FROM c FULL JOIN l USING (game_id) WHERE c.was IS DISTINCT FROM l.visible""")
def fea_5(t):
    cut = t["contest"].select("game_id", F.col("kickoff").alias("cutoff"))
    facts = t["contest_avail"]
    then, now = (A.visible_counts(cut.select("cutoff"), f) for f in (facts.where("game_id % 50 <> 3"), facts))
    cached = cut.where("game_id % 7 <> 0").join(then, "cutoff").select("game_id", "visible").unionByName(t.spark.range(1).select(F.lit(-1).cast("long").alias("game_id"), F.lit(5).cast("long").alias("visible")))
    return X.stale(cached, now, cut)


@query("fea_6_leakage_audit", "SELECT game_id, 'margin' AS feature, 5e-1 * (home_score - away_score) AS stored, 5e-1 * (home_score - away_score) + 1 AS rebuilt FROM contest WHERE game_id % 40 = 0")
def fea_6(t):
    c = t["contest"].select("game_id", (0.5 * (F.col("home_score") - F.col("away_score"))).alias("margin"), "home_score")
    now = c.withColumn("margin", F.when(F.col("game_id") % 40 == 0, F.col("margin") + 1).otherwise(F.col("margin")))
    return X.audit(c, now, ["game_id"], ["margin", "home_score"])


_EDGE = " UNION ALL ".join(f"SELECT game_id, '{n}' AS feature, {sign} * ({c} - (SELECT avg({c}) FROM x)) / (SELECT stddev_samp({c}) FROM x) AS z FROM x" for n, c, sign in (("o_home", "o_h", 1), ("d_home", "d_h", -1), ("o_away", "o_a", -1), ("d_away", "d_a", 1)))
_TOP = f"WITH {_SIDED}, l AS ({_EDGE}), k AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY round(abs(z), 9) DESC, feature) AS k FROM l WHERE z IS NOT NULL)"


@query("fea_7_matchup_edges", f"{_TOP} SELECT game_id, feature, round(z, 6) AS z, CAST(k AS INTEGER) AS k, (z >= 0) = (game_id % 2 = 0) AS favours_pick FROM k WHERE k <= 4")
def fea_7(t):
    rows = _sided(t).withColumn("p", F.when(F.col("game_id") % 2 == 0, 1.0).otherwise(0.0))
    return rounded(X.edges(rows, "game_id", {"o_home": 1, "d_home": -1, "o_away": -1, "d_away": 1}, "p", 4))


@query("srt_5_top_edges", f"{_TOP} SELECT game_id, feature, CAST(k AS INTEGER) AS k FROM k WHERE k <= 3")
def srt_5(t):
    return X.edges(_sided(t).withColumn("p", F.lit(1.0)), "game_id", {"o_home": 1, "d_home": -1, "o_away": -1, "d_away": 1}, "p", 3).select("game_id", "feature", "k")


@query("fea_8_risk_flags", f"WITH {_SIDED} SELECT game_id, concat_ws(',', CASE WHEN neutral = 1 THEN 'neutral' END, CASE WHEN m_h * m_a < 0 THEN 'split' END, CASE WHEN collected < kickoff THEN 'early record' END) AS flags FROM x")
def fea_8(t):
    flags = X.risk_flags({"neutral": F.col("neutral") == 1, "split": F.col("m_home") * F.col("m_away") < 0, "early record": F.col("collected") < F.col("kickoff")})
    return _sided(t).select("game_id", F.array_join(flags, ",").alias("flags"))


#: Reports of players: each order line of a side is one, out or doubtful by its flag.
_REPORTS = "SELECT l_orderkey AS game_id, l_suppkey AS team, l_linenumber AS player, CASE WHEN l_partkey % 4 = 0 THEN 'QB' ELSE 'WR' END AS pos, CASE l_returnflag WHEN 'R' THEN 'Out' WHEN 'A' THEN 'Doubtful' ELSE 'Active' END AS status FROM lineitem"
_CHANGES = "SELECT game_id, off_id AS team, coalesce(CAST(def_id % 3 <> lag(def_id % 3) OVER (PARTITION BY off_id, season ORDER BY kickoff, game_id) AS INTEGER), 0) AS changed, row_number() OVER (PARTITION BY off_id, season ORDER BY kickoff, game_id) - 1 AS prior FROM obs"
_VOTES = "SELECT game_id, min(CAST(p_home >= 5e-1 AS INTEGER)) <> max(CAST(p_home >= 5e-1 AS INTEGER)) AS split, max(CASE WHEN model_version = 'v1.0' THEN p_home END) AS p FROM prediction GROUP BY 1"


@query("fea_8_all_risks", f"""WITH {_SIDED}, l AS ({_EDGE}), vt AS ({_VOTES}), ch AS ({_CHANGES}), ij AS (SELECT game_id, team, count(*) AS out, count(*) FILTER (pos = 'QB') AS key_out FROM ({_REPORTS}) WHERE status IN ('Out', 'Doubtful') GROUP BY 1, 2),
k AS (SELECT l.game_id, feature, (z >= 0) = (p >= 5e-1) AS favours, row_number() OVER (PARTITION BY l.game_id ORDER BY round(abs(z), 9) DESC, feature) AS k FROM l JOIN vt USING (game_id) WHERE z IS NOT NULL),
ct AS (SELECT game_id, arg_min(feature, k) AS counter FROM k WHERE NOT favours AND k <= 4 GROUP BY 1),
fl AS (SELECT c.game_id, concat_ws(',', CASE WHEN vt.split THEN 'members split' END, 'counter ' || counter, CASE WHEN h.changed = 1 THEN 'starter changed home' END, CASE WHEN v.changed = 1 THEN 'starter changed away' END, CASE WHEN h.prior + v.prior < 4 THEN 'early season' END,
  CASE WHEN hi.key_out > 0 THEN 'key player out home' END, CASE WHEN hi.out >= 2 THEN hi.out || ' players out home' END, CASE WHEN vi.key_out > 0 THEN 'key player out away' END, CASE WHEN vi.out >= 2 THEN vi.out || ' players out away' END) AS flags
  FROM contest c LEFT JOIN vt USING (game_id) LEFT JOIN ct USING (game_id) LEFT JOIN ch h ON h.game_id = c.game_id AND h.team = c.home_id LEFT JOIN ch v ON v.game_id = c.game_id AND v.team = c.away_id
  LEFT JOIN ij hi ON hi.game_id = c.game_id AND hi.team = c.home_id LEFT JOIN ij vi ON vi.game_id = c.game_id AND vi.team = c.away_id)
SELECT game_id, CASE WHEN flags = '' THEN 'single contest' ELSE flags END AS flags FROM fl""")
def fea_8_all(t):
    """All flags of a pick. A side has few order lines, so two players out are many here."""
    changes, votes = t.sql(_CHANGES), t.sql(_VOTES)
    sided = _sided(t).join(votes, "game_id")
    found = X.edges(sided, "game_id", {"o_home": 1, "d_home": -1, "o_away": -1, "d_away": 1}, "p", 4)
    prior = lambda s: changes.select("game_id", F.col("team").alias(f"{s}_id"), F.col("prior").alias(f"prior_{s}"))
    picks = t["contest"].join(votes, "game_id", "left").join(prior("home"), ["game_id", "home_id"]).join(prior("away"), ["game_id", "away_id"])
    picks = picks.select("game_id", "home_id", "away_id", "split", (F.col("prior_home") + F.col("prior_away") < 4).cast("int").alias("early"))
    risks = X.all_risks(picks, found, changes, X.injury_counts(t.sql(_REPORTS), ("QB",)), many=2)
    return risks.select("game_id", F.array_join("flags", ",").alias("flags"))


@query("fea_9_scale", "WITH " + _SIDED + ", l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, {c} AS x FROM x" for n, c in (("o_home", "o_h"), ("d_home", "d_h"), ("m_away", "m_a"))) + ") SELECT feature, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM l GROUP BY 1")
def fea_9(t):
    return rounded(X.scale_statistics(_sided(t), ["o_home", "d_home", "m_away"]))


@query("src_14_group_tree", """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS child, 'root' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
w AS (SELECT child, child AS top, 1 AS depth FROM e WHERE parent = 'root' UNION ALL SELECT e.child, w.top, w.depth + 1 FROM e JOIN w ON e.parent = w.child) SELECT child, top, depth FROM w""")
def src_14(t):
    from ..sources.documents import group_tops

    edge = lambda df, a, b, p, q: df.select(F.concat(F.lit(p), F.col(a).cast("string")).alias("child"), F.concat(F.lit(q), F.col(b).cast("string")).alias("parent"))
    parts = edge(t["nation"], "n_nationkey", "n_regionkey", "n", "r"), edge(t["supplier"], "s_suppkey", "s_nationkey", "s", "n")
    roots = t["region"].select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("root").alias("parent"))
    return group_tops(reduce(lambda a, b: a.unionByName(b), parts, roots))
