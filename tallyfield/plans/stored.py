"""Queries on stored features, the log of predictions, its audit, and the update cycle."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import scalars as S
from ..operators import availability as A
from ..operators import feature_store as P
from ..operators import features as X
from ..operators import models as M
from ..sources.parted import PartedTable
from ..sources.shared import checkpointed, fresh, stored
from ..streaming import jobs as J
from .grading import rounded
from .ratings import _ratings_asof, _targets
from .registry import query

#: The columns of the build that come from ratings, and those that come from the visible contests.
RATED = ["pp_home", "pp_away", "pts_margin", "pts_total", "abs_margin"]
HISTORY = ["n_home", "n_away", "form3_home", "form3_away", "form_diff", "rest_home", "rest_away", "early"]


def builder(obs):
    """The point-in-time build from these facts. Their ratings are solved at its first use and kept for others."""
    ratings = cache(lambda: checkpointed(_ratings_asof(obs)))
    return lambda targets: X.build(checkpointed(targets), obs, ratings())


def _history_sql(only: str = "true") -> str:
    """CTEs h and v: of both sides what is visible an hour before the start, of the facts for which ``only`` holds."""
    seen = """SELECT g.game_id, o.margin, o.kickoff, row_number() OVER (PARTITION BY g.game_id ORDER BY o.kickoff DESC, o.margin DESC) AS k, g.kickoff AS starts FROM contest g
  JOIN obs o ON o.season = g.season AND o.off_id = g.{0}_id AND o.avail <= g.kickoff - INTERVAL '1' HOUR WHERE {1}"""
    return ", ".join(f"{s} AS (SELECT game_id, count(*) AS n, avg(margin) FILTER (k <= 3) AS form3, least(floor(date_diff('second', max(kickoff), any_value(starts)) / 86400), 21) AS rest FROM ({seen.format(side, only)}) GROUP BY 1)" for s, side in (("h", "home"), ("v", "away")))


_COLUMNS = """game_id, coalesce(h.n, 0) AS n_home, coalesce(v.n, 0) AS n_away, round(coalesce(h.form3, 0), 6) AS form3_home, round(coalesce(v.form3, 0), 6) AS form3_away,
round(coalesce(h.form3, 0) - coalesce(v.form3, 0), 6) AS form_diff, CAST(coalesce(h.rest, 14) AS BIGINT) AS rest_home, CAST(coalesce(v.rest, 14) AS BIGINT) AS rest_away,
CAST(coalesce(h.n, 0) + coalesce(v.n, 0) < 4 AS INTEGER) AS early"""


@query("fea_4_history_columns", f"WITH {_history_sql()} SELECT {_COLUMNS} FROM contest LEFT JOIN h USING (game_id) LEFT JOIN v USING (game_id)")
def fea_4_history(t):
    """The columns of the build that don't come from ratings."""
    return rounded(builder(checkpointed(t["obs"]))(_targets(t)).select("game_id", *HISTORY))


def feature_store(spark, name: str, built) -> PartedTable:
    """An empty store for what a builder returns, in parts by season."""
    return PartedTable(spark, fresh(spark, name), StructType([*built.schema.fields, StructField("visible", LongType())]), "season")


@query("str_3_feature_store", f"""WITH {_history_sql()}, k AS (SELECT DISTINCT kickoff - INTERVAL '1' HOUR AS cutoff FROM contest), n AS (SELECT cutoff, (SELECT count(*) FROM obs WHERE avail <= cutoff) AS visible FROM k)
SELECT {_COLUMNS}, visible FROM contest JOIN n ON cutoff = kickoff - INTERVAL '1' HOUR LEFT JOIN h USING (game_id) LEFT JOIN v USING (game_id)""")
def str_3_store(t):
    """Facts of the last two seasons land late, in two batches; each lets the store build the rows again that could have seen them, and no others."""
    obs, targets = checkpointed(t["obs"]), checkpointed(_targets(t))
    newest = obs.agg(F.max("season")).first()[0]
    late = obs.where((F.col("season") >= newest - 1) & (F.col("game_id") % 4 == 1)).withColumn("lands", F.col("game_id") % 2 + F.col("season") % 2)
    facts = PartedTable(t.spark, fresh(t.spark, "facts"), obs.schema, "season")
    facts.append(0, obs.join(late.select("game_id").distinct(), "game_id", "left_anti"))
    store = feature_store(t.spark, "features", builder(obs)(targets))
    P.refresh(store, 0, targets, facts.read(), builder(facts.read()))

    def collect(batch, n):
        facts.append(n, batch.select(*obs.columns))

    def rebuild(batch, n):
        known = checkpointed(facts.read())
        P.refresh(store, n, targets, known, builder(known))

    stream = J.landed(t.spark, J.land_in_parts(late, "lands", "late"), late.schema, 1)
    J.each_once(stream, [(facts, collect), (store, rebuild)], fresh(t.spark, "state"), first=1)
    return rounded(store.read().select("game_id", *HISTORY, "visible"))


LEARN_FROM = 300


@query("str_1_whole_cycle", f"""WITH RECURSIVE s AS (SELECT season, count(*) AS n, row_number() OVER (ORDER BY season) AS i FROM contest GROUP BY 1),
r(i, held, due) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), false UNION ALL SELECT s.i, CASE WHEN r.due THEN 0 ELSE r.held END + s.n, CASE WHEN r.due THEN 0 ELSE r.held END + s.n >= {LEARN_FROM} FROM r JOIN s ON s.i = r.i + 1),
e AS (SELECT season, count(*) AS evaluated, avg(-(home_win * ln(q) + (1 - home_win) * ln(1 - q))) AS log_loss FROM (SELECT *, greatest(least(p_home, 0.9999), 0.0001) AS q FROM graded) GROUP BY 1),
m AS (SELECT s.season, regr_slope(g.margin, g.pred_margin) AS slope, regr_intercept(g.margin, g.pred_margin) AS intercept FROM s JOIN r ON r.i = s.i AND r.due JOIN graded g ON g.season <= s.season GROUP BY 1)
SELECT season, s.n AS results, evaluated, round(log_loss, 6) AS log_loss, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM s JOIN e USING (season) LEFT JOIN m USING (season)""")
def str_1_cycle(t):
    """Results land season by season: each batch is collected, the predictions of its contests are evaluated, and once enough results have come since
    the last time, the scoring member is fitted on all evaluations so far. One row for each season, from the three tables."""
    t.keep("contest")
    games = stored(t["contest"].select("game_id", "season", "kickoff", (F.col("home_score") - F.col("away_score")).alias("margin")), "games")
    asked = by_game(t["prediction"].select("pred_id", "game_id", "p_home", "pred_margin"))
    tables = update_cycle(J.landed(t.spark, J.land_in_parts(games, "season", "results"), games.schema, 1), asked, fresh(t.spark, "cycle"))
    results, evaluations, models = (x.read() for x in tables)
    graded = evaluations.groupBy("season").agg(F.count("*").alias("evaluated"), F.avg("logloss").alias("log_loss"))
    every = results.groupBy("season").agg(F.count("*").alias("results")).join(graded, "season")
    return rounded(every.join(models.select("season", "slope", "intercept"), "season", "left"))


def by_game(asked):
    """Predictions from files, dealt out and sorted by contest: of a join with a batch only the batch moves."""
    return checkpointed(asked.repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "game_id").sortWithinPartitions("game_id"))


def update_cycle(stream, asked, path: str, least: int = LEARN_FROM) -> tuple[PartedTable, PartedTable, PartedTable]:
    """The tables of results, evaluations and models under ``path`` after all that has landed in ``stream`` (game_id, season, kickoff, margin)."""
    spark = stream.sparkSession
    table = lambda name, schema: PartedTable(spark, f"{path}/{name}", spark.createDataFrame([], schema).schema, "season")
    results = PartedTable(spark, f"{path}/results", stream.schema, "season")
    evaluations = table("evaluations", "pred_id long, game_id long, season int, p_home double, pred_margin double, margin double, home_win int, logloss double")
    models = table("models", "season int, games long, slope double, intercept double, sigma double")

    def collect(batch, n):
        once = batch.dropDuplicates(["game_id"])
        results.append(n, once.join(results.read(results.parts_of(batch), n).select("game_id"), "game_id", "left_anti"))

    def evaluate(batch, n):
        new = results.read(results.parts_of(batch)).join(batch.select("game_id").distinct(), "game_id", "left_semi")
        graded = asked.join(new, "game_id").withColumn("home_win", (F.col("margin") > 0).cast("int"))
        known = evaluations.read(results.parts_of(batch), n).select("pred_id")
        evaluations.append(n, graded.withColumn("logloss", S.log_loss(F.col("p_home"), F.col("home_win"))).join(known, "pred_id", "left_anti"))

    def learn(batch, n):
        games, last = results.read().count(), models.read(version=n).agg(F.max("games")).first()[0] or 0
        if games - last >= least:
            season = max(results.parts_of(batch))
            models.append(n, M.scoring_member(evaluations.read()).select(F.lit(season).cast("int").alias("season"), F.lit(games).cast("long").alias("games"), "*"))

    J.each_once(stream, [(results, collect), (evaluations, evaluate), (models, learn)], f"{path}/state")
    return results, evaluations, models


_DIFFERS = " UNION ALL ".join(f"SELECT 'feature' AS kind, '{f}' AS feature FROM o JOIN n USING (game_id) WHERE abs(o.{f} - n.{f}) > 1e-6 * greatest(1, abs(o.{f}))" for f in HISTORY)


@query("fea_6_audit_findings", f"""WITH o AS (WITH {_history_sql("o.game_id % 50 <> 3")} SELECT {_COLUMNS} FROM contest LEFT JOIN h USING (game_id) LEFT JOIN v USING (game_id)),
n AS (WITH {_history_sql()} SELECT {_COLUMNS} FROM contest LEFT JOIN h USING (game_id) LEFT JOIN v USING (game_id)),
f AS ({_DIFFERS} UNION ALL SELECT 'hash', NULL FROM contest WHERE game_id % 31 = 0 UNION ALL SELECT 'timestamp', NULL FROM contest WHERE game_id % 37 = 0)
SELECT kind, feature, count(*) AS found FROM f GROUP BY 1, 2""")
def fea_6_findings(t):
    """A log whose features come from a table that lacked some contests, with some hashes and some times changed: the audit finds each."""
    obs, targets = checkpointed(t["obs"]), checkpointed(_targets(t))
    then = X.build(targets, obs.where("game_id % 50 <> 3"), _ratings_asof(obs))
    rows = then.join(targets.select("game_id", "kickoff", "home_id", "away_id", "neutral"), "game_id")
    late = F.col("game_id") % 37 == 0
    rows = rows.withColumns({"created": F.when(late, F.col("kickoff") + A.minutes(5)).otherwise(F.col("cutoff")), "is_blind": F.lit(True), "model_version": F.lit("v1.0"), "origin": F.lit("live")})
    rows = checkpointed(P.with_hashes(rows, HISTORY).withColumn("snapshot_sha256", F.when(F.col("game_id") % 31 == 0, F.sha2("snapshot_sha256", 256)).otherwise(F.col("snapshot_sha256"))))
    found = P.audit(rows, lambda x: X.build(checkpointed(x), obs, _ratings_asof(obs)), HISTORY)
    return found.groupBy("kind", "feature").agg(F.count("*").alias("found"))


@query("ml_25_prediction_log")
def ml_25_log(t):
    """The newest contests as a slate: predicted live at two times and as a back-test, each twice. Repeats of the same inputs add nothing."""
    t.keep("contest")
    obs = stored(t["obs"], "obs")
    every = checkpointed(_targets(t).drop("cutoff"))
    features = RATED + HISTORY
    start = every.selectExpr("percentile_approx(unix_seconds(cast(kickoff AS timestamp)), 0.8) AS s").first()["s"]
    now = F.timestamp_seconds(F.lit(start)).cast("timestamp_ntz")
    build = builder(obs)
    outcomes = X.with_targets(build(every.where(F.col("kickoff") < now).withColumn("cutoff", F.col("kickoff"))), t["contest"]).join(every.select("game_id", "kickoff"), "game_id")
    model = M.fit_ensemble(M.Config(tuple(features)), stored(outcomes.where("margin <> 0"), "outcomes"))
    slate = every.where(F.col("kickoff") >= now)
    log = None
    for at, backtest in ((now, False), (now, False), (now + A.minutes(60 * 24 * 30), False), (now, True), (now, True)):
        at = F.lit("2100-01-01").cast("timestamp_ntz") if backtest else at
        rows = P.predictions(slate, at, "v1.0", build, model.score, features, backtest)
        kept = ["game_id", "season", "kickoff", "home_id", "away_id", "neutral", "cutoff", "created", "is_blind", "model_version", "origin", *features, "p_home", "pred_margin", "pred_total", "input_sha256", "snapshot_sha256"]
        rows = rows.join(slate.select("game_id", "neutral"), "game_id").select(*kept)
        log = log or PartedTable(t.spark, fresh(t.spark, "log"), rows.schema, "season")
        P.append_predictions(log, max(log.versions(), default=-1) + 1, rows)
    return rounded(log.read().select("game_id", "origin", "is_blind", "cutoff", "p_home", "pred_margin", "input_sha256"), 4)
