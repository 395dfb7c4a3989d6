"""Known answers, exact small solvers, and invariance under what mustn't matter."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tallyfield.functions import scalars as S
from tallyfield.operators import availability as A
from tallyfield.operators import features as X
from tallyfield.operators import grading as G
from tallyfield.operators import learning as L
from tallyfield.operators import models as M
from tallyfield.operators import plays as P
from tallyfield.operators import ratings as R
from tallyfield.operators import tables as U
from tallyfield.plans.registry import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def test_normal_functions(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(-50, 51)], "x double").withColumn("p", S.normal_cdf(F.col("x")))
    for r in df.withColumn("back", S.normal_quantile(F.col("p"))).collect():
        assert abs(r["p"] - 0.5 * (1 + math.erf(r["x"] / math.sqrt(2)))) < 1e-7
        assert abs(r["x"]) > 4 or abs(r["back"] - r["x"]) < 1e-3


def test_clip_keeps_null(spark):
    row = spark.range(1).select(S.clip(F.lit(None).cast("double"), 0.1, 0.9).alias("a"), S.clip(F.lit(2.0), 0.1, 0.9).alias("b"), S.log_loss(F.lit(None).cast("double"), F.lit(1)).alias("c")).first()
    assert tuple(row) == (None, 0.9, None)


def test_metrics_and_adjusted_p(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.2, 0), (0.6, 0), (0.4, 1)], "p double, y int")
    got = rows.agg(*G.summary(F.col("p"), F.col("y"))).first()
    assert got["n"] == 4 and got["accuracy"] == 0.5 and abs(got["brier"] - (0.01 + 0.04 + 0.36 + 0.36) / 4) < 1e-12
    q = G.adjusted(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "subgroup string, p double"), "p")
    assert {r["subgroup"]: round(r["q"], 6) for r in q.collect()} == {"a": 0.04, "b": 0.053333, "c": 0.053333, "d": 0.5}


def test_calibrated_draws_have_slope_one(spark):
    rng = random.Random(4)
    draws = [(p := rng.uniform(0.05, 0.95), int(rng.random() < p)) for _ in range(20_000)]
    s = G.calibration_slope(spark.createDataFrame(draws, "p_home double, home_win int"))
    assert abs(s["slope"] - 1) < 3 * s["slope_se"] and abs(s["intercept"]) < 3 * s["intercept_se"] and s["slope_se"] < 0.05
    sharp = G.calibration_finding({"slope": 0.5, "slope_se": 0.1, "intercept": 0.0, "intercept_se": 0.1}, 0.01)
    assert sharp == {"flag": "over-confident", "needs_recalibration": True}


def test_confidence_stays_in_range(spark):
    df = spark.createDataFrame([(0.5, 0.0, 0, 0, 0), (0.99, 0.0, 0, 0, 0), (0.7, 0.3, 1, 1, 1)], "p double, sd double, s int, e int, q int")
    got = [r[0] for r in df.select(S.confidence(*(F.col(c) for c in ("p", "sd", "s", "e", "q")))).collect()]
    assert got[0] == 1 and 9 < got[1] <= 10 and got[2] == 1


def test_elo_by_hand():
    e = R.EloPool(36.0, 45.0, 0.25, R.ELO_START)
    h, a, gain = e.meet(2000, 1, 2, 7, False, ("FBS", "FBS"))
    want = 36 * math.log(8) * 2.2 / (45 * 0.001 + 2.2) * (1 - 1 / (1 + 10 ** (-45 / 400)))
    assert (h, a) == (1500, 1500) and abs(gain - want) < 1e-12
    assert e.meet(2000, 1, 3, 0, True, ("FBS", "FCS"))[2] == 0
    before = 1500 + want
    assert abs(e.meet(2002, 1, 3, 3, True, ("FBS", "FCS"))[0] - (1500 + 0.75 * (before - 1500))) < 1e-9 and e.sides[3][0] < 1200
    e.meet(2003, 8, 9, 1, True, ("FBS", "FBS"))
    e.meet(2004, 8, 9, 1, True, ("FBS", "FBS"))
    now = 1500 + 0.75 ** 3 * (before - 1500)
    assert abs(e.before(2, "FBS") - (1500 - 0.75 ** 3 * want)) < 1e-9 and abs(e.before(1, "FBS") - now) < abs(want)


def test_elo_equals_a_plain_chronological_pass(spark, t):
    """All sides regress when a season begins, ratings in a dict: over the whole table."""
    from tallyfield.plans.ratings import POINT, _grid, _pooled

    k, home, revert = POINT
    rows = sorted(_pooled(t).collect(), key=lambda r: (r["pool"], r["avail"], r["kickoff"], r["game_id"]))
    want, pool = {}, None
    for r in rows:
        if r["pool"] != pool:
            pool, rating, known, season = r["pool"], {}, {}, None
        if season is not None and r["season"] > season:
            rating = {x: R.ELO_START[known[x]] + (1 - revert) * (v - R.ELO_START[known[x]]) for x, v in rating.items()}
        season = r["season"] if season is None else max(season, r["season"])
        for s in ("home", "away"):
            known[r[f"{s}_id"]] = r[f"{s}_division"]
            rating.setdefault(r[f"{s}_id"], R.ELO_START[r[f"{s}_division"]])
        h, a = rating[r["home_id"]], rating[r["away_id"]]
        gain = R.elo_shift(h - a + (0 if r["neutral"] == 1 else home), r["home_score"] - r["away_score"], k)
        rating[r["home_id"]], rating[r["away_id"]] = h + gain, a - gain
        want[r["game_id"]] = (h, a, gain)
    got = {r["game_id"]: (r["elo_home"], r["elo_away"], r["gain"]) for r in R.elo(_pooled(t), _grid(t, [POINT])).collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-6 for g in got for x, y in zip(got[g], want[g]))


def test_pools_are_connected_groups(spark):
    pairs = [(1, 2), (2, 3), (7, 8), (9, 8), (20, 21), (3, 30), (30, 31), (31, 32)]
    got = {(r["home_id"], r["away_id"]): r["pool"] for r in R.pools(spark.createDataFrame(pairs, "home_id long, away_id long")).collect()}
    assert got == {p: {1: "1", 2: "1", 3: "1", 30: "1", 31: "1", 7: "7", 9: "7", 20: "20"}[p[0]] for p in pairs}


def test_stream_ratings_equal_batch(spark, t):
    from tallyfield.plans.registry import QUERIES
    import tallyfield.plans.catalog  # noqa: F401

    batch = {(r["pool"], r["game_id"]): (r["elo_home"], r["gain"]) for r in QUERIES["rat_1_elo"](spark, SF).collect()}
    stream = {(r["pool"], r["game_id"]): (r["elo_home"], r["gain"]) for r in QUERIES["str_5_rating_state"](spark, SF).collect()}
    assert batch.keys() == stream.keys() and all(abs(batch[k][0] - stream[k][0]) < 1e-5 for k in batch)


def dense_ridge(rows, lam, prior=None):
    """A least-squares problem spelled out, with a row for each penalty."""
    prior = prior or {}
    teams = sorted({r["off_id"] for r in rows} | {r["def_id"] for r in rows} | set(prior))
    at, n = {x: i for i, x in enumerate(teams)}, len(teams)
    m, v = [], []
    for r in rows:
        x = np.zeros(2 + 2 * n)
        x[[0, 2 + at[r["off_id"]], 2 + n + at[r["def_id"]]]] = 1
        x[1] = r["loc"]
        m.append(x)
        v.append(float(r["y"]))
    weights = [1e-3, 1e-3 + (50 if len(rows) < 50 else 0), *[lam] * (2 * n)]
    centre = [0, 0, *(prior.get(x, (0, 0))[0] for x in teams), *(prior.get(x, (0, 0))[1] for x in teams)]
    for i, (w, c) in enumerate(zip(weights, centre)):
        m.append(np.sqrt(w) * np.eye(2 + 2 * n)[i])
        v.append(np.sqrt(w) * c)
    z = np.linalg.lstsq(np.array(m), np.array(v), rcond=None)[0]
    return {x: (z[0], z[1], z[2 + i], z[2 + n + i]) for x, i in at.items()}


def close(got, want, by=1e-6):
    return got.keys() == want.keys() and all(abs(a - b) < by for k in got for a, b in zip(got[k], want[k]))


def answers(df):
    return {r["team"]: (r["mu"], r["h"], r["o"], r["d"]) for r in df.collect()}


def test_ridge_equals_a_dense_solver(spark, t):
    obs = t["obs"].where("season = 1996")
    assert close(answers(R.ridge_per_group(obs, ["season"], 8.0)), dense_ridge(obs.collect(), 8.0))
    few = obs.where("off_id < 6 AND def_id < 6")
    prior = {1: (3.0, -2.0), 777: (1.0, 4.0)}
    priors = spark.createDataFrame([(1996, k, *v) for k, v in prior.items()], "season int, team long, prior_o double, prior_d double")
    assert close(answers(R.ridge_per_group(few, ["season"], 8.0, priors)), dense_ridge(few.collect(), 8.0, prior))
    swept = answers(R.ridge_by_sweeps(few, ["season"], 8.0, sweeps=12))
    assert all(abs(swept[k][j] - x) < 0.02 for k, v in dense_ridge(few.collect(), 8.0).items() for j, x in enumerate(v) if j > 1)


def test_weekly_ratings_equal_a_dense_solver(spark, t):
    obs = t["obs"].where("season = 1996").withColumn("week", F.floor((F.dayofyear("kickoff") - 1) / 7).cast("int"))
    got, rows = R.ridge_before(obs, ["season"], "week", 8.0).collect(), obs.collect()
    weeks = sorted({r["week"] for r in rows})
    assert {r["week"] for r in got} == set(weeks[1:])
    for w in (weeks[1], weeks[len(weeks) // 2], weeks[-1]):
        assert close({r["team"]: (r["mu"], r["h"], r["o"], r["d"]) for r in got if r["week"] == w}, dense_ridge([r for r in rows if r["week"] < w], 8.0))


def test_tables_kept_by_a_stream_restart(spark):
    from pyspark.sql.types import StructType
    from tallyfield.sources.parted import PartedTable
    from tallyfield.sources.shared import fresh
    from tallyfield.streaming import jobs as J

    for keep in (lambda *a: J.keep_latest(a[0], ["k"], ["at"], (), *a[1:]), lambda *a: J.keep_corrections(a[0], ["k"], ("v", "at"), ["at"], *a[1:])):
        landing, path, state = (fresh(spark, n) for n in ("landing", "kept", "state"))
        seen = []
        for batch in ([(1, 10, 1), (2, 20, 1)], [], [(1, 15, 5)], [(1, 11, 3), (3, 30, 1)], [], [(2, 25, 9), (2, 24, 8)]):
            spark.createDataFrame(batch, "k long, v long, at long").coalesce(1).write.mode("append").parquet(landing)
            stream = J.landed(spark, landing, "k long, v long, at long", 1)
            seen.append(sorted(map(tuple, keep(stream, path, state).select("k", "v", "at").collect())))
        assert seen[0] == seen[1] == [(1, 10, 1), (2, 20, 1)] and seen[2] == [(1, 15, 5), (2, 20, 1)]
        assert seen[3] == seen[4] == [(1, 15, 5), (2, 20, 1), (3, 30, 1)] and seen[5] == [(1, 15, 5), (2, 25, 9), (3, 30, 1)]
        assert len(PartedTable(spark, path, StructType([]), "").versions()) <= 2


def test_score_values_by_size(spark):
    from tallyfield.operators import plays as P

    rows = [(1, i, h, 0, kind) for i, (h, kind) in enumerate([(6, "Pass"), (7, "Extra Point"), (12, "Run"), (16, "Kick"), (19, None), (21, "Two Point"), (23, "Safety"), (24, "x"), (25, "Conversion")])]
    got = P.scores(spark.createDataFrame(rows, "event_key int, seq int, hs int, as int, type string")).orderBy("seq").select("score_value").collect()
    assert [r[0] for r in got] == [7, 0, 3, 3, 3, 0, 2, 1, 0]


def test_names_equal_the_compatibility_decomposition(spark):
    import re
    import unicodedata

    names = ["Šibenik", "Łódź", "São Paulo & (B)", "ﬁne  ﬂow", "Ǆ½™", "日本 x", "A-B_c", "", "ＦＵＬＬ", "İzmir", "ÀÉ ß ø"]
    want = [re.sub("[^a-z0-9&()]+", " ", unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().lower()).strip() for n in names]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(S.normal_name(F.col("n"))).collect()] == want


def test_hashes_tell_null_from_the_word(spark):
    rows = spark.createDataFrame([(None, "x"), ("null", "x"), ("a;b=c", None), ("a", "c")], "a string, b string")
    assert rows.select(U.content_hash({"a": "string", "b": "string"}).alias("h")).distinct().count() == 4


def test_features_ignore_later_facts(spark, t):
    targets = t["contest"].where("season = 1997 AND game_id % 5 = 0").select("game_id", "season", "kickoff", (F.col("kickoff") - A.minutes(60)).alias("cutoff"), "home_id", "away_id", "neutral")
    last = targets.agg(F.max("cutoff")).first()[0]
    state = R.ridge_per_group(t["obs"].where("season = 1996"), ["season"], 8.0).withColumn("season", F.lit(1997)).withColumn("as_of", F.lit(datetime(1997, 1, 1)).cast("timestamp_ntz"))
    whole, cut = X.build(targets, t["obs"], state), X.build(targets, t["obs"].where(F.col("avail") <= F.lit(last)), state)
    assert whole.count() == targets.count() and whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0
    with pytest.raises(ValueError):
        X.build(targets.withColumn("cutoff", F.col("kickoff") + A.minutes(1)), t["obs"], state)


def test_point_in_time_features_equal_a_plain_search(spark, t):
    obs = t["obs"].where("season = 1997").select("season", "avail", "kickoff", "off_id", "margin", "y").toPandas().astype({"margin": float, "y": float})
    targets = t["contest"].where("season = 1997").select("game_id", "season", "kickoff", (F.col("kickoff") - A.minutes(60)).alias("cutoff"), "home_id", "away_id", "neutral").toPandas()
    teams = sorted({*obs["off_id"]})[::2]  # the others are without ratings
    state = pd.DataFrame([(datetime(1997, m, 1), 1997, x, 20.0 + m, 2.0, x % 7 + m / 2, x % 5 - 1.0) for x in teams for m in (1, 5)], columns=["as_of", "season", "team", "mu", "h", "o", "d"])
    frame = lambda pdf, kinds: spark.createDataFrame(pdf, kinds)
    got = X.build(
        frame(targets, "game_id long, season int, kickoff timestamp_ntz, cutoff timestamp_ntz, home_id long, away_id long, neutral int"), frame(obs, "season int, avail timestamp_ntz, kickoff timestamp_ntz, off_id long, margin double, y double"),
        frame(state, "as_of timestamp_ntz, season int, team long, mu double, h double, o double, d double"),
    ).collect()
    seen, rated = ({k: v for k, v in df.groupby(by)} for df, by in ((obs, "off_id"), (state, "team")))

    def side(team, cutoff, kickoff):
        mine = seen[team][seen[team]["avail"] <= cutoff].sort_values(["kickoff", "margin"], ascending=False)
        last = (kickoff - mine["kickoff"].max()).total_seconds() // 86400 if len(mine) else 14
        known = rated[team][rated[team]["as_of"] <= cutoff].sort_values("as_of") if team in rated else []
        return len(mine), mine["margin"].head(3).mean() if len(mine) else 0.0, min(last, 21), known.iloc[-1].to_dict() if len(known) else dict.fromkeys(("mu", "h", "o", "d"), 0.0)

    assert len(got) == len(targets) == len({r["game_id"] for r in got})
    by_id = {r["game_id"]: r for r in got}
    for c in targets.itertuples():
        (hn, hf, hr, h), (an, af, ar, a) = (side(x, c.cutoff, c.kickoff) for x in (c.home_id, c.away_id))
        place = 0.0 if c.neutral == 1 else h["h"]
        points = h["mu"] + h["o"] + a["d"] + place, h["mu"] + a["o"] + h["d"] - place
        want = {"n_home": hn, "n_away": an, "form3_home": hf, "form3_away": af, "form_diff": hf - af, "rest_home": hr, "rest_away": ar, "early": int(hn + an < 4), "pp_home": points[0], "pp_away": points[1]}
        assert {k: by_id[c.game_id][k] for k in want} == pytest.approx(want, abs=1e-9)


def test_leaks_are_refused(spark):
    noon = datetime(2020, 1, 1, 12)
    used = spark.createDataFrame([(noon, noon + timedelta(hours=1)), (noon + timedelta(hours=2), noon + timedelta(hours=1))], "avail timestamp_ntz, cutoff timestamp_ntz")
    with pytest.raises(ValueError, match="1 facts"):
        A.assert_no_leaks(used)
    assert A.assert_no_leaks(used.limit(1)).count() == 1


def test_availability_and_cutoff_at_the_change_of_clocks(spark):
    k = datetime(2021, 3, 14, 18)
    rows = [(1, k, k + timedelta(hours=2)), (2, k, k - timedelta(hours=1)), (3, k, None), (4, k, k + timedelta(days=9))]
    got = {r["id"]: r["avail"] for r in A.with_availability(spark.createDataFrame(rows, "id int, kickoff timestamp_ntz, collected timestamp_ntz")).collect()}
    assert got == {1: k + timedelta(hours=2), 2: k + timedelta(minutes=270), 3: k + timedelta(minutes=270), 4: k + timedelta(minutes=270)}
    days = spark.createDataFrame([(k,), (datetime(2021, 3, 13, 18),), (datetime(2021, 3, 14, 5),)], "kickoff timestamp_ntz")
    assert [r[0] for r in days.select(A.training_cutoff(F.col("kickoff"))).collect()] == [datetime(2021, 3, 14, 9), datetime(2021, 3, 13, 10), datetime(2021, 3, 14, 5)]


def test_missing_score_reads_as_the_last_known(spark):
    plays = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 7, 0), (1, 3, None, 0), (1, 4, 10, 0), (1, 5, 10, 2)], "event_key int, seq int, hs int, as int")
    assert [r["score_value"] for r in P.scores(plays).orderBy("seq").collect()] == [0, 7, 0, 3, -2]


def test_hash_ignores_order_and_rounding(spark):
    a, b = spark.createDataFrame([(1, 0.1 + 0.2, None)], "a int, b double, c double"), spark.createDataFrame([(0.3, float("nan"), 1)], "b double, c double, a int")
    kinds = {"a": "int", "b": "double", "c": "double"}
    assert a.select(U.content_hash(kinds)).first() == b.select(U.content_hash(kinds)).first()
    with pytest.raises(ValueError):
        U.refuse_columns(a, ("b",))


def test_logistic_and_ridge_reach_their_closed_objectives(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    y = (rng.random(600) < 1 / (1 + np.exp(-x @ [1.0, -0.5]))).astype(int)
    m = 3 * x[:, 0] - x[:, 1] + rng.normal(size=600)
    rows = spark.createDataFrame([(float(a), float(b), int(c), float(d)) for (a, b), c, d in zip(x, y, m)], "a double, b double, home_win int, margin double")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    beta = np.array(M.margin_ridge(rows, ("a", "b"), alpha=10.0).model.stages[-1].coefficients)
    assert np.allclose(beta, np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (m - m.mean())), atol=1e-6)
    fit = M.logistic(rows, ("a", "b"), C=0.1).model.stages[-1]
    w, c = np.array(fit.coefficients), fit.intercept
    p = 1 / (1 + np.exp(-(z @ w + c)))
    assert np.allclose(0.1 * z.T @ (y - p), w, atol=1e-4) and abs((y - p).sum()) < 1e-3


def test_members_heed_weights(spark):
    """A row of weight 3 counts as three rows: linear members, their spread, and the root split of trees."""
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=400), rng.integers(1, 4, 400)
    m = 2 * x + rng.normal(size=400) * 3
    once = [(float(a), int(b > 0), float(b), float(c)) for a, b, c in zip(x, m, w)]
    kinds = "elo_diff double, home_win int, margin double, weight double"
    weighted, spelled = spark.createDataFrame(once, kinds), spark.createDataFrame([r[:3] + (1.0,) for r in once for _ in range(int(r[3]))], kinds)
    elo = M.elo_member(weighted)
    slope = np.array(elo.margin.stages[-1].coefficients)[0]
    mean, centre = np.average(x, weights=w), np.average(m, weights=w)
    assert abs(slope - np.sum(w * (x - mean) * (m - centre)) / (np.sum(w * (x - mean) ** 2) + 1e-6)) < 1e-6
    again = M.elo_member(spelled)
    assert np.allclose(elo.model.stages[-1].coefficients, again.model.stages[-1].coefficients, atol=1e-4) and elo.has_margin
    ridge, z = M.margin_ridge(weighted, ("elo_diff",)), (x - x.mean()) / x.std(ddof=1)
    c = z - np.average(z, weights=w)
    assert abs(ridge.model.stages[-1].coefficients[0] - np.sum(w * c * (m - centre)) / (np.sum(w * c * c) + 10)) < 1e-6
    p = ridge.model.stages[-1].coefficients[0] * c + centre
    assert abs(ridge.sigma - np.sqrt(np.average((m - p) ** 2, weights=w))) < 1e-6
    few = M.margin_trees(weighted.withColumn("weight", F.when(F.col("elo_diff") > 0, 1e-9).otherwise(F.col("weight"))), ("elo_diff",), rounds=2, leaf=1)
    assert not few.chance and "p_gbm_margin" not in few.score(weighted).columns
    low, plain = (M.margin_trees(r, ("elo_diff",), rounds=2, leaf=1).score(weighted).agg(F.avg("m_gbm_margin")).first()[0] for r in (weighted.withColumn("weight", F.when(F.col("elo_diff") > 0, 1e-9).otherwise(1.0)), weighted.drop("weight")))
    assert low < plain - 0.5


def test_saved_ensemble_scores_as_before(spark, t):
    from tallyfield.plans.models import FEATURES, table
    from tallyfield.sources.shared import checkpointed, fresh

    rows, path = checkpointed(table(t)), fresh(spark, "models")
    assert M.champion(path) is None
    for at, calibration in enumerate(("isotonic", "platt")):
        config = M.Config(FEATURES, members={"logistic": {}, "elo": {}}, ensemble="stack", stack_context=("neutral",), calibration=calibration)
        model = M.fit_ensemble(config, rows)
        assert M.register(model, path, "refit", calibration) == f"v1.{at}"
        row = M.champion(path)
        assert (row["version"], row["reason"], row["parent"]) == (f"v1.{at}", calibration, None if at == 0 else "v1.0")
        columns = ["game_id", "p_raw", "p_home", "pred_margin", "pred_total", "p_sd", "split"]
        was, now = (m.score(rows).select(columns).orderBy("game_id").collect() for m in (model, M.load(path, row["version"])))
        assert len(was) == len(now) > 0 and all(abs(a - b) < 1e-9 for x, y in zip(was, now) for a, b in zip(x, y))


def test_permutation_keeps_each_value_once(spark):
    class Same:
        def score(self, rows):
            return rows.withColumn("p_home", S.expit(F.col("a")))

    rng = np.random.default_rng(6)
    x = rng.normal(size=12_000)
    rows = spark.createDataFrame([(i, float(v), 1.0, int(rng.random() < 1 / (1 + math.exp(-v)))) for i, v in enumerate(x)], "game_id long, a double, b double, home_win int")
    got = {r["feature"]: r for r in M.permutation_importance(Same(), rows, ["a", "b"], 2).collect()}
    assert got["a"]["delta"] > 0.05 and not got["a"]["useless"] and abs(got["b"]["delta"]) < 1e-12 and got["b"]["useless"]


def test_candidates_of_findings(spark):
    config = M.Config(("a", "b", "c"), members={"logistic": {"C": 0.1}, "margin_ridge": {}, "gbm": {}, "elo": {}})
    flags = [("subgroup", "conference", True), ("residual", "a", True), ("residual", "d", True), ("useless", "b", True), ("useless", "c", True), ("dead", "elo", True), ("drift", "newest", False)]
    got = L.candidates(config, spark.createDataFrame(flags, "kind string, subject string, flagged boolean"), 3, M.Policy(), ["a", "b", "c", "d", "conf_game"], {"conference": "conf_game"})
    assert list(got) == ["calibration_platt", "stack_subgroup_context", "stack_residual_features", "add_residual_features", "more_capacity", "drop_useless_features", "drop_dead_members", "local_logistic_C_up"]
    assert got["stack_subgroup_context"].stack_context == ("conf_game",) and got["stack_residual_features"].stack_context == ("a", "d") and got["add_residual_features"].features == ("a", "b", "c", "d")
    assert got["drop_useless_features"].features == ("a",) and set(got["drop_dead_members"].members) == {"logistic", "margin_ridge", "gbm"} and got["more_capacity"].members["gbm"]["leaf"] == 30
    assert got["local_logistic_C_up"].members["logistic"] == {"C": 0.3} and L.moved(config, 2)[1].members["gbm"] == {"step": 0.02, "rounds": 500}
    quiet = L.candidates(config, spark.createDataFrame([("drift", "newest", True), ("useless", "b", True)], "kind string, subject string, flagged boolean"), 6, M.Policy(), ["a"], {})
    assert list(quiet) == ["calibration_platt", "recency_weighting", "local_half_life_days_730"] and quiet["recency_weighting"].half_life_days == 365


def test_gates_of_a_challenger(spark):
    rng, day = random.Random(8), datetime(2021, 1, 4)
    rows = [(day + timedelta(days=7 * (i % 40)), int(rng.random() < (p := rng.uniform(0.05, 0.95))), 0.4, p) for i in range(1200)]
    pairs = spark.createDataFrame(rows, "kickoff timestamp_ntz, home_win int, p_old double, p_new double")
    good, bad = L.confirm(pairs, M.Policy(), 200), L.confirm(pairs.select("kickoff", "home_win", F.col("p_new").alias("p_old"), F.col("p_old").alias("p_new")), M.Policy(), 200)
    assert all(good["gates"].values()) and good["n"] == 1200 and good["low"] < good["mean_gain"] < good["high"]
    assert abs(good["mean_gain"] + bad["mean_gain"]) < 1e-9 and not any(bad["gates"][g] for g in ("effect_size", "significance", "brier_not_worse"))
    assert not L.confirm(pairs.limit(200), M.Policy(), 200)["gates"]["min_sample"]


def test_members_of_a_mixture_by_hand(spark):
    """Contributions add up to the logit; Platt has the intercept and slope of the calibration fit; proposals keep rule order."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 2))
    rows = spark.createDataFrame([(i, float(a), float(b), int(a - b + rng.normal() > 0)) for i, (a, b) in enumerate(x)], "game_id long, a double, b double, home_win int")
    fit = M.logistic(rows, ("a", "b"))
    parts = M.contributions(fit, rows, "game_id").groupBy("game_id").agg(F.sum("contribution").alias("sum"))
    both = fit.score(rows).join(parts, "game_id").select((S.logit(F.col("p_logistic"), 1e-12) - F.col("sum")).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert abs(both[0] - fit.model.stages[-1].intercept) < 1e-6 and abs(both[1] - both[0]) < 1e-6
    raw = fit.score(rows).withColumnRenamed("p_logistic", "p_raw")
    platt, slope = M.calibrate(raw, "platt"), G.calibration_slope(raw, "p_raw")
    assert abs(platt.a - slope["intercept"]) < 1e-3 and abs(platt.b - slope["slope"]) < 1e-3
    steps = [r[0] for r in M.calibrate(raw, "isotonic")(raw).orderBy("p_raw").select("p_home").collect()]
    assert steps == sorted(steps) and 0.005 <= steps[0] and steps[-1] <= 0.995


def test_weights_find_the_better_member(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.05, 0.95, 3000)
    y = (rng.random(3000) < p).astype(int)
    rows = spark.createDataFrame([(float(a), 0.5, int(b), float(a * 10), float(b * 9 + a)) for a, b in zip(p, y)], "good double, flat double, home_win int, m1 double, m2 double").withColumn("margin", F.col("m2") + 0.1)
    w = M.mixture_weights(rows, ["good", "flat"], rounds=60)
    assert w["good"] > 0.9 and abs(sum(w.values()) - 1) < 1e-9
    v = M.margin_weights(rows, ["m1", "m2"])
    assert v["m2"] > 0.9 and abs(sum(v.values()) - 1) < 1e-6


def test_walk_forward_and_decision(spark, t):
    from tallyfield.plans.models import FEATURES, table
    from tallyfield.sources.shared import checkpointed

    rows = checkpointed(table(t))
    out = M.walk_forward(M.Config(FEATURES, calibration="isotonic"), rows, M.Policy(n_folds=2, eval_window=200))
    assert out.count() == 200 and out.where("p_home BETWEEN 0.005 AND 0.995").count() == 200
    assert [L.decide(g, n, M.Policy()) for g, n in (({"a": True}, 0), ({"a": False}, 200), ({}, 3))] == ["structural", "refit", "no change"]


def test_member_types_and_an_added_one(spark, t, monkeypatch):
    from tallyfield.plans.models import udf_4

    monkeypatch.setattr(M, "MEMBERS", {k: M.MEMBERS[k] for k in ("elo", "margin_ridge")} | {"form": lambda rows, features, name: M.logistic(rows, ("form3",), name)})
    got = {r["member"]: r for r in udf_4(t).collect()}
    assert set(got) == {"elo", "margin_ridge", "form"} and len({r["n"] for r in got.values()}) == 1 and got["elo"]["n"] > 0
    assert got["margin_ridge"]["has_margin"] and not got["form"]["has_margin"] and all(0 < r["log_loss"] < 1 for r in got.values())
