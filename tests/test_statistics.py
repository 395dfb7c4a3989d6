from datetime import datetime as D

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.operators import availability as A
from tallyfield.operators import folds as V
from tallyfield.operators import ratings as R


@pytest.mark.parametrize("blocks", [16, 52, 300])
def test_drawn_means_spread_as_independent_draws_do(spark, blocks):
    rng = np.random.default_rng(blocks)
    size, mean = rng.integers(1, 30, blocks), rng.normal(0.01, 0.3, blocks)
    rows = [(f"w{i:03}", float(m)) for i, (n, m) in enumerate(zip(size, mean)) for _ in range(n)]
    drawn = rng.integers(0, blocks, (40_000, blocks))
    boots = (mean * size)[drawn].sum(1) / size[drawn].sum(1)
    got = V.block_bootstrap(spark.createDataFrame(rows, "week string, gain double"), 4000).first()
    width = np.quantile(boots, 0.95) - np.quantile(boots, 0.05)
    assert got.high - got.low == pytest.approx(width, rel=0.05)
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(boots, [0.05, 0.95])), abs=0.05 * width)
    assert got.p_value == pytest.approx((boots <= 0).mean(), abs=0.03) and got.reps == 4000


def test_draws_are_even_and_unrelated(spark):
    n = spark.range(200).crossJoin(spark.range(50).withColumnRenamed("id", "i")).select((V.hashed_integer(F.lit(42), "id", "i") % 16).alias("x"), "id", "i").orderBy("id", "i").toPandas()["x"].to_numpy()
    assert ((np.bincount(n, minlength=16) - 625) ** 2 / 625).sum() < 40  # chi square, 15 degrees of freedom
    pairs = np.bincount(n[:-1] * 16 + n[1:], minlength=256)
    assert ((pairs - 10_000 / 256) ** 2 / (10_000 / 256)).sum() < 340  # 255 degrees


def test_facts_of_one_instant_come_in_the_order_asked_for(spark):
    facts = spark.createDataFrame([(7, D(2020, 1, 1), 1, 1600.0), (7, D(2020, 1, 1), 2, 1500.0), (7, D(2020, 1, 3), 3, 1.0)], "team long, avail timestamp_ntz, game_id long, rating double")
    targets = spark.createDataFrame([(9, 7, D(2020, 1, 2)), (8, 7, D(2019, 1, 1))], "game_id long, team long, cutoff timestamp_ntz")
    out = A.running_asof(targets, facts, ["team"], {"rating": lambda w: F.last("_rating", ignorenulls=True).over(w)}, order=["game_id"])
    assert {r.game_id: r.rating for r in out.collect()} == {9: 1500.0, 8: None}


def test_a_season_begins_with_a_side_s_first_contest_home_or_away(spark):
    day = lambda d: D(2020, 9, d)
    rows = [("p", 1.0, 2.0, 0.5, 1, 2020, day(1), day(1), 5, 6, 1500.0, 1400.0, 10.0), ("p", 1.0, 2.0, 0.5, 2, 2020, day(2), day(1), 6, 5, 1390.0, 1510.0, 3.0), ("p", 1.0, 2.0, 0.5, 3, 2020, day(2), day(2), 7, 8, 1.0, 2.0, 3.0), ("p", 1.0, 2.0, 0.5, 4, 2020, day(2), day(2), 8, 7, 9.0, 8.0, 3.0)]
    got = R.season_starts(spark.createDataFrame(rows, R.ELO_SCHEMA)).collect()
    assert {r.team: r.first_rating for r in got} == {5: 1500.0, 6: 1400.0, 7: 1.0, 8: 2.0}


def test_rat_2_and_rat_4_equal_plain_searches(spark):
    from tallyfield.plans.ratings import POINT, _grid, _pooled, rat_2, rat_4
    from tallyfield.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    rated = R.elo(_pooled(t), _grid(t, [POINT])).collect()
    first, after = {}, {}
    for r in sorted(rated, key=lambda r: (r.avail, r.kickoff, r.game_id)):
        for side, elo, sign in ((r.home_id, r.elo_home, 1), (r.away_id, r.elo_away, -1)):
            first.setdefault((r.season, side), elo)
            after.setdefault(side, []).append((r.avail, elo + sign * r.gain))
    assert {(r.season, r.team): r.first_rating for r in rat_2(t).where("revert = 0.25").collect()} == {k: pytest.approx(v, abs=1e-3) for k, v in first.items()}
    want = {c.game_id: ([x for a, x in after[c.home_id] if a <= c.kickoff] or [None])[-1] for c in t["contest"].select("game_id", "home_id", "kickoff").collect()}
    assert {r.game_id: r.rating for r in rat_4(t).collect()} == {k: v if v is None else pytest.approx(v, abs=1e-5) for k, v in want.items()}


def test_the_greatest_so_far_in_any_order_of_arrival(spark):
    from pyspark.sql import Window as W

    rng = np.random.default_rng(5)
    rows = [(int(k), i, None if rng.random() < 0.2 else int(rng.integers(0, 12))) for k in range(4) for i in range(40)]
    df = A.running_greatest(spark.createDataFrame(rows, "key int, at int, v int"), F.when(F.col("v").isNotNull(), F.struct("v", "at")), W.partitionBy("key").orderBy("at"), "top", 3)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    for r in df.collect():
        want = sorted(((v, i) for k, i, v in rows if k == r.key and i <= r.at and v is not None), reverse=True)[:3]
        assert [tuple(x) for x in (r.top_1, r.top_2, r.top_3) if x] == want


def test_pools_of_a_long_chain(spark):
    rng = np.random.default_rng(2)
    names = rng.permutation(300)
    pairs = [(int(names[i]), int(names[i + 1])) for i in range(150)] + [(int(names[i + 1]), int(names[i])) for i in range(151, 298)] + [(1000, 1001)]
    got = R.pools(spark.createDataFrame(pairs, "home_id long, away_id long"))
    want = {p: str(min(names[:151]) if k < 150 else min(names[151:299]) if k < 297 else 1000) for k, p in enumerate(pairs)}
    assert {(r.home_id, r.away_id): r.pool for r in got.collect()} == want


def test_repeated_reads_are_of_a_table_made_once(spark, monkeypatch):
    """The Newton steps of agg_10 and agg_30, and the stacker of ml_11, don't run the views again."""
    from tallyfield.plans import grading, models
    from tallyfield.plans.registry import Tables

    made, keep = [], Tables.__getitem__
    monkeypatch.setattr(Tables, "__getitem__", lambda self, name: made.append(name) or keep(self, name))
    fits, slope = [], grading.G.calibration_slope
    monkeypatch.setattr(grading.G, "calibration_slope", lambda rows: fits.append("parquet" in (plan := rows._jdf.queryExecution().toString()) or "Window" in plan) or slope(rows))
    grading._slopes(Tables(spark, "/root/testdata/sf0.001")).collect()
    assert made.count("graded") == 1 and fits == [False, False]
    stack = []
    monkeypatch.setattr(models.M, "logistic", lambda rows, *a, **k: stack.append("Window" in rows._jdf.queryExecution().toString()) or 1 / 0)
    try:
        models.ml_11(Tables(spark, "/root/testdata/sf0.001"))
    except ZeroDivisionError:
        pass
    assert stack == [False]


def test_rating_state_takes_few_contests_at_a_time(spark, monkeypatch):
    """Three to a frame, over the years that land one after the other: as the batch form, in one order."""
    from tallyfield.plans.catalog import QUERIES
    from tallyfield.streaming import jobs as J

    monkeypatch.setattr(J, "ELO_ROWS", 3)
    got = {r.game_id: (r.elo_home, r.elo_away, r.gain) for r in QUERIES["str_5_rating_state"](spark, "/root/testdata/sf0.001").collect()}
    want = {r.game_id: (r.elo_home, r.elo_away, r.gain) for r in QUERIES["rat_1_elo"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
