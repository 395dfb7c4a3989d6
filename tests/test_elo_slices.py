from tallyfield.operators import ratings as R
from tallyfield.plans.ratings import POINT, _grid, _pooled
from tallyfield.plans.registry import Tables
from tallyfield.sources.shared import checkpointed


def test_slices_of_time_give_the_same_ratings(spark):
    """Each slice goes on from what the one before left, for each pool and point."""
    t = Tables(spark, "/root/testdata/sf0.001")
    contests, grid = checkpointed(_pooled(t)), _grid(t, [POINT, (36.0, 45.0, 0.0)])
    contests = contests.unionByName(contests.selectExpr("* except (pool)", "pool || 'x' as pool"))
    whole = sorted(map(tuple, R.elo(contests, grid).collect()))
    assert whole == sorted(map(tuple, R.elo(contests, grid, most=1200).collect())) and len(whole) == 2 * contests.count()


def test_stream_rates_in_arrays_as_one_after_the_other(spark, monkeypatch, tmp_path):
    """Batches go on from the state that the one before left, and give what the batch form gives; contests aren't rated by a call each."""
    from tallyfield.streaming import jobs as J

    monkeypatch.setattr(J, "ELO_ROWS", 300)
    rows = spark.range(900).selectExpr("concat('p', id % 2) AS pool", "id AS game_id", "cast(1995 + floor(id / 300) AS int) AS season", "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(cast(id AS int)) AS kickoff",
                                       "timestamp_ntz'1995-01-01 04:00:00' + make_dt_interval(cast(id AS int)) AS avail", "(id * 7) % 40 * 2 + id % 2 AS home_id", "((id * 7) % 40 + 1 + id % 11) % 40 * 2 + id % 2 AS away_id",
                                       "cast(id % 9 - 4 AS double) AS m", "cast(id % 10 = 0 AS int) AS neutral", "'FBS' AS home_division", "'FCS' AS away_division")
    for i in range(3):
        rows.where(f"season = {1995 + i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = J.run(J.elo_stream(J.landed(spark, f"{tmp_path}/in", rows.schema, 1), 36.0, 45.0, 0.25), f"{tmp_path}/out", f"{tmp_path}/state")
    want = R.elo(rows.withColumn("home_score", rows["m"]).selectExpr("*", "0 AS away_score"), _grid(Tables(spark, ""), [POINT]))
    pick = lambda df: sorted((r.pool, r.game_id, round(r.elo_home, 6), round(r.elo_away, 6), round(r.gain, 6)) for r in df.collect())
    assert pick(got) == pick(want) and got.count() == 900
    assert not hasattr(J, "EloPool")  # a contest at a time
