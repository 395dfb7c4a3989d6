from pyspark.sql import functions as F
from tallyfield.operators import features as X
from tallyfield.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_unit_ratings_read_contests_from_files(spark):
    """Contests, which take windows over the lines, are made once and not for each reading."""
    plan = QUERIES["fea_2_unit_ratings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_mean_units_equal_long_ratings(spark):
    rows = spark.createDataFrame([(1, 1, 2, 3.0, None), (1, 2, 1, 4.0, 0.5), (1, 1, 3, 5.0, 1.5), (2, 3, 1, None, 2.5)], "season int, off_id long, def_id long, a double, b double")
    contests = spark.createDataFrame([(7, 1, 1, 2), (8, 1, 1, 3), (9, 2, 3, 1)], "game_id long, season int, home_id long, away_id long")
    long = rows.unpivot(["season", "off_id", "def_id"], ["a", "b"], "metric", "y").where("y IS NOT NULL")
    side = lambda id, into: long.groupBy("season", F.col(id).alias("team"), "metric").agg(F.avg("y").alias(into))
    want = X.unit_ratings(contests, side("off_id", "o").join(side("def_id", "d"), ["season", "team", "metric"]), ["a", "b"], ["a"])
    got = X.units(contests, X.mean_units(rows, ["a", "b"]), ["a", "b"], ["a"])
    assert sorted(got.collect(), key=str) == sorted(want.select(*got.columns).collect(), key=str)
