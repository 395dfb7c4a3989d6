from datetime import datetime, timedelta

import pytest
from tallyfield.operators import folds as V


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("k", [0, 1, 5, 29, 40])
def test_the_newest_rows_are_cut_by_a_filter(spark, k):
    rows = spark.createDataFrame([(i, datetime(2020, 1, 1) + timedelta(hours=5 * (i * 7 % 40 // 3))) for i in range(40)], "game_id long, kickoff timestamp_ntz")
    order = [r["game_id"] for r in sorted(rows.collect(), key=lambda r: (r["kickoff"], r["game_id"]))]
    old, new = V.split_newest(rows, 0.0, None, k)
    assert sorted(r["game_id"] for r in old.collect()) == sorted(order[: 40 - k])
    assert sorted(r["game_id"] for r in new.collect()) == sorted(order[40 - k :])
    assert "Join" not in plan(old) and "Union" not in plan(new)
