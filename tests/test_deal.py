from types import SimpleNamespace

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tallyfield.functions import scalars as S
from tallyfield.operators import models as M
from tallyfield.sources.shared import checkpointed


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_deal_moves_rows_once(spark):
    """It equals two numberings and a join."""
    rows = checkpointed(spark.range(11_000).select(F.col("id").alias("game_id"), (F.col("id") % 7 / 7).alias("a"), F.cos("id").alias("b"), (F.col("id") % 3 % 2).cast("int").alias("home_win")))
    seen = []
    p = 0.1 + 0.4 * F.col("a") + 0.3 * F.col("b") ** 2
    model = SimpleNamespace(members=(SimpleNamespace(features=("a", "b")),), total=None, stacker=None, score=lambda df: seen.append(df) or df.withColumn("p_home", p))
    got = {r["feature"]: r["delta"] for r in M.permutation_importance(model, rows, ["a", "b"]).collect()}
    assert "Join" not in plan(seen[-1]) and "Window" not in plan(seen[-1])
    loss = S.log_loss(p, F.col("home_win"))
    base = rows.agg(F.avg(loss)).first()[0]
    for f in "ab":
        deltas = []
        for r in range(3):
            feature, repeat = F.lit(f), F.lit(r)
            n = rows.withColumn("_b", F.pmod(F.xxhash64("game_id", feature, repeat), F.lit(2)))
            part = W.partitionBy("_b")
            n = n.withColumn("_i", F.row_number().over(part.orderBy("game_id"))).withColumn("_j", F.row_number().over(part.orderBy(F.xxhash64(F.lit(1), "game_id", feature, repeat))))
            dealt = n.drop(f).join(n.select("_b", F.col("_j").alias("_i"), f), ["_b", "_i"])
            deltas.append(dealt.agg(F.avg(loss)).first()[0] - base)
        assert got[f] == pytest.approx(sum(deltas) / 3, abs=1e-12)
