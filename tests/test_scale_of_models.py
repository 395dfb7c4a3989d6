import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.operators import models as M
from tallyfield.operators import ratings as R


def test_margin_weights_hold_for_large_sums(spark):
    rows = spark.createDataFrame([(float(a), 0.5 * a + 2, 0.7 * a + (i % 5) - 2.0) for i, a in enumerate(range(-40, 41))], "m_a double, m_b double, margin double")
    a, b, y = (np.array([r[i] for r in rows.collect()]) for i in range(3))
    want = ((a - b) @ (y - b)) / ((a - b) @ (a - b))
    many = rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(20_000))))
    for of in (rows, many):
        got = M.margin_weights(of, ["m_a", "m_b"])
        assert (got["m_a"], got["m_b"]) == pytest.approx((want, 1 - want), abs=1e-7)
    same = M.margin_weights(many.withColumn("m_b", F.col("m_a")), ["m_a", "m_b"])
    assert sum(same.values()) == pytest.approx(1)


def test_sweeps_write_their_cells_few_times(spark, monkeypatch):
    obs = spark.range(600).select(F.lit(1).alias("season"), (F.col("id") % 30).alias("off_id"), ((F.col("id") * 7 + F.floor(F.col("id") / 30) + 1) % 30).alias("def_id"), (F.col("id") % 3 - 1).alias("loc"), (F.col("id") % 11).cast("double").alias("y"))
    written, keep = [], R.checkpointed
    monkeypatch.setattr(R, "checkpointed", lambda df: written.append(keep(df)) or written[-1])
    got = {r.team: r for r in R.ridge_by_sweeps(obs, ["season"], 8.0, sweeps=3).collect()}
    cells = R.ridge_cells(obs, ["season"]).count()
    assert sum(df.count() >= cells for df in written) <= 3  # not once for each step of a sweep
    assert len(got) == 30 and all(r.o is not None and r.d is not None for r in got.values())
