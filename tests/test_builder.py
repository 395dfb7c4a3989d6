from pyspark.sql import functions as F
from tallyfield.plans import stored as P
from tallyfield.plans.registry import Tables
from tallyfield.sources.shared import checkpointed

SF = "/root/testdata/sf0.001"


def test_a_builder_solves_its_ratings_once(spark, monkeypatch):
    t = Tables(spark, SF)
    obs, targets, solved, solve = checkpointed(t["obs"]), checkpointed(P._targets(t)), [], P._ratings_asof
    monkeypatch.setattr(P, "_ratings_asof", lambda o: solved.append(1) or solve(o))
    build = P.builder(obs)
    some = [build(targets.where(F.col("season") == s)) for s in (1996, 1998)]
    assert len(solved) == 1
    every = {r["game_id"]: r for r in build(targets).collect()}
    assert all(every[r["game_id"]] == r for part in some for r in part.collect()) and len(solved) == 1
