from datetime import datetime as D
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from tallyfield.operators import feature_store as P
from tallyfield.operators import features as X
from tallyfield.plans.registry import Tables
from tallyfield.plans.stored import HISTORY, builder, feature_store
from tallyfield.plans.ratings import _targets
from tallyfield.sources.parted import PartedTable
from tallyfield.sources.shared import checkpointed, fresh
from tallyfield.streaming import jobs as J

SCHEMA = "part int, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def parted(spark, schema=SCHEMA, part="part"):
    return PartedTable(spark, fresh(spark, "parted"), spark.createDataFrame([], schema).schema, part)


def test_parts_are_replaced_added_and_removed_while_others_keep_their_files(spark):
    t = parted(spark)
    df = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert rows(t.read()) == [] and t.versions() == []
    t.append(0, df((1, "a"), (2, "b"), (2, "b"), (None, "n")))
    first = t.manifest()
    assert set(first) == {1, 2, -1} and rows(t.read()) == sorted([(1, "a"), (2, "b"), (2, "b"), (None, "n")], key=str)
    t.replace(1, df((2, "c"), (3, "d")), [2, 3])
    assert t.manifest()[1] == first[1] and t.manifest()[-1] == first[-1] and rows(t.read([2, 3])) == [(2, "c"), (3, "d")]
    t.replace(1, df((2, "e")), [2])  # a write that is repeated starts from the version before it
    assert rows(t.read()) == sorted([(1, "a"), (2, "e"), (None, "n")], key=str) and rows(t.read(version=1)) == sorted([(1, "a"), (2, "b"), (2, "b"), (None, "n")], key=str)
    t.append(2, df((1, "f")))
    assert len(t.manifest()[1]) == 2 and rows(t.read([1])) == [(1, "a"), (1, "f")]
    t.replace(3, df().limit(0), [1, None])
    assert rows(t.read()) == [(2, "e")] and t.versions() == [2, 3]


@pytest.fixture(scope="module")
def small(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    obs, targets = checkpointed(t["obs"]), checkpointed(_targets(t))
    return obs, targets, checkpointed(builder(obs)(targets))


def test_the_store_follows_late_facts_and_gone_contests(spark, small):
    obs, targets, whole = small
    late = (F.col("season") == 2000) & (F.col("game_id") % 5 == 0)
    store, before = feature_store(spark, "store", whole), obs.where(~late)
    P.refresh(store, 0, targets, before, builder(before))
    files = store.manifest()
    assert P.refresh(store, 1, targets, before, builder(before)).count() == 0 and store.versions() == [0]  # nothing is stale
    actions = P.refresh(store, 1, targets, obs, builder(obs))
    first = obs.where(late).agg(F.min("avail")).first()[0]
    assert {r.game_id for r in actions.collect()} == {r.game_id for r in targets.where(F.col("cutoff") >= F.lit(first)).collect()}
    assert all(store.manifest()[s] == files[s] for s in files if s < 2000) and store.manifest()[2000] != files[2000]
    columns = ["game_id", "cutoff", "pp_home", *HISTORY]
    assert store.read().select(columns).exceptAll(whole.select(columns)).count() == 0 and store.read().count() == whole.count()
    gone = targets.where("season <> 1995 AND game_id % 2 = 0")
    P.refresh(store, 2, gone, obs, builder(obs))
    assert 1995 not in store.manifest() and rows(store.read().select("game_id")) == rows(gone.select("game_id"))


def test_the_log_adds_a_prediction_once(spark, small):
    obs, targets, _ = small
    slate, at = targets.where("season = 2001").drop("cutoff"), D(2001, 3, 1)
    score = lambda f: f.withColumn("p_home", F.expr("1 / (1 + exp(-pts_margin / 10))"))
    make = lambda now, backtest=False: P.predictions(slate, F.lit(now), "v1", builder(obs), score, HISTORY, backtest)
    live = checkpointed(make(at))
    log = PartedTable(spark, fresh(spark, "log"), live.schema, "season")
    n = slate.count()
    assert P.append_predictions(log, 0, live) == n and P.append_predictions(log, 1, live) == 0 and log.versions() == [0]
    assert P.append_predictions(log, 1, live.unionByName(live).withColumn("created", F.lit(D(2001, 3, 2)))) == 0  # repeats, made later
    nameless = live.limit(1).withColumn("game_id", F.lit(None).cast("long"))
    assert P.append_predictions(log, 1, nameless) == 1 and P.append_predictions(log, 2, nameless) == 0
    back = make(D(2100, 1, 1), backtest=True)
    assert P.append_predictions(log, 2, back) == n and not log.read().where("origin = 'backtest' AND (is_blind OR cutoff <> kickoff)").count()
    assert not log.read().where("origin = 'live' AND (cutoff > kickoff OR cutoff > timestamp_ntz'2001-03-01' OR is_blind <> (kickoff > timestamp_ntz'2001-03-01'))").count()


def test_the_audit_finds_what_was_changed(spark, small):
    obs, targets, _ = small
    slate = targets.where("season >= 2000").drop("cutoff")
    score = lambda f: f.withColumn("p_home", F.lit(0.5))
    log = checkpointed(P.predictions(slate, F.col("kickoff") - F.expr("INTERVAL 1 HOUR"), "v1", builder(obs), score, HISTORY).join(slate.select("game_id", "neutral"), "game_id"))
    assert P.audit(log, builder(obs), HISTORY).count() == 0
    ids = sorted(r.game_id for r in log.collect())
    at = lambda i: F.col("game_id") == ids[i]
    bad = log.withColumns({"form_diff": F.when(at(0), F.col("form_diff") + 1).otherwise(F.col("form_diff")), "is_blind": F.lit(True), "created": F.when(at(2), F.col("kickoff")).otherwise(F.col("created"))})
    bad = P.with_hashes(bad, HISTORY).withColumn("snapshot_sha256", F.when(at(1), "00").otherwise(F.col("snapshot_sha256")))
    bad = bad.withColumn("cutoff", F.when(at(3), F.col("kickoff") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("cutoff")))
    build = lambda x: builder(obs)(x).where(~at(4))
    assert sorted((r.kind, r.game_id, r.feature) for r in P.audit(bad, build, HISTORY).collect()) == [("feature", ids[0], "form_diff"), ("hash", ids[1], None), ("hash", ids[3], None), ("missing", ids[4], None), ("timestamp", ids[2], None), ("timestamp", ids[3], None)]
    assert P.audit(log.limit(0), builder(obs), HISTORY).count() == 0


def test_digests_lead_to_the_groups_that_changed(spark, small):
    obs, targets, _ = small
    facts, keys = obs.select("season", F.col("off_id").alias("team"), "game_id", "avail", "margin"), ["season", "team"]
    was = checkpointed(P.fact_digests(facts, keys, ["game_id", "avail", "margin"]))
    again = P.fact_digests(facts.repartition(7), keys, ["game_id", "avail", "margin"])
    assert P.changed_groups(was, again, keys).count() == 0
    one = facts.where("season = 2001").orderBy("game_id", "team").first()
    now = P.fact_digests(facts.withColumn("margin", F.when((F.col("game_id") == one.game_id) & (F.col("team") == one.team), 99).otherwise(F.col("margin"))), keys, ["game_id", "avail", "margin"])
    changed = P.changed_groups(was, now, keys)
    assert rows(changed) == [(2001, one.team)]
    log = P.predictions(targets.where("season = 2001").drop("cutoff"), F.col("kickoff") - F.expr("INTERVAL 1 HOUR"), "v1", builder(obs), lambda f: f.withColumn("p_home", F.lit(0.5)), HISTORY)
    log = checkpointed(log.join(targets.select("game_id", "neutral"), "game_id").withColumn("n_home", F.lit(-1).cast("long")))
    seen = []
    P.audit(log, lambda x: seen.append(x) or builder(obs)(x), HISTORY, changed=changed).count()
    assert rows(seen[0].select("game_id")) == rows(log.where((F.col("home_id") == one.team) | (F.col("away_id") == one.team)).select("game_id"))
    gone = P.fact_digests(facts.where(F.col("team") != one.team), keys, ["game_id", "avail", "margin"])
    assert {r.team for r in P.changed_groups(was, gone, keys).collect()} == {one.team}


def test_a_batch_that_fails_half_way_is_finished_once(spark):
    landing, state = fresh(spark, "landing"), fresh(spark, "state")
    a, b = parted(spark), parted(spark)
    fail = [True]

    def second(batch, n):
        if fail.pop() if fail else False:
            raise RuntimeError("lost")
        b.append(n, batch.selectExpr("part", "upper(v) AS v"))

    for batch in ([(1, "x"), (2, "y")], [(1, "z")]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        for _ in range(2):
            try:
                J.each_once(J.landed(spark, landing, SCHEMA, 1), [(a, lambda batch, n: a.append(n, batch)), (b, second)], state)
            except Exception as e:  # noqa: BLE001
                assert "lost" in str(e)
    assert rows(a.read()) == [(1, "x"), (1, "z"), (2, "y")] and rows(b.read()) == [(1, "X"), (1, "Z"), (2, "Y")]


def test_pending_rows_come_out_after_a_restart(spark):
    landing = {s: fresh(spark, "landing") for s in "lr"}
    out, state = fresh(spark, "out"), fresh(spark, "state")
    schemas = {"l": "id long, l_k long, asked timestamp", "r": "r_k long, found timestamp"}
    day = lambda d: D(2020, 1, 1) + timedelta(days=d)
    parts = [{"l": [(1, 10, day(0)), (2, 20, day(0)), (5, None, day(0))], "r": [(10, day(0) + timedelta(hours=5))]}, {"l": [(3, 30, day(9))], "r": [(20, day(9)), (30, day(9))]}, {"l": [(4, 40, day(30)), (-1, -1, day(60))], "r": [(-2, day(60))]}]
    seen = []
    for part in parts:
        for s, data in part.items():
            spark.createDataFrame(data, schemas[s]).coalesce(1).write.mode("append").parquet(landing[s])
        joined = J.matched(*(J.landed(spark, landing[s], schemas[s], 1) for s in "lr"), "k", "asked", "found", "1 DAY", how="left")
        seen.append(sorted((r.id, r.r_k) for r in J.run(joined, out, state).collect()))
    assert (1, 10) in seen[0] and seen[-1] == [(1, 10), (2, None), (3, 30), (4, None), (5, None)]


def test_the_cycle_goes_on_after_a_stop_and_takes_each_result_once(spark):
    from tallyfield.plans.stored import update_cycle

    landing, path = fresh(spark, "landing"), fresh(spark, "cycle")
    schema = "game_id long, season int, kickoff timestamp_ntz, margin double"
    asked = spark.createDataFrame([(2 * i + k, i, 0.5 + 0.01 * (i % 40), float(i % 7 + k)) for i in range(60) for k in (0, 1)], "pred_id long, game_id long, p_home double, pred_margin double")
    game = lambda i: (i, 2000 + i // 20, D(2000 + i // 20, 1, 1), float(i % 7 - 3))
    for batch in ([game(i) for i in range(20)], [game(i) for i in range(15, 40)], [game(3)], [game(i) for i in range(40, 60)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(landing)
        for _ in range(2):  # a run without anything new changes nothing
            results, evaluations, models = update_cycle(J.landed(spark, landing, schema, 1), asked, path, least=35)
    assert rows(results.read().select("game_id")) == [(i,) for i in sorted(range(60), key=lambda i: str((i,)))]
    assert evaluations.read().count() == evaluations.read().select("pred_id").distinct().count() == 120
    assert [(r.season, r.games) for r in models.read().collect()] == [(2001, 40)]  # 20 more aren't enough to learn again
    seen = evaluations.read().where("season < 2002").agg(F.regr_slope("margin", "pred_margin")).first()[0]
    assert models.read().first().slope == pytest.approx(seen)
