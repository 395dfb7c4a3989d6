import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from tallyfield.operators import boosting as B
from tallyfield.operators import learning as L
from tallyfield.operators import models as M


def plain(bins, y, w, chance, s, first, width):
    """Scores of a booster that holds all rows, measures every leaf anew and splits the best one."""
    score, out, ids = np.full(len(y), first), [], np.arange(len(y))
    for number in range(s.rounds):
        g, h = B.gradients(score, y, w, chance)
        seen, features = B.drawn(ids, number, s), B.looked_at(bins.shape[1], number, s)
        leaves = [np.ones(len(y), dtype=bool)]
        while len(leaves) < s.leaves:
            best = (1e-12, None)
            for i, rows in enumerate(leaves):
                for f in features:
                    for b in range(width):
                        left, right = rows & seen & (bins[:, f] <= b), rows & seen & (bins[:, f] > b)
                        if min(left.sum(), right.sum()) >= s.leaf:
                            worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.penalty)
                            gain = worth(left) + worth(right) - worth(rows & seen)
                            if gain > best[0] + 1e-12:
                                best = (gain, (i, f, b))
            if best[1] is None:
                break
            i, f, b = best[1]
            rows = leaves.pop(i)
            leaves += [rows & (bins[:, f] <= b), rows & (bins[:, f] > b)]
        for rows in leaves:
            score[rows] -= s.step * g[rows & seen].sum() / (h[rows & seen].sum() + s.penalty)
        out.append(len(leaves))
    return score, out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(0, 1, 500).round(2), rng.integers(0, 3, 500), rng.normal(0, 2, 500).round(1), np.zeros(500)], axis=1)
    margin = 3 * x[:, 0] * (x[:, 1] > 0) + np.abs(x[:, 2]) + rng.normal(0, 1, 500)
    return x, margin, (margin > 1).astype(int), rng.choice([0.5, 1.0, 2.0], 500)


def frame(spark, data):
    x, margin, win, w = data
    return spark.createDataFrame([(*map(float, r), float(m), int(k), float(v)) for r, m, k, v in zip(x, margin, win, w)], "a double, b double, c double, d double, margin double, home_win int, weight double").coalesce(1)


@pytest.mark.parametrize("chance", [True, False])
def test_scores_equal_a_plain_booster(spark, data, chance, monkeypatch):
    monkeypatch.setattr(B, "REFRESH", 2)
    x, margin, win, w = data
    y = win if chance else margin
    s = B.Settings(rounds=5, step=0.3, leaves=6, leaf=20, penalty=5.0, features=0.75)
    base = M.assembled(frame(spark, data), list("abcd"), "_x")
    booster = B.boost(base, "home_win" if chance else "margin", 4, chance, s, cuts=[*(np.quantile(x[:, i], np.arange(1, 8) / 8).tolist() for i in (0,)), [0.0, 1.0], sorted(set(np.quantile(x[:, 2], np.arange(1, 8) / 8).tolist())), []])
    mean = (w * y).sum() / w.sum()
    want, leaves = plain(booster.bins(x), y, w, chance, s, np.log(mean / (1 - mean)) if chance else mean, 8)
    assert [sum(f < 0 for f in t.feature) for t in booster.trees] == leaves and max(leaves) == 6
    assert booster.scores(x) == pytest.approx(want, abs=1e-9)
    assert B.Booster.of(booster.text()).scores(x) == pytest.approx(want, abs=1e-9)


def test_quantile_cuts_and_penalty(spark, data):
    rows = frame(spark, data)
    cuts = B.cuts_of(M.assembled(rows, list("abcd"), "_x"), 4, bins=8)
    assert cuts[1] == [0.0, 1.0] and cuts[3] == [] and len(cuts[0]) == 7
    size = lambda penalty: np.abs([v for t in B.boost(M.assembled(rows, list("abcd"), "_x"), "home_win", 4, True, B.Settings(rounds=1, penalty=penalty)).trees for v in t.value]).max()
    assert size(50.0) < size(5.0)


def test_members_score_save_and_load(spark, data, tmp_path):
    rows = frame(spark, data)
    gbm, margins = M.trees(rows, tuple("abcd"), rounds=25, step=0.1), M.margin_trees(rows, tuple("abcd"), rounds=25, step=0.1)
    out = margins.score(gbm.score(rows))
    loss, error = out.agg(F.avg(F.pow(F.col("p_gbm") - F.col("home_win"), 2)), F.avg(F.abs(F.col("m_gbm_margin") - F.col("margin")))).first()
    assert loss < 0.13 and error < 1.4 and "p_gbm_margin" not in out.columns
    gbm.model.write().overwrite().save(f"file://{tmp_path}/gbm")
    back = M.Fitted("gbm", PipelineModel.load(f"file://{tmp_path}/gbm"), tuple("abcd"))
    assert back.score(rows).agg(F.max(F.abs(F.col("p_gbm")))).first() == gbm.score(rows).agg(F.max(F.abs(F.col("p_gbm")))).first()


def test_nothing_to_split(spark, data):
    rows = frame(spark, data)
    for few in (rows.where("false"), rows.limit(1), rows.withColumn("a", F.lit(1.0)).withColumn("home_win", F.lit(1))):
        p = {round(r.p_gbm, 3) for r in M.trees(few, ("a",), rounds=2).score(rows).collect()}
        assert len(p) == 1


def test_more_regularised_means_a_greater_penalty():
    config = M.Config(("a",), members={"gbm": {}, "gbm_margin": {"penalty": 1.0}, "logistic": {}})
    name, new = L.moved(config, 5)
    assert name == "gbm_leaf_up_penalty_up" and new.members == {"gbm": {"leaf": 80, "penalty": 15.0}, "gbm_margin": {"leaf": 80, "penalty": 3.0}, "logistic": {}}


def test_a_pass_reads_what_its_tree_sees_and_few_tasks(spark, data, monkeypatch):
    """Each tree finds its rows and gradients once; passes read these, in no more tasks than there are cores."""
    passes, keep = [], B.added_up
    monkeypatch.setattr(B, "added_up", lambda seen, *rest: passes.append((seen.id(), seen.getNumPartitions(), len(seen.first()))) or keep(seen, *rest))
    monkeypatch.setattr(B, "TASK_ROWS", 10)
    s = B.Settings(rounds=3, leaves=6, leaf=20)
    B.boost(M.assembled(frame(spark, data), list("abcd"), "_x"), "home_win", 4, True, s)
    assert len({id for id, *_ in passes}) == 3 < len(passes)
    assert all(tasks <= spark.sparkContext.defaultParallelism and cells == 3 for _, tasks, cells in passes)


@pytest.mark.parametrize("chance", [True, False])
def test_one_task_grows_the_trees_of_many(spark, data, chance, monkeypatch):
    """A table that a task can hold is boosted by one job, and gives the scores that passes of many tasks do."""
    x, s = data[0], B.Settings(rounds=12, step=0.3, leaves=8, leaf=10, features=0.75)
    base, label, passes, keep = M.assembled(frame(spark, data), list("abcd"), "_x"), "home_win" if chance else "margin", [], B.added_up
    monkeypatch.setattr(B, "added_up", lambda *args: passes.append(1) or keep(*args))
    one = B.boost(base, label, 4, chance, s)
    assert not passes
    monkeypatch.setattr(B, "TASK_ROWS", 10)
    many = B.boost(base.repartition(3), label, 4, chance, s)  # numbered otherwise, so other rows are drawn
    same = B.boost(base, label, 4, chance, s)
    assert passes and len(one.trees) == len(many.trees) == 12
    assert one.scores(x) == pytest.approx(same.scores(x), abs=1e-9) and one.cuts == same.cuts
