from datetime import datetime, timedelta

import numpy as np
import pytest
from tallyfield.operators import models as M


def contests(spark, n=900):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 2))
    margin = (4 * x[:, 0] + 2 * x[:, 1] + rng.normal(0, 3, n)).tolist()
    at = [datetime(1999, 1, 1) + timedelta(hours=9 * i) for i in range(n)]
    return spark.createDataFrame([(i, at[i], at[i] + timedelta(hours=4), float(x[i, 0]), float(x[i, 1]), margin[i], 50.0 + abs(margin[i]), int(margin[i] > 0)) for i in range(n)], "game_id long, kickoff timestamp_ntz, avail timestamp_ntz, a double, b double, margin double, total double, home_win int")


def test_candidates_fit_only_what_they_do_not_share(spark, monkeypatch):
    """Configurations that differ in calibration or combination share their members, and give what they give alone."""
    rows, fits = contests(spark), []
    for name, keep in list(M.MEMBERS.items()):
        monkeypatch.setitem(M.MEMBERS, name, lambda *args, _keep=keep, **settings: fits.append(settings) or _keep(*args, **settings))
    base = M.Config(("a", "b"))
    cases = [(base, 4), (M.Config(("a", "b"), calibration="platt"), 0), (M.Config(("a", "b"), members={"logistic": {"C": 0.3}, "margin_ridge": {"alpha": 10.0}}), 2)]
    known = {}
    for config, count in cases:
        fits.clear()
        shared = M.fit_ensemble(config, rows, known=known)
        assert len(fits) == count
        if config is base:
            continue
        alone = M.fit_ensemble(config, rows)
        got, want = ([tuple(r) for r in m.score(rows).orderBy("game_id").select("p_home", "pred_margin", "pred_total").collect()] for m in (shared, alone))
        assert np.allclose(np.array(got), np.array(want), atol=1e-9)


def test_weights_of_one_task_equal_those_of_aggregates(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(float(p) if i % 50 else None, float(q), int(rng.random() < p)) for i, (p, q) in enumerate(rng.random((3000, 2)))], "p double, q double, home_win int")
    one = M.mixture_weights(rows, ["p", "q"])
    assert M.mixture_weights(rows.where("false"), ["p", "q"]) == {"p": 0.5, "q": 0.5}
    monkeypatch.setattr(M, "EM_ROWS", -1)
    assert one == pytest.approx(M.mixture_weights(rows, ["p", "q"]), abs=1e-9) and one["p"] > 0.9
