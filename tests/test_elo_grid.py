import numpy as np
import pytest
from tallyfield.operators import ratings as R

POINTS = [(36.0, 45.0, 0.25), (24.0, 30.0, 0.4), (48.0, 0.0, 0.0)]


@pytest.mark.parametrize("sides", [2, 40, 700])
def test_all_points_at_once_equal_one_contest_after_the_other(sides):
    """In batches of any size, with seasons that begin and divisions that change between them."""
    rng, n, names = np.random.default_rng(sides), 3000, [*R.ELO_START]
    season = np.sort(rng.integers(1992, 1999, n)) + rng.choice([0, -1], n, p=[0.95, 0.05])
    home = rng.integers(0, sides, n)
    away = (home + rng.integers(1, sides, n)) % sides
    m, neutral = rng.integers(-30, 31, n).astype(float), rng.random(n) < 0.2
    hd, ad = rng.integers(0, 3, (2, n))
    want = []
    for k, h, r in POINTS:
        pool = R.EloPool(k, h, r, R.ELO_START)
        want.append([pool.meet(int(s), int(x), int(y), float(z), bool(e), (names[a], names[b])) for s, x, y, z, e, a, b in zip(season, home, away, m, neutral, hd, ad)])
    grid, got = R.EloGrid(POINTS, R.ELO_START), []
    for part in np.split(np.arange(n), [1, 700, 2500]):
        got.append(np.stack(grid.meet(*(c[part] for c in (season, home, away, m, neutral, hd, ad)))))
    np.testing.assert_allclose(np.concatenate(got, axis=1), np.array(want).transpose(2, 1, 0), rtol=1e-10, atol=1e-10)


def test_contests_move_once_whatever_the_grid(spark):
    """The rows that are sorted for the tasks don't grow with the points."""
    from tallyfield.plans.ratings import _grid, _pooled
    from tallyfield.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    rated = R.elo(_pooled(t), _grid(t, POINTS))
    assert rated.count() == 3 * t["contest"].count()
    plan = rated._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("MapInArrow") < plan.index("RepartitionByExpression") and "Join" not in plan
