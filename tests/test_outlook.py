import numpy as np
import pytest

from tidepanel.operators import outlook


def test_cubic_is_followed_beyond_its_end():
    t = np.arange(60.0)
    total = 1e-6 * t**3 - 2e-5 * t**2 + 1e-3 * t
    r = np.diff(total, prepend=0.0)
    ahead = 59.0 + 21
    want = 1e-6 * (ahead**3 - 59.0**3) - 2e-5 * (ahead**2 - 59.0**2) + 1e-3 * 21
    assert outlook.cubic_step(r, 21) == pytest.approx(want, abs=1e-9)


def test_bad_fit_gives_no_step():
    assert outlook.cubic_step(np.resize([40.0, -40.0], 60), 5) is None


def test_order_of_differences():
    rng = np.random.default_rng(4)
    noise = rng.normal(0, 0.01, 300)
    assert outlook.difference_order(noise) == 0
    assert outlook.difference_order(np.cumsum(noise)) == 1
    assert outlook.difference_order(noise[:10]) == 0
    assert outlook.difference_order(np.full(100, 0.01)) == 0


def test_forecasts_of_short_constant_and_empty_series(spark):
    rng = np.random.default_rng(5)
    rows = [(0, 1, k, float(x)) for k, x in enumerate(rng.normal(0, 0.01, 40))]
    rows += [(0, 2, k, 0.01) for k in range(40)] + [(0, 3, k, float(k)) for k in range(5)] + [(0, 4, k, None) for k in range(3)]
    series = spark.createDataFrame(rows, "window_id int, cluster int, pos int, r double")
    got = {x.cluster: x for x in outlook.forecasts(series, 10).collect()}
    assert [got[k].model for k in (1, 2, 3, 4)] == ["spline", "historical_mean", "historical_mean", "empty"]
    assert got[1].expected_return == pytest.approx(outlook.cubic_step(np.array([x[3] for x in rows[:40]]), 10))
    assert got[2].expected_return == pytest.approx(0.1) and got[3].expected_return == pytest.approx(20.0) and got[4].expected_return == 0.0
    mean = {x.cluster: x.expected_return for x in outlook.historical_mean(series, 10).collect()}
    assert mean[2] == pytest.approx(0.1) and mean[4] == 0.0


def test_no_series_gives_no_forecasts(spark):
    none = spark.createDataFrame([], "window_id int, cluster int, pos int, r double")
    assert outlook.forecasts(none, 5).count() == outlook.historical_mean(none, 5).count() == 0
