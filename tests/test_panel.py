from functools import cache

import numpy as np
import pytest

from tidepanel.config import Settings
from tidepanel.config import checked_sectors, load
from tidepanel.operators import align, alloc, engine, grouping, inference, outlook, returns, study, windows
from tidepanel.sources import panel

S = Settings()


def plain_score(a, b, s, band):
    """The best of all alignments, by their definition: each step pairs two letters or opens or goes on with a gap; a gap on one side
    isn't followed by one on the other."""

    @cache
    def best(i, j, last):
        if abs(i - j) > band:
            return -1e18
        if i == j == 0:
            return 0.0 if last == "pair" else -1e18
        if last == "pair":
            if not i or not j:
                return -1e18
            gain = s.match if a[i - 1] == b[j - 1] else -abs(a[i - 1] - b[j - 1])
            return gain + max(best(i - 1, j - 1, k) for k in ("pair", "left", "right"))
        p, q = (i - 1, j) if last == "left" else (i, j - 1)
        if min(p, q) < 0:
            return -1e18
        return s.gap_extend + max(best(p, q, "pair") + s.gap_open, best(p, q, last))

    return max(best(len(a), len(b), k) for k in ("pair", "left", "right"))


@pytest.mark.parametrize("band", [0, 1, 2, 5, 10])
def test_alignment_equals_plain_program(band):
    rng = np.random.default_rng(band)
    a, b = rng.integers(0, 5, (30, 20)).astype(float), rng.integers(0, 5, (30, 20)).astype(float)
    b[:10, 2:] = a[:10, :-2]
    want = [plain_score(list(x), list(y), S, band) for x, y in zip(a, b)]
    np.testing.assert_allclose(align.banded_scores(a, b, S, band), want, atol=1e-9)


def test_equal_strings_score_in_proportion():
    a = np.array([[0, 1, 2, 3, 4.0]])
    assert align.banded_scores(a, a, S)[0] == S.match * 5


def test_two_blocks_are_found():
    d = np.full((12, 12), 0.9)
    d[:6, :6] = d[6:, 6:] = 0.1
    np.fill_diagonal(d, 0)
    labels, sil, ok = grouping.constrained_labels(d, S)
    assert list(labels) == [0] * 6 + [1] * 6 and sil > 0.5 and ok


def test_few_assets_make_one_cluster():
    labels, sil, ok = grouping.constrained_labels(np.ones((4, 4)) - np.eye(4), S)
    assert set(labels) == {0} and np.isnan(sil) and not ok


def test_bad_settings_are_refused():
    for bad in ({"cutoffs": (0.2, 0.1, 0.3, 0.4)}, {"k_min": 1}, {"band": -1}, {"costs": (-1.0,)}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_caps_keep_totals(spark):
    df = spark.createDataFrame([(1, 0.9, 0.4), (1, 0.05, 0.4), (1, 0.05, 0.4), (2, 0.5, 0.6), (2, 0.5, 0.6)], "window_id int, w double, cap double")
    rows = alloc.capped(df, ["window_id"]).collect()
    assert abs(sum(r["w"] for r in rows if r["window_id"] == 1) - 1) < 1e-12
    assert all(r["w"] <= r["cap"] + 1e-12 for r in rows)


def test_gap_takes_two_returns_and_padding_none(spark):
    prices = spark.createDataFrame([("a", d, float(d)) for d in range(1, 6) if d != 3] + [("b", d, float(d)) for d in range(1, 6)], "asset string, dt int, price double")
    assert [r["r"] is None for r in returns.simple_returns(prices).where("asset = 'a'").orderBy("dt").collect()] == [False, True, True, False]
    assert returns.simple_returns(prices, "pad").where("r is null").count() == 0
    assert returns.common_days(returns.simple_returns(prices)).select("dt").distinct().count() == 2


def test_windows_hold_what_they_should(spark):
    s = Settings(train=6, hold=2)
    df = spark.range(15).selectExpr("'a' asset", "id dt", "cast(id as int) pos", "0.0 r")
    train = {(r["window_id"], r["pos"]) for r in windows.train_rows(df, s).collect()}
    ahead = {(r["window_id"], r["pos"]) for r in windows.forward_rows(df, s).collect()}
    offsets = [r["i"] for r in windows.schedule(df, s).orderBy("i").collect()]
    assert offsets == [6, 8, 10, 12]
    assert train == {(k, p) for k, i in enumerate(offsets) for p in range(i - 6, i)}
    assert ahead == {(k, p) for k, i in enumerate(offsets) for p in range(i, i + 2)}


def test_leaving_and_coming_back_cost(spark):
    w = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.5), (1, "a", 1.0), (2, "a", 0.5), (2, "b", 0.5)], "window_id int, asset string, w double")
    assert {r["window_id"]: r["turnover"] for r in engine.turnover(w).collect()} == {0: 1.0, 1: 1.0, 2: 1.0}


def test_caps_that_cannot_hold_are_refused(spark):
    df = spark.createDataFrame([(1, 0.5, 0.4), (1, 0.5, 0.4)], "window_id int, w double, cap double")
    with pytest.raises(Exception, match="infeasible"):
        alloc.capped(df, ["window_id"]).collect()
    zero = spark.createDataFrame([(1, 0.0, 0.0)], "window_id int, w double, cap double")
    assert alloc.capped(zero, ["window_id"]).first()["w"] == 0


def test_intervals_equal_plain_resampling(spark):
    import hashlib

    r = np.random.default_rng(3)
    x, y = r.normal(0.001, 0.01, 43), r.normal(0.0005, 0.01, 43)
    pairs = spark.createDataFrame([(k, float(p), float(q)) for k, (p, q) in enumerate(zip(x, y))], "pos int, x double, y double")
    got = {q["stat"]: (q["lo"], q["hi"]) for q in inference.bootstrap_intervals(pairs, S, 300, 6).collect()}
    rows, seen = [], set()
    for k in range(300):
        starts = [int(hashlib.md5(f"start:{k}:{b}".encode()).hexdigest()[:15], 16) % 38 for b in range(8)]
        seen.add(tuple(starts))
        at = np.concatenate([np.arange(v, v + 6) for v in starts])[:43]
        sharpe = [z[at].mean() / z[at].std() * 12**0.5 for z in (x, y)]
        year = [np.prod(1 + z[at]) ** (12 / 43) - 1 for z in (x, y)]
        rows.append((*sharpe, sharpe[0] - sharpe[1], year[0] - year[1]))
    assert len(seen) == 300
    for k, stat in enumerate(("sharpe_method", "sharpe_baseline", "sharpe_diff", "return_diff")):
        np.testing.assert_allclose(got[stat], np.percentile([v[k] for v in rows], [2.5, 97.5]), rtol=1e-9)
    few = inference.bootstrap_intervals(pairs.where("pos < 9"), S, 20, 6).collect()
    assert len(few) == 4 and all(q["lo"] is None and q["hi"] is None for q in few)


def test_failed_gates_give_equal_weights(spark):
    r = np.random.default_rng(4)
    train = spark.createDataFrame([(w, f"a{a}", k, k, float(v)) for w in range(2) for a in range(6) for k, v in enumerate(r.normal(0, 0.01 * (a + 1), 30))], "window_id int, asset string, pos int, dt int, r double")
    groups = spark.createDataFrame([(f"a{a}", a // 3) for a in range(6)], "asset string, cluster int")
    gate = spark.createDataFrame([(0, False), (1, True)], "window_id int, passed boolean")
    s = study.Settings(cap_factor=6.0)
    rows = study.gated_weights(train, groups, gate, s).collect()
    assert all(q["w"] == pytest.approx(1 / 6) for q in rows if q["window_id"] == 0)
    assert max(abs(q["w"] - 1 / 6) for q in rows if q["window_id"] == 1) > 0.01
    with pytest.raises(ValueError, match="unknown method"):
        study.method_weights(train, groups, s, "best")


def test_arma_finds_what_made_a_series():
    r = np.random.default_rng(5)
    x = np.zeros(300)
    for k in range(1, 300):
        x[k] = 0.7 * x[k - 1] + r.normal()
    aic, ar, _, level = outlook.arma_fit(x + 5, 1, 0, True)
    assert ar[0] == pytest.approx(0.7, abs=0.1) and level == pytest.approx(5, abs=0.8)
    # the exact likelihood of a first-order series, written out
    y, a = x + 5 - level, ar[0]
    rest = np.append(y[0] * (1 - a * a) ** 0.5, y[1:] - a * y[:-1])
    want = 300 * (np.log(2 * np.pi * np.mean(rest**2)) + 1) - np.log(1 - a * a) + 2 * 3
    assert aic == pytest.approx(want, abs=1e-3)
    value, p, d, q = outlook.arima_step(x + 5, 3)
    assert d == 0 and p + q >= 1 and 3 * 2 < value < 3 * 9


def test_settings_files_are_checked(tmp_path):
    pytest.importorskip("yaml")
    file = tmp_path / "s.yaml"
    file.write_text("train: 36\ncutoffs: [0.1, 0.3, 0.7, 0.9]\nallocator: forecast_tilt\n")
    assert load(str(file)) == Settings(train=36, cutoffs=(0.1, 0.3, 0.7, 0.9), allocator="forecast_tilt")
    for bad, kind in (("cutoffs: [0.4, 0.3, 0.7, 0.9]", ValueError), ("trian: 3", KeyError), ("tune_fraction: 1.5", ValueError), ("scope: all", ValueError)):
        file.write_text(bad)
        with pytest.raises(kind):
            load(str(file))
    with pytest.raises(ValueError):
        checked_sectors({"x": ["a", "b"], "y": ["c", "d", "e"], "z": ["f", "g", "h"]})


def test_stored_tables_are_read_back_until_forgotten(spark):
    import os

    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(1, 2.5), (2, None)], "asset int, r double")

    for _ in range(2):
        assert sorted(map(tuple, panel.once(spark, ("a test",), make).collect())) == [(1, 2.5), (2, None)]
    paths = [p for p in spark.__dict__["_tidepanel_paths"] if os.path.exists(p)]
    assert made == [1] and paths
    assert panel.spread(panel.once(spark, ("a test",), make), "asset").rdd.getNumPartitions() == 4
    panel.forget(spark)
    assert not any(map(os.path.exists, paths))
    assert panel.once(spark, ("a test",), make).count() == 2 and made == [1, 1]
