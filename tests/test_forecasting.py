import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.binding import Star
from tallyspark.functions import timeseries as ts
from tallyspark.operators import forecasting

N = np.arange(13, 80)


def walk(seed=1, size=79):
    rng = np.random.default_rng(seed)
    return 1000 + 10 * np.arange(size) + 20 * rng.standard_normal(size).cumsum() + 40 * np.sin(2 * np.pi * np.arange(size) / 12), rng.random(size)


@pytest.mark.parametrize("name", ts.MODELS)
def test_origins_together_give_what_each_gives_alone_and_see_the_past_only(name):
    y, rate = walk()
    got = ts.scaled(name, ts.adjusted(y, N, 60), N, rate)
    assert got.shape == (67, 3, 3) and np.isfinite(got).all()
    assert (got[:, 1] <= got[:, 0]).all() and (got[:, 0] <= got[:, 2]).all()
    for k in (13, 24, 40, 62):
        later = np.r_[y[:k], 3 * y[k:]]
        alone = ts.scaled(name, ts.adjusted(later, np.array([k]), 60), np.array([k]), np.r_[rate[:k], rate[k:] + 9])
        assert np.allclose(alone[0], got[k - 13], rtol=1e-6)


def test_flat_zero_and_straight_series_are_defined():
    straight = 100.0 + 5 * np.arange(30)
    for name in ts.MODELS:
        for y in (np.zeros(30), np.full(30, 7.0), straight):
            got = ts.scaled(name, y[None], np.array([30]), np.zeros(30))
            assert np.isfinite(got).all(), name
    for name in ("drift", "arima", "arima_rate", "additive"):
        assert np.allclose(ts.scaled(name, straight[None], np.array([30]), np.zeros(30))[0, 0], [250, 255, 260], rtol=1e-2), name


def test_likelihood_is_exact():
    d = np.random.default_rng(2).standard_normal(40)
    for phi, theta in ((0.0, 0.0), (0.6, 0.0), (0.0, -0.5), (0.4, 0.3), (-0.7, 0.2)):
        g = np.empty(40)
        g[0] = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
        g[1] = phi * g[0] + theta
        for k in range(2, 40):
            g[k] = phi * g[k - 1]
        cov = g[np.abs(np.subtract.outer(np.arange(40), np.arange(40)))]
        inv, one = np.linalg.inv(cov), np.ones(40)
        mu = one @ inv @ d / (one @ inv @ one)
        var = (d - mu) @ inv @ (d - mu) / 40
        loss, weight, v, _ = ts._arma(np.stack((d[None], np.ones((1, 40)))), np.array([40]), np.full((1, 1), phi), np.full((1, 1), theta))
        assert np.allclose(loss, 40 * (np.log(2 * np.pi * var) + 1) + np.linalg.slogdet(cov)[1])
        assert np.allclose(weight, mu) and np.allclose(v, var)


def test_arima_finds_the_order_and_weights_of_a_long_series():
    rng = np.random.default_rng(5)
    e, d = rng.standard_normal(3000), np.zeros(3000)
    for t in range(1, 3000):
        d[t] = 0.6 * d[t - 1] + e[t]
    y = 50 + np.cumsum(0.2 + d)
    got = ts.arima(y[None], np.array([3000]))[0]
    step, want = d[-1], []
    for h in range(3):
        step *= 0.6
        want.append((want[-1] if want else y[-1]) + 0.2 + step)
    assert np.allclose(got[0], want, atol=0.4)
    assert np.allclose(got[2, 0] - got[0, 0], ts.Z80, rtol=0.05)


def test_smoothing_equals_its_recursion_at_any_start():
    y = walk()[0][:30] / 1000
    a, b, f = 0.4, 0.1, 0.9
    sse, level, slope = (v.item() for v in ts._smooth(y[None], np.array([30]), np.full((1, 1), a), np.full((1, 1), b), np.full((1, 1), f), True))

    def run(l, s):
        total = 0.0
        for v in y:
            miss = v - l - f * s
            total += miss**2
            l, s = l + f * s + a * miss, f * s + b * miss
        return total, l, s

    starts = [run(l, s) for l in np.linspace(0.8, 1.2, 41) for s in np.linspace(-0.1, 0.1, 41)]
    near = min(starts)
    assert sse <= near[0] + 1e-9 and abs(near[0] - sse) < 1e-3 and abs(near[1] - level) < 0.01 and abs(near[2] - slope) < 0.01


def test_theta_by_its_formula():
    y = walk()[0][:30] / 1000
    got = ts.theta(y[None], np.array([30]))[0, 0]
    runs = []
    for a in np.linspace(0.01, 0.99, 491):
        for start in np.linspace(0.9, 1.1, 101):
            level, miss = start, 0.0
            for v in y:
                miss += (v - level) ** 2
                level += a * (v - level)
            runs.append((miss, level, a))
    _, level, a = min(runs)
    slope = np.polyfit(np.arange(30), y, 1)[0]
    assert np.allclose(got, [level + slope / 2 * (h - 1 + (1 - (1 - a) ** 30) / a) for h in (1, 2, 3)], rtol=5e-3)


def test_break_lifts_the_months_before():
    smooth = 100 * 1.01 ** np.arange(30)
    y = np.where(np.arange(30) < 20, smooth, 1.5 * smooth)
    got = ts.without_step(y, 20)
    lift = (y[20] / y[19] - 1.01) * y[19]
    assert np.allclose(got, np.where(np.arange(30) < 20, y + lift, y)) and np.isclose(got[20] - got[19], 0.01 * y[19])
    assert (ts.without_step(y[:20], 20) == y[:20]).all()
    assert (ts.without_step(np.r_[0, y], 21) == np.r_[0, y]).all()


def test_boosted_learns_and_leaves_out_empty_series():
    rng = np.random.default_rng(4)
    month = np.arange(60) % 12 + 1
    jump = np.where(month == 3, 0.2, -0.01)
    values = np.exp(np.cumsum(np.tile(jump, (60, 1)) + 0.002 * rng.standard_normal((60, 60)), axis=1) + 3)
    values[0, 5] = 0
    n = 50  # the next months are 3, 4 and 5
    got = ts.boosted(values[:, :n], month, np.zeros(60), None)
    assert (got[0] == values[0, n - 1]).all()
    assert np.abs(got[1:] / values[1:, n : n + 3] - 1).mean() < 0.05
    assert np.isclose(ts.boosted_bands(values[1], got[1:2], np.array([n]))[0, 0], got[1]).all()


def test_bands_of_past_errors():
    y = walk()[0]
    n = np.array([*range(13, 77), 79])
    mean = np.array([np.full(3, y[k - 1]) for k in n])
    got = ts.boosted_bands(y, mean, n)
    past = [k for k in range(13, 77) if k + 3 <= 40]
    wide = np.maximum.accumulate([np.quantile([abs(y[k + h] / y[k - 1] - 1) for k in past], 0.8) for h in range(3)])
    assert np.allclose(got[40 - 13, 2], y[39] * (1 + wide))


def test_choice():
    rng = np.random.default_rng(6)
    base = pd.DataFrame({m: 1 + 0.3 * rng.random(64) for m in ts.CANDIDATES})
    assert forecasting.choose(base.assign(drift=0.5)) == "drift"
    better = base.assign(drift=2 + 0.3 * rng.random(64), theta=0.2 + 0.1 * rng.random(64))
    assert forecasting.choose(better) == "theta"
    assert forecasting.choose(pd.DataFrame({m: np.ones(64) for m in ts.CANDIDATES})) == "drift"
    assert forecasting.choose(base.assign(drift=2.0, naive=0.25, damped=0.25)) == "naive"
    assert forecasting.challenger_p(np.full(20, -1.0)) == 0.0 and forecasting.challenger_p(np.zeros(20)) == 1.0
    d = rng.standard_normal(40)
    assert np.isclose(forecasting.challenger_p(d) + forecasting.challenger_p(-d), 1)


def test_backtest_on_tables_follows_from_the_forecasts(spark, sf_dir):
    s = Star(spark, sf_dir)
    rows = forecasting.forecasts(s, "naive", "drift", first=13).where("series = 'all'").toPandas()
    y = forecasting.series(s).where("series = 'all'").orderBy("month").toPandas()["amount"].to_numpy()
    size = len(y)
    assert sorted(rows["origin"].unique()) == [*range(13, size - 2), size]
    at = forecasting._calendar(s)[1]
    for r in rows[rows["model"] == "naive"].itertuples():
        assert np.isclose(r.forecast, y[r.origin - 1])
        assert np.isnan(r.actual) if r.origin == size else np.isclose(r.actual, y[r.origin + r.h - 1])
        assert np.isclose(r.step, np.abs(np.diff(ts.without_step(y[: r.origin], at))).mean())


def test_all_candidates_enter_the_choice(spark, sf_dir):
    s = Star(spark, sf_dir)
    kept = forecasting.backtest(s).cache()
    found = kept.groupBy("series").agg(F.countDistinct("model").alias("m"), F.count("*").alias("n"), F.countDistinct("origin").alias("o")).collect()
    assert found and all(r["m"] == len(ts.CANDIDATES) and r["n"] == r["m"] * r["o"] * 3 for r in found)
    kept.unpersist()
