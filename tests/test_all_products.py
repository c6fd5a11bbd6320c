"""Models that are fitted for all products at once, against numpy."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from haat.operators import backtest, forecast_fourier as FF, least_squares as LS, shapley as SH

DAY0 = dt.date(1995, 1, 1)


def cube(spark, series):
    rows = [(p, DAY0 + dt.timedelta(t), 1, int(y), int(y) ** 2, 1.0, 1.0) for p, ys in series.items()
            for t, y in ys.items()]
    return spark.createDataFrame(rows, "product string, dt date, n_rows long, qty long, qty_sq long, "
                                       "price_sum double, amount double")


def design(t, lo, hi):
    u = (t - lo) / max(hi - lo, 1)
    d = (DAY0 - dt.date(2000, 1, 1)).days + t
    x = [1.0, u] + [max(u - c, 0) for c in (0.25, 0.5, 0.75)]
    for period, pairs in ((365.25, 2), (7.0, 3)):
        for j in range(1, pairs + 1):
            x += [math.sin(2 * math.pi * j * d / period), math.cos(2 * math.pi * j * d / period)]
    return x


def test_fourier_against_numpy(spark):
    rng = np.random.default_rng(1)
    series = {"season": {t: 500 + 0.3 * t + 80 * math.sin(2 * math.pi * t / 365.25) + 40 * (t % 7 == 3)
                         + rng.integers(0, 5) for t in range(900)},
              "gaps": {t: 100 + rng.integers(0, 50) for t in range(0, 700, 3)},
              "short": {t: 10 + t for t in range(12)}, "flat": {t: 7 for t in range(40)}, "few": {0: 1, 1: 2}}
    got = {}
    for r in FF.forecast_fourier(cube(spark, series)).collect():
        got.setdefault(r.product, {})[(r.ds - DAY0).days] = r
    assert set(got) == set(series) - {"few"} and all(len(v) == 30 for v in got.values())
    for p, rows in got.items():
        ts, ys = zip(*((t, int(y)) for t, y in series[p].items()))
        lo, hi = min(ts), max(ts)
        x, y = np.array([design(t, lo, hi) for t in ts]), np.array(ys, float)
        beta = np.linalg.solve(x.T @ x + 1e-3 * np.diag([0.0] + [1.0] * 14), x.T @ y)
        sigma = math.sqrt(((y - x @ beta) ** 2).sum() / (len(y) - 1))
        for t, r in rows.items():
            want = float(np.dot(design(t, lo, hi), beta))
            assert r.yhat == pytest.approx(want, abs=2e-3) and t in range(hi + 1, hi + 31)
            assert r.yhat_upper - r.yhat == pytest.approx(1.2816 * sigma, abs=2e-3)


def test_fourier_follows_a_season(spark):
    true = lambda t: 500 + 0.3 * t + 80 * math.sin(2 * math.pi * t / 365.25)      # noqa: E731
    series = {"s": {t: round(true(t)) for t in range(1100)}}
    for r in FF.forecast_fourier(cube(spark, series)).collect():
        assert abs(r.yhat - true((r.ds - DAY0).days)) < 3


def test_least_squares(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(a), float(b), float(3 + 2 * a - b + rng.normal(0, 0.1))) for g in ("x", "y")
            for a, b in rng.normal(1e4, 1, (50, 2))]
    rows += [("same", 5.0, 5.0, float(i)) for i in range(4)] + [("one", 1.0, 2.0, 3.0), ("x", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double")
    sums = LS.normal_equations(df, ["g"], {"a": F.col("a"), "b": F.col("b")}, F.col("y"))
    got = {r.g: r for r in LS.solve(sums, ["g"]).collect()}
    for g in ("x", "y"):
        m = np.array([r[1:] for r in rows if r[0] == g and r[1] is not None])
        x = np.column_stack([np.ones(len(m)), m[:, :2] - m[:, :2].mean(0)])
        beta, sse = np.linalg.lstsq(x, m[:, 2], rcond=None)[:2]
        assert got[g].beta[1:] == pytest.approx(beta[1:].tolist(), rel=1e-4) and got[g].n == 50
        assert got[g].r2 == pytest.approx(1 - sse[0] / ((m[:, 2] - m[:, 2].mean()) ** 2).sum(), abs=1e-4)
    assert got["same"].beta is None and got["one"].beta is None      # no unique solution


def test_rolling_origins_against_refits(spark):
    rng = np.random.default_rng(4)
    series = {"a": {t: int(50 + t + rng.integers(0, 20)) for t in range(60) if t % 11}, "b": {0: 3, 1: 4}}
    got = {(r.product, r.ahead): r for r in backtest.rolling_origin_errors(cube(spark, series), 5, 10).collect()}
    ts, errors = sorted(series["a"]), {h: [] for h in range(1, 6)}
    for i, o in enumerate(ts):
        if i + 1 >= 10:
            b, a = np.polyfit(ts[:i + 1], [series["a"][t] for t in ts[:i + 1]], 1)
            for h in errors:
                if o + h in series["a"]:
                    errors[h].append((a + b * (o + h) - series["a"][o + h], series["a"][o + h]))
    assert set(got) == {("a", h) for h in errors}
    for h, es in errors.items():
        r = got[("a", h)]
        assert r.n == len(es) and r.mae == pytest.approx(np.mean([abs(e) for e, _ in es]), abs=1e-3)
        assert r.bias == pytest.approx(np.mean([e for e, _ in es]), abs=1e-3)
        assert r.share == pytest.approx(sum(abs(e) for e, _ in es) / sum(y for _, y in es), abs=1e-3)


def test_shapley_against_all_orders_and_its_sum(spark):
    rng = np.random.default_rng(6)
    rows = [(g, int(rng.integers(3)), int(rng.integers(2)), int(rng.integers(3)), float(rng.integers(0, 99)))
            for g in ("x", "y") for _ in range(80)]
    df = spark.createDataFrame(rows, "g string, a int, b int, c int, y double")
    out = SH.shapley(df, ["g"], ["a", "b", "c"], "y").collect()

    def worth(g, at, some):
        ys = [r[4] for r in rows if r[0] == g and all(r[1 + i] == at[i] for i in some)]
        return sum(ys) / len(ys)

    assert len(out) == len({r[:4] for r in rows}) and sum(r.n for r in out) == len(rows)
    for r in out:
        at, phi = (r.a, r.b, r.c), [0.0] * 3
        for order in itertools.permutations(range(3)):
            for i, x in enumerate(order):
                phi[x] += (worth(r.g, at, order[:i + 1]) - worth(r.g, at, order[:i])) / 6
        assert [r.phi_a, r.phi_b, r.phi_c] == pytest.approx(phi)
        assert r.phi_a + r.phi_b + r.phi_c == pytest.approx(r.mean - r.base)
