"""Walk-forward fits, backtests and pair verdicts against plain fits of every fold."""

import math

import numpy as np
import pandas as pd
import pytest

from shocklens import plans
from shocklens.operators import forecast
from shocklens.plans import prices as price_plans
from shocklens.sources import tables

plans.load()


def _plain_fold(x, forward, n, at, end, large):
    """Probabilities of rows at to end from the first n rows: own scaling, weights by Newton steps from nothing."""
    mean, spread = x[:n].mean(axis=0), x[:n].std(axis=0) + 1e-9
    z = np.hstack([np.ones((end, 1)), (x[:end] - mean) / spread])
    y = np.abs(forward[:end]) >= np.quantile(np.abs(forward[:n]), large) if large else forward[:end] > 0
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z[:n] @ w))
        hessian = (z[:n].T * (p * (1 - p))) @ z[:n] / n + 1e-3 * np.eye(len(w))
        w = w - np.linalg.inv(hessian) @ (z[:n].T @ (p - y[:n]) / n + 1e-3 * w)
    return 1 / (1 + np.exp(-z[at:end] @ w)), y[at:end], y[:n].mean() >= 0.5


def _plain(frame, horizon, least, large=None):
    out = {}
    for series, rows in frame.dropna(subset=[*forecast.FEATURES, "forward"]).groupby("series"):
        rows = rows.sort_values("date").reset_index(drop=True)
        x, forward = rows[list(forecast.FEATURES)].to_numpy(float), rows["forward"].to_numpy(float)
        for at in range(-(-least // 20) * 20, len(rows), 20):
            end = min(at + 20, len(rows))
            p, y, majority = _plain_fold(x, forward, at - horizon, at, end, large)
            out |= {(series, rows["date"][at + i]): (p[i], bool(y[i]), bool(majority)) for i in range(end - at)}
    return out


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    rows = []
    for s in ("a", "b", "short"):
        n = 40 if s == "short" else 420
        drift = np.sin(np.arange(n) / 9) * 0.004
        close = 100 * np.exp(np.cumsum(drift + rng.normal(size=n) * 0.01))
        rows += [(s, d.date(), float(p)) for d, p in zip(pd.bdate_range("2020-01-01", periods=n), close, strict=True)]
    return forecast.outlook_frame(spark.createDataFrame(rows, "series string, date date, price double").repartition(3), 5)


@pytest.mark.parametrize(("least", "large"), [(130, None), (201, 0.75)])
def test_walk_forward_equals_plain_fits(frame, least, large):
    got = {(r.series, r.date): (r.probability, r.actual, r.majority) for r in forecast.walk_forward(frame, 5, least=least, large=large).collect()}
    want = _plain(frame.toPandas(), 5, least, large)
    assert got.keys() == want.keys() and {k[0] for k in got} == {"a", "b"}
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 and got[k][1:] == want[k][1:] for k in want)


def test_rows_go_into_python_once(frame):
    plan = forecast.walk_forward(frame, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "Join" not in plan
    assert forecast.walk_forward(frame.limit(0), 5).count() == 0


def test_optimum_does_not_depend_on_the_start():
    rng = np.random.default_rng(1)
    x = np.hstack([np.ones((80, 1)), rng.normal(size=(80, 3))])
    for y in ((x[:, 1] > 0).astype(float), np.zeros(80), np.ones(80)):
        a, b = (forecast.logistic_optimum(x, y, start) for start in (np.zeros(4), np.array([3.0, -40, 9, 1])))
        assert np.abs(a - b).max() < 1e-6


@pytest.mark.parametrize(("name", "large"), [("dom_15_direction_walk_forward", None), ("dom_16_large_move_risk", 0.75)])
def test_registered_walk_forwards(spark, sf_dir, monkeypatch, name, large):
    frame = forecast.outlook_frame(tables.daily_prices(spark, sf_dir), 5).toPandas()
    want = _plain(frame, 5, 1500, large) if frame.groupby("series").size().max() > 1600 else None
    if want is None:
        # The smallest table has short series: the same query from an earlier row on.
        whole = forecast.walk_forward
        monkeypatch.setattr(forecast, "walk_forward", lambda f, h, least, large=None: whole(f, h, least=200, large=large))
        want = _plain(frame, 5, 200, large)
    got = {r.series: r for r in plans.QUERIES[name](spark, sf_dir).collect()}
    assert set(got) == {k[0] for k in want}
    for series, r in got.items():
        rows = [v for k, v in want.items() if k[0] == series]
        hit = [(p >= 0.5) == y for p, y, _ in rows]
        said = [y for p, y, _ in rows if p >= 0.5]
        assert r.n == len(rows) and r.accuracy == pytest.approx(np.mean(hit), abs=2e-6) and r.baseline == pytest.approx(np.mean([m == y for _, y, m in rows]), abs=2e-6)
        assert (r.precision is None) == (not said) and (not said or r.precision == pytest.approx(np.mean(said), abs=2e-6))


def test_outlook_backtest(spark, sf_dir):
    f = forecast.outlook_frame(tables.daily_prices(spark, sf_dir), 20).toPandas().sort_values(["series", "rn"])
    names = ["ret_5", "ret_10", "vol_20", "ma_distance"]
    hits: dict[str, list] = {"analog": [], "momentum": [], "random": []}
    for series, rows in f.groupby("series"):
        rows = rows.set_index("rn")
        able = [n for n in rows.index if n > 400 and not math.isnan(rows.forward[n])]
        k = len(able)
        chosen = [n for i, n in enumerate(able) if k <= 10 or math.floor((i + 1) * 10 / k - 1e-12) > math.floor(i * 10 / k - 1e-12)]
        for t in chosen:
            past = rows.loc[: t - 20].dropna(subset=names)
            spread = past[names].std(ddof=1)
            far = (((past[names] - rows.loc[t, names].astype(float)) / spread) ** 2).sum(axis=1)
            near = past.loc[sorted(past.index, key=lambda n: (far[n], n))[:25], "forward"].dropna()
            up = (near > 0).mean()
            draw = __import__("hashlib").md5(f"11|{series}|{t}".encode()).hexdigest()
            leans = {"analog": "up" if up > 0.5 else "down" if up < 0.5 else "flat", "momentum": "up" if rows.ret_10[t] > 0 else "down", "random": "up" if int(draw[:15], 16) % 2 == 0 else "down"}
            for m, lean in leans.items():
                if lean != "flat":
                    hits[m].append((lean == "up") == (rows.forward[t] > 0))
    got = {r.model: (r.n, r.hit_rate) for r in plans.QUERIES["dom_22_outlook_backtest"](spark, sf_dir).collect()}
    assert set(got) == {m for m, h in hits.items() if h}
    assert all(got[m][0] == len(hits[m]) and got[m][1] == pytest.approx(np.mean(hits[m]), abs=2e-6) for m in got)


def _tapered(terms, lags=12):
    n = len(terms)
    return sum((1 - abs(i - j) / (lags + 1)) * np.outer(terms[i], terms[j]) for i in range(n) for j in range(n) if abs(i - j) <= lags)


def _holm(p):
    known = sorted((v, k) for k, v in p.items() if v is not None)
    out, most = dict.fromkeys(p), 0.0
    for i, (v, k) in enumerate(known):
        most = max(most, min(1.0, (len(known) - i) * v))
        out[k] = most
    return out


def test_pair_verdicts(spark, sf_dir):
    pairs = price_plans._pairs(spark, sf_dir).toPandas().sort_values("month")
    fits, tests = {}, {}
    for key, rows in pairs.groupby(["target", "driver"]):
        x, y = rows["x"].to_numpy(float), rows["y"].to_numpy(float)
        lagged = np.array([[1.0, *(x[t - k] for k in range(13))] for t in range(12, len(y))])
        ok = ~(np.isnan(lagged).any(axis=1) | np.isnan(y[12:]))
        a, b = lagged[ok], y[12:][ok]
        beta = np.linalg.solve(a.T @ a, a.T @ b)
        rest = b - a @ beta
        inverse = np.linalg.inv(a.T @ a)
        cov = inverse @ _tapered(a * rest[:, None]) @ inverse * len(b) / (len(b) - 14)
        z = beta[1:].sum() / math.sqrt(cov[1:, 1:].sum())
        fits[key] = (len(b), beta[1:].sum(), math.erfc(abs(z) / math.sqrt(2)))
        base = np.array([[1.0, y[t - 1], y[t - 2], y[t - 3], x[t], x[t - 1], x[t - 2]] for t in range(3, len(y))])
        ok = ~(np.isnan(base).any(axis=1) | np.isnan(y[3:]))
        base, b = base[ok], y[3:][ok]
        if len(b) < 40 + 24:
            tests[key] = (None, None)
            continue
        miss = np.array([[b[t] - w[t] @ np.linalg.lstsq(w[:t], b[:t], rcond=None)[0] for w in (base[:, :4], base)] for t in range(40, len(b))])
        worse = miss[:, 0] ** 2 - miss[:, 1] ** 2
        m = len(worse)
        dm = worse.mean() / math.sqrt(_tapered((worse - worse.mean())[:, None])[0, 0] / m / m)
        rmse = np.sqrt((miss**2).mean(axis=0))
        tests[key] = (0.5 * math.erfc(dm / math.sqrt(2)), 100 * (1 - rmse[1] / rmse[0]))
    fit_p, test_p = _holm({k: v[2] for k, v in fits.items()}), _holm({k: v[0] for k, v in tests.items()})
    got = plans.QUERIES["dom_19_pair_verdicts"](spark, sf_dir).collect()
    assert len(got) == len(fits) > 0
    for r in got:
        key = (r.target, r.driver)
        moves, helps, up = fit_p[key] < 0.05, (test_p[key] or 1.0) < 0.05, fits[key][1] > 0
        assert r.n == fits[key][0] and r.sum_beta == pytest.approx(fits[key][1], abs=2e-6) and r.holm_p == pytest.approx(fit_p[key], abs=2e-6)
        if test_p[key] is None:
            assert r.test_p is None and r.improvement_pct is None
            helps = False
        else:
            assert r.test_p == pytest.approx(test_p[key], abs=2e-6) and r.improvement_pct == pytest.approx(tests[key][1], abs=2e-5)
        assert r.verdict == ("passes through and helps the estimate" if moves and helps and up else "passes through" if moves and up else "moves the other way" if moves else "no link shown")
