"""Monthly series: changes without bridging, lag frames, pass-through and nowcast fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shocklens.functions.numbers import holm, ratio

LAGS = 13
HAC_LAGS = 12
LEAST_ROWS = 40


def month_means(prices: DataFrame, keys: list[str]) -> DataFrame:
    """Monthly means; the last month only if its last calendar day is there."""
    months = prices.groupBy(*keys, F.trunc("date", "MM").alias("month")).agg(F.avg("price").alias("value"), F.max("date").alias("_last"))
    whole = months.withColumn("_newest", F.max("month").over(Window.partitionBy(*keys)))
    return whole.where((F.col("month") != F.col("_newest")) | (F.col("_last") == F.last_day("month"))).drop("_last", "_newest")


def month_spine(months: DataFrame, keys: list[str]) -> DataFrame:
    """Every month from a key's first to its last; missing ones stay null."""
    ends = months.groupBy(*keys).agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    spine = ends.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return spine.join(months, [*keys, "month"], "left")


def month_changes(spine: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Log change, year on year and three months annualised; nothing bridges a missing month."""
    w = Window.partitionBy(*keys).orderBy("month")
    level = F.when(F.col(value) > 0, F.col(value))
    near = F.datediff("month", F.lag("month", 3).over(w)) < 100
    return spine.withColumns({
        "log_change": F.ln(level) - F.ln(F.lag(level).over(w)),
        "year_on_year": 100 * (ratio(value, F.lag(value, 12).over(w)) - 1),
        "annualised_3m": F.when(near, (F.pow(ratio(value, F.lag(value, 3).over(w)), 4) - 1) * 100),
    })


def lag_frame(changes: DataFrame, keys: list[str], x_lags: list[int], y_lags: list[int] = ()) -> DataFrame:
    """y with lags of y and x; complete cases only."""
    w = Window.partitionBy(*keys).orderBy("month")
    cols = {f"y_l{k}": F.lag("y", k).over(w) for k in y_lags} | {f"x_l{k}": F.lag("x", k).over(w) for k in x_lags}
    return changes.withColumns(cols).dropna(subset=["y", *cols])


def pair_frame(changes: DataFrame, targets: list[str], drivers: list[str]) -> DataFrame:
    """(target, driver, month, y, x) for every pair of two stated short lists."""
    y = changes.where(F.col("series").isin(*targets)).select(F.col("series").alias("target"), "month", F.col("log_change").alias("y"))
    x = changes.where(F.col("series").isin(*drivers)).select(F.col("series").alias("driver"), "month", F.col("log_change").alias("x"))
    return y.join(x, "month").where("target <> driver")


def _least_squares(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return beta, y - x @ beta


def _tapered(terms: np.ndarray, lags: int) -> np.ndarray:
    """Sum of autocovariances with linearly falling weights."""
    total = terms.T @ terms
    for k in range(1, min(lags, len(terms) - 1) + 1):
        cross = terms[k:].T @ terms[:-k]
        total = total + (1 - k / (lags + 1)) * (cross + cross.T)
    return total


def _seasons(months: pd.Series) -> np.ndarray:
    numbers = pd.to_datetime(months).dt.month.to_numpy()
    return (numbers[:, None] == np.arange(2, 13)).astype(float)


def pass_through(pairs: DataFrame, lags: int = LAGS, seasonal: bool = False) -> DataFrame:
    """Distributed-lag fit of each pair with autocorrelation-robust errors; p and Holm-corrected p.

    One pair's months, bounded by the calendar, are one group.
    """
    names = [f"x_l{k}" for k in range(lags)]

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("month")
        n = len(rows)
        if n < LEAST_ROWS:
            return pd.DataFrame([(*key, n, None, None, None, None, None)])
        x = np.hstack([np.ones((n, 1)), rows[names].to_numpy(float), *([_seasons(rows["month"])] if seasonal else [])])
        y = rows["y"].to_numpy(float)
        beta, rest = _least_squares(y, x)
        inverse = np.linalg.pinv(x.T @ x)
        cov = inverse @ _tapered(x * rest[:, None], HAC_LAGS) @ inverse * n / max(n - x.shape[1], 1)
        own = slice(1, 1 + lags)
        se = math.sqrt(max(cov[own, own].sum(), 0.0))
        z = beta[own].sum() / se if se > 0 else None
        spread = ((y - y.mean()) ** 2).sum()
        return pd.DataFrame([(*key, n, beta[own].sum(), z, math.erfc(abs(z) / math.sqrt(2)) if z is not None else None, 1 - rest @ rest / spread if spread > 0 else 0.0, beta[1:5].sum())])

    frame = lag_frame(pairs, ["target", "driver"], list(range(lags)))
    fitted = frame.groupBy("target", "driver").applyInPandas(fit, "target string, driver string, n long, sum_beta double, z double, p double, r2 double, early_beta double")
    # One row for each pair of the stated lists.
    return holm_by_step(fitted, "p")


def holm_by_step(df: DataFrame, p: str, *keys: str) -> DataFrame:
    """Adds holm_p: the running largest of the stepwise products, capped at 1, null kept."""
    keys = keys or ("_all",)
    df = df.withColumn("_all", F.lit(1)).withColumn("_step", holm(p, *keys))
    run = Window.partitionBy(*keys).orderBy(F.col(p).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("holm_p", F.when(F.col(p).isNotNull(), F.max("_step").over(run))).drop("_step", "_all")


def nowcast(pairs: DataFrame, least_train: int, ar: tuple[int, ...] = (1, 2, 3), x_lags: tuple[int, ...] = (0, 1, 2), seasonal: bool = False) -> DataFrame:
    """Each month estimated from earlier months only, with and without the driver; errors and a comparison of the two."""
    y_names, x_names = [f"y_l{k}" for k in ar], [f"x_l{k}" for k in x_lags]

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("month")
        n = len(rows)
        if n < least_train + 24:
            return pd.DataFrame([(*key, 0, None, None, None, None, None)])
        y = rows["y"].to_numpy(float)
        base = np.hstack([np.ones((n, 1)), rows[y_names].to_numpy(float), *([_seasons(rows["month"])] if seasonal else [])])
        full = np.hstack([base, rows[x_names].to_numpy(float)])
        miss = np.array([[y[t] - x[t] @ _least_squares(y[:t], x[:t])[0] for x in (base, full)] for t in range(least_train, n)])
        worse = miss[:, 0] ** 2 - miss[:, 1] ** 2
        m = len(worse)
        long_run = float(_tapered((worse - worse.mean())[:, None], HAC_LAGS)[0, 0]) / m
        dm = worse.mean() / math.sqrt(long_run / m) if long_run > 0 else None
        a, b = np.sqrt((miss**2).mean(axis=0))
        return pd.DataFrame([(*key, m, a, b, 100 * (1 - b / a) if a > 0 else 0.0, dm, 0.5 * math.erfc(dm / math.sqrt(2)) if dm is not None else None)])

    frame = lag_frame(pairs, ["target", "driver"], list(x_lags), list(ar))
    return frame.groupBy("target", "driver").applyInPandas(walk, "target string, driver string, n_test long, rmse_baseline double, rmse_model double, improvement_pct double, dm double, p double")


def pass_through_verdict(fit_p: str, test_p: str, sum_beta: str, level: float = 0.05):
    """Verdict words from the two corrected p-values and the sign."""
    moves, helps = F.col(fit_p) < level, F.col(test_p) < level
    return F.when(F.col(fit_p).isNull(), "too short").when(moves & helps & (F.col(sum_beta) > 0), "passes through and helps the estimate").when(moves & (F.col(sum_beta) > 0), "passes through").when(moves, "moves the other way").otherwise("no link shown")
