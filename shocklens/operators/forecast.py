"""Walk-forward classifiers and their scoring: one ordered pass over each series, in which every fold starts from the one before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shocklens.functions.numbers import by_series, guarded, ratio
from shocklens.operators.detect import change

BLOCK, RIDGE = 20, 1e-3
FEATURES = ("ret_1", "ret_5", "ret_10", "vol_20", "ma_distance", "price_z")


def outlook_frame(prices: DataFrame, horizon: int, weather: DataFrame | None = None) -> DataFrame:
    """Price features, forward return and row number; dryness, carried forward, where it covers over half of a series' rows."""
    w = by_series()
    last20, last75 = w.rowsBetween(-19, 0), w.rowsBetween(-74, 0)
    df = prices.withColumns({f"ret_{n}": change("price", n) for n in (1, 5, 10)})
    df = df.withColumns({
        "vol_20": guarded(F.stddev_samp("ret_1"), "ret_1", last20, 20),
        "ma_distance": ratio("price", guarded(F.avg("price"), "price", last20, 20)) - 1,
        "price_z": ratio(F.col("price") - guarded(F.avg("price"), "price", last75, 75), guarded(F.stddev_samp("price"), "price", last75, 75) + 1e-9),
        "forward": ratio(F.lead("price", horizon).over(w), "price") - 1,
        "rn": F.row_number().over(w),
    })
    if weather is None:
        return df
    joined = df.join(weather.select("date", "dryness_z"), "date", "left")
    covered = F.avg(F.col("dryness_z").isNotNull().cast("double")).over(Window.partitionBy("series")) > 0.5
    return joined.withColumn("dryness_z", F.when(covered, F.last("dryness_z", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))))


def logistic_optimum(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float = RIDGE, rounds: int = 50) -> np.ndarray:
    """Weights of least mean logistic loss plus ridge / 2 times their square, by Newton steps from ``start``.

    The loss is strictly convex, so the weights do not depend on the start; a
    near one saves steps. A step that does not lower the loss is halved.
    """
    def loss(w: np.ndarray) -> float:
        t = x @ w
        return float(np.mean(np.logaddexp(0, t) - y * t) + ridge / 2 * w @ w)

    w, now = start, loss(start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - y) / len(y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w)), slope)
        size = 1.0
        while (after := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if after > now:
            break
        w, now = w - size * step, after
        if np.abs(size * step).max() < 1e-10:
            break
    return w


def _walk(x: np.ndarray, forward: np.ndarray, horizon: int, least: int, large: float | None) -> list[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, end, probability, actual, majority) of each block from row ``least`` on.

    Means and spreads of a fold's training rows, which are all rows up to one,
    come from running sums.
    """
    centre = x.mean(axis=0)
    sums, squares = np.cumsum(x - centre, axis=0), np.cumsum((x - centre) ** 2, axis=0)
    size, out, weights = np.abs(forward), [], np.zeros(x.shape[1] + 1)
    for at in range(-(-least // BLOCK) * BLOCK, len(x), BLOCK):
        end, n = min(at + BLOCK, len(x)), at - horizon
        if n < 1:
            continue
        mean = sums[n - 1] / n
        spread = np.sqrt(np.maximum(squares[n - 1] / n - mean * mean, 0)) + 1e-9
        scaled = np.column_stack([np.ones(end), (x[:end] - centre - mean) / spread])
        y = (size[:end] >= np.quantile(size[:n], large)) if large is not None else forward[:end] > 0
        weights = logistic_optimum(scaled[:n], y[:n].astype(float), weights)
        p = 1 / (1 + np.exp(-np.clip(scaled[at:end] @ weights, -500, 500)))
        out.append((at, end, p, y[at:end], bool(y[:n].mean() >= 0.5)))
    return out


def walk_forward(frame: DataFrame, horizon: int, features: tuple[str, ...] = FEATURES, least: int = 250, large: float | None = None) -> DataFrame:
    """Probability for each row of each block of ``BLOCK`` rows, learned from rows at least ``horizon`` before the block.

    Target: the forward return is positive, or with ``large`` its size is at
    or above that quantile of the training rows. Every row of a series goes to
    its task once; the calendar bounds their number.
    """
    rows = frame.dropna(subset=[*features, "forward"]).select("series", "date", "forward", *features)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        blocks = _walk(pdf[list(features)].to_numpy(float), pdf["forward"].to_numpy(float), horizon, least, large)
        dates = pdf["date"].to_numpy()
        parts = [pd.DataFrame({"series": key[0], "fold": at // BLOCK, "date": dates[at:end], "probability": p, "actual": actual, "majority": majority}) for at, end, p, actual, majority in blocks]
        return pd.concat(parts) if parts else pdf.iloc[:0][["series", "date"]].assign(fold=0, probability=0.0, actual=False, majority=False)

    return rows.groupBy("series").applyInPandas(fit, "series string, fold long, date date, probability double, actual boolean, majority boolean")


def walk_scores(predicted: DataFrame) -> DataFrame:
    """Accuracy beside the majority answer, and precision, recall and lift of the positive answers."""
    hit = F.col("probability") >= 0.5
    out = predicted.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.avg((hit == F.col("actual")).cast("double")).alias("accuracy"), F.avg((F.col("majority") == F.col("actual")).cast("double")).alias("baseline"),
        F.avg(F.col("actual").cast("double")).alias("base_rate"), F.avg(F.when(hit, F.col("actual").cast("double"))).alias("precision"), F.avg(F.when(F.col("actual"), hit.cast("double"))).alias("recall"))
    return out.withColumn("lift", ratio("precision", "base_rate"))


def lean_scores(leans: DataFrame) -> DataFrame:
    """Hit rates of named leans (columns of up/down texts) against the forward return's sign."""
    names = [c for c in leans.columns if c.startswith("lean_")]
    pairs = ", ".join(f"'{n[5:]}', {n}" for n in names)
    long = leans.selectExpr("forward", f"stack({len(names)}, {pairs}) AS (model, lean)").where("lean IN ('up', 'down') AND forward IS NOT NULL")
    hit = (F.col("lean") == "up") == (F.col("forward") > 0)
    return long.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("hit_rate"))
