"""Safe arithmetic and statistics as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b; null where b is zero or either is missing."""
    return F.try_divide(col(a), col(b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it, also inside its lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean(x: str | Column) -> Column:
    """NaN and infinities to null, so that comparisons and aggregates skip them."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def by_series(series: str = "series", date: str = "date") -> WindowSpec:
    return Window.partitionBy(series).orderBy(date)


def guarded(agg: Column, over: str | Column, frame: WindowSpec, least: int) -> Column:
    """A windowed aggregate, null unless the frame holds ``least`` values."""
    return F.when(F.count(col(over)).over(frame) >= least, agg.over(frame))


def interval_95(k: str | Column, n: str | Column) -> tuple[Column, Column]:
    """Wilson bounds of k out of n in percent, one decimal; null at n = 0."""
    z2 = 1.96 * 1.96
    n = F.when(col(n) > 0, col(n).cast("double"))
    p = col(k) / n
    centre, scale = p + z2 / (2 * n), 1 + z2 / n
    half = F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) * 1.96
    return tuple(F.when(n.isNotNull(), F.round(100 * F.least(F.greatest((centre + sign * half) / scale, F.lit(0.0)), F.lit(1.0)), 1)) for sign in (-1, 1))


def rate(k: str | Column, n: str | Column) -> Column:
    """struct(k, n, pct, lo, hi), the one shape of every rate."""
    lo, hi = interval_95(k, n)
    pct = F.when(col(n) > 0, F.round(100 * col(k) / col(n), 1))
    return F.struct(col(k).alias("k"), col(n).alias("n"), pct.alias("pct"), lo.alias("lo"), hi.alias("hi"))


def erfc(x: Column) -> Column:
    """Complementary error function by a Chebyshev-type fit, relative error below 1.2e-7."""
    t = 1 / (1 + 0.5 * F.abs(x))
    # Published coefficients of the fit, from the constant upwards.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    power = F.lit(fit[-1])
    for c in fit[-2::-1]:
        power = power * t + c
    y = t * F.exp(-x * x + power)
    return F.when(x >= 0, y).otherwise(2 - y)


def two_sided_p(z: str | Column) -> Column:
    return erfc(F.abs(col(z)) / F.sqrt(F.lit(2.0)))


def one_sided_p(z: str | Column) -> Column:
    return 0.5 * erfc(col(z) / F.sqrt(F.lit(2.0)))


def holm(p: str, *keys: str) -> Column:
    """Holm-adjusted p within the keys (of few rows each); null stays null and is not counted."""
    whole = Window.partitionBy(*keys)
    ranked = whole.orderBy(F.col(p).asc_nulls_last())
    step = F.least(F.lit(1.0), (F.count(p).over(whole) - F.row_number().over(ranked) + 1) * F.col(p))
    return step


def draw(seed: int, *of: str | Column) -> Column:
    """A whole number of 60 bits that seed and values fix, the same in every engine: the head of an MD5."""
    named = F.concat_ws("|", F.lit(str(seed)), *[col(x).cast("string") for x in of])
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def sample_kurtosis(x: str | Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values or without spread."""
    n = F.count(col(x)).cast("double")
    return F.when((n > 3) & (F.var_pop(col(x)) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(x)) + 6))
