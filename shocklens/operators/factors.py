"""What is left of a move after market factors, and over which currency it survives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shocklens.functions.numbers import by_series, guarded, ratio

WINDOW = 75
LEAST = 40
CUMULATIVE = 10


def rolling_fit(rows: DataFrame, names: tuple[str, str, str], window: int = WINDOW, least: int = LEAST, prefix: str = "") -> DataFrame:
    """Adds factor_explained, residual, residual_z and window_r2 of a three-factor fit on the rows before each.

    ``rows`` has series, date, y and the factors, complete cases only. The fit
    comes from windowed means and covariances by Cramer's rule, so no row is
    sent to Python. A singular window has no fit (null).
    """
    frame = by_series().rowsBetween(-window, -1)
    seen = F.count("y").over(frame)

    def cov(a: str, b: str) -> Column:
        return F.covar_samp(a, b).over(frame)

    cols = {f"_m{i}": F.avg(n).over(frame) for i, n in enumerate(("y", *names))}
    cols |= {f"_c{i}{j}": cov(names[i], names[j]) for i in range(3) for j in range(i, 3)}
    cols |= {f"_y{i}": cov("y", names[i]) for i in range(3)} | {"_yy": F.var_samp("y").over(frame), "_n": seen}
    df = rows.withColumns(cols)
    c = [[F.col(f"_c{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    y = [F.col(f"_y{i}") for i in range(3)]

    def det(m: list[list[Column]]) -> Column:
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    whole = det(c)
    usable = F.when((F.col("_n") >= least) & (F.abs(whole) > 1e-12 * F.abs(c[0][0] * c[1][1] * c[2][2])), whole)
    df = df.withColumns({f"_b{k}": ratio(det([[y[i] if j == k else c[i][j] for j in range(3)] for i in range(3)]), usable) for k in range(3)})
    fit = F.col("_m0")
    for k, n in enumerate(names):
        fit = fit + F.col(f"_b{k}") * (F.col(n) - F.col(f"_m{k + 1}"))
    left = F.col("_yy") - sum((F.col(f"_b{k}") * y[k] for k in range(1, 3)), F.col("_b0") * y[0])
    df = df.withColumns({f"{prefix}factor_explained": fit, f"{prefix}residual": F.col("y") - fit, "_var": F.greatest(left, F.lit(0.0))})
    # Below this share of the variance nothing but rounding is left.
    real = F.when(F.col("_var") > 1e-14 * F.col("_yy"), F.col("_var"))
    df = df.withColumns({f"{prefix}residual_z": ratio(f"{prefix}residual", F.sqrt(real)), f"{prefix}window_r2": 1 - ratio("_var", F.when(F.col("_b0").isNotNull() & (F.col("_yy") > 0), F.col("_yy")))})
    return df.drop(*[x for x in df.columns if x.startswith("_")])


def cumulated(rows: DataFrame, names: tuple[str, ...], days: int = CUMULATIVE) -> DataFrame:
    """y and the factors as sums over the last ``days`` rows, full sums only."""
    frame = by_series().rowsBetween(-(days - 1), 0)
    return rows.withColumns({n: guarded(F.sum(n), n, frame, days) for n in ("y", *names)}).dropna(subset=["y", *names])


def factor_class(kind: str, residual_z: str, cumulative_z: str, threshold: float = 2.0) -> Column:
    """A shock is judged by the daily residual, a trend by the cumulative one."""
    z = F.when(F.contains(F.col(kind), F.lit("shock")), F.col(residual_z)).when(F.contains(F.col(kind), F.lit("trend")), F.col(cumulative_z))
    judged = F.when(F.abs(z) >= threshold, "commodity-specific").when(z.isNotNull(), "macro-driven").otherwise("unclassified")
    return F.when(F.coalesce(F.col(kind), F.lit("")) == "", "").otherwise(judged)


def factor_adjusted(detected: DataFrame, rows: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """Detections with daily and cumulative residuals and the class of each flagged day; switch days are not judged."""
    daily = rolling_fit(rows, names).select("series", "date", "residual", "residual_z", "window_r2")
    built = rolling_fit(cumulated(rows, names), names, prefix="cum_").select("series", "date", "cum_residual", "cum_residual_z")
    joined = detected.join(daily, ["series", "date"], "left").join(built, ["series", "date"], "left")
    joined = joined.withColumns({n: F.when(~F.col("contract_switch"), F.col(n)) for n in ("residual", "residual_z", "window_r2", "cum_residual", "cum_residual_z")})
    return joined.withColumn("factor_class", factor_class("anomaly_type", "residual_z", "cum_residual_z"))


def class_counts(adjusted: DataFrame) -> DataFrame:
    """Flagged days by class, the macro share of the judged, median R2 over all days and over flagged ones."""
    flagged = F.col("anomaly_flag")
    out = adjusted.groupBy("series").agg(
        F.count_if(flagged).alias("flagged"), F.count_if(flagged & (F.col("factor_class") == "macro-driven")).alias("macro"), F.count_if(flagged & (F.col("factor_class") == "commodity-specific")).alias("specific"),
        F.count_if(flagged & (F.col("factor_class") == "unclassified")).alias("unclassified"), F.median("window_r2").alias("median_r2_all"), F.median(F.when(flagged, F.col("window_r2"))).alias("median_r2_flagged"))
    return out.withColumn("share_macro", ratio("macro", F.col("macro") + F.col("specific")))


def rolling_beta(rows: DataFrame, y: str = "y", x: str = "x", window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """Slope and R2 of y on x over up to ``window`` rows before each, at least ``least``."""
    frame = by_series().rowsBetween(-window, -1)
    enough = F.regr_count(y, x).over(frame) >= least
    return rows.withColumns({"beta": F.when(enough, F.regr_slope(y, x).over(frame)), "beta_r2": F.when(enough, F.regr_r2(y, x).over(frame))})


def survival(moves: DataFrame) -> DataFrame:
    """How much of a dollar move is left in other currencies: their median over it, with a reading."""
    days = moves.groupBy("series", "date").agg(F.max("y").alias("dollar_move"), F.median(F.col("y") + F.col("fx_return")).alias("median_move"), F.count(F.lit(1)).alias("currencies"))
    share = ratio("median_move", "dollar_move")
    reading = F.when(share >= 0.80, "own move").when(share <= 0.35, "dollar move").when(share.isNotNull(), "mixed")
    return days.withColumns({"survival": share, "reading": reading})


def flagged_numeraire(moves: DataFrame, detected: DataFrame) -> DataFrame:
    """Survival of all flagged days that are no contract switch, as one plan."""
    chosen = detected.where(F.col("anomaly_flag") & ~F.col("contract_switch")).select("series", "date", "anomaly_type")
    return survival(moves).join(chosen, ["series", "date"])


def cross_verdicts(flags: DataFrame, least: int = 2) -> DataFrame:
    """For each flagged day: other series flagged and judged, macro-wide if at least ``least`` were flagged too."""
    w = Window.partitionBy("date")
    others = F.coalesce(F.sum(F.col("flag").cast("int")).over(w), F.lit(0)) - F.col("flag").cast("int")
    judged = F.count("flag").over(w) - 1
    rows = flags.withColumns({"others_flagged": others, "others_judged": judged}).where("flag")
    verdict = F.when(F.col("others_judged") < least, "unclassified").when(F.col("others_flagged") >= least, "macro").otherwise("specific")
    return rows.withColumn("verdict", verdict)
