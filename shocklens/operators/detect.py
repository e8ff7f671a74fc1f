"""Unusual days of daily price series: returns, trailing baselines, flags, and what follows a flag.

Every table has series, date and price; rows are a series' sessions in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shocklens.functions.numbers import by_series, guarded, ratio, sample_kurtosis

WINDOW = 75
THRESHOLD = 2.0
CUMULATIVE = 10
GAP = 3
LOOK_AHEAD = 120
LEAST_MOVE_PCT = 1.0


def change(price: str, n: int = 1) -> Column:
    """price / price n rows before - 1."""
    return ratio(price, F.lag(price, n).over(by_series())) - 1


def log_change(price: str, n: int = 1) -> Column:
    """Difference of logs; null where either end is not positive."""
    level = F.when(F.col(price) > 0, F.ln(price))
    return level - F.lag(level, n).over(by_series())


def back_adjusted(prices: DataFrame, switches: DataFrame) -> DataFrame:
    """``prices`` with basis and contract_switch: earlier prices scaled so that each listed day moves as reported.

    ``switches`` has series, date and reported (a fraction); other days keep their moves.
    """
    w = by_series()
    later = w.rowsBetween(1, Window.unboundedFollowing)
    joined = prices.join(F.broadcast(switches.select("series", "date", "reported")), ["series", "date"], "left")
    jump = ratio("price", F.lag("price").over(w)) / (1 + F.col("reported"))
    joined = joined.withColumn("_jump", F.when(F.col("reported").isNotNull(), jump))
    size = F.exp(F.coalesce(F.sum(F.ln(F.abs("_jump"))).over(later), F.lit(0.0)))
    odd = F.coalesce(F.sum(F.when(F.col("_jump") < 0, 1).otherwise(0)).over(later), F.lit(0)) % 2 == 1
    factor = F.when(odd, -size).otherwise(size)
    return joined.withColumns({"basis": F.col("price") * factor, "contract_switch": F.col("reported").isNotNull()}).drop("_jump", "reported")


def detections(prices: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD, cumulative: int = CUMULATIVE, basis: str = "price") -> DataFrame:
    """Daily and cumulative z against the ``window`` rows before each day, both flags and the type."""
    before = by_series().rowsBetween(-window, -1)
    df = prices.withColumns({"return_pct": change(basis), "cumulative_return": change(basis, cumulative)})
    for name, x in (("", "return_pct"), ("cumulative_", "cumulative_return")):
        df = df.withColumns({f"{name}expected_value": guarded(F.avg(x), x, before, window), f"{name}rolling_std": guarded(F.stddev_samp(x), x, before, window)})
        gap = F.col(x) - F.col(f"{name}expected_value")
        # Over a flat stretch any move is infinitely unusual; no move has no z.
        z = F.when(F.col(f"{name}rolling_std") == 0, F.when(gap != 0, F.signum(gap) * float("inf"))).otherwise(ratio(gap, f"{name}rolling_std"))
        df = df.withColumn(f"{name}z_score", z)
    daily, built = (F.coalesce(F.abs(z) >= threshold, F.lit(False)) for z in ("z_score", "cumulative_z_score"))
    kind = F.when(daily & built, "shock+trend").when(daily, "shock").when(built, "trend").otherwise("")
    df = df.withColumns({"daily_anomaly_flag": daily, "cumulative_anomaly_flag": built, "anomaly_flag": daily | built, "anomaly_type": kind})
    return df if "contract_switch" in df.columns else df.withColumn("contract_switch", F.lit(False))


def usable(df: DataFrame) -> DataFrame:
    """Adds usable: both ends positive, no contract switch, move and z known."""
    before = F.lag("price").over(by_series())
    ok = (F.col("price") > 0) & (before > 0) & ~F.coalesce("contract_switch", F.lit(False)) & F.col("return_pct").isNotNull() & F.col("z_score").isNotNull()
    return df.withColumn("usable", F.coalesce(ok, F.lit(False)))


def move_record(df: DataFrame) -> DataFrame:
    """Percent moves defined only between positive prices, direction by the check that fired, and a text."""
    w = by_series()
    defined = (F.col("price") > 0) & (F.lag("price").over(w) > 0)
    leading = F.when(F.col("anomaly_type") == "trend", F.col("cumulative_z_score")).otherwise(F.col("z_score"))
    direction = F.when(leading > 0, "up").when(leading < 0, "down")
    df = df.withColumns({
        "price_is_usable": F.coalesce(defined, F.lit(False)),
        "pct_move": F.when(defined, 100 * F.col("return_pct")),
        "cumulative_pct": 100 * F.col("cumulative_return"),
    })
    text = F.when(F.col("anomaly_type") == "shock", F.format_string("%+.1f%% on the day", "pct_move")).when(F.col("anomaly_type") == "trend", F.format_string("%+.1f%% over ten sessions", "cumulative_pct")).when(
        F.col("anomaly_type") == "shock+trend", F.format_string("%+.1f%% on the day, %+.1f%% over ten sessions", "pct_move", "cumulative_pct"))
    return df.withColumns({"direction": F.when(F.col("price_is_usable"), direction), "description": text})


def rolled(prices: DataFrame) -> DataFrame:
    """Volatility, distance from averages, forward moves and look-back changes."""
    w = by_series()
    last20, last75, next20 = w.rowsBetween(-19, 0), w.rowsBetween(-74, 0), w.rowsBetween(1, 20)
    df = prices.withColumns({"ret": change("price"), "log_ret": log_change("price")})
    return df.withColumns({
        "volatility_20": guarded(F.stddev_samp("ret"), "ret", last20, 20),
        "ma_distance": ratio("price", guarded(F.avg("price"), "price", last20, 20)) - 1,
        "price_z": ratio(F.col("price") - guarded(F.avg("price"), "price", last75, 75), guarded(F.stddev_samp("price"), "price", last75, 75) + 1e-9),
        "forward_5": ratio(F.lead("price", 5).over(w), "price") - 1,
        "forward_vol": guarded(F.stddev_samp("log_ret"), "log_ret", next20, 20),
        "week_change": ratio("price", F.lag("price", 5).over(w)) - 1,
        "month_change": ratio("price", F.lag("price", 20).over(w)) - 1,
        "persistence": F.lag("price").over(w),
        "ma_forecast": guarded(F.avg("price"), "price", w.rowsBetween(-20, -1), 20),
    })


def first_passage(df: DataFrame, chosen: Column, look_ahead: int = LOOK_AHEAD, least_pct: float = LEAST_MOVE_PCT) -> DataFrame:
    """For each chosen row: rows until half of its move is given back, null if never within ``look_ahead``.

    Only chosen rows meet their following rows; a row with none after it is left out.
    """
    w = by_series()
    rows = df.withColumns({"_rn": F.row_number().over(w), "_before": F.lag("price").over(w), "_chosen": chosen, "_move": 100 * change("price")})
    start = rows.where(F.col("_chosen") & (F.abs("_move") >= least_pct)).select("series", "date", F.col("_rn").alias("_i"), "_move", (F.col("_before") * (1 + F.col("_move") / 200)).alias("_target"))
    # An equi-join on series and on a block of rows; a chosen row meets the blocks its look-ahead touches.
    start = start.withColumn("_block", F.explode(F.sequence(F.floor((F.col("_i") + 1) / look_ahead), F.floor((F.col("_i") + look_ahead) / look_ahead))))
    ahead = rows.select("series", F.col("price").alias("_p"), F.col("_rn").alias("_j"), F.floor(F.col("_rn") / look_ahead).alias("_block"))
    met = start.join(ahead, ["series", "_block"]).where(F.col("_j").between(F.col("_i") + 1, F.col("_i") + look_ahead))
    back = F.when(F.col("_move") > 0, F.col("_p") <= F.col("_target")).otherwise(F.col("_p") >= F.col("_target"))
    return met.groupBy("series", "date").agg(F.min(F.when(back, F.col("_j") - F.col("_i"))).alias("days"))


def half_life(passages: DataFrame) -> DataFrame:
    """Retraced, never retraced, and quartiles of the days it took."""
    q = F.percentile("days", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = passages.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count("days").alias("retraced"), q.alias("_q"))
    return out.select("series", "n", "retraced", (F.col("n") - F.col("retraced")).alias("never_retraced"), ratio(F.col("n") - F.col("retraced"), "n").alias("share_never"), F.col("_q")[1].alias("median_days"), F.col("_q")[0].alias("q1_days"), F.col("_q")[2].alias("q3_days"))


def episodes(df: DataFrame, flag: str = "anomaly_flag", gap: int = GAP) -> DataFrame:
    """Runs of flagged rows, merged where at most ``gap`` rows apart."""
    w = by_series()
    flagged = df.withColumn("_rn", F.row_number().over(w)).where(F.col(flag))
    new = F.coalesce(F.col("_rn") - F.lag("_rn").over(w) > gap, F.lit(True))
    numbered = flagged.withColumn("_new", new.cast("int")).withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("series", "episode").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("flagged"), (F.max("_rn") - F.min("_rn") + 1).alias("rows"))


def near_flag(df: DataFrame, reach: int = 5) -> DataFrame:
    """Adds near_flag: a flag within ``reach`` rows on either side."""
    return df.withColumn("near_flag", F.max(F.col("anomaly_flag")).over(by_series().rowsBetween(-reach, reach)))


def calibration(df: DataFrame) -> DataFrame:
    """The z that fires on 5, 2 and 1 % of the days, the share at 2, and the excess kurtosis."""
    z = F.when(F.abs("z_score") < float("inf"), F.col("z_score"))
    q = F.percentile(F.abs(z), F.array(F.lit(0.95), F.lit(0.98), F.lit(0.99)))
    out = df.groupBy("series").agg(F.avg((F.abs(z) >= 2).cast("double")).alias("measured_at_2"), sample_kurtosis(z).alias("excess_kurtosis"), q.alias("_q"))
    return out.select("series", "measured_at_2", "excess_kurtosis", *(F.col("_q")[i].alias(n) for i, n in enumerate(("z_for_05", "z_for_02", "z_for_01"))))


def latest_streak(df: DataFrame, lean: str) -> DataFrame:
    """Length, first and last day of each series' newest run of equal leans."""
    w = by_series()
    turned = df.withColumn("_new", (~F.col(lean).eqNullSafe(F.lag(lean).over(w))).cast("int"))
    runs = turned.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy("series", "_run").agg(F.first(lean).alias("lean"), F.count(F.lit(1)).alias("length"), F.min("date").alias("since"), F.max("date").alias("until"))
    return each.groupBy("series").agg(F.max_by(F.struct("lean", "length", "since", "until"), "_run").alias("_r")).select("series", "_r.*")
