"""Queries over daily series: windows, joins, factors, months, outlooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shocklens.functions import dates
from shocklens.functions.numbers import by_series, draw, ratio
from shocklens.operators import brief, detect, evaluate, factors, forecast, joins, monthly, rank
from shocklens.plans import BY, CONTROL, DETECTED, EVENTS, EVENTS_SQL, LINES, PRICES, RETURNS, query
from shocklens.sources import tables

FACTORS = ("f_market", "f_dollar", "f_broad")


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detections(tables.daily_prices(spark, sf_dir))


def events_dim(spark: SparkSession, prices: DataFrame) -> DataFrame:
    fixed = spark.createDataFrame(EVENTS, "label string, start string, end string").select("label", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return prices.select("series").distinct().crossJoin(F.broadcast(fixed))


def control_dim(prices: DataFrame) -> DataFrame:
    return prices.select("series").distinct().select("series", F.to_date(F.lit(CONTROL[0])).alias("start"), F.to_date(F.lit(CONTROL[1])).alias("end"))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, series, flag): null where a day cannot be judged."""
    return detected(spark, sf_dir).select("date", "series", F.when(F.col("rolling_std").isNotNull(), F.col("anomaly_flag")).alias("flag"))


FLAGS = f"{DETECTED}, flags AS (SELECT date, series, CASE WHEN sd IS NOT NULL THEN flag END AS flag FROM det)"


@query(as_text=("date",), sql=f"{DETECTED} SELECT series, date, round(price, 6) AS price, round(z, 6) AS z_score, round(cz, 6) AS cumulative_z_score, kind AS anomaly_type FROM det WHERE flag")
def win_04_flagged_days(spark, sf_dir):
    return detected(spark, sf_dir).where("anomaly_flag").select("series", "date", "price", "z_score", "cumulative_z_score", "anomaly_type")


@query(as_text=("date",), sql=f"""{DETECTED} SELECT series, date, round(mu, 6) AS expected_value, round(sd, 6) AS rolling_std, df AS daily_anomaly_flag, round(c, 6) AS cumulative_return,
  round(cmu, 6) AS cumulative_expected_value, round(csd, 6) AS cumulative_rolling_std, cf AS cumulative_anomaly_flag FROM det""")
def win_03_baselines(spark, sf_dir):
    return detected(spark, sf_dir).select("series", "date", "expected_value", "rolling_std", "daily_anomaly_flag", "cumulative_return", "cumulative_expected_value", "cumulative_rolling_std", "cumulative_anomaly_flag")


@query(as_text=("date",), sql=f"{RETURNS} SELECT series, date, round(r, 6) AS ret_1, round(price / nullif(lag(price, 5) OVER w, 0) - 1, 6) AS ret_5, round(c, 6) AS ret_10, round(lr, 6) AS log_ret, round(lag(price) OVER w, 6) AS previous_close FROM ret WINDOW w AS {BY}")
def win_01_returns(spark, sf_dir):
    p = tables.daily_prices(spark, sf_dir)
    return p.select("series", "date", detect.change("price").alias("ret_1"), detect.change("price", 5).alias("ret_5"), detect.change("price", 10).alias("ret_10"), detect.log_change("price").alias("log_ret"), F.lag("price").over(by_series()).alias("previous_close"))


_SWITCH = "listed(date, reported) AS (VALUES (DATE '1997-03-03', 0.01::DOUBLE), (DATE '1998-06-15', -0.02::DOUBLE))"


@query(as_text=("date",), sql=f"""{PRICES}, {_SWITCH},
j AS (SELECT p.*, reported, CASE WHEN reported IS NOT NULL THEN price / lag(price) OVER w / (1 + reported) END AS jump FROM prices p LEFT JOIN listed USING (date) WINDOW w AS {BY})
SELECT series, date, round(price * exp(coalesce(sum(ln(jump)) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)), 4) AS basis, reported IS NOT NULL AS contract_switch FROM j""", digits=4)
def win_05_back_adjusted(spark, sf_dir):
    p = tables.daily_prices(spark, sf_dir)
    listed = spark.createDataFrame([("1997-03-03", 0.01), ("1998-06-15", -0.02)], "d string, reported double").select(F.to_date("d").alias("date"), "reported")
    return detect.back_adjusted(p, p.select("series").distinct().crossJoin(F.broadcast(listed))).select("series", "date", "basis", "contract_switch")


@query(as_text=("date",), sql=f"""{RETURNS},
x AS (SELECT *, CASE WHEN count(r) OVER a >= 20 THEN stddev_samp(r) OVER a END AS vol, CASE WHEN count(price) OVER a >= 20 THEN avg(price) OVER a END AS ma,
  CASE WHEN count(price) OVER b >= 75 THEN avg(price) OVER b END AS m75, CASE WHEN count(price) OVER b >= 75 THEN stddev_samp(price) OVER b END AS s75,
  CASE WHEN count(lr) OVER n >= 20 THEN stddev_samp(lr) OVER n END AS fv, CASE WHEN count(price) OVER k >= 20 THEN avg(price) OVER k END AS mf,
  lead(price, 5) OVER w AS l5, lag(price, 5) OVER w AS g5, lag(price, 20) OVER w AS g20, lag(price) OVER w AS g1 FROM ret
  WINDOW w AS {BY}, a AS (PARTITION BY series ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY series ORDER BY date ROWS BETWEEN 74 PRECEDING AND CURRENT ROW),
    n AS (PARTITION BY series ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING), k AS (PARTITION BY series ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT series, date, round(vol, 5) AS volatility_20, round(price / ma - 1, 5) AS ma_distance, round((price - m75) / (s75 + 1e-9), 5) AS price_z, round(l5 / price - 1, 5) AS forward_5, round(fv, 5) AS forward_vol,
  round(price / g5 - 1, 5) AS week_change, round(price / g20 - 1, 5) AS month_change, round(g1, 5) AS persistence, round(mf, 5) AS ma_forecast FROM x""", digits=5)
def win_07_rolled(spark, sf_dir):
    return detect.rolled(tables.daily_prices(spark, sf_dir)).drop("price", "ret", "log_ret")


_PASS = f"""{DETECTED},
s AS (SELECT series, date, rn, 100 * r AS m, lag(price) OVER w * (1 + 100 * r / 200) AS target, df FROM det WINDOW w AS {BY}),
pass AS (SELECT s.series, s.date, min(CASE WHEN (m > 0 AND n.price <= target) OR (m < 0 AND n.price >= target) THEN n.rn - s.rn END) AS days
  FROM s JOIN det n ON n.series = s.series AND n.rn BETWEEN s.rn + 1 AND s.rn + 120 WHERE s.df AND abs(m) >= 1 GROUP BY 1, 2)"""


@query(as_text=("date",), sql=f"{_PASS} SELECT series, date, CAST(days AS INTEGER) AS days FROM pass")
def win_12_first_passage(spark, sf_dir):
    d = detected(spark, sf_dir)
    return detect.first_passage(d, F.col("daily_anomaly_flag")).withColumn("days", F.col("days").cast("int"))


@query(f"""{_PASS} SELECT series, count(*) AS n, count(days) AS retraced, count(*) - count(days) AS never_retraced, round((count(*) - count(days)) / count(*), 6) AS share_never,
  round(quantile_cont(CAST(days AS DOUBLE), 0.5), 6) AS median_days, round(quantile_cont(CAST(days AS DOUBLE), 0.25), 6) AS q1_days, round(quantile_cont(CAST(days AS DOUBLE), 0.75), 6) AS q3_days FROM pass GROUP BY series""")
def agg_12_half_life(spark, sf_dir):
    d = detected(spark, sf_dir)
    return detect.half_life(detect.first_passage(d, F.col("daily_anomaly_flag")))


_EPISODES = f"""{DETECTED},
f AS (SELECT series, date, rn, coalesce(rn - lag(rn) OVER w > 3, true) AS fresh FROM det WHERE flag WINDOW w AS {BY}),
e AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY series ORDER BY date) AS episode FROM f)"""


@query(as_text=("start", "end"), sql=f"{_EPISODES} SELECT series, CAST(episode AS BIGINT) AS episode, min(date) AS start, max(date) AS \"end\", count(*) AS flagged, CAST(max(rn) - min(rn) + 1 AS INTEGER) AS rows FROM e GROUP BY series, episode")
def win_19_episodes(spark, sf_dir):
    return detect.episodes(detected(spark, sf_dir))


@query(as_text=("date",), sql=f"{DETECTED} SELECT series, date, bool_or(flag) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near_flag FROM det")
def win_21_near_flag(spark, sf_dir):
    return detect.near_flag(detected(spark, sf_dir)).select("series", "date", "near_flag")


@query(f"""{DETECTED} SELECT series, round(avg(CAST(abs(z) >= 2 AS INTEGER)), 6) AS measured_at_2, round(kurtosis(z), 6) AS excess_kurtosis,
  round(quantile_cont(abs(z), 0.95), 6) AS z_for_05, round(quantile_cont(abs(z), 0.98), 6) AS z_for_02, round(quantile_cont(abs(z), 0.99), 6) AS z_for_01 FROM det WHERE z IS NOT NULL GROUP BY series""")
def agg_13_calibration(spark, sf_dir):
    return detect.calibration(detected(spark, sf_dir))


@query(as_text=("date",), sql=f"{DETECTED} SELECT series, date, coalesce(price > 0 AND lag(price) OVER w > 0 AND r IS NOT NULL AND z IS NOT NULL, false) AS usable FROM det WINDOW w AS {BY}")
def prj_02_usable_moves(spark, sf_dir):
    return detect.usable(detected(spark, sf_dir)).select("series", "date", "usable")


@query(as_text=("date",), sql=f"""{DETECTED} SELECT series, date, kind AS anomaly_type, round(100 * r, 6) AS pct_move, round(100 * c, 6) AS cumulative_pct,
  CASE WHEN CASE WHEN kind = 'trend' THEN cz ELSE z END > 0 THEN 'up' WHEN CASE WHEN kind = 'trend' THEN cz ELSE z END < 0 THEN 'down' END AS direction FROM det WHERE flag""")
def prj_04_move_records(spark, sf_dir):
    return detect.move_record(detected(spark, sf_dir)).where("anomaly_flag").select("series", "date", "anomaly_type", "pct_move", "cumulative_pct", "direction")


@query(as_text=("date",), sql=f"{DETECTED}, {EVENTS_SQL} SELECT series, date, label, flag AS anomaly_flag FROM det JOIN events_dim ON date BETWEEN s AND e")
def join_07_days_in_events(spark, sf_dir):
    d = detected(spark, sf_dir)
    return joins.in_events(d.select("series", "date", "anomaly_flag"), events_dim(spark, d)).select("series", "date", "label", "anomaly_flag")


@query(as_text=("date", "1-URGENT", "2-HIGH", "3-MEDIUM"), sql=f"""{FLAGS} SELECT date, bool_or(flag) FILTER (series = '1-URGENT') AS "1-URGENT", bool_or(flag) FILTER (series = '2-HIGH') AS "2-HIGH", bool_or(flag) FILTER (series = '3-MEDIUM') AS "3-MEDIUM" FROM flags GROUP BY date""")
def join_06_aligned_flags(spark, sf_dir):
    return joins.aligned_flags(flags(spark, sf_dir), ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query(f"""{FLAGS} SELECT x.series AS a, y.series AS b, count(*) AS common_days, count(*) FILTER (x.flag AND y.flag) AS both, count(*) FILTER (x.flag OR y.flag) AS either,
  round(count(*) FILTER (x.flag AND y.flag) / nullif(count(*) FILTER (x.flag OR y.flag), 0), 6) AS jaccard FROM flags x JOIN flags y USING (date) WHERE x.series < y.series AND x.flag IS NOT NULL AND y.flag IS NOT NULL GROUP BY 1, 2""")
def join_15_pair_overlap(spark, sf_dir):
    return joins.pair_overlap(flags(spark, sf_dir))


_VOTES = f"""{FLAGS}, v AS (SELECT *, coalesce(sum(CAST(flag AS INTEGER)) OVER d, 0) - coalesce(CAST(flag AS INTEGER), 0) AS others, count(flag) OVER d - CAST(flag IS NOT NULL AS INTEGER) AS judged FROM flags WINDOW d AS (PARTITION BY date))"""


@query(f"{_VOTES} SELECT series, CAST(k AS INTEGER) AS k, count(*) AS n, count(*) FILTER (others >= k) AS macro, round(count(*) FILTER (others >= k) / count(*), 6) AS share FROM v, range(1, 5) AS r(k) WHERE flag AND judged >= k GROUP BY series, k")
def agg_09_macro_votes(spark, sf_dir):
    return joins.macro_votes(flags(spark, sf_dir))


@query(as_text=("date",), sql=f"{_VOTES} SELECT series, date, CAST(others AS BIGINT) AS others_flagged, judged AS others_judged, CASE WHEN judged < 2 THEN 'unclassified' WHEN others >= 2 THEN 'macro' ELSE 'specific' END AS verdict FROM v WHERE flag")
def join_20_cross_verdicts(spark, sf_dir):
    return factors.cross_verdicts(flags(spark, sf_dir)).select("series", "date", "others_flagged", "others_judged", "verdict")


@query(as_text=("date", "flag"), sql=f"{FLAGS} SELECT date, CASE WHEN series IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE series END AS series, bool_or(flag) AS flag FROM flags GROUP BY 1, 2")
def agg_10_substitutes(spark, sf_dir):
    return joins.as_one(flags(spark, sf_dir), F.when(F.col("series").isin("1-URGENT", "2-HIGH"), "fast").otherwise(F.col("series")))


_MONTH = f"""{PRICES}, mm AS (SELECT series, date_trunc('month', date)::DATE AS month, avg(price) AS value, max(date) AS last FROM prices GROUP BY 1, 2),
months AS (SELECT series, month, value FROM (SELECT *, max(month) OVER (PARTITION BY series) AS newest FROM mm) WHERE month <> newest OR last = last_day(month))"""


def _months(spark, sf_dir):
    return monthly.month_means(tables.daily_prices(spark, sf_dir), ["series"])


@query(as_text=("month",), sql=f"{_MONTH} SELECT series, month, round(value, 4) AS value FROM months", digits=4)
def agg_19_month_means(spark, sf_dir):
    return _months(spark, sf_dir)


_CHANGES = f"""{_MONTH}, ends AS (SELECT series, min(month) AS a, max(month) AS b FROM months GROUP BY series),
spine AS (SELECT series, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM ends),
sp AS (SELECT series, month, value FROM spine LEFT JOIN months USING (series, month)),
ch AS (SELECT series, month, ln(value) - ln(lag(value) OVER w) AS log_change, 100 * (value / lag(value, 12) OVER w - 1) AS yoy,
  CASE WHEN datediff('day', lag(month, 3) OVER w, month) < 100 THEN (pow(value / lag(value, 3) OVER w, 4) - 1) * 100 END AS a3 FROM sp WINDOW w AS (PARTITION BY series ORDER BY month))"""


def _changes(spark, sf_dir):
    return monthly.month_changes(monthly.month_spine(_months(spark, sf_dir), ["series"]), ["series"])


@query(as_text=("month",), sql=f"{_CHANGES} SELECT series, month, round(log_change, 5) AS log_change, round(yoy, 5) AS year_on_year, round(a3, 5) AS annualised_3m FROM ch", digits=5)
def win_14_month_changes(spark, sf_dir):
    return _changes(spark, sf_dir).drop("value")


def _pairs(spark, sf_dir):
    return monthly.pair_frame(_changes(spark, sf_dir), ["1-URGENT", "2-HIGH"], ["3-MEDIUM", "5-LOW"])


@query(as_text=("month",), sql=f"""{_CHANGES}, f AS (SELECT y.series AS target, x.series AS driver, month, y.log_change AS y, x.log_change AS x FROM ch y JOIN ch x USING (month) WHERE y.series IN ('1-URGENT', '2-HIGH') AND x.series IN ('3-MEDIUM', '5-LOW')),
l AS (SELECT *, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(y, 1) OVER w AS y1 FROM f WINDOW w AS (PARTITION BY target, driver ORDER BY month))
SELECT target, driver, month, round(y, 5) AS y, round(x, 5) AS x_l0, round(x1, 5) AS x_l1, round(x2, 5) AS x_l2, round(y1, 5) AS y_l1 FROM l WHERE y IS NOT NULL AND x IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND y1 IS NOT NULL""", digits=5)
def win_13_lag_frame(spark, sf_dir):
    return monthly.lag_frame(_pairs(spark, sf_dir), ["target", "driver"], [0, 1, 2], [1]).drop("x")


@query()
def dom_17_pass_through(spark, sf_dir):
    return monthly.pass_through(_pairs(spark, sf_dir))


@query()
def dom_18_nowcast(spark, sf_dir):
    return monthly.nowcast(_pairs(spark, sf_dir), 40)


@query()
def dom_19_pair_verdicts(spark, sf_dir):
    fits = monthly.pass_through(_pairs(spark, sf_dir))
    tests = monthly.holm_by_step(monthly.nowcast(_pairs(spark, sf_dir), 40), "p").select("target", "driver", F.col("holm_p").alias("test_p"), "improvement_pct")
    return fits.join(tests, ["target", "driver"]).withColumn("verdict", monthly.pass_through_verdict("holm_p", "test_p", "sum_beta")).select("target", "driver", "n", "sum_beta", "holm_p", "test_p", "improvement_pct", "verdict")


_BENCH = f"""{_MONTH}, bench AS (SELECT series, (month + INTERVAL 1 MONTH)::DATE AS known_from, value AS benchmark FROM months)"""


def _benchmark(spark, sf_dir):
    return _months(spark, sf_dir).select("series", dates.known_from("month", F.lit("price")).alias("known_from"), F.col("value").alias("benchmark"))


@query(as_text=("date",), sql=f"{_BENCH} SELECT p.series, p.date, round(benchmark, 4) AS benchmark FROM prices p ASOF LEFT JOIN bench b ON p.series = b.series AND p.date >= b.known_from", digits=4)
def join_02_as_of_benchmark(spark, sf_dir):
    return joins.as_of(tables.daily_prices(spark, sf_dir), _benchmark(spark, sf_dir), ["series"], "date", "known_from", ["benchmark"]).select("series", "date", "benchmark")


@query(as_text=("date",), sql=f"""{PRICES} SELECT p.series, p.date, round(a.price, 4) AS price_7d, round(b.price, 4) AS price_30d FROM prices p
  ASOF LEFT JOIN prices a ON p.series = a.series AND p.date - INTERVAL 7 DAY >= a.date ASOF LEFT JOIN prices b ON p.series = b.series AND p.date - INTERVAL 30 DAY >= b.date""", digits=4)
def join_03_point_in_time(spark, sf_dir):
    p = tables.daily_prices(spark, sf_dir)
    left = p.select("series", "date", F.date_sub("date", 7).alias("d7"), F.date_sub("date", 30).alias("d30"))
    week = joins.as_of(left, p.select("series", F.col("date").alias("at"), F.col("price").alias("price_7d")), ["series"], "d7", "at", ["price_7d"])
    return joins.as_of(week, p.select("series", F.col("date").alias("at"), F.col("price").alias("price_30d")), ["series"], "d30", "at", ["price_30d"]).select("series", "date", "price_7d", "price_30d")


@query(as_text=("date",), sql=f"{_BENCH} SELECT p.series, p.date, round(100 * (price - benchmark * (100 / 2.20462::DOUBLE)) / (benchmark * (100 / 2.20462::DOUBLE)), 5) AS spread_pct FROM prices p ASOF LEFT JOIN bench b ON p.series = b.series AND p.date >= b.known_from", digits=5)
def join_18_spread(spark, sf_dir):
    joined = joins.as_of(tables.daily_prices(spark, sf_dir), _benchmark(spark, sf_dir), ["series"], "date", "known_from", ["benchmark"])
    return joins.spread(joined).select("series", "date", "spread_pct")


# Stand-ins: line prices by return flag as factor levels, and rates by line status.
_LEVELS = f"""{LINES},
wide AS (SELECT date, max(price) FILTER (series = 'A') AS a, max(price) FILTER (series = 'N') AS n, max(price) FILTER (series = 'R') AS r FROM lines GROUP BY date),
fac AS (SELECT date, ln(a) - lag(ln(a)) OVER w AS f_market, ln(n) - lag(ln(n)) OVER w AS f_dollar, ln(r) - lag(ln(r)) OVER w AS f_broad FROM wide WINDOW w AS (ORDER BY date))"""


def factor_table(spark, sf_dir):
    levels = tables.line_prices(spark, sf_dir).select("date", F.col("series").alias("name"), F.col("price").alias("value"))
    return joins.wide_returns(levels, ["A", "N", "R"]).toDF("date", *FACTORS)


@query(as_text=("date",), sql=f"{_LEVELS} SELECT date, round(f_market, 6) AS f_market, round(f_dollar, 6) AS f_dollar, round(f_broad, 6) AS f_broad FROM fac")
def fn_35_factor_returns(spark, sf_dir):
    return factor_table(spark, sf_dir)


@query(as_text=("date",), sql=f"""{_LEVELS} SELECT date, round(CASE WHEN (f_market IS NOT NULL)::INT + (f_dollar IS NOT NULL)::INT + (f_broad IS NOT NULL)::INT >= 2
  THEN (coalesce(f_market, 0) + coalesce(f_dollar, 0) + coalesce(f_broad, 0)) / ((f_market IS NOT NULL)::INT + (f_dollar IS NOT NULL)::INT + (f_broad IS NOT NULL)::INT) END, 6) AS basket FROM fac""")
def fn_34_dollar_basket(spark, sf_dir):
    return factor_table(spark, sf_dir).select("date", joins.dollar_basket(list(FACTORS)).alias("basket"))


_CASES = f"""{RETURNS}, {_LEVELS}, cases AS (SELECT series, date, lr AS y, f_market AS x0, f_dollar AS x1, f_broad AS x2 FROM ret JOIN fac USING (date) WHERE lr IS NOT NULL AND f_market IS NOT NULL AND f_dollar IS NOT NULL AND f_broad IS NOT NULL)"""


def cases(spark, sf_dir):
    y = tables.daily_prices(spark, sf_dir).select("series", "date", detect.log_change("price").alias("y"))
    return joins.complete_cases(y, factor_table(spark, sf_dir), list(FACTORS))


@query(as_text=("date",), sql=f"{_CASES} SELECT series, date, round(y, 6) AS y, round(x0, 6) AS f_market, round(x1, 6) AS f_dollar, round(x2, 6) AS f_broad FROM cases")
def join_04_complete_cases(spark, sf_dir):
    return cases(spark, sf_dir)


def _det3(m: list[list[str]]) -> str:
    return f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"


_C = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
_FIT = f"""{_CASES},
mom AS (SELECT *, count(*) OVER f AS n, avg(y) OVER f AS my, {', '.join(f'avg(x{i}) OVER f AS m{i}' for i in range(3))}, {', '.join(f'covar_samp(x{i}, x{j}) OVER f AS c{i}{j}' for i in range(3) for j in range(i, 3))},
  {', '.join(f'covar_samp(y, x{i}) OVER f AS y{i}' for i in range(3))}, var_samp(y) OVER f AS yy FROM cases WINDOW f AS (PARTITION BY series ORDER BY date ROWS BETWEEN 75 PRECEDING AND 1 PRECEDING)),
fit AS (SELECT *, {', '.join(f'CASE WHEN n >= 40 THEN {_det3([[f"y{i}" if j == k else _C[i][j] for j in range(3)] for i in range(3)])} / {_det3(_C)} END AS b{k}' for k in range(3))} FROM mom),
res AS (SELECT *, my + b0 * (x0 - m0) + b1 * (x1 - m1) + b2 * (x2 - m2) AS explained, yy - b0 * y0 - b1 * y1 - b2 * y2 AS v FROM fit)"""


@query(as_text=("date",), sql=f"{_FIT} SELECT series, date, round(explained, 5) AS factor_explained, round(y - explained, 5) AS residual, round((y - explained) / sqrt(v), 5) AS residual_z, round(1 - v / yy, 5) AS window_r2 FROM res", digits=5)
def win_16_rolling_fit(spark, sf_dir):
    return factors.rolling_fit(cases(spark, sf_dir), FACTORS).select("series", "date", "factor_explained", "residual", "residual_z", "window_r2")


@query(as_text=("date",), sql=f"""{_CASES} SELECT series, date, round(CASE WHEN count(*) OVER f >= 40 THEN regr_slope(y, x0) OVER f END, 5) AS beta, round(CASE WHEN count(*) OVER f >= 40 THEN regr_r2(y, x0) OVER f END, 5) AS beta_r2
FROM cases WINDOW f AS (PARTITION BY series ORDER BY date ROWS BETWEEN 75 PRECEDING AND 1 PRECEDING)""", digits=5)
def win_17_rolling_beta(spark, sf_dir):
    return factors.rolling_beta(cases(spark, sf_dir), "y", "f_market").select("series", "date", "beta", "beta_r2")


@query(as_text=("date",))
def dom_20_factor_adjusted(spark, sf_dir):
    return factors.factor_adjusted(detected(spark, sf_dir), cases(spark, sf_dir), FACTORS).where("anomaly_flag").select("series", "date", "anomaly_type", "residual_z", "cum_residual_z", "factor_class")


@query()
def agg_08_class_counts(spark, sf_dir):
    return factors.class_counts(factors.factor_adjusted(detected(spark, sf_dir), cases(spark, sf_dir), FACTORS))


@query(as_text=("date",), sql=f"""{_CASES}, m AS (SELECT series, date, y, unnest([x0, x1]) AS fx FROM cases)
SELECT series, date, round(max(y), 6) AS dollar_move, round(median(y + fx), 6) AS median_move, count(*) AS currencies, round(median(y + fx) / nullif(max(y), 0), 4) AS survival,
  CASE WHEN median(y + fx) / nullif(max(y), 0) >= 0.8 THEN 'own move' WHEN median(y + fx) / nullif(max(y), 0) <= 0.35 THEN 'dollar move' WHEN median(y + fx) / nullif(max(y), 0) IS NOT NULL THEN 'mixed' END AS reading FROM m GROUP BY series, date""")
def fn_39_survival(spark, sf_dir):
    c = cases(spark, sf_dir)
    moves = joins.currency_rows(c.select("series", "date", "y"), factor_table(spark, sf_dir).dropna().select("date", "f_market", "f_dollar"), ["f_market", "f_dollar"])
    return factors.survival(moves).withColumn("survival", F.round("survival", 4))


@query(f"""{PRICES}, e AS (SELECT series, price, lag(price) OVER w AS f1, CASE WHEN count(price) OVER k >= 20 THEN avg(price) OVER k END AS f2 FROM prices WINDOW w AS {BY}, k AS (PARTITION BY series ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT series, count(price - f1) AS n, round(avg(abs(price - f1)), 4) AS mae, round(sqrt(avg((price - f1) * (price - f1))), 4) AS rmse FROM e GROUP BY series""", digits=4)
def agg_20_forecast_errors(spark, sf_dir):
    return evaluate.errors(detect.rolled(tables.daily_prices(spark, sf_dir)), "price", "persistence", "series")


@query(as_text=("date",), sql=f"{DETECTED} SELECT series, date, round(z, 6) AS z_score FROM det WHERE z IS NOT NULL ORDER BY abs(z) DESC, date, series LIMIT 25")
def rank_01_top_days(spark, sf_dir):
    return rank.top(detected(spark, sf_dir).where("z_score IS NOT NULL"), 25, F.abs("z_score").desc(), F.col("date"), F.col("series")).select("series", "date", "z_score")


@query(as_text=("date",), sql=f"{DETECTED}, t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(r) DESC NULLS LAST, date) AS place FROM det) SELECT series, date, place, flag AS anomaly_flag FROM t WHERE place <= 20")
def rank_02_largest_moves(spark, sf_dir):
    return rank.top_by(detected(spark, sf_dir), ["series"], 20, F.abs("return_pct").desc_nulls_last(), F.col("date")).select("series", "date", "place", "anomaly_flag")


@query(as_text=("date",), sql=f"""{DETECTED}, {EVENTS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY series, label ORDER BY abs(z) DESC, date) AS place FROM det JOIN events_dim ON date BETWEEN s AND e WHERE df)
SELECT series, label, date, place FROM t WHERE place <= 2""")
def rank_03_event_days(spark, sf_dir):
    d = detected(spark, sf_dir)
    return rank.top_by(joins.in_events(d.where("daily_anomaly_flag"), events_dim(spark, d)), ["series", "label"], 2, F.abs("z_score").desc(), F.col("date")).select("series", "label", "date", "place")


@query(as_text=("date",))
def rank_13_stratified_days(spark, sf_dir):
    days = detect.move_record(detected(spark, sf_dir)).where("anomaly_flag AND direction IS NOT NULL").select("series", "date", "direction", F.lit(False).alias("forced"))
    return rank.stratified(days, 60)


@query(as_text=("date",), sql=f"{DETECTED}, f AS (SELECT series, date, z, row_number() OVER (PARTITION BY series ORDER BY z, date) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM det WHERE flag AND z IS NOT NULL) SELECT series, date FROM f WHERE n <= 10 OR floor((i + 1) * 10 / n - 1e-12) > floor(i * 10 / n - 1e-12)")
def rank_14_even_sample(spark, sf_dir):
    return rank.evenly_spaced(detected(spark, sf_dir).where("anomaly_flag AND z_score IS NOT NULL"), 10, ["series"], F.col("z_score"), F.col("date")).select("series", "date")


@query(as_text=("date",))
def rank_15_quiet_days(spark, sf_dir):
    return rank.quiet_days(detect.near_flag(detected(spark, sf_dir)), "1997-01-01", 20).select("series", "date", "z_score", "place")


@query(as_text=("date",))
def rank_16_move_donors(spark, sf_dir):
    d = detected(spark, sf_dir)
    quiet = rank.quiet_days(detect.near_flag(d), "1997-01-01", 20)
    return rank.move_donors(quiet, d.where("anomaly_type = 'shock'"))


@query(as_text=("date", "donor"))
def join_13_donors(spark, sf_dir):
    return joins.donors(detect.move_record(detected(spark, sf_dir)).where("anomaly_flag AND direction IS NOT NULL").select("series", "date", "direction"))


@query()
def dom_15_direction_walk_forward(spark, sf_dir):
    return forecast.walk_scores(forecast.walk_forward(forecast.outlook_frame(tables.daily_prices(spark, sf_dir), 5), 5, least=1500))


@query()
def dom_16_large_move_risk(spark, sf_dir):
    return forecast.walk_scores(forecast.walk_forward(forecast.outlook_frame(tables.daily_prices(spark, sf_dir), 5), 5, least=1500, large=0.75))


@query()
def dom_22_outlook_backtest(spark, sf_dir):
    frame = forecast.outlook_frame(tables.daily_prices(spark, sf_dir), 20)
    targets = rank.evenly_spaced(frame.where("rn > 400 AND forward IS NOT NULL"), 10, ["series"], F.col("rn")).select("series", "rn")
    leans = rank.analog_outlook(rank.analogs(frame, targets, ["ret_5", "ret_10", "vol_20", "ma_distance"])).select("series", F.col("target").alias("rn"), F.col("lean").alias("lean_analog"))
    plain = frame.select("series", "rn", "forward", F.when(F.col("ret_10") > 0, "up").otherwise("down").alias("lean_momentum"), F.when(draw(11, "series", "rn") % 2 == 0, "up").otherwise("down").alias("lean_random"))
    return forecast.lean_scores(leans.join(plain, ["series", "rn"]).select("forward", "lean_analog", "lean_momentum", "lean_random"))


def weather(spark, sf_dir):
    """Stand-in weather: mean quantity as rain and discount as temperature, by return flag and ship day."""
    return tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("station_id"), F.to_date("l_shipdate").alias("date")).agg((F.sum("l_quantity") / F.count(F.lit(1))).alias("prcp_mm"), (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count(F.lit(1))).alias("tmin_c"))


_WEATHER = f"""days AS (SELECT l_returnflag AS station_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) / count(*) AS prcp, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS tmin FROM lineitem GROUP BY 1, 2),
rolls AS (SELECT *, CASE WHEN count(prcp) OVER a >= 20 THEN sum(prcp) OVER a END AS p30, CASE WHEN count(prcp) OVER b >= 60 THEN sum(prcp) OVER b END AS p90, sum(CAST(tmin < 2 AS INTEGER)) OVER c AS frost
  FROM days WINDOW a AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), b AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW), c AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
dry AS (SELECT *, (p90 - CASE WHEN count(p90) OVER y >= 180 THEN avg(p90) OVER y END) / nullif(CASE WHEN count(p90) OVER y >= 180 THEN stddev_samp(p90) OVER y END, 0) AS rain_z FROM rolls WINDOW y AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 364 PRECEDING AND CURRENT ROW))"""


@query(as_text=("date",), sql=f"{_WEATHER} SELECT station_id, date, round(p30, 4) AS prcp_30, round(p90, 4) AS prcp_90, CAST(frost AS BIGINT) AS frost_7, round(rain_z, 4) + 0 AS rain_z, round(-rain_z, 4) + 0 AS dryness_z FROM dry", digits=4)
def win_06_dryness(spark, sf_dir):
    return brief.dryness(weather(spark, sf_dir)).drop("prcp_mm", "tmin_c")


@query(as_text=("date",), sql=f"{PRICES}, days AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) / count(*) AS prcp_mm FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT series, date, round(prcp_mm, 6) AS prcp_mm FROM prices LEFT JOIN days USING (date)")
def join_01_daily_weather(spark, sf_dir):
    w = weather(spark, sf_dir).where("station_id = 'N'").select("date", "prcp_mm")
    return tables.daily_prices(spark, sf_dir).join(w, "date", "left").select("series", "date", "prcp_mm")


@query(as_text=("date",), sql=f"""{_BENCH}, w AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) / count(*) AS prcp_mm FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT p.series, p.date, round(p.price, 4) AS price, round(prcp_mm, 4) AS prcp_mm, round(benchmark, 4) AS benchmark FROM (SELECT * FROM prices LEFT JOIN w USING (date)) p ASOF LEFT JOIN bench b ON p.series = b.series AND p.date >= b.known_from""", digits=4)
def dom_13_unified_table(spark, sf_dir):
    p = tables.daily_prices(spark, sf_dir)
    w = weather(spark, sf_dir).where("station_id = 'N'").select("date", "prcp_mm")
    local = p.select("series", "date").join(w, "date").select("series", "date", "prcp_mm")
    return brief.unified(p, local, _benchmark(spark, sf_dir))


def _observations(spark, sf_dir):
    p = tables.daily_prices(spark, sf_dir)
    d = detect.detections(p)
    spreads = joins.spread(joins.as_of(p, _benchmark(spark, sf_dir), ["series"], "date", "known_from", ["benchmark"]))
    return brief.brief([brief.observe_trend(detect.rolled(p)), brief.observe_moves(d), brief.observe_spread(spreads)])


@query()
def dom_11_brief(spark, sf_dir):
    return _observations(spark, sf_dir)


@query()
def rank_18_alerts(spark, sf_dir):
    return brief.alert(_observations(spark, sf_dir))


@query(f"""{DETECTED}, v AS (SELECT series, last(date ORDER BY date) AS d, arg_max(r, date) AS r1, arg_max(c, date) AS r10, arg_max(z, date) AS z FROM det GROUP BY series),
s AS (SELECT series, unnest([{{'f': 'day', 'v': CAST(sign(r1) AS INTEGER)}}, {{'f': 'ten days', 'v': 2 * CAST(sign(r10) AS INTEGER)}}, {{'f': 'unusual', 'v': CASE WHEN abs(z) >= 2 THEN CAST(sign(z) AS INTEGER) ELSE 0 END}}]) AS x FROM v)
SELECT series, CAST(sum(x.v) AS BIGINT) AS score, CASE WHEN sum(x.v) >= 2 THEN 'up' WHEN sum(x.v) <= -2 THEN 'down' ELSE 'sideways' END AS outlook, array_to_string(list_transform(list_sort(list({{'w': -abs(x.v), 'f': x.f}}) FILTER (x.v <> 0))[1:2], lambda o: o.f), ', ') AS drivers FROM s GROUP BY series""")
def dom_01_signal_vote(spark, sf_dir):
    last = brief.latest(detected(spark, sf_dir))
    votes = last.select("series", F.explode(F.array(
        F.struct(F.lit("day").alias("factor"), F.signum("return_pct").cast("int").alias("vote")), F.struct(F.lit("ten days").alias("factor"), (2 * F.signum("cumulative_return")).cast("int").alias("vote")),
        F.struct(F.lit("unusual").alias("factor"), F.when(F.abs("z_score") >= 2, F.signum("z_score").cast("int")).otherwise(0).alias("vote")))).alias("s")).select("series", "s.*")
    return brief.signal_vote(votes)


@query(as_text=("date",), sql=f"""{PRICES}, y AS (SELECT *, min(price) OVER w AS lo, max(price) OVER w AS hi FROM prices WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
SELECT series, date, round((price - lo) / nullif(hi - lo, 0), 5) AS range_position FROM y""", digits=5)
def agg_18_range_position(spark, sf_dir):
    year = by_series().rowsBetween(-251, 0)
    p = tables.daily_prices(spark, sf_dir)
    return p.select("series", "date", ratio(F.col("price") - F.min("price").over(year), F.max("price").over(year) - F.min("price").over(year)).alias("range_position"))


_WEEKLY = """weekly AS (SELECT l_returnflag AS series, date_trunc('week', CAST(l_shipdate AS DATE))::DATE AS report_date, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE 0 END) AS BIGINT) AS lo, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END) AS BIGINT) AS sh FROM lineitem GROUP BY 1, 2),
wk AS (SELECT *, lo - sh AS net, row_number() OVER (PARTITION BY series ORDER BY report_date DESC) AS rn FROM weekly), yr AS (SELECT *, max(CASE WHEN rn = 1 THEN net END) OVER (PARTITION BY series) AS newest FROM wk WHERE rn <= 52)"""


@query(f"""{_WEEKLY} SELECT series, CAST(max(newest) AS BIGINT) AS net, CAST(max(CASE WHEN rn = 1 THEN net END) - max(CASE WHEN rn = 2 THEN net END) AS BIGINT) AS change,
  round(CASE WHEN coalesce(stddev_samp(net), 0) = 0 THEN 50 ELSE 100 * avg(CAST(net < newest AS INTEGER)) END, 6) AS percentile, round(max(CASE WHEN rn = 1 THEN lo / nullif(lo + sh, 0) END), 6) AS long_share FROM yr GROUP BY series""")
def agg_17_positioning(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    weekly = li.groupBy(F.col("l_returnflag").alias("series"), F.to_date(F.date_trunc("week", F.to_date("l_shipdate"))).alias("report_date")).agg(
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).otherwise(0)).alias("noncommercial_long"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).otherwise(0)).alias("noncommercial_short"))
    return brief.positioning_summary(weekly)


@query(as_text=("date",))
def join_17_cards(spark, sf_dir):
    d = detected(spark, sf_dir).where("anomaly_flag")
    layers = {"move": d.select("series", "date", "z_score", "anomaly_type"), "factors": factors.factor_adjusted(detected(spark, sf_dir), cases(spark, sf_dir), FACTORS).where("anomaly_flag AND residual_z IS NOT NULL").select("series", "date", "residual_z", "factor_class"), "cross": factors.cross_verdicts(flags(spark, sf_dir)).select("series", "date", "verdict")}
    c = brief.card(layers, ["series", "date"])
    return c.select("series", "date", "move.anomaly_type", "factors.factor_class", "cross.verdict", "missing")
