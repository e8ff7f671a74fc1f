"""The market brief: observations as rows of one shape, the signal vote, the alert level, and the unified daily table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shocklens.functions.numbers import by_series, guarded, ratio
from shocklens.operators.joins import as_of

NOTABLE, USUAL, MINOR = 1, 2, 3


def dryness(weather: DataFrame) -> DataFrame:
    """Rolling rain and frost of each station, with rain_z positive when wet and dryness_z its negative.

    Sums need 20 of 30 and 60 of 90 days; the year's mean and spread 180 of 365.
    """
    w = Window.partitionBy("station_id").orderBy("date")
    r30, r90, r7, year = w.rowsBetween(-29, 0), w.rowsBetween(-89, 0), w.rowsBetween(-6, 0), w.rowsBetween(-364, 0)
    df = weather.withColumns({
        "prcp_30": guarded(F.sum("prcp_mm"), "prcp_mm", r30, 20), "prcp_90": guarded(F.sum("prcp_mm"), "prcp_mm", r90, 60),
        "frost_7": guarded(F.sum((F.col("tmin_c") < 2).cast("int")), "tmin_c", r7, 1)})
    spread = guarded(F.stddev_samp("prcp_90"), "prcp_90", year, 180)
    df = df.withColumn("rain_z", ratio(F.col("prcp_90") - guarded(F.avg("prcp_90"), "prcp_90", year, 180), F.when(spread > 0, spread)))
    return df.withColumn("dryness_z", -F.col("rain_z"))


def unified(prices: DataFrame, weather: DataFrame, monthly: DataFrame) -> DataFrame:
    """Prices with the day's weather and the latest monthly benchmark that was known on the day."""
    daily = prices.join(weather, ["series", "date"], "left")
    return as_of(daily, monthly, ["series"], "date", "known_from", ["benchmark"])


def observation(category: str, importance: Column, text: Column, keys: tuple[str, ...] = ("series",)) -> list[Column]:
    return [*map(F.col, keys), F.lit(category).alias("category"), importance.cast("int").alias("importance"), text.alias("text")]


def latest(df: DataFrame) -> DataFrame:
    """The last row of each series."""
    row = F.max_by(F.struct(*df.columns), "date").alias("_r")
    return df.groupBy("series").agg(row).select("_r.*")


def observe_trend(rolled: DataFrame) -> DataFrame:
    """Week and month change, place in the year's range, volatility against its own year."""
    w = by_series()
    year = w.rowsBetween(-251, 0)
    df = rolled.withColumns({"_low": F.min("price").over(year), "_high": F.max("price").over(year), "_usual": F.avg("volatility_20").over(year)})
    df = df.withColumns({"range_position": ratio(F.col("price") - F.col("_low"), F.col("_high") - F.col("_low")), "vol_ratio": ratio("volatility_20", "_usual")})
    last = latest(df)
    loud = (F.abs("month_change") > 0.10) | (F.col("vol_ratio") > 1.5)
    state = F.when(F.col("vol_ratio") > 1.5, "turbulent").when(F.col("vol_ratio") < 0.7, "calm").otherwise("usual")
    return last.select(*observation("price", F.when(loud, NOTABLE).otherwise(USUAL), F.format_string("%+.1f%% in a month, %s", 100 * F.col("month_change"), state)), "range_position", "vol_ratio")


def observe_moves(detected: DataFrame, rows: int = 7) -> DataFrame:
    """Flags among the last rows of each series."""
    recent = detected.withColumn("_rn", F.row_number().over(Window.partitionBy("series").orderBy(F.col("date").desc()))).where(F.col("_rn") <= rows)
    out = recent.groupBy("series").agg(F.count_if("anomaly_flag").alias("flags"), F.max(F.when(F.col("anomaly_flag"), F.col("date"))).alias("last_flag"))
    return out.select(*observation("moves", F.when(F.col("flags") > 0, NOTABLE).otherwise(MINOR), F.format_string("%d unusual of the last %d sessions", F.col("flags"), F.lit(rows))), "flags", "last_flag")


def positioning_summary(weekly: DataFrame, weeks: int = 52) -> DataFrame:
    """Net position, its change, its strict percentile among the last weeks and the long share."""
    w = Window.partitionBy("series").orderBy(F.col("report_date").desc())
    rows = weekly.withColumns({"net": F.col("noncommercial_long") - F.col("noncommercial_short"), "_rn": F.row_number().over(w)}).where(F.col("_rn") <= weeks)
    newest = F.max_by("net", "report_date").over(Window.partitionBy("series"))
    rows = rows.withColumn("_newest", newest)
    out = rows.groupBy("series").agg(
        F.max_by("net", "report_date").alias("net"), F.max(F.when(F.col("_rn") == 1, F.col("net"))).alias("_n1"), F.max(F.when(F.col("_rn") == 2, F.col("net"))).alias("_n2"),
        (100 * F.avg((F.col("net") < F.col("_newest")).cast("double"))).alias("_pct"), F.coalesce(F.stddev_samp("net"), F.lit(0.0)).alias("_sd"),
        F.max_by(ratio("noncommercial_long", F.col("noncommercial_long") + F.col("noncommercial_short")), "report_date").alias("long_share"))
    return out.select("series", "net", (F.col("_n1") - F.col("_n2")).alias("change"), F.when(F.col("_sd") == 0, 50.0).otherwise(F.col("_pct")).alias("percentile"), "long_share")


def observe_positioning(summary: DataFrame) -> DataFrame:
    p = F.col("percentile")
    text = F.when(p >= 85, "crowded long").when(p >= 70, "long").when(p <= 15, "crowded short").when(p <= 30, "short").otherwise("balanced")
    return summary.select(*observation("positioning", F.when((p >= 85) | (p <= 15), NOTABLE).otherwise(USUAL), text))


def observe_spread(spreads: DataFrame) -> DataFrame:
    last = latest(spreads.where("spread_pct IS NOT NULL"))
    return last.select(*observation("benchmark", F.when(F.abs("spread_pct") > 10, NOTABLE).otherwise(MINOR), F.format_string("%+.1f%% against the benchmark", F.col("spread_pct"))))


def observe_weather(rows: DataFrame) -> DataFrame:
    """Frost first, then drought and excess rain by cut-offs 1.5 and 2.5, from the last known row."""
    last = latest(rows.where("dryness_z IS NOT NULL"))
    d, frost = F.col("dryness_z"), F.col("frost_7") > 0
    text = F.when(frost, "frost in the last week").when(d >= 2.5, "severe drought").when(d >= 1.5, "dry").when(d <= -1.5, "very wet").otherwise("near normal")
    level = F.when(frost | (d >= 2.5), NOTABLE).when((d >= 1.5) | (d <= -1.5), USUAL).otherwise(MINOR)
    return last.select(*observation("weather", level, text))


def forecast_totals(days: DataFrame) -> DataFrame:
    """Rain of 7 and 14 days, lowest temperature of 7, frost and dry days, by place; rows are in date order."""
    n = F.row_number().over(Window.partitionBy("place").orderBy("date"))
    d = days.withColumn("_n", n)
    wet = F.coalesce("precip", F.lit(0.0))
    return d.groupBy("place").agg(F.sum(F.when(F.col("_n") <= 7, wet)).alias("rain_7"), F.sum(F.when(F.col("_n") <= 14, wet)).alias("rain_14"), F.min(F.when(F.col("_n") <= 7, F.col("tmin"))).alias("tmin_7"), F.count_if(F.col("tmin") < 2).alias("frost_days"), F.count_if(wet < 1).alias("dry_days"))


def observe_forecast(totals: DataFrame) -> DataFrame:
    t = totals.withColumnRenamed("place", "series")
    text = F.when(F.col("frost_days") > 0, "frost ahead").when(F.col("tmin_7") < 5, "cold ahead").when(F.col("dry_days") >= 12, "dry ahead").when(F.col("rain_7") > 100, "heavy rain ahead").otherwise("nothing unusual ahead")
    level = F.when(F.col("frost_days") > 0, NOTABLE).when(text == "nothing unusual ahead", MINOR).otherwise(USUAL)
    return t.select(*observation("forecast", level, text))


def news_lean(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Up, down and neutral counts; a lean needs twice as many."""
    up, down = F.col("up"), F.col("down")
    out = docs.groupBy(*keys).agg(F.count_if(F.col("direction") == "up").alias("up"), F.count_if(F.col("direction") == "down").alias("down"), F.count_if(F.col("direction") == "neutral").alias("neutral"))
    return out.withColumn("lean", F.when((up > 0) & (up >= 2 * down), "up").when((down > 0) & (down >= 2 * up), "down").otherwise("mixed"))


def observe_news(leans: DataFrame) -> DataFrame:
    return leans.select(*observation("news", F.when(F.col("lean") == "mixed", MINOR).otherwise(USUAL), F.concat(F.lit("headlines "), "lean")))


def signal_vote(signals: DataFrame) -> DataFrame:
    """Sum of votes of -2 to 2, up at 2 and more, down at -2 and less, with the two strongest drivers."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.abs("vote")).alias("w"), F.col("factor"), F.col("vote"))))
    out = signals.groupBy("series").agg(F.sum("vote").alias("score"), ordered.alias("_o"))
    drivers = F.transform(F.slice(F.filter("_o", lambda x: x["vote"] != 0), 1, 2), lambda x: x["factor"])
    return out.select("series", "score", F.when(F.col("score") >= 2, "up").when(F.col("score") <= -2, "down").otherwise("sideways").alias("outlook"), F.array_join(drivers, ", ").alias("drivers"))


def agreement(signals: DataFrame) -> DataFrame:
    """Lean by strict majority of the given directions; confidence 0.80 where all agree, else 0.55."""
    out = signals.groupBy("series").agg(F.count_if(F.col("vote") > 0).alias("up"), F.count_if(F.col("vote") < 0).alias("down"))
    lean = F.when(F.col("up") > F.col("down"), "up").when(F.col("down") > F.col("up"), "down").otherwise("mixed")
    return out.withColumns({"lean": lean, "confidence": F.when((lean != "mixed") & (F.least("up", "down") == 0), 0.80).otherwise(0.55)})


def brief(parts: list[DataFrame]) -> DataFrame:
    """All observations in one table."""
    shape = ["series", "category", "importance", "text"]
    return reduce(DataFrame.unionByName, [p.select(*shape) for p in parts])


def alert(observations: DataFrame, most: int = 3) -> DataFrame:
    """Level and headline of each series: its most important observations up to ``most``."""
    w = Window.partitionBy("series").orderBy("importance", "category")
    chosen = observations.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") <= most) & (F.col("importance") <= USUAL))
    text = chosen.groupBy("series").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "text"))), lambda x: x["text"]), "; ").alias("headline"))
    level = observations.groupBy("series").agg(F.min("importance").alias("_i")).select("series", F.when(F.col("_i") == NOTABLE, "high").when(F.col("_i") == USUAL, "normal").otherwise("quiet").alias("level"))
    return level.join(text, "series", "left")


def card(layers: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row for each key with every layer as a struct, and the names of the layers that have no row."""
    out = None
    for name, layer in layers.items():
        part = layer.select(*keys, F.struct(*[c for c in layer.columns if c not in keys]).alias(name))
        out = part if out is None else out.join(part, keys, "full")
    missing = F.filter(F.array(*[F.when(F.col(n).isNull(), n) for n in layers]), lambda x: x.isNotNull())
    return out.withColumn("missing", F.array_join(missing, ","))


def seasons(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """The first calendar row (origin, ord, phase, risk, months) that holds the day's month."""
    met = days.withColumn("_m", F.month("date")).join(F.broadcast(calendar), F.array_contains("months", F.col("_m")))
    return met.groupBy("date", "origin").agg(F.min_by("phase", "ord").alias("phase"), F.min_by("risk", "ord").alias("risk"))


def observe_season(phases: DataFrame) -> DataFrame:
    """The newest phase of each origin, and what it risks; ``phases`` is (series, date, origin, phase, risk)."""
    last = phases.withColumn("_last", F.max("date").over(Window.partitionBy("series"))).where("date = _last")
    lines = F.array_sort(F.collect_list(F.struct("origin", F.concat("origin", F.lit(": "), "phase").alias("t"), "risk")))
    out = last.groupBy("series").agg(lines.alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["t"]), ". ")
    risks = F.array_join(F.array_distinct(F.filter(F.transform("_l", lambda x: x["risk"]), lambda r: r != "none")), ", ")
    calendar = out.select(*observation("season", F.lit(USUAL), text))
    return calendar.unionByName(out.where(risks != "").select(*observation("season risk", F.lit(USUAL), risks)))


def observe_analogs(week: DataFrame, month: DataFrame) -> DataFrame:
    """What followed alike days within a week and a month; both are outlooks of one target a series."""
    def way(median: str) -> Column:
        return F.when(F.col(median) > 0, "rose").otherwise("fell")

    both = week.select("series", F.col("median").alias("_w")).join(month.select("series", F.col("median").alias("_m")), "series")
    return both.select(*observation("analogs", F.lit(MINOR), F.concat(F.lit("after alike days the price "), way("_w"), F.lit(" in a week and "), way("_m"), F.lit(" in a month"))))


def signals(parts: dict[str, tuple[DataFrame, dict[str, str], str]]) -> DataFrame:
    """Named figures as rows (series, signal, figure, value, as_of, source).

    A part is its table, the columns to take by figure, and its source; as_of
    is the table's date where it has one. A series without a row in a part
    has no such signal.
    """
    rows = []
    for name, (table, figures, source) in parts.items():
        as_of = F.col("date").cast("string") if "date" in table.columns else F.lit(None).cast("string")
        each = F.array(*[F.struct(F.lit(f).alias("figure"), F.col(c).cast("double").alias("value")) for f, c in figures.items()])
        rows.append(table.select("series", F.lit(name).alias("signal"), F.explode(each).alias("_f"), as_of.alias("as_of")).select("series", "signal", "_f.figure", "_f.value", "as_of", F.lit(source).alias("source")))
    return reduce(DataFrame.unionByName, rows).where("value IS NOT NULL")


def page_text(html: str | Column) -> Column:
    """Readable text of a page: scripts, styles, comments and tags go, common entities are read, white space evens out."""
    x = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    x = F.regexp_replace(x, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def extracted_pages(pages: DataFrame, least: int = 200) -> DataFrame:
    """Page text with the reason of a failure."""
    out = pages.withColumn("text", page_text("html"))
    return out.withColumn("failure", F.when(F.coalesce("html", F.lit("")) == "", "no page").when(F.length("text") < least, "too little text"))


def weather_in_context(phase: Column, dryness_z: Column, frost: Column) -> Column:
    """What the weather means in the crop's phase; frost counts where the phase is at risk of it."""
    dry = F.when(dryness_z >= 2.5, "severe drought").when(dryness_z >= 1.5, "drought").when(dryness_z <= -1.5, "excess rain")
    tender = phase.isin("flowering", "development")
    return F.concat_ws("; ", F.when(frost & tender, F.concat(F.lit("frost during "), phase)), F.when(dry.isNotNull(), F.concat(dry, F.lit(" during "), phase)), F.when(~(frost & tender) & dry.isNull(), F.concat(F.lit("nothing unusual during "), phase)))


def currency_position(rates: DataFrame) -> DataFrame:
    """Week and month change of the newest rate, and its rank among the last 365 days in percent."""
    ends = rates.where("rate IS NOT NULL").groupBy("series").agg(F.max("date").alias("_last"), F.max_by("rate", "date").alias("rate"))
    met = rates.withColumnRenamed("rate", "_r").join(ends, "series")
    week, month = (F.max_by("_r", F.when((F.col("date") <= F.date_sub("_last", n)) & F.col("_r").isNotNull(), F.col("date"))) for n in (7, 30))
    year = F.col("date") >= F.date_sub("_last", 365)
    out = met.groupBy("series", "rate").agg(week.alias("_w"), month.alias("_m"), F.avg(F.when(year, (F.col("_r") < F.col("rate")).cast("double"))).alias("_below"))
    return out.select("series", "rate", (ratio("rate", "_w") - 1).alias("week_change"), (ratio("rate", "_m") - 1).alias("month_change"), (100 * F.col("_below")).alias("percentile"))


def observe_currency(position: DataFrame) -> DataFrame:
    p = F.col("percentile")
    text = F.when(p >= 85, "near its year's high").when(p <= 15, "near its year's low").otherwise("within its range")
    return position.select(*observation("currency", F.when((p >= 85) | (p <= 15), USUAL).otherwise(MINOR), text))
