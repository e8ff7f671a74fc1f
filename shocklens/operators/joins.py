"""Joins over series and dates: as-of, interval, aligned, pairwise, and look-ups by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shocklens.functions.numbers import draw, ratio


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """``left`` with the latest ``values`` of ``right`` known at or before ``left_at``, within the keys ``on``.

    One shuffle by the keys: both sides are put in one order and the last
    right row is carried forward; at equal times right rows come first.
    """
    held = F.struct(*[F.col(v) for v in values]).alias("_held")
    ours = left.select(*on, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(held).schema[0].dataType).alias("_held"))
    theirs = right.where(F.col(right_at).isNotNull()).select(*on, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"), held)
    order = Window.partitionBy(*on).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = ours.unionByName(theirs).withColumn("_held", F.last("_held", ignorenulls=True).over(order))
    return carried.where("_side = 1").select("_row.*", *(F.col(f"_held.{v}").alias(v) for v in values))


def in_events(days: DataFrame, events: DataFrame) -> DataFrame:
    """A row for each day and event window (series, label, start, end) that holds it; the windows are a fixed list."""
    e = F.broadcast(events.select(F.col("series").alias("_s"), "label", "start", "end"))
    return days.join(e, (F.col("series") == F.col("_s")) & F.col("date").between(F.col("start"), F.col("end"))).drop("_s")


def place_of(days: DataFrame, events: DataFrame, control: DataFrame) -> DataFrame:
    """Adds place: event, control or elsewhere."""
    marks = events.select("series", "start", "end", F.lit("event").alias("_place")).unionByName(control.select("series", "start", "end", F.lit("control").alias("_place")))
    held = in_events(days.select("series", "date"), marks.withColumnRenamed("_place", "label")).groupBy("series", "date").agg(F.max("label").alias("_place"))
    return days.join(held, ["series", "date"], "left").withColumn("place", F.coalesce("_place", F.lit("elsewhere"))).drop("_place")


def complete_cases(returns: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """Returns (series, date, y) beside the factors of the date, rows with a null left out."""
    return returns.join(factors, "date").dropna(subset=["y", *names])


def aligned_flags(flags: DataFrame, names: list[str]) -> DataFrame:
    """One row for each date, a nullable flag for each series: null means no data, never calm."""
    return flags.groupBy("date").pivot("series", names).agg(F.first("flag", ignorenulls=True))


def pair_overlap(flags: DataFrame) -> DataFrame:
    """For each pair of series: common days, days both flagged, Jaccard. Pairs are of series, met date by date."""
    a = flags.where(F.col("flag").isNotNull()).select("date", F.col("series").alias("a"), F.col("flag").alias("fa"))
    b = a.select("date", F.col("a").alias("b"), F.col("fa").alias("fb"))
    both = a.join(b, "date").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common_days"), F.count_if(F.col("fa") & F.col("fb")).alias("both"), F.count_if(F.col("fa") | F.col("fb")).alias("either"))
    return both.withColumn("jaccard", ratio("both", "either"))


def macro_votes(flags: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Of each series' flagged days with at least k others judged, the share on which k others were flagged too."""
    w = Window.partitionBy("date")
    own = F.coalesce(F.col("flag").cast("int"), F.lit(0))
    others = F.coalesce(F.sum(F.col("flag").cast("int")).over(w), F.lit(0)) - own
    judged = F.count("flag").over(w) - F.col("flag").isNotNull().cast("int")
    rows = flags.withColumns({"_others": others, "_judged": judged}).where("flag")
    rows = rows.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("_judged") >= F.col("k"))
    return rows.groupBy("series", "k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_others") >= F.col("k")).alias("macro")).withColumn("share", ratio("macro", "n"))


def as_one(flags: DataFrame, groups: Column) -> DataFrame:
    """Substitute series counted as one: flagged if any is, judged if any is."""
    return flags.groupBy("date", groups.alias("series")).agg(F.bool_or("flag").alias("flag"))


def spread(prices: DataFrame, benchmark: str = "benchmark", per: float = 100 / 2.20462) -> DataFrame:
    """Percent by which the price lies above the benchmark converted to its unit."""
    converted = F.col(benchmark) * per
    return prices.withColumn("spread_pct", 100 * ratio(F.col("price") - converted, converted))


def currency_rows(returns: DataFrame, fx: DataFrame, names: list[str]) -> DataFrame:
    """Long (series, date, currency, y, fx_return) of a return and every rate's log change."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return returns.join(fx, "date").selectExpr("series", "date", "y", f"stack({len(names)}, {pairs}) AS (currency, fx_return)").dropna()


def donors(days: DataFrame, least_days: int = 60, seed: int = 11) -> DataFrame:
    """For each flagged day another of the same series and direction at least ``least_days`` away, by seeded draw.

    All days far enough before or after are candidates, and each is drawn alike;
    only a day without any is left out.
    """
    group = Window.partitionBy("series", "direction")
    order = group.orderBy("_day")
    ranked = days.select("series", "direction", "date").distinct().withColumn("_day", F.unix_date(F.col("date").cast("date")))
    ranked = ranked.withColumns({
        "_i": F.row_number().over(order),
        "_before": F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, -least_days)),
        "_near": F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, least_days - 1)),
        "_n": F.count(F.lit(1)).over(group),
    })
    far = ranked.withColumn("_far", F.col("_before") + F.col("_n") - F.col("_near")).where("_far > 0")
    drawn = far.withColumn("_k", F.pmod(draw(seed, "series", "direction", "date"), F.col("_far")) + 1)
    drawn = drawn.select("series", "direction", "date", F.expr("int(if(_k <= _before, _k, _near + _k - _before))").alias("_i"))
    return drawn.join(ranked.select("series", "direction", "_i", F.col("date").alias("donor")), ["series", "direction", "_i"]).drop("_i")


def shifted_documents(pairs: DataFrame, documents: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """The donor's documents dated anew by the gap between the two days; without keys a document is of every series."""
    d = documents.withColumnRenamed("date", "donor")
    return pairs.join(d, [*keys, "donor"]).withColumn("published", F.expr("date_add(published, datediff(date, donor))"))


def label_runs(labels: DataFrame, runs: DataFrame, on: list[str]) -> DataFrame:
    """Every label, with its run where there is one."""
    return labels.join(runs.withColumn("has_run", F.lit(True)), on, "left").withColumn("has_run", F.coalesce("has_run", F.lit(False)))


def model_agreement(readings: DataFrame) -> DataFrame:
    """For each pair of models: documents both read, and those read in the same direction."""
    a = readings.select("date", "document_id", F.col("model").alias("a"), F.col("direction").alias("da"))
    b = readings.select("date", "document_id", F.col("model").alias("b"), F.col("direction").alias("db"))
    met = a.join(b, ["date", "document_id"]).where("a < b")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.count_if(F.col("da").eqNullSafe(F.col("db"))).alias("same")).withColumn("agreement", ratio("same", "common"))


def rebuilt_text(sources: DataFrame, texts: DataFrame) -> DataFrame:
    """Sources with their stored text; a date with any missing or changed text is given up as a whole."""
    joined = sources.join(texts, "document_id", "left").withColumn("_ok", F.coalesce(F.length("text") == F.col("text_chars"), F.lit(False)))
    return joined.withColumn("_all", F.bool_and("_ok").over(Window.partitionBy("date"))).where("_all").drop("_ok", "_all")


def citation_documents(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims with their cited document; id_found is false for an id nobody showed."""
    known = documents.withColumn("id_found", F.lit(True))
    return citations.join(known, ["run_id", "document_id"], "left").withColumn("id_found", F.coalesce("id_found", F.lit(False)))


def wide_returns(levels: DataFrame, names: list[str]) -> DataFrame:
    """Log changes of every name over the union of all dates; a hole nulls the changes on both its sides."""
    wide = levels.groupBy("date").pivot("name", names).agg(F.first("value", ignorenulls=True))
    # One row for each calendar day of the whole table: bounded by the calendar, not by the data.
    one = Window.orderBy("date")
    logs = {n: F.when(F.col(n) > 0, F.ln(n)) for n in names}
    return wide.select("date", *((x - F.lag(x).over(one)).alias(n) for n, x in logs.items()))


def per_dollar(levels: DataFrame, inverted: list[str]) -> DataFrame:
    """Rates as foreign units for a dollar: those quoted the other way are turned over; a rate of zero is left out."""
    turned = F.when(F.col("name").isin(*inverted), ratio(F.lit(1.0), F.nullif(F.col("value"), F.lit(0.0)))).otherwise(F.nullif(F.col("value"), F.lit(0.0)))
    return levels.withColumn("value", turned).where("value IS NOT NULL")


def dollar_basket(rates: list[str], least: int = 2) -> Column:
    """Mean of the available log changes of the rates, null below ``least``."""
    seen = F.filter(F.array(*map(F.col, rates)), lambda x: x.isNotNull())
    return F.when(F.size(seen) >= least, F.aggregate(seen, F.lit(0.0), lambda s, x: s + x) / F.size(seen))


