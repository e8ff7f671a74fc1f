"""Scoring of flags and decisions against labels."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shocklens.functions.numbers import by_series, draw, let, rate, ratio
from shocklens.operators.joins import in_events

# The thresholds of a sweep.
THRESHOLDS = (1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0, 3.5, 4.0)


def flag_rates(df: DataFrame) -> DataFrame:
    """Days, scorable days, flagged days and the flag rate of each series."""
    out = df.groupBy("series").agg(F.count(F.lit(1)).alias("days"), F.count("rolling_std").alias("scorable"), F.count_if("anomaly_flag").alias("flagged"), F.count_if("daily_anomaly_flag").alias("daily_flagged"))
    return out.withColumn("flag_rate", ratio("flagged", "scorable"))


def threshold_sweep(df: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Flagged days at each threshold, from the stored z-scores."""
    rows = df.select("series", "z_score", "cumulative_z_score", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    daily, built = (F.coalesce(F.abs(z) >= F.col("threshold"), F.lit(False)) for z in ("z_score", "cumulative_z_score"))
    out = rows.groupBy("series", "threshold").agg(F.count("z_score").alias("scorable"), F.count_if(daily | built).alias("flagged"), F.count_if(daily & ~built).alias("daily_only"))
    return out.withColumns({"flag_rate": ratio("flagged", "scorable"), "daily_only_rate": ratio("daily_only", "scorable")})


def event_recall(df: DataFrame, events: DataFrame) -> DataFrame:
    """For each event: judged days, flagged days, largest |z| and the highest threshold it survives."""
    rows = in_events(df.select("series", "date", "rolling_std", "anomaly_flag", "z_score", "cumulative_z_score"), events)
    peak = F.greatest(F.coalesce(F.abs("z_score"), F.lit(0.0)), F.coalesce(F.abs("cumulative_z_score"), F.lit(0.0)))
    found = rows.groupBy("series", "label").agg(F.count("rolling_std").alias("judged"), F.count_if("anomaly_flag").alias("flagged"), F.max(peak).alias("peak"))
    survives = F.array_max(F.filter(F.array(*map(F.lit, THRESHOLDS)), lambda t: t <= F.col("peak")))
    out = events.select("series", "label").join(found, ["series", "label"], "left")
    return out.withColumns({"detected": F.when(F.col("judged") > 0, F.col("flagged") > 0), "survives": survives})


def density(placed: DataFrame) -> DataFrame:
    """Flagged share inside events over the base rate, and control false positives; rows have place."""
    judged = F.col("rolling_std").isNotNull()
    inside, flagged = F.col("place") == "event", F.col("anomaly_flag")
    out = placed.groupBy("series").agg(
        F.count_if(judged).alias("judged"), F.count_if(flagged).alias("flagged"), F.count_if(judged & inside).alias("event_days"), F.count_if(flagged & inside).alias("event_flagged"),
        F.count_if(flagged & (F.col("place") == "control")).alias("control_flagged"), F.count_if(flagged & (F.col("place") == "elsewhere")).alias("elsewhere_flagged"))
    out = out.withColumns({"density": ratio("event_flagged", "event_days"), "base_rate": ratio("flagged", "judged")})
    return out.withColumn("lift", ratio("density", "base_rate"))


def chance_of_a_flag(df: DataFrame, length: int, judged_only: bool = True) -> DataFrame:
    """Share of all full windows of ``length`` rows that hold a flag, by series."""
    rows = df.where(F.col("rolling_std").isNotNull()) if judged_only else df
    frame = by_series().rowsBetween(-(length - 1), 0)
    held = rows.withColumns({"_any": F.max(F.col("anomaly_flag").cast("int")).over(frame), "_n": F.count(F.lit(1)).over(frame)}).where(F.col("_n") == length)
    return held.groupBy("series").agg(F.count(F.lit(1)).alias("windows"), F.avg("_any").alias("chance"))


def robust_spread(df: DataFrame, value: str, *keys: str, least: int = 8) -> DataFrame:
    """n, quartiles and the share above zero; below ``least`` values only n."""
    enough = F.count(value) >= least
    q = F.when(enough, F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), q.alias("_q"), F.when(enough, F.avg((F.col(value) > 0).cast("double"))).alias("share_up"))
    return out.select(*keys, "n", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3"), "share_up")


def definition_summary(df: DataFrame, share: float = 0.9) -> DataFrame:
    """The flags beside a plain definition, moves above a quantile of the series' own size."""
    size = F.abs("return_pct")
    bars = df.groupBy("series").agg(F.percentile(size, F.lit(share)).alias("bar"))
    rows = df.join(bars, "series").withColumn("material", F.coalesce(size >= F.col("bar"), F.lit(False)))
    f, m, kind = F.col("anomaly_flag"), F.col("material"), F.col("anomaly_type")
    out = rows.groupBy("series").agg(
        F.count_if(f).alias("flagged"), F.count_if(kind == "shock").alias("shock"), F.count_if(kind == "trend").alias("trend"), F.count_if(kind == "shock+trend").alias("both_kinds"),
        F.count_if(m).alias("material"), F.count_if(f & m).alias("both"), F.count_if(m & ~f).alias("material_only"), F.count_if(f & ~m).alias("flagged_only"), F.count_if(f | m).alias("either"))
    return out.withColumn("jaccard", ratio("both", "either")).drop("either")


def regime_medians(df: DataFrame) -> DataFrame:
    """Median forward volatility after a flag, after any day and after a large unflagged move."""
    bars = df.groupBy("series").agg(F.percentile(F.abs("return_pct"), F.lit(0.9)).alias("bar"))
    rows = df.join(bars, "series")
    large = (F.abs("return_pct") >= F.col("bar")) & ~F.col("anomaly_flag")
    out = rows.groupBy("series").agg(F.median("forward_vol").alias("any_day"), F.median(F.when(F.col("anomaly_flag"), F.col("forward_vol"))).alias("after_flag"), F.median(F.when(large, F.col("forward_vol"))).alias("large_unflagged"))
    return out.withColumn("lift", ratio("after_flag", "any_day"))


def errors(df: DataFrame, actual: str, forecast: str, *keys: str) -> DataFrame:
    e = F.col(actual) - F.col(forecast)
    return df.groupBy(*keys).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def confusion(df: DataFrame, predicted: Column, actual: Column, *keys: str) -> DataFrame:
    """tp, fp, fn, tn with precision, recall, F1, specificity and balanced accuracy."""
    p, a = predicted, actual
    out = df.groupBy(*keys).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    out = out.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn")), "specificity": ratio("tn", F.col("tn") + F.col("fp"))})
    return out.withColumns({"f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2})


def score_curve(df: DataFrame, score: str = "score", relevant: str = "relevant", *keys: str) -> DataFrame:
    """Precision, recall and F1 with every observed score as threshold.

    Rows are counted by distinct score first, so ties are one threshold and
    the ordered part has a row for each score only.
    """
    steps = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"), F.count_if(relevant).alias("_r"))
    above = Window.partitionBy(*keys).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    out = steps.withColumns({"flagged": F.sum("_n").over(above), "tp": F.sum("_r").over(above), "_all": F.sum("_r").over(whole)})
    out = out.withColumns({"precision": ratio("tp", "flagged"), "recall": ratio("tp", "_all"), "f1": ratio(2 * F.col("tp"), F.col("flagged") + F.col("_all"))})
    return out.select(*keys, F.col(score).alias("threshold"), "flagged", "tp", "precision", "recall", "f1")


def best_thresholds(curve: DataFrame, *keys: str, precision: float = 0.9, least: int = 2) -> DataFrame:
    """The threshold of the best F1, and the lowest one of sufficient precision."""
    fits = (F.col("precision") >= precision) & (F.col("flagged") >= least)
    return curve.groupBy(*keys).agg(F.max_by("threshold", F.struct("f1", "threshold")).alias("best_f1_threshold"), F.max("f1").alias("best_f1"), F.min(F.when(fits, F.col("threshold"))).alias("precise_threshold"))


def left_out_selection(df: DataFrame, fold: str, score: str = "score", relevant: str = "relevant") -> DataFrame:
    """Best-F1 threshold of all other folds, applied to the fold left out, pooled into one confusion row.

    The curve of all other folds is the whole curve less the fold's own counts,
    which differ at the fold's own scores only: rows are distinct scores times
    folds, and the own counts meet them by fold and score.
    """
    steps = df.where(F.col(score).isNotNull()).groupBy(fold, score).agg(F.count(F.lit(1)).alias("_n"), F.count_if(relevant).alias("_r"))
    whole = steps.groupBy(score).agg(F.sum("_n").alias("_wn"), F.sum("_r").alias("_wr"))
    names = steps.agg(F.collect_set(fold).alias("_folds"))  # one row with the stated folds
    every = whole.crossJoin(F.broadcast(names)).select(score, "_wn", "_wr", F.explode("_folds").alias("_out"))
    own = steps.select(F.col(fold).alias("_out"), score, "_n", "_r")
    train = every.join(own, ["_out", score], "left").select("_out", score, (F.col("_wn") - F.coalesce("_n", F.lit(0))).alias("_n"), (F.col("_wr") - F.coalesce("_r", F.lit(0))).alias("_r")).where("_n > 0")
    above = Window.partitionBy("_out").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    curve = train.withColumns({"_flagged": F.sum("_n").over(above), "_tp": F.sum("_r").over(above), "_all": F.sum("_r").over(Window.partitionBy("_out"))})
    chosen = curve.groupBy("_out").agg(F.max_by(score, F.struct(ratio(2 * F.col("_tp"), F.col("_flagged") + F.col("_all")).alias("f"), F.col(score).alias("s"))).alias("_cut"))
    tested = steps.join(chosen, F.col(fold) == F.col("_out"))
    hit = F.col(score) >= F.col("_cut")
    out = tested.agg(F.sum(F.when(hit, F.col("_r")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("_n") - F.col("_r")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("_r")).otherwise(0)).alias("fn"))
    return out.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn"))})


def auc(df: DataFrame, *keys: str, score: str = "score", relevant: str = "relevant") -> DataFrame:
    """Chance that a relevant row outscores another one, ties half, from counts by score."""
    steps = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col(relevant)).alias("_p"), F.count_if(~F.col(relevant)).alias("_n"))
    below = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("_p") * (F.coalesce(F.sum("_n").over(below), F.lit(0)) + F.col("_n") / 2)
    out = steps.withColumn("_won", won).groupBy(*keys).agg(F.sum("_p").alias("n_relevant"), F.sum("_n").alias("n_other"), F.sum("_won").alias("_w"))
    return out.select(*keys, "n_relevant", "n_other", ratio("_w", F.col("n_relevant").cast("double") * F.col("n_other")).alias("auc"))


def top_k_scores(df: DataFrame, group: str, k: int, order: list[Column], relevant: str = "relevant") -> DataFrame:
    """Precision and recall at k and the reciprocal rank of each group with at least k rows and a relevant one."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    r = F.col(relevant)
    by = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(r).alias("_all"), F.count_if(r & (F.col("_rn") <= k)).alias("_hit"), F.min(F.when(r, F.col("_rn"))).alias("_first"))
    by = by.where((F.col("n") >= k) & (F.col("_all") > 0))
    return by.select(group, (F.col("_hit") / k).alias("precision_at_k"), ratio("_hit", "_all").alias("recall_at_k"), (1 / F.col("_first")).alias("reciprocal_rank"))


def poisson_steps(most: int = 18) -> list[int]:
    """For k = 0, 1, ...: the draw of 60 bits from which on a Poisson variable of mean 1 is above k."""
    terms = [math.exp(-1) / math.factorial(k) for k in range(most)]
    return [round(math.fsum(terms[: k + 1]) * (1 << 60)) for k in range(most)]


def bootstrap_auc(df: DataFrame, group: str, samples: int = 2000, seed: int = 11, score: str = "score", relevant: str = "relevant") -> DataFrame:
    """2.5 and 97.5 % order statistics of the AUC over resamples of whole groups.

    A resample holds every group a Poisson number of times, which a seeded
    draw from the group's own name gives wherever its rows lie: no draw is
    dealt out or joined, and the counts by (sample, score) are summed before
    they move. Resamples without both classes have no AUC and do not count.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(group, score).agg(F.count_if(F.col(relevant)).alias("_p"), F.count_if(~F.col(relevant)).alias("_n"))
    # Small counts make many rows: they are dealt out first, by number, so that they are not put back into one task.
    dealt = counts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, score)
    steps = F.array(*[F.lit(t).cast("long") for t in poisson_steps()])
    times = let(draw(seed, "sample", group), lambda u: F.size(F.filter(steps, lambda t: u >= t)))
    drawn = dealt.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("_times", times)
    # Groups drawn no time add nothing, so no filter takes the draw apart.
    rows = drawn.groupBy("sample", score).agg(F.sum(F.col("_p") * F.col("_times")).alias("_p"), F.sum(F.col("_n") * F.col("_times")).alias("_n"))
    below = Window.partitionBy("sample").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("_p") * (F.coalesce(F.sum("_n").over(below), F.lit(0)) + F.col("_n") / 2)
    each = rows.withColumn("_w", won).groupBy("sample").agg(ratio(F.sum("_w"), F.sum("_p").cast("double") * F.sum("_n")).alias("auc")).where("auc IS NOT NULL")
    return each.agg(F.count(F.lit(1)).alias("samples"), F.percentile("auc", F.lit(0.025)).alias("lo"), F.percentile("auc", F.lit(0.975)).alias("hi"))


def permutation_test(df: DataFrame, trials: int = 1000, seed: int = 11) -> DataFrame:
    """The flags' precision in events beside random flags of the same number, by series.

    ``df`` has flag and inside (an event day). The event days that a random
    detector hits are a hypergeometric draw from a series' three counts, so a
    trial is one row, whatever the number of days.
    """
    n = df.groupBy("series").agg(F.count_if("flag").alias("n_flags"), F.count_if(F.col("flag") & F.col("inside")).alias("hits"), F.count_if("inside").alias("inside_days"), F.count(F.lit(1)).alias("_days"))
    trial = n.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("_seed", draw(seed, "series", "trial"))

    @F.arrow_udf("long")
    def hit(inside: pa.Array, days: pa.Array, flags: pa.Array, seeds: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (inside, days, flags, seeds)), strict=True)
        return pa.array([int(np.random.default_rng(s).hypergeometric(i, d - i, f)) for i, d, f, s in rows], pa.int64())

    each = trial.withColumn("random_hits", hit("inside_days", "_days", "n_flags", "_seed"))
    out = each.groupBy("series").agg(F.avg(ratio("random_hits", "n_flags")).alias("random_precision"), F.avg((F.col("random_hits") < F.col("hits")).cast("double")).alias("share_beaten"))
    return n.drop("_days").withColumn("precision", ratio("hits", "n_flags")).join(out, "series")


def kappa(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Cohen's kappa of two answers; null where chance alone agrees fully."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    rows = cells.groupBy(*keys, F.col("_a").alias("_v")).agg(F.sum("_n").alias("_na"))
    columns = cells.groupBy(*keys, F.col("_b").alias("_v")).agg(F.sum("_n").alias("_nb"))
    totals = cells.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("agree"))
    chance = rows.join(columns, [*keys, "_v"]).groupBy(*keys).agg(F.sum(F.col("_na") * F.col("_nb")).alias("_e"))
    out = totals.join(chance, list(keys), "left") if keys else totals.crossJoin(chance)
    observed, expected = ratio("agree", "n"), F.coalesce(ratio("_e", F.col("n") * F.col("n")), F.lit(0.0))
    return out.select(*keys, "n", "agree", ratio(observed - expected, F.when(expected < 1, 1 - expected)).alias("kappa"))


def tier_counts(runs: DataFrame, tier: str, *keys: str) -> DataFrame:
    """Runs by tier with their rate and interval."""
    counts = runs.groupBy(*keys, tier).agg(F.count(F.lit(1)).alias("runs"))
    total = F.sum("runs").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    return counts.withColumn("_n", total).select(*keys, tier, "runs", rate("runs", "_n").alias("rate"))


def distribution(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, median, 90th percentile and largest of a cost or time."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9)))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), q.alias("_q"), F.max(value).alias("largest"), F.sum(value).alias("total")).select(*keys, "n", F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p90"), "largest", "total")
