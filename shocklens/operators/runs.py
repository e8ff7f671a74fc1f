"""Evaluation of stored runs: verdicts, states, rates, and what each decision rested on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shocklens.functions.numbers import rate, ratio
from shocklens.operators.documents import guard_fires


def verdicts(runs: DataFrame) -> DataFrame:
    """EXPLAINED, REFUSED or FAULT, before and after the direction guard under either rule; blind runs have no guard."""
    plain = F.when(F.col("is_fault"), "FAULT").when(F.startswith("tier", F.lit("EXPLAINED")), "EXPLAINED").otherwise("REFUSED")
    model = F.when(F.col("withheld"), "EXPLAINED").otherwise(plain)
    out = runs.withColumns({"verdict": plain, "model_verdict": model})
    for name, ties in (("guarded", False), ("guarded_ties", True)):
        fires = ~F.col("blind") & (F.col("model_verdict") == "EXPLAINED") & guard_fires(F.col("consistent"), F.col("inconsistent"), ties)
        out = out.withColumn(name, F.when(fires, "REFUSED").otherwise(F.col("model_verdict")))
    return out


def run_state(planned: DataFrame, runs: DataFrame, version: int) -> DataFrame:
    """missing, stale, fault or current for every planned (series, day)."""
    joined = planned.join(runs.select("series", "day", "pipeline_version", "is_fault"), ["series", "day"], "left")
    return joined.withColumn("state", F.when(F.col("pipeline_version").isNull(), "missing").when(F.col("pipeline_version") < version, "stale").when(F.col("is_fault"), "fault").otherwise("current"))


def complete_days(requests: DataFrame) -> DataFrame:
    """Days whose every planned request has an answer, with what is still waited for elsewhere."""
    return requests.groupBy("series", "day").agg(F.count(F.lit(1)).alias("planned"), F.count_if(~F.col("answered")).alias("waiting")).withColumn("complete", F.col("waiting") == 0)


def refusal_reason(runs: DataFrame) -> DataFrame:
    """Where refused runs stopped: no documents, the gate, or the reading."""
    why = F.when(F.col("considered") == 0, "no documents").when(F.col("gate_decision") != "EXPLAIN", "gate").otherwise("reading")
    return runs.where("is_refusal").withColumn("stopped_at", why)


def without_scores(docs: DataFrame) -> DataFrame:
    """Days with documents of which none has a semantic score: a fault of the scoring, not of the market."""
    out = docs.groupBy("series", "day").agg(F.count(F.lit(1)).alias("documents"), F.count("semantic_score").alias("scored"))
    return out.where((F.col("documents") > 0) & (F.col("scored") == 0))


def counted(runs: DataFrame, excluded: DataFrame) -> DataFrame:
    """Runs that count: decided, no fault, not on an excluded day."""
    return runs.where(F.col("decision").isNotNull() & ~F.col("is_fault")).join(excluded, ["series", "day"], "left_anti")


def decision_scores(judged: DataFrame, columns: list[str]) -> DataFrame:
    """Accuracy of each verdict column against expected (EXPLAIN or REFUSE), faults left out, with balanced accuracy."""
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    long = judged.selectExpr("expected", f"stack({len(columns)}, {pairs}) AS (system, said)").where("said <> 'FAULT' AND expected IN ('EXPLAIN', 'REFUSE')")
    yes, want = F.col("said") == "EXPLAINED", F.col("expected") == "EXPLAIN"
    out = long.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count_if(yes == want).alias("right"), F.count_if(want).alias("to_explain"), F.count_if(want & yes).alias("explained"), F.count_if(~want).alias("to_refuse"), F.count_if(~want & ~yes).alias("refused"))
    return out.withColumns({"accuracy": ratio("right", "n"), "balanced_accuracy": (ratio("explained", "to_explain") + ratio("refused", "to_refuse")) / 2})


def baselines(judged: DataFrame) -> DataFrame:
    """Verdict columns of simple rules: always explain, the gate alone, the evidence's direction alone, never refuse where anything was found."""
    lean = F.coalesce("consistent", F.lit(0)) > F.coalesce("inconsistent", F.lit(0))
    return judged.withColumns({
        "always_explain": F.lit("EXPLAINED"), "gate_only": F.when(F.col("gate_decision") == "EXPLAIN", "EXPLAINED").otherwise("REFUSED"), "direction_only": F.when(lean, "EXPLAINED").otherwise("REFUSED"),
        "never_refuse": F.when(F.coalesce("considered", F.lit(0)) > 0, "EXPLAINED").otherwise("REFUSED")})


def citation_statistics(citations: DataFrame) -> DataFrame:
    """Totals by flag, and the spread of the support scores."""
    return citations.agg(
        F.count(F.lit(1)).alias("citations"), F.count_if(F.col("flag") == "missing_document").alias("missing"), F.count_if(F.col("flag") == "weak_support").alias("weak"), F.count_if(F.col("flag") == "low_rank").alias("low_rank"),
        F.min("support").alias("least_support"), F.median("support").alias("median_support"))


def evidence_statistics(sources: DataFrame, *keys: str) -> DataFrame:
    """Documents, distinct stories, duplicate share, share after the day, hosts."""
    out = sources.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents"), F.count_distinct(F.coalesce(F.nullif(F.col("title_key"), F.lit("")), F.col("url"))).alias("stories"), F.count_if(F.col("age") < 0).alias("after_day"), F.count_distinct("host").alias("hosts"))
    return out.withColumns({"duplicate_share": 1 - ratio("stories", "documents"), "after_share": ratio("after_day", "documents")})


def recency(sources: DataFrame, *keys: str) -> DataFrame:
    """Dated documents, fresh ones, the newest and the median age."""
    return sources.groupBy(*keys).agg(F.count("age").alias("dated"), F.count_if(F.col("age").between(0, 2)).alias("fresh"), F.min("age").alias("newest"), F.median("age").alias("median_age"))


def search_yield(sources: DataFrame) -> DataFrame:
    """For each search: documents found, usable and deciding, and the days decided by them."""
    return sources.select(F.explode("found_by").alias("search"), "series", "day", "usable", "deciding").groupBy("search").agg(
        F.count(F.lit(1)).alias("found"), F.count_if("usable").alias("usable"), F.count_if("deciding").alias("deciding"), F.count_distinct(F.when(F.col("deciding"), F.struct("series", "day"))).alias("days_decided"))


def direction_statistics(runs: DataFrame, *keys: str) -> DataFrame:
    """Runs whose evidence leans with the move, with the rate's interval."""
    out = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.coalesce("consistent", F.lit(0)) > F.coalesce("inconsistent", F.lit(0))).alias("leaning"))
    return out.withColumn("rate", rate("leaning", "runs"))


def explained_rates(runs: DataFrame, *conditions: str) -> DataFrame:
    """Explained runs of each condition, as a rate."""
    out = runs.groupBy(*conditions).agg(F.count_if(F.col("verdict") == "EXPLAINED").alias("explained"), F.count_if(F.col("verdict") != "FAULT").alias("n"))
    return out.withColumn("rate", rate("explained", "n"))


def term_coverage(found: Column, wanted: Column) -> Column:
    """Share of the wanted terms among those found; null where none is wanted."""
    return ratio(F.size(F.array_intersect(wanted, found)), F.size(wanted))


def tagged(value: Column, tag: str, source: str, note: str = "") -> Column:
    """struct(value, tag, source, note); only observed, tested and hypothesis are tags."""
    if tag not in ("observed", "tested", "hypothesis"):
        raise ValueError(f"unknown tag {tag}")
    return F.struct(value.alias("value"), F.lit(tag).alias("tag"), F.lit(source).alias("source"), F.lit(note).alias("note"))
