"""The decision stage over tables, and studies that run it again under other settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shocklens.functions import text as T
from shocklens.functions.numbers import rate, ratio
from shocklens.operators import citations, documents
from shocklens.operators.documents import FRESH

KEYS = ["series", "day"]
# The settings of the rule that are compared, and the gate's configurations (keyword bar, semantic bar, floor).
SETTINGS = (("freshest", 2), ("freshest", 1), ("freshest", 3), ("pooled", 2))
GATES = {"full_pipeline": ("dual", 0.4, 0.85), "semantic_only": ("semantic_only", 0.4, 0.85), "keyword_only": ("keyword_only", 0.4, 0.85), "no_gate": ("dual", 0.0, 0.0), "semantic_0.80": ("dual", 0.4, 0.80), "semantic_0.90": ("dual", 0.4, 0.90)}


def decision_stage(days: DataFrame, docs: DataFrame, readings: DataFrame, variants: tuple[str, ...] = (), rule: str = "freshest", fresh: int = FRESH, least_shown: int = 6) -> DataFrame:
    """Gate, candidates, decision rule, citation audit and outcome of all days in one plan.

    ``days`` is (series, day, direction, move, price_is_usable, retrieval_ran),
    ``docs`` has scores, age and text, ``readings`` one row for each document
    that was read. Only readings of candidates count. The causes of the
    supporting readings are the claims, audited against the candidates' texts;
    one without a cause is no claim.
    A day whose move cannot be computed is a fault and nothing of it is
    explained; a day without documents is refused, or a failed retrieval.
    """
    gated = documents.gate(days.select(*KEYS).join(docs, KEYS, "left"), KEYS).withColumnsRenamed({"decision": "gate_decision", "reason": "gate_reason"})
    found = docs.groupBy(*KEYS).agg(F.count_if(F.col("age").between(0, fresh)).alias("retrieved_recent"))
    candidates = documents.reading_candidates(docs)
    offered = candidates.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("passed_gate").alias("candidates_passed"))
    read = readings.drop("passed_gate").join(candidates.select(*KEYS, "document_id", "passed_gate"), [*KEYS, "document_id"])
    decided = documents.decide(days, read, variants, rule, fresh).drop("direction", "move", "price_is_usable", "retrieval_ran").withColumnsRenamed({"decision": "_rule", "reason": "rule_reason"})

    run = F.concat_ws("|", *[F.col(k).cast("string") for k in KEYS])
    cited = documents.deciding_readings(days, read, variants, rule, fresh).where("along AND fitting")
    claims = cited.select(*KEYS, run.alias("run_id"), F.col("document_id").cast("string").alias("claim_id"), F.col("cause").alias("claim"), F.col("document_id").cast("string").alias("cited_id"))
    shown = candidates.select(run.alias("run_id"), F.col("document_id").cast("string").alias("document_id"), "text")
    audit = citations.citation_audit(claims, shown, least_shown=least_shown).join(claims.select(*KEYS, "run_id").distinct(), "run_id")
    audit = audit.groupBy(*KEYS).agg(F.count_if(F.col("flag") == "missing_document").alias("_missing"), F.count_if(F.col("flag").isin("weak_support", "low_rank")).alias("citations_flagged"))

    out = days.join(gated, KEYS).join(found, KEYS, "left").join(offered, KEYS, "left").join(decided, KEYS).join(audit, KEYS, "left")
    out = out.fillna(0, ["retrieved_recent", "candidates", "candidates_passed", "citations_flagged", "_missing"])
    usable, made = F.coalesce("price_is_usable", F.lit(True)), F.col("candidates") > 0
    out = out.withColumns({
        "reading_made": made, "consistent": F.col("supporting"), "inconsistent": F.col("opposing"), "citations_resolve": F.col("_missing") == 0, "retrieval_ran": F.coalesce("retrieval_ran", F.lit(True)),
        "call_state": F.when(usable, "OK").otherwise("API_ERROR"), "decision": F.when(made & (F.col("_rule") == "EXPLAIN"), "EXPLAIN").otherwise("INSUFFICIENT_EVIDENCE"),
        "reason": F.when(~usable, "price_not_positive_move_undefined").when(~made, F.concat(F.lit("gate_rejected: "), "gate_reason")).otherwise(F.col("rule_reason")),
    })
    out = documents.outcome_tier(out)
    return out.withColumn("decision", F.when(usable, F.col("decision")).otherwise("SYSTEM_ERROR")).drop("_rule", "_missing", "call_state")


def blind_settings(days: DataFrame, readings: DataFrame, settings: tuple[tuple[str, int], ...] = SETTINGS, variants: tuple[str, ...] = ()) -> DataFrame:
    """The rule at each of a stated list of settings on the same readings: explained days, right answers on labelled ones, and the flip test.

    ``days`` is (series, day, direction, move, expected), expected EXPLAIN,
    REFUSE or null. A day flips if it is explained and would be with the
    opposite move too.
    """
    other = F.when(F.col("direction") == "up", "down").when(F.col("direction") == "down", "up")

    def at(rule: str, fresh: int) -> DataFrame:
        said = documents.decide(days, readings, variants, rule, fresh).select(*KEYS, "expected", F.col("decision").alias("said"))
        turned = documents.decide(days.withColumn("direction", other), readings, variants, rule, fresh).select(*KEYS, F.col("decision").alias("turned"))
        return said.join(turned, KEYS).select(F.lit(rule).alias("rule"), F.lit(fresh).alias("fresh_days"), "expected", "said", "turned")

    rows = reduce(DataFrame.unionByName, [at(*s) for s in settings])
    yes, want = F.col("said") == "EXPLAIN", F.col("expected") == "EXPLAIN"
    out = rows.groupBy("rule", "fresh_days").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(yes).alias("explained"), F.count_if(want).alias("to_explain"), F.count_if(want & yes).alias("explain_right"),
        F.count_if(F.col("expected") == "REFUSE").alias("to_refuse"), F.count_if((F.col("expected") == "REFUSE") & ~yes).alias("refuse_right"), F.count_if(yes & (F.col("turned") == "EXPLAIN")).alias("flipped"))
    return out.withColumns({"explained_rate": rate("explained", "runs"), "flipped_rate": rate("flipped", "explained")})


def reading_statistics(readings: DataFrame, *keys: str) -> DataFrame:
    """Documents shown and read, causes given and those whose quote was found."""
    reason = F.coalesce("cause", F.lit("")) != ""
    out = readings.groupBy(*keys).agg(F.count(F.lit(1)).alias("shown"), F.count_if(F.coalesce("read", F.lit(False))).alias("read"), F.count_if(reason).alias("reasons"), F.count_if(reason & F.coalesce("quote_found", F.lit(False))).alias("verified"))
    return out.withColumns({"read_rate": rate("read", "shown"), "verified_rate": rate("verified", "reasons")})


def ablation(docs: DataFrame, labels: DataFrame, gates: dict[str, tuple[str, float, float]] = GATES, floor: float = documents.FLOOR) -> DataFrame:
    """The gate under each of a stated list of configurations, by day and then over the days.

    ``docs`` has scores, age and story (title key or url); ``labels`` is
    (series, day, expected). Averages are over days with documents.
    """
    names = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(m).alias("mode"), F.lit(k).alias("k"), F.lit(s).alias("s")) for n, (m, k, s) in gates.items()])
    rows = docs.withColumn("_g", F.explode(names)).select("*", "_g.*").drop("_g")
    by_word = F.coalesce("keyword_score", F.lit(0.0)) >= F.col("k")
    by_sense = F.coalesce(F.col("semantic_score") >= F.col("s"), F.lit(False))
    passed = F.when(F.col("mode") == "semantic_only", by_sense).when(F.col("mode") == "keyword_only", by_word).otherwise(by_word | by_sense)
    ok = (documents.best_score() >= floor) & passed
    each = rows.groupBy("config", *KEYS).agg(
        F.count(F.lit(1)).alias("retrieved"), F.count_if(ok).alias("accepted"), F.count_distinct(F.when(ok, F.col("story"))).alias("stories"),
        F.count_if(ok & (F.col("age") < 0)).alias("after"), F.max(F.when(documents.best_score() >= floor, documents.best_score())).alias("best"))
    each = each.join(labels.select(*KEYS, "expected"), KEYS, "left").withColumn("yes", F.col("accepted") > 0)
    out = each.groupBy("config").agg(
        F.count(F.lit(1)).alias("n_dates"), F.count_if("yes").alias("n_explain"), F.avg("retrieved").alias("avg_retrieved"), F.avg("accepted").alias("avg_accepted"), F.avg("stories").alias("avg_stories"),
        F.avg(F.coalesce("best", F.lit(0.0))).alias("avg_best_score"), F.sum("after").alias("_after"), F.sum("accepted").alias("_accepted"),
        F.count_if(F.col("expected") == "EXPLAIN").alias("_e"), F.count_if((F.col("expected") == "EXPLAIN") & F.col("yes")).alias("_ey"), F.count_if(F.col("expected") == "REFUSE").alias("_r"), F.count_if((F.col("expected") == "REFUSE") & ~F.col("yes")).alias("_ry"))
    return out.withColumns({"explain_share": ratio("n_explain", "n_dates"), "after_share": ratio("_after", "_accepted"), "passes_explain": ratio("_ey", "_e"), "blocks_refuse": ratio("_ry", "_r")}).drop("_after", "_accepted", "_e", "_ey", "_r", "_ry")


def documented_outcomes(entries: DataFrame, runs: DataFrame, version: int) -> DataFrame:
    """What the stored run of each documented (series, day) ended in: not run, older version, fault, explained or refused."""
    kept = entries.join(runs.select(*KEYS, "pipeline_version", "is_fault", "tier"), KEYS, "left")
    state = F.when(F.col("pipeline_version").isNull(), "not run").when(F.col("pipeline_version") != version, "older version").when(F.col("is_fault"), "fault").when(F.startswith("tier", F.lit("EXPLAINED")), "explained").otherwise("refused")
    return kept.withColumn("state", state)


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Days by state for each series, and the explained share of those with a current run."""
    counts = [F.count_if(F.col("state") == s).alias(s.replace(" ", "_")) for s in ("not run", "older version", "fault", "explained", "refused")]
    out = outcomes.groupBy("series").agg(F.count(F.lit(1)).alias("documented"), *counts)
    return out.withColumn("explained_share", ratio("explained", F.col("explained") + F.col("refused")))


def with_signature(trials: DataFrame, signature: dict[str, str | int], experiments: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(trials made under one signature, the other signatures with their number of trials).

    A trial that lacks a field of the signature is not of it.
    """
    own = F.lit(True)
    for name, value in signature.items():
        own = own & F.col(name).eqNullSafe(F.lit(value))
    kept = trials.where(own & (F.col("experiment").isin(*experiments) if experiments else F.lit(True)))
    return kept, trials.where(~own).groupBy(*signature).agg(F.count(F.lit(1)).alias("trials"))


def left_out(runs: DataFrame, excluded: DataFrame) -> DataFrame:
    """How many runs count, and how many do not for which reason; the first reason stands."""
    joined = runs.join(excluded.select(*KEYS).distinct().withColumn("_x", F.lit(True)), KEYS, "left")
    why = F.when(F.col("decision").isNull(), "not a full run").when(F.col("_x"), "excluded day").when(F.col("is_fault"), "fault").otherwise("counted")
    return joined.groupBy(why.alias("state")).agg(F.count(F.lit(1)).alias("runs"))


def story_key(title: str, url: str) -> Column:
    """The title key, of titles too short for one the url."""
    return F.coalesce(F.nullif(T.title_key(title), F.lit("")), F.col(url))
