"""Queries that score flags, scores, answers and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shocklens.functions.numbers import rate, two_sided_p
from shocklens.operators import detect, evaluate, joins, monthly
from shocklens.plans import DETECTED, EVENTS_SQL, query
from shocklens.plans.prices import control_dim, detected, events_dim
from shocklens.sources import tables

_GRID = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in evaluate.THRESHOLDS) + ")"


@query(f"{DETECTED} SELECT series, count(*) AS days, count(sd) AS scorable, count(*) FILTER (flag) AS flagged, count(*) FILTER (df) AS daily_flagged, round(count(*) FILTER (flag) / nullif(count(sd), 0), 6) AS flag_rate FROM det GROUP BY series")
def agg_01_flag_rates(spark, sf_dir):
    return evaluate.flag_rates(detected(spark, sf_dir))


@query(f"""{DETECTED}, g AS (SELECT series, t AS threshold, z, coalesce(abs(z) >= t, false) AS a, coalesce(abs(cz) >= t, false) AS b FROM det, {_GRID} AS g(t))
SELECT series, threshold, count(z) AS scorable, count(*) FILTER (a OR b) AS flagged, count(*) FILTER (a AND NOT b) AS daily_only, round(count(*) FILTER (a OR b) / nullif(count(z), 0), 6) AS flag_rate, round(count(*) FILTER (a AND NOT b) / nullif(count(z), 0), 6) AS daily_only_rate FROM g GROUP BY 1, 2""")
def agg_02_threshold_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(detected(spark, sf_dir))


@query(as_text=("detected",), sql=f"""{DETECTED}, {EVENTS_SQL}, hit AS (SELECT series, label, count(sd) AS judged, count(*) FILTER (flag) AS flagged, max(greatest(coalesce(abs(z), 0), coalesce(abs(cz), 0))) AS peak FROM det JOIN events_dim ON date BETWEEN s AND e GROUP BY 1, 2)
SELECT x.series, x.label, judged, flagged, round(peak, 6) AS peak, CASE WHEN judged > 0 THEN flagged > 0 END AS detected, (SELECT max(t) FROM {_GRID} AS g(t) WHERE t <= peak) AS survives
FROM (SELECT DISTINCT series, label FROM prices, events_dim) x LEFT JOIN hit USING (series, label)""")
def agg_03_event_recall(spark, sf_dir):
    d = detected(spark, sf_dir)
    return evaluate.event_recall(d, events_dim(spark, d))


_PLACED = f"""{DETECTED}, {EVENTS_SQL}, placed AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM events_dim WHERE date BETWEEN s AND e) THEN 'event' WHEN date BETWEEN DATE '1998-02-01' AND DATE '1998-04-30' THEN 'control' ELSE 'elsewhere' END AS place FROM det)"""


@query(f"{_PLACED} SELECT series, place, count(*) AS days, count(*) FILTER (flag) AS flagged FROM placed GROUP BY 1, 2")
def agg_04_places(spark, sf_dir):
    d = detected(spark, sf_dir)
    return joins.place_of(d, events_dim(spark, d), control_dim(d)).groupBy("series", "place").agg(F.count(F.lit(1)).alias("days"), F.count_if("anomaly_flag").alias("flagged"))


@query(f"""{_PLACED}, a AS (SELECT series, count(sd) AS judged, count(*) FILTER (flag) AS flagged, count(*) FILTER (sd IS NOT NULL AND place = 'event') AS event_days, count(*) FILTER (flag AND place = 'event') AS event_flagged,
  count(*) FILTER (flag AND place = 'control') AS control_flagged, count(*) FILTER (flag AND place = 'elsewhere') AS elsewhere_flagged FROM placed GROUP BY series)
SELECT *, round(event_flagged / nullif(event_days, 0), 6) AS density, round(flagged / nullif(judged, 0), 6) AS base_rate, round((event_flagged / nullif(event_days, 0)) / nullif(flagged / nullif(judged, 0), 0), 6) AS lift FROM a""")
def agg_05_density(spark, sf_dir):
    d = detected(spark, sf_dir)
    return evaluate.density(joins.place_of(d, events_dim(spark, d), control_dim(d)))


@query(f"""{DETECTED}, h AS (SELECT series, max(CAST(flag AS INTEGER)) OVER w AS any_flag, count(*) OVER w AS n FROM det WHERE sd IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))
SELECT series, count(*) AS windows, round(avg(any_flag), 6) AS chance FROM h WHERE n = 21 GROUP BY series""")
def agg_06_chance_of_a_flag(spark, sf_dir):
    return evaluate.chance_of_a_flag(detected(spark, sf_dir), 21)


@query(f"""{DETECTED}, f AS (SELECT *, lead(price, 5) OVER (PARTITION BY series ORDER BY date) / price - 1 AS fwd FROM det)
SELECT series, kind AS anomaly_type, count(fwd) AS n, round(CASE WHEN count(fwd) >= 8 THEN quantile_cont(fwd, 0.5) END, 6) AS median, round(CASE WHEN count(fwd) >= 8 THEN quantile_cont(fwd, 0.25) END, 6) AS q1, round(CASE WHEN count(fwd) >= 8 THEN quantile_cont(fwd, 0.75) END, 6) AS q3,
  round(CASE WHEN count(fwd) >= 8 THEN avg(CAST(fwd > 0 AS INTEGER)) END, 6) AS share_up FROM f GROUP BY 1, 2""")
def agg_11_robust_spread(spark, sf_dir):
    d = detected(spark, sf_dir).select("series", "date", "price", "anomaly_type")
    return evaluate.robust_spread(detect.rolled(d), "forward_5", "series", "anomaly_type")


@query(f"""{DETECTED}, bars AS (SELECT series, quantile_cont(abs(r), 0.9) AS bar FROM det GROUP BY series), m AS (SELECT *, coalesce(abs(r) >= bar, false) AS mat FROM det JOIN bars USING (series))
SELECT series, count(*) FILTER (flag) AS flagged, count(*) FILTER (kind = 'shock') AS shock, count(*) FILTER (kind = 'trend') AS trend, count(*) FILTER (kind = 'shock+trend') AS both_kinds, count(*) FILTER (mat) AS material, count(*) FILTER (flag AND mat) AS both,
  count(*) FILTER (mat AND NOT flag) AS material_only, count(*) FILTER (flag AND NOT mat) AS flagged_only, round(count(*) FILTER (flag AND mat) / nullif(count(*) FILTER (flag OR mat), 0), 6) AS jaccard FROM m GROUP BY series""")
def agg_14_definitions(spark, sf_dir):
    return evaluate.definition_summary(detected(spark, sf_dir))


@query(f"""{DETECTED}, f AS (SELECT *, CASE WHEN count(lr) OVER n >= 20 THEN stddev_samp(lr) OVER n END AS fv FROM det WINDOW n AS (PARTITION BY series ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
bars AS (SELECT series, quantile_cont(abs(r), 0.9) AS bar FROM det GROUP BY series)
SELECT series, round(median(fv), 5) AS any_day, round(median(fv) FILTER (flag), 5) AS after_flag, round(median(fv) FILTER (abs(r) >= bar AND NOT flag), 5) AS large_unflagged, round(median(fv) FILTER (flag) / median(fv), 5) AS lift FROM f JOIN bars USING (series) GROUP BY series""", digits=5)
def agg_15_regime_medians(spark, sf_dir):
    d = detected(spark, sf_dir)
    ahead = detect.rolled(d.select("series", "date", "price")).select("series", "date", "forward_vol")
    return evaluate.regime_medians(d.join(ahead, ["series", "date"]))


# Labelled documents with a plain score: quality as relevance, length as score, source as group.
_SCORED = """scored AS (SELECT doc_id, source AS grp, lang, quality = 1 AS relevant, toxic = 1 AS toxic, floor(n_chars / 250) AS score FROM documents JOIN labels USING (doc_id))"""


def scored(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("source").alias("grp"), "lang", (F.col("quality") == 1).alias("relevant"), (F.col("toxic") == 1).alias("toxic"), F.floor(F.col("n_chars") / 250).cast("double").alias("score"))


@query(f"""{_SCORED}, c AS (SELECT lang, count(*) FILTER (score >= 4 AND relevant) AS tp, count(*) FILTER (score >= 4 AND NOT relevant) AS fp, count(*) FILTER (score < 4 AND relevant) AS fn, count(*) FILTER (score < 4 AND NOT relevant) AS tn FROM scored GROUP BY lang)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM c""")
def agg_21_confusion(spark, sf_dir):
    return evaluate.confusion(scored(spark, sf_dir), F.col("score") >= 4, F.col("relevant"), "lang")


_CURVE = f"""{_SCORED}, st AS (SELECT lang, score, count(*) AS n, count(*) FILTER (relevant) AS r FROM scored GROUP BY 1, 2),
curve AS (SELECT lang, score AS threshold, sum(n) OVER w AS flagged, sum(r) OVER w AS tp, sum(r) OVER (PARTITION BY lang) AS pos FROM st WINDOW w AS (PARTITION BY lang ORDER BY score DESC))"""


@query(f"{_CURVE} SELECT lang, threshold, CAST(flagged AS BIGINT) AS flagged, CAST(tp AS BIGINT) AS tp, round(tp / flagged, 6) AS precision, round(tp / nullif(pos, 0), 6) AS recall, round(2 * tp / (flagged + pos), 6) AS f1 FROM curve")
def agg_22_score_curve(spark, sf_dir):
    return evaluate.score_curve(scored(spark, sf_dir), "score", "relevant", "lang")


@query(f"""{_CURVE}, x AS (SELECT *, 2 * tp / (flagged + pos) AS f1, tp / flagged AS p FROM curve)
SELECT lang, arg_max(threshold, {{'f': f1, 't': threshold}}) AS best_f1_threshold, round(max(f1), 6) AS best_f1, min(threshold) FILTER (p >= 0.9 AND flagged >= 2) AS precise_threshold FROM x GROUP BY lang""")
def agg_22_best_thresholds(spark, sf_dir):
    return evaluate.best_thresholds(evaluate.score_curve(scored(spark, sf_dir), "score", "relevant", "lang"), "lang")


@query(f"""{_SCORED}, st AS (SELECT grp, score, count(*) AS n, count(*) FILTER (relevant) AS r FROM scored GROUP BY 1, 2),
tr AS (SELECT o.grp AS fold, score, sum(n) AS n, sum(r) AS r FROM (SELECT DISTINCT grp FROM st) o JOIN st ON st.grp <> o.grp GROUP BY 1, 2),
cv AS (SELECT fold, score, sum(n) OVER w AS fl, sum(r) OVER w AS tp, sum(r) OVER (PARTITION BY fold) AS pos FROM tr WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
ch AS (SELECT fold, arg_max(score, {{'f': 2 * tp / (fl + pos), 's': score}}) AS cut FROM cv GROUP BY fold),
t AS (SELECT CAST(sum(CASE WHEN score >= cut THEN r ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN score >= cut THEN n - r ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN score < cut THEN r ELSE 0 END) AS BIGINT) AS fn FROM st JOIN ch ON grp = fold)
SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM t""")
def agg_23_left_out_selection(spark, sf_dir):
    return evaluate.left_out_selection(scored(spark, sf_dir), "grp")


@query(f"""{_SCORED}, c AS (SELECT lang, count(*) FILTER (relevant) AS p, count(*) FILTER (NOT relevant) AS n FROM scored GROUP BY lang),
w AS (SELECT a.lang, sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS won FROM scored a JOIN scored b ON a.lang = b.lang AND a.relevant AND NOT b.relevant GROUP BY a.lang)
SELECT lang, p AS n_relevant, n AS n_other, round(coalesce(won, 0) / nullif(p * n, 0), 6) AS auc FROM c LEFT JOIN w USING (lang)""")
def agg_24_auc(spark, sf_dir):
    return evaluate.auc(scored(spark, sf_dir), "lang")


@query(f"""{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, doc_id) AS rn FROM scored),
g AS (SELECT grp, count(*) AS n, count(*) FILTER (relevant) AS pos, count(*) FILTER (relevant AND rn <= 5) AS hit, min(rn) FILTER (relevant) AS f FROM r GROUP BY grp)
SELECT grp, round(hit / 5, 6) AS precision_at_k, round(hit / pos, 6) AS recall_at_k, round(1 / f, 6) AS reciprocal_rank FROM g WHERE n >= 5 AND pos > 0""")
def agg_25_top_k_scores(spark, sf_dir):
    return evaluate.top_k_scores(scored(spark, sf_dir), "grp", 5, [F.col("score").desc(), F.col("doc_id")])


@query()
def agg_26_bootstrap_auc(spark, sf_dir):
    return evaluate.bootstrap_auc(scored(spark, sf_dir), "grp")


@query()
def agg_27_permutation_test(spark, sf_dir):
    d = detected(spark, sf_dir)
    placed = joins.place_of(d, events_dim(spark, d), control_dim(d)).where("rolling_std IS NOT NULL")
    return evaluate.permutation_test(placed.select("series", "date", F.col("anomaly_flag").alias("flag"), (F.col("place") == "event").alias("inside")), 200)


_WILSON = """round(100 * least(greatest((p + 1.96 * 1.96 / (2 * n) {sign} 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 0), 1), 1)"""


@query(f"""{_SCORED}, c AS (SELECT grp, count(*) FILTER (relevant) AS k, count(*)::DOUBLE AS n, count(*) FILTER (relevant) / count(*)::DOUBLE AS p FROM scored GROUP BY grp)
SELECT grp, k, CAST(n AS BIGINT) AS n, round(100 * k / n, 1) AS pct, {_WILSON.format(sign='-')} AS lo, {_WILSON.format(sign='+')} AS hi FROM c""")
def agg_28_rates(spark, sf_dir):
    c = scored(spark, sf_dir).groupBy("grp").agg(F.count_if("relevant").alias("k"), F.count(F.lit(1)).alias("n"))
    return c.select("grp", rate("k", "n").alias("r")).select("grp", "r.*")


@query(f"""{_SCORED}, c AS (SELECT lang, relevant AS a, toxic AS b FROM scored), t AS (SELECT lang, count(*) AS n, count(*) FILTER (a = b) AS agree,
  (count(*) FILTER (a) * count(*) FILTER (b) + count(*) FILTER (NOT a) * count(*) FILTER (NOT b)) / (count(*) * count(*)) AS e FROM c GROUP BY lang)
SELECT lang, n, agree, round((agree / n - e) / nullif(1 - e, 0), 6) AS kappa FROM t""")
def agg_40_kappa(spark, sf_dir):
    return evaluate.kappa(scored(spark, sf_dir), "relevant", "toxic", "lang")


@query()
def win_22_holm(spark, sf_dir):
    c = scored(spark, sf_dir).groupBy("grp").agg(F.avg(F.col("relevant").cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))
    z = (F.col("share") - 0.86) / F.sqrt(F.lit(0.86 * 0.14) / F.col("n"))
    return monthly.holm_by_step(c.select("grp", two_sided_p(z).alias("p")), "p")


@query("""SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(max(value), 6) AS largest, round(sum(value), 2) AS total FROM events GROUP BY event_type""")
def agg_39_cost_distribution(spark, sf_dir):
    out = evaluate.distribution(tables.table(spark, sf_dir, "events"), "value", "event_type")
    return out.withColumn("total", F.round("total", 2))


@query(as_text=("day",), sql="""SELECT CAST(ts AS DATE) AS day, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS failures, count(DISTINCT user_id) AS users, count(*) > count(*) FILTER (event_type = 'error') AS retrieval_ran FROM events GROUP BY 1""")
def agg_38_retrieval_health(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    out = e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("event_type") == "error").alias("failures"), F.count_distinct("user_id").alias("users"))
    return out.withColumn("retrieval_ran", F.col("attempts") > F.col("failures"))


@query("""SELECT role, count(*) AS runs, round(100.0 * count(*) / (SELECT count(*) FROM conversations), 1) AS pct FROM conversations GROUP BY role""")
def agg_29_tier_counts(spark, sf_dir):
    return evaluate.tier_counts(tables.table(spark, sf_dir, "conversations"), "role").select("role", "runs", F.col("rate.pct").alias("pct"))


@query("""SELECT source, count(*) AS labelled, count(*) FILTER (has) AS with_run FROM (SELECT l.doc_id, d.source, d.doc_id IS NOT NULL AS has FROM labels l LEFT JOIN documents d USING (doc_id)) GROUP BY source""")
def join_08_label_runs(spark, sf_dir):
    runs = tables.table(spark, sf_dir, "documents").select("doc_id", "source")
    out = joins.label_runs(tables.table(spark, sf_dir, "labels"), runs, ["doc_id"])
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("labelled"), F.count_if("has_run").alias("with_run"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def join_10_unlabelled(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id").join(tables.table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def join_11_accepted(spark, sf_dir):
    good = tables.table(spark, sf_dir, "labels").where("quality = 1")
    return tables.table(spark, sf_dir, "documents").select("doc_id", "source").join(good, "doc_id", "left_semi")


# Stand-in readings: a turn is a document of its conversation, its role the model, its length the direction.
_READ = """readings AS (SELECT conv_id AS date, turn // 2 AS document_id, role AS model, CASE length(text) % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS direction, length(text) > 40 AS quote_found FROM conversations)"""


def readings(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations")
    kind = F.pmod(F.length("text"), F.lit(3))
    return c.select(F.col("conv_id").alias("date"), F.expr("turn div 2").alias("document_id"), F.col("role").alias("model"), F.when(kind == 0, "up").when(kind == 1, "down").alias("direction"), (F.length("text") > 40).alias("quote_found"))


@query(f"""{_READ} SELECT x.model AS a, y.model AS b, count(*) AS common, count(*) FILTER (x.direction IS NOT DISTINCT FROM y.direction) AS same, round(count(*) FILTER (x.direction IS NOT DISTINCT FROM y.direction) / count(*), 6) AS agreement
FROM readings x JOIN readings y USING (date, document_id) WHERE x.model < y.model GROUP BY 1, 2""")
def join_16_model_agreement(spark, sf_dir):
    return joins.model_agreement(readings(spark, sf_dir))


@query(f"""{_READ}, m AS (SELECT date, count(DISTINCT model) AS models FROM readings GROUP BY date), v AS (SELECT date, document_id, direction, count(DISTINCT model) AS votes, min(model) AS first_model FROM readings WHERE quote_found AND direction IS NOT NULL GROUP BY 1, 2, 3)
SELECT date, document_id, direction, votes, first_model FROM v JOIN m USING (date) WHERE votes * 2 > models""")
def set_11_consensus(spark, sf_dir):
    from shocklens.operators.documents import consensus

    return consensus(readings(spark, sf_dir))
