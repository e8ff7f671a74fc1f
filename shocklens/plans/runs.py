"""Queries over runs: one for each language and day of the stand-in documents, decided by gate and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from shocklens.functions import text as T
from shocklens.operators import citations, documents, runs
from shocklens.plans import query
from shocklens.plans.documents import _SCORES, dated, with_next_title, with_scores

_RUNS = f"""{_SCORES}, g AS (SELECT series, day, count(*) AS considered, count(*) FILTER (best >= 0.05) AS above, count(*) FILTER (best >= 0.05 AND pass) AS accepted,
  count(*) FILTER (document_id % 3 = 0) AS consistent, count(*) FILTER (document_id % 3 = 2) AS inconsistent, min(document_id) AS least FROM sc GROUP BY 1, 2),
ru AS (SELECT *, CASE WHEN accepted > 0 THEN 'EXPLAIN' ELSE 'INSUFFICIENT_EVIDENCE' END AS gate_decision, CASE WHEN least % 11 = 0 THEN 'API_ERROR' ELSE 'OK' END AS call_state,
  CASE WHEN accepted > 0 AND consistent >= inconsistent THEN 'EXPLAIN' ELSE 'INSUFFICIENT_EVIDENCE' END AS decision, CASE WHEN accepted >= 2 AND inconsistent = 0 THEN 'high' ELSE 'medium' END AS confidence FROM g),
ti AS (SELECT *, CASE WHEN call_state = 'API_ERROR' THEN 'SYSTEM_ERROR' WHEN gate_decision <> 'EXPLAIN' AND above = 0 THEN 'REFUSED_NO_EVIDENCE' WHEN gate_decision <> 'EXPLAIN' THEN 'REFUSED_WEAK_EVIDENCE'
  WHEN decision <> 'EXPLAIN' AND inconsistent > 0 AND inconsistent >= consistent THEN 'REFUSED_CONFLICTING' WHEN decision <> 'EXPLAIN' THEN 'REFUSED_WEAK_EVIDENCE'
  WHEN confidence = 'high' AND NOT (inconsistent > 0 AND inconsistent >= consistent) AND accepted >= 2 THEN 'EXPLAINED_STRONG' ELSE 'EXPLAINED_TENTATIVE' END AS tier FROM ru),
ve AS (SELECT *, CASE WHEN tier = 'SYSTEM_ERROR' THEN 'FAULT' WHEN starts_with(tier, 'EXPLAINED') THEN 'EXPLAINED' ELSE 'REFUSED' END AS verdict FROM ti)"""


def all_runs(spark, sf_dir):
    d = with_scores(spark, sf_dir)
    gated = documents.gate(d, ["series", "day"]).withColumnsRenamed({"decision": "gate_decision", "reason": "gate_reason"})
    m = F.pmod("document_id", F.lit(3))
    leans = d.groupBy("series", "day").agg(F.count_if(m == 0).alias("consistent"), F.count_if(m == 2).alias("inconsistent"), F.min("document_id").alias("least"))
    out = gated.join(leans, ["series", "day"])
    out = out.withColumns({
        "call_state": F.when(F.col("least") % 11 == 0, "API_ERROR").otherwise("OK"), "retrieval_ran": F.lit(True), "reading_made": F.lit(False), "blind": F.lit(False), "withheld": F.lit(False), "citations_resolve": F.lit(True), "citations_flagged": F.lit(0),
        "decision": F.when((F.col("accepted") > 0) & (F.col("consistent") >= F.col("inconsistent")), "EXPLAIN").otherwise("INSUFFICIENT_EVIDENCE"), "confidence": F.when((F.col("accepted") >= 2) & (F.col("inconsistent") == 0), "high").otherwise("medium")})
    return runs.verdicts(documents.outcome_tier(out))


@query(as_text=("day",), sql=f"{_RUNS} SELECT series, day, tier, verdict, CASE WHEN verdict = 'EXPLAINED' AND inconsistent > consistent THEN 'REFUSED' ELSE verdict END AS guarded, CASE WHEN verdict = 'EXPLAINED' AND inconsistent > 0 AND inconsistent >= consistent THEN 'REFUSED' ELSE verdict END AS guarded_ties FROM ve")
def rule_04_outcomes(spark, sf_dir):
    return all_runs(spark, sf_dir).select("series", "day", "tier", "verdict", "guarded", "guarded_ties")


@query(f"{_RUNS} SELECT series, CASE WHEN considered = 0 THEN 'no documents' WHEN gate_decision <> 'EXPLAIN' THEN 'gate' ELSE 'reading' END AS stopped_at, count(*) AS runs FROM ve WHERE verdict = 'REFUSED' GROUP BY 1, 2")
def agg_37_refusal_stages(spark, sf_dir):
    return runs.refusal_reason(all_runs(spark, sf_dir)).groupBy("series", "stopped_at").agg(F.count(F.lit(1)).alias("runs"))


_SYSTEMS = """j AS (SELECT *, CASE WHEN least % 2 = 0 THEN 'EXPLAIN' ELSE 'REFUSE' END AS expected FROM ve),
l AS (SELECT expected, 'verdict' AS system, verdict AS said FROM j UNION ALL SELECT expected, 'always_explain', 'EXPLAINED' FROM j UNION ALL SELECT expected, 'gate_only', CASE WHEN gate_decision = 'EXPLAIN' THEN 'EXPLAINED' ELSE 'REFUSED' END FROM j
  UNION ALL SELECT expected, 'direction_only', CASE WHEN consistent > inconsistent THEN 'EXPLAINED' ELSE 'REFUSED' END FROM j UNION ALL SELECT expected, 'never_refuse', CASE WHEN considered > 0 THEN 'EXPLAINED' ELSE 'REFUSED' END FROM j),
c AS (SELECT system, count(*) AS n, count(*) FILTER ((said = 'EXPLAINED') = (expected = 'EXPLAIN')) AS "right", count(*) FILTER (expected = 'EXPLAIN') AS to_explain, count(*) FILTER (expected = 'EXPLAIN' AND said = 'EXPLAINED') AS explained,
  count(*) FILTER (expected = 'REFUSE') AS to_refuse, count(*) FILTER (expected = 'REFUSE' AND said <> 'EXPLAINED') AS refused FROM l WHERE said <> 'FAULT' GROUP BY system)"""


@query(f'{_RUNS}, {_SYSTEMS} SELECT *, round("right" / n, 6) AS accuracy, round((explained / nullif(to_explain, 0) + refused / nullif(to_refuse, 0)) / 2, 6) AS balanced_accuracy FROM c')
def agg_30_decision_scores(spark, sf_dir):
    judged = all_runs(spark, sf_dir).withColumn("expected", F.when(F.col("least") % 2 == 0, "EXPLAIN").otherwise("REFUSE"))
    return runs.decision_scores(runs.baselines(judged), ["verdict", "always_explain", "gate_only", "direction_only", "never_refuse"])


@query(f"{_RUNS} SELECT series, count(*) AS runs, count(*) FILTER (consistent > inconsistent) AS leaning, round(100 * count(*) FILTER (consistent > inconsistent) / count(*), 1) AS pct FROM ve GROUP BY series")
def agg_34_direction_statistics(spark, sf_dir):
    return runs.direction_statistics(all_runs(spark, sf_dir), "series").select("series", "runs", "leaning", F.col("rate.pct").alias("pct"))


@query(f"{_RUNS} SELECT series, count(*) FILTER (verdict = 'EXPLAINED') AS explained, count(*) FILTER (verdict <> 'FAULT') AS n FROM ve GROUP BY series")
def agg_42_explained_rates(spark, sf_dir):
    return runs.explained_rates(all_runs(spark, sf_dir), "series").select("series", "explained", "n")


@query(as_text=("day",), sql=f"{_RUNS}, p AS (SELECT series, day FROM sc UNION SELECT series, CAST(day + INTERVAL 1 DAY AS DATE) FROM sc) SELECT series, day, CASE WHEN verdict IS NULL THEN 'missing' WHEN least % 4 < 1 THEN 'stale' WHEN verdict = 'FAULT' THEN 'fault' ELSE 'current' END AS state FROM p LEFT JOIN ve USING (series, day)")
def prj_20_run_states(spark, sf_dir):
    """Planned are the days with documents and the days after them; of the latter, those without documents have no run."""
    days = with_scores(spark, sf_dir).select("series", "day")
    planned = days.union(days.select("series", F.date_add("day", 1))).distinct()
    stored = all_runs(spark, sf_dir).withColumn("pipeline_version", (F.col("least") % 4).cast("int"))
    return runs.run_state(planned, stored, 1).select("series", "day", "state")


@query(as_text=("day",), sql=f"{_SCORES} SELECT series, day, count(*) AS documents, count(sem) AS scored FROM sc GROUP BY 1, 2 HAVING count(sem) = 0")
def prj_22_unscored_days(spark, sf_dir):
    return runs.without_scores(with_scores(spark, sf_dir))


@query(as_text=("day",), sql=f"{_SCORES} SELECT series, day, count(*) AS planned, count(*) FILTER (document_id % 7 = 0) AS waiting, count(*) FILTER (document_id % 7 = 0) = 0 AS complete FROM sc GROUP BY 1, 2")
def prj_21_complete_days(spark, sf_dir):
    return runs.complete_days(with_scores(spark, sf_dir).withColumn("answered", F.col("document_id") % 7 != 0))


_SOURCES = "ag AS (SELECT series, document_id, url, title, split_part(split_part(url, '://www.', 2), '/', 1) AS host, CAST(datediff('day', published, DATE '1999-02-15') AS INTEGER) AS age FROM dated)"


def sources(spark, sf_dir):
    return dated(spark, sf_dir).select("series", "document_id", "url", F.lit("").alias("title_key"), T.host("url").alias("host"), F.datediff(F.to_date(F.lit("1999-02-15")), "published").alias("age"))


@query(f"{_SCORES}, {_SOURCES} SELECT series, count(*) AS documents, count(DISTINCT url) AS stories, count(*) FILTER (age < 0) AS after_day, count(DISTINCT host) AS hosts, round(1 - count(DISTINCT url) / count(*), 6) AS duplicate_share, round(count(*) FILTER (age < 0) / count(*), 6) AS after_share FROM ag GROUP BY series")
def agg_33_evidence_statistics(spark, sf_dir):
    return runs.evidence_statistics(sources(spark, sf_dir), "series")


@query(f"{_SCORES}, {_SOURCES} SELECT series, count(age) AS dated, count(*) FILTER (age BETWEEN 0 AND 2) AS fresh, min(age) AS newest, round(median(age), 6) AS median_age FROM ag GROUP BY series")
def agg_44_recency(spark, sf_dir):
    return runs.recency(sources(spark, sf_dir), "series")


@query(f"""{_SCORES}, x AS (SELECT unnest(CASE WHEN document_id % 2 = 0 THEN ['a', 'b'] ELSE ['b'] END) AS search, series, day, pass AS usable, pass AND best > 0.9 AS deciding FROM sc)
SELECT search, count(*) AS found, count(*) FILTER (usable) AS usable, count(*) FILTER (deciding) AS deciding, count(DISTINCT CASE WHEN deciding THEN series || day END) AS days_decided FROM x GROUP BY search""")
def agg_36_search_yield(spark, sf_dir):
    d = with_scores(spark, sf_dir)
    both = F.when(F.col("document_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    return runs.search_yield(d.withColumns({"found_by": both, "usable": documents.passes(), "deciding": documents.passes() & (documents.best_score() > 0.9)}))


@query(as_text=("day", "start", "end"), sql=f"""{_SCORES}, p AS (SELECT DISTINCT series, day FROM sc) SELECT series, day, q AS query, span, (day - d)::DATE AS start, (day + 1)::DATE AS "end" FROM p, (VALUES ('prices'), ('weather')) AS x(q), (VALUES ('full', 7), ('recent', 2), ('day', 0)) AS y(span, d)""")
def rule_10_request_plan(spark, sf_dir):
    days = with_scores(spark, sf_dir).select("series", "day").distinct()
    queries = days.select("series").distinct().withColumn("query", F.explode(F.array(F.lit("prices"), F.lit("weather"))))
    return documents.request_plan(days, queries)


@query(f"""{_SCORES}, t AS (SELECT document_id, series, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM dated)
SELECT document_id, round(len(list_filter(['the', 'and', 'que', 'der'], lambda x: list_contains(w, x))) / 4, 6) AS coverage FROM t""")
def agg_47_term_coverage(spark, sf_dir):
    wanted = F.array(*map(F.lit, ["the", "and", "que", "der"]))
    return dated(spark, sf_dir).select("document_id", runs.term_coverage(T.ascii_tokens("text"), wanted).alias("coverage"))


def audit_sql(claims: str, shown: str) -> str:
    """Common tables up to fa: the audit of ``claims`` (run_id, claim_id, own, claim) against ``shown`` (run_id, doc, text), every claim beside every document of its run."""
    words, figures = ("list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))", "list_distinct(regexp_extract_all(replace({}, ',', '.'), '[0-9]+(?:\\.[0-9]+)?'))")
    return f"""cl AS (SELECT *, {words.format('claim')} AS cw, {figures.format('claim')} AS cn FROM ({claims})), sh AS (SELECT *, {words.format('text')} AS tw, {figures.format('text')} AS tn FROM ({shown})),
sx AS (SELECT cl.run_id, claim_id, own, claim, doc, coalesce(len(list_intersect(cw, tw)) / nullif(len(cw), 0), 0) AS s, len(list_intersect(cn, tn)) AS n FROM cl JOIN sh USING (run_id)),
rk AS (SELECT *, row_number() OVER w AS r, first(doc) OVER w AS closest, count(*) OVER (PARTITION BY run_id, claim_id) AS shown FROM sx WINDOW w AS (PARTITION BY run_id, claim_id ORDER BY s DESC, doc)),
au AS (SELECT cl.run_id, cl.claim_id, cl.own AS document_id, s AS support, CASE WHEN cl.claim <> '' THEN r END AS support_rank, shown, n AS shared_numbers, CASE WHEN cl.claim <> '' THEN closest END AS closest FROM cl LEFT JOIN rk ON rk.run_id = cl.run_id AND rk.claim_id = cl.claim_id AND rk.doc = cl.own),
fa AS (SELECT *, CASE WHEN support IS NULL THEN 'missing_document' WHEN shared_numbers = 0 AND support < 0.15 THEN 'weak_support' WHEN shared_numbers = 0 AND shown >= 6 AND support_rank > 3 THEN 'low_rank' ELSE 'ok' END AS flag FROM au)"""


# Runs of a language and fortnight; claims are titles of the next document, of every fourth one its own; every seventh cites what was not shown.
_AUDITED = f"""{_SCORES}, cx AS (SELECT *, series || '-' || (document_id % 60) // 14 AS run_id, CASE WHEN document_id % 4 = 0 THEN title ELSE lead(title, 1, title) OVER (PARTITION BY series ORDER BY document_id) END AS claim FROM dated),
{audit_sql("SELECT run_id, document_id AS claim_id, CASE WHEN document_id % 7 = 0 THEN 'none' ELSE CAST(document_id AS VARCHAR) END AS own, claim FROM cx", "SELECT run_id, CAST(document_id AS VARCHAR) AS doc, text FROM cx")}"""


def _cited(spark, sf_dir):
    d = dated(spark, sf_dir).withColumn("run_id", F.concat_ws("-", "series", F.floor(F.col("document_id") % 60 / 14).cast("string")))
    said = with_next_title(d).withColumn("claim", F.when(F.col("document_id") % 4 == 0, F.col("title")).otherwise(F.col("next_title")))
    cited = F.when(F.col("document_id") % 7 == 0, F.lit("doc_none")).otherwise(F.concat(F.lit("doc_"), F.col("document_id").cast("string")))
    return said.select("run_id", F.col("document_id").alias("claim_id"), "claim", cited.alias("cited_id")), d.select("run_id", F.col("document_id").cast("string").alias("document_id"), "text")


@query(f"{_AUDITED} SELECT run_id, claim_id, document_id, round(support, 6) AS support, CAST(support_rank AS INTEGER) AS support_rank, shown, CAST(shared_numbers AS INTEGER) AS shared_numbers, closest, flag FROM fa")
def rule_06_citation_audit(spark, sf_dir):
    """Claims that are mostly other documents' titles, on the documents of a language's fortnight."""
    return citations.citation_audit(*_cited(spark, sf_dir))


@query(f"""{_AUDITED}, un AS (SELECT run_id, count(DISTINCT CASE WHEN document_id % 5 = 0 THEN 'lost' || document_id % 3 END) AS n FROM cx GROUP BY run_id)
SELECT run_id, count(*) AS n_citations, count(*) FILTER (flag = 'ok') AS n_ok, count(*) FILTER (flag = 'weak_support') AS n_weak_support, count(*) FILTER (flag = 'low_rank') AS n_low_rank, count(*) FILTER (flag = 'missing_document') AS n_missing_document,
  any_value(un.n) AS n_unresolved, count(*) FILTER (flag = 'missing_document') = 0 AND any_value(un.n) = 0 AS citations_resolve, round(count(*) FILTER (flag = 'ok') / count(*), 6) AS ok_share FROM fa JOIN un USING (run_id) GROUP BY run_id""")
def rule_06_citation_report(spark, sf_dir):
    """The audit by run, with explanations that name the document itself and, every fifth, one that was not shown."""
    claims, shown = _cited(spark, sf_dir)
    i = F.col("claim_id")
    said = F.concat(F.lit("It fell (source: doc_"), i.cast("string"), F.when(i % 5 == 0, F.concat(F.lit("; source: lost"), (i % 3).cast("string"))).otherwise(""), F.lit(")"))
    loose = citations.unresolved_inline(claims.select("run_id", said.alias("explanation")), shown)
    return citations.citation_report(citations.citation_audit(claims, shown), loose)


@query(f"{_AUDITED} SELECT count(*) AS citations, count(*) FILTER (flag = 'missing_document') AS missing, count(*) FILTER (flag = 'weak_support') AS weak, count(*) FILTER (flag = 'low_rank') AS low_rank, round(min(support), 6) AS least_support, round(median(support), 6) AS median_support FROM fa")
def agg_32_citation_statistics(spark, sf_dir):
    return runs.citation_statistics(rule_06_citation_audit(spark, sf_dir))
