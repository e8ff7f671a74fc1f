"""Values of queries that have no SQL, and of operators on rows made for them."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shocklens import plans
from shocklens.functions.numbers import draw, two_sided_p
from shocklens.operators import brief, documents, evaluate, rank, stage
from shocklens.plans import documents as plan_documents
from shocklens.plans import stage as plan_stage
from shocklens.sources import landing

plans.load()


def test_p_values(spark, sf_dir):
    z = {(r.series, str(r.date)): r.z_score for r in plans.QUERIES["win_04_flagged_days"](spark, sf_dir).collect()}
    rows = plans.QUERIES["fn_36_p_values"](spark, sf_dir).collect()
    assert len(rows) > 500
    for r in rows:
        if (x := z.get((r.series, str(r.date)))) is not None:
            assert abs(r.p_two - math.erfc(abs(x) / 2**0.5)) < 2e-6 and abs(r.p_one - math.erfc(x / 2**0.5) / 2) < 2e-6


def test_holm(spark, sf_dir):
    rows = sorted((r.p, r.holm_p) for r in plans.QUERIES["win_22_holm"](spark, sf_dir).collect() if r.p is not None)
    most = 0.0
    for i, (p, adjusted) in enumerate(rows):
        most = max(most, min(1.0, (len(rows) - i) * p))
        assert abs(adjusted - most) < 1e-4
    assert spark.range(1).select(two_sided_p(F.lit(1.959963985)).alias("p")).first().p == pytest.approx(0.05, abs=1e-6)


def test_permutation_hits_follow_the_counts(spark):
    rows = [("a", i, i % 10 == 0, i < 30) for i in range(100)] + [("b", i, False, i < 3) for i in range(20)]
    got = {r.series: r for r in evaluate.permutation_test(spark.createDataFrame(rows, "series string, date int, flag boolean, inside boolean"), 3000).collect()}
    a = got["a"]
    assert (a.n_flags, a.hits, a.inside_days) == (10, 3, 30) and a.precision == pytest.approx(0.3)
    ways = [math.comb(30, k) * math.comb(70, 10 - k) / math.comb(100, 10) for k in range(11)]
    assert a.random_precision == pytest.approx(0.3, abs=0.01) and a.share_beaten == pytest.approx(sum(ways[:3]), abs=0.04)
    assert (got["b"].n_flags, got["b"].precision, got["b"].random_precision) == (0, None, None)


def test_focus_text(spark, sf_dir):
    subject = ["the", "tion"]
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + ["", None, "One. The two 2 things! The 3. nothing here? the end", "x" * 2000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", documents.focus_text("text", subject).alias("f")).collect()
    for r in got:
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", texts[r.i] or "") if s]
        scored = [(-1000 if k == 0 else -(2 * len(set(re.findall("[a-z]+", s.lower())) & set(subject)) + bool(re.search(r"[0-9]", s))), k, s) for k, s in enumerate(sentences)]
        assert r.f == " ".join(s for w, _, s in sorted(scored) if w < -1)[:1200], r.i


def test_draws_are_md5(spark):
    import hashlib

    got = spark.createDataFrame([("a", 3)], "s string, n int").select(draw(11, "s", "n").alias("d")).first().d
    assert got == int(hashlib.md5(b"11|a|3").hexdigest()[:15], 16)


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.integers(-3, 4, 5).tolist() for i in range(300)}
    vectors |= {300: [1, 2], 301: [], 302: None, 303: [1, None, 0, 0, 0], 304: [0] * 5}
    rows = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors.items()], "id long, v array<float>")
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    whole = {i: v for i, v in vectors.items() if v and None not in v}
    want = set()
    for i in range(0, 305, 20):
        scores = sorted((-sum(a * b for a, b in zip(v, whole[i], strict=True)), j) for j, v in whole.items() if i in whole and j != i and len(v) == len(whole[i]))
        want |= {(i, j, float(-s), p) for p, (s, j) in enumerate(scores[:7], 1)}
    for block, chunk in ((4096, 32768), (3, 40)):
        assert {tuple(r) for r in rank.nearest(rows, queries, 7, block, chunk).collect()} == want
    assert rank.nearest(rows.limit(0), queries, 7).count() == 0
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],), (None,)], "v array<double>").select(rank.unit("v").alias("u")).collect()
    assert [r.u for r in zero] == [[None, None], [0.6, 0.8], None]


def test_stories(spark):
    base = [f"w{i}" for i in range(80)]
    body = lambda *change: " ".join(x if i not in change else f"n{i}" for i, x in enumerate(base))
    hot = "the same opening words on every page of this site"
    rows = [
        (1, "", "", "https://a.example/1", None, None, None),
        (2, "Big frost hits crop - Daily", None, "https://a.example/2", "2020-01-02", 0.1, None),
        (3, "Big frost hits crop", body(), "https://b.example/3", "2020-01-03", 0.1, 0.2),
        (4, "x", body(40), "https://www.c.example/4", "2020-01-01", 0.9, None),
        (5, "y", body(41), "https://c.example/5", "2020-01-01", 0.9, None),
        (6, "z", body(), "https://b.example/6", None, None, None),
    ] + [(10 + i, "", f"{hot} " + " ".join(f"u{i}x{k}" for k in range(60)), f"https://h{i}.example/", None, None, None) for i in range(40)]
    docs = spark.createDataFrame([("s", *r) for r in rows], "series string, document_id long, title string, text string, url string, published string, keyword_score double, semantic_score double")
    edges = {(r.a, r.b) for r in documents.story_links(docs, ["series"]).collect()}
    # Same site, same text: no link of their own; 4 and 5 are of one site too.
    assert edges == {(2, 3), (3, 4), (3, 5)}
    got = {r.document_id: r for r in documents.collapse_stories(docs, ["series"]).collect()}
    assert set(got) == {1, 4, 6, *range(10, 50)}
    four = got[4]
    assert (four.n_copies, four.duplicate_urls, four.syndication_domains) == (4, ["https://a.example/2", "https://b.example/3", "https://c.example/5"], ["a.example", "b.example", "c.example"])
    assert documents.collapse_stories(docs.limit(0), ["series"]).count() == 0


def test_quotes_meet_by_runs(spark):
    quotes = [(1, "a rare run of words is here"), (2, "two longwordsonly"), (3, "Three  small\nwords indeed"), (4, "short"), (5, None), (6, "never in any of the texts at all")]
    texts = [(1, "xa rare run of words is herex"), (2, "has two longwordsonlyhere"), (3, "THREE small words indeed, a rare run of words"), (4, None), (5, ""), (6, "short and three small words indeed")]
    got = documents.quoted(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, quote string"))
    even = lambda t: " ".join((t or "").lower().split())
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(d, i) for d, t in texts for i, q in quotes if len(even(q)) >= 15 and even(q) in even(t)}


def test_stage_marks_faults(spark):
    days = spark.createDataFrame([("s", 1, "up", 5.0, True, True), ("s", 2, "up", 5.0, False, True), ("s", 3, "down", None, True, False), ("s", 4, "up", 1.0, None, None)], "series string, day int, direction string, move double, price_is_usable boolean, retrieval_ran boolean")
    docs = spark.createDataFrame([("s", d, i, 0.9, 0.9, 0, "frost hits 30 percent of the crop") for d in (1, 2) for i in (1, 2)] + [("s", 4, 7, 0.0, None, None, None)], "series string, day int, document_id long, keyword_score double, semantic_score double, age int, text string")
    readings = spark.createDataFrame([("s", d, i, "up", "report", 0, "frost hits crop", True) for d in (1, 2) for i in (1, 2)], "series string, day int, document_id long, direction string, kind string, age int, cause string, quote_found boolean")
    got = {r.day: r for r in stage.decision_stage(days, docs, readings).collect()}
    assert (got[1].tier, got[1].decision, got[1].supporting, got[1].citations_flagged) == ("EXPLAINED_STRONG", "EXPLAIN", 2, 0)
    assert (got[2].tier, got[2].decision, got[2].reason) == ("SYSTEM_ERROR", "SYSTEM_ERROR", "price_not_positive_move_undefined")
    assert (got[3].tier, got[4].tier) == ("RETRIEVAL_FAILED", "REFUSED_NO_EVIDENCE")
    assert stage.decision_stage(days.limit(0), docs, readings).count() == 0


def test_next_titles_need_no_whole_series(spark, sf_dir, monkeypatch, tmp_path):
    monkeypatch.setattr(plan_documents, "IDS", 8)
    rows = [(s, i, None if i % 7 == 3 else f"{s}{i}") for s, step in (("a", 1), ("b", 5), (None, 40), ("c", 900)) for i in range(-20, 60, step)]
    want = {}
    for s in {r[0] for r in rows}:
        own = sorted((i, t) for x, i, t in rows if x == s)
        want |= {(s, i): own[min(k + 1, len(own) - 1)][1] for k, (i, _) in enumerate(own)}
    df = spark.createDataFrame(rows, "series string, document_id long, title string").repartition(3)
    got = plan_documents.with_next_title(df)
    assert got.columns == [*df.columns, "next_title"] and {(r.series, r.document_id): r.next_title for r in got.collect()} == want
    assert got.count() == len(rows)
    # The readings of the largest series are dealt to several tasks.
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = plan_stage.stage_readings(spark, str(tmp_path)).groupBy("series", F.spark_partition_id().alias("p")).agg(F.count("cause").alias("k")).groupBy("series").agg(F.max("k").alias("most"), F.sum("k").alias("n")).orderBy(F.desc("n")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert held.most < held.n


def test_signature_needs_every_field(spark):
    trials = spark.createDataFrame([(1, "x", 1, "a"), (2, "x", None, "a"), (3, "y", 1, "a"), (4, "x", 1, "b")], "id int, provider string, seed int, experiment string")
    own, others = stage.with_signature(trials, {"provider": "x", "seed": 1}, ["a"])
    assert [r.id for r in own.collect()] == [1] and {(r.provider, r.seed, r.trials) for r in others.collect()} == {("x", None, 1), ("y", 1, 1)}


def test_currency_position_without_a_year(spark):
    rates = spark.createDataFrame([("a", "2020-01-10", 2.0), ("a", "2020-01-01", 1.0), ("a", "2018-01-01", 9.0), ("b", "2020-01-01", None)], "series string, date string, rate double").withColumn("date", F.to_date("date"))
    got = {r.series: r for r in brief.currency_position(rates).collect()}
    assert (got["a"].rate, got["a"].week_change, got["a"].percentile) == (2.0, 1.0, 50.0) and "b" not in got


def test_scans_refuse_and_sinks_round(spark, tmp_path):
    (tmp_path / "coffee.csv").write_text("date,price,z_score\n2020-01-01,1,2\n")
    with pytest.raises(ValueError, match="columns missing"):
        landing.detections(spark, str(tmp_path / "coffee.csv"))
    with pytest.raises(ValueError, match="factor columns missing"):
        landing.factors(spark, str(tmp_path / "coffee.csv"))
    (tmp_path / "pipeline_output_coffee_2020-01-02.json").write_text('{"pipeline_version": "11",\n "anomaly": {"date": "2020-01-02", "direction": "up"}, "outcome": {"tier": "EXPLAINED_STRONG"}}')
    (tmp_path / "pipeline_output_coffee_2020-01-03.json").write_text("{broken")
    run = landing.stored_runs(spark, str(tmp_path / "pipeline_output_*.json")).where("tier IS NOT NULL").collect()
    assert [(r.series, str(r.day), r.pipeline_version, r.tier, r.is_fault, r.price_is_usable) for r in run] == [("coffee", "2020-01-02", 11, "EXPLAINED_STRONG", False, True)]
    shown = spark.createDataFrame([("s", "2020-01-01", 2, "b", 1.239), ("s", "2020-01-01", 1, "a", None)], "series string, date string, place int, text string, score double")
    landing.write_shown(shown, str(tmp_path / "shown"))
    assert [r.text for r in spark.read.json(str(tmp_path / "shown/series=s/date=2020-01-01")).collect()] == ["a", "b"]
    landing.write_sheet(shown, str(tmp_path / "sheet"))
    assert {r.score for r in spark.read.option("header", True).csv(str(tmp_path / "sheet")).collect()} == {"1.24", None}
    manual = tmp_path / "manual/coffee"
    manual.mkdir(parents=True)
    (manual / "2020-01-05.json").write_text('[{"title": "t", "url": "u", "date": "4 Jan 2020"}, {"title": "late", "url": "v", "date": "20200109"}, {"title": "none", "date": "2020-01-01"}]')
    assert [(r.series, str(r.day), r.title, str(r.published)) for r in landing.manual_articles(spark, str(tmp_path / "manual/*/*.json")).collect()] == [("coffee", "2020-01-05", "t", "2020-01-04")]


def test_equal_word_weights_have_no_direction(spark):
    df = spark.createDataFrame([("", "that " * 20 + "and " * 7), ("that", "with " * 2), ("", "that " * 20 + "and " * 6)], "title string, text string")
    got = [tuple(r.x) for r in df.select(documents.price_direction("title", "text", {"the": 1.0, "that": 0.35}, {"and": 1.0, "with": 0.35}).alias("x")).collect()]
    assert [g[:3] for g in got] == [(7.0, 7.0, "neutral"), (0.7, 0.7, "neutral"), (7.0, 6.0, "up")]
    assert got[0][3] == 0.0 and abs(got[2][3] - 1 / 13) < 1e-12


def test_excerpts_have_the_embedded_text_too(spark, sf_dir):
    rows = plans.QUERIES["fn_22_excerpts"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.document_id]
        title = text and text.split("\n")[0]
        assert r.embedded == (text if text is None else f"query: {title}" if r.document_id % 2 == 0 else f"passage: {title}. {text[:40]}")
