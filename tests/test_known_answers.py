"""Known answers on small inputs."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shocklens.functions import dates, numbers
from shocklens.functions import text as T
from shocklens.operators import brief, citations, detect, documents, evaluate, factors, joins, monthly, rank, runs
from shocklens.sources import landing


def weekdays(n, start=dt.date(2020, 1, 1)):
    out = []
    while len(out) < n:
        if start.weekday() < 5:
            out.append(start)
        start += dt.timedelta(days=1)
    return out


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(1)
    price, rows = 100.0, []
    for i, d in enumerate(weekdays(140)):
        price *= 1 + rng.gauss(0, 0.01) + (0.08 if i == 120 else 0)
        rows.append(("s", d, price))
    return spark.createDataFrame(rows, "series string, date date, price double")


def one(df):
    return df.collect()[0]


def values(df, column):
    return [r[0] for r in df.orderBy("date").select(column).collect()]


def test_detector_flags_the_jump_and_its_baseline_excludes_the_day(walk):
    d = detect.detections(walk)
    z, p = values(d, "z_score"), values(walk, "price")
    r = [b / a - 1 for a, b in zip(p, p[1:])]
    assert z[:76] == [None] * 76 and z[76] is not None
    before = np.array(r[119 - 75 : 119])
    assert z[120] == pytest.approx((r[119] - before.mean()) / before.std(ddof=1)) and z[120] > 4
    assert values(d, "anomaly_flag")[120] and "shock" in values(d, "anomaly_type")[120]


def test_contract_switch_replaces_the_step(spark, walk):
    day = weekdays(140)[120]
    listed = spark.createDataFrame([("s", day, 0.01), ("s", dt.date(1990, 1, 1), 0.5)], "series string, date date, reported double")
    b = detect.back_adjusted(walk, listed)
    basis, price = values(b, "basis"), values(walk, "price")
    assert basis[-1] == price[-1] and basis[120] / basis[119] - 1 == pytest.approx(0.01)
    assert sum(values(b, "contract_switch")) == 1
    assert not values(detect.detections(b, basis="basis"), "daily_anomaly_flag")[120]


def test_episodes_merge_across_small_gaps(spark):
    def count(rows):
        flags = [("s", d, i in rows) for i, d in enumerate(weekdays(40))]
        return detect.episodes(spark.createDataFrame(flags, "series string, date date, anomaly_flag boolean")).count()

    assert count(set(range(5, 15))) == 1 and count({1, 2, 12, 13}) == 2 and count({4, 5, 7, 8}) == 1 and count(set()) == 0


@pytest.mark.parametrize(("prices", "n", "never", "median"), [([100.0] * 50 + [110.0] * 200, 1, 1, None), ([100.0] * 20 + [110.0, 109.0, 108.0, 104.0] + [104.0] * 20, 1, 0, 3.0)])
def test_half_life(spark, prices, n, never, median):
    rows = [("s", d, p) for d, p in zip(weekdays(len(prices)), prices)]
    df = spark.createDataFrame(rows, "series string, date date, price double").withColumn("m", detect.change("price"))
    got = one(detect.half_life(detect.first_passage(df, F.col("m") > 0.05)))
    assert (got.n, got.never_retraced, got.median_days) == (n, never, median)


def test_moves_next_to_a_negative_price_are_unusable(spark):
    rows = [("s", d, p) for d, p in zip(weekdays(6), [50.0, 20.0, -37.63, 10.01, 12.0, 13.0])]
    m = detect.move_record(detect.detections(spark.createDataFrame(rows, "series string, date date, price double")))
    assert values(m, "price_is_usable") == [False, True, False, False, True, True]


def test_factor_fit_leaves_planted_moves(spark):
    rng, days = np.random.default_rng(3), weekdays(200)
    x = rng.normal(0, 0.01, (200, 3))
    y = -2 * x[:, 0] + rng.normal(0, 0.001, 200)
    y[150] += 0.09
    rows = [("s", d, float(a), *map(float, b)) for d, a, b in zip(days, y, x)]
    got = factors.rolling_fit(spark.createDataFrame(rows, "series string, date date, y double, a double, b double, c double"), ("a", "b", "c"))
    z, left, r2 = values(got, "residual_z"), values(got, "residual"), values(got, "window_r2")
    assert z[:40] == [None] * 40 and z[40] is not None and z[150] > 5 and left[150] == pytest.approx(0.09, abs=0.01)
    lo = 100 - 75
    X = np.c_[np.ones(75), x[lo:100]]
    beta = np.linalg.lstsq(X, y[lo:100], rcond=None)[0]
    rest = y[lo:100] - X @ beta
    assert left[100] == pytest.approx(y[100] - np.r_[1, x[100]] @ beta) and z[100] == pytest.approx(left[100] / rest.std(ddof=1)) and r2[100] == pytest.approx(1 - rest.var() / y[lo:100].var())


def test_cross_series_null_is_not_calm(spark):
    rows = [("2020-01-01", "a", True), ("2020-01-01", "b", True), ("2020-01-01", "c", True), ("2020-01-02", "a", True), ("2020-01-02", "b", False), ("2020-01-02", "c", False), ("2020-01-03", "a", True), ("2020-01-03", "b", None)]
    flags = spark.createDataFrame(rows, "date string, series string, flag boolean")
    got = {r.date: r.verdict for r in factors.cross_verdicts(flags).where("series = 'a'").collect()}
    assert got == {"2020-01-01": "macro", "2020-01-02": "specific", "2020-01-03": "unclassified"}
    wide = {r.date: r for r in joins.aligned_flags(flags, ["a", "b", "c"]).collect()}
    assert wide["2020-01-03"].c is None and wide["2020-01-03"].b is None
    assert joins.as_one(flags, F.lit("all")).where("date = '2020-01-03'").first().flag is True


def test_as_of_takes_the_row_known_on_the_day(spark):
    left = spark.createDataFrame([("s", d) for d in (1, 5, 9)], "series string, at int")
    right = spark.createDataFrame([("s", 5, 1.0), ("s", 7, 2.0), ("t", 0, 9.0), ("s", None, 4.0)], "series string, known int, v double")
    assert [r.v for r in joins.as_of(left, right, ["series"], "at", "known", ["v"]).orderBy("at").collect()] == [None, 1.0, 2.0]


def test_every_day_with_a_far_day_has_a_donor(spark):
    start = dt.date(2020, 1, 1)
    days = [("a", start + dt.timedelta(i), "up") for i in [*range(60), 150]] + [("a", start + dt.timedelta(400), "down"), ("b", start, "up"), ("b", start + dt.timedelta(59), "up")]
    got = {(r.series, r.date): r.donor for r in joins.donors(spark.createDataFrame(days, "series string, date date, direction string")).collect()}
    assert set(got) == {("a", d) for _, d, w in days[:61]}
    assert all(got["a", start + dt.timedelta(i)] == start + dt.timedelta(150) for i in range(60))
    spread = [("a", start + dt.timedelta(7 * i), "up") for i in range(300)]
    drawn = {r.date: r.donor for r in joins.donors(spark.createDataFrame(spread, "series string, date date, direction string")).collect()}
    assert len(drawn) == 300 and all(abs((a - b).days) >= 60 for a, b in drawn.items())
    assert {a < b for a, b in drawn.items()} == {True, False} and len(set(drawn.values())) > 150


def test_month_gap_is_not_bridged(spark):
    months = [("s", dt.date(2020, m, 1), float(m)) for m in (1, 2, 4, 5)]
    df = monthly.month_changes(monthly.month_spine(spark.createDataFrame(months, "series string, month date, value double"), ["series"]), ["series"])
    assert [r.log_change is None for r in df.orderBy("month").collect()] == [True, False, True, True, False]


def test_pass_through_recovers_planted_lags(spark):
    rng, n = np.random.default_rng(5), 300
    x = rng.normal(0, 0.05, n)
    y = 0.02 * x + 0.03 * np.roll(x, 1) + 0.01 * np.roll(x, 6) + rng.normal(0, 0.0005, n)
    month = [dt.date(1990 + i // 12, i % 12 + 1, 1) for i in range(n)]
    rows = [("t", "d", m, float(a), float(b)) for m, a, b in zip(month, y, x)] + [("t", "u", m, float(a), float(rng.normal())) for m, a in zip(month, y)] + [("t", "short", m, 1.0, 2.0) for m in month[:20]]
    got = {r.driver: r for r in monthly.pass_through(spark.createDataFrame(rows, "target string, driver string, month date, y double, x double")).collect()}
    assert got["d"].sum_beta == pytest.approx(0.06, abs=0.005) and got["d"].early_beta == pytest.approx(0.05, abs=0.005) and got["d"].holm_p < 0.001
    assert got["u"].p > 0.01 and got["short"].p is None
    test = {r.driver: r for r in monthly.nowcast(spark.createDataFrame(rows, "target string, driver string, month date, y double, x double"), 96).collect()}
    assert test["d"].improvement_pct > 20 and test["d"].p < 0.01 and test["short"].n_test == 0


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", None), ("c", 0.04), ("d", 0.03)], "k string, p double")
    assert {r.k: r.holm_p and round(r.holm_p, 9) for r in monthly.holm_by_step(df, "p").collect()} == {"a": 0.03, "b": None, "c": 0.06, "d": 0.06}


def test_wilson_and_p_values(spark):
    r = one(spark.createDataFrame([(33, 33, 0, 0)], "k int, n int, a int, b int").select(numbers.rate("k", "n").alias("x"), numbers.rate("a", "b").alias("y")))
    assert r.x.hi == 100 and 89 <= r.x.lo <= 90 and r.y.pct is None and r.y.lo is None
    for z in (-3.0, -0.4, 0.0, 1.96, 4.0):
        got = one(spark.range(1).select(numbers.two_sided_p(F.lit(z)).alias("p"), numbers.one_sided_p(F.lit(z)).alias("q")))
        assert got.p == pytest.approx(math.erfc(abs(z) / 2**0.5), rel=1e-6) and got.q == pytest.approx(0.5 * math.erfc(z / 2**0.5), rel=1e-6)
    k = one(spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0, 4.0)], "x double").agg(numbers.sample_kurtosis("x").alias("k")))
    assert k.k == pytest.approx(3.152, abs=1e-3)


@pytest.mark.parametrize(("pub", "day", "age"), [("2024-03-01", "2024-03-04", 1), ("2024-03-02", "2024-03-04", 1), ("2024-03-04", "2024-03-04", 0), ("2024-03-05", "2024-03-04", -1), (None, "2024-03-04", None), ("2024-02-26", "2024-03-04", 5)])
def test_trading_days(spark, pub, day, age):
    assert one(spark.createDataFrame([(pub, day)], "a string, b string").select(dates.trading_days_before(F.to_date("a"), F.to_date("b")).alias("x"))).x == age


def test_dates(spark):
    df = spark.createDataFrame([("2024-12-05", "Mon, 03 Feb 2025 10:00:00 GMT", "20250203T070000Z", "bad")], "m string, rfc string, seen string, bad string")
    r = one(df.select(dates.known_from(F.to_date("m"), F.lit("price")).alias("a"), dates.known_from(F.to_date("m"), F.lit("consumer")).alias("b"), dates.feed_time("rfc").alias("c"), dates.seen_date("seen").alias("d"), dates.seen_date("bad").alias("e"), dates.year_chunks(F.lit("2023-05-01").cast("date"), F.lit("2025-02-03").cast("date")).alias("f")))
    assert (r.a, r.b) == (dt.date(2025, 1, 1), dt.date(2025, 1, 15)) and r.c.hour == 10 and r.d == dt.date(2025, 2, 3) and r.e is None
    assert [(x.first, x.last) for x in r.f] == [(dt.date(2023, 5, 1), dt.date(2023, 12, 31)), (dt.date(2024, 1, 1), dt.date(2024, 12, 31)), (dt.date(2025, 1, 1), dt.date(2025, 2, 3))]


def test_titles_and_quotes(spark):
    titles = ["Frost hits the crop - AP News - AP News", "Frost hits the crop - Reuters", "FROST hits the crop!", "Frost spares the crop", "Short one"]
    keys = [r.k for r in spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").orderBy("i").select(T.title_key("t").alias("k")).collect()]
    assert keys[0] == keys[1] == keys[2] == "frost hits the crop" and keys[3] != keys[0] and keys[4] == ""
    pairs = [("prices rose sharply on Monday", "Yesterday, Prices ROSE: sharply on monday.", True), ("prices rose", "prices rose", False), ("the market fell on news of rain", "rain made buyers sell all they had", False), ("ราคากาแฟเพิ่มขึ้นมาก", "วันนี้ราคากาแฟเพิ่มขึ้นมากแล้ว", True), ("a b c d e f g h i j", "a b c d e f g h x j", False), ("", "x", False)]
    got = [r.q for r in spark.createDataFrame([(i, q, t) for i, (q, t, _) in enumerate(pairs)], "i int, q string, t string").orderBy("i").select(T.quote_in_text("q", "t").alias("q")).collect()]
    assert got == [w for _, _, w in pairs]
    r = one(spark.range(1).select(T.citation_id(F.lit(" doc_ab ")).alias("a"), T.inline_sources(F.lit("x (source: doc_9f) y Source: 77")).alias("b"), T.numbers(F.lit("1,5 and 20")).alias("c"), T.clean_percent(F.lit("-3.5%")).alias("d"), T.clean_choice(F.lit(" UP "), ["up", "down"], None).alias("e"), T.clean_flag(F.lit("Yes")).alias("f"), T.clean_percent(F.lit("150")).alias("g")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("ab", ["9f", "77"], ["1.5", "20"], 3.5, "up", True, None)


def test_support_is_found_in_the_whole_text(spark, monkeypatch):
    from shocklens.plans import more

    frame = spark.createDataFrame([(1, "late word", "x " * 400 + "late word"), (2, "none", "x " * 400)], "document_id long, title string, text string")
    monkeypatch.setattr(more, "dated", lambda *_: frame)
    assert {r.document_id: r.support for r in more.fn_12_lexical_support(spark, "").collect()} == {1: 1.0, 2: 0.0}


def test_story_links_against_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(6)]
    docs = []
    for i in range(60):
        words = base[i % 6].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = "new"
        docs.append((i, f"title {i} of {i} alone {i}", " ".join(words), f"https://h{i % 4}.org/{i}"))
    df = spark.createDataFrame(docs, "document_id int, title string, text string, url string").withColumn("k", F.lit(1))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(56)} for i, _, t, _ in docs}
    want = {(a, b) for a in sets for b in sets if a < b and a % 4 != b % 4 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = {(r.a, r.b) for r in documents.story_links(df, ["k"]).collect()}
    # Equal texts on one host are one node; its pairs are those of its first document.
    first = {}
    for i, _, t, _ in docs:
        first.setdefault((t, i % 4), i)
    names = {i: first[t, i % 4] for i, _, t, _ in docs}
    # Edges may take another way than the pairs, the groups they make may not; every edge joins members of one group.
    def groups(edges):
        label = {i: i for i in names}
        for a, b in edges:
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
        return label

    assert groups(got) == groups({(names[a], names[b]) for a, b in want}) and len(set(groups(got).values())) < 60


def _reading(i, direction, age, kind="report", **more):
    return {"series": "s", "day": 1, "document_id": i, "direction": direction, "age": age, "kind": kind, "cause": "frost", "quote_found": True} | more


SCHEMA = "series string, day int, document_id int, direction string, age int, kind string, cause string, quote_found boolean, passed_gate boolean, this_market boolean, `when` string, seen_before_open boolean, move_pct double, move_size string, cause_type string"


@pytest.mark.parametrize(("rows", "variants", "decision", "confidence"), [
    ([], (), "REFUSE", None),
    ([_reading(1, "up", 0), _reading(2, "up", 0)], (), "EXPLAIN", "high"),
    ([_reading(1, "up", 0), _reading(2, "down", 0)], (), "EXPLAIN", "medium"),
    ([_reading(1, "down", 0), _reading(2, "up", 1), _reading(3, "up", 1)], (), "REFUSE", None),
    ([_reading(1, "down", 0, "pressure"), _reading(2, "up", 0)], (), "EXPLAIN", "medium"),
    ([_reading(1, "up", 3)], (), "REFUSE", None),
    ([_reading(1, "up", 0, quote_found=False)], (), "REFUSE", None),
    ([_reading(1, "up", 0, passed_gate=False)], ("gate_only",), "REFUSE", None),
    ([_reading(1, "up", 0, when="previous_day"), _reading(2, "down", 0)], ("current_moves",), "REFUSE", None),
    ([_reading(1, "up", 0, move_pct=0.5)], ("sized_support",), "REFUSE", None),
    ([_reading(1, "up", 0, move_size="large")], ("sized_support",), "EXPLAIN", "medium"),
    ([_reading(1, "up", 0, cause_type="trading")], ("event_reasons",), "REFUSE", None),
    ([_reading(1, "up", 0, move_pct=0.5)], ("size_consistent",), "REFUSE", None),
])
def test_decision_rule(spark, rows, variants, decision, confidence):
    days = spark.createDataFrame([("s", 1, "up", 4.0)], "series string, day int, direction string, move double")
    got = one(documents.decide(days, spark.createDataFrame(rows, SCHEMA), variants))
    assert (got.decision, got.confidence) == (decision, confidence)


def test_documents_keep_labels_and_latest(spark):
    old = spark.createDataFrame([(1, "yes"), (2, ""), (3, "no")], "id int, label string")
    new = spark.createDataFrame([(1, ""), (4, "")], "id int, label string")
    assert {r.id: r.label for r in documents.keep_labels(new, old, ["id"]).collect()} == {1: "yes", 3: "no", 4: None}
    assert {r.id: r.label for r in documents.keep_latest(old, new, ["id"]).collect()} == {1: "", 2: "", 3: "no", 4: ""}


def test_packing_takes_the_longest_step_that_fits(spark):
    docs = spark.createDataFrame([("s", i, i, "x" * 2000) for i in range(1, 5)], "k string, document_id int, place int, text string")
    for budget, chars, n in ((4 * 470, 1500, 4), (4 * 200, 600, 4), (150, 300, 3)):
        got = documents.packed(docs, ["k"], budget).collect()
        assert ({r.chars for r in got}, len(got)) == ({chars}, n)


def test_citation_audit(spark):
    shown = spark.createDataFrame([("r", "a1", "coffee rose on frost in the south 12"), ("r", "b2", "nothing of note")], "run_id string, document_id string, text string")
    claims = spark.createDataFrame([("r", 1, "frost in the south", "doc_a1"), ("r", 2, "wheat fell", "zz"), ("r", 3, "bulls were charging", "b2"), ("r", 4, "up 12 percent", "a1")], "run_id string, claim_id int, claim string, cited_id string")
    assert {r.claim_id: r.flag for r in citations.citation_audit(claims, shown).collect()} == {1: "ok", 2: "missing_document", 3: "weak_support", 4: "ok"}
    text = spark.createDataFrame([("r", "as said (source: doc_a1), and source: qq")], "run_id string, explanation string")
    assert [r.document_id for r in citations.unresolved_inline(text, shown).collect()] == ["qq"]


def test_curves_against_brute_force(spark):
    rng = random.Random(2)
    data = [(rng.randrange(10) / 10, rng.random() < 0.5, f"g{rng.randrange(4)}") for _ in range(200)]
    df = spark.createDataFrame(data, "score double, relevant boolean, grp string")
    p, n = [s for s, r, _ in data if r], [s for s, r, _ in data if not r]
    assert one(evaluate.auc(df)).auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in p for b in n) / len(p) / len(n))
    boot = one(evaluate.bootstrap_auc(df, "grp", 300))
    # Groups count a Poisson number of times: of 300 resamples of four groups some 300 e^-4 hold none and have no AUC.
    assert boot.lo <= one(evaluate.auc(df)).auc <= boot.hi and 285 <= boot.samples <= 300


def test_stratified_and_nearest(spark):
    days = [("s", d, "up" if i % 2 else "down", i == 7) for i, d in enumerate(weekdays(700))]
    got = rank.stratified(spark.createDataFrame(days, "series string, date date, direction string, forced boolean"), 12).collect()
    sizes = {}
    for r in got:
        sizes[r.stratum] = sizes.get(r.stratum, 0) + 1
    assert len(got) == 12 and max(sizes.values()) - min(sizes.values()) <= 1 and any(r.forced for r in got)
    v = np.random.default_rng(1).normal(size=(50, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>")
    near = rank.nearest(df, df.where("id < 3").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 4).collect()
    for q in range(3):
        s = v @ v[q]
        assert [r.id for r in sorted((r for r in near if r.query_id == q), key=lambda r: r.place)] == [i for i in np.argsort(-s) if i != q][:4]


def test_signal_vote_positioning_and_seasons(spark):
    votes = spark.createDataFrame([("s", "a", 2), ("s", "b", -1), ("s", "c", 1), ("t", "a", -2), ("t", "b", 0)], "series string, factor string, vote int")
    assert {r.series: (r.outlook, r.drivers) for r in brief.signal_vote(votes).collect()} == {"s": ("up", "a, b"), "t": ("down", "a")}
    weeks = spark.createDataFrame([("s", dt.date(2024, 1, 2) + dt.timedelta(7 * i), 50_000.0 + 5000 * i, 30_000.0) for i in range(10)], "series string, report_date date, noncommercial_long double, noncommercial_short double")
    p = one(brief.positioning_summary(weeks))
    assert p.net == 65_000 and p.change == 5000 and p.percentile >= 80
    calendar = spark.createDataFrame([("br", 1, "harvest", "rain", [5, 6]), ("br", 2, "flowering", "frost", [6, 9])], "origin string, ord int, phase string, risk string, months array<int>")
    got = {r.date.month: r.phase for r in brief.seasons(spark.createDataFrame([(dt.date(2024, m, 3),) for m in (6, 9, 12)], "date date"), calendar).collect()}
    assert got == {6: "harvest", 9: "flowering"}
    assert one(spark.range(1).select(brief.page_text(F.lit("<p>A&amp;B</p><script>x<1</script> <!-- no --><b>c</b>")).alias("t"))).t == "A&B c"


def test_landing(spark, tmp_path):
    (tmp_path / "macro.csv").write_text("observation_date,CPI\n2024-01-01,1.5\n2024-02-01,.\n2024-03-01,\n2024-04-01,2\n")
    assert [(r.series_id, r.value) for r in landing.macro_series(spark, str(tmp_path / "macro.csv")).orderBy("date").collect()] == [("CPI", 1.5), ("CPI", 2.0)]
    (tmp_path / "bad.csv").write_text("<html>\nno\n")
    with pytest.raises(ValueError):
        landing.macro_series(spark, str(tmp_path / "bad.csv"))
    head = "Market_and_Exchange_Names,CFTC_Contract_Market_Code,Report_Date_as_YYYY-MM-DD,Open_Interest_All,M_Money_Positions_Long_All,M_Money_Positions_Short_All"
    (tmp_path / "cot.csv").write_text(f"{head}\nCOFFEE C - ICE, 083 ,2024-01-02,10,5,x\nWHEAT - CBOT,001,2024-01-02,7,1,1\n")
    for code, name in (("083", "nothing"), ("999", "coffee")):
        r = one(landing.positioning(spark, str(tmp_path / "cot.csv"), code, name))
        assert (r.open_interest, r.noncommercial_short, r.commercial_long) == (10, 0, 0)
    raw = spark.createDataFrame([('{"PRECTOTCORR": {"20240101": 1.0, "20240102": -999}, "T2M_MIN": {"20240101": -1.5}}',)], "body string")
    assert [(r.prcp_mm, r.tmin_c, r.tmax_c) for r in landing.weather_json(raw).orderBy("date").collect()] == [(1.0, -1.5, None), (None, None, None)]
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title> A </title><link>http://a</link><pubDate>Mon, 03 Feb 2025 10:00:00 GMT</pubDate></item><item><title>B</title><link>http://b</link><pubDate>x</pubDate></item></channel></rss>")
    assert {r.title: r.published_at is not None for r in landing.feed_items(spark, str(tmp_path / "feed.xml")).collect()} == {"A": True, "B": False}
    (tmp_path / "coffee.csv").write_text("date,price\n2024-01-02,1.5\n2024-01-03,\n")
    assert {(r.series, r.price) for r in landing.prices(spark, str(tmp_path / "coffee.csv")).collect()} == {("coffee", 1.5), ("coffee", None)}
    (tmp_path / "log.json").write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    assert landing.json_log(spark, str(tmp_path / "log.json"), "a int").count() == 2
    (tmp_path / "sw.csv").write_text("date,reported_pct,verdict\n2024-01-02,1.5, exclude\n2024-01-03,x,EXCLUDE\n2024-01-04,2,KEEP\n")
    assert [r.reported for r in landing.switches(spark, str(tmp_path / "sw.csv")).collect()] == [0.015]
    (tmp_path / "sheet.csv").write_text("label,Coffee arabica,x\n1999M01,2.5,1\nnotes,,\n1999M02,..,1\n")
    assert [(str(r.month), r.value) for r in landing.monthly_sheet(spark, str(tmp_path / "sheet.csv"), "coffee").orderBy("month").collect()] == [("1999-01-01", 2.5), ("1999-02-01", None)]
    (tmp_path / "old.csv").write_text("model,latency_s\na,1\n")
    (tmp_path / "new.csv").write_text("model,latency_s,prompt_tokens\nb,2,30\n")
    assert {(r.model, r.prompt_tokens, r.output_tokens) for r in landing.call_log(spark, [str(tmp_path / "old.csv"), str(tmp_path / "new.csv")]).collect()} == {("a", None, None), ("b", 30.0, None)}
    landing.write_by_series(spark.createDataFrame([("a", 1), ("b", 2)], "series string, x int"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_tags_and_rates(spark):
    with pytest.raises(ValueError):
        runs.tagged(F.lit(1), "guess", "x")
    assert one(spark.range(1).select(runs.tagged(F.lit(1), "tested", "x").alias("t"))).t.tag == "tested"


def test_stories_collapse(spark):
    titles = ["Frost hits the crop - AP News - AP News", "Frost hits the crop - Reuters", "FROST hits the crop!", "Frost spares the crop"]
    docs = spark.createDataFrame([("s", i, t, f"text number {i}", f"https://www.h{i}.org/x") for i, t in enumerate(titles)], "series string, document_id int, title string, text string, url string")
    got = {r.document_id: (r.n_copies, len(r.duplicate_urls), r.syndication_domains) for r in documents.collapse_stories(docs, ["series"]).collect()}
    assert got == {0: (3, 2, ["h0.org", "h1.org", "h2.org"]), 3: (1, 0, ["h3.org"])}
    assert documents.collapse_stories(docs.limit(0), ["series"]).count() == 0
