"""Further queries: text checks, small predicates, set operations and observations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shocklens.functions import text as T
from shocklens.functions.numbers import by_series, one_sided_p, two_sided_p
from shocklens.operators import brief, detect, documents, factors, forecast, joins, rank, reports
from shocklens.plans import BY, DETECTED, PRICES, query
from shocklens.plans.documents import _DATED, _SCORES, dated, with_scores
from shocklens.plans.prices import _BENCH, _CASES, _CHANGES, _WEATHER, FACTORS, _benchmark, _changes, cases, detected, factor_table, weather
from shocklens.plans.runs import _AUDITED, rule_06_citation_audit
from shocklens.sources import tables

_STOP = ["the", "and", "that"]


@query(as_text=("date",), sql=f"{PRICES} SELECT series, date, round(price, 6) AS price FROM prices WHERE date BETWEEN DATE '1997-10-01' AND DATE '1997-11-10'")
def prj_01_window(spark, sf_dir):
    return tables.daily_prices(spark, sf_dir).where(F.col("date").between(F.to_date(F.lit("1997-10-01")), F.to_date(F.lit("1997-11-10")))).select("series", "date", "price")


@query(as_text=("date",), sql=f"{DETECTED} SELECT series, date, CASE WHEN kind = 'trend' THEN NULL ELSE round(100 * r, 6) END AS flagged_move FROM det WHERE flag")
def prj_17_flagged_move(spark, sf_dir):
    return detected(spark, sf_dir).where("anomaly_flag").select("series", "date", F.when(F.col("anomaly_type") != "trend", 100 * F.col("return_pct")).alias("flagged_move"))


@query(f"{_SCORES} SELECT document_id, CAST(document_id % 6 AS INTEGER) AS age FROM sc WHERE document_id % 6 BETWEEN 0 AND 3")
def prj_13_recent(spark, sf_dir):
    return with_scores(spark, sf_dir).select("document_id", F.pmod("document_id", F.lit(6)).cast("int").alias("age")).where(F.col("age").between(0, 3))


@query("""SELECT page_id FROM pages WHERE regexp_extract(url, '://([^/?#]*)', 1) <> '' AND NOT regexp_matches(regexp_extract(url, '://([^/?#]*)', 1), '(?i)(^|\\.)example\\.net$')""")
def prj_14_text_wanted(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").where((T.host("url") != "") & ~T.host("url").rlike(r"(?i)(^|\.)example\.net$")).select("page_id")


@query("""SELECT doc_id, length(text) AS text_chars, source, lang FROM documents""")
def prj_27_source_records(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("text_chars"), "source", "lang")


@query(f"""{_DATED}, w AS (SELECT document_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zß-öø-ÿ]+'), lambda t: length(t) > 2 AND t NOT IN ('the', 'and', 'that'))) AS w FROM dated) SELECT document_id, len(w) AS words FROM w""")
def fn_03_content_words(spark, sf_dir):
    return dated(spark, sf_dir).select("document_id", F.size(T.content_tokens("text", _STOP)).cast("long").alias("words"))


@query()
def fn_05_title_keys(spark, sf_dir):
    return dated(spark, sf_dir).select("document_id", T.title_key("title").alias("title_key"))


@query(f"""{_DATED}, n AS (SELECT document_id, list_sort(list_distinct(regexp_extract_all(replace(text, ',', '.'), '[0-9]+(?:\\.[0-9]+)?'))) AS n FROM dated) SELECT document_id, array_to_string(n, ' ') AS numbers FROM n""")
def fn_11_numbers(spark, sf_dir):
    return dated(spark, sf_dir).select("document_id", F.array_join(F.array_sort(T.numbers("text")), " ").alias("numbers"))


@query()
def fn_12_lexical_support(spark, sf_dir):
    return dated(spark, sf_dir).select("document_id", T.lexical_support("title", "text").alias("support"))


@query()
def fn_14_quotes_checked(spark, sf_dir):
    items = tables.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    held = documents.quoted(tables.table(spark, sf_dir, "documents").select("doc_id", "text"), items)
    return held.select("doc_id", "item_id", T.quote_in_text("quote", "text").alias("quote_found"))


_UP, _DOWN = {"the": 1.0, "that": 0.35}, {"and": 1.0, "with": 0.35}


@query(f"""{_DATED}, w AS (SELECT document_id, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+') AS h, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS b FROM dated),
c AS (SELECT document_id, {' + '.join(f"{wt} * (2 * len(list_filter(h, lambda x: x = '{k}')) + len(list_filter(b, lambda x: x = '{k}')))" for k, wt in _UP.items())} AS u, {' + '.join(f"{wt} * (2 * len(list_filter(h, lambda x: x = '{k}')) + len(list_filter(b, lambda x: x = '{k}')))" for k, wt in _DOWN.items())} AS d FROM w)
SELECT document_id, round(CAST(u AS DOUBLE), 4) AS up, round(CAST(d AS DOUBLE), 4) AS down, CASE WHEN u > d THEN 'up' WHEN d > u THEN 'down' ELSE 'neutral' END AS direction FROM c""", digits=4)
def fn_16_price_direction(spark, sf_dir):
    d = dated(spark, sf_dir).select("document_id", documents.price_direction("title", "text", _UP, _DOWN).alias("x"))
    return d.select("document_id", "x.up", "x.down", "x.direction")


# Stand-in cues: words that the given texts have.
STAND_IN_CUES = [("wheat", "name", "de", "word", "der"), ("coffee", "name", "en", "word", "the"), ("gold", "name", "fr", "stem", "qu"), ("*", "price", "*", "part", "tion"), ("coffee", "exchange", "en", "word", "of the"), ("*", "report", "*", "stem", "vers"), ("*", "move", "*", "word", "and"), ("wheat", "retail", "de", "part", "ch"), ("*", "retail", "*", "word", "was")]


def with_market(docs):
    return docs.withColumn("market", F.when(F.col("series") == "en", "coffee").when(F.col("series") == "de", "wheat").otherwise("gold"))


@query()
def fn_17_report_scores(spark, sf_dir):
    return reports.report_scores(with_market(dated(spark, sf_dir)), reports.cue_table(spark, reports.CUES + STAND_IN_CUES)).select("document_id", "report_score")


@query()
def fn_18_focus_text(spark, sf_dir):
    return dated(spark, sf_dir).select("document_id", F.length(documents.focus_text("text", ["the", "tion"])).alias("focus_chars"))


@query(f"""{_DATED}, w AS (SELECT document_id, list_distinct(regexp_extract_all(lower(title), '[a-z]+')) AS t FROM dated), n AS (SELECT document_id, len(list_filter(t, lambda x: x IN ('the', 'of'))) AS s, len(list_filter(t, lambda x: x IN ('and', 'that'))) AS d, len(list_filter(t, lambda x: x IN ('que', 'der'))) AS e FROM w)
SELECT document_id, CASE WHEN s = 0 AND d = 0 AND e = 0 THEN 'other' WHEN s >= d AND s >= e THEN 'supply' WHEN d >= e THEN 'demand' ELSE 'event' END AS posture FROM n""")
def fn_19_posture(spark, sf_dir):
    return dated(spark, sf_dir).select("document_id", documents.posture("title", ["the", "of"], ["and", "that"], ["que", "der"]).alias("posture"))


@query(f"""{_DATED} SELECT document_id, text[1:120] AS excerpt, CASE WHEN document_id % 2 = 0 THEN 'query: ' || title ELSE 'passage: ' || title || '. ' || text[1:40] END AS embedded FROM dated""")
def fn_22_excerpts(spark, sf_dir):
    d = dated(spark, sf_dir)
    return d.select("document_id", F.substring("text", 1, 120).alias("excerpt"), F.when(F.col("document_id") % 2 == 0, F.concat(F.lit("query: "), "title")).otherwise(F.concat(F.lit("passage: "), "title", F.lit(". "), F.substring("text", 1, 40))).alias("embedded"))


@query(f"""{_DATED}, p AS (SELECT document_id, trim(title, ' ') AS t, trim(text, ' ') AS b FROM dated) SELECT document_id, 'query: ' || t AS query_text, sha256('passage: ' || concat_ws('. ', nullif(t, ''), nullif(b, ''))) AS passage_sha256 FROM p""")
def fn_45_embedded_texts(spark, sf_dir):
    return dated(spark, sf_dir).select("document_id", T.query_text("title").alias("query_text"), F.sha2(T.passage_text("title", "text"), 256).alias("passage_sha256"))


@query(as_text=("date",), sql=f"""{DETECTED}, m AS (SELECT *, lag(price) OVER (PARTITION BY series ORDER BY date) AS before FROM det) SELECT series, date, CASE kind WHEN 'shock' THEN format('{{:+.1f}}% on the day', 100 * r) WHEN 'trend' THEN format('{{:+.1f}}% over ten sessions', 100 * c) ELSE format('{{:+.1f}}% on the day, {{:+.1f}}% over ten sessions', 100 * r, 100 * c) END AS description FROM m WHERE flag""")
def prj_05_move_descriptions(spark, sf_dir):
    return detect.move_record(detected(spark, sf_dir)).where("anomaly_flag").select("series", "date", "description")


@query("""e AS (SELECT event_id, ts + INTERVAL 0 HOUR AS t FROM events) SELECT event_id, strftime(date_trunc('second', t) - CASE event_id % 3 WHEN 1 THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%d %H:%M:%S') AS at FROM e""")
def fn_25_feed_times(spark, sf_dir):
    """Times written in RFC 822, with and without a weekday, by zone name or offset."""
    i, t = F.col("event_id"), F.col("ts").cast("timestamp")
    plain = F.date_format(t, "d MMM yyyy HH:mm:ss")
    said = F.when(i % 3 == 0, F.concat(F.date_format(t, "EEE"), F.lit(", "), plain, F.lit(" GMT"))).when(i % 3 == 1, F.concat(plain, F.lit(" +0530"))).otherwise(F.concat(F.lit(" "), F.date_format(t, "EEE"), F.lit(", "), plain, F.lit(" +0000 ")))
    from shocklens.functions.dates import feed_time

    return tables.table(spark, sf_dir, "events").select("event_id", F.date_format(feed_time(said), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= (SELECT max(ts) FROM events)""")
def prj_09_closed_window(spark, sf_dir):
    """From a time to the last one, both included."""
    from shocklens.functions.dates import in_window

    e = tables.table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("_last"))
    return e.crossJoin(F.broadcast(last)).where(in_window("ts", F.to_timestamp(F.lit("2024-01-02")), "_last", closed=True)).select("event_id")


@query(f"{PRICES} SELECT series, count(*) AS days, min(year(date)) AS first_year, max(year(date)) AS last_year, max(year(date)) - min(year(date)) + 1 AS chunks FROM prices GROUP BY series")
def fn_30_year_chunks(spark, sf_dir):
    from shocklens.functions.dates import year_chunks

    p = tables.daily_prices(spark, sf_dir).groupBy("series").agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("a"), F.max("date").alias("b"))
    return p.select("series", "days", F.year("a").cast("long").alias("first_year"), F.year("b").cast("long").alias("last_year"), F.size(year_chunks("a", "b")).cast("long").alias("chunks"))


@query()
def fn_36_p_values(spark, sf_dir):
    return detected(spark, sf_dir).where("z_score IS NOT NULL").select("series", "date", two_sided_p("z_score").alias("p_two"), one_sided_p("z_score").alias("p_one"))


@query(as_text=("month",), sql=f"{_CHANGES} SELECT series, month, " + ", ".join(f"CAST(month(month) = {m} AS DOUBLE) AS m{m}" for m in range(2, 13)) + " FROM ch")
def fn_37_month_terms(spark, sf_dir):
    return _changes(spark, sf_dir).select("series", "month", *[(F.month("month") == m).cast("double").alias(f"m{m}") for m in range(2, 13)])


@query(as_text=("month",), sql=f"{_CHANGES} SELECT a.month, round(a.value * b.value / 1000, 2) AS converted FROM sp a JOIN sp b USING (month) WHERE a.series = '1-URGENT' AND b.series = '5-LOW'", digits=2)
def fn_38_product(spark, sf_dir):
    c = _changes(spark, sf_dir)
    a, b = c.where("series = '1-URGENT'").select("month", F.col("value").alias("x")), c.where("series = '5-LOW'").select("month", F.col("value").alias("y"))
    return a.join(b, "month").select("month", (F.col("x") * F.col("y") / 1000).alias("converted"))


@query(as_text=("date",), sql=f"{_CASES} SELECT series, date, u.c AS currency, round(y, 6) AS y, round(u.v, 6) AS fx_return FROM (SELECT series, date, y, unnest([{{'c': 'f_market', 'v': x0}}, {{'c': 'f_dollar', 'v': x1}}]) AS u FROM cases)")
def join_19_currencies(spark, sf_dir):
    c = cases(spark, sf_dir)
    return joins.currency_rows(c.select("series", "date", "y"), factor_table(spark, sf_dir).dropna().select("date", "f_market", "f_dollar"), ["f_market", "f_dollar"])


@query()
def dom_21_flagged_numeraire(spark, sf_dir):
    c = cases(spark, sf_dir)
    moves = joins.currency_rows(c.select("series", "date", "y"), factor_table(spark, sf_dir).dropna().select("date", "f_market", "f_dollar"), ["f_market", "f_dollar"])
    return factors.flagged_numeraire(moves, detected(spark, sf_dir)).select("series", "date", "anomaly_type", "survival", "reading")


@query("""d AS (SELECT doc_id, sha256(source || lang)[1:16] AS id, source, lang FROM documents) SELECT id, min(source) AS source, min(lang) AS lang, count(*) AS documents FROM d GROUP BY id""")
def join_12_id_lookup(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").withColumn("id", T.document_id(F.concat("source", "lang")))
    known = documents.first_by(d, F.col("id"), F.col("doc_id")).select("id", "source", "lang")
    return d.groupBy("id").agg(F.count(F.lit(1)).alias("documents")).join(known, "id").select("id", "source", "lang", "documents")


@query("""SELECT l.doc_id, quality, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS implied FROM labels l JOIN documents d USING (doc_id) WHERE quality <> CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END""")
def join_09_disagreements(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("implied"))
    return tables.table(spark, sf_dir, "labels").join(d, "doc_id").where("quality <> implied").select("doc_id", "quality", "implied")


@query(f"""{_DATED}, s AS (SELECT document_id, published AS date, n_chars + CAST(document_id % 50 = 0 AS INTEGER) AS text_chars FROM dated), a AS (SELECT *, bool_and(length(text) = text_chars) OVER (PARTITION BY date) AS ok FROM s JOIN dated USING (document_id)) SELECT document_id FROM a WHERE ok""")
def join_21_rebuilt_text(spark, sf_dir):
    d = dated(spark, sf_dir)
    listed = d.select("document_id", F.col("published").alias("date"), (F.col("n_chars") + (F.col("document_id") % 50 == 0).cast("int")).alias("text_chars"))
    return joins.rebuilt_text(listed, d.select("document_id", "text")).select("document_id")


@query("""c AS (SELECT conv_id AS run_id, turn, length(text) % 9 AS document_id FROM conversations), d AS (SELECT DISTINCT conv_id AS run_id, turn AS document_id FROM conversations) SELECT c.run_id, turn, c.document_id, d.run_id IS NOT NULL AS id_found FROM c LEFT JOIN d USING (run_id, document_id)""")
def join_22_citations(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations")
    cited = c.select(F.col("conv_id").alias("run_id"), "turn", (F.length("text") % 9).cast("long").alias("document_id"))
    return joins.citation_documents(cited, c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("document_id")).distinct()).select("run_id", "turn", "document_id", "id_found")


@query(as_text=("since", "until"), sql=f"""{PRICES}, l AS (SELECT *, CASE WHEN price >= lag(price) OVER w THEN 'up' ELSE 'down' END AS lean FROM prices WINDOW w AS {BY}), n AS (SELECT *, CAST(lean IS DISTINCT FROM lag(lean) OVER w AS INTEGER) AS fresh FROM l WINDOW w AS {BY}),
g AS (SELECT *, sum(fresh) OVER w AS run FROM n WINDOW w AS {BY}), e AS (SELECT series, run, min(lean) AS lean, count(*) AS length, min(date) AS since, max(date) AS until FROM g GROUP BY 1, 2) SELECT series, lean, length, since, until FROM e QUALIFY run = max(run) OVER (PARTITION BY series)""")
def win_20_streaks(spark, sf_dir):
    p = tables.daily_prices(spark, sf_dir)
    lean = F.when(F.col("price") >= F.lag("price").over(by_series()), "up").otherwise("down")
    return detect.latest_streak(p.withColumn("lean", lean), "lean")


@query(as_text=("date",), sql=f"{DETECTED}, b AS (SELECT series, quantile_cont(abs(r), 0.9) AS bar FROM det GROUP BY series) SELECT series, date FROM det JOIN b USING (series) WHERE abs(r) >= bar AND NOT flag")
def set_09_unflagged_large(spark, sf_dir):
    d = detected(spark, sf_dir)
    bars = d.groupBy("series").agg(F.percentile(F.abs("return_pct"), F.lit(0.9)).alias("bar"))
    large = d.join(bars, "series").where(F.abs("return_pct") >= F.col("bar")).select("series", "date")
    return large.exceptAll(d.where("anomaly_flag").select("series", "date"))


@query("""u AS (SELECT l_returnflag AS name, 0 AS priority, l_linestatus AS source, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 3 UNION ALL SELECT l_returnflag, 1, l_linestatus, count(*) FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 3)
SELECT name, CAST(priority AS INTEGER) AS priority, source, priority > 0 AS substitute FROM u QUALIFY row_number() OVER (PARTITION BY name ORDER BY priority) = 1""")
def set_04_sources(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    levels = li.select(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("name"), F.col("l_extendedprice").alias("value"), F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("priority"), F.col("l_linestatus").alias("source"))
    return documents.with_fallback(levels, ["A", "N"])[1]


@query(as_text=("date",), sql="""u AS (SELECT CAST(ts AS DATE) AS date, event_id, event_type FROM events) SELECT date, arg_max(event_type, event_id) AS last_type FROM u GROUP BY date""")
def set_06_last_by_date(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("date")).agg(F.max_by("event_type", "event_id").alias("last_type"))


@query(as_text=("day",), sql=f"{_SCORES} SELECT series, day, document_id, rank() OVER (PARTITION BY series, day ORDER BY best DESC) AS place FROM sc WHERE pass")
def rank_04_gate_ranking(spark, sf_dir):
    w = Window.partitionBy("series", "day").orderBy(documents.best_score().desc())
    return with_scores(spark, sf_dir).where(documents.passes()).select("series", "day", "document_id", F.rank().over(w).cast("long").alias("place"))


@query(f"{_AUDITED} SELECT run_id, claim_id, CAST(support_rank AS INTEGER) AS support_rank, shown FROM fa WHERE support_rank IS NOT NULL")
def rank_09_support_rank(spark, sf_dir):
    return rule_06_citation_audit(spark, sf_dir).where("support_rank IS NOT NULL").select("run_id", "claim_id", "support_rank", "shown")


@query()
def rank_17_label_sample(spark, sf_dir):
    return rank.label_sample(detected(spark, sf_dir).where("anomaly_flag"), 5).select("series", "date", "place")


@query()
def rule_05_normalised_readings(spark, sf_dir):
    """Every turn is shown and answered; each third answer names a document that was not shown, so that one stays unread."""
    c = tables.table(spark, sf_dir, "conversations")
    shown = c.select(F.lit("all").alias("series"), F.col("conv_id").alias("day"), F.col("turn").cast("string").alias("document_id"), "text")
    answers = c.select(F.lit("all").alias("series"), F.col("conv_id").alias("day"), F.col("turn").alias("position"), F.concat(F.lit("doc_"), F.when(F.col("turn") % 3 == 0, F.lit("not_shown")).otherwise(F.col("turn").cast("string"))).alias("raw_id"), F.element_at(F.array(F.lit(" UP"), F.lit("down"), F.lit("?")), (F.length("text") % 3 + 1).cast("int")).alias("raw_direction"), F.lit("Report").alias("raw_kind"), F.lit("frost").alias("raw_cause"), F.lit("-3%").alias("raw_move"), F.substring("text", 1, 40).alias("raw_quote"))
    return documents.normalised_readings(shown, answers)


@query()
def rule_08_explanations(spark, sf_dir):
    d = dated(spark, sf_dir).withColumnRenamed("published", "day")
    ordered = rank.reading_order(d, ["series", "day"], F.lit(0), F.lit(0), F.col("n_chars"), 4)
    days = d.select("series", "day").distinct()
    return documents.explanation_text(days, ordered.select("series", "day", "document_id", "place", "title", (F.col("document_id") % 3 != 0).alias("supports"))).select("series", "day", "explanation")


@query()
def dom_02_weather_observations(spark, sf_dir):
    return brief.observe_weather(brief.dryness(weather(spark, sf_dir)).withColumnRenamed("station_id", "series"))


@query(f"""{_WEATHER}, d AS (SELECT station_id AS place, date, prcp, tmin, row_number() OVER (PARTITION BY station_id ORDER BY date) AS n FROM days)
SELECT place, round(sum(prcp) FILTER (n <= 7), 6) AS rain_7, round(sum(prcp) FILTER (n <= 14), 6) AS rain_14, round(min(tmin) FILTER (n <= 7), 6) AS tmin_7, count(*) FILTER (tmin < 2) AS frost_days, count(*) FILTER (prcp < 1) AS dry_days FROM d GROUP BY place""")
def agg_16_forecast_totals(spark, sf_dir):
    return brief.forecast_totals(weather(spark, sf_dir).select(F.col("station_id").alias("place"), "date", F.col("prcp_mm").alias("precip"), F.col("tmin_c").alias("tmin")))


@query()
def dom_03_forecast_observations(spark, sf_dir):
    return brief.observe_forecast(agg_16_forecast_totals(spark, sf_dir))


@query(f"""{_BENCH}, j AS (SELECT p.series, p.date, 100 * (price - benchmark * (100 / 2.20462::DOUBLE)) / (benchmark * (100 / 2.20462::DOUBLE)) AS s FROM prices p ASOF LEFT JOIN bench b ON p.series = b.series AND p.date >= b.known_from)
SELECT series, 'benchmark' AS category, CAST(CASE WHEN abs(arg_max(s, date) FILTER (s IS NOT NULL)) > 10 THEN 1 ELSE 3 END AS INTEGER) AS importance FROM j GROUP BY series""")
def dom_04_benchmark_observations(spark, sf_dir):
    j = joins.as_of(tables.daily_prices(spark, sf_dir), _benchmark(spark, sf_dir), ["series"], "date", "known_from", ["benchmark"])
    return brief.observe_spread(joins.spread(j)).select("series", "category", "importance")


@query()
def dom_05_trend_observations(spark, sf_dir):
    return brief.observe_trend(detect.rolled(tables.daily_prices(spark, sf_dir)))


@query(f"""{DETECTED}, t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS back FROM det) SELECT series, count(*) FILTER (flag) AS flags, CAST(CASE WHEN count(*) FILTER (flag) > 0 THEN 1 ELSE 3 END AS INTEGER) AS importance FROM t WHERE back <= 7 GROUP BY series""")
def dom_08_move_observations(spark, sf_dir):
    return brief.observe_moves(detected(spark, sf_dir)).select("series", "flags", "importance")


@query()
def dom_09_news_observations(spark, sf_dir):
    d = dated(spark, sf_dir).withColumn("direction", documents.price_direction("title", "text", _UP, _DOWN)["direction"])
    return brief.observe_news(brief.news_lean(d, ["series"]))


@query()
def dom_14_outlook_frame(spark, sf_dir):
    w = brief.dryness(weather(spark, sf_dir)).where("station_id = 'N'").select("date", "dryness_z")
    return forecast.outlook_frame(tables.daily_prices(spark, sf_dir), 5, w).select("series", "date", "ret_5", "vol_20", "dryness_z", "forward")


@query(f"""{DETECTED}, v AS (SELECT series, arg_max(r, date) AS a, arg_max(c, date) AS b FROM det GROUP BY series), s AS (SELECT series, CAST(a > 0 AS INTEGER) + CAST(b > 0 AS INTEGER) AS up, CAST(a < 0 AS INTEGER) + CAST(b < 0 AS INTEGER) AS down FROM v)
SELECT series, CAST(up AS BIGINT) AS up, CAST(down AS BIGINT) AS down, CASE WHEN up > down THEN 'up' WHEN down > up THEN 'down' ELSE 'mixed' END AS lean, CASE WHEN up <> down AND least(up, down) = 0 THEN 0.8 ELSE 0.55 END::DOUBLE AS confidence FROM s""")
def agg_46_signal_agreement(spark, sf_dir):
    last = brief.latest(detected(spark, sf_dir))
    return brief.agreement(last.select("series", F.explode(F.array(F.signum("return_pct"), F.signum("cumulative_return"))).alias("vote")))


@query(as_text=("date",), sql=f"""{_CASES}, s AS (SELECT *, sum(y) OVER w AS sy, sum(x0) OVER w AS s0, count(*) OVER w AS n FROM cases WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT series, date, round(sy, 6) AS y, round(s0, 6) AS f_market FROM s WHERE n = 10""")
def win_09_cumulated(spark, sf_dir):
    return factors.cumulated(cases(spark, sf_dir), FACTORS).select("series", "date", "y", "f_market")




@query()
def set_07_stories(spark, sf_dir):
    return documents.collapse_stories(dated(spark, sf_dir), ["series"]).select("series", "document_id", "n_copies", F.size("duplicate_urls").alias("urls"), F.array_join("syndication_domains", ",").alias("domains"))


@query()
def rule_11_candidates(spark, sf_dir):
    d = with_market(dated(spark, sf_dir)).withColumn("day", F.to_date(F.lit("1999-02-15")))
    cues = reports.cue_table(spark, reports.CUES + STAND_IN_CUES)
    return documents.prepared_candidates(d, ["series"], 30, ["the", "tion"], ["and", "was"], cues).select("series", "document_id", "n_copies", "keyword_score", "report_score", "age")


@query(f"{_SCORES} SELECT document_id FROM sc WHERE best >= 0.05")
def prj_11_noise_floor(spark, sf_dir):
    return with_scores(spark, sf_dir).where(documents.best_score() >= documents.FLOOR).select("document_id")


@query(f"{_SCORES} SELECT document_id, round(best, 6) AS best_score FROM sc")
def fn_42_best_scores(spark, sf_dir):
    return with_scores(spark, sf_dir).select("document_id", documents.best_score().alias("best_score"))


@query("""r AS (SELECT conv_id, turn, CASE length(text) % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'unclear' END AS direction, CASE WHEN turn % 3 = 0 THEN 'pressure' ELSE 'report' END AS kind, turn % 4 AS age, length(text) > 30 AS found FROM conversations)
SELECT conv_id, turn FROM r WHERE direction <> 'unclear' AND found AND age BETWEEN 0 AND 2 AND kind = 'report'""")
def prj_15_usable_readings(spark, sf_dir):
    from shocklens.plans.documents import _days_and_readings

    days, rows = _days_and_readings(spark, sf_dir)
    out = documents.usable_readings(rows.join(days.select("series", "day", "move"), ["series", "day"]), ("reports_only",))
    return out.select(F.col("day").alias("conv_id"), F.col("document_id").alias("turn"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 OR conv_id % 5 = 0 THEN true WHEN turn % 3 = 0 THEN false WHEN turn % 2 = 0 THEN (turn % 4) >= 0.25 * (conv_id % 7) AND turn % 4 <> 0 OR (turn % 4 = 0 AND length(text) > 60) ELSE length(text) > 60 END AS matches FROM conversations""")
def prj_16_size_matches(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "pressure").otherwise("report").alias("kind"), F.when(F.col("turn") % 2 == 0, (F.col("turn") % 4).cast("double")).alias("move_pct"), F.when(F.length("text") > 60, "large").alias("move_size"), F.when(F.col("conv_id") % 5 != 0, (F.col("conv_id") % 7).cast("double")).alias("move"))
    return rows.select("conv_id", "turn", documents.matches_size(F.col("move")).alias("matches"))


@query()
def join_14_shifted_documents(spark, sf_dir):
    days = detect.move_record(detected(spark, sf_dir)).where("anomaly_flag AND direction IS NOT NULL").select("series", "date", "direction")
    pairs = joins.donors(days)
    docs = dated(spark, sf_dir).select("document_id", "published", F.col("published").alias("date"))
    return joins.shifted_documents(pairs, docs, ()).select("series", "date", "donor", "document_id", "published")


@query(as_text=("date",), sql="""d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), cal(origin, ord, phase, a, b) AS (VALUES ('north', 1, 'harvest', 5, 8), ('north', 2, 'flowering', 8, 11), ('south', 1, 'rest', 1, 4))
SELECT date, origin, arg_min(phase, ord) AS phase FROM d JOIN cal ON month(date) BETWEEN a AND b GROUP BY date, origin""")
def fn_31_seasons(spark, sf_dir):
    calendar = spark.createDataFrame([("north", 1, "harvest", "rain", [5, 6, 7, 8]), ("north", 2, "flowering", "frost", [8, 9, 10, 11]), ("south", 1, "rest", "none", [1, 2, 3, 4])], "origin string, ord int, phase string, risk string, months array<int>")
    days = tables.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return brief.seasons(days, calendar).select("date", "origin", "phase")


@query()
def fn_32_weather_in_context(spark, sf_dir):
    w = brief.dryness(weather(spark, sf_dir)).where("dryness_z IS NOT NULL")
    return w.select("station_id", "date", brief.weather_in_context(F.when(F.month("date") < 7, "flowering").otherwise("harvest"), F.col("dryness_z"), F.col("frost_7") > 3).alias("note"))


@query(f"""{PRICES}, l AS (SELECT *, max(date) OVER (PARTITION BY series) AS last FROM prices), n AS (SELECT series, arg_max(price, date) AS rate, arg_max(price, date) FILTER (date <= last - 7) AS w, arg_max(price, date) FILTER (date <= last - 30) AS m FROM l GROUP BY series)
SELECT n.series, round(rate, 4) AS rate, round(rate / w - 1, 4) AS week_change, round(rate / m - 1, 4) AS month_change, round((SELECT 100 * avg(CAST(price < rate AS INTEGER)) FROM l WHERE l.series = n.series AND date >= last - 365), 4) AS percentile FROM n""", digits=4)
def dom_07_currency_position(spark, sf_dir):
    return brief.currency_position(tables.daily_prices(spark, sf_dir).withColumnRenamed("price", "rate"))


@query()
def dom_06_positioning_observations(spark, sf_dir):
    from shocklens.plans.prices import agg_17_positioning

    return brief.observe_positioning(agg_17_positioning(spark, sf_dir))


@query("""SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 'one' ELSE 'other' END AS provider FROM documents""")
def fn_44_providers(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", T.provider("source", {"src1": "one", "src2$": "none"}).alias("provider"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events""")
def fn_43_nested_fields(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
