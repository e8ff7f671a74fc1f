"""Queries that land tables as files and read them back through the scans.

What a scan reads is written by Spark from the given tables, into a new folder
of the shared one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shocklens.plans import DETECTED, PRICES, query
from shocklens.plans.prices import _LEVELS, _WEATHER, detected, factor_table, weather
from shocklens.session import shared_folder
from shocklens.sources import landing, tables


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/landed-{uuid.uuid4().hex}/{name}"


def csv(df: DataFrame, *by: str, **options: str) -> str:
    """Folder of CSV files with a header."""
    path = _folder(df.sparkSession, "csv")
    df.write.options(header=True, **options).partitionBy(*by).csv(path) if by else df.write.options(header=True, **options).csv(path)
    return path


def lines(df: DataFrame, *by: str) -> str:
    """Folder of JSON lines."""
    path = _folder(df.sparkSession, "json")
    df.write.partitionBy(*by).json(path) if by else df.write.json(path)
    return path


@query(as_text=("date",), sql=f"{PRICES} SELECT series, date, CASE WHEN day(date) <> 7 THEN round(price, 6) END AS price FROM prices")
def src_01_prices(spark, sf_dir):
    p = tables.daily_prices(spark, sf_dir).withColumn("price", F.when(F.dayofmonth("date") != 7, F.col("price").cast("string")).otherwise("NaN"))
    return landing.prices(spark, csv(p, "series"))


@query(as_text=("date",), sql=f"{DETECTED} SELECT series, date, round(price, 4) AS price, round(z, 4) AS z_score, round(cz, 4) AS cumulative_z_score, round(sd, 4) AS rolling_std, flag AS anomaly_flag, nullif(kind, '') AS anomaly_type, false AS contract_switch FROM det", digits=4)
def src_02_detections(spark, sf_dir):
    names = ["price", "z_score", "cumulative_z_score", "rolling_std"]
    d = detected(spark, sf_dir).select("series", "date", *[F.col(n).cast("decimal(38,10)").alias(n) for n in names], "anomaly_flag", "anomaly_type")
    return landing.detections(spark, csv(d, "series"))


@query(as_text=("date",), sql=f"{_LEVELS} SELECT date, round(f_dollar, 6) AS dollar, round(f_market, 6) AS equity, round(f_broad, 6) AS broad_commodity FROM fac")
def src_03_factors(spark, sf_dir):
    f = factor_table(spark, sf_dir).select("date", *[F.col(c).cast("decimal(38,12)").cast("string").alias(n) for c, n in (("f_dollar", "dollar"), ("f_market", "equity"), ("f_broad", "broad_commodity"))])
    return landing.factors(spark, csv(f))


@query(as_text=("date", "known_from"), sql=f"""{PRICES} SELECT series AS series_id, 'mean value' AS name, 'price' AS kind, date, round(price, 6) AS value, (date + 1)::DATE AS known_from FROM prices""")
def src_04_macro_long(spark, sf_dir):
    p = tables.daily_prices(spark, sf_dir)
    return landing.macro_long(spark, csv(p.select(F.col("series").alias("series_id"), F.lit("mean value").alias("name"), F.lit("price").alias("kind"), "date", F.col("price").alias("value"), F.date_add("date", 1).alias("known_from"))))


@query(as_text=("date",), sql=f"""{PRICES} SELECT 'MED' AS series_id, date, round(price, 6) AS value FROM prices WHERE series = '3-MEDIUM' AND day(date) % 5 <> 0""")
def src_05_macro_series(spark, sf_dir):
    p = tables.daily_prices(spark, sf_dir).where("series = '3-MEDIUM'")
    shown = F.when(F.dayofmonth("date") % 10 == 0, ".").when(F.dayofmonth("date") % 5 == 0, "").otherwise(F.col("price").cast("string"))
    return landing.macro_series(spark, csv(p.select(F.col("date").alias("observation_date"), shown.alias("MED"))))


_REPORTS = """rp AS (SELECT l_returnflag AS market, CAST(l_shipdate AS DATE) AS report_date, CAST(sum(l_linenumber) AS DOUBLE) AS oi, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE 0 END) AS DOUBLE) AS nl, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END) AS DOUBLE) AS ns FROM lineitem GROUP BY 1, 2)"""


def _reports(spark, sf_dir, names):
    li = tables.table(spark, sf_dir, "lineitem")
    long, short = (F.sum(F.when(F.col("l_linestatus") == s, F.col("l_linenumber")).otherwise(0)) for s in ("O", "F"))
    out = li.groupBy(F.col("l_returnflag").alias("market"), F.to_date("l_shipdate").alias("report_date")).agg(F.sum("l_linenumber").alias("oi"), long.alias("nl"), short.alias("ns"))
    code = F.when(F.col("market") == "A", "083731").otherwise("000001")
    return out.select(F.concat(F.lit("FLAG "), "market", F.lit(" - EXCHANGE")).alias(names[0]), code.alias(names[1]), F.col("report_date").alias(names[2]), F.col("oi").alias(names[3]), F.col("nl").alias(names[4]), F.col("ns").alias(names[5]))


@query(as_text=("report_date",), sql=f"{_REPORTS} SELECT report_date, oi AS open_interest, nl AS noncommercial_long, ns AS noncommercial_short, 0::DOUBLE AS commercial_long, 0::DOUBLE AS commercial_short FROM rp WHERE market = 'A'")
def src_06_positions(spark, sf_dir):
    names = ["Market_and_Exchange_Names", "CFTC_Contract_Market_Code", "Report_Date_as_YYYY-MM-DD", "Open_Interest_All", "M_Money_Positions_Long_All", "M_Money_Positions_Short_All"]
    return landing.positioning(spark, csv(_reports(spark, sf_dir, names)), "083731", "FLAG R")


@query(as_text=("report_date",), sql=f"{_REPORTS} SELECT report_date, oi AS open_interest, nl AS noncommercial_long, ns AS noncommercial_short, 0::DOUBLE AS commercial_long, 0::DOUBLE AS commercial_short FROM rp WHERE market = 'R'")
def src_07_legacy_positions(spark, sf_dir):
    """Tab-separated, and by name: no row has the code asked for."""
    names = ["Market and Exchange Names", "CFTC Contract Market Code", "As of Date in Form YYYY-MM-DD", "Open Interest (All)", "Noncommercial Positions-Long (All)", "Noncommercial Positions-Short (All)"]
    return landing.positioning(spark, csv(_reports(spark, sf_dir, names), sep="\t"), "999999", "flag r")


@query(as_text=("date",), sql=f"{_WEATHER} SELECT station_id, date, CASE WHEN day(date) <> 9 THEN round(prcp, 4) END AS prcp_mm, 20::DOUBLE AS tmax_c, round(tmin, 4) AS tmin_c FROM days", digits=4)
def src_08_weather_json(spark, sf_dir):
    """One document a station and month, as a service returns a span of days."""
    w = weather(spark, sf_dir).withColumn("d", F.date_format("date", "yyyyMMdd"))
    rain = F.when(F.dayofmonth("date") == 9, landing.WEATHER_FILL).otherwise(F.col("prcp_mm"))
    parts = [F.map_from_entries(F.collect_list(F.struct("d", v.alias("v")))) for v in (rain, F.lit(20.0), F.col("tmin_c"))]
    months = w.groupBy("station_id", F.date_trunc("month", "date")).agg(*[p.alias(f"m{i}") for i, p in enumerate(parts)])
    return landing.weather_json(months.select("station_id", F.to_json(F.create_map(F.lit("PRECTOTCORR"), "m0", F.lit("T2M_MAX"), "m1", F.lit("T2M_MIN"), "m2")).alias("body")), "body", "station_id")


@query(as_text=("date",), sql=f"{_WEATHER} SELECT date, station_id, round(prcp, 4) AS prcp_mm, NULL::DOUBLE AS tmax_c, round(tmin, 4) AS tmin_c FROM days", digits=4)
def src_09_station_records(spark, sf_dir):
    both = F.array(*[F.struct(F.lit(t).alias("datatype"), F.col(c).alias("value"), F.lit(p).alias("position")) for t, c, p in (("PRCP", "prcp_mm", 0), ("PRCP", "tmin_c", 1), ("TMIN", "tmin_c", 0))])
    return landing.station_wide(weather(spark, sf_dir).select("date", F.col("station_id").alias("station"), F.explode(both).alias("r")).select("date", "station", "r.*"))


@query(as_text=("date",), sql=f"{_WEATHER} SELECT station_id AS place, date, 20::DOUBLE AS tmax, round(tmin, 4) AS tmin, round(prcp, 4) AS precip, NULL::DOUBLE AS prob FROM days", digits=4)
def src_10_forecast_arrays(spark, sf_dir):
    """Parallel arrays of a place and month; the last one is empty."""
    w = weather(spark, sf_dir).withColumn("r", F.struct("date", "prcp_mm", "tmin_c"))
    rows = w.groupBy(F.col("station_id").alias("place"), F.date_trunc("month", "date").alias("m")).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return landing.forecast_days(rows.select("place", F.transform("r", lambda x: x["date"].cast("string")).alias("time"), F.transform("r", lambda x: F.lit(20.0)).alias("tmax"), F.transform("r", lambda x: x["tmin_c"]).alias("tmin"), F.transform("r", lambda x: x["prcp_mm"]).alias("precip"), F.array().cast("array<double>").alias("prob")))


@query(as_text=("month",), sql="""SELECT date_trunc('month', CAST(o_orderdate AS DATE))::DATE AS month, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1""")
def src_11_monthly_sheet(spark, sf_dir):
    m = tables.table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy'M'MM").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    sheet = m.select("period", F.lit("x").alias("Other"), F.col("n").alias("Orders, number")).unionByName(spark.createDataFrame([("Source: own", "", None)], 'period string, Other string, `Orders, number` long'))
    return landing.monthly_sheet(spark, csv(sheet), "orders")


@query(as_text=("publication_date",), sql="""SELECT lang || ' ' || doc_id // 100 AS query, CAST(row_number() OVER (PARTITION BY lang, doc_id // 100 ORDER BY doc_id) - 1 AS INTEGER) AS position, CAST(doc_id AS VARCHAR) AS title, 'https://x.example/' || doc_id AS url, '19990' || (1 + doc_id % 9) || '15T120000Z' AS seendate, source AS domain, '' AS language, '' AS sourcecountry,
make_date(1999, CAST(1 + doc_id % 9 AS INTEGER), 15) AS publication_date FROM documents""")
def src_12_articles(spark, sf_dir):
    """A response for each language and hundred of ids, as a service gives pages."""
    d = tables.table(spark, sf_dir, "documents")
    seen = F.concat(F.lit("19990"), (1 + F.col("doc_id") % 9).cast("string"), F.lit("15T120000Z"))
    item = F.struct("doc_id", F.col("doc_id").cast("string").alias("title"), F.concat(F.lit("https://x.example/"), "doc_id").alias("url"), seen.alias("seendate"), F.col("source").alias("domain"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("sourcecountry"))
    return landing.articles(d.groupBy(F.concat_ws(" ", "lang", F.floor(F.col("doc_id") / 100).cast("string")).alias("query")).agg(F.array_sort(F.collect_list(item)).alias("articles")))


@query(as_text=("day",), sql="""r AS (SELECT doc_id, lang AS series, DATE '1999-01-01' + CAST(doc_id % 60 AS INTEGER) AS day FROM documents)
SELECT series, doc_id, day, CASE WHEN doc_id % 4 <> 0 THEN CAST(3 + doc_id % 9 AS INTEGER) END AS pipeline_version, 'legacy' AS decision_mode, CASE WHEN doc_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction, doc_id % 6 <> 1 AS price_is_usable, doc_id % 10 = 0 AS is_fault, CASE WHEN doc_id % 3 <> 0 THEN 'EXPLAIN' END AS gate_decision, CAST(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 2 ELSE 1 END AS INTEGER) AS accepted FROM r""")
def src_15_stored_runs(spark, sf_dir):
    """Run documents of two layouts, one of which lacks the version, the gate and the usable mark."""
    i = F.col("doc_id")
    d = tables.table(spark, sf_dir, "documents")
    anomaly = F.struct(F.date_add(F.to_date(F.lit("1999-01-01")), (i % 60).cast("int")).cast("string").alias("date"), F.when(i % 2 == 0, "up").otherwise("down").alias("direction"), F.when(i % 6 == 1, F.lit(False)).alias("price_is_usable"))
    gate = F.when(i % 3 != 0, F.struct(F.lit("EXPLAIN").alias("decision"), F.when(i % 3 == 2, 1).alias("accepted_document_count"), F.when(i % 3 == 1, F.array(F.lit("a"), F.lit("b"))).alias("accepted_document_ids")))
    rows = d.select(F.col("lang").alias("series"), F.when(i % 4 != 0, (3 + i % 9).cast("string")).alias("pipeline_version"), anomaly.alias("anomaly"), F.struct(i.cast("string").alias("label"), F.when(i % 10 == 0, F.lit(True)).alias("is_fault")).alias("outcome"), gate.alias("gate_result"), F.struct(i.cast("string").alias("model_used")).alias("explanation_result"))
    return landing.stored_runs(spark, lines(rows, "series"), many_lines=False).select("series", F.col("model").cast("long").alias("doc_id"), "day", "pipeline_version", "decision_mode", "direction", "price_is_usable", "is_fault", "gate_decision", "accepted")


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN quality = 1 THEN 'EXPLAIN' ELSE 'refuse' END AS expected_outcome, CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'Medium ' WHEN 2 THEN 'high' ELSE '?' END AS label_confidence FROM labels WHERE doc_id % 4 IN (1, 2)""")
def src_16_labels(spark, sf_dir):
    grade = F.element_at(F.array(*map(F.lit, ("low", "Medium ", "high", "?"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = tables.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "EXPLAIN").otherwise("refuse").alias("expected_outcome"), grade.alias("label_confidence"))
    return landing.labels(spark, csv(rows, ignoreTrailingWhiteSpace="false"), "medium")


@query(as_text=("date",), sql=f"{PRICES} SELECT date, round(day(date) / 100::DOUBLE, 6) AS reported FROM prices WHERE series = '3-MEDIUM' AND month(date) = 3 AND day(date) % 3 = 0")
def src_17_switches(spark, sf_dir):
    p = tables.daily_prices(spark, sf_dir).where("series = '3-MEDIUM' AND month(date) = 3")
    day = F.dayofmonth("date")
    return landing.switches(spark, csv(p.select("date", F.when(day % 3 == 0, " exclude").when(day % 3 == 1, "KEEP").otherwise("EXCLUDE").alias("verdict"), F.when(day % 3 == 0, day.cast("string")).otherwise("n/a").alias("reported_pct"))))


@query("""SELECT event_id, event_type, value FROM events""")
def src_18_json_log(spark, sf_dir):
    return landing.json_log(spark, lines(tables.table(spark, sf_dir, "events").select("event_id", "event_type", "value")), "event_id LONG, event_type STRING, value DOUBLE")


@query("""SELECT event_id, value AS latency_s, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS DOUBLE) END AS prompt_tokens, NULL::DOUBLE AS output_tokens FROM events""")
def src_19_call_log(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    new = e.where("event_id % 2 = 0").select("event_id", F.col("value").alias("latency_s"), F.col("user_id").alias("prompt_tokens"))
    old = e.where("event_id % 2 <> 0").select("event_id", F.col("value").alias("latency_s"))
    return landing.call_log(spark, [csv(old), csv(new)]).select(F.col("event_id").cast("long").alias("event_id"), "latency_s", "prompt_tokens", "output_tokens")


@query(as_text=("start", "end"), sql="""m AS (SELECT o_orderpriority AS series, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1)
SELECT series, 'first month' AS label, a AS start, (a + 30)::DATE AS "end" FROM m UNION ALL SELECT series, 'last month', (b - 30)::DATE, b FROM m""")
def src_20_configured_events(spark, sf_dir):
    """A configured series for each series of the prices, with two events."""
    p = tables.daily_prices(spark, sf_dir).groupBy("series").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    window = lambda n, s, e: F.struct(F.lit(n).alias("label"), s.alias("start"), e.alias("end"))
    events = F.array(window("first month", F.col("a"), F.date_add("a", 30)), window("last month", F.date_sub("b", 30), F.col("b")))
    rows = p.select(F.col("series").alias("key"), F.col("series").alias("name"), events.alias("known_events"))
    return landing.configured(spark, lines(rows))[1].drop("note")


_REASON = "CASE WHEN doc_id % 7 = 3 THEN 'not a JSON object' WHEN doc_id % 11 = 5 THEN 'a field of another type' WHEN doc_id % 13 = 6 THEN 'no day' ELSE 'kept' END"


@query(f"SELECT lang AS series, {_REASON} AS reason, count(*) AS documents FROM documents GROUP BY 1, 2")
def src_15_run_rejects(spark, sf_dir):
    """Run documents of which some are cut off, some hold a text for a number and some have no day: all are counted."""
    i = F.col("doc_id")
    d = tables.table(spark, sf_dir, "documents")
    count = F.when(i % 11 == 5, '"many"').otherwise((i % 5).cast("string"))
    date = F.when(i % 13 == 6, "").otherwise(F.date_format(F.date_add(F.to_date(F.lit("1999-01-01")), (i % 60).cast("int")), "yyyy-MM-dd"))
    whole = F.format_string('{"pipeline_version": "11", "anomaly": {"date": "%s"}, "gate_result": {"accepted_document_count": %s}}', date, count)
    path = _folder(spark, "json")
    d.select("lang", F.when(i % 7 == 3, F.substring(whole, 1, 40)).otherwise(whole).alias("value")).withColumnRenamed("lang", "series").write.partitionBy("series").text(path)
    runs, rejects = landing.scanned_runs(spark, path, many_lines=False)
    lost = rejects.select(F.regexp_extract("file", "series=([^/]+)/", 1).alias("series"), "reason")
    return runs.select("series", F.lit("kept").alias("reason")).unionByName(lost).groupBy("series", "reason").agg(F.count(F.lit(1)).alias("documents"))


_SEEN = "TIMESTAMP '1999-01-01 06:30:00' + to_days(CAST(page_id % 60 AS INTEGER))"


@query(f"SELECT 'Page ' || page_id AS title, 'https://feed.example/' || page_id AS url, CASE WHEN page_id % 4 <> 0 THEN 'desk ' || page_id % 3 ELSE '' END AS source, CASE WHEN page_id % 10 <> 7 THEN strftime({_SEEN} - CASE WHEN page_id % 2 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END, '%Y-%m-%d %H:%M:%S') END AS published_at FROM pages")
def src_13_feed_items(spark, sf_dir):
    """Items of landed feeds, dated in RFC 822 with a zone name or an offset, some not at all."""
    i = F.col("page_id")
    seen = F.timestamp_add("DAY", (i % 60).cast("int"), F.to_timestamp(F.lit("1999-01-01 06:30:00")))
    shown = F.concat(F.date_format(seen, "EEE, dd MMM yyyy HH:mm:ss"), F.when(i % 2 == 0, " GMT").otherwise(" +0200"))
    items = tables.table(spark, sf_dir, "pages").select(F.concat(F.lit("Page "), i.cast("string")).alias("title"), F.concat(F.lit(" https://feed.example/"), i.cast("string")).alias("link"), F.when(i % 10 != 7, shown).otherwise("soon").alias("pubDate"), F.when(i % 4 != 0, F.concat(F.lit("desk "), (i % 3).cast("string"))).alias("source"))
    path = _folder(spark, "xml")
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return landing.feed_items(spark, path).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query(as_text=("day", "published"), sql="""a AS (SELECT doc_id, lang AS series, DATE '1999-01-01' + CAST(doc_id % 20 AS INTEGER) AS day, DATE '1999-01-01' + CAST(doc_id % 20 AS INTEGER) - CAST(doc_id % 7 AS INTEGER) + 2 AS said FROM documents)
SELECT series, day, CAST(doc_id AS VARCHAR) AS title, CASE WHEN doc_id % 9 <> 4 THEN said END AS published FROM a WHERE doc_id % 5 <> 0 AND (doc_id % 9 = 4 OR said <= day)""")
def src_14_manual_articles(spark, sf_dir):
    """Hand-collected articles of a series and day in three ways of writing a date; some without a url, some dated after the day."""
    i = F.col("doc_id")
    day = F.date_add(F.to_date(F.lit("1999-01-01")), (i % 20).cast("int"))
    said = F.date_add(F.date_sub(day, (i % 7).cast("int")), 2)
    forms = F.when(i % 9 == 4, "undated").when(i % 3 == 0, F.date_format(said, "yyyy-MM-dd")).when(i % 3 == 1, F.date_format(said, "d MMM yyyy")).otherwise(F.date_format(said, "yyyyMMdd"))
    rows = tables.table(spark, sf_dir, "documents").select(F.col("lang").alias("series"), day.alias("day"), i.cast("string").alias("title"), F.when(i % 5 != 0, F.concat(F.lit("https://m.example/"), i.cast("string"))).alias("url"), forms.alias("date"))
    # One list of a series and day in a file.
    lists = rows.groupBy("series", "day").agg(F.to_json(F.collect_list(F.struct("title", "url", "date"))).alias("value"))
    path = _folder(spark, "json")
    lists.write.partitionBy("series", "day").text(path)
    return landing.manual_articles(spark, path).select("series", "day", "title", "published")


@query(as_text=("first", "last"), sql=f"{DETECTED} SELECT series, count(*) AS days, count(*) FILTER (flag) AS flagged, min(date) AS first, max(date) AS last, round(sum(z), 4) AS z_sum FROM det GROUP BY series", digits=4)
def src_21_series_sink(spark, sf_dir):
    """Detector output written by series and read again."""
    path = _folder(spark, "sink")
    landing.write_by_series(detected(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("series").cast("string").alias("series")).agg(F.count(F.lit(1)).alias("days"), F.count_if("anomaly_flag").alias("flagged"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("z_score").alias("z_sum"))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, format('{:.2f}', round(value, 2)) AS value FROM events")
def src_22_manifest_sheet(spark, sf_dir):
    """A sheet with rounded numbers, written and read again."""
    path = _folder(spark, "sheet")
    landing.write_sheet(tables.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    return landing.read_sheet(spark, path).withColumn("value", F.format_string("%.2f", F.col("value").cast("double")))


@query("""l AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label FROM labels WHERE doc_id % 2 = 0)
SELECT CAST(coalesce(d.doc_id, l.doc_id) AS VARCHAR) AS document_id, CASE WHEN d.doc_id IS NOT NULL THEN split_part(text, chr(10), 1) ELSE 'old' END AS title, CASE WHEN d.doc_id IS NOT NULL THEN replace(text[1:300], chr(10), ' ') ELSE '' END AS text_snippet,
  '' AS semantic_score, CASE WHEN d.doc_id IS NOT NULL THEN format('{:.4f}', (d.doc_id % 50) / 100) ELSE '' END AS keyword_score, coalesce(label, '') AS human_label FROM (SELECT * FROM documents WHERE doc_id % 3 <> 1) d FULL JOIN l USING (doc_id)""")
def src_23_label_sheet(spark, sf_dir):
    """An earlier sheet with some labels meets newly sampled rows; the result goes to a sheet with empty columns and comes back."""
    d = tables.table(spark, sf_dir, "documents").where("doc_id % 3 <> 1")  # as sampled anew
    new = d.select(F.col("doc_id").alias("document_id"), F.lit("1999-01-01").alias("anomaly_date"), F.substring_index("text", "\n", 1).alias("title"), "text", (F.pmod("doc_id", F.lit(50)) / 100).alias("keyword_score"))
    first = tables.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.lit("1999-01-01").alias("anomaly_date"), F.lit("old").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("quality").cast("string")).otherwise(" ").alias("human_label"))
    earlier, path = _folder(spark, "sheet"), _folder(spark, "sheet")
    landing.write_label_sheet(first, earlier)
    landing.write_label_sheet(landing.label_sheet(new, landing.read_sheet(spark, earlier)), path)
    back = landing.read_sheet(spark, path)
    assert tuple(back.columns) == landing.LABEL_SHEET
    scored = F.when(F.col("keyword_score") != "", F.format_string("%.4f", F.col("keyword_score").try_cast("double"))).otherwise("")
    return back.select("document_id", "title", "text_snippet", "semantic_score", scored.alias("keyword_score"), "human_label")


@query("""SELECT lang AS series, CAST(DATE '1999-01-01' + CAST(doc_id % 60 AS INTEGER) AS VARCHAR) AS date, count(*) AS shown, CAST(sum(length(text)) AS BIGINT) AS text_chars FROM documents GROUP BY 1, 2""")
def src_24_shown_evidence(spark, sf_dir):
    """Texts as they were shown, written by series and day in order and read again."""
    i = F.col("doc_id")
    rows = tables.table(spark, sf_dir, "documents").select(F.col("lang").alias("series"), F.date_add(F.to_date(F.lit("1999-01-01")), (i % 60).cast("int")).cast("string").alias("date"), i.alias("place"), "text")
    path = _folder(spark, "shown")
    landing.write_shown(rows, path)
    back = spark.read.schema("series string, date string, place long, text string").json(path)
    return back.groupBy("series", "date").agg(F.count(F.lit(1)).alias("shown"), F.sum(F.length("text")).alias("text_chars"))
