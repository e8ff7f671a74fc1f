"""Landed files to tables, with declared schemas, and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shocklens.functions.dates import feed_time, seen_date

PRICES = "date DATE, price DOUBLE"
FACTORS = "date DATE, dollar DOUBLE, equity DOUBLE, broad_commodity DOUBLE"
MACRO = "series_id STRING, name STRING, kind STRING, date DATE, value DOUBLE, known_from DATE"
# Missing-value marks of landed weather and macro files.
WEATHER_FILL = -999.0
MISSING = ("", ".")


def series_name() -> Column:
    """The file's name without folder and ending, as series key."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)


def prices(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of date and price, one for each series, or in folders series=…"""
    rows = spark.read.schema(f"{PRICES}, series STRING").option("header", True).csv(path)
    return rows.select(F.coalesce("series", series_name()).alias("series"), "date", F.when(~F.isnan("price"), F.col("price")).alias("price"))


# Columns of detector output.
DETECTIONS = "date DATE, price DOUBLE, z_score DOUBLE, cumulative_z_score DOUBLE, rolling_std DOUBLE, anomaly_flag BOOLEAN, anomaly_type STRING"


def detections(spark: SparkSession, path: str) -> DataFrame:
    """CSV of detector output in folders series=…; an absent contract_switch column is false, another absent column an error."""
    raw = spark.read.option("header", True).csv(path)
    fields = [f.split() for f in DETECTIONS.split(", ")]
    if absent := [n for n, _ in fields if n not in raw.columns]:
        raise ValueError(f"not detector output, columns missing: {absent}")
    switch = F.coalesce(F.col("contract_switch").try_cast("boolean"), F.lit(False)) if "contract_switch" in raw.columns else F.lit(False)
    series = F.col("series") if "series" in raw.columns else series_name()
    return raw.select(series.alias("series"), *(F.col(n).try_cast(t).alias(n) for n, t in fields), switch.alias("contract_switch"))


# The parts of a stored run that the evaluation reads; layouts that lack some leave them null.
RUN = """pipeline_version STRING, decision_mode STRING, documents_retrieved INT, documents_retrieved_recent INT,
anomaly STRUCT<date: STRING, direction: STRING, pct_move: DOUBLE, z_score: DOUBLE, anomaly_type: STRING, price_is_usable: BOOLEAN>,
outcome STRUCT<tier: STRING, label: STRING, headline: STRING, detail: STRING, is_refusal: BOOLEAN, is_fault: BOOLEAN>,
gate_result STRUCT<decision: STRING, reason: STRING, best_score: DOUBLE, accepted_document_count: INT, accepted_document_ids: ARRAY<STRING>, total_documents_considered: INT>,
direction_summary STRUCT<consistent: INT, neutral: INT, inconsistent: INT>,
sources ARRAY<STRUCT<document_id: STRING, title: STRING, url: STRING, publication_date: STRING, trading_days_before_anomaly: INT, passed_gate: BOOLEAN, n_copies: INT, retrieval_score: DOUBLE, semantic_score: DOUBLE>>,
explanation_result STRUCT<decision: STRING, confidence: STRING, reason: STRING, explanation: STRING, model_used: STRING, citations: ARRAY<STRUCT<document_id: STRING, supports: STRING>>>"""


def scanned_runs(spark: SparkSession, path: str, many_lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """(runs, rejects): run documents, one to a file or one to a line, and those that are none.

    Every document is in one of the two tables, so a rate over runs knows what
    it left out. rejects is (file, reason, record): "empty file", "not a JSON
    object", "a field of another type", or "no day". The series is that of the
    document, of a folder series=… or of the file's name.
    """
    raw = spark.read.schema(f"{RUN}, series STRING, _corrupt STRING").option("multiLine", many_lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    file = F.col("_metadata.file_path")
    named = F.regexp_extract(file, r"pipeline_output_(.+)_\d{4}-\d{2}-\d{2}\.json$", 1)
    bare = F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in raw.columns if c not in ("series", "_corrupt")], F.lit(False))
    day = F.to_date(F.try_to_timestamp("anomaly.date"))
    reason = F.when(F.col("_corrupt").isNotNull() & ~bare, "not a JSON object").when(F.col("_corrupt").isNotNull(), "a field of another type").when(day.isNull(), "no day")
    judged = raw.withColumns({"_reason": reason, "_file": file})
    runs = judged.where("_reason IS NULL").select(
        F.coalesce("series", F.nullif(named, F.lit(""))).alias("series"), day.alias("day"), F.col("pipeline_version").try_cast("int").alias("pipeline_version"), F.coalesce("decision_mode", F.lit("legacy")).alias("decision_mode"),
        "anomaly.direction", F.col("anomaly.pct_move").alias("move"), F.coalesce("anomaly.price_is_usable", F.lit(True)).alias("price_is_usable"), "outcome.tier", F.coalesce("outcome.is_fault", F.lit(False)).alias("is_fault"), F.coalesce("outcome.is_refusal", F.lit(False)).alias("is_refusal"),
        F.col("gate_result.decision").alias("gate_decision"), F.col("gate_result.reason").alias("gate_reason"), F.coalesce("gate_result.accepted_document_count", F.size("gate_result.accepted_document_ids")).alias("accepted"), F.coalesce("gate_result.total_documents_considered", "documents_retrieved").alias("considered"),
        "direction_summary.consistent", "direction_summary.inconsistent", "explanation_result.decision", "explanation_result.confidence", F.col("explanation_result.model_used").alias("model"), "sources", "explanation_result.citations")
    kept = [c for c in raw.columns if c != "_corrupt"]
    rejects = judged.where("_reason IS NOT NULL").select(F.col("_file").alias("file"), F.col("_reason").alias("reason"), F.coalesce("_corrupt", F.to_json(F.struct(*kept))).alias("record"))
    if many_lines:
        # Of the files that the scan lists, on the driver as ever, those that gave no row.
        listed = spark.createDataFrame([(f,) for f in raw.inputFiles()], "file string")
        # A local path has one slash in a row's metadata and three in the list.
        plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        empty = listed.select(plain("file").alias("file")).join(judged.select(plain("_file").alias("file")), "file", "left_anti")
        rejects = rejects.unionByName(empty.select("file", F.lit("empty file").alias("reason"), F.lit("").alias("record")))
    return runs, rejects


def stored_runs(spark: SparkSession, path: str, many_lines: bool = True) -> DataFrame:
    """The runs of ``scanned_runs``."""
    return scanned_runs(spark, path, many_lines)[0]


def configured(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(series, events, controls) from JSON lines of configured series: key, name, price_file, known_events, control_period.

    One small row for each series; events and controls have series, label, start and end.
    """
    window = "STRUCT<label: STRING, start: DATE, end: DATE, note: STRING>"
    raw = spark.read.schema(f"key STRING, name STRING, price_file STRING, history_start DATE, known_events ARRAY<{window}>, control_period {window}").json(path)
    series = raw.select(F.col("key").alias("series"), "name", "price_file", "history_start")
    events = raw.select(F.col("key").alias("series"), F.explode("known_events").alias("e")).select("series", "e.*")
    return series, events, raw.where("control_period IS NOT NULL").select(F.col("key").alias("series"), "control_period.*")


def factors(spark: SparkSession, path: str, needed: tuple[str, ...] = ("dollar", "equity", "broad_commodity")) -> DataFrame:
    """CSV of daily factor returns; a missing factor column is an error."""
    found = spark.read.option("header", True).csv(path)
    if absent := [n for n in needed if n not in found.columns]:
        raise ValueError(f"factor columns missing: {absent}")
    return found.select(F.to_date("date").alias("date"), *(F.col(n).try_cast("double").alias(n) for n in needed))


def macro_long(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MACRO).option("header", True).csv(path)


def macro_series(spark: SparkSession, path: str) -> DataFrame:
    """Two-column CSV (date first, then value); empty and ``.`` rows are left out, another header is an error."""
    found = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    names = [c.lstrip("﻿").strip() for c in found.columns]
    if len(names) != 2 or names[0].lower() not in ("observation_date", "date"):
        raise ValueError(f"not a two-column series: {names}")
    raw = found.toDF("date", "value")
    return raw.where(~F.trim(F.coalesce("value", F.lit(""))).isin(*MISSING)).select(F.lit(names[1]).alias("series_id"), F.expr("try_cast(date AS DATE)").alias("date"), F.col("value").try_cast("double").alias("value")).dropna()


def resolved(df: DataFrame, candidates: dict[str, list[str]], optional: tuple[str, ...] = ()) -> DataFrame:
    """Columns under fixed names, each from the first candidate present; absent optional ones are zero."""
    have = {c.strip().lower(): c for c in df.columns}
    out = []
    for name, tries in candidates.items():
        found = next((have[t.lower()] for t in tries if t.lower() in have), None)
        if found is None and name not in optional:
            raise ValueError(f"no column for {name}: tried {tries}")
        out.append((F.col(f"`{found}`") if found else F.lit("0")).alias(name))
    return df.select(*out)


# Column names of weekly positioning reports.
POSITIONING = {
    "market": ["Market_and_Exchange_Names", "Market and Exchange Names"],
    "code": ["CFTC_Contract_Market_Code", "CFTC Contract Market Code"],
    "report_date": ["Report_Date_as_YYYY-MM-DD", "As of Date in Form YYYY-MM-DD"],
    "open_interest": ["Open_Interest_All", "Open Interest (All)"],
    "noncommercial_long": ["M_Money_Positions_Long_All", "Noncommercial Positions-Long (All)"],
    "noncommercial_short": ["M_Money_Positions_Short_All", "Noncommercial Positions-Short (All)"],
    "commercial_long": ["Prod_Merc_Positions_Long_All", "Commercial Positions-Long (All)"],
    "commercial_short": ["Prod_Merc_Positions_Short_All", "Commercial Positions-Short (All)"],
}


def positioning(spark: SparkSession, path: str, code: str, name_part: str) -> DataFrame:
    """Weekly positions of one market by code, by part of its name where the code matches nothing."""
    comma = spark.read.option("header", True).csv(path)
    raw = comma if len(comma.columns) >= 5 else spark.read.option("header", True).option("sep", "\t").csv(path)
    rows = resolved(raw, POSITIONING, ("commercial_long", "commercial_short"))
    coded = F.trim("code") == code
    named = F.contains(F.upper("market"), F.lit(name_part.upper()))
    any_code = rows.agg(F.coalesce(F.bool_or(coded), F.lit(False)).alias("_any"))
    kept = rows.crossJoin(F.broadcast(any_code)).where(F.when(F.col("_any"), coded).otherwise(named))
    numeric = [c for c in POSITIONING if c not in ("market", "code", "report_date")]
    return kept.select(F.expr("try_cast(report_date AS DATE)").alias("report_date"), *(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in numeric)).dropna(subset=["report_date"])


def weather_json(raw: DataFrame, column: str = "body", *keys: str) -> DataFrame:
    """Nested {parameter: {yyyymmdd: value}} to a row for each day, by ``keys`` (a station) beside the document."""
    parsed = raw.select(*keys, F.from_json(column, "map<string,map<string,double>>").alias("p"))
    long = parsed.select(*keys, F.explode("p").alias("name", "days")).select(*keys, "name", F.explode("days").alias("day", "value"))
    known = long.withColumn("value", F.when(F.col("value") != WEATHER_FILL, F.col("value")))
    return known.groupBy(*keys, F.to_date("day", "yyyyMMdd").alias("date")).pivot("name", ["PRECTOTCORR", "T2M_MAX", "T2M_MIN"]).agg(F.first("value")).withColumnsRenamed({"PRECTOTCORR": "prcp_mm", "T2M_MAX": "tmax_c", "T2M_MIN": "tmin_c"})


def station_wide(records: DataFrame) -> DataFrame:
    """Long (date, station, datatype, value) to wide; of repeats the smallest position stands."""
    first = records.groupBy("date", "station").pivot("datatype", ["PRCP", "TMAX", "TMIN"]).agg(F.min_by("value", "position"))
    return first.withColumnsRenamed({"PRCP": "prcp_mm", "TMAX": "tmax_c", "TMIN": "tmin_c", "station": "station_id"})


def forecast_days(raw: DataFrame) -> DataFrame:
    """Parallel daily arrays to rows; a missing tail is null."""
    names = ["time", "tmax", "tmin", "precip", "prob"]
    zipped = raw.select("place", F.explode(F.arrays_zip(*names)).alias("d"))
    return zipped.select("place", F.to_date("d.time").alias("date"), *(F.col(f"d.{n}").alias(n) for n in names[1:]))


def monthly_sheet(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Landed CSV of a monthly sheet: rows labelled like 1999M01, the column whose name starts with ``prefix``."""
    raw = spark.read.option("header", True).csv(path)
    value = next((c for c in raw.columns[1:] if c.strip().lower().startswith(prefix.lower())), None)
    if value is None:
        raise ValueError(f"no column starts with {prefix}")
    label = F.col(f"`{raw.columns[0]}`")
    return raw.where(label.rlike(r"^\d{4}M\d{2}$")).select(F.to_date(F.concat(F.regexp_replace(label, "M", "-"), F.lit("-01"))).alias("month"), F.col(f"`{value}`").try_cast("double").alias("value"))


def articles(raw: DataFrame) -> DataFrame:
    """articles[] of a news response to one schema, nulls to empty texts."""
    text = ["title", "url", "seendate", "domain", "language", "sourcecountry"]
    rows = raw.select("query", F.posexplode("articles").alias("position", "a")).select("query", "position", *(F.coalesce(F.col(f"a.{t}"), F.lit("")).alias(t) for t in text))
    return rows.withColumn("publication_date", seen_date("seendate"))


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files."""
    schema = "title STRING, link STRING, pubDate STRING, source STRING"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return rows.select(F.trim("title").alias("title"), F.trim("link").alias("url"), F.coalesce("source", F.lit("")).alias("source"), feed_time("pubDate").alias("published_at"))


def manual_articles(spark: SparkSession, path: str) -> DataFrame:
    """JSON lists by series and day (…/series/day.json, or folders series=…/day=…); entries without url or dated after the day go."""
    rows = spark.read.option("multiLine", True).schema("title STRING, url STRING, date STRING, text STRING").json(path)
    where = F.col("_metadata.file_path")
    # A folder series=… or day=… is a column already.
    series = F.col("series") if "series" in rows.columns else F.regexp_extract(where, r"([^/]+)/[^/]+$", 1)
    day = F.to_date("day") if "day" in rows.columns else F.to_date(F.regexp_extract(where, r"(\d{4}-\d{2}-\d{2})", 1))
    keyed = rows.select("title", "url", "date", "text", series.alias("series"), day.alias("day"))
    forms = [F.to_date(F.try_to_timestamp("date", F.lit(f))) for f in ("yyyy-MM-dd", "d MMM yyyy", "yyyyMMdd")]
    dated = keyed.withColumn("published", F.coalesce(*forms))
    return dated.where((F.coalesce("url", F.lit("")) != "") & F.coalesce(F.col("published") <= F.col("day"), F.lit(True)))


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, malformed ones skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def call_log(spark: SparkSession, paths: list[str], numeric: tuple[str, ...] = ("latency_s", "prompt_tokens", "output_tokens")) -> DataFrame:
    """Call logs of old and new layouts; numeric columns that a layout lacks are null."""
    both = None
    for p in paths:
        part = spark.read.option("header", True).csv(p)
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    return both.withColumns({n: (F.col(n) if n in both.columns else F.lit(None)).try_cast("double") for n in numeric})


def switches(spark: SparkSession, path: str) -> DataFrame:
    """Contract-switch days: EXCLUDE rows with a number, as fractions."""
    raw = spark.read.option("header", True).csv(path)
    return raw.where(F.upper(F.trim("verdict")) == "EXCLUDE").select(F.expr("try_cast(date AS DATE)").alias("date"), (F.col("reported_pct").try_cast("double") / 100).alias("reported")).dropna()


def labels(spark: SparkSession, path: str, least: str = "low") -> DataFrame:
    """Answer keys with a confidence of at least ``least``."""
    order = {"low": 0, "medium": 1, "high": 2}
    raw = spark.read.option("header", True).csv(path)
    grade = F.coalesce(*[F.when(F.lower(F.trim("label_confidence")) == k, v) for k, v in order.items()], F.lit(0))
    return raw.where(F.upper("expected_outcome").isin("EXPLAIN", "REFUSE", "EXCLUDE") & (grade >= order[least]))


def write_by_series(df: DataFrame, folder: str) -> None:
    """Parquet with a folder for each series, each written by tasks of its own."""
    df.repartition("series").write.mode("overwrite").partitionBy("series").parquet(folder)


def write_sheet(df: DataFrame, folder: str, round_to: int = 2) -> None:
    """CSV with rounded numbers, for people."""
    df.select(*[F.round(c, round_to).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").option("header", True).csv(folder)


# Columns of the sheet that people label, in their order; the last is filled in by hand.
LABEL_SHEET = ("document_id", "anomaly_date", "anomaly_move", "title", "url", "publication_date", "days_before_anomaly", "n_copies", "text_snippet", "keyword_score", "semantic_score", "anomaly_query_score", "human_label")


def label_sheet(rows: DataFrame, old: DataFrame | None = None, keys: tuple[str, ...] = ("document_id", "anomaly_date"), snippet: int = 300) -> DataFrame:
    """Rows as a sheet of ``LABEL_SHEET``, all texts; what a row lacks, and a label not given yet, is an empty text.

    Rows of ``old``, an earlier sheet, give their labels; its labelled rows
    that are not among the new ones stay as they were.
    """
    text = {"text_snippet": F.regexp_replace(F.substring(F.col("text"), 1, snippet), "\n", " ")} if "text" in rows.columns else {}
    rounded = {c: F.round(c, 4) for c, t in rows.dtypes if t == "double"}
    given = rows.withColumns(text | rounded)
    blank = lambda df: df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in LABEL_SHEET])
    new = blank(given.drop("human_label"))
    if old is None:
        return new
    marked = blank(old).where(F.trim("human_label") != "")
    labels = marked.select(*keys, F.col("human_label").alias("_given"))
    kept = new.join(labels, list(keys), "left").withColumn("human_label", F.coalesce("_given", F.lit(""))).select(*LABEL_SHEET)
    return kept.unionByName(marked.join(new.select(*keys), list(keys), "left_anti").select(*LABEL_SHEET))


def read_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """A sheet as it was written; empty cells are empty texts."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    return rows.fillna("")


def write_label_sheet(sheet: DataFrame, folder: str) -> None:
    """CSV with a header, empty columns among the others."""
    sheet.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)


def write_shown(df: DataFrame, folder: str) -> None:
    """The text given to a reader, by series and day, in order."""
    df.repartition("series", "date").sortWithinPartitions("series", "date", "place").write.mode("overwrite").partitionBy("series", "date").json(folder)
