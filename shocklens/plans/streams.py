"""Streaming forms, run over the landed events until nothing new is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shocklens import streaming
from shocklens.plans import PRICES, query
from shocklens.session import shared_folder
from shocklens.sources import tables
from shocklens.streaming.snapshots import Snapshots


def landed(spark, sf_dir: str, name: str) -> DataFrame:
    """A stream over one table's files."""
    schema = tables.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows a stream gives for what has landed, written to the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").start(f"{base}/rows")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def news(spark, sf_dir):
    e = landed(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("seen_at"), F.col("user_id").cast("string").alias("document_id"))


@query(as_text=("day",), sql="""c AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, count(*) AS articles FROM events GROUP BY 1, 2) SELECT * FROM c WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 DAY FROM events)""")
def str_01_daily_counts(spark, sf_dir):
    return drained(streaming.daily_counts(news(spark, sf_dir)))


@query("""SELECT DISTINCT CAST(user_id AS VARCHAR) AS document_id FROM events""")
def str_02_first_articles(spark, sf_dir):
    return drained(streaming.first_articles(news(spark, sf_dir), "400 days").select("document_id"))


def micro_batches(stream: DataFrame, body) -> None:
    """Runs ``body(batch, id)`` over all that has landed."""
    base = f"{shared_folder(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.foreachBatch(body).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()


@query(as_text=("month",), sql="""f AS (SELECT l_returnflag AS name, date_trunc('month', l_shipdate)::DATE AS month, l_linenumber % 4 AS release, count(*) AS lines FROM lineitem GROUP BY 1, 2, 3)
SELECT name, month, CAST(max(release) AS INTEGER) AS release, arg_max(lines, release) AS lines FROM f WHERE month + CAST(30 * (1 + release) AS INTEGER) <= DATE '1997-06-30' GROUP BY 1, 2""")
def str_03_known_figures(spark, sf_dir):
    """Monthly figures in four releases, one batch each and the last one twice; on a given day the last release then known stands."""
    li = tables.table(spark, sf_dir, "lineitem")
    release = (F.col("l_linenumber") % 4).cast("int")
    figures = li.groupBy(F.col("l_returnflag").alias("name"), F.trunc("l_shipdate", "month").alias("month"), release.alias("release")).agg(F.count(F.lit(1)).alias("lines"))
    figures = figures.withColumn("known_from", F.date_add("month", 30 * (1 + F.col("release"))))
    base = f"{shared_folder(spark).rstrip('/')}/figures-{uuid.uuid4().hex}"
    figures.repartition(4, "release").write.partitionBy("release").parquet(f"{base}/landed")
    stream = spark.readStream.schema(figures.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landed")
    store = Snapshots(spark, f"{base}/table", ["name", "month"])

    def body(batch, batch_id):
        for _ in range(2):  # as after a lost driver
            streaming.merge_known(batch, store, "1997-06-30", ("release",), "figures", batch_id)

    micro_batches(stream, body)
    return store.read().select("name", "month", "release", "lines")


@query()
def str_05_alerts(spark, sf_dir):
    """Alerts of one landed batch of observations, which comes twice."""
    from shocklens.plans.prices import dom_11_brief

    base = f"{shared_folder(spark).rstrip('/')}/alerts-{uuid.uuid4().hex}"
    seen = dom_11_brief(spark, sf_dir)
    seen.coalesce(1).write.parquet(f"{base}/landed")  # a row a series and category

    def body(batch, batch_id):
        for _ in range(2):
            streaming.alerts(batch, batch_id, f"{base}/sink")

    micro_batches(spark.readStream.schema(seen.schema).parquet(f"{base}/landed"), body)
    return spark.read.schema("series string, level string, headline string").parquet(f"{base}/sink").select("series", "level", "headline")


@query()
def str_06_flag_sessions(spark, sf_dir):
    e = landed(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("series"), F.col("ts").cast("timestamp").alias("ts"))
    return drained(streaming.flag_sessions(e, "12 hours"))


@query(as_text=("date",), sql=f"""{PRICES}, r AS (SELECT *, price / lag(price) OVER w - 1 AS r FROM prices WINDOW w AS (PARTITION BY series ORDER BY date)),
b AS (SELECT *, CASE WHEN count(r) OVER f >= 75 THEN (r - avg(r) OVER f) / nullif(stddev_samp(r) OVER f, 0) END AS z FROM r WINDOW f AS (PARTITION BY series ORDER BY date ROWS BETWEEN 75 PRECEDING AND 1 PRECEDING))
SELECT series, date, round(z, 6) AS z_score, coalesce(abs(z) >= 2, false) AS flag, false AS refused FROM b""")
def str_04_live_flags(spark, sf_dir):
    folder = f"{shared_folder(spark).rstrip('/')}/closes-{uuid.uuid4().hex}"
    tables.daily_prices(spark, sf_dir).write.parquet(folder)
    closes = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    return drained(streaming.live_flags(closes)).select("series", "date", "z_score", "flag", "refused")
