"""The driver's tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean_of_cents(amount: str):
    """Mean of money amounts, summed as whole cents so that it does not hang on the order of rows."""
    return F.sum(F.round(F.col(amount) * 100).cast("long")).cast("double") / (F.lit(100.0) * F.count(F.lit(1)))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, price): mean order value by priority and day."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg(_mean_of_cents("o_totalprice").alias("price"))


def line_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, price): mean line value by return flag and ship day."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("date")).agg(_mean_of_cents("l_extendedprice").alias("price"))


def dated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with title (first line), url and a publication date made from the id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("document_id"), F.col("lang").alias("series"), F.substring_index("text", "\n", 1).alias("title"), "text",
        F.concat(F.lit("https://www."), "source", F.lit(".example/"), F.pmod("doc_id", F.lit(97)), F.lit("/#top")).alias("url"),
        F.date_add(F.to_date(F.lit("1999-01-01")), F.pmod("doc_id", F.lit(60)).cast("int")).alias("published"), F.length("text").alias("n_chars"))
