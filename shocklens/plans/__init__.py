"""Registered queries by the part of the inventory they cover, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def quoted(name: str) -> str:
    return f'"{name}"'


def query(sql: str | None = None, digits: int = 6, as_text: tuple[str, ...] = ()):
    """Registers a function under its name; its doubles are rounded, as in its SQL, and the columns ``as_text`` (dates, nullable flags) are texts."""
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if c in as_text else F.col(c) for c, t in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            whole = sql.strip() if sql.strip().startswith("SELECT") else "WITH " + sql.strip()
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({quoted(d)} AS VARCHAR) AS {quoted(d)}' for d in as_text)}) FROM ({whole})" if as_text else whole
        return f

    return register


# Pieces of SQL that several queries start from.
PRICES = """prices AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (CAST(100 AS DOUBLE) * count(*)) AS price FROM orders GROUP BY 1, 2)"""
LINES = PRICES.replace("o_orderpriority", "l_returnflag").replace("o_orderdate", "l_shipdate").replace("o_totalprice", "l_extendedprice").replace("orders", "lineitem").replace("prices AS", "lines AS")
BY = "(PARTITION BY series ORDER BY date)"
RETURNS = f"""{PRICES},
ret AS (SELECT *, price / nullif(lag(price) OVER w, 0) - 1 AS r, price / nullif(lag(price, 10) OVER w, 0) - 1 AS c, ln(price) - ln(lag(price) OVER w) AS lr, row_number() OVER w AS rn FROM prices WINDOW w AS {BY})"""
DETECTED = f"""{RETURNS},
base AS (SELECT *, CASE WHEN count(r) OVER f >= 75 THEN avg(r) OVER f END AS mu, CASE WHEN count(r) OVER f >= 75 THEN stddev_samp(r) OVER f END AS sd,
  CASE WHEN count(c) OVER f >= 75 THEN avg(c) OVER f END AS cmu, CASE WHEN count(c) OVER f >= 75 THEN stddev_samp(c) OVER f END AS csd
  FROM ret WINDOW f AS (PARTITION BY series ORDER BY date ROWS BETWEEN 75 PRECEDING AND 1 PRECEDING)),
zs AS (SELECT *, (r - mu) / nullif(sd, 0) AS z, (c - cmu) / nullif(csd, 0) AS cz FROM base),
det AS (SELECT *, coalesce(abs(z) >= 2, false) AS df, coalesce(abs(cz) >= 2, false) AS cf, coalesce(abs(z) >= 2, false) OR coalesce(abs(cz) >= 2, false) AS flag,
  CASE WHEN coalesce(abs(z) >= 2, false) AND coalesce(abs(cz) >= 2, false) THEN 'shock+trend' WHEN coalesce(abs(z) >= 2, false) THEN 'shock' WHEN coalesce(abs(cz) >= 2, false) THEN 'trend' ELSE '' END AS kind FROM zs)"""
# Event and control windows of the five series.
EVENTS = [("spring 1996", "1996-03-01", "1996-04-15"), ("autumn 1997", "1997-10-01", "1997-11-10"), ("summer 1999", "1999-07-01", "1999-08-01"), ("before the data", "1990-01-01", "1990-02-01")]
CONTROL = ("1998-02-01", "1998-04-30")
EVENTS_SQL = "events_dim(label, s, e) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in EVENTS) + ")"


def load() -> None:
    """Import the modules that register queries."""
    from shocklens.plans import checks, documents, evaluation, landed, more, prices, runs, stage, streams  # noqa: F401
