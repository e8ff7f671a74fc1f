"""Orders, top-k, samples and vector search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shocklens.functions.numbers import col, draw, let, ratio

REPORT_SCORE = 3


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows; a bounded heap in each task, then one of n rows."""
    return df.orderBy(*order).limit(n)


def top_by(df: DataFrame, keys: list[str], n: int, *order: Column, name: str = "place") -> DataFrame:
    """The first n rows of each key, numbered."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def reading_order(docs: DataFrame, keys: list[str], age: str | Column, report_score: str | Column, relevance: str | Column, limit: int | None = None) -> DataFrame:
    """place: market reports newest first, then the others; ties by relevance and id. The move's direction plays no part."""
    is_report = (col(report_score) >= REPORT_SCORE).cast("int")
    w = Window.partitionBy(*keys).orderBy(is_report.desc(), col(age).asc_nulls_last(), col(relevance).desc_nulls_last(), F.col("document_id"))
    out = docs.withColumn("place", F.row_number().over(w))
    return out.where(F.col("place") <= limit) if limit else out


def direction_rerank(docs: DataFrame, keys: list[str], score: str | Column, strict: bool = False) -> DataFrame:
    """consistent, neutral, inconsistent, then by score; strict drops the inconsistent."""
    group = F.when(F.col("stance") == "consistent", 0).when(F.col("stance") == "inconsistent", 2).otherwise(1)
    out = docs.where(F.coalesce(F.col("stance") != "inconsistent", F.lit(True))) if strict else docs
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(group, col(score).desc_nulls_last(), "document_id")))


def rank_fusion(docs: DataFrame, keys: list[str], scores: list[str], k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over the score lists; a document without a score is not on that list."""
    out = docs
    for i, s in enumerate(scores):
        w = Window.partitionBy(*keys).orderBy(F.col(s).desc_nulls_last(), "document_id")
        out = out.withColumn(f"_r{i}", F.when(F.col(s).isNotNull(), 1 / (k + F.row_number().over(w))).otherwise(0.0))
    total = sum((F.col(f"_r{i}") for i in range(1, len(scores))), F.col("_r0"))
    return out.withColumn("fused", total).drop(*[f"_r{i}" for i in range(len(scores))])


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double; null if the lengths differ."""
    x, y = col(a), col(b)
    return F.when(F.size(x) == F.size(y), F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v))


def unit(a: str | Column) -> Column:
    """The vector over its length, found once; a vector of zeros has no direction (nulls)."""
    def over(norm: Column) -> Column:
        return F.transform(col(a), lambda x: F.try_divide(x.cast("double"), norm))

    return let(F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))), over)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096, chunk: int = 32768) -> DataFrame:
    """The k nearest vectors (id, v) of each query (query_id, q) by inner product, a query's own row left out.

    Queries are dealt to blocks and vectors to chunks of bounded size by hash;
    each block meets each chunk in one task as a matrix product, and only a
    query's k best of a chunk are shuffled. Nothing is broadcast. Vectors of
    another length than the query, or with nulls, are not among its nearest.
    """
    blocks, chunks = (max(1, -(-t.count() // n)) for t, n in ((queries, block), (vectors, chunk)))
    q = queries.select(F.col("query_id").cast("long").alias("i"), F.col("q").cast("array<double>").alias("v"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("c"))
    x = vectors.select(F.col("id").cast("long").alias("i"), F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))

    def matrices(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        ids, rows = t.column("i").to_numpy(), t.column("v").to_pylist()
        by: dict[int, list[int]] = {}
        for n, r in enumerate(rows):
            if r and None not in r:
                by.setdefault(len(r), []).append(n)
        return {size: (ids[held], np.array([rows[n] for n in held])) for size, held in by.items()}

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, given = matrices(left), matrices(right)
        out = [[], [], []]
        for size in asked.keys() & given.keys():
            (qi, qv), (xi, xv) = asked[size], given[size]
            for at in range(0, len(qi), 256):
                scores = qv[at : at + 256] @ xv.T
                scores[qi[at : at + 256, None] == xi] = -np.inf
                # All that reach the k-th best score, so that ties are settled by id later.
                bar = np.partition(scores, max(0, len(xi) - k), axis=1)[:, max(0, len(xi) - k)]
                r, c = np.nonzero((scores >= bar[:, None]) & np.isfinite(scores))
                for column, values in zip(out, (qi[at + r], xi[c], scores[r, c]), strict=True):
                    column.append(values)
        columns = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(float))], names=["query_id", "id", "score"])

    met = q.groupBy("b", "c").cogroup(x.groupBy("b", "c")).applyInArrow(meet, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "id", "score", "place")


def analogs(history: DataFrame, targets: DataFrame, features: list[str], k: int = 25, horizon: int = 20) -> DataFrame:
    """For each target row the k most alike rows of its series at least ``horizon`` rows earlier, on standardised features.

    ``targets`` (series, rn) is a short stated list. Means and spreads are of
    the rows before each target.
    """
    t = F.broadcast(targets.select(F.col("series").alias("_s"), F.col("rn").alias("target")))
    met = history.dropna(subset=features).join(t, (F.col("series") == F.col("_s")) & (F.col("rn") <= F.col("target") - horizon)).drop("_s")
    scale = met.groupBy("series", "target").agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_samp(f).alias(f"_d_{f}") for f in features])
    own = history.select("series", F.col("rn").alias("target"), *[F.col(f).alias(f"_t_{f}") for f in features])
    known = scale.join(own, ["series", "target"])
    rows = met.join(F.broadcast(known), ["series", "target"])
    parts = [F.pow(F.coalesce(ratio(F.col(f) - F.col(f"_t_{f}"), f"_d_{f}"), F.lit(0.0)), 2) for f in features]
    rows = rows.withColumn("distance", sum(parts[1:], parts[0]))
    return top_by(rows, ["series", "target"], k, F.col("distance"), F.col("rn")).select("series", "target", "rn", "distance", "place", "forward")


def analog_outlook(found: DataFrame) -> DataFrame:
    """Distribution of what followed the analogs, and the lean."""
    q = F.percentile("forward", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    out = found.groupBy("series", "target").agg(F.count("forward").alias("n"), q.alias("_q"), F.avg((F.col("forward") > 0).cast("double")).alias("share_up"))
    return out.select("series", "target", "n", *(F.col("_q")[i].alias(x) for i, x in enumerate(("p10", "p25", "median", "p75", "p90"))), "share_up", F.when(F.col("share_up") > 0.5, "up").when(F.col("share_up") < 0.5, "down").otherwise("flat").alias("lean"))


def stratified(days: DataFrame, n: int, seed: int = 11) -> DataFrame:
    """n days spread over year and direction: round robin over the strata, forced days first.

    Ranks inside a stratum are distributed; the last step keeps n rows.
    """
    inside = Window.partitionBy(F.year("date"), "direction").orderBy(F.col("forced").desc(), draw(seed, "series", "date"), "series", "date")
    return top(days.withColumn("_turn", F.row_number().over(inside)), n, F.col("forced").desc(), F.col("_turn"), draw(seed, "series", "date"), F.col("series"), F.col("date")).withColumn("stratum", F.concat_ws("-", F.year("date"), "direction")).drop("_turn")


def evenly_spaced(rows: DataFrame, n: int, keys: list[str], *order: Column) -> DataFrame:
    """Every len / n-th row of each key's ordered rows."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    # Row i is taken if it is the floor of some multiple of the step.
    take = (F.floor((F.col("_i") + 1) * n / F.col("_n") - 1e-12) > F.floor(F.col("_i") * n / F.col("_n") - 1e-12)) | (F.col("_n") <= n)
    return placed.where(take).drop("_i", "_n")


def quiet_days(df: DataFrame, since: str, n: int, largest: float = 0.5, seed: int = 11) -> DataFrame:
    """Days of small z with no flag near, from ``since`` on, round robin by year; needs near_flag."""
    rows = df.where((F.abs("z_score") < largest) & ~F.col("near_flag") & (F.col("date") >= F.to_date(F.lit(since))))
    inside = Window.partitionBy("series", F.year("date")).orderBy(draw(seed, "series", "date"), "date")
    return top_by(rows.withColumn("_turn", F.row_number().over(inside)), ["series"], n, F.col("_turn"), F.year("date")).drop("_turn")


def move_donors(quiet: DataFrame, shocks: DataFrame, seed: int = 11) -> DataFrame:
    """A real shock of the series, picked by seed, gives each quiet day size and sign, and its mirror image."""
    w = Window.partitionBy("series").orderBy("date")
    numbered = shocks.select("series", F.row_number().over(w).alias("_k"), F.col("return_pct").alias("move"))
    sizes = numbered.groupBy("series").agg(F.max("_k").alias("_n"))
    picked = quiet.select("series", "date").join(sizes, "series").withColumn("_k", (F.pmod(draw(seed, "series", "date"), F.col("_n")) + 1).cast("int"))
    return picked.join(numbered, ["series", "_k"]).select("series", "date", "move", (-F.col("move")).alias("mirror"))


def label_sample(flagged: DataFrame, per_series: int, seed: int = 11) -> DataFrame:
    """As many seeded flagged days of each series."""
    return top_by(flagged, ["series"], per_series, draw(seed, "date"), F.col("date"))
