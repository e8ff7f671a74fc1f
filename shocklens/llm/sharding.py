"""Sharding by extendible hashing.

A row's hash is a bit string. The directory maps prefixes of it to shards: a
bucket stays whole while its bytes fit the limit, and only an oversized one is
split on the next bit. A level of the directory is one aggregation over a fixed
number of prefix bits; the next level counts only rows of buckets that are
still too large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shocklens.llm.common import saved

LEVEL_BITS = 12
#: Rows of a directory that is broadcast to write the shards.
MAX_BROADCAST_SHARDS = 1_000_000
HASH_BITS = 60


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as text of 0 and 1."""
    digest = F.md5(key)
    return F.lpad(F.conv(F.substring(digest, 1, 15), 16, 2), HASH_BITS, "0")


def shard_key(doc_id: Column, text: Column) -> Column:
    """The id as text; rows without one are spread by what they hold."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))


def _level(sizes: DataFrame, above: int, limit: int) -> DataFrame:
    """Depth and bytes of the shard of each prefix of ``above`` + LEVEL_BITS bits; depth null if still too large."""
    deepest = above + LEVEL_BITS
    fine = sizes.groupBy(F.substring("bits", 1, deepest).alias("prefix")).agg(F.sum("size").alias("size"))
    grown = [fine.select(F.substring("prefix", 1, d).alias("bucket"), "size").groupBy("bucket").agg(F.sum("size").alias("shard_bytes")).where(F.col("shard_bytes") <= limit) for d in range(above + (above > 0), deepest + 1)]
    fits = reduce(DataFrame.unionByName, grown)
    # Of a fitting bucket the ancestors may fit as well: the shortest one is the shard.
    ways = fine.select("prefix", F.explode(F.sequence(F.lit(above), F.lit(deepest))).alias("depth"))
    ways = ways.select("prefix", "depth", F.expr("substring(prefix, 1, depth)").alias("bucket")).join(fits, "bucket")
    least = ways.groupBy("prefix").agg(F.min(F.struct("depth", "shard_bytes")).alias("s"))
    return fine.select("prefix").join(least, "prefix", "left").select("prefix", "s.depth", "s.shard_bytes")


def assign_shards(docs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, oversized) for every row of ``docs``.

    shard is the hash prefix that names it (empty: one shard holds all). Every
    shard's texts have at most ``limit`` bytes, but for one that 60 bits cannot
    split: a text above the limit, or rows repeated under one id; it is marked
    oversized. Null texts have no bytes. Rows without a doc_id are spread by
    their text. Other columns are ignored; an empty table gives an empty one.
    """
    return _placed(docs, limit).drop("bits")


def _placed(docs: DataFrame, limit: int) -> DataFrame:
    text = F.col("text").cast("string")
    rows = saved(docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(shard_key(F.col("doc_id"), text)).alias("bits")))
    open_rows, done, above = rows, [], 0
    while True:
        deepest = above + LEVEL_BITS
        sizes = open_rows.select("bits", F.col("n_bytes").alias("size"))
        level = saved(_level(sizes, above, limit))
        last = deepest >= HASH_BITS
        placed = open_rows.withColumn("prefix", F.substring("bits", 1, deepest)).join(level, "prefix")
        if last:
            whole = sizes.groupBy("bits").agg(F.sum("size").alias("all_bytes"))
            placed = placed.join(whole, "bits").withColumns({"depth": F.coalesce("depth", F.lit(HASH_BITS)), "shard_bytes": F.coalesce("shard_bytes", "all_bytes")})
        done.append(placed.where("depth IS NOT NULL").select("doc_id", "n_bytes", "bits", F.expr("substring(bits, 1, depth)").alias("shard"), "depth", "shard_bytes"))
        if last or level.where("depth IS NULL").limit(1).count() == 0:
            break
        open_rows = saved(placed.where("depth IS NULL").select("doc_id", "n_bytes", "bits"))
        above = deepest
    return reduce(DataFrame.unionByName, done).withColumn("oversized", F.col("shard_bytes") > limit)


def write_shards(docs: DataFrame, limit: int, folder: str) -> None:
    """Write every row of ``docs`` with one folder for each shard; a row finds its shard by its hash, which has one.

    The directory has a row a shard. Up to ``MAX_BROADCAST_SHARDS`` of them it
    is broadcast, and texts move once, to their shard; a longer one is joined.
    """
    placed = _placed(docs, limit)
    shards = saved(placed.select("shard", "depth").distinct())
    rows = docs.drop("shard").withColumn("_bits", hash_bits(shard_key(F.col("doc_id"), F.col("text").cast("string"))))
    if shards.count() <= MAX_BROADCAST_SHARDS:
        # No shard's prefix begins another's, so of the few depths in use one finds the row's.
        depths = sorted(r.depth for r in shards.select("depth").distinct().collect())
        for d in depths:
            listed = F.broadcast(shards.where(F.col("depth") == d).select(F.col("shard").alias(f"_s{d}")))
            rows = rows.join(listed, F.substring("_bits", 1, d) == F.col(f"_s{d}"), "left")
        rows = rows.withColumn("shard", F.coalesce(*[f"_s{d}" for d in depths]) if depths else F.lit("")).drop(*[f"_s{d}" for d in depths])
    else:
        rows = rows.join(placed.select(F.col("bits").alias("_bits"), "shard").distinct(), "_bits")
    rows.drop("_bits").repartition("shard").write.partitionBy("shard").parquet(folder)
