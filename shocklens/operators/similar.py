"""Texts that share most of their shingles: classes by exact Jaccard similarity, without the pairs of a family.

In a first pass every text meets a few centres with the same least hashes, which
joins a family of n copies with work in n. Then texts that share enough with
other classes go on. Two sets of a similarity t share one of their rarest
(1 - t) shingles, so only those are indexed. In a second pass
texts that are still in different classes meet under a shared shingle if the
places of that shingle in both orders leave room for the similarity. Every
link is decided by the two whole sets, and no link is left out that would join
two classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shocklens.operators import meetings
from shocklens.operators.graph import connected_components
from shocklens.session import saved

#: Texts under one shingle up to which their pairs are looked at in one row, and those of a share beyond.
FEW, SHARE = 48, 1024
#: Centres that a text is compared with in the first pass, and the pairs of least hashes by which it finds them.
CENTRES, BANDS = 3, 12


def rare_index(sets: DataFrame, keys: list[str], similar: float) -> DataFrame:
    """(keys, id, site, n, place, g, f) of the rarest shingles of each text that other texts hold too.

    ``sets`` is (keys, id, site, s). Places are counted from the rarest shingle
    on; those of one text alone come first and meet nothing.
    """
    # Three numbers move for each shingle; keys of equal hash share counts only, texts of two keys never meet.
    one = sets.dropna(subset=keys).select("id", F.xxhash64(*keys).alias("k"), F.explode("s").alias("g"))
    # Counted before they move, then met: a shingle of very many texts is split by the join and not held by a task.
    often = one.groupBy("k", "g").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    # As many entries as the text has shingles.
    ordered = one.join(often, ["k", "g"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("o"))
    ordered = ordered.join(sets.select(*keys, "id", "site", F.size("s").alias("n")), "id")
    alone = F.col("n") - F.size("o")
    most = F.greatest(F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1 - alone, F.lit(0)).cast("int")
    held = ordered.select(*keys, "id", "site", "n", alone.alias("alone"), F.posexplode(F.slice("o", 1, most)).alias("i", "x"))
    return held.select(*keys, "id", "site", "n", (F.col("alone") + F.col("i")).alias("place"), "x.g", "x.f")


def _room(a: str, b: str, similar: float) -> str:
    """Whether sets a and b can be that similar if the shingle at these places is the first that they share."""
    sized = f"least({a}.n, {b}.n) >= {similar}D * greatest({a}.n, {b}.n) - 1e-9D"
    return f"{sized} AND least({a}.n - {a}.place, {b}.n - {b}.place) * {1 + similar}D >= {similar}D * ({a}.n + {b}.n) - 1e-6D"


def _few(crowd: DataFrame, keys: list[str], similar: float) -> DataFrame:
    """(keys, a, b): pairs of different roots under shingles of at most ``FEW`` texts."""
    each = crowd.where(F.col("f") <= FEW).groupBy(*keys, "g").agg(F.collect_list(F.struct("id", "site", "root", "n", "place")).alias("m"))
    pairs = f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, {FEW}), y -> x.root <> y.root AND coalesce(x.site <> y.site, true) AND {_room('x', 'y', similar)}), y -> struct(least(x.id, y.id) AS a, greatest(x.id, y.id) AS b))))"
    return each.select(*keys, F.explode(F.expr(pairs)).alias("e")).select(*keys, "e.a", "e.b")


def _many(crowd: DataFrame, keys: list[str], similar: float) -> DataFrame:
    """The same under shingles of more texts: shares of them meet two by two, and a task holds two shares."""
    dealt = crowd.where(F.col("f") > FEW).withColumns({"shares": F.ceil(F.col("f") / SHARE).cast("int")}).withColumn("share", F.pmod(F.xxhash64("id", "g"), F.col("shares")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("other")
    tiles = dealt.select(*keys, "id", "site", "root", "n", "place", "g", "share", other)
    tiles = tiles.withColumns({"lo": F.least("share", "other"), "hi": F.greatest("share", "other")}).withColumn("second", (F.col("share") == F.col("hi")) & (F.col("lo") < F.col("hi")))
    kinds = dict(crowd.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", a {kinds['id']}, b {kinds['id']}"

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        ids, second = table.column("id"), table.column("second").to_numpy()
        root = np.unique(table.column("root").to_pylist(), return_inverse=True)[1]
        named: dict = {None: -1}
        site = np.array([named.setdefault(x, len(named)) for x in table.column("site").to_pylist()])
        n, place = (table.column(c).to_numpy().astype(float) for c in ("n", "place"))
        one = np.flatnonzero(~second)
        two = np.flatnonzero(second) if second.any() else one
        left, right = [], []
        for i in one.tolist():
            with_ = two if second.any() else two[two > i]
            ok = (root[with_] != root[i]) & ((site[with_] != site[i]) | (site[i] < 0)) & (np.minimum(n[with_], n[i]) >= similar * np.maximum(n[with_], n[i]) - 1e-9)
            ok &= np.minimum(n[i] - place[i], n[with_] - place[with_]) * (1 + similar) >= similar * (n[i] + n[with_]) - 1e-6
            left += [i] * int(ok.sum())
            right += with_[ok].tolist()
        a, b = (ids.take(pa.array(x, pa.int64())).to_pylist() for x in (left, right))
        ends = [(min(x, y), max(x, y)) for x, y in zip(a, b, strict=True)]
        columns = [pa.array([k.as_py()] * len(ends), k.type) for k in key[: len(keys)]]
        return pa.table([*columns, *(pa.array([e[j] for e in ends], ids.type) for j in (0, 1))], names=[*keys, "a", "b"])

    return tiles.groupBy(*keys, "g", "lo", "hi").applyInArrow(meet, schema)


def similar_links(sets: DataFrame, keys: list[str], similar: float) -> DataFrame:
    """(keys, a, b) with a < b: links whose components are those of all links of ``sets`` (keys, id, site, s).

    Two texts of one key link if the Jaccard similarity of their shingle sets
    is at least ``similar`` and they are not of one site (a null site is none).
    Sets must be distinct and not empty within a key, ids within the table;
    rows with a null among the keys link with nothing. A
    family around a centre costs its size; texts under one shingle that leave
    room for the similarity but do not reach it cost the square of their number
    over ``SHARE`` in rows.
    """
    sets = saved(sets.dropna(subset=keys).select(*keys, "id", "site", "s"))
    return links_among(sets.select(*keys, "id", "site", F.size("s").alias("n")), sets.select("id", "s"), keys, similar)


def links_among(texts: DataFrame, sets: DataFrame, keys: list[str], similar: float) -> DataFrame:
    """The same from ``texts`` (keys, id, site, n), without null keys, and ``sets`` (id, s), which may hold further ids; both are read several times."""
    bands = sets.select("id", F.arrow_udf(_bands, "array<long>")("s").alias("g"))
    banded = saved(texts.join(bands, "id").withColumn("g", F.explode("g")))
    firsts = banded.groupBy(*keys, "g", "site").agg(F.min(F.struct("id", "n")).alias("_e"))
    near = firsts.groupBy(*keys, "g").agg(F.min(F.struct("_e.id", "_e.n", "site")).alias("_c"))
    other = firsts.join(near, [*keys, "g"]).where("_e.id <> _c.id AND coalesce(site <> _c.site, true)").groupBy(*keys, "g").agg(F.min("_e").alias("_d"))
    met = banded.join(near, [*keys, "g"]).join(other, [*keys, "g"], "left")
    met = met.withColumn("c", F.when(F.coalesce(F.col("site") != F.col("_c.site"), F.lit(True)), F.struct("_c.id", "_c.n")).otherwise(F.col("_d")))
    met = met.where(f"c.id <> id AND least(n, c.n) >= {similar}D * greatest(n, c.n) - 1e-9D").withColumn("c", F.col("c.id"))
    # A text goes to the centres that it meets most often; what that leaves apart is settled below.
    met = met.groupBy(*keys, "id", "c").agg(F.count(F.lit(1)).alias("often"))
    best = F.row_number().over(Window.partitionBy(*keys, "id").orderBy(F.desc("often"), "c"))
    met = met.withColumn("place", best).where(F.col("place") <= CENTRES)
    first = saved(_confirmed(met.select(*keys, F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b")).distinct(), sets, keys, similar))
    roots = connected_components(first).withColumnRenamed("node", "id")
    left = saved(_left(texts.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), sets, keys, similar))
    left = saved(_among(sets, left).join(left, "id"))
    rooted = saved(rare_index(left, keys, similar).join(left.select("id", "root"), "id"))
    sites = (F.min("site") != F.max("site")) | (F.count("site") < F.count(F.lit(1)))
    apart = rooted.groupBy(*keys, "g").agg((F.min("root") != F.max("root")).alias("_apart"), F.coalesce(sites, F.lit(True)).alias("_sites"), F.count(F.lit(1)).alias("f")).where("_apart AND _sites")
    crowd = saved(rooted.drop("f").join(apart.drop("_apart", "_sites"), [*keys, "g"]))
    rest = _few(crowd, keys, similar).unionByName(_many(crowd, keys, similar)).distinct()
    return first.unionByName(_confirmed(rest, left, keys, similar))


def _bands(s: pa.Array) -> pa.Array:
    """``BANDS`` numbers of each set, each from the least of its shingles in two orders."""
    if len(s) > 1 and len(s.flatten()) > 1 << 18:
        return pa.concat_arrays([_bands(s[: len(s) // 2]), _bands(s[len(s) // 2 :])])
    flat, starts = s.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), s.offsets.to_numpy()[:-1] - s.offsets.to_numpy()[0]
    least = [np.minimum.reduceat(meetings.mixed(flat + np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 2**64))), starts) for j in range(2 * BANDS)]
    bands = np.stack([meetings.mixed(a ^ meetings.mixed(b + np.uint64(i))) for i, (a, b) in enumerate(zip(least[::2], least[1::2], strict=True))], axis=1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))


def _among(sets: DataFrame, texts: DataFrame, name: str = "id") -> DataFrame:
    """Of ``sets`` those whose id ``texts`` hold, and few others, so that few sets move in a join."""
    return sets.where(meetings.chosen(texts.select(F.xxhash64(name).alias("h")))(F.xxhash64("id")))


def _left(rooted: DataFrame, sets: DataFrame, keys: list[str], similar: float) -> DataFrame:
    """Those of ``rooted`` (keys, id, site, n, root) that share enough with sets of other roots to be similar to one."""
    def read(batch: pa.RecordBatch) -> tuple:
        s = batch.column("s")
        bounds = s.offsets.to_numpy().astype(np.int64)
        found = s.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(s)), np.diff(bounds))
        return None, batch.column("x").to_numpy(), batch.column("k").to_numpy(), bounds - bounds[0], found[np.lexsort((found, row))]

    words = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    looked = sets.join(rooted.select("id", F.xxhash64("root").alias("x"), F.xxhash64(*keys).alias("k")), "id").select("x", "k", "s")
    found = meetings.counts(meetings.met(looked, read, "", similar, words, similar))
    return rooted.join(found, F.xxhash64("root") == F.col("x")).where(F.col("c") >= meetings.least_met(F.col("n"), similar, similar)).select(*keys, "id", "site", "root")


def _confirmed(pairs: DataFrame, sets: DataFrame, keys: list[str], similar: float) -> DataFrame:
    """Those pairs that are similar by their whole sets."""
    pairs = saved(pairs)
    a, b = (_among(sets, pairs, x).select(F.col("id").alias(x), F.col("s").alias(f"_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("_n", F.size(F.array_intersect("_a", "_b")))
    return both.where(F.col("_n") / (F.size("_a") + F.size("_b") - F.col("_n")) >= similar).select(*keys, "a", "b")
