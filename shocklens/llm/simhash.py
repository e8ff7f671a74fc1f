"""SimHash near-duplicates: pigeonhole blocks, Hamming check, components.

A fingerprint is cut into five blocks. Two fingerprints that differ in at most
two bits agree on at least three blocks, so every close pair meets under one of
the ten block triples. Buckets of few members compare their pairs; larger ones
are linked through the points at distance one from a member, of which two
fingerprints share one exactly when they differ in two bits or fewer. Both ways
are exact, and neither emits the pairs of a large group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shocklens.llm.common import saved
from shocklens.operators.graph import connected_components

RADIUS = 2
#: Distinct fingerprints in a bucket up to which its pairs are compared.
SMALL_BUCKET = 16
_EDGES = (0, 13, 26, 39, 52, 64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_BLOCKS = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(_EDGES, _EDGES[1:], strict=False)]
_MASKS = [_signed(a | b | c) for a, b, c in combinations(_BLOCKS, 3)]
_FLIPS = [0, *(_signed(1 << i) for i in range(64))]


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the ``width``-word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], "<u8")
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), "<u8", len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long, one row for each row of ``docs``."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, fp long")


def _close(a: str, b: str) -> str:
    return f"bit_count({a} ^ {b}) <= {RADIUS}"


def links(distinct: DataFrame, small: int = SMALL_BUCKET) -> DataFrame:
    """Edges (a, b) over a table of distinct fingerprints ``fp`` whose components are those of all links."""
    blocks = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in _MASKS])
    keys = distinct.select("fp", F.posexplode(blocks).alias("part", "block"))
    buckets = saved(keys.groupBy("part", "block").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = buckets.where(f"n = 2 AND {_close('a', 'b')}").select("a", "b")
    shared = saved(keys.join(buckets.where("n > 2").select("part", "block", "n"), ["part", "block"]))
    each = shared.where(F.col("n") <= small).groupBy("part", "block").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    each = each.select(F.explode(F.expr(f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, {small}), y -> {_close('x', 'y')}), y -> struct(x AS a, y AS b))))")).alias("e"))
    crowd = shared.where(F.col("n") > small).select("fp").distinct()
    points = crowd.select("fp", F.explode(F.array(*[F.lit(x).cast("long") for x in _FLIPS])).alias("flip"))
    # At most 65 fingerprints lie within one bit of a point, so these sets are bounded.
    stars = points.groupBy(F.expr("fp ^ flip").alias("point")).agg(F.collect_set("fp").alias("m")).where("size(m) > 1")
    stars = stars.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    return pairs.unionByName(each.select("e.a", "e.b")).unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, small: int = SMALL_BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Two documents link if their fingerprints differ in at most two bits;
    component_id is the smallest doc_id reachable. Null, empty and blank texts
    have fingerprint zero and link like any other. Copies share a fingerprint
    and are handled as one. Null doc_ids stay in the result but never name a
    component (component_id is null only if all ids of it are). Other columns
    are ignored; an empty table gives an empty one.
    """
    prints = saved(fingerprints(docs, width))
    groups = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(groups.select("fp"), small))
    rooted = saved(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Similarity of shingle sets. At a Jaccard similarity of 0.8 about 15 % of the bits of two fingerprints
# differ, so no block of a fingerprint is both long enough to be selective and shared by most close pairs.
# There a block is the fingerprint of a small sample of the shingles instead: the two of smallest hash
# under one of twelve orders. Two sets of similarity j share a block with probability 1 - (1 - j^2)^12,
# at 0.8 over 0.99999. Then 256 bits are compared, and the sets themselves where these leave it open.
ORDERS = 12
WORDS = 4
#: Members of a crowded bucket that a task compares at once, and their shingles together.
SHARE, SHARE_SHINGLES = 256, 1 << 18
#: Columns of the membership matrix of a share that are held at once.
_WIDE = 1 << 13
_rng = np.random.default_rng(23)
_ORDER = _rng.integers(1, 1 << 63, ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = [f"h{i}" for i in range(WORDS)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending; of all words if they are fewer; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return np.unique(np.fromiter((digest(joined[s:e]) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts)))


def content_key(hashes: np.ndarray) -> int:
    """One signed number that names a shingle set."""
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes()))


def sketch(text: str | None, width: int = 5) -> tuple[list[int], list[int]]:
    """(four fingerprint words, twelve blocks) of the set of shingles, signed; no blocks without words."""
    return _sketch(shingle_set(text, width))


def _sketch(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(hashes):
        return [0] * WORDS, []
    ones = np.zeros(64 * WORDS, np.int64)
    least = np.full((2, ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        part = hashes[i : i + (1 << 12), None]
        bits = np.unpackbits(_mixed(part * _SPREAD).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
        least = np.sort(np.vstack([least, np.partition(_mixed(part * _ORDER), min(1, len(part) - 1), axis=0)[:2]]), axis=0)[:2]
    print_ = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)
    blocks = _mixed(_mixed(least[0]) + least[1])
    return print_.tolist(), blocks.view(np.int64).tolist()


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, content, size, h0, h1, h2, h3, blocks) for every row with a doc_id; content names the shingle set."""
    schema = "doc_id long, content long, size long, " + ", ".join(f"{h} long" for h in _SKETCH) + ", blocks array<long>"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = (shingle_set(t.as_py(), width) for t in batch.column(1))
            found = [(content_key(s), len(s), *_sketch(s)) for s in sets]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)] + [pa.array([f[2][i] for f in found], pa.int64()) for i in range(WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([f[3] for f in found], pa.list_(pa.int64()))], ["doc_id", "content", "size", *_SKETCH, "blocks"])

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, schema)


def furthest(similarity: float, deviations: float = 2.0) -> int:
    """Differing bits of 256 of sets that similar: the expected number and as many deviations."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    n = 64 * WORDS
    return round(n * p + deviations * (n * p * (1 - p)) ** 0.5)


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(content, held) with the shingle set of each ``wanted`` (content, doc_id); no other text is cut up."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(content_key, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["content", "held"])

    texts = docs.join(wanted.select(F.col("doc_id").alias("_id")), F.col("doc_id").cast("long") == F.col("_id"), "left_semi").select(F.col("text").cast("string"))
    return texts.mapInArrow(batches, "content long, held array<long>").dropDuplicates(["content"])


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those ``pairs`` (a, b) of contents whose shingle sets are similar.

    The join carries one set a pair, so a text in many pairs is met in a stream
    and not gathered.
    """
    one, two = (sets.select(F.col("content").alias(c), F.col("held").alias(f"_{c}")) for c in "ab")
    similar = f"size(array_intersect(_a, _b)) * {1 + similarity}D >= {similarity}D * (size(_a) + size(_b)) - 1e-6D"
    return pairs.join(two, "b").join(one, "a").where(similar).select("a", "b")


def similar_pairs(held: list[np.ndarray], similarity: float) -> np.ndarray:
    """Square table: which of these shingle sets are similar, from exact counts of their common shingles."""
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    owner = np.repeat(np.arange(len(held)), sizes)
    _, place, often = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    # Shingles of one set alone are in no intersection.
    column = np.cumsum(often > 1) - 1
    shared = often[place] > 1
    owner, place = owner[shared], column[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(held), len(held)), np.float32)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, _WIDE):
        low, high = np.searchsorted(place, [at, at + _WIDE])
        member = np.zeros((len(held), _WIDE), np.float32)
        member[owner[low:high], place[low:high] - at] = 1
        common += member @ member.T
    np.fill_diagonal(common, sizes)
    return common.astype(float) * (1 + similarity) >= similarity * (sizes[:, None] + sizes) - 1e-6


def spanning(similar: np.ndarray) -> np.ndarray:
    """For each member the smallest one that it reaches."""
    label = np.arange(len(similar))
    while True:
        least = np.minimum(label, np.where(similar, label, len(similar)).min(axis=1))
        if (least == label).all():
            return label
        label = least[least]


def _linked_in_tiles(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the roots that similar members of a tile join; ``rows`` is (tile, content, root)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        roots = table.column("root").to_numpy()
        if len(roots) < 2:
            return schema.empty_table()
        first = spanning(similar_pairs([x.values.to_numpy() for x in table.column("held")], similarity))
        joined = roots != roots[first]
        return pa.table([pa.array(roots[first][joined]), pa.array(roots[joined])], schema=schema)

    return rows.join(sets, "content").select("tile", "root", "held").groupBy("tile").applyInArrow(compare, "a long, b long")


def _n_shares(n: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / SHARE), F.ceil(F.col(shingles) / SHARE_SHINGLES), F.lit(1)).cast("int")


def _share_of(shares: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("share"), "content"), F.col(shares)).cast("int")


def _first_tiles(crowd: DataFrame) -> DataFrame:
    """(tile, content, root): the members of a crowded bucket in shares, with its centre in each of them."""
    shares = F.when(F.col("content") == F.col("centre"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(_share_of("shares")))
    dealt = crowd.select("block", "content", F.explode(shares).alias("share"))
    return dealt.select(F.xxhash64("block", "share").alias("tile"), "content", F.col("content").alias("root"))


def _second_tiles(crowd: DataFrame) -> DataFrame | None:
    """(tile, content, root) such that members of a bucket with different roots meet in some tile; None if there are none.

    A root of many members has shares of its own, the others of a bucket have
    shares together. A tile is two shares that are not of one root.
    """
    counted = saved(crowd.groupBy("block", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w")))
    mixed = counted.groupBy("block").agg(F.count(F.lit(1)).alias("roots")).where("roots > 1").select("block")
    if mixed.isEmpty():
        return None
    counted = counted.join(mixed, "block").withColumn("k", _n_shares("n", "w"))
    own = counted.where("k > 1").select("block", "root", "k")
    pool = counted.where("k = 1").groupBy("block").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).select("block", _n_shares("n", "w").alias("pool"))
    listed = own.select("block", F.col("root").alias("owner"), "k").unionByName(pool.select("block", F.lit(None).cast("long").alias("owner"), F.col("pool").alias("k")))
    name = F.xxhash64("owner", "i")
    listed = saved(listed.select("block", "owner", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).select("block", "owner", name.alias("share")))
    other = listed.select(F.col("block").alias("_block"), F.col("owner").alias("_owner"), F.col("share").alias("_share"))
    tiles = listed.join(other, F.expr("block = _block AND share <= _share AND coalesce(owner <> _owner, true)"))
    ends = tiles.select("block", F.explode(F.array_distinct(F.array("share", "_share"))).alias("share"), F.xxhash64("block", "share", "_share").alias("tile"))
    placed = crowd.join(own, ["block", "root"], "left").join(pool, "block", "left")
    placed = placed.select("block", "content", "root", F.when(F.col("k").isNotNull(), F.col("root")).alias("owner"), F.coalesce("k", "pool").alias("k"))
    placed = placed.where("k IS NOT NULL").withColumn("i", _share_of("k")).select("block", "content", "root", name.alias("share"))
    return placed.join(ends, ["block", "share"]).select("tile", "content", "root")


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, small: int = SMALL_BUCKET) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id, linked by the similarity of their shingle sets.

    All pairs that share one of twelve buckets are decided, and a link is
    always confirmed by the two shingle sets. In buckets of up to ``small``
    texts, sizes and fingerprints to four deviations choose the pairs whose
    sets are compared. Larger buckets are dealt to shares of bounded size, each
    with the bucket's centre; a share counts the common shingles of its members
    by matrix products. What is still apart then meets share by share: work
    beyond a bucket's size is done only between members that are in different
    groups so far. Texts without words are one group. Other columns are
    ignored.
    """
    drawn = saved(sketches(docs, width))
    groups = saved(drawn.groupBy("content").agg(F.min(F.struct("doc_id", "size", *_SKETCH, "blocks")).alias("g")).select("content", "g.*"))
    bits = furthest(similarity, 4.0)
    keys = groups.select("content", "size", *_SKETCH, F.explode("blocks").alias("block"))
    buckets = keys.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"), F.min("content").alias("centre")).where("n > 1")
    met = saved(keys.join(buckets, "block"))

    def close(a: str, b: str) -> str:
        sized = f"least({a}.size, {b}.size) >= {similarity} * greatest({a}.size, {b}.size) - 1e-9"
        return f"{sized} AND " + " + ".join(f"bit_count({a}.{h} ^ {b}.{h})" for h in _SKETCH) + f" <= {bits}"

    each = met.where(F.col("n") <= small).groupBy("block").agg(F.collect_list(F.struct("content", "size", *_SKETCH)).alias("m"))
    each = each.select(F.explode(F.expr(f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, {small}), y -> {close('x', 'y')}), y -> struct(x.content AS a, y.content AS b))))")).alias("e"))
    pairs = saved(each.select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).distinct())
    crowd = saved(met.where(F.col("n") > small).select("block", "content", "size", "centre", _n_shares("n", "w").alias("shares")))
    wanted = pairs.select(F.col("a").alias("content")).unionByName(pairs.select(F.col("b").alias("content"))).unionByName(crowd.select("content")).distinct()
    sets = saved(shingle_sets(docs, wanted.join(groups.select("content", "doc_id"), "content"), width))

    roots = saved(connected_components(confirmed(pairs, sets, similarity).unionByName(_linked_in_tiles(_first_tiles(crowd), sets, similarity))))
    rooted = groups.select("content", "doc_id").join(roots.withColumnRenamed("node", "content"), "content", "left").select("content", "doc_id", F.coalesce("root", "content").alias("root"))
    apart = crowd.where("shares > 1").join(roots.withColumnRenamed("node", "content"), "content", "left").select("block", "content", "size", F.coalesce("root", "content").alias("root"))
    tiles = _second_tiles(saved(apart))
    if tiles is not None:
        above = connected_components(_linked_in_tiles(tiles, sets, similarity)).select(F.col("node").alias("root"), F.col("root").alias("top"))
        rooted = rooted.join(above, "root", "left").select("content", "doc_id", F.coalesce("top", "root").alias("root"))
    rooted = saved(rooted)
    named = rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("content", "component_id")
    return drawn.join(named, "content").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of similar texts, the one of the smallest doc_id.

    Rows that repeat that doc_id stay with it, and rows without a doc_id stay.
    """
    losers = similar_documents(docs, width, similarity).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(losers, "doc_id", "left_anti").select(*docs.columns)
