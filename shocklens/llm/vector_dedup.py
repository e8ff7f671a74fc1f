"""Near-duplicate vectors by an inverted file with product-quantised residuals.

Unit vectors lie in the lists of their nearest centroids. What is left after
the centroid is cut into subspaces and each part replaced by the nearest word
of a codebook, with the length of the error kept beside the codes. A vector is
compared with every list whose border is near enough: tables of its squared
distances to the codebooks give its distance to every code of the list, and as
the error is known, no pair within reach is lost there. The cosines of what
stays are then worked out exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shocklens.llm.common import saved
from shocklens.operators.graph import connected_components

COSINE = 0.95
#: How far beyond its own list a vector looks, in standard deviations of where a vector at the bound lies.
DEVIATIONS = 3.0
#: Centroids at most, and vectors that they and the codebooks are fitted on at most.
MAX_LISTS, SAMPLE = 8192, 1 << 17
SUBSPACES, CODES = 8, 256
#: Vectors and probing vectors of a tile; larger tables take the root of their size.
TILE = 4096
#: Groups of equal vectors with more than one of so many rows are joined by broadcast: there are no more of them than this.
HEAVY = 100_000
_SLACK = 1e-4


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = np.asarray(values, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, centres: np.ndarray, step: int = 1024) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """At most ``k`` centres; one that loses all its points stays where it was."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        own = nearest(x, centres)
        order = np.argsort(own, kind="stable")
        held, first, n = np.unique(own[order], return_index=True, return_counts=True)
        centres[held] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
    return centres


@dataclass
class Quantizer:
    """Coarse centroids, and a codebook for each subspace of the residuals."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[slice]

    @staticmethod
    def fit(sample: np.ndarray, lists: int) -> Quantizer:
        x = unit(sample).astype(np.float32)
        centres = k_means(x, lists)
        left = x - centres[nearest(x, centres)]
        ends = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int).tolist()
        cuts = [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]
        return Quantizer(centres, [k_means(left[:, c], CODES) for c in cuts], cuts)

    def encode(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of the error) of residuals."""
        codes = np.stack([nearest(left[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        gone = sum(((left[:, c] - b[codes[:, j]]) ** 2).sum(axis=1) for j, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)))
        return codes, np.sqrt(gone)

    def probes(self, x: np.ndarray, home: np.ndarray, reach: float) -> list[np.ndarray]:
        """Lists from its own on, in number, whose border is within ``reach`` of each vector."""
        out, size = [], (self.centres * self.centres).sum(axis=1)
        for i in range(0, len(x), 256):
            own = home[i : i + 256]
            far = size - 2 * x[i : i + 256] @ self.centres.T
            apart = np.sqrt(np.maximum(size[own, None] + size - 2 * self.centres[own] @ self.centres.T, 1e-12))
            near = far - far[np.arange(len(own)), own][:, None] <= 2 * reach * apart
            near[np.arange(len(own)), own] = True
            near &= np.arange(len(size)) >= own[:, None]
            out += [np.flatnonzero(row).astype(np.int32) for row in near]
        return out

    def distances(self, x: np.ndarray, where: int, codes: np.ndarray) -> np.ndarray:
        """Distances of vectors ``x`` to coded vectors of list ``where``, from a table for each vector and subspace."""
        left, total = x - self.centres[where], np.zeros((len(x), len(codes)), np.float32)
        for j, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = left[:, c]
            table = (part * part).sum(axis=1)[:, None] - 2 * part @ b.T + (b * b).sum(axis=1)
            total += table[:, codes[:, j]]
        return np.sqrt(np.maximum(total, 0))


def _groups(centres: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Lists in groups of at most ``most`` vectors, near ones together; a larger list is a group of its own."""
    done, open_ = [], [np.arange(len(centres))]
    while open_:
        held = open_.pop()
        if len(held) == 1 or sizes[held].sum() <= most:
            done.append(held)
            continue
        c = centres[held] - centres[held].mean(axis=0)
        axis = int(np.argmax(c.var(axis=0)))
        order = held[np.argsort(c[:, axis], kind="stable")]
        open_ += [order[: len(order) // 2], order[len(order) // 2 :]]
    return done


def links_of_tile(index: Quantizer, seekers: pa.Table, entries: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, linked rows, a, b): how many rows each vector is linked to within a tile, and a forest of edges between them."""
    vectors = [unit(np.stack(t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1))) if len(t) else np.zeros((0, 1)) for t in (seekers, entries)]
    (nq, mq, hq), (ne, me, he) = ([t.column(c).to_numpy() for c in ("node", "m", "home")] for t in (seekers, entries))
    flat = seekers.column("probes").combine_chunks()
    who, lists = np.repeat(np.arange(len(nq)), np.diff(flat.offsets.to_numpy())), flat.flatten().to_numpy()
    codes = np.frombuffer(b"".join(entries.column("codes").to_pylist()), np.uint8).reshape(len(ne), -1)
    bound = (2 - 2 * cosine) ** 0.5 + entries.column("error").to_numpy() + _SLACK
    left, right = [], []
    for where in np.unique(he).tolist():
        mine, asked = np.flatnonzero(he == where), who[lists == where]
        for i in range(0, len(asked), 128):
            q = asked[i : i + 128]
            maybe = index.distances(vectors[0][q].astype(np.float32), where, codes[mine]) <= bound[mine]
            # Within one list a pair is taken once.
            maybe &= (hq[q] != where)[:, None] | (nq[q][:, None] < ne[mine])
            a, b = np.nonzero(maybe)
            for k in range(0, len(a), 1 << 16):
                x, y = q[a[k : k + (1 << 16)]], mine[b[k : k + (1 << 16)]]
                same = np.einsum("ij,ij->i", vectors[0][x], vectors[1][y]) >= cosine
                left.append(x[same])
                right.append(y[same])
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
    nodes, place = np.unique(np.concatenate([nq[x], ne[y]]), return_inverse=True)
    a, b = place[: len(x)], place[len(x) :]
    linked = np.bincount(a, me[y], len(nodes)) + np.bincount(b, mq[x], len(nodes))
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    tied = label != np.arange(len(nodes))
    return nodes, linked.astype(np.int64), nodes[label[tied]], nodes[tied]


def _usable() -> Column:
    """Whether an embedding is whole, finite and not zero."""
    x = F.col("embedding")
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))


def _sampled(distinct: DataFrame, n: int, most: int) -> np.ndarray:
    """The vectors of smallest hash, ``most`` of them at most; only rows below a bar on the hash come to the driver."""
    h = F.shiftrightunsigned(F.xxhash64("embedding"), 1)
    rows = distinct.select("embedding", h.alias("h"))
    if n > most:
        # Some more than wanted are expected, so that the smallest ones are among them.
        rows = rows.where(F.col("h") <= min((1 << 63) - 1, int((1 << 63) * ((most + 4 * most**0.5) / n))))
    held = rows.toArrow().sort_by("h").slice(0, most).column("embedding").combine_chunks()
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def link_vectors(distinct: DataFrame, cosine: float = COSINE, deviations: float = DEVIATIONS, lists: int | None = None, tile: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(node, linked, a, b) over distinct vectors (node, m, embedding) of one length.

    Rows with ``linked`` say with how many rows a node is linked in some tile;
    rows with ``a`` and ``b`` are edges whose components are those of all links.
    A tile is a group of lists, or a share of one, and a share of the vectors
    that look into them, so copies of a vector grow with the lists it looks at
    and not with the links that it has.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    schema = "node long, linked long, a long, b long"
    if not n:
        return spark.createDataFrame([], schema)
    root = int(np.ceil(n**0.5))
    lists, tile = lists or min(root, MAX_LISTS), tile or max(TILE, root)
    sent = spark.sparkContext.broadcast(Quantizer.fit(drawn := _sampled(distinct, n, min(sample, 32 * lists)), lists))
    # A vector at the bound lies sqrt(1 - cosine^2) off, in a direction of which a border sees one of as many parts as there are dimensions.
    reach = min((2 - 2 * cosine) ** 0.5, deviations * (1 - cosine**2) ** 0.5 / drawn.shape[1] ** 0.5)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in it:
            x = unit(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)).astype(np.float32) if batch.num_rows else np.zeros((0, index.centres.shape[1]), np.float32)
            home = nearest(x, index.centres)
            codes, error = index.encode(x - index.centres[home])
            columns = [pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float64)), pa.array(index.probes(x, home, reach), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["node", "m", "embedding", "home", "codes", "error", "probes"])

    kind = dict(distinct.dtypes)["embedding"]
    coded = saved(distinct.select("node", "m", "embedding").mapInArrow(encode, f"node long, m long, embedding {kind}, home int, codes binary, error double, probes array<int>"))
    sizes = np.zeros(len(sent.value.centres), np.int64)
    for r in coded.groupBy("home").count().collect():  # a row a list
        sizes[r.home] = r["count"]
    groups = _groups(sent.value.centres, sizes, tile)
    group_of = np.zeros(len(sizes), np.int32)
    for g, held in enumerate(groups):
        group_of[held] = g
    shares = np.array([-(-int(sizes[held].sum()) // tile) for held in groups])

    def asked_groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(groups), np.int64)
        for batch in it:
            for p in batch.column(0):
                counts[np.unique(group_of[p.values.to_numpy()])] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(groups))), pa.array(counts)], ["g", "n"])

    seekers = np.zeros(len(groups), np.int64)
    for r in coded.select("probes").mapInArrow(asked_groups, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        seekers[r.g] = r.n
    asked = np.maximum(1, -(-seekers // tile))
    first = np.concatenate([[0], np.cumsum(shares * asked)])

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            node, home, probes = batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(6)
            mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            rows, tiles, seeks = [], [], []
            for i in range(batch.num_rows):
                g = group_of[home[i]]
                k = int(mixed[i])
                mine = first[g] + (k % shares[g]) * asked[g] + np.arange(asked[g])
                looks = [first[h] + np.arange(shares[h]) * asked[h] + k % asked[h] for h in np.unique(group_of[probes[i].values.to_numpy()]) if shares[h]]
                tiles += [mine, *looks]
                seeks += [0] * len(mine) + [1] * sum(map(len, looks))
                rows += [i] * (len(mine) + sum(map(len, looks)))
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles) if tiles else np.zeros(0, np.int64)), pa.array(seeks, pa.int32()), *taken.columns], ["tile", "seeks", *batch.schema.names])

    def compare(table: pa.Table) -> pa.Table:
        seeks = table.column("seeks").to_numpy() == 1
        nodes, linked, a, b = links_of_tile(sent.value, table.filter(pa.array(seeks)), table.filter(pa.array(~seeks)), cosine)
        gap, more = pa.nulls(len(nodes), pa.int64()), pa.nulls(len(a), pa.int64())
        columns = [pa.chunked_array(pair, pa.int64()) for pair in ((pa.array(nodes), more), (pa.array(linked), more), (gap, pa.array(a)), (gap, pa.array(b)))]
        return pa.table(columns, names=["node", "linked", "a", "b"])

    dealt = coded.mapInArrow(deal, f"tile long, seeks int, node long, m long, embedding {kind}, home int, codes binary, error double, probes array<int>")
    return saved(dealt.groupBy("tile").applyInArrow(compare, schema))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, deviations: float = DEVIATIONS, lists: int | None = None, tile: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding), linked from ``cosine`` on.

    n_links counts the other rows linked directly, equal vectors among them;
    component_id is the smallest vec_id reachable, kept holds for the row of
    that id. Every row is indexed and every row looks; centroids and codebooks
    are fitted on at most ``sample`` vectors of smallest hash. Equal vectors
    are compared as one. Null and zero vectors, and those with a null or
    non-finite component or another length than the most frequent (of equally
    frequent ones the smaller), link with nothing. Rows without a vec_id count
    as links but name no component; one without any named partner has a null
    component_id and is kept. Repeated rows are vectors of their own. Other
    columns are ignored; an empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    lengths = rows.where(_usable()).groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    apart = [F.col("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")]
    if not lengths:
        return rows.select(*apart, F.lit(True).alias("kept"))
    ok = _usable() & (F.size("embedding") == lengths[0].d)
    usable, alone = rows.where(ok), rows.where(~F.coalesce(ok, F.lit(False))).select(*apart)
    distinct = saved(usable.groupBy("embedding").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    found = link_vectors(distinct, cosine, deviations, lists, tile, sample)
    linked = found.where("linked IS NOT NULL").groupBy("node").agg(F.sum("linked").alias("linked"))
    roots = connected_components(found.where("a IS NOT NULL").select("a", "b"))
    rooted = distinct.join(linked, "node", "left").join(roots, "node", "left")
    rooted = saved(rooted.select("embedding", "m", "first", (F.coalesce("linked", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    named = saved(rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("embedding", "m", "n_links", "component_id"))
    # Rows of a large group of equal vectors stay where they are: there are fewer such groups than HEAVY.
    heavy = F.broadcast(named.where(F.col("m") > max(64, lengths[0].n // HEAVY)).drop("m"))
    usual = named.where(F.col("m") <= max(64, lengths[0].n // HEAVY)).drop("m")
    columns = ["vec_id", "n_links", "component_id"]
    told = usable.join(heavy, "embedding").select(*columns).unionByName(usable.join(heavy, "embedding", "left_anti").join(usual, "embedding").select(*columns))
    return told.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
