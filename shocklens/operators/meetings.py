"""How many shingles a text shares with others, from six bytes a shingle, and a small filter of chosen texts.

Two sets of a similarity t share l of their first (1 - t) n + l shingles, in
any order that both follow. So some of each set is looked at, by value.
Shingles move packed by ranges of their hash; what comes back is a number for
each text. Texts that share too few are in no link, and their sets never move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shingles that are looked at beyond (1 - t) n, as a share of n.
MORE = 0.2
#: Shingles of a bucket, which a task holds; those packed at a time; the least number of buckets; bytes of a batch that are read at a time.
BUCKET, FLUSH, BUCKETS, PIECE = 5 << 20, 1 << 19, 64, 1 << 21
#: Members of a slice of the filter, its bits for each and probes.
SLICE, BITS, PROBES = 1 << 16, 16, 4


def mixed(x: np.ndarray) -> np.ndarray:
    """Other 64 bits for each 64, one to one."""
    x = x.view(np.uint64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def set_hashes(k: np.ndarray, bounds: np.ndarray, found: np.ndarray) -> np.ndarray:
    """A hash of each row's key hash and set of shingles."""
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mixed(found.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)))]
    return mixed((sums[bounds[1:]] - sums[bounds[:-1]]) ^ mixed(k)).view(np.int64)


def least_met(n: Column, similar: float, more: float = MORE) -> Column:
    """The least count of a set of ``n`` shingles that is similar to one of another class, whose size is ``similar`` times its own or more."""
    return F.ceil(n * similar - 1e-6) if more >= similar else F.floor(n * (more * similar) - 1e-6) + 1


def _looked_at(x: np.ndarray, k: np.ndarray, bounds: np.ndarray, found: np.ndarray, similar: float, more: float) -> tuple[np.ndarray, np.ndarray]:
    """(class, hash) of the first shingles of each row, row by row."""
    size = np.diff(bounds)
    most = np.minimum(size - np.ceil(size * similar - 1e-9) + 1 + np.floor(more * size), size).astype(np.int64)
    row = np.repeat(np.arange(len(size)), most)
    at = np.arange(len(row)) - (np.cumsum(most) - most)[row] + bounds[:-1][row]
    return x[row], mixed(found[at].view(np.uint64) ^ mixed(k)[row])


def _dealt(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(bucket, six bytes of each hash, classes, entries of each class)."""
    x, h = (np.concatenate([e[j] for e in held]) for j in (0, 1))
    bucket = ((h >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    x, v = x[order], h[order].view(np.uint8).reshape(-1, 8)[:, :6]
    ends = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
    for b, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
        if start < end:
            heads = np.flatnonzero(np.r_[True, x[start + 1 : end] != x[start : end - 1]])
            yield b, v[start:end].tobytes(), x[start:end][heads].tobytes(), np.diff(np.r_[heads, end - start]).astype(np.uint32).tobytes()


def _shared(v: np.ndarray, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, shingles that another class has too) of a bucket."""
    h = np.zeros((len(v) // 6, 8), np.uint8)
    h[:, :6] = v.reshape(-1, 6)
    h = h.view(np.uint64).ravel()
    order = np.argsort(h)
    ranked = h[order]
    same = ranked[1:] == ranked[:-1]
    order = order[np.r_[same, False] | np.r_[False, same]]
    h, x = h[order], x[np.searchsorted(np.cumsum(c), order, "right")]
    order = np.lexsort((x, h))
    h, x = h[order], x[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])][: len(h)]
    h, x = h[new], x[new]
    same = np.diff(h) == 0
    return np.unique(x[(np.r_[same, False] | np.r_[False, same])[: len(x)]], return_counts=True)


def met(given: DataFrame, read: Callable[[pa.RecordBatch], tuple], carried: str, similar: float, words: float, more: float = MORE) -> DataFrame:
    """The carried rows, with null x and c, and one row of packed (x, c) for each bucket; ``counts`` opens these.

    ``read`` takes a batch to (rows of ``carried`` or None, each row's class,
    key hash, bounds, shingles), the shingles ascending in a row. A class
    counts a shingle of several of its members once. With ``more`` of at least
    ``similar`` whole sets are looked at. ``words`` is about the number of all
    shingles and sizes the buckets only.
    """
    buckets = min(max(BUCKETS, int(words * min(1 - similar + more, 1)) // BUCKET + 1), 1 << 16)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list, kinds: list[pa.Field]) -> pa.RecordBatch:
            columns = list(zip(*_dealt(held, buckets), strict=True))
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(columns[0]), f.type) for f in kinds), pa.array(columns[0], pa.int32()), *(pa.array(x, pa.binary()) for x in columns[1:])], names=[*(f.name for f in kinds), *"bvxc"])

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = max(batch.num_rows * PIECE // max(batch.nbytes, 1), 1)
                yield from (batch.slice(i, step) for i in range(0, batch.num_rows, step))
                del batch
                # A worker lives on after its task and would keep what it took.
                pa.default_memory_pool().release_unused()

        held, size, kinds = [], 0, []
        for batch in pieces(batches):
            rows, *sets = read(batch)
            if rows is not None and rows.num_rows:
                kinds = list(rows.schema)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.arange(rows.num_rows) % buckets, pa.int32()), *[pa.nulls(rows.num_rows, pa.binary())] * 3], names=[*rows.schema.names, *"bvxc"])
            held.append(_looked_at(*sets, similar, more))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield packed(held, kinds)
                held, size = [], 0
        if size:
            yield packed(held, kinds)

    def counted(table: pa.Table) -> pa.Table:
        v, x, c = (np.frombuffer(b"".join(table.column(n).drop_null().to_pylist()), kind) for n, kind in zip("vxc", (np.uint8, np.int64, np.uint32), strict=True))
        table = table.filter(pc.is_null(table.column("v"))).drop_columns(["b", "v"])
        if not len(v):
            return table
        x, c = _shared(v, x, c)
        told = [pa.array([y.tobytes()], pa.binary()) for y in (x, c.astype(np.uint32))]
        return pa.concat_tables([table, pa.table([*(pa.nulls(1, f.type) for f in list(table.schema)[:-2]), *told], schema=table.schema)])

    carried = f"{carried}, " if carried else ""
    return given.mapInArrow(pack, f"{carried}b int, v binary, x binary, c binary").groupBy("b").applyInArrow(counted, f"{carried}x binary, c binary")


def counts(found: DataFrame) -> DataFrame:
    """(x, c): shingles of each class that other classes have too."""
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, c in zip(*(batch.column(n).to_pylist() for n in "xc"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)), pa.array(np.frombuffer(c, np.uint32).astype(np.int64))], names=["x", "c"])

    return found.where("x IS NOT NULL").select("x", "c").mapInArrow(opened, "x long, c long").groupBy("x").agg(F.sum("c").alias("c"))


def chosen(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test for being one of ``hashes`` (h), which lets some four of a thousand others through: two bytes for each are kept.

    It saves work ahead of a join and decides nothing.
    """
    n = hashes.count()
    slices = -(-n // SLICE) or 1
    width = 8 * (-(-n * BITS // (8 * slices)) or 1)

    def places(h: np.ndarray) -> Iterator[np.ndarray]:
        for j in range(PROBES):
            yield h % slices * width + (mixed(h.view(np.uint64) + np.uint64(j + 1)) % np.uint64(width)).astype(np.int64)

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(width, np.uint8)
        for at in places(table.column("h").to_numpy()):
            bits[at - key[0].as_py() * width] = 1
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["s", "v"])

    bits = np.zeros((slices, width // 8), np.uint8)
    for r in hashes.select("h", F.pmod("h", F.lit(slices)).alias("s")).groupBy("s").applyInArrow(fill, "s long, v binary").collect():
        bits[r.s] = np.frombuffer(r.v, np.uint8)
    bits = bits.ravel()

    @F.arrow_udf("boolean")
    def held(h: pa.Array) -> pa.Array:
        h = h.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array(np.all([bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 for at in places(h)], axis=0))

    return held
