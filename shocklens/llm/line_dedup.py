"""Line dedup over range-partitioned hashes.

Lines travel as hashes with document and place, never as text. They are dealt
by ranges of (hash, document) and sorted by hash, document and place, so that
each task streams runs of one hash and sees its first document first. A run
that starts a task may go on from the one before; the ends of the tasks settle
that. The result is one compressed bitmap of kept lines for each document that
loses any.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shocklens.llm.common import BLANKS, ascii_lower, saved

MIN_CHARS = 10
_FOUND = "kind string, h1 long, h2 long, doc_id long, place int, task int"


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, place) for every line whose key has at least ``min_chars`` code points."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    keyed = lines.select("doc_id", "place", ascii_lower(F.trim("line", F.lit(BLANKS))).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"), "doc_id", "place")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later lines of every run; of the task's first run also its first document's, as open; last the task's end."""
    task = TaskContext.get().partitionId()
    schema = pa.schema([("kind", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("task", pa.int32())])

    def out(kind, h1, h2, doc, place):
        n = len(h1)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array(h1), pa.array(h2), pa.array(doc), pa.array(place, pa.int32()), pa.array(np.full(n, task, np.int32))], schema=schema)

    last = first = None  # (h1, h2, smallest doc of the run); (h1, h2) of the task's first run
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        starts = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        if last is not None and (h1[0], h2[0]) == last[:2]:
            starts[0] = False
        if first is None:
            first = (h1[0], h2[0])
        at = np.maximum.accumulate(np.where(starts, np.arange(len(h1)), -1))
        head = np.where(at >= 0, doc[np.maximum(at, 0)], last[2] if last is not None else 0)
        dropped = doc != head
        yield out("drop", h1[dropped], h2[dropped], doc[dropped], place[dropped])
        opened = ~dropped & (h1 == first[0]) & (h2 == first[1])
        if opened.any():
            yield out("open", h1[opened], h2[opened], doc[opened], place[opened])
        last = (h1[-1], h2[-1], head[-1])
    if last is not None:
        yield out("end", *(np.array([x]) for x in (last[0], last[1], last[2])), np.zeros(1, np.int32))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, place) of every line that an earlier document holds; a place may repeat."""
    # Hashed once: the range bounds are sampled from the stored hashes, not from the texts.
    found = saved(saved(hashed_lines(docs, min_chars)).repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "place").mapInArrow(_runs, _FOUND))
    # At most one row for each task.
    ends = found.where("kind = 'end'").groupBy("h1", "h2").agg(F.min("task").alias("since"))
    late = found.where("kind = 'open'").join(ends, ["h1", "h2"]).where("since < task")
    return found.where("kind = 'drop'").select("doc_id", "place").unionByName(late.select("doc_id", "place"))


def pack(dropped: list[int]) -> bytes:
    """Deflated bitmap, bit i set if line i goes; short of trailing lines that stay."""
    bits = np.zeros((max(dropped) + 1 if dropped else 0), np.uint8)
    bits[dropped] = 1
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """True for each line that stays."""
    gone = np.zeros(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines]
        gone[: len(bits)] = bits.astype(bool)
    return ~gone


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, bitmap) for each document that loses a line."""
    @F.arrow_udf("binary")
    def packed(places: pa.Array) -> pa.Array:
        return pa.array((pack(x.as_py()) for x in places), pa.binary())

    # As long as the document has lines.
    return dropped_lines(docs, min_chars).groupBy("doc_id").agg(F.collect_set("place").alias("places")).select("doc_id", packed("places").alias("bitmap"))


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    """(lines, dropped lines, text of the lines that stay)."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), 0, text or ""
    stay = unpack(bitmap, len(lines))
    kept = [x for x, s in zip(lines, stay.tolist(), strict=True) if s]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of ``docs``.

    A line whose key (stripped, A-Z lower-cased) has at least ``min_chars``
    code points and occurs in several documents stays only in the one with the
    smallest doc_id, there as often as it occurs. Null and empty texts are one
    empty line. Rows without a doc_id take no part: all their lines stay. Rows
    that repeat a doc_id are one document. Other columns are ignored. Lines are
    held equal by 128 bits of hash; their texts are not compared.
    """
    @F.arrow_udf("struct<n_lines long, n_dropped long, kept_sha256 string>")
    def digest(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
        kind = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
        rows = (kept_lines(t.as_py(), b.as_py()) for t, b in zip(texts, bitmaps, strict=True))
        return pa.array(((n, d, hashlib.sha256(s.encode()).hexdigest()) for n, d, s in rows), kind)

    joined = docs.select("doc_id", F.col("text").cast("string")).join(keep_bitmaps(docs, min_chars), "doc_id", "left")
    return joined.select("doc_id", digest("text", "bitmap").alias("d")).select("doc_id", "d.n_lines", "d.n_dropped", "d.kept_sha256")


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the kept lines as text; n_chars, where there is one, follows the new text.

    Rows and lines are treated as in ``dedup_lines``; all columns stay, whatever
    their names.
    """
    @F.arrow_udf("string")
    def kept(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
        return pa.array((t if b is None else kept_lines(t, b)[2] for t, b in ((t.as_py(), b.as_py()) for t, b in zip(texts, bitmaps, strict=True))), pa.string())

    # The text travels once, beside the other columns.
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", F.struct(*others).alias("row"), F.col("text").cast("string").alias("text"))
    joined = rows.join(keep_bitmaps(docs, min_chars), "doc_id", "left").select("row", kept("text", "bitmap").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    new = {"text": F.col("text")} | ({"n_chars": size.cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
