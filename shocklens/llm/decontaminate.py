"""Benchmark decontamination by Wu-Manber search over words.

All windows of one length are searched together. A table gives for each block
of two words how far the search may move on because no window holds that block
nearer to its end; where it may not move, the block's bucket lists the windows
that end with it, and those are compared word by word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

WINDOW = 13
#: Benchmark text of a slice, slices whose searchers stay in a worker, and document text that is searched by slice after slice together.
SLICE_BYTES, SLICES_HELD, GROUP_BYTES = 2 << 20, 3, 48 << 20
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_STATE = StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType()))])
_STATE_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (A-Z lower-cased), ASCII digits and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


class WuManber:
    """Windows of one length over the words of the items."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.furthest = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}

    def _key(self, words: list[bytes], end: int):
        return words[end] if self.block == 1 else (words[end - 1], words[end])

    def add(self, words: list[bytes], start: int, item: str) -> None:
        last = start + self.length - 1
        for end in range(start + self.block - 1, last + 1):
            key = self._key(words, end)
            if last - end < self.shift.get(key, self.furthest):
                self.shift[key] = last - end
        self.bucket.setdefault(self._key(words, last), []).append((words, start, item))

    def search(self, words: list[bytes], hit: np.ndarray, items: set[str]) -> None:
        length, furthest, shift, n = self.length, self.furthest, self.shift.get, len(words)
        i = length - 1
        while i < n:
            key = words[i] if self.block == 1 else (words[i - 1], words[i])
            move = shift(key, furthest)
            if move:
                i += move
                continue
            here = words[i - length + 1 : i + 1]
            for pattern, start, item in self.bucket[key]:
                if pattern[start : start + length] == here:
                    hit[i - length + 1 : i + 1] = True
                    items.add(item)
            i += 1


def build(items: list[tuple[str, str | None]]) -> list[WuManber]:
    """One searcher for each window length; short items are one window of their own length."""
    by_length: dict[int, WuManber] = {}
    for item, text in items:
        words = words_of(text)
        if words:
            length = min(WINDOW, len(words))
            searcher = by_length.setdefault(length, WuManber(length))
            for start in range(len(words) - length + 1):
                searcher.add(words, start, item)
    return list(by_length.values())


_ready: dict[str, list[WuManber]] = {}


def _searchers(name: str, sent: Broadcast) -> list[WuManber]:
    """The searchers of one slice, built in the worker; the last ones used stay."""
    if name in _ready:
        _ready[name] = _ready.pop(name)
        return _ready[name]
    while len(_ready) >= SLICES_HELD:
        del _ready[next(iter(_ready))]
    _ready[name] = build(sent.value)
    if getattr(sent, "_path", None):
        # A slice is read from the worker's file again when it is needed again.
        vars(sent).pop("_value", None)
    return _ready[name]


class Found:
    """Hit words and found items of one text."""

    def __init__(self):
        self.hit: np.ndarray | None = None
        self.items: set[str] = set()

    def search(self, text: str | None, searchers: list[WuManber]) -> None:
        words = words_of(text)
        if self.hit is None:
            self.hit = np.zeros(len(words), bool)
        for searcher in searchers:
            searcher.search(words, self.hit, self.items)

    def state(self) -> tuple[int, int, list[str]]:
        return len(self.hit), int(self.hit.sum()), sorted(self.items)


def _slices(benchmark: DataFrame, slice_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in groups of bounded text, read one group after the other."""
    group, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        n = len(row.t or "") + 64
        if size + n > slice_bytes and group:
            yield group
            group, size = [], 0
        group.append((row.i, row.t))
        size += n
    yield group


def search_batches(batches: Iterator[pa.RecordBatch], sent: list[Broadcast], name: str, group_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches (_row, _text) as (_row, _o), taken together up to ``group_bytes`` of text; every other group visits the slices in reverse."""
    turn = 0

    def searched(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for batch in group for t in batch.column(1)]
        found = [Found() for _ in texts]
        for k, part in list(enumerate(sent))[:: -1 if turn % 2 else 1]:
            searchers = _searchers(f"{name}-{k}", part)
            for f, t in zip(found, texts, strict=True):
                f.search(t.as_py(), searchers)
        at = 0
        for batch in group:
            states = pa.array([f.state() for f in found[at : at + batch.num_rows]], _STATE_ARROW)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), states], ["_row", "_o"])

    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.column(1).nbytes
        if size >= group_bytes or len(sent) <= SLICES_HELD:
            yield from searched(group)
            group, size, turn = [], 0, turn + 1
    if group:
        yield from searched(group)


def with_overlap(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(_row, _o): the rows of ``docs`` as structs, and struct(n_words, n_hit, items) of their texts.

    One Python step whatever the size of the benchmark. A task searches groups
    of batches slice after slice, so that a slice's tables are built once for
    many batches. The driver and a worker hold one slice at a time (a worker
    ``SLICES_HELD`` searchers); what is sent waits on disk.
    """
    context, name = docs.sparkSession.sparkContext, uuid.uuid4().hex
    sent = [context.broadcast(group) for group in _slices(benchmark, slice_bytes)]
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(lambda it: search_batches(it, sent, name, group_bytes), StructType([rows.schema["_row"], StructField("_o", _STATE)]))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def find_contamination(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) for every row of ``docs``.

    A word is hit if it lies in an occurrence of a window of ``benchmark``
    (item_id, text): 13 consecutive words of an item, or all words of a shorter
    one. Items without words have no window; items without an id count as one
    item with an empty id; rows that repeat an id are one item. A document is
    contaminated if at least a twentieth of its words is hit. Null and empty
    texts have no words. Other columns are ignored.
    """
    found = with_overlap(docs.select("doc_id", "text"), benchmark, slice_bytes).select("_row.doc_id", F.col("_o").alias("o"))
    return found.select(
        "doc_id", "o.n_words", "o.n_hit", F.size("o.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("o.items"), ","), 256).alias("items_sha256"),
        is_contaminated(F.col("o.n_hit"), F.col("o.n_words")).alias("contaminated"), F.col("o.items").alias("items"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    judged = with_overlap(docs, benchmark, slice_bytes)
    return judged.where(~is_contaminated(F.col("_o.n_hit"), F.col("_o.n_words"))).select("_row.*")
