"""Importance resampling towards a target corpus over hashed word features.

An Aho-Corasick automaton holds frequent words between two delimiters, each
with its CRC-32 and its length. One scan of a text gives these payloads in
order; the CRC of a run of words follows from those of its parts, as a CRC is
linear, so no run is put together as text. Words outside the dictionary lie in
the gaps between two matches and get their payload directly, so every count is
exact whatever the dictionary holds.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shocklens.llm.common import ascii_lower, saved

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 2024
#: Words of the dictionary, the most frequent ones, and their length in bytes at most: what a worker holds.
DICTIONARY_WORDS, WORD_BYTES = 20_000, 64
# ASCII letters (A-Z lower-cased), digits and every byte beyond ASCII belong to words; the others delimit them.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_POLYNOMIAL = 0xEDB88320


def _zero_byte_tables() -> list[np.ndarray]:
    """For k = 0, 1, ...: four tables that carry a CRC over 2^k zero bytes, one for each of its bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLYNOMIAL), one >> 1).astype(np.uint32)
    # One zero byte: the lowest byte goes through the table, the others move down.
    first = np.stack([one, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * (j - 1)) for j in (1, 2, 3))])
    tables = [first]
    while len(tables) < 32:
        last = tables[-1]
        tables.append(_carry(last, last.ravel()).reshape(4, 256))
    return tables


def _carry(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


_ZEROS = _zero_byte_tables()


def compose(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each text ``left`` followed by ``right``, which has ``length`` bytes."""
    out = left.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        bit = (length >> k) & 1 == 1
        out[bit] = _carry(_ZEROS[k], out[bit])
    return out ^ right


def features(crc: np.ndarray, length: np.ndarray, longest: int) -> np.ndarray:
    """CRC-32 of all runs of 1 to ``longest`` words joined by one space, from the payloads of the words in order."""
    found, run = [crc], crc
    space = np.uint32(zlib.crc32(b" "))
    spaced = compose(np.full(len(crc), space, np.uint32), crc, length) if longest > 1 else crc
    for n in range(2, longest + 1):
        run = compose(run[: len(crc) - n + 1], spaced[n - 1 :], length[n - 1 :] + 1) if len(crc) >= n else crc[:0]
        found.append(run)
    return np.concatenate(found)


class Dictionary:
    """Words between delimiters, with their payloads."""

    def __init__(self, words: list[str]):
        self.machine = ahocorasick.Automaton()
        for k, w in enumerate(words):
            self.machine.add_word(f" {w} ", k)
        encoded = [w.encode() for w in words]
        self.crc = np.fromiter(map(zlib.crc32, encoded), np.uint32, len(words))
        self.length = np.fromiter(map(len, encoded), np.int64, len(words))
        self.spans = [len(w) + 1 for w in words]
        if words:
            self.machine.make_automaton()

    def payloads(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(CRC-32, bytes) of every word of ``text`` in order."""
        clean = f" {(text or '').encode('utf-8', 'surrogatepass').translate(_CLEAN).decode('utf-8', 'surrogatepass')} "
        place, crc, length, at, spans = [], [], [], 0, self.spans
        rare: list[tuple[int, int, int]] = []
        for end, k in self.machine.iter(clean) if self.spans else ():
            start = end - spans[k]
            if start > at:
                # Words that the dictionary lacks end before this one begins.
                rare += [(len(place), zlib.crc32(b), len(b)) for b in (w.encode("utf-8", "surrogatepass") for w in clean[at:start].split(" ") if w)]
            place.append(k)
            at = end
        rare += [(len(place), zlib.crc32(b), len(b)) for b in (w.encode("utf-8", "surrogatepass") for w in clean[at:].split(" ") if w)]
        known = np.array(place, np.int64)
        crc, length = self.crc[known] if len(known) else np.zeros(0, np.uint32), self.length[known] if len(known) else np.zeros(0, np.int64)
        if rare:
            before = np.array([r[0] for r in rare])
            crc = np.insert(crc, before, np.array([r[1] for r in rare], np.uint32))
            length = np.insert(length, before, np.array([r[2] for r in rare], np.int64))
        return crc, length


_ready: dict[str, Dictionary] = {}


def _dictionary(name: str, sent: Broadcast) -> Dictionary:
    """The automaton of this broadcast, built once in a worker."""
    if name not in _ready:
        _ready.clear()
        _ready[name] = Dictionary(sent.value)
    return _ready[name]


def frequent_words(texts: DataFrame, most: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of up to ``WORD_BYTES`` bytes over all texts, at most ``most`` of them.

    Counts fall into classes, four to an octave, and the highest classes are
    taken as far as they fit, so that the driver gets the words of the list and
    a few hundred class sizes only.
    """
    words = texts.select(F.explode(F.regexp_extract_all(ascii_lower(F.col("text").cast("string")), F.lit(_WORD), F.lit(0))).alias("word"))
    counted = words.where(F.octet_length("word") <= WORD_BYTES).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = saved(counted.select("word", F.floor(4 * F.log2("n")).alias("class")))
    room, least = most, None
    for r in sorted(counted.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["class"]
    return [] if least is None else [r.word for r in counted.where(F.col("class") >= least).select("word").collect()]


Find = Callable[[str | None], tuple[np.ndarray, np.ndarray]]


def count_buckets(texts: DataFrame, find: Callable[[], Find], longest: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts: one array of counts a task, of which the buckets in use are shuffled."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, payloads = np.zeros(buckets, np.int64), find()
        for batch in it:
            for t in batch.column(0):
                counts += np.bincount(features(*payloads(t.as_py()), longest) % buckets, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    return texts.select(F.col("text").cast("string")).mapInArrow(batches, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket: 1000 times the log ratio of its smoothed shares in target and source, floored."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    # One row a bucket at most comes to the driver.
    seen = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in seen:
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def with_rank(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``scored`` (doc_id, score) with rank: 1, 2, ... over the ``percent`` of the ``eligible`` rows with the highest scores, else null.

    Scores are whole thousandths of a logarithm, so their table of counts is
    bounded however many documents there are. It says how many stand above
    each score; the rows of one score are then numbered by doc_id.
    """
    counted = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")
    wanted = F.floor(percent * F.sum("n").over(Window.partitionBy()) / 100)
    steps = saved(counted.select("score", above.alias("above"), wanted.alias("wanted")).where("above < wanted"))
    met = saved(scored.withColumn("_in", eligible).join(F.broadcast(steps), "score", "left").withColumn("_in", F.col("_in") & F.col("above").isNotNull()))
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    drawn = met.where("_in").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= F.col("wanted"), F.col("rank")).cast("long"))
    rest = met.where("NOT _in").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("_in", "above", "wanted")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED, most: int = DICTIONARY_WORDS
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs`` (doc_id, text).

    Features are all runs of 1 to ``longest`` words, hashed to ``buckets`` by
    CRC-32. A bucket's gain compares its share in the texts of ``target`` with
    that in ``docs``; weight is the floored mean gain of a document's features
    (0 without any), score adds a Gumbel draw that seed and doc_id fix, and
    rank numbers the floor of ``percent`` of the documents of at least
    ``least_words`` words with the highest scores (ties: the smaller doc_id,
    null ids last, then repeated rows in any order), null for the others. Null
    and empty texts have no words; a null doc_id draws as an empty one. Other
    columns are ignored; empty tables give empty or unweighted rows.
    """
    context, name = docs.sparkSession.sparkContext, uuid.uuid4().hex
    sent = context.broadcast(frequent_words(docs, most))

    def find() -> Find:
        return _dictionary(name, sent).payloads

    gains = context.broadcast(bucket_gains(count_buckets(docs, find, longest, buckets), count_buckets(target, find, longest, buckets), buckets))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads, gain = find(), gains.value
        for batch in it:
            rows = []
            for t in batch.column(1):
                crc, length = payloads(t.as_py())
                found = features(crc, length, longest)
                rows.append((len(crc), len(found), int(gain[found % buckets].sum()) // len(found) if len(found) else 0))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    weighed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = saved(weighed.withColumn("score", F.col("weight") + noise))
    return with_rank(scored, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
