"""Spelling variants: words one edit apart, met under pairs of trie nodes.

The distinct words are put into a trie and their reversals into another, and
the nodes of both are numbered. A word cut at a place is the pair of the node
of what stands before and the node of what stands after. Words that agree but
for one code point give the same pair when that code point is skipped; a word
with one code point more gives, when it is skipped, the pair of the shorter
word cut there. Both are equalities of two integers, so one grouping by pairs
finds all neighbours, and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shocklens.llm.common import ascii_lower, saved

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: One run in so many loses a code point.
EVERY = 199
#: A form is at least so many times as frequent as its variant.
LEAD = 5
_RUN = "[A-Za-zÀ-ÿ]+"
#: Nodes of up to so many letters are numbered by their letters, each a byte; deeper ones lie in one range of words.
_SHALLOW = 7


def with_slips(word: Column, doc_id: Column, every: int = EVERY) -> Column:
    """``word``, without one code point if ``every`` divides the crc32 of ``<doc_id>:<word>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): the frequent longer words of all texts, after slips; counted in each task before the shuffle."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(_RUN), F.lit(0))).alias("run"))
    # No slip makes a run longer.
    runs = runs.where(F.length("run") >= least_length).select("doc_id", ascii_lower(F.col("run")).alias("run"))
    words = runs.select(with_slips(F.col("run"), F.col("doc_id"), every).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class Trie:
    """Numbers of the nodes on the paths of words that come in ascending order.

    Only the path of the last word is held. Nodes of the first letters have
    the letters for a number, so that they are the same in every range.
    """

    def __init__(self, part: int):
        self.free = -((part + 1) << 40)
        self.last = b""
        self.path = np.array([1], np.int64)

    def walk(self, word: bytes) -> np.ndarray:
        """Numbers of the prefixes of 0, 1, ... letters."""
        a, b = (np.frombuffer(x, np.uint8) for x in (self.last, word))
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        common = int(differ[0]) if len(differ) else n
        path = np.empty(len(word) + 1, np.int64)
        path[: common + 1] = self.path[: common + 1]
        for i in range(common + 1, min(_SHALLOW, len(word)) + 1):
            path[i] = (int(path[i - 1]) << 8) | word[i - 1]
        deep = max(common, _SHALLOW) + 1
        if deep <= len(word):
            path[deep:] = self.free + np.arange(len(word) + 1 - deep)
            self.free += len(word) + 1 - deep
        self.last, self.path = word, path
        return path


def _paths(words: DataFrame, path: str) -> DataFrame:
    """(word, n, number, ``path``): words over Latin-1 with their trie nodes; number follows their order."""
    # Words that share their first eight letters are in one range: deeper nodes belong to one task.
    placed = words.repartitionByRange(F.substring("word", 1, _SHALLOW + 1)).sortWithinPartitions("word")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, k = None, 0
        for batch in it:
            part = batch.column(2)[0].as_py() if batch.num_rows else 0
            trie = trie or Trie(part)
            paths = [trie.walk(w.as_py().encode("latin-1")) for w in batch.column(0)]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
            numbers = (part << 40) + k + np.arange(batch.num_rows)
            k += batch.num_rows
            nodes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(paths) if paths else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers), nodes], ["word", "n", "number", path])

    return placed.select("word", "n", F.spark_partition_id().alias("part")).mapInArrow(batches, f"word string, n long, number long, {path} array<long>")


def neighbours(words: DataFrame) -> DataFrame:
    """(number, word, n, n_near, near) for every row of distinct ``words`` (word, n); near is the number and n of the most frequent neighbour.

    Under one pair of nodes lie at most one cut word and as many skipped ones
    as the alphabet has letters, 90. A pair of words meets once: of equal
    letters in a row only the first counts as left out.
    """
    ahead = saved(_paths(words, "ahead"))
    behind = _paths(words.select(F.reverse("word").alias("word"), "n"), "behind").select(F.reverse("word").alias("word"), "behind")
    both = ahead.join(behind, "word")
    size = "size(ahead) - 1"
    cut = f"transform(sequence(0, {size}), i -> struct(ahead[i] AS p, behind[{size} - i] AS s, 0 AS kind))"
    # kind 1: a skipped letter; 2: one that equals the letter before it.
    repeats = "i > 0 AND substring(word, i + 1, 1) = substring(word, greatest(i, 1), 1)"
    skip = f"transform(sequence(0, {size} - 1), i -> struct(ahead[i] AS p, behind[{size} - 1 - i] AS s, CASE WHEN {repeats} THEN 2 ELSE 1 END AS kind))"
    pairs = both.select("number", "n", F.explode(F.expr(f"concat({cut}, {skip})")).alias("e")).select("e.p", "e.s", F.struct((-F.col("n")).alias("less"), "number", "e.kind").alias("x"))
    met = pairs.groupBy("p", "s").agg(F.array_sort(F.collect_list("x")).alias("m")).where("size(m) > 1")
    near = "filter(m, y -> x.number <> y.number AND CASE WHEN x.kind = 0 THEN y.kind = 1 WHEN y.kind = 0 THEN x.kind = 1 ELSE true END)"
    seen = met.select(F.explode(F.expr(f"transform(m, x -> struct(x.number AS number, {near} AS near))")).alias("e")).where("size(e.near) > 0")
    seen = seen.groupBy(F.col("e.number").alias("number")).agg(F.sum(F.size("e.near")).alias("n_near"), F.min(F.expr("struct(e.near[0].less AS less, e.near[0].number AS number)")).alias("near"))
    found = ahead.select("number", "word", "n").join(seen, "number", "left")
    return found.select("number", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.expr("CASE WHEN near IS NOT NULL THEN struct(near.number AS number, -near.less AS n) END").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(number, root) of every row of ``forms`` (number, form), following forms to the last by doubling.

    A form is ``LEAD`` times as frequent as its variant, so chains are short
    and end.
    """
    now = saved(forms.select("number", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("number").alias("root"), F.col("root").alias("_next"))
        now = saved(now.join(onward, "root", "left").select("number", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select("number", "root")
        now = now.select("number", "root")


def group_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY, lead: int = LEAD) -> DataFrame:
    """(word, n, n_near, form, form_n, root), one row for each frequent word of ``docs`` (doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z
    lower-cased and a slip in one of ``every`` (``with_slips``; None of them
    for an ``every`` above 2^32). Near words differ by one inserted, deleted or
    replaced code point. form is the most frequent near word (ties: the
    smaller) if it is ``lead`` times as frequent, root the last of the chain of
    forms, the word itself without a form. Null and empty texts have no words;
    a null doc_id counts as an empty one in the choice of slips; repeated rows
    count as often as they occur; words may be of any length. Other columns
    are ignored; an empty table gives an empty one.
    """
    known = saved(neighbours(saved(count_words(docs, least_length, least_count, every))))
    formed = F.when(F.col("near.n") >= lead * F.col("n"), F.col("near"))
    known = known.withColumn("_form", formed)
    last = roots(known.where("_form IS NOT NULL").select("number", F.col("_form.number").alias("form")))
    names = known.select(F.col("number").alias("_number"), F.col("word").alias("_word"))
    joined = known.join(last, "number", "left").join(names.withColumnRenamed("_word", "form"), F.col("_form.number") == F.col("_number"), "left").drop("_number")
    joined = joined.join(names.withColumnRenamed("_word", "_root"), F.col("root") == F.col("_number"), "left")
    return joined.select("word", "n", "n_near", "form", F.col("_form.n").alias("form_n"), F.coalesce("_root", "word").alias("root"))
