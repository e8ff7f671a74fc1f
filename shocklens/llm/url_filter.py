"""URL filter over a sorted digest array.

The list is kept as one file: the 64-bit xxhash of every entry in ascending
order, the entries' offsets, and the entries themselves. Workers map the file
into memory, find hashes by vectorised binary search and compare the stored
string, so a hash collision never decides a verdict. A list too large to send
is cut into such arrays by the hash of its entries' hosts.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shocklens.llm.common import ascii_lower

#: A list up to this size travels to the executors; a larger one is cut into arrays of a quarter of it.
MAX_DIGEST_BYTES = 64 << 20
#: Tasks that share the urls of one such array, each with the array.
SALTS = 8


class DigestArray:
    """Sorted 64-bit keys with the strings behind them."""

    def __init__(self, buffer: np.ndarray):
        n = int(buffer[:8].view("<u8")[0])
        self.keys = buffer[8 : 8 + 8 * n].view("<u8")
        self.ends = buffer[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.text = buffer[16 + 16 * n :]

    @staticmethod
    def pack(entries: list[bytes], digest=xxhash.xxh64_intdigest) -> bytes:
        """The file's bytes; entry i of the sorted order is text[ends[i]:ends[i + 1]]."""
        hashed = sorted((digest(x), x) for x in set(entries))
        keys = np.array([h for h, _ in hashed], "<u8")
        ends = np.concatenate([[0], np.cumsum([len(x) for _, x in hashed])]).astype("<u8")
        return np.uint64(len(hashed)).tobytes() + keys.tobytes() + ends.tobytes() + b"".join(x for _, x in hashed)

    @classmethod
    def mapped(cls, packed: bytes) -> DigestArray:
        """Written to a file of the worker's own temp folder and mapped read-only; the file has no name any more once it is mapped."""
        with tempfile.TemporaryFile() as out:
            out.write(packed)
            out.flush()
            return cls(np.memmap(out, np.uint8, "r"))

    def find(self, probes: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """Position of each probe in the sorted order, -1 where it is not listed."""
        hashes = np.fromiter((digest(x) for x in probes), "<u8", len(probes))
        at = np.searchsorted(self.keys, hashes)
        found = np.full(len(probes), -1, np.int64)
        inside = np.flatnonzero(at < len(self.keys))
        for i in inside[self.keys[at[inside]] == hashes[inside]].tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == hashes[i]:
                if self.text[int(self.ends[k]) : int(self.ends[k + 1])].tobytes() == probes[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def entry(self, k: int) -> bytes:
        return self.text[int(self.ends[k]) : int(self.ends[k + 1])].tobytes()


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or a text without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def _suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def _longest(hosts: list[str], paths: list[str], listed: DigestArray, lengths: list[int], whole: bool = False) -> list[int]:
    """Place of the longest listed host suffix (only the host if ``whole``) + path prefix of each url, -1 for none; of equally long ones that of the longer host."""
    probes, owner = [], []
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        for tail in [host] if whole else _suffixes(host):
            for n in lengths:
                if n <= len(path):
                    probes.append((tail + path[:n]).encode())
                    owner.append(i)
    best, size = [-1] * len(hosts), [0] * len(hosts)
    found = listed.find(probes)
    # A url's probes come by host, the longest first.
    for j in np.flatnonzero(found >= 0).tolist():
        n = len(probes[j].decode())
        if n > size[owner[j]]:
            best[owner[j]], size[owner[j]] = int(found[j]), n
    return best


_mapped: dict[str, DigestArray] = {}
_BEST = pa.struct([("rule", pa.string()), ("verdict", pa.string())])


def _path_lengths(rules: Iterable[str]) -> list[int]:
    return sorted({len(r) - r.index("/") if "/" in r else 0 for r in rules})


def _by_digest(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    packed = DigestArray.pack([r.encode() for r, _ in rules])
    listed, name, verdict_of = DigestArray(np.frombuffer(packed, np.uint8)), uuid.uuid4().hex, dict(rules)
    verdicts = [verdict_of[listed.entry(k).decode()] for k in range(len(listed.keys))]
    sent = pages.sparkSession.sparkContext.broadcast((packed, verdicts))
    lengths = _path_lengths(verdict_of)

    @F.arrow_udf("struct<rule string, verdict string>")
    def longest(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        if name not in _mapped:
            _mapped.clear()
            _mapped[name] = DigestArray.mapped(sent.value[0])
        entries, verdicts = _mapped[name], sent.value[1]
        best = _longest(hosts.to_pylist(), paths.to_pylist(), entries, lengths)
        return pa.array(((entries.entry(k).decode(), verdicts[k]) if k >= 0 else (None, None) for k in best), _BEST)

    return pages.withColumn("_best", longest("host", "path"))


def _by_shards(pages: DataFrame, rules: DataFrame, shards: int) -> DataFrame:
    """The same search over digest arrays by the hash of the rules' hosts.

    Every distinct url visits the shard of each suffix of its host. A task
    reads a shard's rules first, packs them, and lets the urls of one salt go
    by, so it holds one array whatever the number of urls.
    """
    def dealt(df: DataFrame, host: Column, salt: Column) -> DataFrame:
        return df.withColumns({"_shard": F.pmod(F.xxhash64(host), F.lit(shards)).cast("int"), "_salt": salt})

    listed = dealt(rules, F.substring_index("rule", "/", 1), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    listed = listed.select("_shard", "_salt", F.lit(0).alias("_kind"), "rule", "verdict", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("tail"))
    urls = pages.select("host", "path").distinct()
    tails = urls.select("host", "path", F.explode(F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")).alias("tail"))
    asked = dealt(tails, F.col("tail"), F.pmod(F.xxhash64("host", "path", F.lit("salt")), F.lit(SALTS)).cast("int"))
    asked = asked.select("_shard", "_salt", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), "host", "path", "tail")
    both = listed.unionByName(asked).repartition(shards * SALTS, "_shard", "_salt").sortWithinPartitions("_shard", "_salt", "_kind")

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rules, entries, verdicts, lengths = None, {}, None, [], []
        for batch in it:
            found = []
            for shard, salt, kind, rule, verdict, host, path, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, salt) != own:
                    own, rules, entries = (shard, salt), {}, None
                if kind == 0:
                    rules[rule] = verdict
                    continue
                if entries is None:
                    entries, lengths = DigestArray.mapped(DigestArray.pack([r.encode() for r in rules])), _path_lengths(rules)
                    verdicts = [rules[entries.entry(k).decode()] for k in range(len(entries.keys))]
                    rules = {}
                found.append((entries, verdicts, lengths, host, path, tail))
            rows = []
            # A batch may reach over several arrays; each is searched at once.
            for _, part in groupby(found, key=lambda f: id(f[0])):
                part = list(part)
                entries, verdicts, lengths = part[0][:3]
                best = _longest([f[5] for f in part], [f[4] for f in part], entries, lengths, whole=True)
                rows += [(f[3], f[4], entries.entry(k).decode(), verdicts[k], len(f[5])) for f, k in zip(part, best, strict=True) if k >= 0]
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["host", "path", "rule", "verdict", "tail"])

    found = both.mapInArrow(search, "host string, path string, rule string, verdict string, tail int")
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("tail"))).alias("_best"))
    return pages.join(best, ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_bytes: int = MAX_DIGEST_BYTES) -> DataFrame:
    """Host, path, winning rule and verdict for every row of ``pages``.

    ``rules`` has columns rule (host followed by a path prefix, as ``net/es/``)
    and verdict. A rule fits its host and all subdomains if the path starts
    with the rule's; the longest wins, of equally long ones that of the longer
    host. A url that no entry of the list fits gets ``default``. Null urls and urls without ``://`` have empty host and
    path and get the default. Null or repeated rules are dropped (of two
    verdicts for one rule the smaller string stands). Other columns of
    ``pages`` stay; columns named host, path, rule or verdict are replaced.
    """
    rules = rules.where("rule IS NOT NULL").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    host, path = split_url(F.col(url))
    pages = pages.drop(*[c for c in ("rule", "verdict", "_best") if c != url]).withColumns({"host": host, "path": path})
    n_bytes = rules.agg(F.sum(F.octet_length("rule") + 16)).first()[0] or 0
    if n_bytes > max_bytes:
        ruled = _by_shards(pages, rules, -(-4 * n_bytes // max(max_bytes, 1)) if max_bytes else 3)
    elif n_bytes:
        ruled = _by_digest(pages, [(r.rule, r.verdict) for r in rules.collect()])
    else:
        ruled = pages.withColumn("_best", F.lit(None).cast("struct<rule: string, verdict: string>"))
    return ruled.select(*pages.columns, F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
