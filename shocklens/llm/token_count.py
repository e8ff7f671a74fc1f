"""Token counts by rank-synchronous merging of ragged numpy arrays.

The pre-tokens of a batch of texts are held as one flat symbol array with the
row of each symbol. In every round each row looks up the rank of its adjacent
pairs, and all rows merge their own lowest-ranked pair at once; the symbols
left when no pair has a rank are the tokens.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int64(1 << 40)
#: Pre-tokens merged in one go, and how many counts a worker remembers.
PENDING_BYTES = 1 << 20
REMEMBERED = 400_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """Ranks and results of a vocabulary's pair merges, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([ids[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.of_byte[byte] = ids[letter]
        self.special = [x["content"] for x in spec.get("added_tokens", [])]

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece, all pieces merged together."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        left_over = np.zeros(len(pieces), np.int64)
        row = np.repeat(np.arange(len(pieces)), sizes)
        symbol = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        while len(symbol):
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (row[:-1] == row[1:])
            rank = np.where(known, self.ranks[at], NO_RANK)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, NO_RANK], first)
            done = lowest == NO_RANK
            lengths = np.diff(np.r_[first, len(row)])
            left_over[row[first[done]]] = lengths[done]
            chosen = known & (rank == np.repeat(lowest, lengths)[:-1])
            # Of overlapping pairs, as in a run of one symbol, every second one merges, from the left.
            hits = np.flatnonzero(chosen)
            if len(hits):
                start = np.r_[True, np.diff(hits) > 1]
                run_at = np.maximum.accumulate(np.where(start, np.arange(len(hits)), 0))
                hits = hits[(np.arange(len(hits)) - run_at) % 2 == 0]
            symbol[hits] = self.made[at[hits]]
            stay = ~np.repeat(done, lengths)
            stay[hits + 1] = False
            symbol, row = symbol[stay], row[stay]
        return left_over


class Counter:
    """Counts tokens of texts; remembers the counts of pre-tokens it has met."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.find = regex.compile(PRE_TOKEN).findall
        special = self.merges.special
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
        self.known: dict[str, int] = {}

    def _parts(self, text: str) -> tuple[list[str], int]:
        if self.cut is None or not any(x in text for x in self.merges.special):
            return self.find(text), 0
        parts = self.cut.split(text)
        return [p for part in parts for p in self.find(part)], len(parts) - 1

    def _settle(self, pending: list) -> Iterator[int]:
        new = list({p for pieces, _ in pending for p in pieces}.difference(self.known))
        if new:
            self.known.update(zip(new, self.merges.count([p.encode() for p in new]).tolist(), strict=True))
        for pieces, extra in pending:
            yield sum(map(self.known.__getitem__, pieces)) + extra
        if len(self.known) > REMEMBERED:
            self.known.clear()

    def counts(self, texts: Iterator[str]) -> Iterator[int]:
        pending, size = [], 0
        for text in texts:
            pending.append(self._parts(text))
            size += len(text)
            if size > PENDING_BYTES:
                yield from self._settle(pending)
                pending, size = [], 0
        yield from self._settle(pending)


@functools.cache
def counter(path: str) -> Counter:
    """One counter for each vocabulary and worker process."""
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file that every worker can
    read. Special strings inside a text count as one token each; nothing is
    added, cut or padded. Null texts count as empty: no bytes, no tokens.
    Repeated rows and null ids give their own rows; other columns are ignored.
    """
    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(counter(vocabulary).counts(t.as_py() for t in texts), pa.int64())

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
