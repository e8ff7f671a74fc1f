"""Counts of shared shingles and the filter of chosen texts, against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shocklens.functions import text as T
from shocklens.operators import documents, meetings, similar


def test_a_batch_of_fewer_words_than_a_shingle_has(spark):
    for text in ("", "a b", "a b c d"):
        df = spark.createDataFrame([(text,)], "text string").coalesce(1)
        assert df.select(T.shingle_hashes("text").alias("h")).first().h == []


@pytest.mark.parametrize(("more", "flush", "buckets", "seed"), [(0.1, 1 << 22, 64, 1), (0.2, 50, 3, 2), (0.6, 700, 1, 3)])
def test_counts_of_shared_shingles(spark, monkeypatch, more, flush, buckets, seed):
    monkeypatch.setattr(meetings, "FLUSH", flush)
    monkeypatch.setattr(meetings, "BUCKETS", buckets)
    rng = random.Random(seed)
    bases = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.choice([3, 30, 90]))] for _ in range(12)]
    rows = []
    for i in range(150):
        g = set(rng.choice(bases)) if i % 3 else set()
        g = {x for x in g if rng.random() < 0.9} | {rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.randrange(1, 25))}
        rows.append((i // 2 if i < 40 else i, rng.choice([5, -7]), sorted(g)))

    def read(batch):
        s = batch.column("s")
        return None, batch.column("x").to_numpy(), batch.column("k").to_numpy(), s.offsets.to_numpy().astype(np.int64), s.flatten().to_numpy()

    df = spark.createDataFrame(rows, "x long, k long, s array<long>").repartition(3)
    got = {r.x: r.c for r in meetings.counts(meetings.met(df, read, "", 0.6, 1.0, more)).collect()}
    held = {}
    for x, k, s in rows:
        most = len(s) - int(np.ceil(0.6 * len(s) - 1e-9)) + 1 + int(more * len(s))
        for g in s[:most]:
            held.setdefault((k, g), set()).add(x)
    want = {}
    for xs in held.values():
        for x in xs if len(xs) > 1 else ():
            want[x] = want.get(x, 0) + 1
    assert got == want and want
    # Whatever is similar to a set of another class has the least count.
    least = {r.n: r.l for r in spark.range(200).select(F.col("id").alias("n"), meetings.least_met(F.col("id"), 0.6, more).alias("l")).collect()}
    close = [(a, b) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and len(set(a[2]) & set(b[2])) >= 0.6 * len(set(a[2]) | set(b[2]))]
    assert len(close) > 20 and all(got[a[0]] >= least[len(a[2])] for a, _ in close)


def test_set_hashes_name_key_and_set():
    bounds, found = T.run_hashes(pa.array([[1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [1, 2, 3, 4, 5] * 2, None, [1, 2, 3, 4, 5] * 3], pa.list_(pa.int64())))
    x = meetings.set_hashes(np.array([1, 2, 1, 1, 1]), bounds, found)
    # Repeats change no set, the key does.
    assert x[2] == x[4] and len(set(x.tolist())) == 4


def test_chosen_loses_none_and_lets_few_others_through(spark, monkeypatch):
    monkeypatch.setattr(meetings, "SLICE", 300)
    ids = spark.range(0, 4000, 2).select("id", F.xxhash64("id").alias("h"))
    test = meetings.chosen(ids.select("h"))
    got = {r.id for r in spark.range(4000).where(test(F.xxhash64("id"))).collect()}
    assert got >= set(range(0, 4000, 2)) and len(got) < 2060
    nothing = meetings.chosen(ids.limit(0).select("h"))
    assert spark.range(50).where(nothing(F.xxhash64("id"))).count() == 0


def test_sets_of_texts_without_partners_never_move(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    line = "one line that every page of all the sites has at its end"
    rows = [("s", i, "", " ".join([*(f"n{i}" if j == i else w for j, w in enumerate(base))]), f"https://h{i}.example/") for i in range(4)]
    rows += [("s", 100 + i, "", " ".join(str(rng.randrange(10**9)) for _ in range(80)) + " " + line, f"https://h{i}.example/") for i in range(60)]
    docs = spark.createDataFrame(rows, "series string, document_id long, title string, text string, url string")
    seen = []

    def spied(texts, sets, keys, bar):
        seen.extend(r.id for r in sets.select("id").collect())
        return similar.links_among(texts, sets, keys, bar)

    monkeypatch.setattr(documents, "links_among", spied)
    links = {(r.a, r.b) for r in documents.story_links(docs, ["series"]).collect()}
    assert sorted(seen) == [0, 1, 2, 3]
    assert {x for e in links for x in e} == {0, 1, 2, 3}
