"""Classes of alike texts against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shocklens.functions import text as T
from shocklens.operators import similar
from shocklens.operators.graph import connected_components


def _classes(rows, bar):
    """Class of each id by all pairs; rows are (key, id, site, set of whole numbers)."""
    names = {g: k for k, g in enumerate(sorted({g for r in rows for g in r[3]}))}
    m = np.zeros((len(rows), len(names)), np.float32)
    for i, r in enumerate(rows):
        m[i, [names[g] for g in r[3]]] = 1
    n = m.sum(axis=1)
    common = m @ m.T
    close = common / np.maximum(n[:, None] + n - common, 1) >= bar - 1e-7
    key, site = (np.array([str(r[k]) for r in rows]) for k in (0, 2))
    close &= (key[:, None] == key) & ((site[:, None] != site) | (site[:, None] == "None"))
    np.fill_diagonal(close, True)
    label = np.arange(len(rows))
    while True:
        least = np.where(close, label, len(rows)).min(axis=1)
        if (least == label).all():
            return {r[1]: rows[k][1] for r, k in zip(rows, label, strict=True)}
        label = least


def _links(spark, rows, bar):
    df = spark.createDataFrame([(k, i, s, sorted(g)) for k, i, s, g in rows], "k string, id long, site string, s array<long>").repartition(4)
    return similar.similar_links(df, ["k"], bar)


def _found(links, rows):
    roots = {r.node: r.root for r in connected_components(links).collect()}
    return {r[1]: roots.get(r[1], r[1]) for r in rows}


def _same(a, b):
    return {frozenset(i for i in a if a[i] == c) for c in a.values()} == {frozenset(i for i in b if b[i] == c) for c in b.values()}


@pytest.mark.parametrize(("few", "share", "bar", "seed"), [(48, 1024, 0.6, 1), (2, 5, 0.6, 2), (1, 3, 0.8, 3), (4, 2, 0.45, 4)])
def test_links_make_the_classes_of_all_pairs(spark, monkeypatch, few, share, bar, seed):
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "SHARE", share)
    rng = random.Random(seed)
    frame = rng.sample(range(10**6), 30)
    bases = [rng.sample(range(10**6), rng.choice([6, 20, 60])) for _ in range(9)]
    rows, seen = [], set()
    for i in range(260):
        g = set(rng.choice(bases))
        for _ in range(rng.randrange(12)):
            g.discard(rng.choice(sorted(g) or [0]))
            g.add(rng.randrange(2000))
        if rng.random() < 0.3:
            g = set(frame) | set(rng.sample(range(10**6), rng.randrange(25)))
        k = rng.choice("ab")
        if g and (k, frozenset(g)) not in seen:
            seen.add((k, frozenset(g)))
            rows.append((k, i, rng.choice([None, "h1", "h1", "h2", "h3"]), g))
    got = _found(_links(spark, rows, bar), rows)
    want = _classes(rows, bar)
    assert _same(got, want) and len(set(want.values())) < len(want)


def test_a_family_of_two_thousand_costs_its_size(spark):
    rng = random.Random(7)
    base = [rng.randrange(1 << 60) for _ in range(150)]
    rows = []
    for i in range(2000):
        g = list(base)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(0, 146)
            g[at : at + 5] = [rng.randrange(1 << 60) for _ in range(5)]
        rows.append(("a", i, f"h{i}", set(g)))
    # Pages of one site share a frame, which is no story; the family's own pages are elsewhere.
    frame = [rng.randrange(1 << 60) for _ in range(100)]
    rows += [("a", 5000 + i, "site", set(frame) | {rng.randrange(1 << 60) for _ in range(20)}) for i in range(500)]
    links = _links(spark, rows, 0.6).collect()
    assert len(links) < 4 * len(rows)
    got = _found(spark.createDataFrame(links), rows)
    assert len({got[i] for i in range(2000)}) == 1 and all(got[5000 + i] == 5000 + i for i in range(500))
    sample = [rows[i] for i in range(0, 2500, 5)]
    assert _same(_found(_links(spark, sample, 0.6), sample), _classes(sample, 0.6))


def test_odd_sets(spark):
    none = spark.createDataFrame([], "k string, id long, site string, s array<long>")
    assert similar.similar_links(none, ["k"], 0.6).count() == 0
    rows = [(None, 1, None, {1, 2, 3}), (None, 2, None, {1, 2, 3, 4}), ("a", 3, "h", {9}), ("a", 4, None, {9, 10})]
    assert _found(_links(spark, rows, 0.5), rows) == {1: 1, 2: 2, 3: 3, 4: 3}


def test_index_places_count_from_the_rarest(spark):
    df = spark.createDataFrame([("a", 1, None, [1, 2, 3]), ("a", 2, None, [2, 3, 4]), ("a", 3, None, [3, 2])], "k string, id long, site string, s array<long>")
    index = similar.rare_index(df, ["k"], 0.1)
    assert {(r.id, r.g, r.place) for r in index.where(F.col("id") < 3).collect()} == {(1, 2, 1), (1, 3, 2), (2, 2, 1), (2, 3, 2)}


def test_shingle_hashes_stand_for_shingles(spark):
    rng = random.Random(3)
    texts = [None, "", "a b c d", "a b c d e", "e d c b a", "A b, c d e! a b c d e", *(" ".join(rng.choices("abcd", k=rng.randrange(40))) for _ in range(200))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select(T.shingles("text").alias("s"), T.shingle_hashes("text").alias("h")).collect()
    named = {}
    for r in rows:
        assert len(r.s) == len(r.h) and r.h == sorted(r.h)
        for g in r.h:
            named.setdefault(g, []).append(set(r.s))
    # A number stands for one run of words in all texts that have it, and for no other.
    meant = [set.intersection(*x) for x in named.values()]
    assert all(meant) and len(named) == len(set().union(*(r.s for r in rows)))


def test_an_index_row_moves_numbers_only(spark):
    df = spark.createDataFrame([("a", 1, "h", [1, 2]), ("a", 2, "h", [2, 3]), ("b", 3, "h", [2]), (None, 4, "h", [2])], "k string, id long, site string, s array<long>")
    assert {(r.k, r.id, r.g, r.f) for r in similar.rare_index(df, ["k"], 0.1).collect()} == {("a", 1, 2, 2), ("a", 2, 2, 2)}
    moved = similar.rare_index(df, ["k"], 0.1)._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in moved.splitlines() if "Generate explode" in x)
    assert "site" not in line
