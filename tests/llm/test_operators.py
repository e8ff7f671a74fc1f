import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from shocklens.llm import decontaminate, license_scan, line_dedup, quality_rank, quality_rules, queries, sentencepiece_codec, sharding, simhash, token_count, url_filter
from shocklens.operators.graph import connected_components

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "a b c d e f"), (6, "a b c d e f"), (7, "A B C D E F"), (None, "lost id, some text here for it"), (None, None),
    (8, "a long line of text here\nx\nA long line of text here \nother"), (9, "  a LONG line of text here\nmore\n\n"), (10, "ß İ 漢字 \U0001f600 é\u0301 ▁ x▁y"), (11, "word " * 3000), (12, "z" * 5000), (13, "<|endoftext|> a<|endoftext|>"),
    (14, "no\x00nul\x0bvt\x0cff\rcr\u00a0nb\u2028ls"), (15, "   three   spaces    and\n\n\nlines"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "src", t, 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fingerprint string, kept int").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_sql_oracles(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf_dir)
        want = con.execute(sql).df()
        order = sorted(got.columns)
        assert sorted(want.columns) == order, name
        key = lambda rows: sorted((tuple(str(round(v, 9) if isinstance(v, float) else v) for v in r) for r in rows))
        assert key(map(tuple, got.select(*order).collect())) == key(want[order].astype(object).where(want[order].notna(), None).itertuples(index=False)), name


@pytest.mark.parametrize("text", [t for _, t in ODD])
def test_simhash_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    assert simhash.fingerprint(text) == want


def _components(fps, radius=2):
    root = {i: i for i in fps}
    ids = sorted(fps)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_components(docs, sf_dir):
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = _components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("small", [2, 3, 16, 1000])
def test_simhash_links_small_and_large_buckets(spark, small):
    rng = random.Random(small)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base:
        for _ in range(30):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    want = _components({f: f for f in fps})
    signed = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(simhash.links(signed, small)).collect()}
    same = {}
    for f in fps:
        same.setdefault(want[f], set()).add(got.get(f, f))
    assert all(len(s) == 1 for s in same.values()) and len(set(map(tuple, same.values()))) == len(same)


def test_simhash_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    zero = {r.doc_id: r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {1: 1, 2: 1, 3: 1, None: 1}
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns
    assert {r.doc_id for r in simhash.keep_one(odd).collect()} >= {1, 6, None} and simhash.keep_one(odd).where("doc_id IN (2, 3, 7)").count() == 0
    assert simhash.keep_one(empty).count() == 0


def _five(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_similar_documents(spark):
    rng = random.Random(8)
    docs, group = [], {}
    for g in range(60):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([40, 150, 600]))]
        for k in range(rng.choice([1, 2, 3, 40 if g == 5 else 4])):
            words = list(base)
            for _ in range(k and rng.randint(0, max(1, len(base) // 70))):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            group[len(docs)] = g
            docs.append((len(docs), " ".join(words)))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert all(group[i] == group[c] for i, c in got.items())
    sets = [_five(t) for _, t in docs]
    close = [(a, b) for a in range(len(docs)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.82]
    assert np.mean([got[a] == got[b] for a, b in close]) >= 0.99


def test_similar_documents_are_confirmed_by_their_sets(spark):
    rng = random.Random(31)
    docs = []
    for g in range(150):
        base = [f"w{g}x{i}" for i in range(204)]
        far = list(base)
        for i in range(5):
            far[20 + 40 * i] = f"n{rng.randrange(10**9)}"
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(far))]
    sets = {i: _five(t) for i, t in docs}
    assert {round(len(sets[2 * g] & sets[2 * g + 1]) / len(sets[2 * g] | sets[2 * g + 1]), 3) for g in range(150)} == {round(175 / 225, 3)}
    assert all(r.doc_id == r.component_id for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_similar_documents_inside_a_crowded_bucket(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs, texts = [], [base]
    for i in range(260):
        words = list(rng.choice(texts))
        for _ in range(rng.randint(2, 5)):
            words[rng.randrange(5, len(words))] = f"n{rng.randrange(10**9)}"
        texts.append(words)
        docs.append((i, " ".join(words)))
    sets = [_five(t) for _, t in docs]
    up = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and up[a] != up[b]:
                least, most = sorted((up[a], up[b]))
                up = [least if x == most else x for x in up]
    assert 20 < len(set(up)) < 240 and max(map(up.count, set(up))) > 3
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for small in (2, 16, 1000):
        assert {r.doc_id: r.component_id for r in simhash.similar_documents(frame, small=small).collect()} == dict(enumerate(up))
    monkeypatch.setattr(simhash, "SHARE", 9)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(frame, small=2).collect()} == dict(enumerate(up))
    # One family of far more texts than a share holds, all close to one of them: no second round is needed for it.
    many = [(i, " ".join(base if i == 90 else [*base[: i % 50 + 40], f"n{i}", *base[i % 50 + 41 :]])) for i in range(120)]
    assert {r.component_id for r in simhash.similar_documents(spark.createDataFrame(many, "doc_id long, text string"), small=2).collect()} == {0}


@pytest.mark.parametrize("wide", [3, 1 << 13])
def test_similar_pairs_counts_common_shingles(monkeypatch, wide):
    monkeypatch.setattr(simhash, "_WIDE", wide)
    rng = np.random.default_rng(2)
    held = [np.unique(rng.integers(0, 40, n)) for n in (0, 1, 5, 30, 30, 60, 200, 200)] + [np.arange(66), np.r_[np.arange(56), 100:104]]
    got = simhash.similar_pairs(held, 0.8)
    for i, a in enumerate(held):
        for j, b in enumerate(held):
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            assert got[i, j] == (10 * both >= 8 * either), (i, j)
    assert got[8, 9]  # exactly 0.8: 56 of 70
    assert simhash.similar_pairs([], 0.8).shape == (0, 0)


def _similar_components(texts):
    """{id: smallest id reachable} by exact similarity of five-word shingle sets, over all pairs that share a shingle."""
    sets = {i: _five(t) for i, t in texts.items()}
    kinds, held = {}, {}
    for i in sorted(sets):
        kinds.setdefault(frozenset(sets[i]), []).append(i)
    for s in kinds:
        for x in s:
            held.setdefault(x, []).append(s)
    root = {s: s for s in kinds}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for s in kinds:
        common = {}
        for x in s:
            for t in held[x]:
                common[t] = common.get(t, 0) + 1
        for t, n in common.items():
            if 10 * n >= 8 * (len(s) + len(t) - n) and find(s) is not find(t):
                root[find(s)] = find(t)
    least = {}
    for s, ids in kinds.items():
        least[find(s)] = min(least.get(find(s), ids[0]), ids[0])
    return {i: least[find(s)] for s, ids in kinds.items() for i in ids}


def test_similar_documents_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = _similar_components({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == want


def test_sketch_estimates_similarity():
    rng = random.Random(4)
    assert simhash.sketch("") == simhash.sketch(None) == ([0] * 4, []) and simhash.sketch("one")[1]
    base = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    far = [f"x{i}" for i in range(20_000)]
    a, b, c = (simhash.sketch(" ".join(x))[0] for x in (base, base[:19_000], far))
    distance = lambda p, q: sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(p, q, strict=True))
    assert distance(a, b) < simhash.furthest(0.8) < 60 < distance(a, c)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 300), (300, 200), (None, 4)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {200: 200, 300: 200}


def test_token_counts(docs, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    for table in (docs, odd):
        texts = table.select("doc_id", "text").collect()
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(table, path).collect())
        n = [len(own.encode(t.text or "", add_special_tokens=False).ids) for t in texts]
        assert got == sorted((str(t.doc_id), len((t.text or "").encode()), k, k > 1024) for t, k in zip(texts, n, strict=True))
    assert token_count.count_tokens(empty, path).count() == 0


def test_token_counts_random_text():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, counter, rng = Tokenizer.from_file(path), token_count.Counter(path), random.Random(5)
    texts = ["".join(rng.choice(["a", "aa", "the", " ", "  ", "\n", "é", "漢", "1", "'s", "'", "!!", "\t", "ing", "\u0301", "٣", "²", "\U0001f600"]) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    assert list(counter.counts(iter(texts))) == [len(own.encode(t, add_special_tokens=False).ids) for t in texts]


def test_shards(odd, empty, docs, tmp_path):
    for limit in (1, 5_000, 100_000, 1 << 40):
        rows = sharding.assign_shards(docs, limit).collect()
        assert len(rows) == docs.count()
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r)
        for shard, held in by.items():
            assert sum(r.n_bytes for r in held) == held[0].shard_bytes
            assert held[0].shard_bytes <= limit or held[0].oversized and len(shard) == sharding.HASH_BITS
            assert not any(o != shard and o.startswith(shard) for o in by)
    rows = sharding.assign_shards(odd, 4_000).collect()
    assert len(rows) == len(ODD) and {r.doc_id for r in rows if r.oversized} == {11, 12}
    assert sharding.assign_shards(empty, 10).count() == 0
    unique = odd.where("doc_id <> 6")
    sharding.write_shards(unique, 4_000, str(tmp_path / "shards"))
    assert odd.sparkSession.read.parquet(str(tmp_path / "shards")).count() == unique.count()


def test_written_shards_hold_every_row(odd, tmp_path):
    sharding.write_shards(odd, 4_000, str(tmp_path / "all"))
    got = odd.sparkSession.read.parquet(str(tmp_path / "all"))
    key = lambda r: (r.doc_id or 0, r.doc_id is None, r.text or "", r.text is None)
    assert sorted(map(key, got.collect())) == sorted(map(key, odd.collect()))
    sizes = got.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n"), F.collect_set("doc_id").alias("ids")).collect()
    assert all((r.n or 0) <= 4_000 or r.ids in ([11], [12]) for r in sizes)


def test_quality_odd_rows(odd, empty):
    rows = {r.doc_id: r for r in quality_rules.judge_quality(odd).collect() if r.doc_id}
    assert (rows[1].n_words, rows[3].n_words, rows[11].n_words) == (0, 0, 3000)
    assert rows[11].n_repeat_words == 3000 and rows[11].base_failed and rows[6].n_repeat_words == 0
    assert quality_rules.judge_quality(odd).count() == len(ODD) and quality_rules.judge_quality(empty).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns and quality_rules.keep_good(empty).count() == 0


def test_quality_rejects_bad_hosts(spark):
    good, poor = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good if i % 10 else poor, f"host{i % 7}") for i in range(700)] + [(1000 + i, poor if i % 5 else good, "bad") for i in range(100)] + [(2000, poor, "once"), (2001, good, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules.judge_quality(table).where("kept").collect()}
    assert {i for i, t, s in rows if t == good and s != "bad"} == kept == {r.doc_id for r in quality_rules.keep_good(table).collect()}
    assert kept == {r.doc_id for r in quality_rules.keep_good(table, max_broadcast=0).collect()}
    assert kept == {r.doc_id for r in quality_rules.judge_quality(table, max_broadcast=0).where("kept").collect()}
    rates = {r.host: r.host_rate for r in quality_rules.host_rates(quality_rules.with_metrics(table)).collect()}
    assert 0.2 < rates["once"] < 1 and rates["bad"] > 0.5 > rates["host1"]


def test_quality_query_rejects_a_host(spark, tmp_path):
    """The registered query beside its SQL on a table in which a source is rejected."""
    good, poor = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good if i % 10 else poor, f"host{i % 7}") for i in range(300)] + [(1000 + i, poor if i % 5 else good, "bad") for i in range(100)] + [(2000, "a b c a b c " * 20, "host1"), (2001, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    order = got.columns
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(order)} FROM ({queries.oracle_sql()['op5_quality_rules']})").fetchall())
    assert not {r.doc_id for r in got.where("kept").collect()} & set(range(1000, 1100)) and got.where("kept").count() > 200


@pytest.mark.parametrize("measure", ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
def test_quality_filters_stay_above_the_measures(spark, measure):
    """A filter is not pushed into the steps over the text, where it would be repeated for every word."""
    long = spark.createDataFrame([(1, "a b c d e f " * 5000, "s")], "doc_id long, text string, source string")
    measured = quality_rules.with_metrics(long).where(measure if measure == "base_failed" else f"{measure} > 0")
    plan = measured._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("split(") and plan.count("Filter") == 1
    assert measured.count() == (measure not in ("n_symbols", "n_dup_lines"))


def _lines(rows):
    first, out = {}, {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        for x in (t or "").split("\n"):
            key = re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 10:
                first.setdefault(key, i)
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or first.get(re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")), i) == i]
        out.setdefault(i, []).append((len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("partitions", ["2", "61"])
def test_line_dedup(spark, odd, empty, partitions):
    rng = random.Random(3)
    hot = "the same line in every document"
    rows = [(rng.randrange(400), "\n".join(rng.choice([hot, "x", "", f"a line number {rng.randrange(300)}", hot.upper() + " "]) for _ in range(rng.randint(0, 6)))) for _ in range(300)]
    rows = list({i: (i, t) for i, t in rows}.values())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for table, want in ((spark.createDataFrame(rows, "doc_id long, text string"), _lines(rows)), (odd, _lines(ODD))):
            got = {}
            for r in line_dedup.dedup_lines(table).collect():
                got.setdefault(r.doc_id, []).append((r.n_lines, r.n_dropped, r.kept_sha256))
            assert {k: sorted(v) for k, v in got.items()} == want
            texts = {}
            for r in line_dedup.without_repeated_lines(table).collect():
                texts.setdefault(r.doc_id, []).append(hashlib.sha256((r.text or "").encode()).hexdigest())
            assert {k: sorted(v) for k, v in texts.items()} == {k: sorted(x[2] for x in v) for k, v in want.items()}
        assert line_dedup.dedup_lines(empty).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bitmaps():
    for gone in ([], [0], [3, 900], list(range(50))):
        stay = line_dedup.unpack(line_dedup.pack(gone), 1000)
        assert sorted(np.flatnonzero(~stay).tolist()) == gone
    assert line_dedup.unpack(None, 3).all()


def test_quality_rank_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ranked = quality_rank.rank_quality(docs, labels)
    assert ranked.count() == docs.count()
    rows = ranked.where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.9
    good, poor = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([(g > p) + 0.5 * (g == p) for g in good for p in poor]) >= 0.9


def test_quality_rank_against_plain_python(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    extra = spark.createDataFrame([(1, 0), (1, 1), (None, 1)], "doc_id long, quality int")
    given = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).unionByName(extra)
    laid = [quality_rank.rank_quality(docs.repartition(n), given.repartition(n), per_class=20) for n in (1, 7)]
    one, two = ({r.doc_id: (r.held_out, r.score, r.predicted) for r in x.collect()} for x in laid)
    assert one == two
    texts = {r.doc_id: r.text for r in docs.collect()}
    by = {}
    for r in given.collect():
        if r.doc_id is not None and r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5:
            by.setdefault(r.doc_id, set()).add(r.quality)
    assert by.get(1, {0, 1}) == {0, 1}
    hashed = {r.i: r.h for r in spark.createDataFrame([(i,) for i in by], "i long").select("i", F.xxhash64(F.col("i").cast("string")).alias("h")).collect()}
    sample = [sorted((i for i, q in by.items() if q == {c}), key=lambda i: (hashed[i], i))[:20] for c in (1, 0)]
    good, poor = (np.array([quality_rank.features(texts[i]) for i in ids if i in texts]) for ids in sample)
    share = sum(q == {1} for q in by.values()) / sum(len(q) == 1 for q in by.values())
    # The fit again, by plain gradient steps on the same loss, in loops' terms: mean over pairs of log(1 + exp(-w.d)) + ridge |w|^2 / 2.
    mean, spread = np.vstack([good, poor]).mean(axis=0), np.vstack([good, poor]).std(axis=0) + 1e-9
    side = lambda x: np.array([[min(4, max(-4, v)) for v in (r - mean) / spread] for r in x])
    a, b = (np.hstack([side(x), side(x) ** 2]) for x in (good, poor))
    rng = np.random.default_rng(7)
    diff = a[rng.integers(len(a), size=quality_rank.PAIRS)] - b[rng.integers(len(b), size=quality_rank.PAIRS)]
    model = quality_rank.fit(good, poor, share)
    slope = diff.T @ (1 / (1 + np.exp(diff @ model["w"]))) / len(diff) - 1e-3 * model["w"]
    assert np.abs(slope).max() < 1e-6
    wrong = lambda cut: share * np.mean(a @ model["w"] < cut) + (1 - share) * np.mean(b @ model["w"] >= cut)
    assert wrong(model["cut"]) <= min(wrong(c) for c in np.r_[a @ model["w"], b @ model["w"]]) + 1e-12
    for i, t in texts.items():
        x = side([quality_rank.features(t)])
        s = 1 / (1 + np.exp(-((np.hstack([x, x**2]) @ model["w"])[0] - model["cut"]) / model["scale"] - np.log(0.3 / 0.7)))
        assert abs(one[i][1] - s) < 1e-9 and one[i][2] == (s >= 0.3) and one[i][0] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_quality_rank_learns_from_every_label(spark, monkeypatch):
    monkeypatch.setattr(quality_rank, "SHARE", 300)
    rows = [(i, ("12 34 " if i % 2 else "plain words ") * (3 + i % 7)) for i in range(900)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    whole = [{r.doc_id: r.score for r in quality_rank.rank_quality(docs.repartition(n), labels.repartition(n)).collect()} for n in (1, 5)]
    assert whole[0] == whole[1] and all((s >= 0.3) == bool(i % 2) for i, s in whole[0].items())
    seen = []
    monkeypatch.setattr(quality_rank, "fit_whole", lambda labelled, share: seen.append((labelled.count(), share)))
    quality_rank.rank_quality(docs, labels)
    assert seen[0][0] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows)
    for g, p in ((3, 40), (40, 3), (50, 30), (30, 50), (1, 1)):
        a, b = quality_rank._matched(g, p)
        assert set(a) == set(range(g)) and set(b) == set(range(p)) and len(set(zip(a, b))) == len(a)


def test_quality_rank_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(6, 1), (7, 0), (10, 0), (None, 1), (12, 0), (11, None), (14, 1), (14, 1)], "doc_id long, quality int")
    rows = quality_rank.rank_quality(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_rank.rank_quality(odd, labels.where("quality = 1")).collect()} == {0.5}
    assert quality_rank.rank_quality(empty, labels).count() == 0


def test_licenses(spark, odd, empty):
    mit = license_scan.LICENSES["mit-text"]
    filler = " ".join(f"word{i}" for i in range(700))
    edited = mit.replace("merge", "join")
    rows = [(1, f"{filler} {mit} {filler}"), (2, "RELEASED under the (mit) license"), (3, filler), (4, f"{filler} {edited}"), (5, "Licensed under CC BY-NC 4.0." + filler), (6, mit[:40])]
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "mit-text"), (2, "mit"), (4, "mit-text"), (5, "cc-by-nc-4.0")} and got[1, "mit-text"] == 1 and 0.8 <= got[4, "mit-text"] < 1
    assert license_scan.scan_licenses(odd).count() == 0 and license_scan.scan_licenses(empty).count() == 0
    long = " ".join(f"v{i}" for i in range(40_000))
    at = len(long) // 2
    assert [m[0] for m in license_scan.Templates(license_scan.LICENSES).scan(f"{long[:at]} {mit} {long[at:]} {mit}")] == ["mit-text"]


def test_licenses_from_a_table(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    known = {f"l{i}": text(rng.choice([5, 9, 40, 300])) for i in range(120)}
    table = spark.createDataFrame([*known.items(), ("l1", "zz"), (None, "a b c d e f"), ("none", None), ("short", "a b")], "license string, text string")
    given = license_scan.template_table(table)
    assert given == known | {"short": "a b"}
    docs, want = [], set()
    for i in range(200):
        words = text(rng.choice([0, 50, 700])).split()
        name = f"l{rng.randrange(120)}"
        held = known[name].split()
        if len(held) > 30 and i % 2:
            held[3] = "changed"
        docs.append((i, " ".join([*words, *held, *words])))
        want.add((i, name))
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()}
    assert got >= want
    brute = {(i, n) for i, t in docs for n, x in known.items() if len(set(license_scan.shingles(license_scan.words_of(x))) & set(license_scan.shingles(license_scan.words_of(t)))) >= 0.8 * len(set(license_scan.shingles(license_scan.words_of(x))))}
    assert got <= brute
    with pytest.raises(ValueError, match="license texts"):
        license_scan.template_table(table, max_bytes=10)


def _contaminated(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(own) - n + 1 if w else 0):
            if tuple(own[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("slice_bytes", [1, 300, 1 << 20])
def test_decontamination(spark, odd, empty, slice_bytes):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 12, 13, 14, 20]))) for i in range(2, 12)] + [(20, None), (21, " !! "), (None, "lost words here"), (2, "Same ID, again"), (10, "ß İ 漢字")]
    rows = [(i, text(rng.randint(0, 60)) + rng.choice(["", " LOST, words-here", " same id again c c c c"])) for i in range(60)] + [(99, None)]
    for table, data in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (odd, ODD)):
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.items_sha256, r.contaminated) for r in decontaminate.find_contamination(table, bench, slice_bytes).collect())
        want = sorted((str(i), n, h, f, hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0 and 20 * h >= n) for i, (n, h, f) in ((i, _contaminated(t, items)) for i, t in data))
        assert got == want
        clean = decontaminate.without_contaminated(table, bench, slice_bytes)
        assert clean.columns == table.columns and clean.count() == sum(not r[5] for r in want)
    assert decontaminate.find_contamination(odd, bench.where("item_id = -1")).where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(empty, bench).count() == 0


def test_decontamination_is_one_python_step(odd, spark):
    rows = [(i, " ".join(f"x{i}y{k}" for k in range(20))) for i in range(10)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    found = decontaminate.find_contamination(odd.unionByName(spark.createDataFrame([(77, rows[7][1], "", "", 1)], odd.schema)), bench, 100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {(r.doc_id, r.n_hit, tuple(r["items"])) for r in found.where("n_hit > 0").collect()} == {(77, 20, ("7",))}


def test_slices_are_built_once_for_many_batches(monkeypatch):
    """Ten slices over twelve batches: a build for each slice and group of batches, less what the turn of the order keeps."""
    built, texts = [], [pa.array([f"t{i} " * 5]) for i in range(12)]
    monkeypatch.setattr(decontaminate, "build", lambda items: built.append(items) or [])
    sent = [type("Sent", (), {"value": k})() for k in range(10)]
    for slices, group, builds in ((sent, 1 << 30, 10), (sent, 6 * texts[0].nbytes, 17), (sent[:3], 1, 3)):
        decontaminate._ready.clear()
        built.clear()
        batches = (pa.RecordBatch.from_arrays([pa.array([{"a": 1}]), t], ["_row", "_text"]) for t in texts)
        assert len(list(decontaminate.search_batches(batches, slices, "x", group))) == 12
        assert len(built) == builds and len(decontaminate._ready) == decontaminate.SLICES_HELD


def test_sentencepiece_refuses_other_models(tmp_path):
    import sentencepiece

    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    path = public_tokenizers.path("piece_bpe_32k.model")
    sentencepiece_codec.Codec(path)
    for k, change in enumerate((lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", not m.normalizer_spec.add_dummy_prefix))):
        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        change(model)
        (tmp_path / f"{k}.model").write_bytes(model.SerializeToString())
        assert sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / f"{k}.model")).get_piece_size()
        with pytest.raises(ValueError, match="BPE"):
            sentencepiece_codec.Codec(str(tmp_path / f"{k}.model"))


def test_sentencepiece(docs, odd, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    for table in (docs, odd):
        texts = sorted((str(r.doc_id), own.encode(r.text or "")) for r in table.select("doc_id", "text").collect())
        coded = sentencepiece_codec.encode(table, path)
        assert sorted((str(r.doc_id), r.token_ids) for r in coded.collect()) == texts
        assert {r.doc_id for r in coded.where("NOT lossless").collect()} <= {10}
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    assert sentencepiece_codec.encode(empty, path).count() == 0


def test_sentencepiece_random_text():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, codec, rng = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path), random.Random(5)
    bits = ["a", "b", "th", "e", "ing", " ", "  ", "\n", "é", "漢", "字", "1", "'", "!", "\t", "\u0301", "\U0001f600", "st", "er", "on", "S", "ization"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["".join(rng.choice("aeintrs") for _ in range(n)) for n in (100, 127, 128, 129, 700, 3000)] + [" " * 50, "x" + " " * 33 + "y"]
    for text, ids in zip(texts, codec.encode(iter(texts)), strict=True):
        assert ids.tolist() == own.encode(text), repr(text)
        assert codec.decode(ids) == text == own.decode(ids.tolist())


def test_sentencepiece_work_grows_with_distinct_runs(monkeypatch):
    """Words are learned without the marks behind them, and what decodes word by word is not decoded again as a text."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, codec, rng = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path), random.Random(6)
    codec._forget()
    words = ["".join(rng.choices(["th", "er", "on", "ou", "in", "é"], k=rng.randint(1, 6))) for _ in range(80)]
    marks = ["", ",", ".", "!!", "$$$", ".%%%", "):", "1", "²."]
    texts = [" ".join(w + m for w in words) for m in marks] + [f"{w}{m}{v}" for w, v in zip(words, words[1:], strict=False) for m in marks[1:]] + [""]
    assert [ids.tolist() for ids in codec.encode(iter(texts))] == [own.encode(t) for t in texts]
    assert len(codec.known) <= 2 * len(set(words)) + len(marks)
    decoded, whole = [], sentencepiece_codec.Codec.decode
    monkeypatch.setattr(sentencepiece_codec.Codec, "decode", lambda self, ids: decoded.append(1) or whole(self, ids))
    assert [same for _, same in codec.coded(iter([*texts, "a▁b"]))] == [True] * len(texts) + [False]
    assert len(decoded) == 1
    # A piece that decodes to something else is told, in the texts that hold it only.
    codec._forget()
    codec.shown[own.piece_to_id("▁of")] = b" off"
    codec.shown_size[own.piece_to_id("▁of")] = 4
    assert [same for _, same in codec.coded(iter(["one of two", "two", "of", "x"]))] == [False, True, False, True]


def test_suffix_array():
    """By as many numbers as asked for at least, whether one sort, two or three do it."""
    rng = random.Random(8)
    for bits, width, n in ((2, 5, 300), (3, 16, 2000), (20, 16, 2000), (31, 16, 5000), (3, 16, 1), (20, 16, 2)):
        text = [rng.choice([0, 1, 2, 2, 3]) for _ in range(n)]
        order, key, step = sentencepiece_codec.suffix_array(np.array(text), bits, width)
        heads = [(text[i : i + width] + [0] * width)[:width] for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(n)) and heads == sorted(heads)
        assert all(int(k) == sum(x << bits * (step - 1 - j) for j, x in enumerate(text[i : i + step])) for i, k in enumerate(key.tolist()))


@pytest.mark.parametrize("alphabet", ["ab", "etaoin▁", "".join(map(chr, range(0x21, 0x17F))), "".join(map(chr, range(0x4E00, 0x9FA0, 3))) + "erth"])
def test_sentencepiece_edges(alphabet):
    """Every occurrence of every piece, whether one packed word, two or more hold the longest one."""
    codec, rng = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model")), random.Random(7)
    names = ["".join(map(chr, row[row > 0])) for row in np.r_[0, np.flatnonzero(codec.number)][codec.spelled]]
    assert [len(x) for x in names] == codec.size.tolist()
    fit = [x for x in names if frozenset(alphabet).issuperset(x)] if len(alphabet) < 999 else names
    long = [x for x in fit if len(x) > 6] or fit
    for n in (0, 1, 3, 400):
        text = "\0" + "\0".join("".join(rng.choice([rng.choice(alphabet), rng.choice(fit), rng.choice(long)]) for _ in range(rng.randint(1, 9))) for _ in range(n)) + "\0"
        index = {x: i for i, x in enumerate(names)}
        want = {(a, k): index[text[a : a + k]] for a in range(len(text)) for k in range(1, codec.longest + 1) if text[a : a + k] in index and a + k <= len(text)}
        found = codec.edges(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        at = np.flatnonzero(found >= 0)
        assert {divmod(i, codec.longest + 1): p for i, p in zip(at.tolist(), found[at].tolist(), strict=True)} == want


def test_url_filter(spark):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), (None, "block"), ("org", "block"), ("com/", "block")]
    urls = ["http://Example.COM/en/x?y", "https://www.example.com/en/", "https://a.www.example.com/en/z#q", "http://example.com", "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/", None, "", "no scheme", "a://b://c.com/d", "http://u.org?x", "ftp://com/EN/", "http://notexample.com/en/"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "rule string, verdict string")
    small, joined = (sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, table, max_bytes=n).collect()) for n in (1 << 20, 0))
    assert small == joined and [r[1] for r in small][:2] == ["example.com", "www.example.com"]
    assert [r[3] for r in small] == ["example.com/en/", "www.example.com/en/", "www.example.com/en/", None, "net/es/", "net/fr/", None, None, None, None, None, "org", "com/", "com/"]
    assert url_filter.judge_urls(pages, table.limit(0)).where("verdict = 'allow'").count() == len(urls)
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0


def test_url_filter_ties(spark):
    """Of equally long rules the one of the longer host stands, in both ways of searching."""
    pages = spark.createDataFrame([(1, "http://a.com/ab?x"), (2, "http://com/ab"), (3, "http://b.a.com/")], "page_id long, url string")
    for rules in ([("a.com/", "allow"), ("com/ab", "block")], [("com/ab", "block"), ("a.com/", "allow")]):
        table = spark.createDataFrame(rules, "rule string, verdict string")
        for n in (1 << 20, 0):
            got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, table, max_bytes=n).collect()}
            assert got == {1: ("a.com/", "allow"), 2: ("com/ab", "block"), 3: ("a.com/", "allow")}


def test_url_filter_shards(spark):
    """A list cut into arrays by host gives the rows of one array; repeated urls and a host with a third of all rows too."""
    rng = random.Random(4)
    hosts = [".".join(rng.choices(["a", "b", "cc", "d"], k=rng.randint(1, 4))) for _ in range(60)]
    path = lambda: "".join(rng.choices(["/x", "/yy", "/z"], k=rng.randint(0, 4)))
    rules = [(rng.choice(hosts) + path(), rng.choice(["allow", "block"])) for _ in range(300)]
    urls = [f"http://{rng.choice(hosts)}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(400)] + [f"http://a.b{path()}" for _ in range(300)] + [None, "", "x"]
    pages = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(urls)], "page_id long, url string, _salt string").repartition(3)
    table = spark.createDataFrame(rules, "rule string, verdict string")
    one, many, more = (sorted(map(str, url_filter.judge_urls(pages, table, max_bytes=n).collect())) for n in (1 << 20, 0, 3000))
    assert one == many == more and len(one) == len(urls)


def test_digest_array_collisions():
    entries = [f"host{i}.com/".encode() for i in range(2000)]
    weak = lambda x: len(x) % 7
    for digest in (weak, xxhash.xxh64_intdigest):
        listed = url_filter.DigestArray.mapped(url_filter.DigestArray.pack(entries, digest))
        found = listed.find([*entries, b"absent", b""], digest)
        assert [listed.entry(k) for k in found[:-2].tolist()] == entries and (found[-2:] == -1).all()


def test_pipeline_against_plain_python(spark, sf_dir, docs):
    import corpus_pipeline

    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    from sentencepiece import SentencePieceProcessor

    kept = {r.doc_id for r in quality_rules.judge_quality(docs).where("kept").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    first = {}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for i in sorted(rows):
        for x in rows[i].split("\n"):
            if len(key(x)) >= 10:
                first.setdefault(key(x), i)
    rows = {i: "\n".join(x for x in t.split("\n") if first.get(key(x), i) == i) for i, t in rows.items()}
    comp = _similar_components(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    own = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t in rows.items():
        n, h, _ = _contaminated(t, items)
        if comp[i] == i and not (h > 0 and 20 * h >= n):
            want[i] = own.encode(t)
    assert got == want


def test_pipeline_stages_take_odd_rows(spark, odd, empty, sf_dir):
    import corpus_pipeline

    clash = odd.withColumns({"_row": F.lit(1), "_host": F.lit("h"), "row": F.lit(2), "bitmap": F.lit("b"), "_doc_id": F.lit(3), "host": F.lit("x"), "component_id": F.lit(5), "_o": F.lit(0), "n_words": F.lit(9)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (odd, empty, clash):
            out = stage(spark, table, sf_dir)
            assert out.columns == table.columns, name
            assert out.count() <= table.count(), name
    assert line_dedup.without_repeated_lines(clash).select("doc_id", "text", "_doc_id").count() == len(ODD)
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).count() == len(ODD) and corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).count() == 0
