"""The citation audit against every claim beside every document, and keep_latest under any order of rows."""

import random
import re

import pytest

from shocklens import plans
from shocklens.functions import text as T
from shocklens.operators import citations, documents


def _audit(claims, shown):
    docs = {}
    for run, doc, text in shown:
        held = docs.setdefault(run, {})
        held[doc] = max(held.get(doc, ""), text or "")
    words = lambda t: set(re.findall(r"[^\W_]+", (t or "").lower()))
    numbers = lambda t: set(re.findall(r"[0-9]+(?:\.[0-9]+)?", (t or "").replace(",", ".")))
    out = []
    for run, i, claim, cited in claims:
        own, held, k = re.sub("(?i)^doc_", "", cited.strip()), docs.get(run, {}), len(words(claim))
        if own not in held:
            out.append((run, i, None, None, None, None, "missing_document"))
            continue
        share = {d: len(words(claim) & words(t)) / k if k else 0.0 for d, t in held.items()}
        order = sorted(held, key=lambda d: (-share[d], d))
        rank = order.index(own) + 1 if claim else None
        common = len(numbers(claim) & numbers(held[own]))
        flag = "weak_support" if not common and share[own] < 0.15 else "low_rank" if not common and len(held) >= 6 and rank and rank > 3 else "ok"
        out.append((run, i, round(share[own], 9), rank, common, order[0] if claim else None, flag))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_ranks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(25)] + ["der", "ÄÖ", "12", "3.5"]
    often = [1 / (1 + i) for i in range(len(words))]
    text = lambda most: " ".join(rng.choices(words, often, k=rng.randrange(most)))
    shown = [(f"r{i % 5}", f"d{i // 5}", text(40)) for i in range(120)] + [("r0", "d1", "w3 w4"), ("r9", "x", None)]
    claims = [(f"r{rng.randrange(6)}", i, text(9), rng.choice(["doc_d", "D", "doc_none"]) + str(rng.randrange(26))) for i in range(150)]
    claims = [(r, i, c, q.replace("D", "d")) for r, i, c, q in claims] + [("r0", 900, "", "d1"), ("r0", 901, "!!", "d2"), ("r9", 902, "w1", "x"), ("r8", 903, "w1", "x")]
    got = citations.citation_audit(
        spark.createDataFrame(claims, "run_id string, claim_id long, claim string, cited_id string").repartition(3),
        spark.createDataFrame(shown, "run_id string, document_id string, text string").repartition(3)).collect()
    have = [(r.run_id, r.claim_id, None if r.support is None else round(r.support, 9), r.support_rank, r.shared_numbers, r.closest, r.flag) for r in got]
    want = _audit(claims, shown)
    assert sorted(have, key=str) == want
    assert {w[-1] for w in want} == {"ok", "weak_support", "low_rank", "missing_document"}


def test_a_supported_claim_reads_short_lists(spark):
    shown = [("r", f"d{i}", f"the of and u{i}") for i in range(400)]
    claims = [("r", i, f"the of and u{i}", f"d{i}") for i in range(400)]
    docs = spark.createDataFrame(shown, "run_id string, doc string, text string").selectExpr("run_id", "doc", "split(text, ' ') AS words")
    asked = spark.createDataFrame(claims, "run_id string, claim_id long, claim string, own string").selectExpr("run_id", "claim_id", "split(claim, ' ') AS words", "own", "4 AS own_held")
    assert citations.better_documents(asked, docs).count() == 400


def test_weak_claims_send_one_row_each(spark):
    docs = spark.createDataFrame([("r", f"d{i:03}", f"the of u{i}") for i in range(300)], "run_id string, doc string, text string").selectExpr("run_id", "doc", "split(text, ' ') AS words")
    asked = spark.createDataFrame([("r", i, f"the of x{i} y{i}", f"d{i:03}") for i in range(300)], "run_id string, claim_id long, claim string, own string").selectExpr("run_id", "claim_id", "split(claim, ' ') AS words", "own", "2 AS own_held")
    got = citations.better_documents(asked, docs).collect()
    assert len(got) == 300 and all((r.better, r.tied, r.top, r.near) == (0, r.claim_id, 2, "d000") for r in got)


@pytest.mark.parametrize(("block", "chunk", "dense"), [(3, 4, 2), (7, 1000, 0), (1000, 2, 1)])
def test_blocks_and_chunks_leave_the_ranks(spark, monkeypatch, block, chunk, dense):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("DENSE", dense)):
        monkeypatch.setattr(citations, name, value)
    rng = random.Random(5)
    text = lambda most: " ".join(rng.choices([f"w{chr(97 + i)}" for i in range(26)], [1 / (1 + i) for i in range(26)], k=rng.randrange(most)))
    shown = [(f"r{i % 2}", f"d{i // 2}", text(30)) for i in range(50)]
    claims = [(f"r{i % 2}", i, " ".join(f"{a}{b}" for a in "xyz" for b in range(120)) + " wa" if i == 9 else text(8), f"d{rng.randrange(25)}") for i in range(40)]
    got = citations.citation_audit(spark.createDataFrame(claims, "run_id string, claim_id long, claim string, cited_id string"), spark.createDataFrame(shown, "run_id string, document_id string, text string")).collect()
    have = [(r.run_id, r.claim_id, None if r.support is None else round(r.support, 9), r.support_rank, r.shared_numbers, r.closest, r.flag) for r in got]
    assert sorted(have, key=str) == _audit(claims, shown)


def test_support_of_any_similarity_needs_no_ranks(spark, sf_dir):
    claims = spark.createDataFrame([("r", 1, "Frost in May", "doc_a"), ("r", 2, "no frost", "b"), ("r", 3, "frost", "c"), ("r", 4, None, "a"), ("s", 5, "frost", "a"), ("r", 6, "", "a")], "run_id string, claim_id long, claim string, cited_id string")
    shown = spark.createDataFrame([("r", "a", "frost, may"), ("r", "a", None), ("r", "b", None), ("r", "d", "no frost")], "run_id string, document_id string, text string")
    similar = lambda a, b: T.jaccard(T.ascii_tokens(a), T.ascii_tokens(b))
    for f in (T.lexical_support, similar):
        want = {r.claim_id: (r.run_id, r.document_id, r.support) for r in citations.citation_audit(claims, shown, similarity=f).collect()}
        assert {r.claim_id: (r.run_id, r.document_id, r.support) for r in citations.citation_support(claims, shown, f).collect()} == want
    assert {i: w[2] for i, w in want.items()} == {1: 2 / 3, 2: 0.0, 3: None, 4: 0.0, 5: None, 6: 0.0}
    # The query asks for support alone, so no claim may meet the other documents of its run.
    plans.load()
    assert "CoGroups" not in plans.QUERIES["udf_01_audit_by_similarity"](spark, sf_dir)._jdf.queryExecution().toString()


def test_report_counts_flags_and_loose_ids(spark):
    audit = spark.createDataFrame([("r", "ok"), ("r", "weak_support"), ("s", "ok")], "run_id string, flag string")
    loose = spark.createDataFrame([("s", "zz"), ("s", "zz"), ("t", "y")], "run_id string, document_id string")
    got = {r.run_id: (r.n_citations, r.n_ok, r.n_weak_support, r.n_unresolved, r.citations_resolve) for r in citations.citation_report(audit, loose).collect()}
    assert got == {"r": (2, 1, 1, 0, True), "s": (1, 1, 0, 1, False), "t": (0, 0, 0, 1, False)}
    assert citations.citation_report(audit.limit(0)).count() == 0


def test_latest_rows_do_not_depend_on_arrival(spark):
    schema = "k int, v double, note string"
    old = [(1, 1.0, "a"), (1, 3.0, "b"), (2, None, "c"), (2, 1.0, "d"), (3, 9.0, "old")]
    new = [(3, 1.0, "x"), (3, 1.0, "y"), (4, None, "p"), (4, None, "q"), (None, 1.0, "n")]
    for turn in range(4):
        random.Random(turn).shuffle(old)
        random.Random(turn).shuffle(new)
        frames = [spark.createDataFrame(rows, schema).repartition(1 + turn) for rows in (old, new)]
        assert {r.k: r.note for r in documents.keep_latest(*frames, ["k"], ("v",)).collect()} == {1: "b", 2: "d", 3: "y", 4: "q", None: "n"}
