"""Audit of cited claims against the documents that were shown."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shocklens.functions import text as T
from shocklens.functions.numbers import ratio
from shocklens.session import saved

CLAIM = ["run_id", "claim_id"]
#: Documents of a block, claims of a chunk, the most words of a block that are rows of bytes, and documents whose words are split at once.
BLOCK, CHUNK, DENSE, SLICE = 16_384, 65_536, 4_096, 1_024


def better_documents(claims: DataFrame, shown: DataFrame) -> DataFrame:
    """(run_id, claim_id, better, tied, top, near), one row a claim: documents of its run that hold more of its words than its own one, and as many with a smaller id; the most words that one holds, and the first that does.

    ``claims`` is (run_id, claim_id, words, own, own_held), ``shown`` (run_id,
    doc, words) with distinct words without spaces, ids distinct in a run. A
    run's documents are dealt to blocks and its claims to chunks of bounded
    size by hash. Each block meets each chunk in one task, which adds up the
    words' rows of documents, one byte a document, and sends one row a claim;
    no pair is shuffled. Pairs of a run are looked at all, so its time grows
    with their number.
    """
    parts = F.ceil(F.col("count") / CHUNK).alias("chunks")
    sizes = shown.groupBy("run_id").count().select("run_id", F.ceil(F.col("count") / BLOCK).alias("blocks")).join(claims.groupBy("run_id").count().select("run_id", parts), "run_id")
    sizes = saved(sizes)
    groups = sizes.agg(F.sum(F.col("blocks") * F.col("chunks"))).first()[0] or 1
    zero, keys = F.lit(0).cast("long"), ["run_id", "block", "chunk"]
    joined = F.array_join("words", " ").alias("words")
    docs = shown.select("run_id", "doc", joined).join(sizes, "run_id").select("run_id", F.pmod(F.xxhash64("doc"), F.col("blocks")).alias("block"), F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("chunk"), "doc", "words")
    asked = claims.select(*CLAIM, joined, "own", F.col("own_held").cast("long").alias("own_held")).join(sizes, "run_id")
    # Claims of the same words are in one chunk and counted once there.
    asked = asked.select(*CLAIM, "own", "own_held", "words", F.pmod(F.xxhash64("words"), F.col("chunks")).alias("chunk"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"))
    kinds = dict(claims.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in CLAIM) + ", better long, tied long, top long, near string"
    spread = max(groups, int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = asked.repartition(min(spread, 4096), *keys).groupBy(*keys).cogroup(docs.repartition(min(spread, 4096), *keys).groupBy(*keys)).applyInArrow(_counted, schema)
    found = met.groupBy(*CLAIM).agg(F.sum("better").alias("better"), F.sum("tied").alias("tied"), F.min(F.struct((-F.col("top")).alias("h"), "near")).alias("_n"))
    return found.select(*CLAIM, "better", "tied", (-F.col("_n.h")).alias("top"), "_n.near")


def _split(words: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(words, row of each) of space-joined words."""
    lists = pc.split_pattern(words.combine_chunks(), " ")
    flat, row = lists.flatten(), pc.list_parent_indices(lists)
    given = pc.not_equal(flat, "")
    return flat.filter(given), row.filter(given).to_numpy()


def _counted(claims: pa.Table, shown: pa.Table) -> pa.Table:
    """Counts of one chunk of claims over one block of documents."""
    out: list[list] = [[], [], [], []]
    if len(claims) and len(shown):
        shown = shown.take(pc.sort_indices(shown.column("doc")))
        names, n = shown.column("doc").to_pylist(), len(shown)
        alike = claims.column("words").combine_chunks().dictionary_encode()
        flat, row = _split(pa.chunked_array([alike.dictionary]))
        coded = flat.dictionary_encode()
        word, vocabulary = coded.indices.to_numpy(), len(coded.dictionary)
        starts = np.searchsorted(row, np.arange(len(alike.dictionary) + 1))
        codes, places = [], []
        for k in range(0, n, SLICE):
            held, at = _split(shown.column("words").slice(k, SLICE))
            found = pc.index_in(held, value_set=coded.dictionary)
            known = pc.is_valid(found)
            codes.append(found.filter(known).to_numpy())
            places.append((at[known.to_numpy(zero_copy_only=False)] + k).astype(np.int32))
        code, at = np.concatenate(codes), np.concatenate(places)
        # Frequent words are rows of bytes, the others lists of documents.
        often = np.bincount(code, minlength=vocabulary)
        dense = np.argsort(-often, kind="stable")[:DENSE]
        dense = dense[often[dense] > n / 32]
        line = np.full(vocabulary, -1)
        line[dense] = np.arange(len(dense))
        rows = np.zeros((len(dense), n), np.uint8)
        common = line[code] >= 0
        rows[line[code[common]], at[common]] = 1
        code, at = code[~common], at[~common]
        order = np.argsort(code, kind="stable")
        listed, ends = at[order], np.searchsorted(code[order], np.arange(vocabulary + 1))
        of = alike.indices.to_numpy()
        turn = np.argsort(of, kind="stable")
        own, least, last, count = claims.column("own").to_pylist(), claims.column("own_held").to_numpy(), -1, np.zeros(0)
        result = np.zeros((3, len(claims)), np.int64)
        near: list = [None] * len(claims)
        for i in turn.tolist():
            if of[i] != last:
                last = of[i]
                wanted = word[starts[last] : starts[last + 1]]
                count = np.zeros(n, np.uint8 if len(wanted) < 256 else np.int32)
                for w in wanted.tolist():
                    if line[w] >= 0:
                        np.add(count, rows[line[w]], out=count)
                    else:
                        count[listed[ends[w] : ends[w + 1]]] += 1
                first = int(count.argmax())
            result[:, i] = np.count_nonzero(count > least[i]), np.count_nonzero(count[: bisect_left(names, own[i])] == least[i]), count[first]
            near[i] = names[first]
        out = [*result, near]
    ids = {c: claims.column(c).slice(0, len(out[0])) for c in CLAIM}
    return pa.table(ids | {c: pa.array(x, pa.string() if c == "near" else pa.int64()) for c, x in zip(("better", "tied", "top", "near"), out, strict=True)})


def _cited_texts(citations: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows shown, documents with their greatest text, claims beside the text they cite, null if it was not shown)."""
    held = shown.select("run_id", T.citation_id("document_id").alias("doc"), T.given("text").alias("text"))
    docs = held.groupBy("run_id", "doc").agg(F.max("text").alias("text"))
    claims = citations.select(*CLAIM, "claim", T.citation_id("cited_id").alias("own"))
    return held, docs, claims.join(docs.withColumnRenamed("doc", "own"), ["run_id", "own"], "left")


def citation_support(citations: DataFrame, shown: DataFrame, similarity: Callable[[Column, Column], Column] = T.lexical_support) -> DataFrame:
    """(run_id, claim_id, document_id, support) of each cited claim as ``citation_audit`` has them; support is null if the document was not shown.

    A claim meets only the text it cites, so the time grows with the rows; the
    other documents of its run matter for its rank alone.
    """
    _, _, joined = _cited_texts(citations, shown)
    return joined.select(*CLAIM, F.col("own").alias("document_id"), F.when(F.col("text").isNotNull(), similarity(F.col("claim"), F.col("text"))).alias("support"))


def citation_audit(citations: DataFrame, shown: DataFrame, weak: float = 0.15, top: int = 3, least_shown: int = 6, similarity: Callable[[Column, Column], Column] = T.lexical_support) -> DataFrame:
    """For each cited claim: was the document shown, do words or numbers support the claim, and how does it rank among those shown.

    ``citations`` is (run_id, claim_id, claim, cited_id), ``shown`` (run_id,
    document_id, text); of rows that repeat a document the greatest text
    stands. support is ``similarity`` of claim and cited text, by default the
    share of the claim's words that the text has. support_rank orders all
    documents of the run by that share, ties by id; shown is their number and
    closest the first of them. An empty claim, and one whose document was not
    shown, has no rank. A claim that shares a number with its document is
    never weak or low.
    """
    held, docs, joined = _cited_texts(citations, shown)
    words = F.array_distinct(T.word_tokens("claim"))
    own = saved(joined.select(
        *CLAIM, "own", F.col("text").isNotNull().alias("found"), (T.given("claim") != "").alias("said"), similarity(F.col("claim"), F.col("text")).alias("support"),
        F.size(F.array_intersect(T.numbers("claim"), T.numbers("text"))).alias("shared_numbers"), words.alias("words"), F.size(F.array_intersect(words, T.word_tokens("text"))).alias("own_held")))
    near = better_documents(own.where("found AND said").select(*CLAIM, "words", "own", "own_held"), docs.select("run_id", "doc", F.array_distinct(T.word_tokens("text")).alias("words")))
    ranks = near.select(*CLAIM, (1 + F.col("better") + F.col("tied")).cast("int").alias("support_rank"), F.col("near").alias("closest"))
    numbers = held.select("run_id", "doc").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("shown"))
    known = own.join(numbers, "run_id", "left").select(*CLAIM, F.col("own").alias("document_id"), *[F.when(F.col("found"), F.col(c)).alias(c) for c in ("shown", "support", "shared_numbers")])
    out = known.join(ranks, CLAIM, "left")
    plain = F.col("shared_numbers") == 0
    flag = F.when(F.col("support").isNull(), "missing_document").when(plain & (F.col("support") < weak), "weak_support").when(plain & (F.col("shown") >= least_shown) & (F.col("support_rank") > top), "low_rank").otherwise("ok")
    return out.select(*CLAIM, "document_id", "support", "support_rank", "shown", "shared_numbers", "closest", flag.alias("flag"))


def unresolved_inline(explanations: DataFrame, shown: DataFrame) -> DataFrame:
    """Ids that an explanation names in its text although no such document was shown."""
    named = explanations.select("run_id", F.explode(T.inline_sources("explanation")).alias("document_id"))
    return named.join(shown.select("run_id", T.citation_id("document_id").alias("document_id")), ["run_id", "document_id"], "left_anti")


def citation_report(audit: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """By run: citations, those of each flag, ids named in the text that were not shown, and whether all resolve."""
    counts = {f"n_{f}": F.count_if(F.col("flag") == f) for f in ("ok", "weak_support", "low_rank", "missing_document")}
    out = audit.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_citations"), *[c.alias(n) for n, c in counts.items()])
    if unresolved is not None:
        loose = unresolved.distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("n_unresolved"))
        out = out.join(loose, "run_id", "full").fillna(0)
    else:
        out = out.withColumn("n_unresolved", F.lit(0).cast("long"))
    return out.withColumns({"citations_resolve": (F.col("n_missing_document") == 0) & (F.col("n_unresolved") == 0), "ok_share": ratio("n_ok", "n_citations")})
