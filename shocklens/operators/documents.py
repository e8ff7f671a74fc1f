"""News documents: windows, first-wins dedupe, syndicated copies, relevance, the gate and the decision rule."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shocklens.functions import text as T
from shocklens.functions.dates import trading_days_before
from shocklens.functions.numbers import ratio
from shocklens.operators import meetings
from shocklens.operators.graph import connected_components
from shocklens.operators.rank import top_by
from shocklens.operators.reports import report_scores
from shocklens.operators.similar import links_among
from shocklens.session import saved

KEYWORD, SEMANTIC, FLOOR, NEAR = 0.4, 0.85, 0.05, 0.80
FRESH = 2
SIMILAR = 0.6


def age_window(docs: DataFrame, before: int, after: int = 0) -> DataFrame:
    """Adds drop_reason: null for documents from ``before`` days ahead of the day to ``after`` behind it, and for undated ones."""
    gap = F.datediff("day", "published")
    reason = F.when(gap > before, "too old").when(gap < -after, "after the move")
    return docs.withColumns({"undated": F.col("published").isNull(), "drop_reason": reason})


def first_by(docs: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first arrival of each key; blank keys go."""
    keyed = docs.withColumn("_key", key).where(F.coalesce(F.col("_key"), F.lit("")) != "")
    return keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_rn = 1").drop("_rn", "_key")


def url_key(url: str) -> Column:
    """A url without fragment and trailing slashes."""
    return F.regexp_replace(F.split(F.col(url), "#")[0], "/+$", "")


def by_priority(sources: list[DataFrame], url: str = "url") -> DataFrame:
    """Union of sources of which the earlier wins a shared url."""
    both = None
    for i, s in enumerate(sources):
        s = s.withColumn("priority", F.lit(i))
        both = s if both is None else both.unionByName(s, allowMissingColumns=True)
    return first_by(both, url_key(url), F.col("priority"), F.col("position"))


def keep_latest(old: DataFrame, new: DataFrame, keys: list[str], order: tuple[str, ...] = (), by_batch: bool = True) -> DataFrame:
    """Old and new rows, the newest batch's row of each key, in a batch the greatest by ``order``; without ``by_batch`` the order decides first.

    Missing values of ``order`` come last, and rows that it leaves tied are
    told apart by the greatest text of the whole row, so the result does not
    depend on their arrival.
    """
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    whole = F.to_json(F.struct(*sorted(c for c in both.columns if c != "_batch")))
    batch, ordered = [F.col("_batch").desc()], [F.desc_nulls_last(c) for c in order]
    latest = Window.partitionBy(*keys).orderBy(*(batch + ordered if by_batch else ordered + batch), whole.desc())
    return both.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn", "_batch")


def keep_labels(new: DataFrame, old: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """New rows with the labels already given; labelled rows that are not sampled again stay."""
    given = old.where(F.coalesce(F.trim(label), F.lit("")) != "").select(*keys, F.col(label).alias("_given"))
    joined = new.drop(label).withColumn("_new", F.lit(True)).join(given, keys, "full")
    return joined.withColumn(label, F.col("_given")).drop("_given", "_new")


def best_score(keyword: str = "keyword_score", semantic: str = "semantic_score") -> Column:
    return F.greatest(F.coalesce(keyword, F.lit(0.0)), F.coalesce(semantic, F.lit(0.0)))


def passes(mode: str = "dual", keyword: float = KEYWORD, semantic: float = SEMANTIC) -> Column:
    """Relevance by either score; a missing semantic score never passes."""
    k = F.coalesce(F.col("keyword_score"), F.lit(0.0)) >= keyword
    s = F.coalesce(F.col("semantic_score") >= semantic, F.lit(False))
    return {"dual": k | s, "semantic_only": s, "keyword_only": k}[mode]


def gate(docs: DataFrame, keys: list[str], mode: str = "dual") -> DataFrame:
    """One decision for each key: EXPLAIN, or one of three reasons to refuse. ``docs`` holds a row of nulls for a key without documents."""
    counted = F.col("document_id").isNotNull() & (best_score() >= FLOOR)
    accepted = counted & passes(mode)
    out = docs.groupBy(*keys).agg(
        F.count("document_id").alias("considered"), F.count_if(counted).alias("above_floor"), F.count_if(accepted).alias("accepted"),
        F.coalesce(F.max(F.when(counted, best_score())), F.lit(0.0)).alias("best_score"))
    reason = F.when(F.col("considered") == 0, "no_documents_retrieved").when(F.col("above_floor") == 0, "all_documents_below_noise_floor").when(F.col("accepted") == 0, "documents_retrieved_but_below_relevance_threshold").otherwise(
        F.concat(F.col("accepted").cast("string"), F.lit("_document(s)_above_threshold")))
    return out.withColumns({"decision": F.when(F.col("accepted") > 0, "EXPLAIN").otherwise("INSUFFICIENT_EVIDENCE"), "reason": reason})


def accepted_documents(docs: DataFrame, keys: list[str], mode: str = "dual") -> DataFrame:
    """The documents behind a gate's decision, with their place: the best score first, ties by id."""
    held = docs.where(F.col("document_id").isNotNull() & (best_score() >= FLOOR) & passes(mode))
    return held.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(best_score().desc(), "document_id")))


def reading_candidates(docs: DataFrame, age: str = "age") -> DataFrame:
    """Documents the gate accepts, and recent ones just under its bar, marked."""
    passed = (best_score() >= FLOOR) & passes()
    near = F.coalesce(F.col(age).between(0, 3) & (F.col("semantic_score") >= NEAR), F.lit(False))
    return docs.withColumn("passed_gate", passed).where(F.col("passed_gate") | near)


def capped(docs: DataFrame, keys: list[str], n: int = 12) -> DataFrame:
    """The n best of each key."""
    return top_by(docs, keys, n, best_score().desc(), F.col("document_id"))


def story_links(docs: DataFrame, keys: list[str], similar: float = SIMILAR) -> DataFrame:
    """Links (a, b) of documents of one key whose components are its stories: equal title keys, or alike texts on different hosts.

    Titles and copies of one text are stars. Different texts link if the
    Jaccard similarity of their shingles, over the whole texts, is at least
    ``similar``, unless both are found on one and the same host only. Texts
    without five words, null ones too, have no shingles; rows without an id
    are in no link.
    """
    docs = docs.where("document_id IS NOT NULL")
    rows = saved(_with_counts(docs, keys, similar))
    titled = rows.where("_t IS NOT NULL")
    same = titled.withColumn("a", F.min("document_id").over(Window.partitionBy(*keys, "_t"))).where("a <> document_id").select(*keys, "a", F.col("document_id").alias("b"))
    # Copies of one text are one on each host; a host's smallest id stands for them there.
    hosts = rows.where("_n > 0").groupBy(*keys, "_h", "_x").agg(F.min("document_id").alias("document_id"), F.first("_n").alias("_n"))
    # One text on several hosts is a star, whatever the number of hosts; only a text of one host has a site.
    site = F.when(F.min("_h") == F.max("_h"), F.min("_h"))
    texts = saved(hosts.groupBy(*keys, "_x").agg(F.min("document_id").alias("id"), site.alias("site"), F.first("_n").alias("n")))
    copies = hosts.join(texts.select(*keys, "_x", F.col("id").alias("a")), [*keys, "_x"]).where("a <> document_id").select(*keys, "a", F.col("document_id").alias("b"))
    # Only texts that share enough with others are read again, and only their sets move.
    near = texts.dropna(subset=keys).join(meetings.counts(rows).withColumnRenamed("x", "_x"), "_x")
    near = saved(near.where(F.col("c") >= meetings.least_met(F.col("n"), similar)).select(*keys, "id", "site", "n"))
    chosen = meetings.chosen(near.select(F.xxhash64("id").alias("h")))
    sets = saved(docs.where(chosen(F.xxhash64("document_id"))).select(F.col("document_id").alias("id"), T.shingle_hashes("text").alias("s")).where(F.size("s") > 0))
    return same.unionByName(copies).unionByName(links_among(near, sets, keys, similar)).distinct()


def _with_counts(docs: DataFrame, keys: list[str], similar: float) -> DataFrame:
    """(keys, document_id, title digest, host, number of shingles, hash of them), and the packed counts of ``meetings.met``."""
    title = T.title_key("title")
    d = docs.select(*keys, "document_id", F.when(title != "", F.unhex(F.md5(title))).alias("_t"), T.host("url").alias("_h"), F.xxhash64(*keys).alias("_k"), T.word_hashes("text").alias("_w"))
    kept = [*keys, "document_id", "_t", "_h"]

    def read(batch: pa.RecordBatch) -> tuple:
        k = batch.column("_k").to_numpy()
        bounds, found = T.run_hashes(batch.column("_w"))
        x = meetings.set_hashes(k, bounds, found)
        rows = pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.diff(bounds)), pa.array(x)], names=[*kept, "_n", "_x"])
        return rows, x, k, bounds, found

    kinds = dict(d.dtypes)
    carried = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "_n long", "_x long"])
    # A word has some six characters with what parts it from the next.
    words = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) / 6
    return meetings.met(d, read, carried, similar, words)


def stories(docs: DataFrame, keys: list[str], similar: float = SIMILAR) -> DataFrame:
    """(keys, document_id, story), one row for each document; story is the smallest id that links reach.

    A link lies within one key and ids name one document, so one graph serves
    all keys.
    """
    roots = connected_components(story_links(docs, keys, similar)).withColumnsRenamed({"node": "document_id", "root": "story"})
    return docs.select(*keys, "document_id").join(roots, "document_id", "left").select(*keys, "document_id", F.coalesce("story", "document_id").alias("story"))


def collapse_stories(docs: DataFrame, keys: list[str], similar: float = SIMILAR) -> DataFrame:
    """One document of each story with the number of copies, the other copies' urls and all hosts.

    The one with a text stands for its story, then that of the best score, the
    earliest date and the smallest id; a table without scores or dates has
    none. Stories are connected components of title and text links.
    """
    roots = connected_components(story_links(docs, keys, similar)).withColumnsRenamed({"node": "document_id", "root": "_story"})
    scored = {"keyword_score", "semantic_score"} <= set(docs.columns)
    dated = F.coalesce(F.col("published").cast("string"), F.lit("9999")) if "published" in docs.columns else F.lit("9999")
    order = F.struct((F.coalesce("text", F.lit("")) == "").alias("t"), (-best_score() if scored else F.lit(0.0)).alias("s"), dated.alias("d"), F.col("document_id").alias("id"))
    # What orders the documents is worked out ahead of the join, so that texts do not move for it.
    grouped = docs.select("document_id", "url", order.alias("_o")).join(roots, "document_id", "left").withColumn("_story", F.coalesce("_story", "document_id"))
    # As many urls as a story has distinct ones.
    copies = grouped.groupBy("_story").agg(F.min("_o")["id"].alias("document_id"), F.count(F.lit(1)).alias("n_copies"), F.array_sort(F.collect_set("url")).alias("_urls"), F.array_sort(F.collect_set(F.nullif(T.host("url"), F.lit("")))).alias("syndication_domains"))
    chosen = docs.join(copies.drop("_story"), "document_id")
    return chosen.withColumn("duplicate_urls", F.filter("_urls", lambda u: u != F.coalesce("url", F.lit("")))).drop("_urls")


def prepared_candidates(docs: DataFrame, keys: list[str], before: int, terms: list[str], vocabulary: list[str], cues: DataFrame | None = None) -> DataFrame:
    """Documents of the window, first of each url, one of each story, scored and aged, in this order.

    ``cues`` are those of ``reports.report_scores``; a table without a market
    is scored by the shared ones.
    """
    inside = age_window(docs, before).where("drop_reason IS NULL")
    single = first_by(inside, F.concat_ws("|", *keys, url_key("url")), F.col("document_id"))
    told = collapse_stories(single, keys)
    scored = report_scores(told if "market" in told.columns else told.withColumn("market", F.lit("*")), cues)
    return scored.withColumns({"keyword_score": T.keyword_score("title", "text", terms, vocabulary), "age": trading_days_before("published", "day")})


def price_direction(title: str | Column, text: str | Column, up: dict[str, float], down: dict[str, float]) -> Column:
    """struct(up, down, direction, confidence) from weighted word counts, the title twice.

    Weights count to a millionth and are added as whole numbers, so equal sums
    are equal whatever words they come from.
    """
    def weight(words: dict[str, float]) -> Column:
        values = F.create_map(*[F.lit(x) for k, w in words.items() for x in (k, round(w * 1_000_000))]).cast("map<string,bigint>")

        def inside(x: Column) -> Column:
            return F.aggregate(T.word_tokens(x), F.lit(0).cast("long"), lambda s, t: s + F.coalesce(F.try_element_at(values, t), F.lit(0).cast("long")))

        return 2 * inside(F.col(title) if isinstance(title, str) else title) + inside(F.col(text) if isinstance(text, str) else text)

    u, d = weight(up), weight(down)
    lean = F.when(u > d, "up").when(d > u, "down").otherwise("neutral")
    return F.struct((u / 1_000_000).alias("up"), (d / 1_000_000).alias("down"), lean.alias("direction"), F.coalesce(ratio(F.abs(u - d), u + d), F.lit(0.0)).alias("confidence"))


def usable_readings(readings: DataFrame, variants: tuple[str, ...] = (), fresh: int = FRESH) -> DataFrame:
    """Readings that count as evidence; ``move`` is the flagged day's percent move, null for a trend.

    A report on the day before is counted a session older under current_moves.
    """
    age, report = F.col("age"), F.coalesce("kind", F.lit("report")) == "report"
    ok = F.col("direction").isin("up", "down") & (F.coalesce("cause", F.lit("")) != "") & F.coalesce("quote_found", F.lit(False)) & F.coalesce(age.between(0, fresh), F.lit(False))
    if "gate_only" in variants:
        ok = ok & F.coalesce("passed_gate", F.lit(True))
    if "this_market" in variants:
        ok = ok & F.coalesce("this_market", F.lit(True))
    out = readings
    if "current_moves" in variants:
        older = report & F.coalesce(F.col("when") == "previous_day", F.lit(False)) & ~F.coalesce("seen_before_open", F.lit(False))
        ok = ok & ~(report & F.coalesce(F.col("when").isin("earlier", "forecast"), F.lit(False))) & (age + older.cast("int") <= fresh)
        out = out.withColumn("_older", older.cast("int"))
    if "size_consistent" in variants:
        ok = ok & F.coalesce(~((F.col("move_pct") > 0) & (F.col("move_pct") < 0.25 * F.abs("move")) & (F.col("move") != 0)), F.lit(True))
    if "reports_only" in variants:
        ok = ok & report
    out = out.where(ok)
    return out.withColumn("age", F.col("age") + F.col("_older")).drop("_older") if "current_moves" in variants else out


def matches_size(move: Column) -> Column:
    """A stated size of at least a quarter of the move, else a report that calls it large."""
    report = F.coalesce("kind", F.lit("report")) == "report"
    by_size = F.when(F.coalesce("move_pct", F.lit(0.0)) != 0, F.col("move_pct") >= 0.25 * F.abs(move)).otherwise(F.coalesce(F.col("move_size") == "large", F.lit(False)))
    return F.when(F.coalesce(move, F.lit(0.0)) == 0, True).otherwise(report & by_size)


def deciding_readings(days: DataFrame, readings: DataFrame, variants: tuple[str, ...] = (), rule: str = "freshest", fresh: int = FRESH) -> DataFrame:
    """Readings that decide a day: the usable ones, by ``freshest`` only the newest and most direct; along says whether one supports the move, fitting whether it may."""
    keys = ["series", "day"]
    evidence = usable_readings(readings.join(days.select(*keys, F.col("direction").alias("_way"), "move"), keys), variants, fresh)
    if rule == "freshest":
        evidence = evidence.withColumn("_g", F.struct("age", _directness().alias("k")))
        evidence = evidence.withColumn("_best", F.min("_g").over(Window.partitionBy(*keys))).where("_g = _best").drop("_g", "_best")
    fitting = F.lit(True)
    if "event_reasons" in variants:
        fitting = fitting & ~F.coalesce(F.col("cause_type") == "trading", F.lit(False))
    if "sized_support" in variants:
        fitting = fitting & matches_size(F.col("move"))
    return evidence.withColumns({"along": F.col("direction") == F.col("_way"), "fitting": fitting}).drop("_way")


def _directness() -> Column:
    return F.when(F.coalesce("kind", F.lit("report")) == "report", 0).otherwise(1)


def decide(days: DataFrame, readings: DataFrame, variants: tuple[str, ...] = (), rule: str = "freshest", fresh: int = FRESH) -> DataFrame:
    """One decision for each day (series, day, direction, move): the newest, most direct readings decide.

    EXPLAIN if at least one reading supports the move and at least as many do as oppose it.
    """
    keys = ["series", "day"]
    evidence, kind = deciding_readings(days, readings, variants, rule, fresh), _directness()
    along, fitting = F.col("along"), F.col("fitting")
    pool = evidence.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pool"), F.count_if(along).alias("with_move"), F.count_if(along & fitting).alias("supporting"), F.count_if(~along).alias("opposing"), F.min("age").alias("deciding_age"), F.min(kind).alias("_k"))
    out = days.join(pool, keys, "left").fillna(0, ["pool", "with_move", "supporting", "opposing"])
    reason = F.when(~F.coalesce(F.col("direction").isin("up", "down"), F.lit(False)), "direction_of_the_move_unknown").when(F.col("pool") == 0, "no_recent_document_gives_a_reason").when(F.col("with_move") == 0, "freshest_evidence_points_the_other_way").when(
        F.col("supporting") == 0, "no_fitting_report").when(F.col("opposing") > F.col("supporting"), "freshest_evidence_mostly_points_the_other_way")
    explained = reason.isNull()
    return out.withColumns({
        "reason": reason, "decision": F.when(explained, "EXPLAIN").otherwise("REFUSE"),
        "deciding_age": F.when(F.lit(rule == "freshest"), F.col("deciding_age")), "deciding_kind": F.when(F.lit(rule == "freshest"), F.when(F.col("_k") == 0, "report").when(F.col("_k") == 1, "pressure")),
        "confidence": F.when(explained & (F.col("supporting") >= 2) & (F.col("opposing") == 0), "high").when(explained, "medium"),
    }).drop("_k")


def guard_fires(consistent: Column, inconsistent: Column, ties: bool = False) -> Column:
    c, i = F.coalesce(consistent, F.lit(0)), F.coalesce(inconsistent, F.lit(0))
    return (i > 0) & (i >= c) if ties else i > c


def outcome_tier(runs: DataFrame) -> DataFrame:
    """Adds tier, is_refusal and is_fault by precedence: fault, outage, gate, reading, explanation.

    ``runs`` has call_state, considered, retrieval_ran, gate_decision, gate_reason, reading_made, decision,
    consistent, inconsistent, confidence, accepted, citations_resolve and citations_flagged. An explanation is
    strong if its confidence is high, no evidence conflicts, every citation resolves and none is flagged;
    without a reading it also needs two accepted documents.
    """
    refused = F.col("decision") == "INSUFFICIENT_EVIDENCE"
    quiet = F.col("gate_reason").isin("no_documents_retrieved", "all_documents_below_noise_floor")
    gated = (F.col("gate_decision") != "EXPLAIN") & ~F.col("reading_made")
    against = F.when(F.col("reading_made"), F.coalesce("inconsistent", F.lit(0)) > 0).otherwise(guard_fires(F.col("consistent"), F.col("inconsistent"), ties=True))
    strong = (F.col("confidence") == "high") & ~guard_fires(F.col("consistent"), F.col("inconsistent"), ties=True) & F.coalesce("citations_resolve", F.lit(True)) & (F.coalesce("citations_flagged", F.lit(0)) == 0) & (F.col("reading_made") | (F.col("accepted") >= 2))
    tier = (
        F.when(F.col("call_state").isin("API_ERROR", "PARSE_ERROR"), "SYSTEM_ERROR")
        .when((F.col("considered") == 0) & ~F.col("retrieval_ran"), "RETRIEVAL_FAILED")
        .when(gated & quiet, "REFUSED_NO_EVIDENCE")
        .when(gated, "REFUSED_WEAK_EVIDENCE")
        .when(refused & against, "REFUSED_CONFLICTING")
        .when(refused, "REFUSED_WEAK_EVIDENCE")
        .when(F.coalesce(strong, F.lit(False)), "EXPLAINED_STRONG")
        .otherwise("EXPLAINED_TENTATIVE")
    )
    out = runs.withColumn("tier", tier)
    return out.withColumns({"is_refusal": F.startswith("tier", F.lit("REFUSED")), "is_fault": F.col("tier").isin("SYSTEM_ERROR", "RETRIEVAL_FAILED")})


def consensus(readings: DataFrame) -> DataFrame:
    """A document's direction counts where more than half of the models report it with a found quote."""
    keys = ["date", "document_id"]
    models = readings.groupBy("date").agg(F.count_distinct("model").alias("_models"))
    votes = readings.where(F.coalesce("quote_found", F.lit(False)) & F.col("direction").isin("up", "down")).groupBy(*keys, "direction").agg(F.count_distinct("model").alias("votes"), F.min("model").alias("first_model"))
    return votes.join(models, "date").where(F.col("votes") * 2 > F.col("_models")).drop("_models")


def packed(docs: DataFrame, keys: list[str], budget: int, steps: tuple[int, ...] = (1500, 1100, 800, 600, 400, 300), least: int = 3) -> DataFrame:
    """Excerpts that fit a token budget: the longest step that holds all, else as many documents from the front as fit the shortest, at least ``least``.

    ``docs`` has place (reading order) and text.
    """
    rows = docs.select(*keys, "document_id", "place", "text", F.explode(F.array(*map(F.lit, steps))).alias("chars"))
    cost = T.token_estimate(F.substring("text", F.lit(1), F.col("chars")))
    rows = rows.withColumn("_cost", cost).withColumn("_sum", F.sum("_cost").over(Window.partitionBy(*keys, "chars").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    totals = rows.groupBy(*keys, "chars").agg(F.sum("_cost").alias("_total"))
    fitting = totals.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_total") <= budget, F.col("chars"))), F.lit(steps[-1])).alias("_step"))
    kept = rows.join(fitting, keys).where((F.col("chars") == F.col("_step")) & ((F.col("_sum") <= budget) | (F.col("place") <= least)))
    return kept.select(*keys, "document_id", "place", F.substring("text", F.lit(1), F.col("chars")).alias("excerpt"), "chars")


def quoted(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id) of documents that hold a quote (item_id, quote) by ``quote_squashed``.

    A quote's words but the first and last stand whole in such a text. Those
    that have three meet the texts by their rarest run of three words, by hash;
    shorter quotes, a stated few, are looked for in every text.
    """
    even = lambda x: F.trim(F.regexp_replace(F.lower(T.given(x)), r"\s+", " "))
    q = quotes.select("item_id", "quote", F.split(even("quote"), " ").alias("_w")).withColumn("_inner", F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0))))

    def runs(words: str) -> Column:
        return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.element_at(words, i + 2), F.element_at(words, i + 3)))

    texts = docs.select("doc_id", "text", F.split(even("text"), " ").alias("_w"))
    anchors = q.where(F.size("_inner") >= 3).select("item_id", F.explode(F.array_distinct(runs("_inner"))).alias("_g"))
    wanted = anchors.select("_g").distinct()
    grams = texts.select("doc_id", F.explode(F.array_distinct(runs("_w"))).alias("_g"))
    often = grams.join(wanted, "_g").groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    chosen = anchors.join(often, "_g").groupBy("item_id").agg(F.min(F.struct("_f", "_g")).alias("_a"))
    # A run of the quote that no text holds leaves the quote without a document.
    held = anchors.join(often, "_g", "left").groupBy("item_id").agg(F.bool_and(F.col("_f").isNotNull()).alias("_all")).where("_all").select("item_id")
    chosen = chosen.join(held, "item_id").select("item_id", F.col("_a._g").alias("_g"))
    met = grams.join(chosen, "_g").select("doc_id", "item_id")
    pairs = met.join(docs.select("doc_id", "text"), "doc_id").join(quotes.select("item_id", "quote"), "item_id")
    short = q.where(F.size("_inner") < 3).select("item_id", "quote")
    found = pairs.where(T.quote_squashed("quote", "text")).select("doc_id", "item_id", "quote", "text")
    few = docs.select("doc_id", "text").join(short, T.quote_squashed("quote", "text")).select("doc_id", "item_id", "quote", "text")
    return found.unionByName(few)


def stance(document_direction: Column, move_direction: Column) -> Column:
    """consistent, inconsistent or neutral; a document without a direction never contradicts."""
    known = move_direction.isNotNull() & (document_direction != "neutral")
    return F.when(F.coalesce(known, F.lit(False)), F.when(document_direction == move_direction, "consistent").otherwise("inconsistent")).otherwise("neutral")


def explanation_text(days: DataFrame, sources: DataFrame) -> DataFrame:
    """One line for each supporting source in reading order, then one for each opposing source."""
    ordered = F.array_sort(F.collect_list(F.struct((~F.col("supports")).alias("o"), F.col("place"), F.col("line"))))
    lines = sources.withColumn("line", F.concat(F.when(F.col("supports"), F.lit("")).otherwise(F.lit("Against: ")), F.col("title"), F.lit(" (source: "), F.col("document_id").cast("string"), F.lit(")")))
    text = lines.groupBy("series", "day").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("explanation"))
    return days.join(text, ["series", "day"], "left")


def request_plan(days: DataFrame, queries: DataFrame, before: int = 7, recent: int = 2) -> DataFrame:
    """Full-window, recent and day-only requests of each day and query, from a start to before an end."""
    spans = F.array(F.struct(F.lit("full").alias("span"), F.lit(before).alias("d")), F.struct(F.lit("recent").alias("span"), F.lit(recent).alias("d")), F.struct(F.lit("day").alias("span"), F.lit(0).alias("d")))
    plan = days.join(F.broadcast(queries), "series").withColumn("_s", F.explode(spans))
    return plan.select("series", "day", "query", F.col("_s.span").alias("span"), F.expr("date_sub(day, _s.d)").alias("start"), F.date_add("day", 1).alias("end"))


def with_fallback(levels: DataFrame, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(levels, provenance): for each name the rows of its first source by priority, whole names at a time; a needed name without rows is an error."""
    chosen = levels.where("value IS NOT NULL").groupBy("name").agg(F.min(F.struct("priority", "source")).alias("_s")).select("name", "_s.priority", "_s.source")
    if absent := set(needed) - {r["name"] for r in chosen.where(F.col("name").isin(*needed)).select("name").collect()}:
        raise ValueError(f"no source for {sorted(absent)}")
    return levels.join(chosen, ["name", "priority", "source"]).select("date", "name", "value"), chosen.withColumn("substitute", F.col("priority") > 0)


def posture(title: str, supply: list[str], demand: list[str], event: list[str]) -> Column:
    """supply, demand, event or other, by which list shares most words with the title; earlier lists win ties."""
    tokens = T.ascii_tokens(title)
    s, d, e = (F.size(F.array_intersect(tokens, F.array(*map(F.lit, words)))) for words in (supply, demand, event))
    return F.when((s == 0) & (d == 0) & (e == 0), "other").when((s >= d) & (s >= e), "supply").when(d >= e, "demand").otherwise("event")


def focus_text(text: str | Column, subject: list[str], limit: int = 1200) -> Column:
    """The opening sentence and the sentences on the subject, most telling first, up to a length."""
    sentences = F.filter(F.split(T.given(text), r"(?<=[.!?])\s+"), lambda s: s != "")

    def telling(s: Column) -> Column:
        words = T.ascii_tokens(s)
        return F.size(F.array_intersect(words, F.array(*map(F.lit, subject)))) * 2 + s.rlike(r"\d").cast("int")

    scored = F.transform(sentences, lambda s, i: F.struct(F.when(i == 0, -1000).otherwise(-telling(s)).alias("w"), i.alias("i"), s.alias("s")))
    chosen = F.array_sort(F.filter(scored, lambda x: x["w"] < -1))
    return F.substring(F.array_join(F.transform(chosen, lambda x: x["s"]), " "), 1, limit)


def normalised_readings(shown: DataFrame, answers: DataFrame) -> DataFrame:
    """One checked reading for every shown document; the first answer of an id wins, unread documents stay.

    ``answers`` has series, day, position and the raw fields of each answer.
    """
    w = Window.partitionBy("series", "day", "_id").orderBy("position")
    first = answers.withColumn("_id", T.citation_id("raw_id")).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    fields = first.select("series", "day", F.col("_id").alias("document_id"), T.clean_choice("raw_direction", ["up", "down", "unclear"], "unclear").alias("direction"), T.clean_choice("raw_kind", ["report", "pressure"], "report").alias("kind"),
        F.nullif(F.trim(T.given("raw_cause")), F.lit("")).alias("cause"), T.clean_percent("raw_move").alias("move_pct"), "raw_quote", F.lit(True).alias("read"))
    out = shown.join(fields, ["series", "day", "document_id"], "left").withColumn("quote_found", F.coalesce(T.quote_in_text("raw_quote", "text"), F.lit(False)))
    return out.withColumn("read", F.coalesce("read", F.lit(False))).drop("raw_quote", "text")
