"""Quality rules with host verdicts.

Every document is measured by expressions over its own text. Failures are
summed by host, the rate of each host is shrunk towards the corpus by a beta
prior whose two parameters come from the hosts' own mean and spread, and the
verdict of a host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shocklens.llm.common import BLANKS, saved

MIN_WORDS = 50
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Rejected hosts that are broadcast at most, and the shares of a host beyond that.
MAX_BROADCAST_HOSTS = 200_000
SALTS = 64
# Fixed value of the rule: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _array_sum(array: str) -> str:
    return f"aggregate({array}, 0L, (s, x) -> s + x)"


def with_metrics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text: Column = F.coalesce(F.col("text").cast("string"), F.lit(""))
    started = docs.withColumn("_text", text)
    started = started.withColumn("_words", F.filter(F.split("_text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    started = started.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.rtrim(F.translate(x, BLANKS, " ")) != ""))
    # A first look by hash: equal windows have equal hashes, so texts without equal hashes are done.
    started = started.withColumn("_n", F.size("_words").cast("long")).withColumn("_hashes", F.expr(
        "CASE WHEN _n < 4 THEN array() ELSE transform(slice(_words, 1, size(_words) - 2), (w, i) -> xxhash64(w, _words[i + 1], _words[i + 2])) END"))
    # Windows with their place, in order: a window repeats if a neighbour in this order equals it.
    started = started.withColumn("_sorted", F.expr(
        "CASE WHEN size(array_distinct(_hashes)) < size(_hashes) THEN array_sort(transform(_hashes, (h, i) -> struct(h AS h, concat_ws(' ', _words[i], _words[i + 1], _words[i + 2]) AS w, i AS i))) END"))
    started = started.withColumn("_places", F.expr(
        "sort_array(transform(filter(transform(_sorted, (x, k) -> struct(x.i AS i, (k > 0 AND x.w = _sorted[greatest(k - 1, 0)].w) OR (k < size(_sorted) - 1 AND x.w = _sorted[least(k + 1, size(_sorted) - 1)].w) AS again)), x -> x.again), x -> x.i))"))
    covered = "transform(_places, (p, k) -> CASE WHEN k = size(_places) - 1 THEN 3L ELSE least(3, _places[least(k + 1, size(_places) - 1)] - p) END)"
    lengths, none = F.length("_text"), F.lit(0).cast("long")
    measures = {
        "n_words": F.col("_n"),
        "word_chars": F.length(F.translate("_text", BLANKS, "")).cast("long"),
        "n_symbols": (lengths - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(F.expr(_array_sum(covered)), none),
    }
    # The condition always holds. As it is not deterministic, the measures are worked out in this
    # step: a filter on one of them stays above it and is not rewritten as one expression over the
    # text, in which every step would be repeated for every word.
    started = started.withColumn("_m", F.when(F.spark_partition_id() >= 0, F.struct(*[c.alias(k) for k, c in measures.items()])))
    measured = started.select(*docs.columns, "_m.*")
    return measured.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """(host, n_docs, n_failed, host_rate): failure rates shrunk by an empirical beta prior.

    The prior has the hosts' pooled mean m and, by the method of moments, the
    strength m (1 - m) / s2 - 1, with s2 the part of the spread of their rates
    that sampling leaves over; without such a part the hosts are taken as equal
    and every rate is the mean.
    """
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    # One row of sums over the hosts.
    total = hosts.agg(F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.expr("n_failed * (n_failed / n_docs)")).alias("sq"))
    prior = total.selectExpr("f / n AS m", "n", "k", "greatest(sq / n - (f / n) * (f / n), 0D) AS seen")
    prior = prior.selectExpr("m", "seen - m * (1 - m) * k / n AS s2").selectExpr("m", "CASE WHEN s2 > 0 THEN greatest(m * (1 - m) / s2 - 1, 0D) END AS strength")
    shrunk = "CASE WHEN strength IS NULL THEN m ELSE (n_failed + m * strength) / (n_docs + strength) END"
    return hosts.crossJoin(F.broadcast(prior)).selectExpr("host", "n_docs", "n_failed", f"{shrunk} AS host_rate")


def judge_quality(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE, max_broadcast: int = MAX_BROADCAST_HOSTS) -> DataFrame:
    """Metrics, base_failed, host_rate and kept for every row of ``docs`` (doc_id, text, ``host``).

    Null texts have no words and fail. Documents without a host form one host
    of their own. Repeated rows count as often as they occur. Other columns are
    ignored; an empty table gives an empty one.
    """
    measured = saved(with_metrics(docs.select("doc_id", "text", F.col(host).alias("host"))).drop("text"))
    rates = saved(host_rates(measured, "host").select(F.col("host").alias("_host"), "host_rate"))
    joined = _by_host(measured.withColumn("_spread", F.xxhash64("doc_id", "word_chars")), rates, "inner", max_broadcast).drop("_host", "_spread")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate))


def _by_host(rows: DataFrame, hosts: DataFrame, how: str, max_broadcast: int) -> DataFrame:
    """``rows`` (host, _spread) joined to ``hosts`` (_host): by broadcast up to ``max_broadcast`` hosts, else by host and salt."""
    same = F.col("host").eqNullSafe(F.col("_host"))
    if hosts.count() <= max_broadcast:
        return rows.join(F.broadcast(hosts), same, how)
    salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_part", F.pmod("_spread", F.lit(SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("_part") == F.col("_salt")), how).drop("_part", "_salt")


def keep_good(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE, max_broadcast: int = MAX_BROADCAST_HOSTS) -> DataFrame:
    """The rows of ``docs`` that pass the rules and whose host is not rejected.

    Every text is measured once; what passes waits in the shared folder for the
    hosts' verdicts. Texts do not move: the rejected hosts are broadcast, up to
    ``max_broadcast`` of them. More are joined by host and salt, so that one
    host's documents spread over many tasks. Null texts fail; documents without
    a host are one host; repeated rows stay as often as they are given.
    """
    measured = with_metrics(docs.select(F.struct("*").alias("_row"), F.col("text"), F.col(host).alias("host")))
    measured = saved(measured.select(F.when(~F.col("base_failed"), F.col("_row")).alias("_row"), "host", "base_failed", F.xxhash64("text").alias("_spread")))
    rejected = saved(host_rates(measured, "host").where(F.col("host_rate") > max_host_rate).select(F.col("host").alias("_host")))
    return _by_host(measured.where(~F.col("base_failed")), rejected, "left_anti", max_broadcast).select("_row.*")
