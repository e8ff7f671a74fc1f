"""The operators over their whole tables, and the same results in DuckDB SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shocklens.llm import decontaminate, license_scan, line_dedup, quality_rank, quality_rules, resampling, sentencepiece_codec, sharding, simhash, spelling, token_count, url_filter, vector_dedup

# The rules of the URL filter's query.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
SHARD_BYTES = 8 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = quality_rules.judge_quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and a digest of those that stay."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op7_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned quality of every document."""
    return quality_rank.rank_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that documents hold."""
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark passages cover."""
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), model)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document for the benchmark's texts, and the drawn tenth."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words with their near words, forms and roots."""
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_url_filter, op2_simhash, op3_token_counts, op4_sharding, op5_quality_rules, op6_line_dedup, op7_quality_rank,
        op8_license_scan, op9_decontamination, op10_sentencepiece, op11_resampling, op12_spelling, op13_vector_dedup,
    ]
    return {f.__name__: f for f in found}


_URL_SQL = r"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(rule, h, p, v) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block'))
SELECT page_id, host, path,
  (SELECT max_by(rule, length(rule)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT max_by(v, length(rule)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM cut
"""

_SHARD_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS h FROM documents),
b AS (SELECT doc_id, n_bytes, lpad(bin(CAST('0x' || h[1:15] AS BIGINT)), 60, '0') AS bits FROM d),
t AS (
  SELECT '' AS shard, 0 AS depth, (SELECT coalesce(sum(n_bytes), 0) FROM b) AS size
  UNION ALL
  SELECT shard || x.bit, depth + 1, (SELECT coalesce(sum(n_bytes), 0) FROM b WHERE starts_with(bits, shard || x.bit))
  FROM t, (VALUES ('0'), ('1')) AS x(bit) WHERE size > {SHARD_BYTES} AND depth < 60)
SELECT doc_id, n_bytes, shard, depth, CAST(size AS BIGINT) AS shard_bytes, size > {SHARD_BYTES} AS oversized
FROM b JOIN t ON starts_with(bits, shard) AND (size <= {SHARD_BYTES} OR depth = 60)
"""

_BASE_SQL = r"""
w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram, i FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(3) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""

_QUALITY_SQL = f"""
WITH {_BASE_SQL},
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM f GROUP BY source),
pool AS (SELECT sum(bad) / sum(n) AS m, sum(n) AS n, count(*) AS k, sum(bad * (bad / n)) AS sq FROM hosts),
spread AS (SELECT m, greatest(sq / n - m * m, 0) - m * (1 - m) * k / n AS s2 FROM pool),
prior AS (SELECT m, CASE WHEN s2 > 0 THEN greatest(m * (1 - m) / s2 - 1, 0) END AS strength FROM spread),
rates AS (SELECT source, CASE WHEN strength IS NULL THEN m ELSE (bad + m * strength) / (n + strength) END AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= {quality_rules.MAX_HOST_RATE} AS kept
FROM f JOIN rates ON f.source IS NOT DISTINCT FROM rates.source
"""

_LINE_SQL = r"""
WITH l AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT doc_id, i, line, coalesce(doc_id <> first_doc, false) AS gone FROM k LEFT JOIN firsts USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_LICENSE_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.LICENSES.items())
_LICENSE_SQL = rf"""
WITH t(license, text) AS (VALUES {_LICENSE_ROWS}),
tw AS (SELECT license, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
tn AS (SELECT license, count(*) AS n, greatest(2, CAST(pow(2, ceil(log2(max(len(w)) - 4))) AS BIGINT)) AS block FROM ts JOIN tw USING (license) GROUP BY license),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dsh AS (SELECT doc_id, len(w) - 4 AS n_sh, i - 1 AS place, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
met AS (SELECT doc_id, license, n, block, n_sh, place, s FROM dsh JOIN ts USING (s) JOIN tn USING (license)),
win AS (SELECT doc_id, license, n, s, block * (place // block - x.back) AS first_word, n_sh, block FROM met, (VALUES (0), (1)) AS x(back)),
ok AS (SELECT doc_id, license, first_word, n, count(DISTINCT s) AS shared FROM win
  WHERE first_word >= 0 AND (first_word + block < n_sh OR n_sh <= block) GROUP BY doc_id, license, first_word, n HAVING count(DISTINCT s) >= {license_scan.CONTAINMENT} * n)
SELECT doc_id, license, first_word, shared, shared / n AS containment FROM ok
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY shared DESC, first_word) = 1
"""

_BENCHMARK_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ww AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ds AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM ww) WHERE len(w) >= n)),
o AS (SELECT DISTINCT doc_id, item_id, i, n FROM ds JOIN ww USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM o, range(13) AS r(k) WHERE k < n GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""


# crc32(text) as a table macro cannot be registered here, so the CRC is worked out by folding the bytes of a text over a table that its rule builds.
_CRC_TABLE = "crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS steps FROM range(256) AS r(b))"


def _crc_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of a text column's UTF-8 bytes, beside a column ``steps``."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || hex(encode({text}))[2 * i + 1 : 2 * i + 2] AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_RESAMPLING_SQL = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
vocabulary AS (SELECT word, {_crc_sql('word')} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_table),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN vocabulary USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s_all, (SELECT count(*) FROM bw)::DOUBLE AS t_all),
gains AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket), n),
weights AS (SELECT doc_id, floor(sum(gain) / count(*)) AS weight FROM dw JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor(10 * n / 100) THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""

_SPELLING_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+'))")} AS run FROM documents),
hashed AS (SELECT run, count(*) AS n, {_crc_sql("(doc_id || ':' || run)")} AS h FROM runs, crc_table WHERE length(run) >= 6 GROUP BY doc_id, run, steps),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
gaps AS (SELECT word, n, i, word[: i] || chr(0) || word[i + 2 :] AS gap, word[: i] || word[i + 2 :] AS shorter FROM places),
pairs AS (
  SELECT a.word AS word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.shorter = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.shorter = b.word),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM pairs GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words LEFT JOIN near USING (word)),
chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON chain.root = formed.word WHERE formed.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN (SELECT chain.word, chain.root FROM chain JOIN formed ON chain.root = formed.word WHERE formed.form IS NULL) USING (word)
"""

_VECTOR_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= {vector_dedup.COSINE}),
reached AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT reached.vec_id, links.b FROM reached JOIN links ON reached.other = links.a),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a),
least AS (SELECT vec_id, min(other) AS other FROM reached GROUP BY vec_id)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id, vec_id <= coalesce(other, vec_id) AS kept
FROM v LEFT JOIN counted USING (vec_id) LEFT JOIN least USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": _URL_SQL, "op4_sharding": _SHARD_SQL, "op5_quality_rules": _QUALITY_SQL,
        "op6_line_dedup": _LINE_SQL, "op8_license_scan": _LICENSE_SQL, "op9_decontamination": _BENCHMARK_SQL,
        "op11_resampling": _RESAMPLING_SQL, "op12_spelling": _SPELLING_SQL, "op13_vector_dedup": _VECTOR_SQL,
    }
