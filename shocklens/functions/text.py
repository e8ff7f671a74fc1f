"""Text: tokens, keys, ids, shingles, quote checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from shocklens.functions.numbers import col, let, ratio

SHINGLE_WORDS = 5


def given(text: str | Column) -> Column:
    return F.coalesce(col(text), F.lit(""))


def ascii_tokens(text: str | Column) -> Column:
    """Distinct runs of ASCII letters, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(given(text)), F.lit("([a-z]+)"), 1))


def word_tokens(text: str | Column) -> Column:
    """Letters and digits of any script, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(given(text)), F.lit(r"([\p{L}\p{N}]+)"), 1)


def content_tokens(text: str | Column, stop: list[str]) -> Column:
    """Distinct words of Latin letters longer than two characters, without stop words."""
    found = F.regexp_extract_all(F.lower(given(text)), F.lit(r"([a-zß-öø-ÿ]+)"), 1)
    return F.array_except(F.filter(found, lambda t: F.length(t) > 2), F.array(*map(F.lit, stop)))


def _hit_share(terms: list[str], tokens: Column) -> Column:
    """Share of terms whose words are all among the tokens; repeats count."""
    hits = [F.forall(F.array(*map(F.lit, t.split())), lambda w: F.array_contains(tokens, w)).cast("int") for t in terms]
    return sum(hits[1:], hits[0]) / F.lit(float(len(terms)))


def keyword_score(title: str | Column, text: str | Column, terms: list[str], vocabulary: list[str]) -> Column:
    """Shares of query terms and vocabulary found, the title counted twice, over 6, four decimals."""
    if not terms:
        return F.lit(0.0)
    both = [let(ascii_tokens(x), lambda t: F.array(_hit_share(terms, t), _hit_share(vocabulary, t))) for x in (title, text)]
    head, body = both
    raw = 2 * head[0] + body[0] + 2 * head[1] + body[1]
    return F.round(F.least(raw / 6, F.lit(1.0)), 4)


def title_key(title: str | Column, least_words: int = 3) -> Column:
    """Words of a headline without its publisher; empty if too short to name a story."""
    dash = r"\s+[-|–—]\s+"
    single = F.regexp_replace(F.trim(given(title)), rf"(?i)(?:{dash}([^-|–—]+?))(?:{dash}\1)+$", " - $1")
    bare = F.regexp_replace(single, rf"{dash}[^-|–—]+$", "")
    words = word_tokens(bare)
    return F.when(F.size(words) >= least_words, F.array_join(words, " ")).otherwise("")


def host(url: str | Column) -> Column:
    """Lower-case host without www., empty if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(given(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", ""), F.lit(""))


def document_id(url: str | Column) -> Column:
    return F.substring(F.sha2(col(url), 256), 1, 16)


def request_key(params: str | Column) -> Column:
    """Digest of a map in key order, 32 hex digits."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(col(params))))
    return F.substring(F.sha2(F.to_json(ordered), 256), 1, 32)


def citation_id(raw: str | Column) -> Column:
    return F.regexp_replace(F.trim(given(raw)), "(?i)^doc_", "")


def inline_sources(text: str | Column) -> Column:
    """Ids cited inside a text as ``source: doc_x``."""
    return F.array_distinct(F.regexp_extract_all(given(text), F.lit(r"(?i)source:\s*(?:doc_)?([A-Za-z0-9]+)"), 1))


def numbers(text: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(given(text), ",", "."), F.lit(r"(\d+(?:\.\d+)?)"), 1))


def lexical_support(claim: str | Column, text: str | Column) -> Column:
    """Share of the claim's words that the text has; 0 without words."""
    own = F.array_distinct(word_tokens(claim))
    return F.coalesce(ratio(F.size(F.array_intersect(own, word_tokens(text))), F.size(own)), F.lit(0.0))


def word_runs(words: Column, width: int) -> Column:
    """All runs of ``width`` words, in order; ``words`` must be cheap to name again."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(0))), lambda w, i: F.array_join(F.slice(words, i + 1, F.lit(width)), " "))


def shingles(text: str | Column, width: int = SHINGLE_WORDS, chars: int | None = None) -> Column:
    """Distinct word runs of the text, or of its first ``chars`` characters; empty if it has too few words."""
    whole = given(text)
    words = word_tokens(F.substring(whole, 1, chars) if chars else whole)
    return F.array_distinct(let(words, lambda w: word_runs(w, width)))


def run_hashes(hashed: pa.Array, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of all runs of ``width`` words, ascending in each row, and the rows' bounds; ``hashed`` has a list of word hashes a row."""
    if len(hashed) > 1 and len(hashed.flatten()) > 1 << 18:
        (first, found), (second, others) = (run_hashes(half, width) for half in (hashed[: len(hashed) // 2], hashed[len(hashed) // 2 :]))
        return np.r_[first, first[-1] + second[1:]], np.concatenate([found, others])
    size = pc.fill_null(pc.list_value_length(hashed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = hashed.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    mixed = np.zeros(len(flat), np.uint64)
    for k in range(min(width, len(flat))):
        # Powers of an odd number, so that the order of the words counts.
        mixed[: len(flat) - k] += flat[k:] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64))
    mixed = mixed[np.arange(len(flat)) + width <= np.repeat(np.cumsum(size), size)]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    found = (mixed ^ (mixed >> np.uint64(33))).view(np.int64)
    runs = np.maximum(size - width + 1, 0)
    ends = np.cumsum(runs)
    new = np.ones(len(found), bool)
    for start, end in zip((ends - runs).tolist(), ends.tolist(), strict=True):
        found[start:end].sort()
    new[1:] = found[1:] != found[:-1]
    new[(ends - runs)[runs > 0]] = True
    return np.r_[0, np.cumsum(new)][np.r_[0, ends]], found[new]


def word_hashes(text: str | Column) -> Column:
    """A hash of each word, in order."""
    return F.transform(word_tokens(given(text)), lambda w: F.xxhash64(w))


def shingle_hashes(text: str | Column, width: int = SHINGLE_WORDS, chars: int | None = None) -> Column:
    """``shingles`` as distinct 64-bit hashes, ascending; each word is hashed once, runs of them batch by batch."""
    @F.arrow_udf("array<long>")
    def runs(hashed: pa.Array) -> pa.Array:
        bounds, found = run_hashes(hashed, width)
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found))

    return runs(word_hashes(F.substring(given(text), 1, chars) if chars else text))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """0 where either is empty."""
    def share(x: Column, y: Column) -> Column:
        return F.coalesce(ratio(F.size(F.array_intersect(x, y)), F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_union(x, y)))), F.lit(0.0))

    return let(col(a), lambda x: let(col(b), lambda y: share(x, y)))


def quote_in_text(quote: str | Column, text: str | Column, share: float = 0.8) -> Column:
    """Is the quote there but for punctuation, case and spacing, or enough of its three-word runs?"""
    def check(q: Column, t: Column) -> Column:
        joined = F.array_join(q, "")
        allowed = (F.size(t) > 0) & ((F.size(q) >= 3) | (F.length(joined) >= 12))
        found = let(word_runs(t, 3), lambda have: F.size(F.filter(word_runs(q, 3), lambda g: F.array_contains(have, g))))
        return allowed & (F.contains(F.array_join(t, ""), joined) | ((F.size(q) >= 3) & (found >= share * (F.size(q) - 2))))

    return let(word_tokens(quote), lambda q: let(word_tokens(text), lambda t: check(q, t)))


def quote_squashed(quote: str | Column, text: str | Column, least: int = 15) -> Column:
    """Plain containment with white space and case evened out, for quotes that are long enough."""
    q, t = (F.trim(F.regexp_replace(F.lower(given(x)), r"\s+", " ")) for x in (quote, text))
    return (F.length(q) >= least) & F.contains(t, q)


def is_ascii(text: str | Column) -> Column:
    return given(text).rlike(r"^[\x00-\x7F]*$")


def token_estimate(text: str | Column) -> Column:
    """Rough tokens: Latin characters over 3.2, every other one, and one more."""
    whole = given(text)
    others = F.length(F.regexp_replace(whole, r"[\u0000-ɏ]", ""))
    return (F.floor((F.length(whole) - others) / F.lit(3.2)) + others + 1).cast("int")


def query_text(query: str | Column) -> Column:
    """What stands for a query before it is embedded."""
    return F.concat(F.lit("query: "), F.trim(given(query)))


def passage_text(title: str | Column, text: str | Column, chars: int | None = None) -> Column:
    """What stands for a document before it is embedded: title and text, either alone where the other is empty; with ``chars`` the text's opening."""
    body = F.trim(given(text))
    body = F.substring(body, 1, chars) if chars else body
    return F.concat(F.lit("passage: "), F.concat_ws(". ", F.nullif(F.trim(given(title)), F.lit("")), F.nullif(body, F.lit(""))))


def clean_choice(value: str | Column, allowed: list[str], default: str | None) -> Column:
    plain = F.lower(F.trim(given(value)))
    return F.when(plain.isin(*allowed), plain).otherwise(F.lit(default))


def clean_flag(value: str | Column) -> Column:
    plain = F.lower(F.trim(given(value)))
    return F.when(plain.isin("true", "yes", "1"), True).when(plain.isin("false", "no", "0"), False)


def clean_percent(value: str | Column) -> Column:
    """A number above 0 and below 100 out of a text, its sign dropped."""
    number = F.abs(F.regexp_replace(F.trim(given(value)), "%$", "").try_cast("double"))
    return F.when((number > 0) & (number < 100), number)


def signed_percent(x: str | Column) -> Column:
    return F.when(col(x).isNotNull(), F.format_string("%+.1f%%", col(x)))


def provider(model: str | Column, known: dict[str, str]) -> Column:
    """Provider of a model name: the listed one, else the first listed name part it contains, else other."""
    plain = F.lower(given(model))
    out = F.lit("other")
    for part, name in reversed(known.items()):
        out = F.when(F.contains(plain, F.lit(part)), name).otherwise(out)
    return F.coalesce(*[F.when(plain == part, name) for part, name in known.items()], out)
