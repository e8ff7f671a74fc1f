"""How much a headline looks like a report on a market: cues are a relation of market, kind, language and form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shocklens.functions import text as T

KINDS = ("name", "price", "exchange", "report", "move", "retail")
FORMS = ("word", "stem", "part")
#: Words of a cue at most.
LONGEST = 3
#: A figure in percent or points.
SHARE = r"[0-9]\s*(%|percent|pts?([^a-z]|$)|points?([^a-z]|$)|por cento|pontos)"

# Cues of market reports, by what they say and language. A word or phrase stands whole, a stem begins a
# word, a part may stand anywhere, for scripts that do not part words.
_LISTS = [
    ("coffee", "name", "*", "word", "coffee, café, kaffee, caffè, cà phê, kopi, kahve, arabica, arábica, robusta, conilon"),
    ("coffee", "name", "*", "part", "кофе, 咖啡, コーヒー, قهوة, 커피"),
    ("wheat", "name", "*", "word", "wheat, grain, grains, trigo, blé, weizen, buğday"),
    ("wheat", "name", "*", "part", "пшениц, 小麦, قمح, 밀"),
    ("gold", "name", "*", "word", "gold, bullion, ouro, oro, altın, emas, vàng"),
    ("gold", "name", "*", "part", "золот, 黄金, ذهب, 금값"),
    ("coffee", "exchange", "*", "word", "arabica, arábica, robusta, conilon"),
    ("wheat", "exchange", "*", "word", "cbot, chicago, bushel, bushels, euronext"),
    ("gold", "exchange", "*", "word", "comex, bullion, ounce, ounces, spot gold, onza"),
    ("*", "exchange", "en", "word", "future, futures, softs, settle, settles, settled, ice, contract, contracts, new york"),
    ("*", "exchange", "*", "word", "bolsa, futuros, nova york, nueva york, londres, cotação, prix à terme, vadeli, borsa"),
    ("*", "exchange", "*", "part", "期货, 先物, фьючерс, بورصة, العقود الآجلة, 선물"),
    ("*", "price", "*", "word", "price, prices, market, markets, preço, preços, precio, precios, mercado, prix, cours, preise, prezzi, giá, harga"),
    ("*", "price", "*", "part", "цен, 价格, 相場, أسعار, سعر, 가격, 시세"),
    ("*", "report", "en", "stem", "jump, surg, soar, climb, spik, plung, plummet, tumbl, slump, sink, slip, retreat"),
    ("*", "report", "en", "word", "rally, rallies, slide, slides, settle, settles, settled, drop, drops, fall, falls, fell, rise, rises, rose"),
    ("*", "report", "pt", "word", "sobe, dispara, cai, recua, recuam, despenca, fecha"),
    ("*", "report", "*", "word", "sube, cae, baja, cierra, grimpe, chute, steigt, fällt, sinkt, tăng mạnh, giảm mạnh, yükseldi, düştü"),
    ("*", "report", "*", "part", "вырос, упал, 上涨, 下跌, 急騰, 急落, ارتفع, ترتفع, انخفض, تنخفض, 급등, 급락"),
    ("*", "move", "en", "word", "higher, lower, high, low, record, up, down, gains, rising, falling"),
    ("*", "move", "*", "word", "alta, baixa, queda, alza, caída, tăng, giảm, hausse, baisse"),
    ("*", "move", "*", "part", "рост, паден, 新高, 新低, ارتفاع, انخفاض"),
    ("*", "retail", "*", "word", "supermarket, supermarkets, retail, consumer, consumers, shop, shops, store, cup, inflation, menu, supermercado, varejo, inflação"),
]
#: (market, kind, language, form, cue); market ``*`` holds for all.
CUES = [(m, k, lang, f, cue) for m, k, lang, f, cues in _LISTS for cue in cues.split(", ")]


def cue_table(spark: SparkSession, cues: list[tuple[str, str, str, str, str]] | None = None) -> DataFrame:
    """The cues of this module, or others, as a table (market, kind, language, form, cue)."""
    return spark.createDataFrame(CUES if cues is None else cues, "market string, kind string, language string, form string, cue string")


def _by_market(cues: DataFrame) -> DataFrame:
    """(market, one array of cues for each kind and form), with the shared cues in every market's row; ``*`` has them alone."""
    given = cues.where(F.col("kind").isin(*KINDS) & F.col("form").isin(*FORMS) & (T.given("cue") != "")).withColumn("cue", F.lower("cue"))
    markets = given.select("market").distinct().unionByName(given.sparkSession.createDataFrame([("*",)], "market string")).distinct()
    held = markets.join(given.withColumnRenamed("market", "_of"), F.col("_of").isin("*") | (F.col("_of") == F.col("market")))
    arrays = [F.collect_set(F.when((F.col("kind") == k) & (F.col("form") == f), F.col("cue"))).alias(f"_{k}_{f}") for k in KINDS for f in FORMS]
    return held.groupBy(F.col("market").alias("_market")).agg(*arrays)


def report_scores(docs: DataFrame, cues: DataFrame | None = None, title: str = "title", market: str = "market") -> DataFrame:
    """``docs`` with report_score, 0 to 7: how much a headline looks like a report on its market.

    One point each for naming the market's good, a price and a figure in
    percent or points; two for a word of the exchange; two for a report's verb
    of movement, of which no direction counts more than the other, or one for
    a weaker word of movement. News of shop prices without a word of the
    exchange stays below a report. Markets that no cue names are scored by the
    shared cues (market ``*``); null titles have no cues. All cues of all
    markets are matched in one pass: they are a stated list, and a market's
    lists are one row, sent to every task.
    """
    lists = _by_market(cue_table(docs.sparkSession) if cues is None else cues)
    known = [r["_market"] for r in lists.select("_market").collect()]  # a row a market
    place = F.when(F.col(market).isin(*known), F.col(market)).otherwise("*")
    words = docs.withColumns({"_t": F.lower(T.given(title)), "_w": T.word_tokens(title)})
    runs = F.flatten(F.array(*[T.word_runs(F.col("_w"), n) for n in range(1, LONGEST + 1)]))
    starts = F.flatten(F.transform("_w", lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda n: F.substring(w, F.lit(1), n))))
    words = words.withColumns({"_runs": F.array_distinct(runs), "_starts": F.array_distinct(starts), "_place": place})
    met = words.join(F.broadcast(lists), F.col("_place") == F.col("_market"))

    def has(kind: str) -> Column:
        return F.arrays_overlap("_runs", f"_{kind}_word") | F.arrays_overlap("_starts", f"_{kind}_stem") | F.exists(f"_{kind}_part", lambda c: F.contains("_t", c))

    met = met.withColumns({f"_{k}": F.coalesce(has(k), F.lit(False)) for k in KINDS})
    one = lambda c: c.cast("int")
    score = one(F.col("_name")) + one(F.col("_price")) + F.when(F.col("_report"), 2).otherwise(one(F.col("_move"))) + one(F.col("_t").rlike(SHARE)) + 2 * one(F.col("_exchange"))
    held = F.when(F.col("_retail") & ~F.col("_exchange"), F.least(score, F.lit(2))).otherwise(score)
    return met.select(*[c for c in docs.columns if c != "report_score"], held.cast("int").alias("report_score"))
