"""The longer SQL statements of queries that are registered elsewhere."""

from __future__ import annotations

from shocklens.operators.reports import CUES, SHARE
from shocklens.operators.evaluate import poisson_steps
from shocklens.plans import DETECTED, EVENTS_SQL, PRICES, SQL
from shocklens.plans.documents import _DATED, _SCORES, _share
from shocklens.plans.evaluation import _SCORED
from shocklens.plans.more import _DOWN, _UP, STAND_IN_CUES
from shocklens.plans.prices import _BENCH, _C, _CASES, _FIT, _WEATHER, _WEEKLY, FLAGS, _det3


def put(sql: str, *names: str) -> None:
    for name in names:
        SQL[name] = "WITH " + sql.strip()


def seeded(*parts: str) -> str:
    """The draw of ``numbers.draw`` with seed 11."""
    return f"CAST('0x' || substr(md5(concat_ws('|', '11', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 15) AS BIGINT)"


_DAYS = f"{DETECTED}, usable AS (SELECT *, price > 0 AND lag(price) OVER (PARTITION BY series ORDER BY date) > 0 AS ok FROM det), lead_z AS (SELECT *, CASE WHEN kind = 'trend' THEN cz ELSE z END AS lz FROM usable), days AS (SELECT series, date, CASE WHEN lz > 0 THEN 'up' ELSE 'down' END AS direction FROM lead_z WHERE flag AND ok AND lz <> 0)"
_DONORS = f"""{_DAYS}, rk AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY series, direction ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 60 DAYS PRECEDING) AS bef,
  count(*) OVER (PARTITION BY series, direction ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 59 DAYS FOLLOWING) AS near, count(*) OVER (PARTITION BY series, direction) AS n FROM days WINDOW w AS (PARTITION BY series, direction ORDER BY date)),
dr AS (SELECT *, {seeded('series', 'direction', 'date')} % (bef + n - near) + 1 AS k FROM rk WHERE bef + n - near > 0),
pairs AS (SELECT d.series, d.direction, d.date, o.date AS donor FROM dr d JOIN rk o ON o.series = d.series AND o.direction = d.direction AND o.i = CASE WHEN k <= d.bef THEN k ELSE d.near + k - d.bef END)"""
put(f"{_DONORS} SELECT series, direction, CAST(date AS VARCHAR) AS date, CAST(donor AS VARCHAR) AS donor FROM pairs", "join_13_donors")
put(f"{_DONORS}, {_DATED} SELECT p.series, p.date, donor, document_id, date AS published FROM pairs p JOIN dated d ON d.published = donor", "join_14_shifted_documents")
put(f"""{_DAYS}, t AS (SELECT *, {seeded('series', 'date')} AS h, row_number() OVER (PARTITION BY year(date), direction ORDER BY {seeded('series', 'date')}, series, date) AS turn FROM days), o AS (SELECT * FROM t ORDER BY turn, h, series, date LIMIT 60)
SELECT series, CAST(date AS VARCHAR) AS date, direction, false AS forced, year(date) || '-' || direction AS stratum FROM o""", "rank_13_stratified_days")
_QUIET = f"""{DETECTED}, nf AS (SELECT *, bool_or(flag) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM det), q0 AS (SELECT *, row_number() OVER (PARTITION BY series, year(date) ORDER BY {seeded('series', 'date')}, date) AS turn FROM nf WHERE abs(z) < 0.5 AND NOT near AND date >= DATE '1997-01-01'),
quiet AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY turn, year(date)) AS place FROM q0 QUALIFY place <= 20)"""
put(f"{_QUIET} SELECT series, CAST(date AS VARCHAR) AS date, round(z, 6) AS z_score, CAST(place AS INTEGER) AS place FROM quiet", "rank_15_quiet_days")
put(f"""{_QUIET}, sh AS (SELECT series, r, row_number() OVER (PARTITION BY series ORDER BY date) AS k, count(*) OVER (PARTITION BY series) AS n FROM det WHERE kind = 'shock')
SELECT q.series, CAST(q.date AS VARCHAR) AS date, round(sh.r, 6) AS move, round(-sh.r, 6) AS mirror FROM quiet q JOIN sh ON sh.series = q.series AND sh.k = {seeded('q.series', 'q.date')} % sh.n + 1""", "rank_16_move_donors")
put(f"{DETECTED}, s AS (SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY {seeded('date')}, date) AS place FROM det WHERE flag) SELECT series, date, CAST(place AS INTEGER) AS place FROM s WHERE place <= 5", "rank_17_label_sample")

put(f"""{_SCORED}, c AS (SELECT grp, score, count(*) FILTER (relevant) AS p, count(*) FILTER (NOT relevant) AS n FROM scored GROUP BY 1, 2), gr AS (SELECT DISTINCT grp FROM c),
dr AS (SELECT grp, sample, len(list_filter({poisson_steps()}, lambda t: u >= t)) AS times FROM (SELECT grp, sample, {seeded('sample', 'grp')} AS u FROM gr, range(1, 2001) AS x(sample))),
w AS (SELECT sample, score, sum(p * times) AS p, sum(n * times) AS n FROM dr JOIN c USING (grp) WHERE times > 0 GROUP BY 1, 2),
b AS (SELECT *, p * (coalesce(sum(n) OVER (PARTITION BY sample ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS won FROM w), a AS (SELECT sample, sum(won) / nullif(CAST(sum(p) AS DOUBLE) * sum(n), 0) AS auc FROM b GROUP BY sample)
SELECT count(*) AS samples, round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi FROM a WHERE auc IS NOT NULL""", "agg_26_bootstrap_auc")

_CUM = ", ".join(f"covar_samp(x{i}, x{j}) OVER f AS c{i}{j}" for i in range(3) for j in range(i, 3))
_ADJUSTED = f"""{DETECTED}, {_FIT[_FIT.index('lines AS'):]},
cu AS (SELECT series, date, sum(y) OVER w AS y, sum(x0) OVER w AS x0, sum(x1) OVER w AS x1, sum(x2) OVER w AS x2, count(*) OVER w AS full_n FROM cases WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
cm AS (SELECT *, count(*) OVER f AS n, avg(y) OVER f AS my, {', '.join(f'avg(x{i}) OVER f AS m{i}' for i in range(3))}, {_CUM}, {', '.join(f'covar_samp(y, x{i}) OVER f AS y{i}' for i in range(3))}, var_samp(y) OVER f AS yy FROM (SELECT * FROM cu WHERE full_n = 10) WINDOW f AS (PARTITION BY series ORDER BY date ROWS BETWEEN 75 PRECEDING AND 1 PRECEDING)),
cf AS (SELECT *, {', '.join(f'CASE WHEN n >= 40 THEN {_det3([[f"y{i}" if j == k else _C[i][j] for j in range(3)] for i in range(3)])} / {_det3(_C)} END AS b{k}' for k in range(3))} FROM cm),
cr AS (SELECT series, date, (y - (my + b0 * (x0 - m0) + b1 * (x1 - m1) + b2 * (x2 - m2))) / sqrt(yy - b0 * y0 - b1 * y1 - b2 * y2) AS crz FROM cf),
aj AS (SELECT d.series, d.date, d.flag, d.kind, d.z, (r.y - r.explained) / sqrt(r.v) AS rz, 1 - r.v / r.yy AS r2, c.crz FROM det d LEFT JOIN res r ON r.series = d.series AND r.date = d.date LEFT JOIN cr c ON c.series = d.series AND c.date = d.date),
ac AS (SELECT *, CASE WHEN contains(kind, 'shock') THEN rz WHEN contains(kind, 'trend') THEN crz END AS judged FROM aj),
fa AS (SELECT *, CASE WHEN judged IS NULL THEN 'unclassified' WHEN abs(judged) >= 2 THEN 'commodity-specific' ELSE 'macro-driven' END AS factor_class FROM ac)"""
put(f"{_ADJUSTED} SELECT series, CAST(date AS VARCHAR) AS date, kind AS anomaly_type, round(rz, 6) AS residual_z, round(crz, 6) AS cum_residual_z, factor_class FROM fa WHERE flag", "dom_20_factor_adjusted")
put(f"""{_ADJUSTED} SELECT series, count(*) FILTER (flag) AS flagged, count(*) FILTER (flag AND factor_class = 'macro-driven') AS macro, count(*) FILTER (flag AND factor_class = 'commodity-specific') AS specific, count(*) FILTER (flag AND factor_class = 'unclassified') AS unclassified,
round(median(r2), 6) AS median_r2_all, round(median(r2) FILTER (flag), 6) AS median_r2_flagged, round(count(*) FILTER (flag AND factor_class = 'macro-driven') / nullif(count(*) FILTER (flag AND factor_class IN ('macro-driven', 'commodity-specific')), 0), 6) AS share_macro FROM fa GROUP BY series""", "agg_08_class_counts")
put(f"""{_ADJUSTED}, fl AS (SELECT date, series, CASE WHEN sd IS NOT NULL THEN flag END AS f FROM det), cv AS (SELECT series, date, f, coalesce(sum(CAST(f AS INTEGER)) OVER w, 0) - CAST(f AS INTEGER) AS others, count(f) OVER w - 1 AS judged FROM fl WINDOW w AS (PARTITION BY date)),
cx AS (SELECT series, date, CASE WHEN judged < 2 THEN 'unclassified' WHEN others >= 2 THEN 'macro' ELSE 'specific' END AS verdict FROM cv WHERE f), ff AS (SELECT series, date, factor_class FROM fa WHERE flag AND rz IS NOT NULL)
SELECT series, CAST(date AS VARCHAR) AS date, m.kind AS anomaly_type, ff.factor_class, cx.verdict, array_to_string(list_filter([CASE WHEN m.kind IS NULL THEN 'move' END, CASE WHEN ff.factor_class IS NULL THEN 'factors' END, CASE WHEN cx.verdict IS NULL THEN 'cross' END], lambda x: x IS NOT NULL), ',') AS missing
FROM (SELECT series, date, kind FROM det WHERE flag) m FULL JOIN ff USING (series, date) FULL JOIN cx USING (series, date)""", "join_17_cards")

put(f"""{_CASES}, {DETECTED[DETECTED.index('base AS'):]}, m AS (SELECT series, date, y, unnest([x0, x1]) AS fx FROM cases), s AS (SELECT series, date, median(y + fx) / nullif(max(y), 0) AS survival FROM m GROUP BY 1, 2)
SELECT series, date, kind AS anomaly_type, round(survival, 6) AS survival, CASE WHEN survival >= 0.8 THEN 'own move' WHEN survival <= 0.35 THEN 'dollar move' WHEN survival IS NOT NULL THEN 'mixed' END AS reading FROM s JOIN det USING (series, date) WHERE flag""", "dom_21_flagged_numeraire")

_DRY = f"{_WEATHER}, dz AS (SELECT *, -rain_z AS d FROM dry WHERE rain_z IS NOT NULL)"
put(f"""{_DRY}, l AS (SELECT station_id AS series, arg_max(d, date) AS d, arg_max(frost, date) AS f FROM dz GROUP BY 1)
SELECT series, 'weather' AS category, CAST(CASE WHEN f > 0 OR d >= 2.5 THEN 1 WHEN d >= 1.5 OR d <= -1.5 THEN 2 ELSE 3 END AS INTEGER) AS importance, CASE WHEN f > 0 THEN 'frost in the last week' WHEN d >= 2.5 THEN 'severe drought' WHEN d >= 1.5 THEN 'dry' WHEN d <= -1.5 THEN 'very wet' ELSE 'near normal' END AS text FROM l""", "dom_02_weather_observations")
put(f"""{_WEATHER}, d AS (SELECT station_id AS series, prcp, tmin, row_number() OVER (PARTITION BY station_id ORDER BY date) AS n FROM days), t AS (SELECT series, sum(prcp) FILTER (n <= 7) AS r7, min(tmin) FILTER (n <= 7) AS t7, count(*) FILTER (tmin < 2) AS fd, count(*) FILTER (prcp < 1) AS dd FROM d GROUP BY series),
x AS (SELECT *, CASE WHEN fd > 0 THEN 'frost ahead' WHEN t7 < 5 THEN 'cold ahead' WHEN dd >= 12 THEN 'dry ahead' WHEN r7 > 100 THEN 'heavy rain ahead' ELSE 'nothing unusual ahead' END AS text FROM t) SELECT series, 'forecast' AS category, CAST(CASE WHEN fd > 0 THEN 1 WHEN text = 'nothing unusual ahead' THEN 3 ELSE 2 END AS INTEGER) AS importance, text FROM x""", "dom_03_forecast_observations")
_TREND = f"""{PRICES}, rt AS (SELECT *, price / nullif(lag(price) OVER w, 0) - 1 AS ret, price / nullif(lag(price, 20) OVER w, 0) - 1 AS mo FROM prices WINDOW w AS (PARTITION BY series ORDER BY date)),
vo AS (SELECT *, CASE WHEN count(ret) OVER m >= 20 THEN stddev_samp(ret) OVER m END AS vol FROM rt WINDOW m AS (PARTITION BY series ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
yr AS (SELECT *, min(price) OVER y AS lo, max(price) OVER y AS hi, avg(vol) OVER y AS usual FROM vo WINDOW y AS (PARTITION BY series ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
la AS (SELECT series, mo, (price - lo) / nullif(hi - lo, 0) AS rp, vol / nullif(usual, 0) AS vr FROM yr QUALIFY row_number() OVER (PARTITION BY series ORDER BY date DESC) = 1),
trend AS (SELECT series, 'price' AS category, CAST(CASE WHEN abs(mo) > 0.10 OR vr > 1.5 THEN 1 ELSE 2 END AS INTEGER) AS importance, format('{{:+.1f}}% in a month, ', 100 * mo) || CASE WHEN vr > 1.5 THEN 'turbulent' WHEN vr < 0.7 THEN 'calm' ELSE 'usual' END AS text, rp, vr FROM la)"""
put(f"{_TREND} SELECT series, category, importance, text, round(rp, 6) AS range_position, round(vr, 6) AS vol_ratio FROM trend", "dom_05_trend_observations")
put(f"""{_WEEKLY}, p AS (SELECT series, CASE WHEN coalesce(stddev_samp(net), 0) = 0 THEN 50 ELSE 100 * avg(CAST(net < newest AS INTEGER)) END AS p FROM yr GROUP BY series)
SELECT series, 'positioning' AS category, CAST(CASE WHEN p >= 85 OR p <= 15 THEN 1 ELSE 2 END AS INTEGER) AS importance, CASE WHEN p >= 85 THEN 'crowded long' WHEN p >= 70 THEN 'long' WHEN p <= 15 THEN 'crowded short' WHEN p <= 30 THEN 'short' ELSE 'balanced' END AS text FROM p""", "dom_06_positioning_observations")


def _weight(words: dict[str, float]) -> str:
    return " + ".join(f"{w} * (2 * len(list_filter(h, lambda x: x = '{k}')) + len(list_filter(b, lambda x: x = '{k}')))" for k, w in words.items())


put(f"""{_DATED}, w AS (SELECT series, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+') AS h, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS b FROM dated), c AS (SELECT series, {_weight(_UP)} AS u, {_weight(_DOWN)} AS d FROM w),
n AS (SELECT series, count(*) FILTER (u > d) AS up, count(*) FILTER (d > u) AS down FROM c GROUP BY series), l AS (SELECT series, CASE WHEN up > 0 AND up >= 2 * down THEN 'up' WHEN down > 0 AND down >= 2 * up THEN 'down' ELSE 'mixed' END AS lean FROM n)
SELECT series, 'news' AS category, CAST(CASE WHEN lean = 'mixed' THEN 3 ELSE 2 END AS INTEGER) AS importance, 'headlines ' || lean AS text FROM l""", "dom_09_news_observations")

put(f"""{_DRY}, c AS (SELECT station_id, date, d, frost > 3 AS f, CASE WHEN month(date) < 7 THEN 'flowering' ELSE 'harvest' END AS phase FROM dz), k AS (SELECT *, CASE WHEN d >= 2.5 THEN 'severe drought' WHEN d >= 1.5 THEN 'drought' WHEN d <= -1.5 THEN 'excess rain' END AS dry, f AND phase = 'flowering' AS tender FROM c)
SELECT station_id, date, concat_ws('; ', CASE WHEN tender THEN 'frost during ' || phase END, dry || ' during ' || phase, CASE WHEN NOT tender AND dry IS NULL THEN 'nothing unusual during ' || phase END) AS note FROM k""", "fn_32_weather_in_context")

put(f"""{_DATED}, w AS (SELECT document_id, list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS b FROM dated)
SELECT document_id, round(coalesce(len(list_intersect(a, b)) / nullif(len(a), 0), 0), 6) AS support FROM w""", "fn_12_lexical_support")
_CUE_ROWS = ", ".join(f"('{m}', '{k}', '{f}', '{c}')" for m, k, _, f, c in CUES + STAND_IN_CUES)
_SCORED_TITLES = f"""cu(market, kind, form, cue) AS (VALUES {_CUE_ROWS}),
ti AS (SELECT document_id, lower(title) AS t, CASE series WHEN 'en' THEN 'coffee' WHEN 'de' THEN 'wheat' ELSE 'gold' END AS market, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+') AS w FROM dated),
hi AS (SELECT document_id, t, kind FROM ti JOIN cu ON cu.market IN ('*', ti.market) AND CASE form WHEN 'word' THEN contains(' ' || array_to_string(w, ' ') || ' ', ' ' || cue || ' ') WHEN 'stem' THEN contains(' ' || array_to_string(w, ' '), ' ' || cue) ELSE contains(t, cue) END),
ki AS (SELECT document_id, bool_or(kind = 'name') AS na, bool_or(kind = 'price') AS pr, bool_or(kind = 'exchange') AS ex, bool_or(kind = 'report') AS rp, bool_or(kind = 'move') AS mo, bool_or(kind = 'retail') AS re FROM hi GROUP BY document_id),
po AS (SELECT ti.document_id, coalesce(ex, false) AS ex, coalesce(re, false) AS re, CAST(coalesce(na, false) AS INTEGER) + CAST(coalesce(pr, false) AS INTEGER) + CASE WHEN rp THEN 2 WHEN mo THEN 1 ELSE 0 END + CAST(regexp_matches(t, '{SHARE}') AS INTEGER) + 2 * CAST(coalesce(ex, false) AS INTEGER) AS n FROM ti LEFT JOIN ki USING (document_id)),
report AS (SELECT document_id, CAST(CASE WHEN re AND NOT ex THEN least(n, 2) ELSE n END AS INTEGER) AS report_score FROM po)"""
put(f"{_DATED}, {_SCORED_TITLES} SELECT document_id, report_score FROM report", "fn_17_report_scores")

put("""c AS (SELECT conv_id AS day, turn, text, CAST(turn AS VARCHAR) AS id FROM conversations), a AS (SELECT conv_id AS day, CASE WHEN turn % 3 = 0 THEN 'not_shown' ELSE CAST(turn AS VARCHAR) END AS id, [' UP', 'down', '?'][CAST(length(text) % 3 AS INTEGER) + 1] AS raw, turn, row_number() OVER (PARTITION BY conv_id, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn END ORDER BY turn) AS rn, text[1:40] AS quote FROM conversations),
j AS (SELECT c.day, c.id, c.text, a.raw, a.quote, a.id IS NOT NULL AS read FROM c LEFT JOIN (SELECT * FROM a WHERE rn = 1) a USING (day, id)),
w AS (SELECT *, regexp_extract_all(lower(coalesce(quote, '')), '[\\p{L}\\p{N}]+') AS q, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS t FROM j),
g AS (SELECT *, list_transform(range(1, len(q) - 1), lambda i: q[i] || ' ' || q[i + 1] || ' ' || q[i + 2]) AS qg, list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS tg FROM w)
SELECT 'all' AS series, day, id AS document_id, CASE raw WHEN ' UP' THEN 'up' WHEN 'down' THEN 'down' WHEN '?' THEN 'unclear' END AS direction, CASE WHEN read THEN 'report' END AS kind, CASE WHEN read THEN 'frost' END AS cause, CASE WHEN read THEN 3::DOUBLE END AS move_pct, read,
  coalesce(read AND len(t) > 0 AND (len(q) >= 3 OR length(array_to_string(q, '')) >= 12) AND (contains(array_to_string(t, ''), array_to_string(q, '')) OR (len(q) >= 3 AND len(list_filter(qg, lambda x: list_contains(tg, x))) >= 0.8 * (len(q) - 2))), false) AS quote_found FROM g""", "rule_05_normalised_readings")
_STEPS = "(VALUES (1500), (1100), (800), (600), (400), (300))"
put(f"""{_DATED}, pl AS (SELECT series, published, document_id, text, row_number() OVER (PARTITION BY series, published ORDER BY n_chars DESC, document_id) AS place FROM dated), st AS (SELECT *, text[1:chars] AS e FROM pl, {_STEPS} AS s(chars)),
co AS (SELECT *, length(regexp_replace(e, '[\\x{{0000}}-\\x{{024F}}]', '', 'g')) AS o FROM st), cs AS (SELECT *, CAST(floor((length(e) - o) / 3.2) AS BIGINT) + o + 1 AS cost FROM co),
su AS (SELECT *, sum(cost) OVER (PARTITION BY series, published, chars ORDER BY place) AS run, sum(cost) OVER (PARTITION BY series, published, chars) AS total FROM cs), fi AS (SELECT series, published, coalesce(max(chars) FILTER (total <= 900), 300) AS step FROM su GROUP BY 1, 2)
SELECT series, CAST(published AS VARCHAR) AS published, document_id, CAST(place AS INTEGER) AS place, CAST(chars AS INTEGER) AS chars, CAST(length(e) AS INTEGER) AS excerpt_chars FROM su JOIN fi USING (series, published) WHERE chars = step AND (run <= 900 OR place <= 3)""", "rule_07_packed_evidence")
put(f"""{_DATED}, pl AS (SELECT series, published AS day, document_id, title, row_number() OVER (PARTITION BY series, published ORDER BY n_chars DESC, document_id) AS place FROM dated), li AS (SELECT series, day, place, document_id % 3 = 0 AS o, CASE WHEN document_id % 3 = 0 THEN 'Against: ' ELSE '' END || title || ' (source: ' || document_id || ')' AS line FROM pl WHERE place <= 4)
SELECT series, day, string_agg(line, chr(10) ORDER BY o, place) AS explanation FROM li GROUP BY 1, 2""", "rule_08_explanations")

put("""e AS (SELECT CAST(user_id AS VARCHAR) AS series, ts FROM events), f AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 12 HOURS, true) AS fresh FROM e WINDOW w AS (PARTITION BY series ORDER BY ts)), g AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT series, min(ts) AS "start", max(ts) + INTERVAL 12 HOURS AS "end", count(*) AS flags FROM g GROUP BY series, s HAVING max(ts) + INTERVAL 12 HOURS <= (SELECT max(ts) FROM e) - INTERVAL 10 DAYS""", "str_06_flag_sessions")

_KEYED = f"""{_DATED}, tk AS (SELECT *, regexp_extract_all(lower(regexp_replace(trim(title), '\\s+[-|–—]\\s+[^-|–—]+$', '')), '[\\p{{L}}\\p{{N}}]+') AS tw FROM dated), ky AS (SELECT *, CASE WHEN len(tw) >= 3 THEN array_to_string(tw, ' ') ELSE '' END AS title_key FROM tk)"""
put(f"{_KEYED} SELECT document_id, title_key FROM ky", "fn_05_title_keys")
_LINKS = """hx AS (SELECT *, regexp_replace(split_part(split_part(url, '://', 2), '/', 1), '^www\\.', '') AS host, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM given),
gs AS (SELECT *, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g0 FROM hx), gx AS (SELECT *, list_sort(list_distinct(g0)) AS g FROM gs), gk AS (SELECT *, md5(array_to_string(g, '|')) AS x FROM gx WHERE len(g) > 0),
ho AS (SELECT series, host, x, min(document_id) AS id FROM gk GROUP BY 1, 2, 3), tx AS (SELECT series, x, min(id) AS a, min(host) AS lo, max(host) AS hi FROM ho GROUP BY 1, 2),
sg AS (SELECT t.series, t.a AS id, lo, hi, unnest(gk.g) AS g, len(gk.g) AS n FROM tx t JOIN gk ON gk.document_id = t.a), cm AS (SELECT p.series, p.id AS a, q.id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS c, any_value(p.lo) AS al, any_value(p.hi) AS ah, any_value(q.lo) AS bl, any_value(q.hi) AS bh FROM sg p JOIN sg q ON p.series = q.series AND p.g = q.g AND p.id < q.id GROUP BY 1, 2, 3),
edges AS (SELECT series, min(document_id) OVER (PARTITION BY series, title_key) AS a, document_id AS b FROM given WHERE title_key <> '' QUALIFY a <> b UNION SELECT h.series, a, id FROM ho h JOIN tx USING (series, x) WHERE a <> id UNION SELECT series, a, b FROM cm WHERE c / (na + nb - c) >= 0.6 AND NOT (al = ah AND bl = bh AND al = bl))"""
_REACH = """both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach(n, r) AS (SELECT document_id, document_id FROM given UNION SELECT w.b, reach.r FROM reach JOIN both_ways w ON w.a = reach.n), rt AS (SELECT n AS document_id, min(r) AS root FROM reach GROUP BY n),
st AS (SELECT g.*, root, row_number() OVER (PARTITION BY root ORDER BY coalesce(text, '') = '', published, document_id) AS first FROM given g JOIN rt USING (document_id)),
cp AS (SELECT root, count(*) AS n_copies, list(DISTINCT url) AS urls, list_sort(list(DISTINCT regexp_replace(split_part(split_part(url, '://', 2), '/', 1), '^www\\.', ''))) AS hosts FROM st GROUP BY root),
stories AS (SELECT s.*, n_copies, len(list_filter(urls, lambda u: u <> s.url)) AS other_urls, array_to_string(hosts, ',') AS domains FROM st s JOIN cp USING (root) WHERE first = 1)"""
SQL["set_07_story_edges"] = f"WITH RECURSIVE {_KEYED}, given AS (SELECT * FROM ky), {_LINKS}, {_REACH} SELECT series, g.document_id, root AS story FROM given g JOIN rt USING (document_id)"
SQL["set_07_stories"] = f"WITH RECURSIVE {_KEYED}, given AS (SELECT * FROM ky), {_LINKS}, {_REACH} SELECT series, document_id, n_copies, CAST(other_urls AS INTEGER) AS urls, domains FROM stories"
SQL["rule_11_candidates"] = f"""WITH RECURSIVE {_KEYED}, {_SCORED_TITLES}, given AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, regexp_replace(split_part(url, '#', 1), '/+$', '') ORDER BY document_id) AS turn FROM ky WHERE datediff('day', published, DATE '1999-02-15') BETWEEN 0 AND 30) WHERE turn = 1), {_LINKS}, {_REACH},
kw AS (SELECT *, regexp_extract_all(lower(title), '[a-z]+') AS th, regexp_extract_all(lower(text), '[a-z]+') AS tb FROM stories)
SELECT series, document_id, n_copies, round(least((2 * {_share(['the', 'tion'], 'th')} + {_share(['the', 'tion'], 'tb')} + 2 * {_share(['and', 'was'], 'th')} + {_share(['and', 'was'], 'tb')}) / 6, 1), 4) AS keyword_score, report_score,
  CAST(len(list_filter(range(1, datediff('day', published, DATE '1999-02-15') + 1), lambda i: isodow(published + CAST(i AS INTEGER)) < 6)) AS INTEGER) AS age FROM kw JOIN report USING (document_id)"""
put(f"""{_TREND}, {DETECTED[DETECTED.index('ret AS'):]}, mo AS (SELECT series, count(*) FILTER (flag) AS flags FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS back FROM det) WHERE back <= 7 GROUP BY series),
{_BENCH[_BENCH.index('prices AS') + len(PRICES):].lstrip(', ')}, sj AS (SELECT p.series, p.date, 100 * (price - benchmark * (100 / 2.20462::DOUBLE)) / (benchmark * (100 / 2.20462::DOUBLE)) AS s FROM prices p ASOF LEFT JOIN bench b ON p.series = b.series AND p.date >= b.known_from), sp AS (SELECT series, arg_max(s, date) AS s FROM sj WHERE s IS NOT NULL GROUP BY series),
ob AS (SELECT series, category, importance, text FROM trend UNION ALL SELECT series, 'moves', CAST(CASE WHEN flags > 0 THEN 1 ELSE 3 END AS INTEGER), flags || ' unusual of the last 7 sessions' FROM mo UNION ALL SELECT series, 'benchmark', CAST(CASE WHEN abs(s) > 10 THEN 1 ELSE 3 END AS INTEGER), format('{{:+.1f}}% against the benchmark', s) FROM sp)
SELECT * FROM ob""", "dom_11_brief")
put(f"""{SQL['dom_11_brief'][5:].rpartition('SELECT * FROM ob')[0].rstrip()}, rk2 AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY importance, category) AS rn2 FROM ob), hd AS (SELECT series, string_agg(text, '; ' ORDER BY rn2) AS headline FROM rk2 WHERE rn2 <= 3 AND importance <= 2 GROUP BY series),
lv AS (SELECT series, CASE min(importance) WHEN 1 THEN 'high' WHEN 2 THEN 'normal' ELSE 'quiet' END AS level FROM ob GROUP BY series) SELECT series, level, headline FROM lv LEFT JOIN hd USING (series)""", "rank_18_alerts")
put(f"{SQL['rank_18_alerts'][5:].rpartition(' SELECT series, level, headline')[0]} SELECT series, level, headline FROM lv LEFT JOIN hd USING (series) WHERE level <> 'quiet'", "str_05_alerts")
put(f"""{PRICES}, {_WEATHER}, fr0 AS (SELECT *, price / nullif(lag(price) OVER w, 0) - 1 AS r1, price / nullif(lag(price, 5) OVER w, 0) - 1 AS ret_5, lead(price, 5) OVER w / nullif(price, 0) - 1 AS forward FROM prices WINDOW w AS (PARTITION BY series ORDER BY date)),
fv AS (SELECT *, CASE WHEN count(r1) OVER m >= 20 THEN stddev_samp(r1) OVER m END AS vol_20 FROM fr0 WINDOW m AS (PARTITION BY series ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), dn AS (SELECT date, -rain_z AS dz FROM dry WHERE station_id = 'N'), j AS (SELECT fv.*, dz FROM fv LEFT JOIN dn USING (date)),
c AS (SELECT *, avg(CAST(dz IS NOT NULL AS INTEGER)) OVER (PARTITION BY series) > 0.5 AS ok FROM j) SELECT series, date, round(ret_5, 6) AS ret_5, round(vol_20, 6) AS vol_20, round(CASE WHEN ok THEN last_value(dz IGNORE NULLS) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING) END, 6) AS dryness_z, round(forward, 6) AS forward FROM c""", "dom_14_outlook_frame")
put("""n AS (SELECT doc_id, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents), m AS (SELECT item_id, text AS quote, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS q FROM benchmark), h AS (SELECT doc_id, item_id, regexp_extract_all(lower(quote), '[\\p{L}\\p{N}]+') AS q, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM n JOIN m ON length(m.q) >= 15 AND contains(n.t, m.q)),
g AS (SELECT *, list_transform(range(1, len(q) - 1), lambda i: q[i] || ' ' || q[i + 1] || ' ' || q[i + 2]) AS qg, list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS tg FROM h)
SELECT doc_id, item_id, len(t) > 0 AND (len(q) >= 3 OR length(array_to_string(q, '')) >= 12) AND (contains(array_to_string(t, ''), array_to_string(q, '')) OR (len(q) >= 3 AND len(list_filter(qg, lambda x: list_contains(tg, x))) >= 0.8 * (len(q) - 2))) AS quote_found FROM g""", "fn_14_quotes_checked")
