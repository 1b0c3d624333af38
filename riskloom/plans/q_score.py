"""Queries of scoring and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import params
from riskloom.functions import text as T
from riskloom.functions.num import banded, rounded
from riskloom.operators import score as S
from riskloom.operators import timeseries as TS
from riskloom.plans import q_events as QE
from riskloom.plans import q_text as QT
from riskloom.plans.bindings import HISTORY, SERIES, C, R, articles, bands_sql, history, long_sql, names_sql, series, weights_sql
from riskloom.session import table

KEYS = list(params.WEIGHTS)


def _values(s, d):
    return S.unpivot(history(s, d), ("series_key", "date"), KEYS)


def _scores(s, d):
    v = _values(s, d)
    return S.risk_scores(S.normalize(v, S.percentiles(v)), S.weight_table(s))


def _details(s, d):
    v = _values(s, d)
    return S.details(S.normalize(v, S.percentiles(v)), S.weight_table(s))


def risk_daily(s, d):
    """Daily 0-100 risk of each region with its 7-day moving average."""
    scored = _scores(s, d).withColumnRenamed("risk_score", "score")
    return TS.moving_average(scored).select("series_key", "date", F.col("score").alias("risk_score"), "risk_level", "rebalanced", "ma")


def _event_values(s, d):
    """Every event's value, a long history of each event type."""
    return table(s, d, "events").select(F.col("event_type").alias("series_key"), F.to_date("ts").alias("date"), F.lit("value").alias("indicator"), "value")


def _numeric(s, d):
    """Sums of the numeric entries of events' free-form details."""
    details = F.map_from_arrays(F.array(F.lit("value"), F.lit("type"), F.lit("k"), F.lit("props")), F.array(F.col("value").cast("string"), "event_type", F.get_json_object("props", "$.k"), "props"))
    rows = table(s, d, "events").select("event_type", F.explode(S.numeric_entries(details)).alias("indicator", "value"))
    return rows.groupBy("event_type", "indicator").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("total"))


LONG = long_sql(HISTORY)
NORM = f"""SELECT v.series_key, v.date, v.indicator, {R(f"CASE WHEN n >= 5 THEN CASE WHEN p95 - p5 < 1e-6 THEN 0.5 ELSE {C('(value - p5) / (p95 - p5)')} END ELSE {C('value')} END", 4)} AS value
FROM ({LONG}) v JOIN (SELECT series_key, indicator, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95, count(value) AS n FROM ({LONG}) GROUP BY 1, 2) p ON v.series_key = p.series_key AND v.indicator = p.indicator"""
def _dec(x: str, places: int) -> str:
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(28,10)), {places}) AS DECIMAL(28,{places})) AS VARCHAR)"


def chain(norm):
    """SQL of details, scores, drivers and attribution over normalised values (series_key, date, indicator, value)."""
    details = f"""SELECT series_key, date, indicator, skipped, value, CASE WHEN total <= 0 THEN weight WHEN abs(total - 1) > 0.001 THEN valid / total ELSE valid END AS used_weight,
  value * CASE WHEN total <= 0 THEN weight WHEN abs(total - 1) > 0.001 THEN valid / total ELSE valid END AS contribution, total > 0 AND abs(total - 1) > 0.001 AS rebalanced
FROM (SELECT *, sum(valid) OVER (PARTITION BY series_key, date) AS total FROM (SELECT n.*, weight, placeholder AND value <= 0 AS skipped, CASE WHEN placeholder AND value <= 0 THEN 0.0 ELSE weight END AS valid FROM ({norm}) n JOIN {weights_sql()} USING (indicator)))"""
    scored = f"SELECT series_key, date, risk_score, {bands_sql('risk_score', params.RISK_BANDS)} AS risk_level, rebalanced FROM (SELECT series_key, date, {R('sum(contribution) * 100')} AS risk_score, bool_or(rebalanced) AS rebalanced FROM ({details}) GROUP BY 1, 2)"
    drivers = f"""SELECT series_key, date, indicator, {names_sql('indicator')} AS name, c AS contribution, share, CAST(row_number() OVER (PARTITION BY series_key, date ORDER BY c DESC, indicator) AS INT) AS rank FROM (
  SELECT *, {R('contribution', 4)} AS c, {R('CASE WHEN t > 0 THEN contribution / t ELSE 0 END * 100')} AS share FROM (SELECT *, sum(contribution) OVER (PARTITION BY series_key, date) AS t FROM ({details})) WHERE NOT skipped)"""
    told = f"""SELECT s.series_key, s.date, s.risk_score, n1 AS primary_driver, coalesce(hhi, 0.0) AS concentration, coalesce(
  '当前综合风险为' || CASE WHEN s.risk_score >= 70 THEN '高' WHEN s.risk_score >= 40 THEN '中' ELSE '低' END || '风险（' || {_dec('s.risk_score', 1)} || '分）。' ||
  '最主要驱动因素是「' || n1 || '」，贡献了 ' || {_dec('p1', 0)} || '% 的风险，' || {names_sql('i1', params.INDICATOR_TEXTS)} || '。' ||
  coalesce('其次为「' || n2 || '」（' || {_dec('p2', 0)} || '%）。', '') ||
  CASE WHEN hhi > 0.5 THEN '风险来源高度集中于单一因素，建议重点监测。' WHEN hhi > 0.3 THEN '风险由少数几个因素主导。' ELSE '风险来源较为分散，属多因素综合作用。' END, '无有效驱动指标。') AS attribution_text
FROM ({scored}) s LEFT JOIN (SELECT series_key, date, max(name) FILTER (rank = 1) AS n1, max(indicator) FILTER (rank = 1) AS i1, max(share) FILTER (rank = 1) AS p1, max(name) FILTER (rank = 2) AS n2, max(share) FILTER (rank = 2) AS p2,
  {R('sum(pow(share / 100, 2))', 4)} AS hhi FROM ({drivers}) GROUP BY 1, 2) a ON a.series_key = s.series_key AND a.date = s.date"""
    return details, scored, drivers, told


DETAILS, SCORED, DRIVERS, ATTRIBUTION = chain(NORM)


def _change(s, d):
    det = _details(s, d)
    day = lambda n: det.filter(F.col("date") == F.lit(f"2024-01-{n:02d}").cast("date")).drop("date")
    return S.change(day(20), day(19)).select("series_key", "indicator", "name", "change", "direction", "rank")


CHANGE = f"""SELECT series_key, indicator, {names_sql('indicator')} AS name, change, CASE WHEN delta > 0 THEN '上升' ELSE '下降' END AS direction, CAST(row_number() OVER (PARTITION BY series_key ORDER BY abs(change) DESC, indicator) AS INT) AS rank FROM (
  SELECT *, {R('delta * 100')} AS change FROM (SELECT coalesce(a.series_key, b.series_key) AS series_key, coalesce(a.indicator, b.indicator) AS indicator, coalesce(a.contribution, 0) - coalesce(b.contribution, 0) AS delta FROM (SELECT * FROM ({DETAILS}) WHERE date = DATE '2024-01-20') a FULL JOIN (SELECT * FROM ({DETAILS}) WHERE date = DATE '2024-01-19') b ON a.series_key = b.series_key AND a.indicator = b.indicator) WHERE abs(delta) >= 1e-6)"""
HALVES = f"""SELECT series_key, half, count(*) AS rows, avg(risk_score) AS score, {', '.join(f'avg(coalesce({k}, 0)) AS {k}' for k in KEYS)}, min(date) AS first, max(date) AS last FROM (
  SELECT *, CASE WHEN back > n - floor(n / 2) THEN 'older' ELSE 'recent' END AS half FROM (SELECT *, count(*) OVER (PARTITION BY series_key) AS n FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date DESC) AS back FROM ({HISTORY})) WHERE back <= 14) WHERE n >= 4) GROUP BY 1, 2"""
_MOVES = " UNION ALL ".join(f"SELECT r.series_key, '{k}' AS indicator, r.{k} * {w} - o.{k} * {w} AS delta FROM h r JOIN h o ON r.series_key = o.series_key AND r.half = 'recent' AND o.half = 'older'" for k, w in params.WEIGHTS.items())
HISTORY_CHANGE = f"""WITH h AS ({HALVES}), m AS (SELECT series_key, {names_sql('indicator')} AS name, change, CASE WHEN delta > 0 THEN '上升' ELSE '下降' END AS direction, row_number() OVER (PARTITION BY series_key ORDER BY abs(change) DESC, indicator) AS r FROM (SELECT *, {R('delta * 100')} AS change FROM ({_MOVES})) WHERE abs(delta) >= 1e-6),
w AS (SELECT r.series_key, r.score AS b, o.score AS a, {R('r.score - o.score')} AS delta, o.first || ' ~ ' || o.last AS older_period, r.first || ' ~ ' || r.last AS recent_period FROM h r JOIN h o ON r.series_key = o.series_key AND r.half = 'recent' AND o.half = 'older')
SELECT w.series_key, {R('b', 4)} AS current_score, {R('a', 4)} AS previous_score, delta, word AS trend, name AS main_change, coalesce('风险分较上期' || word || ' ' || {_dec('abs(delta)', 1)} || ' 分，主要由「' || name || '」' || direction || '驱动（贡献变化 ' || CASE WHEN change >= 0 THEN '+' ELSE '' END || {_dec('change', 1)} || ' 分）。', '风险分较上期基本' || word || '，无显著驱动因素变化。') AS change_text, older_period, recent_period
FROM (SELECT *, CASE WHEN delta > 0 THEN '上升' WHEN delta < 0 THEN '下降' ELSE '持平' END AS word FROM w) w LEFT JOIN m ON m.series_key = w.series_key AND m.r = 1"""


def _fusion(s, d):
    """Daily text metrics of events' titles fused with coded metrics and external levels."""
    a = articles(s, d)
    text = a.groupBy("series_key", "date").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("series_key").isin("error", "purchase").cast("double")).alias("conflict_frequency"), rounded(F.avg(T.lexicon_sentiment(F.col("title"))), 4).alias("sentiment_avg"))
    coded = QE.event_metrics(a.filter("series_key <> 'signup'"), "series_key", "date")
    ext = a.select("series_key", "date").distinct().select("series_key", "date", F.when(F.dayofmonth("date") % 2 == 0, -0.3).otherwise(0.2).alias("nightlight_change"), F.lit(0.4).alias("refugee_change"))
    return S.fuse(text, coded, ext).select("series_key", "date", "indicator", rounded(F.col("value"), 4).alias("value"))


_CF = "CASE WHEN m.series_key IN ('error', 'purchase') THEN 1.0 ELSE 0.0 END"
_FUSED = f"""SELECT t.series_key, t.date, CASE WHEN t.series_key = 'signup' THEN {_CF.replace('m.', 't.')} ELSE 0.6 * ({_CF.replace('m.', 't.')}) + 0.4 * m.conflict_frequency END AS c, CASE WHEN t.series_key = 'signup' THEN 0.5 ELSE 0.6 * 0.5 + 0.4 * m.avg_tone_risk END AS sn, CASE WHEN t.series_key <> 'signup' THEN m.avg_severity END AS sev
FROM (SELECT DISTINCT series_key, date FROM ({SERIES})) t JOIN ({QE.METRICS}) m ON m.series_key = t.series_key AND m.date = t.date"""
FUSION = f"""WITH f AS ({_FUSED}) SELECT series_key, date, 'conflict_frequency' AS indicator, {R('c', 4)} AS value FROM f UNION ALL SELECT series_key, date, 'sentiment_avg', {R('sn', 4)} FROM f
UNION ALL SELECT series_key, date, 'nightlight_change', CASE WHEN day(date) % 2 = 0 THEN 0.3 ELSE 0.0 END FROM f UNION ALL SELECT series_key, date, 'refugee_change', 0.4 FROM f UNION ALL SELECT series_key, date, 'event_severity', {R('coalesce(sev, c * 0.8 + sn * 0.2)', 4)} FROM f"""


def _single(s, d):
    """The score of each document by itself."""
    t = QT._mixed(s, d)
    flag = T.contains_any(F.col("text"), params.CONFLICT_WORDS_ZH + params.CONFLICT_WORDS_EN)
    t = t.select("doc_id", flag.alias("flag"), (1 - T.lexicon_sentiment(F.col("text"))).alias("risk"))
    ind = S.single_text_indicators(F.col("flag"), F.col("risk"))
    wide = t.select(F.col("doc_id").alias("series_key"), *[c.alias(k) for k, c in ind.items()])
    return S.risk_scores(S.unpivot(wide, ("series_key",), KEYS), S.weight_table(s), ("series_key",)).withColumnRenamed("series_key", "doc_id")


_FLAG = f"len(list_filter({QT.KW}, lambda w: contains({QT.LOW}, w))) > 0"
_RISK = f"1 - CASE WHEN {QT.POS} + {QT.NEG} = 0 THEN 0.5 ELSE {R(f'CAST({QT.POS} AS DOUBLE) / greatest({QT.POS} + {QT.NEG}, 1)', 4)} END"
_W = {k: params.WEIGHTS[k] / (1 - params.WEIGHTS["nightlight_change"] - params.WEIGHTS["refugee_change"]) for k in ("conflict_frequency", "sentiment_avg", "event_severity")}
SINGLE = f"SELECT doc_id, sc AS risk_score, {bands_sql('sc', params.RISK_BANDS)} AS risk_level, true AS rebalanced FROM (SELECT doc_id, {R(f'''100 * (CASE WHEN f THEN 1.0 ELSE 0.2 END * CAST({_W['conflict_frequency']} AS DOUBLE) + r * CAST({_W['sentiment_avg']} AS DOUBLE) + CASE WHEN f THEN 0.8 ELSE 0.3 END * CAST({_W['event_severity']} AS DOUBLE))''')} AS sc FROM (SELECT doc_id, {_FLAG} AS f, {_RISK} AS r FROM ({QT.MIXED})))"


def _records(s, d):
    """Records of documents that name seed entities."""
    return S.analysis_records(QT.mentions(s, d), QT.gazetteer(s))


_CLEAN = f"SELECT doc_id, {QT.clean_sql('text')} AS text FROM ({QT.MENTIONS})"
_TEXT_VALUES = f"WITH c AS MATERIALIZED (SELECT doc_id, {_FLAG} AS f, {_RISK} AS r FROM ({_CLEAN})) SELECT doc_id AS series_key, DATE '2024-01-01' AS date, unnest([{', '.join(f"'{k}'" for k in KEYS)}]) AS indicator, CAST(unnest([CASE WHEN f THEN 1.0 ELSE 0.2 END, r, 0.0, 0.0, CASE WHEN f THEN 0.8 ELSE 0.3 END]) AS DOUBLE) AS value FROM c"
_, _TEXT_SCORES, _, _TEXT_TOLD = chain(_TEXT_VALUES)
RECORDS = f"""SELECT c.doc_id, substring(c.text, 1, 200) || '...' AS text, locations, organizations, persons, events, 1 - r AS sentiment_score, r AS risk_sentiment, {bands_sql('r', params.SENTIMENT_BANDS)} AS sentiment_level, s.risk_score, s.risk_level, {bands_sql('s.risk_score', params.ALERT_BANDS)} AS alert, primary_driver, concentration, attribution_text
FROM (SELECT doc_id, text, {R(_RISK, 4)} AS r, CASE WHEN {QT.ZH} THEN {QT._held(params.EVENT_WORDS_ZH, 'text')} ELSE {QT._held(params.EVENT_WORDS_EN, QT.LOW)} END AS events FROM ({_CLEAN})) c
JOIN ({QT.tags_sql(_CLEAN)}) t ON t.doc_id = c.doc_id JOIN ({_TEXT_SCORES}) s ON s.series_key = c.doc_id JOIN ({_TEXT_TOLD}) a ON a.series_key = c.doc_id"""


def _rolled(s, d):
    """Events by three as the steps of one analysis; some steps are missing or empty."""
    k, kind = F.col("event_id"), F.col("event_type")
    event = F.to_json(F.struct(kind.alias("event_type"), F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("key_actors"), F.when(k % 5 > 0, (k % 6).cast("string")).alias("severity")))
    result = F.when(k % 7 == 0, "{}").when(k % 3 == 0, event).when(k % 3 == 1, '{"impact": "x"}').otherwise(F.to_json(F.struct(F.array(kind, F.lit("watch")).alias("policy_recommendations"))))
    step = F.get(F.lit(["event_identification", "impact_analysis", "recommendation"]), (k % 3).cast("int"))
    return S.roll_up(table(s, d, "events").select(F.floor(k / 3).alias("key"), step.alias("step"), result.alias("result")))


ROLLED = f"""SELECT key, coalesce(max(event_type) FILTER (e), '{params.UNKNOWN}') AS event_type, coalesce(max(['u' || user_id]) FILTER (e), []) AS key_actors,
  CASE WHEN count(*) FILTER (i) = 0 THEN '{params.UNKNOWN}' ELSE {bands_sql(f'coalesce(max(event_id % 6) FILTER (e AND event_id % 5 > 0), {params.USUAL_SEVERITY})', params.ROLL_UP_BANDS)} END AS risk_level, coalesce(max([event_type, 'watch']) FILTER (a), []) AS recommendations
FROM (SELECT *, event_id // 3 AS key, event_id % 7 > 0 AND event_id % 3 = 0 AS e, event_id % 7 > 0 AND event_id % 3 = 1 AS i, event_id % 7 > 0 AND event_id % 3 = 2 AS a FROM events) GROUP BY 1"""


def _macro(s, d):
    """Nations' macro indicators from their customers and suppliers."""
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(rounded(F.avg("c_acctbal") / 400 - 8, 4).alias("growth"), rounded(F.avg("c_acctbal") / 4, 4).alias("per_capita"))
    p = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(rounded(F.avg("s_acctbal") / 300, 4).alias("inflation"), rounded(F.count(F.lit(1)).cast("double") * 8, 4).alias("trade"))
    return c.join(p, "k", "left")


MACRO = f"SELECT c.k, growth, per_capita, inflation, trade FROM (SELECT c_nationkey AS k, {R('avg(c_acctbal) / 400 - 8', 4)} AS growth, {R('avg(c_acctbal) / 4', 4)} AS per_capita FROM customer GROUP BY 1) c LEFT JOIN (SELECT s_nationkey AS k, {R('avg(s_acctbal) / 300', 4)} AS inflation, {R('CAST(count(*) AS DOUBLE) * 8', 4)} AS trade FROM supplier GROUP BY 1) s ON s.k = c.k"
_DIST = "CASE WHEN g < 0 THEN 0.6 * least(1.0, abs(g) / 10) WHEN g < 3 THEN 0.3 ELSE 0.0 END + CASE WHEN i > 15 THEN 0.4 * least(1.0, (i - 15) / 20) WHEN i > 8 THEN 0.2 ELSE 0.0 END"

QUERIES = {
    "risk_daily": risk_daily,
    "normalize": lambda s, d: S.normalize(_values(s, d), S.percentiles(_values(s, d))).select("series_key", "date", "indicator", "value"),
    "percentiles_merged": lambda s, d: S.merged_percentiles(S.percentile_sketches(_event_values(s, d))),
    "numeric_details": _numeric,
    "percentiles": lambda s, d: S.percentiles(_values(s, d)).select("series_key", "indicator", rounded(F.col("p5"), 6).alias("p5"), rounded(F.col("p95"), 6).alias("p95"), "n"),
    "score": _scores,
    "score_details": lambda s, d: _details(s, d).select("series_key", "date", "indicator", "skipped", "value", rounded(F.col("used_weight"), 4).alias("used_weight"), rounded(F.col("contribution"), 4).alias("contribution"), "rebalanced"),
    "drivers": lambda s, d: S.drivers(_details(s, d)),
    "attribution": lambda s, d: S.attribution(_details(s, d), _scores(s, d).drop("risk_level", "rebalanced")),
    "change_attribution": _change,
    "history_change": lambda s, d: S.history_change(history(s, d)),
    "half_means": lambda s, d: S.half_means(history(s, d), KEYS).select("series_key", "half", "rows", rounded(F.col("score"), 4).alias("score"), *[rounded(F.col(k), 4).alias(k) for k in KEYS], "first", "last"),
    "daily_fusion": _fusion,
    "single_text_score": _single,
    "analysis_record": _records,
    "result_rollup": _rolled,
    "risk_levels": lambda s, d: history(s, d).select("series_key", "date", banded(F.col("risk_score"), params.RISK_BANDS).alias("level")),
    "daily_conflict": lambda s, d: table(s, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count_if(F.col("event_type") == "error").alias("conflicts"), rounded(F.avg((F.col("event_type") == "error").cast("double")), 4).alias("frequency"), rounded(1 - F.avg(F.coalesce(F.when(F.col("event_id") % 5 > 0, F.col("value") / 500), F.lit(0.5))), 4).alias("negativity")),
    "sentiment_summary": lambda s, d: table(s, d, "events").groupBy("event_type").agg(rounded(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), rounded(F.stddev_pop("value"), 4).alias("sd"), F.count(F.lit(1)).alias("n")),
    "macro_norm": lambda s, d: _macro(s, d).select("k", *[c.alias(n) for n, c in S.macro_norms(F.col("growth"), F.col("per_capita"), F.col("inflation"), F.col("trade")).items()]),
    "displacement": lambda s, d: _macro(s, d).select("k", S.displacement(F.col("growth"), F.when(F.col("k") % 4 > 0, F.col("inflation"))).alias("displacement")),
    "activity_proxy": lambda s, d: _macro(s, d).select("k", S.activity_proxy(F.when(F.col("k") % 5 > 0, F.col("trade")), F.when(F.col("k") % 3 > 0, F.col("inflation"))).alias("activity")),
}

ORACLES = {
    "analysis_record": RECORDS,
    "result_rollup": ROLLED,
    "risk_daily": f"SELECT series_key, date, risk_score, risk_level, rebalanced, ma FROM (SELECT *, {R('avg(risk_score) OVER (PARTITION BY series_key ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 4)} AS ma, row_number() OVER (PARTITION BY series_key ORDER BY date) AS r FROM ({SCORED})) WHERE r >= 7",
    "normalize": NORM,
    "numeric_details": f"SELECT event_type, 'value' AS indicator, count(value) AS n, {R('sum(value)')} AS total FROM events GROUP BY 1 UNION ALL SELECT event_type, 'k', count(*), {R('sum(k)')} FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k IS NOT NULL GROUP BY 1",
    "percentiles": f"SELECT series_key, indicator, {R('quantile_cont(value, 0.05)', 6)} AS p5, {R('quantile_cont(value, 0.95)', 6)} AS p95, count(value) AS n FROM ({LONG}) GROUP BY 1, 2",
    "score": SCORED,
    "score_details": f"SELECT series_key, date, indicator, skipped, value, {R('used_weight', 4)} AS used_weight, {R('contribution', 4)} AS contribution, rebalanced FROM ({DETAILS})",
    "drivers": DRIVERS,
    "attribution": ATTRIBUTION,
    "change_attribution": CHANGE,
    "history_change": HISTORY_CHANGE,
    "half_means": f"SELECT series_key, half, rows, {R('score', 4)} AS score, {', '.join(f'{R(k, 4)} AS {k}' for k in KEYS)}, first, last FROM ({HALVES})",
    "daily_fusion": FUSION,
    "single_text_score": SINGLE,
    "risk_levels": f"SELECT series_key, date, {bands_sql('risk_score', params.RISK_BANDS)} AS level FROM ({HISTORY})",
    "daily_conflict": f"SELECT CAST(ts AS DATE) AS date, count(*) FILTER (event_type = 'error') AS conflicts, {R('''avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END)''', 4)} AS frequency, {R('1 - avg(CASE WHEN event_id % 5 > 0 THEN value / 500 ELSE 0.5 END)', 4)} AS negativity FROM events GROUP BY 1",
    "sentiment_summary": f"SELECT event_type, {R('avg(value)', 4)} AS mean, min(value) AS low, max(value) AS high, {R('stddev_pop(value)', 4)} AS sd, count(*) AS n FROM events GROUP BY 1",
    "macro_norm": f"SELECT k, {R(C('(growth + 10) / 25'), 4)} AS gdp_growth_norm, {R(C('per_capita / 2000'), 4)} AS gdp_per_capita_norm, {R(C('(30 - inflation) / 35'), 4)} AS inflation_norm, {R(C('trade / 100'), 4)} AS trade_change_norm FROM ({MACRO})",
    "displacement": f"SELECT k, {R(C(f'0.6 + 0.4 * least(1.0, {_DIST})'), 4)} AS displacement FROM (SELECT k, coalesce(growth, 0) AS g, coalesce(CASE WHEN k % 4 > 0 THEN inflation END, 10) AS i FROM ({MACRO}))",
    "activity_proxy": f"SELECT k, {R(f'CASE WHEN l IS NOT NULL THEN 0.7 * a + 0.3 * ' + C('(25 - l) / 20') + ' ELSE a END', 4)} AS activity FROM (SELECT k, CASE WHEN k % 5 > 0 AND trade IS NOT NULL THEN {C('0.1 + 0.8 * trade / 100', 0.05, 0.95)} ELSE 0.5 END AS a, CASE WHEN k % 3 > 0 THEN inflation END AS l FROM ({MACRO}))",
}
