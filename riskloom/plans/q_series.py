"""Queries of time series and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import params
from riskloom.functions.num import banded, rounded
from riskloom.operators import align as AL
from riskloom.operators import timeseries as TS
from riskloom.plans.bindings import HISTORY, MONTHLY, SERIES, C, R, bands_sql, history, monthly, series
from riskloom.session import table

IDX = f"SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY series_key) AS n FROM ({SERIES})"
W = "OVER (PARTITION BY series_key ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
ALL = "OVER (PARTITION BY series_key)"
GAPS = f"SELECT series_key, date, CASE WHEN day(date) % 5 = 0 THEN NULL WHEN day(date) % 7 = 1 THEN 0.0 ELSE score END AS score FROM ({SERIES})"


def gaps(s, d):
    k = F.dayofmonth("date")
    return series(s, d).withColumn("score", F.when(k % 5 == 0, None).when(k % 7 == 1, 0.0).otherwise(F.col("score")))


_TREND = f"""SELECT series_key, date, score, idx, n, CASE WHEN idx < 2 THEN first_score WHEN idx = 2 THEN first_ma WHEN idx <= n - 4 THEN ahead ELSE last_ma END AS trend FROM (
  SELECT *, lead(ma, 3) OVER (PARTITION BY series_key ORDER BY date) AS ahead, first(score) OVER (PARTITION BY series_key ORDER BY date) AS first_score, max(ma) FILTER (idx = 6) {ALL} AS first_ma, max(ma) FILTER (idx = n - 1) {ALL} AS last_ma
  FROM (SELECT *, {R(f"avg(score) {W.format(6)}", 4)} AS ma FROM ({IDX})))"""
STL = f"""SELECT series_key, date, score, {R('trend', 4)} AS trend, {R('s', 4)} AS seasonal, {R('score - trend - s', 4)} AS residual FROM (SELECT *, season - avg(season) {ALL} AS s FROM (SELECT *, avg(score - trend) OVER (PARTITION BY series_key, idx % 7) AS season FROM ({_TREND})))"""
LINE = """SELECT series_key, count(*) AS n, coalesce(regr_slope(score, CAST(idx AS DOUBLE)), 0) AS slope, regr_intercept(score, CAST(idx AS DOUBLE)) AS intercept, CASE WHEN stddev_pop(score) > 0 THEN regr_r2(score, CAST(idx AS DOUBLE)) ELSE 0 END AS r2 FROM ({}) GROUP BY 1"""
TAIL = f"SELECT series_key, score, row_number() OVER (PARTITION BY series_key ORDER BY date) - 1 AS idx FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date DESC) AS back FROM ({SERIES})) WHERE back <= 14"
FORECAST = f"SELECT series_key, CAST(step AS INT) AS step, {C(R('slope * (n - 1 + step) + intercept'), 0.0, 100.0)} AS forecast, {R('slope', 6)} AS slope, {R('r2', 4)} AS r_squared, CASE WHEN r2 > 0.7 THEN '高' WHEN r2 > 0.4 THEN '中' ELSE '低' END AS confidence FROM ({LINE.format(TAIL)}) CROSS JOIN (SELECT unnest(range(1, 8)) AS step)"
FIRST = "max(score) FILTER (idx = {}) " + ALL
HALF = f"SELECT series_key, n, avg(score) FILTER (idx < 7) AS a, avg(score) FILTER (idx >= n - 7) AS b FROM ({IDX}) GROUP BY 1, 2"
WORD = "CASE WHEN n < 7 THEN '数据不足，无法判断趋势' WHEN b > a + 5 THEN '近期风险呈上升趋势' WHEN b < a - 5 THEN '近期风险呈下降趋势' ELSE '近期风险相对平稳' END"
MA = f"SELECT series_key, date, ma FROM (SELECT *, {R(f'avg(score) {W.format(6)}', 4)} AS ma FROM ({IDX})) WHERE idx >= 6"
LAST = f"SELECT series_key, max(date) AS date, arg_max(score, date) AS score FROM ({SERIES}) GROUP BY 1"
CHART = f"""SELECT s.series_key, s.date, 'actual' AS kind, s.score, ma FROM ({SERIES}) s LEFT JOIN ({MA}) m ON m.series_key = s.series_key AND m.date = s.date
UNION ALL SELECT series_key, date, 'bridge', score, NULL FROM ({LAST}) UNION ALL SELECT f.series_key, l.date + f.step, 'forecast', f.forecast, NULL FROM ({FORECAST}) f JOIN ({LAST}) l ON l.series_key = f.series_key"""


def _trend_frame(s, d):
    """The chart frame with threshold lines and markers."""
    frame = TS.chart_frame(series(s, d))
    marks = history(s, d).filter("risk_score > 50").groupBy("date").agg(F.count(F.lit(1)).alias("markers"))
    lines = [F.lit(v).alias(n) for v, n in params.ALERT_BANDS if v != float("-inf")]
    return frame.join(marks, "date", "left").select("series_key", "date", "kind", "score", "ma", F.coalesce("markers", F.lit(0)).alias("markers"), *lines)


def matrix(s, d):
    m = monthly(s, d)
    return AL.monthly_matrix(m["spine"], m["light"], m["conflicts"], m["sentiment"], m["events"])


MATRIX = f"""SELECT *, {R('coalesce(nightlight - lag(nightlight) OVER (PARTITION BY series_key ORDER BY month), 0)', 4)} AS nightlight_change FROM (SELECT p.series_key, p.month, coalesce(a.value, 0.5) AS nightlight, coalesce(b.value, 0) AS conflict_count, coalesce(c.value, 0.5) AS sentiment_avg, coalesce(e.value, 0) AS event_count
FROM ({MONTHLY['spine']}) p LEFT JOIN ({MONTHLY['light']}) a ON a.series_key = p.series_key AND a.month = p.month LEFT JOIN ({MONTHLY['conflicts']}) b ON b.series_key = p.series_key AND b.month = p.month LEFT JOIN ({MONTHLY['sentiment']}) c ON c.series_key = p.series_key AND c.month = p.month LEFT JOIN ({MONTHLY['events']}) e ON e.series_key = p.series_key AND e.month = p.month)"""
PAIRS = [("nightlight", "conflict_count"), ("nightlight_change", "sentiment_avg"), ("conflict_count", "event_count")]


def _corr(a: str, b: str) -> str:
    return f"SELECT series_key, '{a}~{b}' AS pair, {R(f'CASE WHEN count(*) >= 3 AND stddev_pop({a}) > 1e-12 AND stddev_pop({b}) > 1e-12 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) ELSE 0 END', 4)} AS r FROM ({MATRIX}) GROUP BY 1"


def annual(s, d):
    """Yearly shares of nations' lines, with nulls and NaN in some years."""
    y = table(s, d, "orders").select(F.col("o_orderstatus").alias("country"), F.col("o_orderpriority").alias("indicator"), F.year("o_orderdate").alias("year"), "o_totalprice").groupBy("country", "indicator", "year").agg(rounded(F.avg("o_totalprice") / 4000, 4).alias("value"))
    return y.withColumn("value", F.when(F.col("year") % 4 == 1, None).when(F.col("year") == 1998, F.lit(float("nan"))).otherwise(F.col("value")))


ANNUAL = f"SELECT country, indicator, year, CASE WHEN year % 4 = 1 OR year = 1998 THEN NULL ELSE v END AS value FROM (SELECT o_orderstatus AS country, o_orderpriority AS indicator, CAST(year(o_orderdate) AS INT) AS year, {R('avg(o_totalprice) / 4000', 4)} AS v FROM orders GROUP BY 1, 2, 3)"


def _interp(s, d):
    a = annual(s, d).filter(F.col("value").isNotNull() & ~F.isnan("value")).select(F.concat_ws("|", "country", "indicator").alias("series_key"), "year", "value")
    return TS.annual_to_monthly(a)


INTERP = f"SELECT series_key, make_date(year, m, 1) AS month, {R(C('0.1 + 0.8 * (value + (m - 1) / 12.0 * (nxt - value)) / 100', 0.05, 0.95), 4)} AS value FROM (SELECT *, lead(value) OVER (PARTITION BY series_key ORDER BY year) AS nxt FROM (SELECT country || '|' || indicator AS series_key, year, value FROM ({ANNUAL}) WHERE value IS NOT NULL)) CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INT) AS m) WHERE nxt IS NOT NULL"


def _snapshots(s, d):
    e = table(s, d, "events")
    snaps = e.select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("fetched_at"), "value").filter("value < 480")
    names = e.select(F.col("event_type").alias("source")).distinct()
    ttl = names.select("source", F.when(F.col("source") == "click", 60).otherwise(86400).alias("ttl"))
    last = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return AL.fresh_snapshots(snaps, ttl, last, names.select("source", F.lit(-1.0).alias("value"))).select("source", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "value", "fresh")


SNAP = """SELECT source, CASE WHEN fresh THEN strftime(t, '%Y-%m-%d %H:%M:%S') END AS fetched_at, CASE WHEN fresh THEN v ELSE -1.0 END AS value, fresh FROM (SELECT source, t, v, epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(t)) < ttl AS fresh FROM (SELECT event_type AS source, max(ts) FILTER (value < 480) AS t, arg_max(value, ts) FILTER (value < 480) AS v, CASE event_type WHEN 'click' THEN 60 ELSE 86400 END AS ttl FROM events GROUP BY 1))"""


def _report(s, d):
    """A row for each region: latest score and level, mean, trend, key events, forecast mean, and the sentence on them."""
    h = history(s, d).withColumn("score", F.col("risk_score"))
    one = TS.summary(h).join(TS.half_trend(h).select("series_key", "trend"), "series_key").join(TS.regression(h).select("series_key", F.col("trend").alias("slope_word")), "series_key")
    ahead = TS.forecast(h).groupBy("series_key").agg(rounded(F.avg("forecast"), 2).alias("forecast_mean"))
    key = h.filter("risk_score >= 60").groupBy("series_key").agg(F.count(F.lit(1)).alias("key_events"))
    df = one.join(ahead, "series_key").join(key, "series_key", "left")
    fixed = lambda c, p: F.round(F.col(c).cast("decimal(28,10)"), p).cast(f"decimal(28,{p})").cast("string")
    text = F.concat_ws(" ", F.concat(F.lit("当前风险综合评分为 "), fixed("latest", 2), F.lit(" 分，处于"), banded(F.col("latest"), params.RISK_BANDS), F.lit("水平。"), F.col("trend"), F.lit("。")), F.concat(F.lit("过去 "), F.col("n").cast("string"), F.lit(" 天的趋势分析显示风险"), F.col("slope_word"), F.lit("，未来7日均值预计 "), fixed("forecast_mean", 1), F.lit("。")))
    return df.select("series_key", "latest", banded(F.col("latest"), params.RISK_BANDS).alias("level"), "mean", "n", "trend", "slope_word", "forecast_mean", F.coalesce("key_events", F.lit(0)).alias("key_events"), text.alias("assessment"))


def _key_events(s, d):
    from riskloom.operators.clean import ranked

    h = history(s, d).filter("risk_score >= 50")
    return ranked(h, ["series_key"], [F.desc("date")], 10).select("series_key", "date", F.format_string("风险评分 %s", F.round(F.col("risk_score").cast("decimal(28,10)"), 1).cast("decimal(28,1)").cast("string")).alias("title"), F.when(F.col("risk_score") >= 80, "高").otherwise("中").alias("severity"))


def _metrics(s, d):
    h = history(s, d)
    last = h.groupBy("series_key").agg(F.max_by(F.struct(*params.WEIGHTS), "date").alias("m"))
    return last.select("series_key", F.inline(F.array(*[F.struct(F.lit(k).alias("indicator"), F.col(f"m.{k}").alias("value")) for k in params.WEIGHTS])))


HS = f"SELECT series_key, date, risk_score AS score FROM ({HISTORY})"
HIDX = IDX.replace(SERIES, HS)
HTAIL = TAIL.replace(SERIES, HS)
HFORE = FORECAST.replace(TAIL, HTAIL)
HLINE = LINE.format(HIDX)
TREND_WORD = "CASE WHEN n < 14 THEN '数据不足' WHEN slope > 0.005 THEN '上升' WHEN slope < -0.005 THEN '下降' ELSE '平稳' END"


def _dec(x: str, places: int) -> str:
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(28,10)), {places}) AS DECIMAL(28,{places})) AS VARCHAR)"


REPORT = f"""WITH a AS (SELECT series_key, arg_max(score, date) AS latest, {R('avg(score)', 4)} AS mean, count(*) AS n FROM ({HS}) GROUP BY 1), b AS (SELECT series_key, {WORD} AS trend FROM ({HALF.replace(IDX, HIDX)})), c AS (SELECT series_key, {TREND_WORD} AS slope_word FROM ({HLINE})),
f AS (SELECT series_key, {R('avg(forecast)')} AS forecast_mean FROM ({HFORE}) GROUP BY 1), k AS (SELECT series_key, count(*) AS key_events FROM ({HS}) WHERE score >= 60 GROUP BY 1)
SELECT series_key, latest, {bands_sql('latest', params.RISK_BANDS)} AS level, mean, n, trend, slope_word, forecast_mean, coalesce(key_events, 0) AS key_events, '当前风险综合评分为 ' || {_dec('latest', 2)} || ' 分，处于' || {bands_sql('latest', params.RISK_BANDS)} || '水平。' || trend || '。 过去 ' || n || ' 天的趋势分析显示风险' || slope_word || '，未来7日均值预计 ' || {_dec('forecast_mean', 1)} || '。' AS assessment FROM a JOIN b USING (series_key) JOIN c USING (series_key) JOIN f USING (series_key) LEFT JOIN k USING (series_key)"""

QUERIES = {
    "moving_avg": lambda s, d: TS.moving_average(series(s, d)),
    "weighted_ma": lambda s, d: TS.weighted_moving_average(series(s, d)),
    "stl": lambda s, d: TS.decompose(series(s, d)),
    "anomalies": lambda s, d: TS.anomalies(series(s, d)),
    "ols": lambda s, d: TS.regression(series(s, d)),
    "forecast": lambda s, d: TS.forecast(series(s, d)),
    "fill_missing": lambda s, d: TS.fill_missing(gaps(s, d)),
    "fill_linear": lambda s, d: TS.fill_missing(gaps(s, d), linear=True),
    "last_rows": lambda s, d: TS.last_rows(series(s, d), 7),
    "half_trend": lambda s, d: TS.half_trend(series(s, d)),
    "series_summary": lambda s, d: TS.summary(series(s, d)),
    "weekly_mean": lambda s, d: series(s, d).groupBy("series_key", F.to_date(F.date_trunc("week", "date")).alias("week")).agg(rounded(F.avg("score"), 2).alias("score")),
    "chart_frame": lambda s, d: TS.chart_frame(series(s, d)),
    "trend_frame": _trend_frame,
    "monthly_conflict": lambda s, d: history(s, d).groupBy("series_key", F.trunc("date", "MM").alias("month")).agg(F.count_if(F.col("conflict_frequency") > 0.2).alias("days"), rounded(F.avg(F.coalesce("sentiment_avg", F.lit(0.5))), 4).alias("sentiment")),
    "align_monthly": matrix,
    "month_change": lambda s, d: TS.month_change(monthly(s, d)["light"], "value", "change"),
    "pearson": lambda s, d: AL.correlations(matrix(s, d), PAIRS),
    "latest_annual": lambda s, d: AL.latest_values(annual(s, d)),
    "interp_monthly": _interp,
    "fresh_snapshots": _snapshots,
    "report_context": _report,
    "key_events": _key_events,
    "report_metrics": _metrics,
}

ORACLES = {
    "moving_avg": f"SELECT series_key, date, score, ma FROM (SELECT *, {R(f'avg(score) {W.format(6)}', 4)} AS ma FROM ({IDX})) WHERE idx >= 6",
    "weighted_ma": f"SELECT series_key, date, score, {R('(' + ' + '.join(f'lag(score, {k}) OVER w * {7 - k}' for k in range(1, 7)) + ' + score * 7) / 28.0', 4)} AS wma FROM ({IDX}) WINDOW w AS (PARTITION BY series_key ORDER BY date) QUALIFY idx >= 6",
    "stl": STL,
    "anomalies": f"SELECT series_key, date, idx, score, {R('z', 4)} AS z, CASE WHEN z > 0 THEN 'peak' ELSE 'trough' END AS kind FROM (SELECT *, (score - avg(score) {ALL}) / nullif(stddev_pop(score) {ALL}, 0) AS z FROM ({IDX})) WHERE n >= 3 AND abs(z) > 2",
    "ols": f"SELECT series_key, n, {R('CASE WHEN n >= 14 THEN slope ELSE 0 END', 6)} AS slope, {R('CASE WHEN n >= 14 THEN intercept ELSE 0 END', 4)} AS intercept, {R('CASE WHEN n >= 14 THEN r2 ELSE 0 END', 4)} AS r_squared, {TREND_WORD} AS trend FROM ({LINE.format(IDX)})",
    "forecast": FORECAST,
    "fill_missing": f"SELECT series_key, date, score, {R('CASE WHEN idx = 0 AND score IS NULL THEN lead(f) OVER (PARTITION BY series_key ORDER BY date) ELSE f END')} AS filled FROM (SELECT *, coalesce(last_value(nullif(score, 0) IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS f, row_number() OVER (PARTITION BY series_key ORDER BY date) - 1 AS idx FROM ({GAPS}))",
    "fill_linear": f"""SELECT series_key, date, score, {R('coalesce(k, a + (b - a) * (CAST(idx - ai AS DOUBLE) / nullif(bi - ai, 0)), a, b)')} AS filled FROM (SELECT *, last_value(k IGNORE NULLS) OVER p AS a, last_value(ki IGNORE NULLS) OVER p AS ai, first_value(k IGNORE NULLS) OVER q AS b, first_value(ki IGNORE NULLS) OVER q AS bi FROM (SELECT *, CASE WHEN k IS NOT NULL THEN idx END AS ki FROM (SELECT *, nullif(score, 0) AS k, row_number() OVER (PARTITION BY series_key ORDER BY date) - 1 AS idx FROM ({GAPS})))
        WINDOW p AS (PARTITION BY series_key ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY series_key ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "last_rows": f"SELECT series_key, date, score FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date DESC) AS r FROM ({SERIES})) WHERE r <= 7",
    "half_trend": f"SELECT series_key, {R('a', 4)} AS first_avg, {R('b', 4)} AS last_avg, {WORD} AS trend FROM ({HALF})",
    "series_summary": f"SELECT series_key, arg_max(score, date) AS latest, {R('avg(score)', 4)} AS mean, count(*) AS n FROM ({SERIES}) GROUP BY 1",
    "weekly_mean": f"SELECT series_key, CAST(date_trunc('week', date) AS DATE) AS week, {R('avg(score)')} AS score FROM ({SERIES}) GROUP BY 1, 2",
    "chart_frame": CHART,
    "trend_frame": f"SELECT series_key, f.date, kind, score, ma, coalesce(markers, 0) AS markers, CAST(80 AS DOUBLE) AS red, CAST(60 AS DOUBLE) AS orange, CAST(40 AS DOUBLE) AS yellow FROM ({CHART}) f LEFT JOIN (SELECT date, count(*) AS markers FROM ({HISTORY}) WHERE risk_score > 50 GROUP BY 1) m ON m.date = f.date",
    "monthly_conflict": f"SELECT series_key, CAST(date_trunc('month', date) AS DATE) AS month, count(*) FILTER (conflict_frequency > 0.2) AS days, {R('avg(coalesce(sentiment_avg, 0.5))', 4)} AS sentiment FROM ({HISTORY}) GROUP BY 1, 2",
    "align_monthly": MATRIX,
    "month_change": f"SELECT series_key, month, value, {R('coalesce(value - lag(value) OVER (PARTITION BY series_key ORDER BY month), 0)', 4)} AS change FROM ({MONTHLY['light']})",
    "pearson": " UNION ALL ".join(_corr(a, b) for a, b in PAIRS),
    "latest_annual": f"SELECT country, indicator, CAST(max(year) AS INT) AS year, arg_max(value, year) AS value FROM (SELECT *, dense_rank() OVER (PARTITION BY country, indicator ORDER BY year DESC) AS r FROM ({ANNUAL})) WHERE r <= 5 AND value IS NOT NULL GROUP BY 1, 2",
    "interp_monthly": INTERP,
    "fresh_snapshots": SNAP,
    "report_context": REPORT,
    "key_events": f"SELECT series_key, date, '风险评分 ' || {_dec('risk_score', 1)} AS title, CASE WHEN risk_score >= 80 THEN '高' ELSE '中' END AS severity FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date DESC) AS r FROM ({HISTORY}) WHERE risk_score >= 50) WHERE r <= 10",
    "report_metrics": " UNION ALL ".join(f"SELECT series_key, '{k}' AS indicator, arg_max({k}, date) AS value FROM ({HISTORY}) GROUP BY 1" for k in params.WEIGHTS),
}
