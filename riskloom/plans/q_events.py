"""Queries of coded events, filters over them, and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import events as E
from riskloom.functions import params
from riskloom.functions import text as T
from riskloom.functions.num import banded, rounded
from riskloom.operators import alerts as A
from riskloom.operators import clean
from riskloom.plans.bindings import ARTICLES, CODED, R, articles, bands_sql
from riskloom.session import table


def coded(df: DataFrame) -> DataFrame:
    """Raw articles with severity, tone and places worked out."""
    return df.withColumn("sev", E.severity(F.col("themes"))).withColumn("t", E.tone(F.col("tone"))).withColumn("locs", E.locations(F.col("locations")))


def normalized(df: DataFrame, as_of) -> DataFrame:
    """Raw articles as event articles; those without a title drop out."""
    c = coded(df).filter(T.given(F.col("title")) != "")
    return c.select("ingest_seq", "title", F.col("url"), E_date(as_of).alias("pub_date"), T.any_cjk_language(F.col("title")).alias("language"), F.col("t.normalized_score").alias("tone"), F.col("sev.max_severity").alias("severity"), F.array_join("sev.event_categories", ",").alias("categories"), F.size("locs").alias("n_places"))


def E_date(as_of):
    return T.compact_date(F.col("seendate"), as_of)


def event_metrics(df: DataFrame, *by: str) -> DataFrame:
    """n, conflict count and frequency, mean tone risk, mean and largest severity, in one aggregate."""
    c = coded(df)
    return c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("sev.has_conflict").alias("conflict_count"), rounded(F.avg(F.col("sev.has_conflict").cast("double")), 4).alias("conflict_frequency"),
        rounded(F.avg("t.risk_score"), 4).alias("avg_tone_risk"), rounded(F.avg("sev.max_severity"), 4).alias("avg_severity"), F.max("sev.max_severity").alias("max_severity"),
    )


def with_defaults(spine: DataFrame, metrics: DataFrame, *by: str) -> DataFrame:
    """metrics on a spine; days without articles have the fixed defaults."""
    fill = {"n": 0, "conflict_count": 0, "conflict_frequency": 0.0, "avg_tone_risk": 0.5, "avg_severity": 0.0, "max_severity": 0.0}
    return spine.join(metrics, list(by), "left").fillna(fill)


METRICS = f"""SELECT series_key, date, count(*) AS n, count(*) FILTER (has_conflict) AS conflict_count, {R('avg(CASE WHEN has_conflict THEN 1.0 ELSE 0.0 END)', 4)} AS conflict_frequency,
  {R(f"avg({R('1 - norm', 4)})", 4)} AS avg_tone_risk, {R('avg(CAST(severity AS DOUBLE))', 4)} AS avg_severity, CAST(max(severity) AS DOUBLE) AS max_severity FROM ({CODED}) GROUP BY 1, 2"""


def hist_events(s, d):
    """Orders as historical events: type by priority, severity 1..5, actors, place."""
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("event_type"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("severity"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of a customer with a long description")).alias("description"))


HIST = "SELECT o_orderkey AS seq, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS event_type, CAST(o_orderkey % 5 + 1 AS INT) AS severity, 'order ' || o_orderkey || ' of a customer with a long description' AS description FROM orders"


def filter_events(df: DataFrame, event_type: str | None = None, severity_min: int = 0, year: int | None = None) -> DataFrame:
    """Events by type, least severity and year, each optional."""
    if event_type is not None:
        df = df.filter(F.col("event_type") == event_type)
    if severity_min > 0:
        df = df.filter(F.col("severity") >= severity_min)
    return df if year is None else df.filter(F.year("date") == year)


def event_stats(df: DataFrame) -> DataFrame:
    """Total, by type and by year in one pass: (level, event_type, year, n, avg_severity)."""
    return df.sparkSession.sql(
        """SELECT CASE WHEN grouping(event_type) = 0 THEN 'type' WHEN grouping(year) = 0 THEN 'year' ELSE 'all' END AS level, event_type, year, count(*) AS n, avg(severity) AS s
        FROM (SELECT event_type, year(date) AS year, severity FROM {df}) GROUP BY GROUPING SETS ((), (event_type), (year))""",
        df=df,
    ).select("level", "event_type", "year", "n", rounded(F.col("s"), 2).alias("avg_severity"))


def markers(df: DataFrame, least: int = 4, most: int = 20) -> DataFrame:
    """Severe events in input order as chart markers."""
    return df.filter(F.col("severity") >= least).orderBy("seq").limit(most).select("seq", "date", (F.col("severity") * 15).alias("y"), F.when(F.col("severity") >= 5, "red").otherwise("orange").alias("color"), F.substring("description", 1, 30).alias("label"))


def scores(s, d):
    """Hourly mean value by event type as alert input."""
    return table(s, d, "events").groupBy(F.col("event_type").alias("series_key"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(rounded(F.avg("value"), 2).alias("risk_score"))


SCORES = f"SELECT event_type AS series_key, date_trunc('hour', ts) AS ts, {R('avg(value)')} AS risk_score FROM events GROUP BY 1, 2"
ALERTS = f"SELECT md5(series_key || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || CAST(CAST(risk_score AS DECIMAL(28,4)) AS VARCHAR)) AS id, series_key, ts, risk_score, {bands_sql('risk_score', params.ALERT_BANDS)} AS level FROM ({SCORES}) WHERE risk_score >= 40"
END = "TIMESTAMP '2024-01-20 00:00:00'"


def _end():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


def _text(df: DataFrame, at: str = "ts") -> DataFrame:
    return df.withColumn(at, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"

QUERIES = {
    "tone": lambda s, d: coded(articles(s, d)).select("ingest_seq", F.col("t.tone_score").alias("tone_score"), F.col("t.normalized_score").alias("normalized_score"), F.col("t.risk_score").alias("risk_score")),
    "severity": lambda s, d: coded(articles(s, d)).select("ingest_seq", F.col("sev.max_severity").alias("severity"), F.col("sev.has_conflict").alias("conflict"), F.col("sev.has_unrest").alias("unrest"), F.col("sev.has_diplomacy").alias("diplomacy"), F.array_join("sev.event_categories", ",").alias("categories")),
    "locations": lambda s, d: coded(articles(s, d)).select("ingest_seq", F.inline("locs")),
    "article_normalize": lambda s, d: normalized(articles(s, d), F.lit("2024-02-01").cast("date")),
    "risk_sentiment": lambda s, d: _sentiment(s, d),
    "event_metrics": lambda s, d: event_metrics(articles(s, d), "series_key", "date"),
    "event_metrics_daily": lambda s, d: _spined(s, d),
    "category_histogram": lambda s, d: coded(articles(s, d)).select(F.explode("sev.event_categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category"),
    "top_places": lambda s, d: coded(articles(s, d)).select(F.explode("locs.name").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "place").limit(10),
    "dedup_url": lambda s, d: clean.dedup_url(articles(s, d)).select("ingest_seq", "url"),
    "article_query": lambda s, d: clean.query_articles(articles(s, d).withColumn("language", T.any_cjk_language(F.col("title"))), F.lit("2024-01-10").cast("date"), language="en", most=100).select("ingest_seq", "date"),
    "latest_snapshot": lambda s, d: _latest(s, d),
    "event_filter": lambda s, d: filter_events(hist_events(s, d), "1-URGENT", 4, 1996).select("seq", "date", "severity"),
    "event_timeline": lambda s, d: filter_events(hist_events(s, d), severity_min=4).orderBy(F.desc("date"), F.desc("seq")).limit(15).select("seq", "date", "event_type", "severity"),
    "event_stats": lambda s, d: event_stats(hist_events(s, d)),
    "event_markers": lambda s, d: markers(hist_events(s, d)),
    "alerts": lambda s, d: _text(A.alerts(scores(s, d))),
    "alert_levels": lambda s, d: scores(s, d).select(banded(F.col("risk_score"), params.ALERT_BANDS).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n")),
    "alert_changes": lambda s, d: _text(A.level_changes(scores(s, d))),
    "alert_retention": lambda s, d: _text(A.retained(A.alerts(scores(s, d)))),
    "alert_status": lambda s, d: _text(A.status(A.alerts(scores(s, d)), _end()), "latest_at"),
    "alert_acknowledge": lambda s, d: _ack(s, d),
    "alert_thresholds": lambda s, d: scores(s, d).select("series_key").distinct().join(F.broadcast(s.createDataFrame([(n, v) for v, n in params.ALERT_BANDS if v != float("-inf")], "line string, threshold double"))),
    "recent_alert_count": lambda s, d: _rolling(s, d),
}


def _sentiment(s, d):
    c = coded(articles(s, d)).withColumn("tone_or_none", F.when(F.col("ingest_seq") % 3 > 0, F.col("t.normalized_score")))
    return c.select("ingest_seq", F.inline(F.array(T.risk_sentiment(T.lexicon_sentiment(F.col("title")), F.col("tone_or_none"), F.lit("en")))))


def _spined(s, d):
    a = articles(s, d)
    days = a.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", F.date_add("b", 2))).alias("date"))
    return with_defaults(a.select("series_key").distinct().join(F.broadcast(days)), event_metrics(a, "series_key", "date"), "series_key", "date")


def _latest(s, d):
    from riskloom.sources.io import latest_per_source

    return latest_per_source(articles(s, d), "series_key", "date").groupBy("series_key").agg(F.max("date").alias("date"), F.count(F.lit(1)).alias("n"))


def _ack(s, d):
    log = A.alerts(scores(s, d))
    acks = log.filter("level = 'red'").select("id", F.expr("ts + interval 1 hour").alias("acknowledged_at")).unionAll(log.filter("level = 'red'").select("id", F.expr("ts + interval 2 hours").alias("acknowledged_at")))
    return _text(_text(A.acknowledge(log, acks)).select("id", "ts", "acknowledged", "acknowledged_at"), "acknowledged_at")


def _rolling(s, d):
    return _text(A.trailing_counts(A.alerts(scores(s, d)).select("series_key", "ts")))


ORACLES = {
    "tone": f"SELECT ingest_seq, {R('''CAST(split_part(tone, ',', 1) AS DOUBLE)''')} AS tone_score, {R('norm', 4)} AS normalized_score, {R('1 - norm', 4)} AS risk_score FROM ({CODED})",
    "severity": f"SELECT ingest_seq, CAST(severity AS DOUBLE) AS severity, has_conflict AS conflict, has_unrest AS unrest, has_diplomacy AS diplomacy, array_to_string(categories, ',') AS categories FROM ({CODED})",
    "locations": f"SELECT ingest_seq, place AS name, CAST(9.5 + (nk * 7) % 19 AS DOUBLE) AS lat, CAST(92 + (nk * 5) % 10 AS DOUBLE) AS lon, '4' AS type, upper(substring(place, 1, 2)) AS country_code FROM ({ARTICLES})",
    "article_normalize": f"SELECT ingest_seq, title, url, date AS pub_date, 'en' AS language, {R('norm', 4)} AS tone, CAST(severity AS DOUBLE) AS severity, array_to_string(categories, ',') AS categories, CAST(1 AS INT) AS n_places FROM ({CODED})",
    "risk_sentiment": f"SELECT ingest_seq, sc AS sentiment_score, {R('1 - sc', 4)} AS risk_score, {bands_sql(R('1 - sc', 4), params.SENTIMENT_BANDS)} AS risk_level, src AS source FROM (SELECT ingest_seq, CASE WHEN ingest_seq % 3 > 0 THEN {R('norm', 4)} ELSE 0.5 END AS sc, CASE WHEN ingest_seq % 3 > 0 THEN 'gdelt' ELSE 'fallback' END AS src FROM ({CODED}))",
    "event_metrics": METRICS,
    "event_metrics_daily": f"SELECT k.series_key, d.date, coalesce(n, 0) AS n, coalesce(conflict_count, 0) AS conflict_count, coalesce(conflict_frequency, 0.0) AS conflict_frequency, coalesce(avg_tone_risk, 0.5) AS avg_tone_risk, coalesce(avg_severity, 0.0) AS avg_severity, coalesce(max_severity, 0.0) AS max_severity FROM (SELECT DISTINCT event_type AS series_key FROM events) k CROSS JOIN (SELECT CAST(unnest(generate_series(min(CAST(CAST(ts AS DATE) AS TIMESTAMP)), max(CAST(CAST(ts AS DATE) AS TIMESTAMP)) + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM events) d LEFT JOIN ({METRICS}) m ON m.series_key = k.series_key AND m.date = d.date",
    "category_histogram": f"SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM ({CODED})) GROUP BY 1",
    "top_places": f"SELECT place, count(*) AS n FROM ({ARTICLES}) GROUP BY 1 ORDER BY n DESC, place LIMIT 10",
    "dedup_url": f"SELECT ingest_seq, url FROM (SELECT *, row_number() OVER (PARTITION BY rtrim(url, '/') ORDER BY ingest_seq) AS r FROM ({ARTICLES})) WHERE r = 1",
    "article_query": f"SELECT ingest_seq, date FROM ({ARTICLES}) WHERE date >= DATE '2024-01-10' ORDER BY date DESC, ingest_seq LIMIT 100",
    "latest_snapshot": "SELECT series_key, date, n FROM (SELECT event_type AS series_key, CAST(ts AS DATE) AS date, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE) DESC) AS r FROM events GROUP BY 1, 2) WHERE r = 1",
    "event_filter": f"SELECT seq, date, severity FROM ({HIST}) WHERE event_type = '1-URGENT' AND severity >= 4 AND year(date) = 1996",
    "event_timeline": f"SELECT seq, date, event_type, severity FROM ({HIST}) WHERE severity >= 4 ORDER BY date DESC, seq DESC LIMIT 15",
    "event_stats": f"SELECT CASE WHEN grouping(event_type) = 0 THEN 'type' WHEN grouping(y) = 0 THEN 'year' ELSE 'all' END AS level, event_type, CAST(y AS INT) AS year, count(*) AS n, {R('avg(severity)')} AS avg_severity FROM (SELECT *, year(date) AS y FROM ({HIST})) GROUP BY GROUPING SETS ((), (event_type), (y))",
    "event_markers": f"SELECT seq, date, CAST(severity * 15 AS INT) AS y, CASE WHEN severity >= 5 THEN 'red' ELSE 'orange' END AS color, substring(description, 1, 30) AS label FROM ({HIST}) WHERE severity >= 4 ORDER BY seq LIMIT 20",
    "alerts": f"SELECT id, series_key, {STAMP.format('ts')} AS ts, risk_score, level FROM ({ALERTS})",
    "alert_levels": f"SELECT {bands_sql('risk_score', params.ALERT_BANDS)} AS level, count(*) AS n FROM ({SCORES}) GROUP BY 1",
    "alert_changes": f"SELECT id, series_key, {STAMP.format('ts')} AS ts, risk_score, level FROM ({ALERTS}) JOIN (SELECT series_key, ts, coalesce(lag(l) OVER (PARTITION BY series_key ORDER BY ts), 'green') AS before FROM (SELECT series_key, ts, {bands_sql('risk_score', params.ALERT_BANDS)} AS l FROM ({SCORES}))) USING (series_key, ts) WHERE level <> before",
    "alert_retention": f"SELECT id, series_key, {STAMP.format('ts')} AS ts, risk_score, level FROM (SELECT * FROM ({ALERTS}) ORDER BY ts DESC, id LIMIT 100)",
    "alert_status": f"SELECT series_key, coalesce(max(struct_pack(ts := ts, id := id, level := level)) FILTER (i).level, 'green') AS level, count(*) FILTER (i) AS alert_count, {STAMP.format('max(ts) FILTER (i)')} AS latest_at FROM (SELECT *, ts >= {END} - INTERVAL 24 HOUR AND ts <= {END} AS i FROM ({ALERTS})) GROUP BY 1",
    "alert_acknowledge": f"SELECT id, {STAMP.format('ts')} AS ts, level = 'red' AS acknowledged, CASE WHEN level = 'red' THEN {STAMP.format('ts + INTERVAL 1 HOUR')} END AS acknowledged_at FROM ({ALERTS})",
    "alert_thresholds": "SELECT DISTINCT event_type AS series_key, line, threshold FROM events CROSS JOIN (VALUES ('red', CAST(80 AS DOUBLE)), ('orange', CAST(60 AS DOUBLE)), ('yellow', CAST(40 AS DOUBLE))) t(line, threshold)",
    "recent_alert_count": f"SELECT series_key, {STAMP.format('ts')} AS ts, count(*) OVER (PARTITION BY series_key ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS n FROM ({ALERTS})",
}
