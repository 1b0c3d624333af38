"""Queries that run as streams over the landed events and give what the batch forms give."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.num import rounded
from riskloom.functions.text import canonical_url
from riskloom.operators import alerts as A
from riskloom.plans import q_events as QE
from riskloom.plans.bindings import R
from riskloom.session import shared_folder, table
from riskloom.streaming import jobs, state

LATE = "60 days"  # the landed events may come in any order


def _folder(s) -> str:
    return f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"


def _stream(s, d) -> DataFrame:
    return jobs.timed(s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/event[s].parquet"))  # a pattern, as the table may be a file or a folder


def _finished(s, df: DataFrame, mode: str) -> DataFrame:
    """The result of a stream over all that is there."""
    folder = _folder(s)
    if mode == "complete":
        query = jobs.complete(df, f"{folder}/out", f"{folder}/log")
        return s.read.parquet(f"{folder}/out/batch={query.lastProgress['batchId']}")
    jobs.run_available(df, f"{folder}/out", f"{folder}/log")
    return s.read.schema(df.schema).parquet(f"{folder}/out")


def daily(s, d):
    """Daily metrics of each event type over tumbling windows."""
    out = jobs.daily(_stream(s, d), "event_type", [F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")], late=LATE)
    return _finished(s, out, "complete").select("event_type", F.to_date("start").alias("date"), "n", rounded(F.col("mean"), 2).alias("mean"))


def rolling(s, d):
    """Counts over the last seven days, by day."""
    out = jobs.daily(_stream(s, d), "event_type", [F.count(F.lit(1)).alias("n")], late=LATE, size="7 days", slide="1 day")
    return _finished(s, out, "complete").select("event_type", F.to_date("start").alias("date"), "n")


def dedup(s, d):
    """One row for each URL of the stream."""
    named = _stream(s, d).withColumn("url", F.concat(F.lit("http://x/"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "/").otherwise("")))
    return _finished(s, jobs.dedup_urls(named, late=LATE).select("url"), "append").select(canonical_url(F.col("url")).alias("url"))


def alerts(s, d):
    """Alerts of single events' values over 60."""
    scored = _stream(s, d).select(F.col("event_id").alias("series_key"), "ts", rounded(F.col("value") / 5, 2).alias("risk_score"))
    return _finished(s, jobs.threshold_alerts(scored), "append").select("series_key", "risk_score", "level")


def _landed(s, df: DataFrame, folder: str) -> DataFrame:
    """df landed as files, and read as a stream."""
    df.write.parquet(folder)
    return s.readStream.schema(df.schema).parquet(folder)


def changes(s, d):
    """Alerts of hourly scores whose level changes, from keyed state."""
    state.use_rocksdb(s)
    scores = _landed(s, QE.scores(s, d), f"{_folder(s)}/in")
    return _finished(s, state.level_changes(scores, late=LATE), "append").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def acknowledged(s, d):
    """Red alerts as the stream of their acknowledgements meets them."""
    state.use_rocksdb(s)
    log, folder = A.alerts(QE.scores(s, d)).select("id", "level", "ts"), _folder(s)
    acks = log.filter("level = 'red'").select("id", (F.col("ts") + F.expr("interval 1 hour")).alias("acknowledged_at"))
    out = state.acknowledged(_landed(s, log, f"{folder}/alerts"), _landed(s, acks, f"{folder}/acks"), late=LATE)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _finished(s, out, "append").select("id", stamp("ts"), stamp("acknowledged_at"))


QUERIES = {"stream_daily": daily, "stream_rolling": rolling, "stream_dedup": dedup, "stream_alerts": alerts, "stream_alert_changes": changes, "stream_acknowledge": acknowledged}
ORACLES = {
    "stream_daily": f"SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS n, {R('avg(value)')} AS mean FROM events GROUP BY 1, 2",
    "stream_rolling": "SELECT event_type, CAST(CAST(ts AS DATE) - CAST(k AS INT) AS DATE) AS date, count(*) AS n FROM events CROSS JOIN (SELECT unnest(range(0, 7)) AS k) GROUP BY 1, 2",
    "stream_dedup": "SELECT DISTINCT 'http://x/' || user_id AS url FROM events",
    "stream_alert_changes": QE.ORACLES["alert_changes"],
    "stream_acknowledge": f"SELECT id, ts, acknowledged_at FROM ({QE.ORACLES['alert_acknowledge']}) WHERE acknowledged",
    "stream_alerts": f"SELECT event_id AS series_key, {R('value / 5')} AS risk_score, CASE WHEN {R('value / 5')} >= 80 THEN 'red' WHEN {R('value / 5')} >= 60 THEN 'orange' ELSE 'yellow' END AS level FROM events WHERE {R('value / 5')} >= 40",
}
