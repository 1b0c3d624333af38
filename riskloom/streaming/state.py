"""Keyed state with timers: alerts on changes of level, and acknowledgements that meet their alerts.

State is one row a key and goes with its timer, so it is bounded by the keys seen within `idle`. These need the RocksDB
state store, which keeps state outside the heap and in the checkpoint; use_rocksdb() sets it for a session.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from riskloom.functions import params

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class _Timed(StatefulProcessor):
    """One value a key, which goes `idle` after its time unless it is renewed. Times are microseconds."""

    def __init__(self, schema: StructType, idle: dt.timedelta):
        self.schema, self.idle = schema, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def keep(self, value: tuple, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.held.update(value)
        self.handle.registerTimer(at // 1000 + int(self.idle.total_seconds() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


class _Changes(_Timed):
    """Rows whose level differs from that of the key's row before; rows that aren't later than it are late and left out."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        level, last = self.held.get() if self.held.exists() else ("green", None)
        out = []
        for r in sorted(rows, key=lambda r: r.t):
            if last is not None and r.t <= last:
                continue
            if last is not None and r.t - last > self.idle.total_seconds() * 1_000_000:
                level = "green"
            if r.level != level and r.level != "green":
                out.append(Row(id=r.id, by=r.by, t=r.t, score=r.score, level=r.level))
            level, last = r.level, r.t
        if last is not None:
            self.keep((level, last), last)
        return iter(out)


def level_changes(stream: DataFrame, by: str = "series_key", at: str = "ts", score: str = "risk_score", bands=params.ALERT_BANDS, late: str = "1 hour", idle: dt.timedelta = dt.timedelta(days=30)) -> DataFrame:
    """The stream form of alerts.level_changes(): alerts whose level differs from that of the series' score before.

    Scores of a batch are taken by time. A series without a score for `idle` is forgotten and starts at green again.
    """
    from riskloom.functions.num import banded

    key = F.md5(F.concat_ws("|", F.col(by).cast("string"), F.col(at).cast("string"), F.col(score).cast("decimal(28,4)").cast("string")))
    rows = stream.select(key.alias("id"), F.col(by).alias("by"), F.unix_micros(at).alias("t"), F.col(score).alias("score"), banded(F.col(score), bands).alias("level"))
    schema = StructType([StructField("level", StringType()), StructField("last", LongType())])
    timed = rows.withColumn("at", F.timestamp_micros("t")).withWatermark("at", late)
    out = timed.groupBy("by").transformWithState(_Changes(schema, idle), rows.schema, "Append", "EventTime")
    return out.select("id", F.col("by").alias(by), F.timestamp_micros("t").alias(at), F.col("score").alias(score), "level")


class _Acknowledged(_Timed):
    """An alert meets its first acknowledgement, whichever comes first; the pair is given once."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        level, alert_at, acked_at, told = self.held.get() if self.held.exists() else (None, None, None, None)
        newest = None
        for r in rows:
            newest = r.t if newest is None else max(newest, r.t)
            if r.level is not None:
                level, alert_at = r.level, r.t
            else:
                acked_at = r.t if acked_at is None else min(acked_at, r.t)
        out = []
        if alert_at is not None and acked_at is not None and told is None:
            told = "yes"
            out.append(Row(id=key[0], level=level, alert_at=alert_at, acked_at=acked_at))
        self.keep((level, alert_at, acked_at, told), newest)
        return iter(out)


def acknowledged(alerts: DataFrame, acks: DataFrame, late: str = "1 hour", idle: dt.timedelta = dt.timedelta(days=30)) -> DataFrame:
    """(id, level, ts, acknowledged_at) of a stream of alerts (id, level, ts) as a stream of acknowledgements (id, acknowledged_at) meets them.

    Of a batch's acknowledgements the first counts; a pair is given once, and forgotten after `idle`.
    """
    both = alerts.select("id", F.col("ts").alias("at"), "level").unionByName(acks.select("id", F.col("acknowledged_at").alias("at"), F.lit(None).cast("string").alias("level")))
    times = [StructField("alert_at", LongType()), StructField("acked_at", LongType())]
    schema = StructType([StructField("level", StringType()), *times, StructField("told", StringType())])
    told = StructType([StructField("id", StringType()), StructField("level", StringType()), *times])
    timed = both.withColumn("t", F.unix_micros("at")).withWatermark("at", late)
    out = timed.groupBy("id").transformWithState(_Acknowledged(schema, idle), told, "Append", "EventTime")
    return out.select("id", "level", F.timestamp_micros("alert_at").alias("ts"), F.timestamp_micros("acked_at").alias("acknowledged_at"))
