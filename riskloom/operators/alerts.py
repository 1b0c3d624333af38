"""Threshold alerts on scores, their retention, status and acknowledgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import params
from riskloom.functions.num import banded


def alerts(scores: DataFrame, by: str = "series_key", at: str = "ts", score: str = "risk_score", bands=params.ALERT_BANDS) -> DataFrame:
    """(id, by, at, score, level) of scores above green; the id is a hash of the three, so re-runs give the same."""
    level = banded(F.col(score), bands)
    key = F.md5(F.concat_ws("|", F.col(by).cast("string"), F.col(at).cast("string"), F.col(score).cast("decimal(28,4)").cast("string")))
    return scores.withColumn("level", level).filter(F.col("level") != "green").select(key.alias("id"), by, at, score, "level")


def level_changes(scores: DataFrame, by: str = "series_key", at: str = "ts", score: str = "risk_score", bands=params.ALERT_BANDS) -> DataFrame:
    """Alerts whose level differs from that of the series' score before.

    Scores are ranked by series and day; the first of a day goes by the last level of the days before, which is
    one row a day, so a series with a third of all rows isn't one group.
    """
    level = banded(F.col(score), bands)
    dated = scores.withColumn("__day", F.to_date(at)).withColumn("__level", level)
    ends = dated.groupBy(by, "__day").agg(F.max_by("__level", at).alias("__end"))
    carried = ends.select(by, "__day", F.lag("__end").over(Window.partitionBy(by).orderBy("__day")).alias("__carried"))
    before = F.coalesce(F.lag("__level").over(Window.partitionBy(by, "__day").orderBy(at)), "__carried", F.lit("green"))
    changed = dated.join(carried, [by, "__day"]).withColumn("__before", before).filter(F.col("__level") != F.col("__before"))
    return alerts(changed.select(*scores.columns), by, at, score, bands)


def trailing_counts(log: DataFrame, by: str = "series_key", at: str = "ts", hours: int = 24) -> DataFrame:
    """log and n, the alerts of the series in the trailing hours up to each, itself and those of the same second included.

    An alert is counted in the window-long bucket that it lies in and goes as a mere neighbour to the next one, so
    the groups are series and buckets, not series.
    """
    size = hours * 3600
    second = F.unix_seconds(at)
    own = F.floor(second / size)
    both = log.select("*", F.inline(F.array(F.struct(own.alias("__b"), F.lit(True).alias("__own")), F.struct((own + 1).alias("__b"), F.lit(False).alias("__own")))))
    w = Window.partitionBy(by, "__b").orderBy(second).rangeBetween(-size, 0)
    return both.withColumn("n", F.count(F.lit(1)).over(w)).filter("__own").drop("__b", "__own")


def retained(log: DataFrame, most: int = 100, at: str = "ts") -> DataFrame:
    """The newest `most` alerts."""
    return log.orderBy(F.desc(at), "id").limit(most)


def status(log: DataFrame, as_of: Column, by: str = "series_key", at: str = "ts", hours: int = 24) -> DataFrame:
    """(by, level, alert_count, latest_at): alerts of the trailing hours and the level of the latest; green without any."""
    recent = log.withColumn("__in", (F.col(at) >= as_of - F.expr(f"interval {hours} hours")) & (F.col(at) <= as_of))
    g = recent.groupBy(by).agg(F.count_if("__in").alias("alert_count"), F.max(F.when(F.col("__in"), F.col(at))).alias("latest_at"), F.max(F.when(F.col("__in"), F.struct(F.col(at), F.col("id"), F.col("level")))).alias("__m"))
    return g.select(by, F.coalesce("__m.level", F.lit("green")).alias("level"), "alert_count", "latest_at")


def acknowledge(log: DataFrame, acks: DataFrame) -> DataFrame:
    """log with acknowledged and acknowledged_at, from the first acknowledgement (id, acknowledged_at) of each alert."""
    first = acks.groupBy("id").agg(F.min("acknowledged_at").alias("acknowledged_at"))
    return log.join(first, "id", "left").withColumn("acknowledged", F.col("acknowledged_at").isNotNull())
