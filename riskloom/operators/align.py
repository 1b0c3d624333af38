"""Alignment of several monthly series, and correlations that survive constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.num import rounded

BY = "series_key"


def monthly_matrix(spine: DataFrame, light: DataFrame, conflicts: DataFrame, sentiment: DataFrame, events: DataFrame) -> DataFrame:
    """A row for each month of the spine: nightlight (default 0.5) and its change, conflict_count (0), sentiment_avg (0.5), event_count (0).

    Inputs are (series_key, month, value); the spine is (series_key, month).
    """
    df = spine
    for name, side, default in (("nightlight", light, 0.5), ("conflict_count", conflicts, 0.0), ("sentiment_avg", sentiment, 0.5), ("event_count", events, 0.0)):
        df = df.join(side.select(BY, "month", F.col("value").alias(name)), [BY, "month"], "left").withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(default)))
    before = F.lag("nightlight").over(Window.partitionBy(BY).orderBy("month"))
    return df.withColumn("nightlight_change", rounded(F.coalesce(F.col("nightlight") - before, F.lit(0.0)), 4))


def pearson(df: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    """(series, r) over rows where both are given; 0 under `least` rows or for a constant."""
    p = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(BY, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    g = p.groupBy(BY).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    r = F.when((F.col("n") >= least) & (F.col("sx") > 1e-12) & (F.col("sy") > 1e-12), F.try_divide("c", F.col("sx") * F.col("sy"))).otherwise(0.0)
    return df.select(BY).distinct().join(g.select(BY, rounded(r, 4).alias("r")), BY, "left").select(BY, F.coalesce("r", F.lit(0.0)).alias("r"))


def correlations(matrix: DataFrame, pairs: list[tuple[str, str]], least: int = 3) -> DataFrame:
    """(series, pair, r) of each named pair of columns, in one aggregate."""
    long = matrix.select(BY, F.inline(F.array(*[F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])))
    g = long.groupBy(BY, "pair").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    r = F.when((F.col("n") >= least) & (F.col("sx") > 1e-12) & (F.col("sy") > 1e-12), F.try_divide("c", F.col("sx") * F.col("sy"))).otherwise(0.0)
    return g.select(BY, "pair", rounded(r, 4).alias("r"))


def place_alignment(places: DataFrame, counts: DataFrame, activity: DataFrame, place: str = "place") -> DataFrame:
    """(place, lat, lon, activity, event_count, level): counted events (default 3) and activity (0.5) of each place."""
    df = places.select(place, "lat", "lon").join(counts.select(place, "event_count"), place, "left").join(activity.select(place, "activity"), place, "left")
    n = F.coalesce("event_count", F.lit(3)).cast("long")
    return df.select(place, "lat", "lon", rounded(F.coalesce("activity", F.lit(0.5)), 4).alias("activity"), n.alias("event_count"), F.when(n > 10, "高").when(n > 3, "中").otherwise("低").alias("level"))


def latest_values(annual: DataFrame, years: int = 5, by: tuple[str, ...] = ("country", "indicator")) -> DataFrame:
    """(by, year, value): the latest value that is neither null nor NaN among the `years` most recent years of each indicator."""
    recent = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("year")))
    df = annual.withColumn("__r", recent).filter((F.col("__r") <= years) & F.col("value").isNotNull() & ~F.isnan("value"))
    return df.groupBy(*by).agg(F.max("year").alias("year"), F.max_by("value", "year").alias("value"))


def fresh_snapshots(snapshots: DataFrame, ttl: DataFrame, as_of, defaults: DataFrame) -> DataFrame:
    """(source, fetched_at, value, fresh): each source's newest snapshot if it is younger than its ttl (seconds), else the default value."""
    newest = snapshots.groupBy("source").agg(F.max("fetched_at").alias("fetched_at"), F.max_by("value", "fetched_at").alias("value"))
    df = defaults.select("source", F.col("value").alias("__default")).join(ttl, "source").join(newest, "source", "left")
    age = F.unix_seconds(as_of) - F.unix_seconds(F.col("fetched_at").cast("timestamp"))
    fresh = F.coalesce(age < F.col("ttl"), F.lit(False))
    return df.select("source", F.when(fresh, F.col("fetched_at")).alias("fetched_at"), F.when(fresh, F.col("value")).otherwise(F.col("__default")).alias("value"), fresh.alias("fresh"))
