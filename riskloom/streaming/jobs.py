"""Structured Streaming forms of the incremental jobs. Times must be TIMESTAMP; `late` bounds the state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.functions.text import canonical_url
from riskloom.operators import alerts as A


def timed(df: DataFrame, at: str = "ts") -> DataFrame:
    """df with its time as TIMESTAMP (session zone), which watermarks need."""
    return df.withColumn(at, F.col(at).cast("timestamp"))


def dedup_urls(stream: DataFrame, url: str = "url", at: str = "ts", late: str = "7 days") -> DataFrame:
    """The first row of each canonical URL within the watermark."""
    return stream.withColumn("__url", canonical_url(F.col(url))).withWatermark(at, late).dropDuplicatesWithinWatermark(["__url"]).drop("__url")


def daily(stream: DataFrame, by: str, measures: list[Column], at: str = "ts", late: str = "1 day", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """(by, start, measures) over tumbling or sliding windows."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), by).agg(*measures).select(by, F.col("w.start").alias("start"), *[F.col(name) for name in _names(measures)])


def _names(measures: list[Column]) -> list[str]:
    return [m._jc.toString().rsplit(" AS ", 1)[1].strip("`") for m in measures]


def threshold_alerts(stream: DataFrame, by: str = "series_key", at: str = "ts", score: str = "risk_score") -> DataFrame:
    """Alerts of each new score; stateless."""
    return A.alerts(stream, by, at, score)


def retain_newest(path: str, most: int = 100, at: str = "ts") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest `most` alerts of all batches at path, a folder a batch.

    A batch writes path/batch=N from batch N - 1 and its own rows, so a repeated batch gives the same.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}"))
        A.retained(rows, most, at).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over what is there and stop; results as Parquet at path."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def complete(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run an aggregate over what is there in complete mode and stop; each batch's whole result is at path/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
