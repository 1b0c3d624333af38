"""Session defaults shared by tests, bench and local runs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session: UTC, ANSI and AQE on, and a checkpoint folder of its own that is cleaned as tables go out of use."""
    conf = {
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="riskloom-"),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("RISKLOOM_DRIVER_MEMORY", "8g"),
    } | {k.replace("__", "."): v for k, v in extra.items()}
    return SparkSession.builder.master(f"local[{cores}]").appName("riskloom").config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors must see; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="riskloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, with its lineage cut, so that lost executors don't undo the rounds before."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, over: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage is cut and the planner sees the true size.

    A checkpoint keeps its plan's estimate of size, which multiplies from round to round where a loop joins its own
    results; a loop uses this instead. `over` is the stored table that the new one takes the place of: its files go,
    so nothing not yet computed may still read it. Other files stay until forget() or the folder's own cleaning. `by`
    names columns whose values get folders of their own, for loops that read some at a time.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._stored_in = folder
    if over is not None:
        forget(over)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._stored_in)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows up to which a side is broadcast where Spark can't know its size.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most `most` rows; else as it is, for Spark to shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded(df: DataFrame, what: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast; refused if it has more than `most` rows."""
    from pyspark.sql import functions as F

    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return F.broadcast(df)
