"""Scans and sinks of landed files. Missing or bad files give empty frames or counted rejects, not failures."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, MapType, StringType, StructField, StructType

ARTICLE = StructType([StructField(c, StringType()) for c in ("title", "pub_time", "content", "url", "source", "language", "crawled_at")])
RISK_RECORD = StructType([StructField("date", StringType()), StructField("risk_score", DoubleType()), StructField("risk_level", StringType()), StructField("details", MapType(StringType(), DoubleType())), StructField("recorded_at", StringType())])


def _present(reader, load, schema: StructType, spark: SparkSession) -> DataFrame:
    try:
        return load(reader)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def scan_csv(spark: SparkSession, path: str, schema: StructType = ARTICLE) -> DataFrame:
    """CSV with a header; a byte order mark before the first name is no part of it. Columns go by name."""

    def load(reader) -> DataFrame:
        raw = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
        return raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    return _present(spark.read, load, schema, spark)


def scan_json(spark: SparkSession, path: str, schema: StructType = ARTICLE) -> DataFrame:
    """A JSON array or single object a file."""
    return _present(spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED"), lambda r: r.json(path), schema, spark)


def scan_jsonl(spark: SparkSession, path: str, schema: StructType = RISK_RECORD) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): JSON lines that parse, and the text of those that don't. Blank lines are neither."""
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    lines = _present(spark.read, lambda r: r.text(path), StructType([StructField("value", StringType())]), spark).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.filter(~bad).select(*[f"r.{f.name}" for f in schema]), parsed.filter(bad).select("value")


def tolerant_lines(spark: SparkSession, root: str, schema: StructType = ARTICLE, stream: bool = False, files_a_batch: int | None = None) -> DataFrame:
    """Landed JSON lines at root/source=S/date=D/ with the columns of schema, source, date and `bad`: the text of a line that
    doesn't parse, whose other columns are null. Blank lines are left out.

    One definition serves a batch and a stream, so both give the same rows; a filter on source or date reads only
    their folders. The landing folder must exist.
    """
    kind = StructType([StructField("value", StringType()), StructField("source", StringType()), StructField("date", DateType())])
    reader = (spark.readStream if stream else spark.read).schema(kind)
    if stream and files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    lines = reader.format("text").load(root).filter(F.trim("value") != "")
    own = [f for f in schema.fields if f.name not in ("source", "date")]
    wide = StructType([*own, StructField("_bad", StringType())])
    parsed = lines.select("source", "date", "value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    wrong = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.select(*[F.when(~wrong, F.col(f"r.{f.name}")).alias(f.name) for f in own], "source", "date", F.when(wrong, F.col("value")).alias("bad"))


def scan_external(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """By extension: .csv, .json, .jsonl or Parquet."""
    if path.endswith(".csv"):
        return scan_csv(spark, path, schema)
    if path.endswith(".jsonl"):
        return scan_jsonl(spark, path, schema)[0]
    if path.endswith(".json"):
        return scan_json(spark, path, schema)
    return _present(spark.read.schema(schema), lambda r: r.parquet(path), schema, spark)


def scan_sources(spark: SparkSession, root: str, date: str, sources: list[str], schema: StructType = ARTICLE) -> DataFrame:
    """The union of root/source=S/date=D.json and .csv of the named sources for one date; absent files are empty."""
    out = None
    for s in sources:
        for ext in ("json", "csv"):
            df = scan_external(spark, f"{root}/source={s}/date={date}.{ext}", schema).withColumn("feed", F.lit(s))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def latest_per_source(df: DataFrame, source: str = "source", date: str = "date") -> DataFrame:
    """The rows of each source's last date."""
    last = df.groupBy(source).agg(F.max(date).alias(date))
    return df.join(last, [source, date], "left_semi")


def append_history(df: DataFrame, path: str, recorded_at: str) -> None:
    """Append risk records, partitioned by date."""
    df.withColumn("recorded_at", F.to_timestamp(F.lit(recorded_at))).write.mode("append").partitionBy("date").parquet(path)


def save_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "append") -> None:
    """CSV with a header; arrays, maps and structs as JSON; only `columns` if given."""
    cols = [c for c in (columns or df.columns) if c in df.columns]
    kinds = dict(df.dtypes)
    nested = lambda c: kinds[c].startswith(("array", "map", "struct"))
    df.select(*[F.to_json(c).alias(c) if nested(c) else F.col(c) for c in cols]).write.mode(mode).option("header", True).csv(path)


def save_analysis(df: DataFrame, path: str, text: str = "text", longest: int = 200) -> None:
    """JSON lines with the text cut to `longest` characters."""
    df.withColumn(text, F.substring(text, 1, longest)).write.mode("append").json(path)


def load_or_seed(spark: SparkSession, path: str, seed: DataFrame) -> DataFrame:
    """The table at path, written from the seed if it is absent."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        seed.write.parquet(path)
        return spark.read.parquet(path)
