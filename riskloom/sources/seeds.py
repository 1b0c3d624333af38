"""Seed tables as DataFrames. Callers may pass their own of the same columns everywhere instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import seeds

#: The type under which tagging lists an entity.
TAG_TYPES = {"Country": "location", "Location": "location", "Organization": "organization", "Person": "person"}


def places(spark: SparkSession) -> DataFrame:
    """(place, lat, lon, border)"""
    return spark.createDataFrame([(n, float(a), float(b), c == "border") for n, a, b, c in seeds.rows(seeds.PLACES)], "place string, lat double, lon double, border boolean")


def centers(spark: SparkSession) -> DataFrame:
    """(center, lat, lon, weight)"""
    return spark.createDataFrame([(n, float(a), float(b), float(w)) for n, a, b, w in seeds.rows(seeds.CENTERS)], "center string, lat double, lon double, weight double")


def entities(spark: SparkSession) -> DataFrame:
    """(id, type, aliases)"""
    return spark.createDataFrame([(n, t, [x for x in a.split(",") if x]) for n, t, a in seeds.rows(seeds.ENTITIES)], "id string, type string, aliases array<string>")


def relations(spark: SparkSession) -> DataFrame:
    """(src, type, dst)"""
    return spark.createDataFrame([tuple(r) for r in seeds.rows(seeds.RELATIONS)], "src string, type string, dst string")


def past_events(spark: SparkSession) -> DataFrame:
    """(seq, date, event_type, place, severity)"""
    rows = [(i, d, t, p, int(s)) for i, (d, t, p, s) in enumerate(seeds.rows(seeds.PAST_EVENTS))]
    return spark.createDataFrame(rows, "seq int, date string, event_type string, place string, severity int").withColumn("date", F.to_date("date"))


def gazetteer(known: DataFrame, types: dict[str, str] = TAG_TYPES) -> DataFrame:
    """(alias, entity, type) of entities (id, type, aliases): their names and aliases, by the types that tagging lists."""
    kinds = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    names = F.array_distinct(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return known.select(F.explode(names).alias("alias"), F.col("id").alias("entity"), F.try_element_at(kinds, F.col("type")).alias("type")).filter("type IS NOT NULL")


def vertices(known: DataFrame, seq: int = 0) -> DataFrame:
    """Entities as (type, id, seq, props): aliases by comma are a property."""
    props = F.when(F.size("aliases") > 0, F.create_map(F.lit("aliases"), F.array_join("aliases", ","))).otherwise(F.create_map().cast("map<string,string>"))
    return known.select("type", "id", F.lit(seq).alias("seq"), props.alias("props"))
