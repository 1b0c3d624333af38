"""A store of seen keys in buckets, with a filter for each, so that a merge reads only the buckets it must.

Layout under one folder: keys/bucket=B/ holds Parquet files of keys, appended by merges; filters/version=N/ holds bitmaps of
the keys' hashes by bucket, a new version a merge. A key whose bits aren't set is new and costs no read; the buckets of
the others alone are read. A filter is written before its keys, so a merge that fails between the two is safe to repeat: what
the filter says too early is looked up and found missing. One merge runs at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import forget, stored

#: Bits of one bitmap, as Spark builds them.
_MAP = 32768


class SeenKeys:
    """The keys at `path`, in `buckets` buckets with filters of `maps` bitmaps each."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, maps: int = 8, kind: str = "string"):
        self.spark, self.path, self.buckets, self.maps, self.kind = spark, path, buckets, maps, kind

    def _versions(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/filters")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _filters(self) -> DataFrame:
        done = self._versions()
        schema = "bucket int, piece int, bits binary"
        return self.spark.read.schema(schema).parquet(f"{self.path}/filters/version={done[-1]}") if done else self.spark.createDataFrame([], schema)

    def keys(self, buckets: list[int] | None = None) -> DataFrame:
        """(key, bucket) of all buckets or of some; the files of others aren't read."""
        try:
            df = self.spark.read.schema(f"key {self.kind}, bucket int").parquet(f"{self.path}/keys")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"key {self.kind}, bucket int")
        return df if buckets is None else df.filter(F.col("bucket").isin(buckets))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _places(self) -> Column:
        """The key's two bits, counted from 1."""
        return F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(self.maps * _MAP)) + 1 for seed in (1, 2)])).alias("place")

    def split(self, keys: DataFrame) -> tuple[DataFrame, list[int]]:
        """((key, bucket, maybe), buckets to read) of distinct keys: whether the filter may know them."""
        piece, at = F.bitmap_bucket_number("place").cast("int"), F.bitmap_bit_position("place")
        asked = keys.select("key", self._bucket()).select("key", "bucket", self._places()).select("key", "bucket", piece.alias("piece"), at.alias("at"))
        byte = F.conv(F.hex(F.substring("bits", (F.col("at") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
        bit = F.coalesce(F.getbit(byte, (F.col("at") % 8).cast("int")), F.lit(0))
        told = stored(asked.join(self._filters(), ["bucket", "piece"], "left").groupBy("key", "bucket").agg((F.min(bit) == 1).alias("maybe")))
        return told, [r.bucket for r in told.filter("maybe").select("bucket").distinct().collect()]  # at most `buckets` rows

    def merge(self, incoming: DataFrame, key: str) -> DataFrame:
        """(key): the distinct non-null keys of incoming that were not seen; they are seen from now on."""
        given = incoming.select(F.col(key).alias("key")).filter(F.col("key").isNotNull()).distinct()
        told, touched = self.split(given)
        known = self.keys(touched).select("key")
        new = stored(told.filter("NOT maybe").select("key", "bucket").unionAll(told.filter("maybe").select("key", "bucket").join(known, "key", "left_anti")))
        places = new.select("bucket", "key").select("bucket", self._places())
        made = places.groupBy("bucket", F.bitmap_bucket_number("place").cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        merged = self._filters().unionAll(made).groupBy("bucket", "piece").agg(F.bitmap_or_agg("bits").alias("bits"))
        done = self._versions()
        merged.write.mode("overwrite").parquet(f"{self.path}/filters/version={(done[-1] if done else 0) + 1}")
        new.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/keys")
        forget(told)
        return new.select("key")

    def compact(self, buckets: list[int] | None = None) -> None:
        """Rewrite the files of some buckets, or of all, as one a bucket."""
        held = stored(self.keys(buckets).distinct())
        held.repartition("bucket").sortWithinPartitions("bucket", "key").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys")
        forget(held)
