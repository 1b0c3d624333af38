"""The store of seen keys against plain sets."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from riskloom.operators.seen import SeenKeys


def test_merges_equal_sets(spark, tmp_path):
    rnd = random.Random(3)
    store, seen = SeenKeys(spark, str(tmp_path / "seen"), buckets=16, maps=1), set()
    for i in range(4):
        batch = [f"http://x/{rnd.randrange(400)}" for _ in range(rnd.choice([0, 150, 300]))] + [None, f"only{i}", f"only{i}"]
        got = [r.key for r in store.merge(spark.createDataFrame([(x,) for x in batch], "url string"), "url").collect()]
        new = {x for x in batch if x is not None} - seen
        assert len(got) == len(set(got)) and set(got) == new
        seen |= new
    store.compact()
    assert sorted(r.key for r in store.keys().collect()) == sorted(seen)
    assert store.keys().inputFiles() and len(store.keys().inputFiles()) <= 16
    assert store.merge(spark.createDataFrame([(x,) for x in seen], "url string"), "url").count() == 0


def test_new_keys_read_few_buckets(spark, tmp_path):
    """A batch of new keys and one seen key reads the bucket of that key, and what the filter mistakes."""
    store = SeenKeys(spark, str(tmp_path / "seen"), buckets=32, maps=8)
    store.merge(spark.range(3000).select(F.concat(F.lit("k"), "id").alias("url")), "url")
    batch = spark.range(100).select(F.concat(F.lit("n"), "id").alias("key")).unionAll(spark.createDataFrame([("k7",)], "key string"))
    told, touched = store.split(batch)
    assert told.filter("key = 'k7'").first().maybe and 1 <= len(touched) <= 3
    read = store.keys(touched)
    files = {r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) == len(touched) < len(store.keys().inputFiles()) == 32


def test_a_failed_merge_is_repeated(spark, tmp_path, monkeypatch):
    """Filters written without their keys lose nothing."""
    store = SeenKeys(spark, str(tmp_path / "seen"), buckets=4, maps=1)
    df = spark.createDataFrame([("a",), ("b",)], "url string")
    store.merge(df.limit(0), "url")
    store.merge(df, "url")
    for f in (tmp_path / "seen" / "keys").glob("bucket=*/*"):
        f.unlink()
    assert sorted(r.key for r in store.merge(df, "url").collect()) == ["a", "b"]
    assert store.merge(df, "url").count() == 0
