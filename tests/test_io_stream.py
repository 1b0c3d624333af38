"""Scans, sinks and streams over small files."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.operators import alerts
from riskloom.sources import io
from riskloom.streaming import jobs, state


def test_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿title,content,url\n"x, y","two\nlines",u1\n', encoding="utf-8")
    r = io.scan_csv(spark, str(tmp_path / "a.csv")).first()
    assert (r.title, r.content, r.url, r.language) == ("x, y", "two\nlines", "u1", None)
    (tmp_path / "b.json").write_text(json.dumps([{"title": "t1"}, {"title": "t2"}]))
    (tmp_path / "c.json").write_text(json.dumps({"title": "t3"}))
    (tmp_path / "bad.json").write_text("{oops")
    titles = lambda name: sorted(r.title for r in io.scan_json(spark, str(tmp_path / name)).collect() if r.title)
    assert titles("b.json") == ["t1", "t2"] and titles("c.json") == ["t3"] and titles("bad.json") == []
    assert io.scan_external(spark, str(tmp_path / "none.csv"), io.ARTICLE).count() == 0
    (tmp_path / "h.jsonl").write_text('{"date": "2024-01-01", "risk_score": 5.0, "details": {"a": 1.0}}\n\n{broken\n')
    rows, bad = io.scan_jsonl(spark, str(tmp_path / "h.jsonl"))
    assert rows.count() == 1 and bad.count() == 1 and rows.first().details == {"a": 1.0}


def test_sources_and_sinks(spark, tmp_path):
    day = tmp_path / "source=s1"
    day.mkdir()
    (day / "date=2024-01-01.json").write_text(json.dumps([{"title": "a"}]))
    assert io.scan_sources(spark, str(tmp_path), "2024-01-01", ["s1", "s2"]).count() == 1
    df = spark.createDataFrame([("2024-01-01", 5.0, ["x"])], "date string, risk_score double, tags array<string>")
    io.append_history(df, str(tmp_path / "hist"), "2024-01-02 00:00:00")
    io.append_history(df, str(tmp_path / "hist"), "2024-01-02 00:00:00")
    assert spark.read.parquet(str(tmp_path / "hist")).count() == 2
    io.save_csv(df, str(tmp_path / "csv"), ["tags", "risk_score", "missing"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().tags == '["x"]'
    io.save_analysis(spark.createDataFrame([("x" * 500,)], "text string"), str(tmp_path / "res"))
    assert len(spark.read.json(str(tmp_path / "res")).first().text) == 200
    seed = spark.createDataFrame([(1,)], "a int")
    assert io.load_or_seed(spark, str(tmp_path / "seed"), seed).count() == io.load_or_seed(spark, str(tmp_path / "seed"), seed.filter("false")).count() == 1


def _landed(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=i), f"http://x/{i % 7}" + "/" * (i % 2), float(i % 100)) for i in range(200)]
    df = spark.createDataFrame(rows, "ts timestamp, url string, risk_score double").withColumn("series_key", F.lit("a"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_streams_equal_batch(spark, tmp_path):
    df, stream = _landed(spark, tmp_path)
    jobs.run_available(jobs.dedup_urls(stream, late="30 days"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 7
    q = jobs.complete(jobs.daily(stream, "series_key", [F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("s")], late="30 days"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    got = spark.read.parquet(str(tmp_path / f"o2/batch={q.lastProgress['batchId']}"))
    want = df.groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("s"))
    assert {(r.start, r.n, r.s) for r in got.collect()} == {(r.d, r.n, r.s) for r in want.collect()}
    jobs.run_available(jobs.threshold_alerts(stream), str(tmp_path / "o3"), str(tmp_path / "c3"))
    ids = lambda d: sorted(r.id for r in d.collect())
    log = alerts.alerts(df)
    assert ids(spark.read.parquet(str(tmp_path / "o3"))) == ids(log)


def test_retention(spark, tmp_path):
    df, _ = _landed(spark, tmp_path)
    log = alerts.alerts(df)
    keep = jobs.retain_newest(str(tmp_path / "log"), 10)
    keep(log.filter("ts < '2024-01-03'"), 0)
    keep(log.filter("ts >= '2024-01-03'"), 1)
    keep(log.filter("ts >= '2024-01-03'"), 1)
    kept = spark.read.parquet(str(tmp_path / "log/batch=1"))
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in alerts.retained(log, 10).collect())


def test_late_rows_are_dropped(spark, tmp_path):
    schema = StructType.fromDDL("ts timestamp, url string")
    (tmp_path / "in").mkdir()
    stream = jobs.dedup_urls(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), late="1 hour")
    t = dt.datetime(2024, 1, 1)
    for i, (at, url) in enumerate([(t, "a"), (t + dt.timedelta(days=2), "b"), (t, "c")]):
        spark.createDataFrame([(at, url)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "log"))
    assert sorted(r.url for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def _scores(spark, tmp_path, files=3):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"s{k}", start + dt.timedelta(hours=i), float((i * 37 + k * 11) % 100 if i % 5 else 90)) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "series_key string, ts timestamp, risk_score double")
    for k in range(files):  # a file a batch, in order of time
        part = df.filter((F.hour("ts") + 24 * (F.dayofmonth("ts") - 1)).between(k * 14, k * 14 + 13))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        yield df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_level_changes_in_a_stream(spark, tmp_path):
    """State lives on between runs from the same checkpoint, and the changes are those of the batch form."""
    state.use_rocksdb(spark)
    for df, stream in _scores(spark, tmp_path):
        jobs.run_available(state.level_changes(stream), str(tmp_path / "out"), str(tmp_path / "log"))
    got = sorted((r.id, r.series_key, r.ts, r.level) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.id, r.series_key, r.ts, r.level) for r in alerts.level_changes(df).collect()) and got


def test_idle_series_are_forgotten(spark, tmp_path):
    state.use_rocksdb(spark)
    start = dt.datetime(2024, 1, 1)
    schema = "series_key string, ts timestamp, risk_score double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(StructType.fromDDL(schema)).parquet(str(tmp_path / "in"))
    for key, days in (("a", 0), ("b", 9), ("b", 18), ("a", 18.1)):
        spark.createDataFrame([(key, start + dt.timedelta(days=days), 90.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.run_available(state.level_changes(stream, idle=dt.timedelta(days=5)), str(tmp_path / "out"), str(tmp_path / "log"))
    got = sorted((r.series_key, (r.ts - start).days) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0), ("a", 18), ("b", 9), ("b", 18)]


def test_acknowledgements_in_a_stream(spark, tmp_path):
    state.use_rocksdb(spark)
    for df, stream in _scores(spark, tmp_path):
        log = alerts.alerts(df)
        acks = log.filter("level = 'red'").select("id", (F.col("ts") + F.expr("interval 1 hour")).alias("acknowledged_at"))
        both = acks.unionAll(acks.withColumn("acknowledged_at", F.col("acknowledged_at") + F.expr("interval 2 hours")))
        both.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "acks"))
    alert_stream = alerts.alerts(stream).select("id", "level", "ts")
    ack_stream = spark.readStream.schema(acks.schema).parquet(str(tmp_path / "acks"))
    jobs.run_available(state.acknowledged(alert_stream, ack_stream, late="10 days"), str(tmp_path / "out"), str(tmp_path / "log"))
    got = sorted((r.id, r.ts, r.acknowledged_at) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.id, r.ts, r.acknowledged_at) for r in alerts.acknowledge(log, both).filter("acknowledged").collect()) and got


def test_tolerant_lines(spark, tmp_path):
    """A stream and a batch over landed lines give the same rows, bad lines are told, and a date reads only its folder."""
    lines = ['{"title": "a", "url": "u1"}', "", "{broken", '{"title": 5}', '["list"]', "   "]
    for source in ("s1", "s2"):
        for day in ("2024-01-01", "2024-01-02"):
            folder = tmp_path / "in" / f"source={source}" / f"date={day}"
            folder.mkdir(parents=True)
            (folder / "x.jsonl").write_text("\n".join(lines))
    batch = io.tolerant_lines(spark, str(tmp_path / "in"))
    plain = lambda df: sorted(map(tuple, df.select("title", "url", "source", F.col("date").cast("string"), "bad").collect()), key=str)
    want = plain(batch)
    assert len(want) == 16 and sum(r[4] is None for r in want) == 8 and ("a", "u1", "s1", "2024-01-01", None) in want and (None, None, "s2", "2024-01-02", "{broken") in want
    stream = io.tolerant_lines(spark, str(tmp_path / "in"), stream=True, files_a_batch=1)
    jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "log"))
    assert plain(spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))) == want
    one = batch.filter("date = DATE'2024-01-02' AND source = 's1'")
    files = {r.f for r in one.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) == 1 and "date=2024-01-02" in files.pop() and one.count() == 4
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan
