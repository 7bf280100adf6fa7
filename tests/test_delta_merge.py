"""Snapshot + delta ticks: segments, hot topics and micro-batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.streaming import ticks as tk

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "topic string, ts timestamp, seq long, ltp double, volume double"
FIELDS = ["ltp", "volume"]


def some(seed, n, step):
    """Half of all ticks in one topic, many of them in one second."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        topic = "HOT" if r.random() < 0.5 else f"T{r.randrange(6)}"
        ltp = float(r.randrange(3)) if r.random() < 0.4 else None if r.random() < 0.5 else float(tk.KEEP)
        out.append((topic, T0 + dt.timedelta(seconds=step * (i // 50)), i, ltp, float(r.randrange(2)) if r.random() < 0.3 else None))
    return out


def brute(rows, start=None):
    last, out = dict(start or {}), []
    for topic, _, seq, *values in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        had = last.get(topic, [None, None])
        now = [h if v is None or v == tk.KEEP else v for v, h in zip(values, had, strict=True)]
        if now != had:
            out.append((topic, seq, *now))
        last[topic] = now
    return sorted(out, key=str), last


def collected(df):
    return sorted((tuple(r) for r in df.select("topic", "seq", *FIELDS).collect()), key=str)


@pytest.mark.parametrize("segments", [None, 1, 13])
def test_segments_give_the_same_rows(spark, segments):
    rows = some(segments or 0, 1500, 0.01)
    assert collected(tk.merge_deltas(spark.createDataFrame(rows, SCHEMA), FIELDS, segments)) == brute(rows)[0]


def test_a_hot_topic_spreads_over_tasks(spark):
    rows = some(1, 4000, 0)  # one instant, so no time slice could split it
    placed = spark.createDataFrame(rows, SCHEMA).repartitionByRange(16, "topic", "ts", "seq").withColumn("p", F.spark_partition_id())
    share = placed.groupBy("p").count().agg(F.max("count")).first()[0]
    assert share < 4000 / 8
    assert placed.filter("topic = 'HOT'").select("p").distinct().count() > 5


def test_micro_batches_equal_one_batch(spark, tmp_path):
    rows = some(7, 1200, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    for lo, hi in ((0, 300), (300, 320), (320, 900), (900, 1200)):
        df.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    merger = tk.DeltaMerger(FIELDS, "file://" + str(tmp_path / "out"), segments=5)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = s.writeStream.foreachBatch(merger).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert collected(merger.rows(spark)) == brute(rows)[0]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rows = some(9, 600, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    merger = tk.DeltaMerger(FIELDS, "file://" + str(tmp_path / "out"))
    parts = [df.filter(f"seq < {200}"), df.filter("seq BETWEEN 200 AND 399"), df.filter("seq >= 400")]
    merger(parts[0], 0)
    merger(parts[1], 1)
    merger(parts[1], 1)
    merger(parts[2], 2)
    merger(parts[2], 2)
    assert collected(merger.rows(spark)) == brute(rows)[0]
    state = {r.topic: [r.ltp, r.volume] for r in merger.state(spark, 3).collect()}
    assert state == brute(rows)[1]


def test_topics_out_of_sight_are_forgotten(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    merger = tk.DeltaMerger(FIELDS, "file://" + str(tmp_path / "out"), ttl=60)
    for n, rows in enumerate(([("A", at(0), 1, 1.0, 1.0), ("B", at(50), 2, 2.0, None)], [("C", at(90), 3, 3.0, None)], [("A", at(95), 4, 1.0, None), ("B", at(96), 5, 2.0, None)])):
        merger(spark.createDataFrame(rows, SCHEMA), n)
    got = collected(merger.rows(spark))
    assert ("A", 4, 1.0, None) in got and not any(r[1] == 5 for r in got)  # A began anew, B had not changed


def test_empty_batches(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    merger = tk.DeltaMerger(FIELDS, "file://" + str(tmp_path / "out"), ttl=5)
    merger(none, 0)
    merger(spark.createDataFrame([("A", T0, 1, 1.0, None)], SCHEMA), 1)
    merger(none, 2)
    assert collected(merger.rows(spark)) == [("A", 1, 1.0, None)]
    assert tk.merge_deltas(none, FIELDS).count() == 0
