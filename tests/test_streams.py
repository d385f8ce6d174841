"""Streams with state and streams that merge into tables."""

import datetime as dt

from pyspark.sql import functions as F
from trapline.session import scratch_path
from trapline.streaming import online, upsert

SCHEMA = "path string, n long, at long, mine boolean"


def rows_of(spark, table):
    return sorted(tuple(r) for r in upsert.current(spark, table, SCHEMA).collect())


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_merge(spark):
    table = scratch_path(spark, "table")
    assert upsert.current(spark, table, SCHEMA).collect() == [] and upsert.version(spark, table) == 0
    write = upsert.merging(table, "path", "at", SCHEMA, keep=F.col("mine"), buckets=4)
    write(batch(spark, [("a", 1, 1, False), ("a", 2, 2, None), ("b", 3, 5, True), (None, 9, 9, False)]), 0)
    assert rows_of(spark, table) == [("a", 2, 2, None), ("b", 3, 5, True)]
    write(batch(spark, [("a", 7, 7, None), ("z", 7, 7, None)]), 0)  # replayed
    assert rows_of(spark, table) == [("a", 2, 2, None), ("b", 3, 5, True)] and upsert.version(spark, table) == 1
    write(batch(spark, [("a", None, 4, False), ("b", 4, 9, False), ("c", 5, None, None)]), 1)  # a null keeps its value, an own row stays
    assert rows_of(spark, table) == [("a", 2, 4, False), ("b", 3, 5, True), ("c", 5, None, None)]
    other = upsert.merging(table, "path", "at", SCHEMA, source="other", buckets=4)
    other(batch(spark, [("a", 8, 3, None), ("b", 6, 6, False)]), 0)  # older than what is stored; no own rows for this writer
    assert rows_of(spark, table) == [("a", 2, 4, False), ("b", 6, 6, False), ("c", 5, None, None)]
    for again, number in ((write, 0), (write, 1), (other, 0)):
        again(batch(spark, [("a", 99, 99, False)]), number)
    assert upsert.version(spark, table) == 3 and rows_of(spark, table)[0] == ("a", 2, 4, False)
    write(batch(spark, []), 2)
    assert upsert.version(spark, table) == 4 and len(rows_of(spark, table)) == 3


def test_what_a_lost_batch_wrote_is_not_seen(spark):
    table = scratch_path(spark, "table")
    write = upsert.merging(table, "path", "at", SCHEMA, buckets=2)
    write(batch(spark, [("a", 1, 1, None), ("b", 1, 1, None)]), 0)
    batch(spark, [("a", 5, 5, None)]).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{table}/data/_version=2")  # written, not committed
    assert rows_of(spark, table) == [("a", 1, 1, None), ("b", 1, 1, None)]
    write(batch(spark, [("a", 6, 6, None)]), 1)
    assert rows_of(spark, table) == [("a", 6, 6, None), ("b", 1, 1, None)]


def test_only_touched_buckets_are_written(spark):
    table = scratch_path(spark, "table")
    write = upsert.merging(table, "path", "at", SCHEMA, buckets=8)
    write(batch(spark, [(str(i), i, 1, None) for i in range(100)]), 0)
    write(batch(spark, [("7", 70, 2, None)]), 1)
    assert spark.read.parquet(f"{table}/data/_version=2").select("_bucket").distinct().count() == 1
    assert len(rows_of(spark, table)) == 100 and ("7", 70, 2, None) in rows_of(spark, table)


def test_sessions_leave_the_state(spark):
    """A file a day: each session is written once, and the state never holds more than the open ones."""
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "offsets"))
    start, schema = dt.datetime(2024, 1, 1), "location string, captured_at timestamp"
    wanted, held = [], []
    for day in range(6):
        shots = [(f"l{k}", start + dt.timedelta(days=day, seconds=1000 * s + 60 * i)) for k in range(2) for s in range(5) for i in range(3)]
        wanted += [(f"l{k}", start + dt.timedelta(days=day, seconds=1000 * s), 3) for k in range(2) for s in range(5)]
        spark.createDataFrame(shots, schema).coalesce(1).write.mode("append").parquet(source)
        held += online.drain(online.online_sequences(online.watch_folder(spark, source, schema), "location", "captured_at"), sink, checkpoint)
    assert len(held) == 6 and max(held) <= 2  # one open session a location
    written = lambda: sorted((r["location"], r["first_at"], r["shots"]) for r in spark.read.parquet(sink).collect())
    assert set(written()) < set(wanted) and len(written()) == len(wanted) - 2
    last = online.ending(spark.read.parquet(source), "location", "captured_at")
    last.write.mode("append").parquet(source)
    online.drain(online.online_sequences(online.watch_folder(spark, source, schema), "location", "captured_at"), sink, checkpoint)
    assert written() == sorted(wanted)


def test_no_shots_need_no_ending(spark):
    assert online.ending(spark.createDataFrame([], "location string, captured_at timestamp"), "location", "captured_at").collect() == []
