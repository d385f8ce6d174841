"""Global orders, sequences and top lists against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trapline.operators import dedup, ordered, ranking, sequences, splits
from trapline.operators.skew import attach

START = dt.datetime(2024, 1, 1)


def random_shots(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        location = rng.choice(["a", "b", "c", None]) if seed % 3 else rng.choice(["a", "b"])
        ts = START + dt.timedelta(seconds=rng.choice([0, 60, 120, 121, 240, 361, 500, 1000, 5000]) + 120 * rng.randint(0, 3))
        if rng.random() < 0.15 or (seed % 4 == 0 and location == "c"):
            ts = None
        rows.append((i, location, ts, rng.choice([True, False])))
    return rows


def whole_frame_machine(rows, limit=120):
    """The numbering as a loop over the sorted frame."""
    known = sorted({r[1] for r in rows if r[1] is not None}, reverse=True)
    place = {v: i for i, v in enumerate(known)} | {None: len(known)}
    late = dt.datetime.max
    frame = sorted(rows, key=lambda r: (place[r[1]], r[2] or late, not r[3], r[0]))
    deltas, previous = [], None
    for r in frame:
        deltas.append(None if r[2] is None or previous is None else (r[2] - previous).total_seconds())
        previous = r[2] or previous
    numbers, number = {}, 0
    for i, (r, d) in enumerate(zip(frame, deltas)):
        if i == 0:
            numbers[r[0]] = 0
        elif d is None:
            numbers[r[0]] = None
        else:
            number += d < 0 or d > limit
            numbers[r[0]] = number
    return numbers, {r[0]: d for r, d in zip(frame, deltas)}


@pytest.mark.parametrize("seed", range(8))
def test_sequences_of_the_whole_frame(spark, seed):
    rows = random_shots(seed)
    shots = spark.createDataFrame(rows, "media_id long, location string, captured_at timestamp, annotated boolean")
    got = sequences.number_sequences(shots, annotated="annotated", mode="reference", with_delta=True).collect()
    numbers, deltas = whole_frame_machine(rows)
    assert {r["media_id"]: r["sequence_number"] for r in got} == numbers
    assert {r["media_id"]: r["delta_seconds"] for r in got} == deltas


def test_leading_shot_without_time(spark):
    rows = [(1, "z", None, True), (2, "a", START, True), (3, "a", START, False), (4, "a", START + dt.timedelta(seconds=121), True)]
    shots = spark.createDataFrame(rows, "media_id long, location string, captured_at timestamp, annotated boolean")
    got = sequences.number_sequences(shots, annotated="annotated", mode="reference").collect()
    assert {r["media_id"]: r["sequence_number"] for r in got} == {1: 0, 2: None, 3: 0, 4: 1} == whole_frame_machine(rows)[0]


def test_gap_of_exactly_the_limit_and_times_before_1970(spark):
    base = dt.datetime(1969, 12, 31, 23, 59, 30)
    rows = [(i, "a", base + dt.timedelta(seconds=s), True) for i, s in enumerate([0, 120, 240, 360.5, 480, 700])]
    shots = spark.createDataFrame(rows, "media_id long, location string, captured_at timestamp, annotated boolean")
    got = {r["media_id"]: r["sequence_number"] for r in sequences.number_sequences(shots).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2}


def skewed(spark, n=2000):
    """One group holds most of the rows."""
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 10 < 8, F.lit("hot")).when(F.col("id") % 10 == 8, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        ((F.col("id") * 7919) % n).alias("v"),
    )


def test_numbers_over_all_and_in_groups(spark):
    df = skewed(spark)
    numbered = ordered.row_number_over_all(df, [F.col("v").desc(), F.col("id")], "n").collect()
    expected = {r["id"]: i + 1 for i, r in enumerate(sorted(df.collect(), key=lambda r: (-r["v"], r["id"])))}
    assert {r["id"]: r["n"] for r in numbered} == expected
    grouped = ordered.row_number_in_group(df, "g", [F.col("v"), F.col("id")], "n").collect()
    by_group = {}
    for r in sorted(df.collect(), key=lambda r: (r["v"], r["id"])):
        by_group.setdefault(r["g"], []).append(r["id"])
    assert {r["id"]: (r["n"], r["n_count"]) for r in grouped} == {
        i: (k + 1, len(ids)) for ids in by_group.values() for k, i in enumerate(ids)
    }


def test_neighbours(spark):
    df = skewed(spark, 500)
    order = [F.col("v"), F.col("id")]
    ids = [r["id"] for r in sorted(df.collect(), key=lambda r: (r["v"], r["id"]))]
    after = {r["id"]: r["x"] for r in ordered.next_over_all(df, order, F.col("id"), "x").collect()}
    before = {r["id"]: r["x"] for r in ordered.previous_over_all(df, order, F.col("id"), "x").collect()}
    assert after == dict(zip(ids, [*ids[1:], None])) and before == dict(zip(ids, [None, *ids[:-1]]))


def test_attach_keeps_the_null_group(spark):
    df = skewed(spark, 300)
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    got = attach(df, sizes, ["g"], F.col("id")).collect()
    assert len(got) == 300 and all(r["n"] is not None for r in got)
    assert {r["n"] for r in got if r["g"] is None} == {30}


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("heavy_rows", [0, 50, 10_000])
def test_attach_by_weight(spark, heavy_rows, how):
    df = skewed(spark, 300)
    sizes = df.filter("g is null or g != 'g1'").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = attach(df, sizes, ["g"], F.col("id"), how, weight="n", heavy_rows=heavy_rows)
    expected = df.join(sizes.withColumnRenamed("g", "g2"), F.col("g").eqNullSafe(F.col("g2")), how).select("id", "g", "v", "n", "top")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    assert got.columns == ["id", "g", "v", "n", "top"]


def test_rows_of_heavy_keys_are_spread(spark):
    df = skewed(spark, 4000)
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = attach(df, sizes, ["g"], F.col("id"), weight="n", heavy_rows=1000)
        per_task = plan.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in per_task) < 2500


def test_duplicates(spark):
    rows = [(i, "same" if i % 3 else f"own{i}", i % 2 == 0, "loc", START + dt.timedelta(seconds=i % 5)) for i in range(60)]
    files = spark.createDataFrame(rows, "media_id long, h string, annotated boolean, location string, captured_at timestamp")
    kept, others = dedup.split_duplicates(files, "h", "media_id", dedup.metadata_order("media_id"))
    kept_ids, other_ids = {r["media_id"] for r in kept.collect()}, {r["media_id"] for r in others.collect()}
    assert kept_ids | other_ids == set(range(60)) and not kept_ids & other_ids
    assert {i for i in kept_ids if i % 3} == {10}  # annotated, earliest second, smallest id
    marked = {r["media_id"]: r["duplicate"] for r in dedup.mark_duplicates(files, "h", "media_id", dedup.metadata_order("media_id")).collect()}
    assert {i for i, d in marked.items() if d} == other_ids


def test_pages(spark):
    df = spark.range(25)
    ids = lambda n: [r["id"] for r in ranking.page(df, [F.col("id")], n, 10).collect()]
    assert ids(1) == list(range(10)) and ids(3) == list(range(20, 25)) and ids(4) == ids(1) == ids(0)


def test_sort_by_unknown_column_keeps_the_frame(spark):
    df = spark.range(5)
    assert ranking.sort_by(df, "drop table", "asc", ["id"], "id") is df
    assert [r["id"] for r in ranking.sort_by(df, "id", "desc", ["id"], "id").collect()] == [4, 3, 2, 1, 0]


def split_loop(rows, share=0.8):
    import math

    counts = {}
    for _, identity, _ in rows:
        counts[identity] = counts.get(identity, 0) + 1
    quota = {k: math.ceil(v * (1 - share)) for k, v in counts.items()}
    seen, observed, out = dict.fromkeys(counts, 0), set(), {}
    for key, identity, observation in sorted(rows):
        if seen[identity] < quota[identity]:
            out[key] = "test"
            observed.add(observation)
        else:
            out[key] = "test" if observation in observed else "train"
        seen[identity] += 1
    trained = {identity for key, identity, _ in rows if out[key] == "train"}
    return {key: out[key] if out[key] == "train" or identity in trained else None for key, identity, _ in rows}


@pytest.mark.parametrize("seed", range(3))
def test_split_ratio(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaaaab") if i % 9 else f"single{i}", rng.randint(0, 60)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, identity string, observation long")
    got = {r["id"]: r["split"] for r in splits.split_ratio(df, "identity", "observation", "id").collect()}
    assert got == split_loop(rows)


def test_chunks(spark):
    got = splits.chunks(spark.range(10).withColumnRenamed("id", "k"), "k", 4).orderBy("k").collect()
    assert [r["chunk"] for r in got] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    few = splits.chunks(spark.range(2).withColumnRenamed("id", "k"), "k", 5).orderBy("k").collect()
    assert [r["chunk"] for r in few] == [0, 1]


def test_factorize(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b"), (4, "c")], "id long, label string")
    assert [r["label_index"] for r in splits.factorize(df, "label", "id").orderBy("id").collect()] == [0, -1, 1, 0, 2]
