"""Shards, mixes and nearest neighbours."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.llm import graph, mixing, shards

# ---- shards ---------------------------------------------------------------------------------


def test_longest_first():
    rng = random.Random(1)
    sizes = {i: rng.randint(1, 100) for i in range(60)}
    placed = shards.longest_first(sizes, 4)
    loads = [0] * 4
    for i in sorted(sizes, key=lambda i: (-sizes[i], i)):  # the rule without a heap
        least = min(range(4), key=lambda s: (loads[s], s))
        assert placed[i] == least
        loads[least] += sizes[i]
    assert max(loads) - min(loads) <= 100


@pytest.mark.parametrize("bundles", [512, 3])
def test_shards(spark, bundles):
    rng = random.Random(2)
    texts = ["x" * rng.randint(0, 400) for _ in range(300)] + ["big " * 500] * 3 + [None, None, "", "é"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "null id")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, shard int")
    got = shards.shard_documents(docs, 8, bundles).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    by_id = dict(rows)
    place = {}
    for r in got:
        text = by_id[r["doc_id"]]
        assert r["size"] == len((text or "").encode()) + 1 and r["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))
        assert r["law"] == "bytes" and r["grown_shard"] is None
        assert place.setdefault(text, r["shard"]) == r["shard"]
    loads = {s: sum(r["size"] for r in got if r["shard"] == s) for s in range(8)}
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    if bundles == 512:
        assert max(loads.values()) - min(loads.values()) <= 3 * 2001
    assert shards.shard_documents(docs.limit(0)).count() == 0


# ---- mixes ----------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 300) == pytest.approx([187.5, 75, 37.5])
    got = mixing.targets([10, 100, 100, 0], [5, 2, 1, 9], 210)
    assert got[0] == 30 and got[3] == 0 and sum(got) == pytest.approx(210) and got[1] == pytest.approx(2 * got[2])
    assert mixing.targets([0, 0], [5, 2], 0) == [0, 0] and mixing.targets([], [], 0) == []


def test_permutations():
    for n in (1, 2, 3, 10, 100, 1023, 5000):
        for key in (0, 99):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))
    many = np.concatenate([mixing.permuted(np.arange(7), np.full(7, 7), np.full(7, k)) for k in range(300)]).reshape(-1, 7)
    assert len({tuple(x) for x in many}) > 200


def test_draws():
    counts = mixing.draw_counts([700, 200, 0, 60], 100)
    assert [int(c.sum()) for c in counts] == [100] * 9 + [60] and np.array(counts).sum(axis=0).tolist() == [700, 200, 0, 60]
    assert mixing.draw_counts([0, 0], 10) == [] and mixing.draw_counts([], 10) == []
    again = mixing.draw_counts([700, 200, 0, 60], 100)
    assert all((a == b).all() for a, b in zip(counts, again))


def mixed_corpus(spark, n=400):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n"]).join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 300))), rng.choice(["a", "b", "b", "B", "é", None, None])) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", "z"), (n + 2, "only", "tiny"), (5, rows[5][1], rows[5][2]), (None, "no id here", "a"), (n + 3, "w " * 30_000, "a")]
    return rows, spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, source string, target double, size int")


def test_mix_of_documents(spark):
    rows, docs = mixed_corpus(spark)
    got = mixing.mix_documents(docs, block_words=16, shard_slots=500).collect()
    assert len(got) == len(rows)
    size = lambda text: len((text or "").split())
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    totals = [sum(size(t) for _, t, s in rows if s == name) for name in sources]
    goals = mixing.targets(totals, [(5, 2, 1)[i % 3] for i in range(len(sources))], sum(totals))
    source_of = {i: s for i, _, s in rows}
    taken = dict.fromkeys(sources, 0)
    for r in got:
        at = sources.index(source_of[r["doc_id"]])
        assert r["source_size"] == totals[at] and r["target"] == pytest.approx(goals[at])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[sources[at]] += r["taken"]
    for name, goal in zip(sources, goals):
        assert abs(taken[name] - goal) <= 3 * 16
    again = mixing.mix_documents(docs.repartition(5), block_words=16, shard_slots=500).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_slots_and_blocks(spark):
    _, docs = mixed_corpus(spark, 200)
    rows, spans = (x.collect() for x in mixing.mix(docs, block_words=32, shard_slots=100))
    per_slot, per_shard = {}, {}
    for s in spans:
        assert 0 < s["words"] <= 32 and 0 <= s["first_word"] and s["first_word"] + s["words"] <= s["size"]
        per_slot.setdefault((s["source_no"], s["slot"]), []).append(s)
        per_shard.setdefault(s["shard"], set()).add((s["source_no"], s["slot"]))
    totals = {r["source_no"]: r["source_size"] for r in rows}
    for (source, _), parts in per_slot.items():
        block = {(p["start"] + p["first_word"]) // 32 for p in parts}
        assert len(block) == 1
        (block,) = block
        assert sum(p["words"] for p in parts) == min(32, totals[source] - 32 * block)
    assert all(len(found) == 100 for shard, found in per_shard.items() if shard != max(per_shard))


def test_repeated_documents(spark):
    rows, docs = mixed_corpus(spark)
    got = mixing.repeated(docs, block_words=16)
    assert got.columns == docs.columns
    counts = {}
    for r in got.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    assert all(n <= (6 if i == 5 else 3) for i, n in counts.items()) and all(counts.get(i, 0) == 0 for i, n in sizes.items() if not n)
    goals = {}
    for r in mixing.mix_documents(docs, block_words=16).collect():
        goals.setdefault(r["source_size"], [r["target"], 0])[1] += r["size"] * counts.get(r["doc_id"], 0)
    for size, (goal, words) in goals.items():
        if size > 5_000 and size < 30_000:  # enough documents, none of them most of the source
            assert abs(words - goal) < 0.35 * goal
    keyed = docs.withColumn("k", F.xxhash64("doc_id", "source", "text"))
    for r in mixing.taken(*mixing.mix(keyed, "k", block_words=16)).join(keyed.select("k", "doc_id"), F.col("key") == F.col("k")).filter("doc_id <> 5").collect():
        assert counts.get(r["doc_id"], 0) in ({0} if not r["taken"] else {r["taken"] // r["size"], r["taken"] // r["size"] + 1})


def test_repeated_documents_keep_columns_of_any_name(spark):
    names = ["mix_key", "_mix_key", "mix_times", "mix_copies", "mix_copy", "_llm_key", "_llm_copies"]
    docs = mixed_corpus(spark)[1].withColumns({n: F.lit(i) for i, n in enumerate(names)})
    got = mixing.repeated(docs, block_words=16)
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.select(*names).distinct().collect()] == [tuple(range(len(names)))]


def test_slots_are_not_broadcast(spark):
    _, docs = mixed_corpus(spark, 50)
    plan = mixing.mix(docs)[1]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= 3


# ---- nearest neighbours ---------------------------------------------------------------------

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(vectors, k):
    out = {}
    for i, x in vectors.items():
        if i % 20 == 0:
            near = sorted((-float(np.dot(x.astype(np.float64), y.astype(np.float64))), j) for j, y in vectors.items() if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def searched(frame, **options):
    found = {}
    for r in graph.nearest(frame, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return found


def test_recall_over_shards(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(12, 24))
    matrix = (centers[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 24))) * rng.uniform(0.5, 2, (3000, 1))
    vectors = {i: v.astype(np.float32) for i, v in enumerate(matrix)}
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in vectors.items()], SCHEMA)
    got, expected = searched(frame, shard_rows=1000, block_rows=60), exact(vectors, 20)
    assert set(got) == set(expected)
    hits = 0
    for i, rows in got.items():
        assert [r[0] for r in rows] == list(range(1, 21))
        assert [(-s, j) for _, j, s in rows] == sorted((-s, j) for _, j, s in rows)
        assert all(s == pytest.approx(float(np.dot(vectors[i].astype(float), vectors[j].astype(float))), rel=1e-12) for _, j, s in rows)
        hits += len({j for _, j, _ in rows} & {j for j, _ in expected[i]})
    assert hits / (20 * len(expected)) >= 0.9


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0], 0) for i in range(30)] + [(40, [0.5, 0.5], 0), (60, None, 0), (80, [0.0, 0.0], 0), (100, [nan, 1.0], 0), (120, [inf, 1.0], 0), (140, [None, 1.0], 0), (160, [], 0)]
    rows += [(41, [2.0, 0.0], 1), (None, [9.0, 9.0], 0), (200, [1.0, 1.0, 1.0], 0), (201, [1.0, 0.0, 2.0], 0), (0, [1.0, 0.0], 0)]
    got = searched(spark.createDataFrame(rows, SCHEMA))
    assert set(got) == {0, 20, 40, 200}
    assert [j for _, j, _ in got[0]] == [41, *range(1, 20)]
    assert [j for _, j, _ in got[20]] == [41, *range(0, 19)]
    assert [j for _, j, _ in got[40]] == [41, *range(0, 19)]
    assert got[200] == [(1, 201, 3.0)]
    assert searched(spark.createDataFrame([], SCHEMA)) == {}
    assert searched(spark.createDataFrame([(20, [1.0, 2.0], 0)], SCHEMA)) == {}


def test_neighbours_in_double_precision(spark):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(400, 8)) * np.where(np.arange(400) % 50 == 7, 1e12, np.where(np.arange(400) % 50 == 9, 1e-30, 1.0))[:, None]
    matrix[123, 0] = 1e150  # finite, though not in 32 bits
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(matrix)], SCHEMA.replace("float", "double"))
    got, hits = searched(frame, shard_rows=300), 0
    assert set(got) == set(range(0, 400, 20))
    for i, rows in got.items():
        scores = {j: float(np.dot(matrix[i], matrix[j])) for j in range(400) if j != i}
        assert all(s == pytest.approx(scores[j], rel=1e-12) for _, j, s in rows)  # 32-bit floats are off by 1e-7
        hits += len({j for _, j, _ in rows} & set(sorted(scores, key=lambda j: (-scores[j], j))[:20]))
    assert hits >= 0.95 * 20 * len(got)


def test_pruned_graph_reaches_every_point():
    points = graph.augmented(np.random.default_rng(1).normal(size=(1500, 16)).astype(np.float32))
    edges, start = graph.build(points)
    seen, front = {start}, [start]
    while front:
        front = [int(j) for i in front for j in edges[i] if j >= 0 and int(j) not in seen and not seen.add(int(j))]
    assert len(seen) >= 0.999 * len(points)
    assert ((edges >= 0).sum(axis=1) <= graph.DEGREE).all()
