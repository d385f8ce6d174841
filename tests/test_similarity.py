"""Search, fusion and clustering against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.operators import calibration, modelout, similarity


def vectors(spark, matrix, first=0):
    rows = [(first + i, [float(x) for x in v], int(i % 4), int(i % 3)) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "ref_id long, embedding array<float>, identity long, sequence_id long")


def data(seed, n, d=6):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_shortlist(spark, block_rows):
    q, g = data(1, 20), data(2, 50)
    g[7] = g[3]  # equal vectors: the smaller id first
    g[9] = 0  # a zero vector is similar to nothing
    got = similarity.shortlist(vectors(spark, q), vectors(spark, g), 5, block_rows=block_rows).collect()
    scores = similarity.cosine_matrix(q.astype(float), g.astype(float))
    scores[:, 7] = scores[:, 3]
    for i in range(20):
        rows = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["position"])
        best = np.lexsort((np.arange(50), -scores[i]))[:5]
        assert [r["ref_id"] for r in rows] == list(best)
        assert np.allclose([r["score"] for r in rows], scores[i][best])


def test_shortlist_longer_than_the_gallery(spark):
    got = similarity.shortlist(vectors(spark, data(1, 3)), vectors(spark, data(2, 4)), 10)
    assert got.count() == 12


def test_top_identities_are_distinct_and_padded(spark):
    pairs = spark.createDataFrame(
        [(1, 10, "a", 0.9), (1, 11, "a", 0.8), (1, 12, "b", 1.7), (2, 10, "a", -0.3)], "query_id long, ref_id long, identity string, score double"
    )
    paths = spark.createDataFrame([(i, f"/x/masked_images/{i}.jpg") for i in (10, 11, 12)], "ref_id long, path string")
    rows = {r["query_id"]: r for r in similarity.result_arrays(similarity.top_identities(pairs, 3), paths, 3).collect()}
    assert rows[1]["class_ids"] == ["b", "a", "a"] and rows[1]["scores"] == [1.0, 0.9, 0.9]
    assert rows[1]["paths"][0] == "/x/images/12.jpg" and rows[1]["masked_paths"][0] == "/x/masked_images/12.jpg"
    assert rows[2]["class_ids"] == ["a"] * 3 and rows[2]["scores"] == [0.0] * 3


def test_rerank(spark):
    pairs = spark.createDataFrame(
        [(1, 10, "a", 0.9, 5.0), (1, 11, "b", 0.8, 150.0), (1, 12, "c", 0.7, 120.0), (1, 13, "d", 0.1, 999.0)],
        "query_id long, ref_id long, identity string, cosine double, local double",
    )
    got = sorted((r["position"], r["ref_id"]) for r in similarity.rerank(pairs, 3).collect())
    assert got == [(1, 11), (2, 12), (3, 12)]


def single_linkage(keys, matrix, scores, limit, multiplier):
    """The clustering as a loop that merges the two closest groups."""
    groups = [[i] for i in range(len(matrix))]
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    angle = np.degrees(np.arccos(np.clip(unit @ unit.T, -1, 1)))
    if len(groups) == 1:
        return matrix[0]

    def closest():
        return min((min(angle[i, j] for i in a for j in b), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x > y)

    first, x, y = closest()
    if first > limit:
        return matrix[int(np.argmax(scores))]
    while True:
        merged = groups[x] + groups[y]
        groups = [g for k, g in enumerate(groups) if k not in (x, y)] + [merged]
        if len(groups) == 1:
            break
        distance, x, y = closest()
        if distance > multiplier * first:
            break

    def mean(g):
        inside = [angle[i, j] for i in g for j in g if i > j]
        return sum(inside) / len(inside) if inside else 361

    return matrix[min(groups, key=mean)].sum(axis=0)


@pytest.mark.parametrize("limit, block_rows", [(60.0, 4096), (60.0, 6), (5.0, 4096), (5.0, 6)])
def test_sequence_clusters(spark, limit, block_rows):
    rng = np.random.default_rng(4)
    rows, expected = [], {}
    for s in range(4):
        n = [1, 5, 15, 24][s]
        centers = rng.normal(size=(4, 5))
        matrix = centers[rng.integers(0, 4, n)] + rng.normal(scale=0.25, size=(n, 5))
        scores = rng.random(n)
        expected[s] = single_linkage(None, matrix, scores, limit, 2.0)
        rows += [(100 * s + i, s, [float(x) for x in v], float(c)) for i, (v, c) in enumerate(zip(matrix, scores))]
    df = spark.createDataFrame(rows, "ref_id long, sequence_id long, embedding array<double>, score double")
    got = similarity.cluster_sequences(df, limit=limit, block_rows=block_rows).collect()
    assert {r["sequence_id"] for r in got} == set(expected) and len(got) == 4
    for r in got:
        assert np.allclose(r["embedding"], expected[r["sequence_id"]])


@pytest.mark.parametrize("block_rows", [4096, 2])
@pytest.mark.parametrize("scores, winner", [((1.0, None, 2.0), 2), ((1.0, float("nan"), 0.5), 0), ((None, None, None), 0), ((3.0, 3.0, 1.0), 0)])
def test_sequence_without_cluster_takes_the_best_score(spark, block_rows, scores, winner):
    """A missing score never wins, a tie goes to the smaller key, whatever the size of the blocks."""
    rows = [(i, 1, [float(i == k) for k in range(3)], s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "ref_id long, sequence_id long, embedding array<double>, score double")
    (got,) = similarity.cluster_sequences(df, limit=10.0, block_rows=block_rows).collect()
    assert got["embedding"] == rows[winner][2]


def test_equal_vectors_cluster_alike_in_blocks(spark):
    rows = [(i, 1, [1.0, 0.0] if i < 3 else [0.0, 1.0 + i], 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "ref_id long, sequence_id long, embedding array<double>, score double")
    got = {tuple(similarity.cluster_sequences(df, limit=10.0, block_rows=n).first()["embedding"]) for n in (2, 4096)}
    assert got == {(3.0, 0.0)}


def test_search_leaves_out_what_is_no_vector_or_score(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [float("nan"), 1.0])], "ref_id long, embedding array<float>")
    g = spark.createDataFrame([(10, [1.0, 0.1]), (11, [2.0, 2.0]), (12, None), (13, [0.0, 1.0])], "ref_id long, embedding array<float>")
    odd = lambda a, b: np.where(np.arange(len(b))[None, :] >= 1, np.nan, 0.5) + np.zeros((len(a), 1))
    got = similarity.shortlist(q, g, 2, matcher=odd).collect()
    assert [(r["query_id"], r["score"]) for r in got] == [(0, 0.5)]
    assert {r["ref_id"] for r in similarity.unsearchable(g).collect()} == {12}


def test_search_within_organisations_and_copies_of_tiles(spark):
    rng = np.random.default_rng(0)
    make = lambda first, n: spark.createDataFrame([(first + i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(n)], "ref_id long, embedding array<float>, org int")
    q, g = make(0, 30), make(100, 90)
    got = similarity.shortlist(q, g, 100, scope="org").collect()
    assert len(got) == 3 * 10 * 30 and all(r["query_id"] % 3 == (r["ref_id"] - 100) % 3 for r in got)
    tiles = similarity.packed_tiles(g, "embedding", "ref_id", "org", tile_bytes=4 * 8 * 10, pivots=np.eye(1, 4)).collect()
    assert sorted(r["scope"] for r in tiles) == sorted(["0", "1", "2"] * 3) and sum(len(r["ids"]) // 8 for r in tiles) == 90


def test_isotonic_golden(spark):
    pairs = spark.createDataFrame([(0.0, 0), (0.5, 1), (1.0, 1)], "score double, hit int")
    model = calibration.fit_isotonic(pairs)
    assert np.allclose(model.values(np.array([0.0, 0.25, 0.8])), [0.0, 0.5, 1.0])
    assert np.allclose(model.values(np.array([-3.0, 7.0])), [0.0, 1.0])


def test_isotonic_is_monotone(spark):
    rng = np.random.default_rng(0)
    score = rng.random(300)
    hit = (rng.random(300) < score).astype(int)
    pairs = spark.createDataFrame([(float(s), int(h)) for s, h in zip(score, hit)], "score double, hit int")
    model = calibration.fit_isotonic(pairs)
    curve = model.values(np.linspace(-0.2, 1.2, 500))
    assert (np.diff(curve) > -1e-12).all() and curve[-1] > curve[0]
    column = calibration.calibrated(pairs, model).select("score").collect()
    assert np.allclose([r["score"] for r in column], model.values(score))
    with pytest.raises(ValueError):
        calibration.calibrated(pairs, None)


def test_logistic(spark):
    rng = np.random.default_rng(1)
    score = rng.normal(size=400)
    hit = (rng.random(400) < 1 / (1 + np.exp(-2 * score))).astype(int)
    model = calibration.fit_logistic(spark.createDataFrame([(float(s), int(h)) for s, h in zip(score, hit)], "score double, hit int"))
    # the minimum of the penalised loss: its gradient is zero
    p = 1 / (1 + np.exp(-(model.slope * score + model.intercept)))
    assert abs(((p - hit) * score).sum() + model.slope) < 0.05 and abs((p - hit).sum()) < 0.05


def test_thresholds(spark):
    rows = [(0, [0.3, 0.3, 0.2, 0.2]), (1, [0.05, 0.9, 0.03, 0.02]), (2, [0.5, 0.2, 0.2, 0.1])]
    df = spark.createDataFrame(rows, "id int, probs array<double>")
    got = {r["id"]: r for r in modelout.thresholded(df, [0.5, 0.6, 0.7, 0.8]).collect()}
    assert (got[0]["class_id"], got[0]["prob"], got[0]["class_id_raw"]) == (4, pytest.approx(0.7), 0)
    assert (got[1]["class_id"], got[1]["prob"]) == (1, 0.9)
    assert got[2]["class_id"] == 4  # equal to the threshold is not over it


def test_detector_fallback(spark):
    labels = modelout.extended_labels(["Homo sapiens", "Lynx lynx"])
    rows = [(0, 2, 0.6, ("person", 0.9)), (1, 2, 0.6, ("vehicle", 0.9)), (2, 2, 0.6, ("animal", 0.8)), (3, 2, 0.6, None), (4, 1, 0.7, ("person", 0.9))]
    df = spark.createDataFrame(rows, "id int, class_id long, prob double, detection struct<class:string,confidence:double>")
    got = {r["id"]: (r["class_id"], r["prob"]) for r in modelout.detector_fallback(df, labels).collect()}
    assert got == {0: (0, 0.9), 1: (2, 0.6), 2: (3, 0.8), 3: (2, 0.6), 4: (1, 0.7)}


def test_reliability(spark):
    rows = [(0.0, 1), (0.05, 0), (0.1, 1), (0.95, 1), (1.0, 0), (1.2, 1)]
    bins = calibration.reliability_bins(spark.createDataFrame(rows, "s double, h int"), "s", "h")
    assert {r["bin"]: (r["size"], r["hit_rate"]) for r in bins.collect()} == {1: (2, 0.5), 10: (2, 0.5)}
    assert calibration.calibration_error(bins).first()["ece"] == pytest.approx(0.45)


def test_matcher_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(similarity.matcher_column(similarity.row_cosine, F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert got == pytest.approx(2**-0.5)


def test_tiles_that_hold_none_of_the_best_are_left_out(spark):
    """Vectors in 16 directions: most pairs of tiles are never compared, and the lists are those of brute force."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 24))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    make = lambda n: (centres[rng.integers(0, 16, n)] + 0.02 * rng.normal(size=(n, 24))).astype(np.float32)
    q, g = make(200), make(1600)
    found, compared = similarity.search(vectors(spark, q), vectors(spark, g), 5, block_rows=50)
    got = similarity.top_per_group(found, ["query_id"], [F.col("score").desc(), F.col("ref_id")], 5)
    scores = similarity.cosine_matrix(q.astype(float), g.astype(float))
    best = {(i, int(j)) for i in range(200) for j in np.lexsort((np.arange(1600), -scores[i]))[:5]}
    assert {(r["query_id"], r["ref_id"]) for r in got.collect()} == best
    pivots = similarity._pivots(vectors(spark, q), vectors(spark, g), "embedding", "ref_id", 1, 50)
    sides = [similarity.packed_tiles(vectors(spark, m), "embedding", "ref_id", None, 1, 50, pivots).count() for m in (q, g)]
    assert compared.count() < 0.3 * sides[0] * sides[1]
    # another matcher has no bound, so all pairs are compared
    every = similarity.search(vectors(spark, q), vectors(spark, g), 5, block_rows=50, matcher=lambda a, b: similarity.cosine_matrix(a, b))[1]
    assert every.count() == sides[0] * sides[1]


def test_search_of_few_scores_and_scopes(spark):
    """A scope with fewer references than wanted, one without any, and zero vectors in far tiles."""
    g = data(3, 300)
    g[::50] = 0
    rows = vectors(spark, g).withColumn("org", F.when(F.col("ref_id") < 3, "small").when(F.col("ref_id") % 3 == 0, "a").otherwise("b"))
    ask = vectors(spark, -g[:40], 1000).withColumn("org", F.when(F.col("ref_id") % 4 == 0, "small").when(F.col("ref_id") % 4 == 1, "a").when(F.col("ref_id") % 4 == 2, "b").otherwise("none"))
    got = similarity.shortlist(ask, rows, 7, scope="org", block_rows=20).collect()
    org = {r["ref_id"]: r["org"] for r in rows.collect()}
    scores = similarity.cosine_matrix(-g[:40].astype(float), g.astype(float))
    for r in ask.collect():
        mine = np.array([j for j in range(300) if org[j] == r["org"]], int)
        order = mine[np.lexsort((mine, -np.round(scores[r["ref_id"] - 1000][mine], 12)))][:7]
        assert [x["ref_id"] for x in sorted((x for x in got if x["query_id"] == r["ref_id"]), key=lambda x: x["position"])] == order.tolist()


def test_sequences_with_null_vectors(spark):
    rows = [(1, 1, [1.0, 0.0], 0.5), (2, 1, None, 0.9), (3, 1, [1.0, 0.1], 0.1), (4, 2, None, 0.9), (5, 3, [float("nan"), 1.0], 0.2), (6, 3, [0.0, 2.0], None)]
    frame = spark.createDataFrame(rows, "ref_id long, sequence_id long, embedding array<double>, score double")
    for block_rows in (1, 4096):
        got = {r["sequence_id"]: r["embedding"] for r in similarity.cluster_sequences(frame, block_rows=block_rows).collect()}
        assert set(got) == {1, 3} and np.allclose(got[1], [2.0, 0.1]) and got[3] == [0.0, 2.0]


@pytest.mark.parametrize("least_rows, bundles", [(4096, 1), (10, 2)])
def test_small_tiles_travel_in_bundles(spark, monkeypatch, least_rows, bundles):
    """What leaves the tasks goes by the bundles, not by the 100 tiles, and the lists are those of brute force."""
    monkeypatch.setattr(similarity, "LEAST_ROWS", least_rows)
    q, g = data(6, 30), data(7, 300)
    g[100:] = np.round(g[100:])  # a few equal vectors
    for matcher in (similarity.cosine_matrix, lambda a, b: similarity.cosine_matrix(a, b)):
        found, compared = similarity.search(vectors(spark, q), vectors(spark, g), 4, block_rows=3, matcher=matcher)
        rows = found.collect()
        assert len(rows) <= 30 * 4 * (1 + bundles)  # from the nearest tile, and from each bundle
        scores = similarity.cosine_matrix(q.astype(float), g.astype(float))
        for i in range(30):
            mine = sorted({(-round(r["score"], 9), r["ref_id"]) for r in rows if r["query_id"] == i})[:4]
            assert mine == sorted((-round(x, 9), j) for j, x in enumerate(scores[i]))[:4]
    assert compared.count() >= 10 * 100  # every pair of tiles, as the second matcher has no bound
