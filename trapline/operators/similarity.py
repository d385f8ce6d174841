"""Similarity of embeddings: search, shortlists, fusion, re-identification.

Searching compares every query with every gallery vector of its organisation, as the task demands,
but never as a join of rows: both sides are packed into tiles of bounded size and similar direction,
pairs of tiles that can't hold any of the best are left out, each other pair is compared in one
task, and only the best ``k`` references per query leave it. Small tiles travel in bundles: a pair
of bundles is one task, so neither the copies of vectors nor the lists that leave tasks grow with the number of tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.functions import arrays as A
from trapline.functions.text import swap_variant
from trapline.operators.ranking import top_per_group
from trapline.operators.rollups import vector_per_group
from trapline.operators.skew import attach
from trapline.session import pin

# Bytes of a tile of vectors, and the rows that are multiplied at once inside a pair of tiles.
TILE_BYTES, STRIP = 64_000_000, 2_048
# Directions that vectors are dealt by at most (they are sent to all tasks), and rows that are worth a tile of their own.
MOST_PIVOTS, LEAST_ROWS = 256, 4_096
_PACKED = ("dim", "ids", "matrix")
# Rows of a sequence that are clustered in one task.
BLOCK_ROWS = 4096

Matcher = Callable[[np.ndarray, np.ndarray], np.ndarray]


def cosine_matrix(left: np.ndarray, right: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), eps)
    return unit(left) @ unit(right).T


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def unsearchable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is null, empty or not finite; a search leaves them out."""
    return rows.filter(~F.coalesce(_finite(F.col(vector)), F.lit(False)))


def _best(scores: np.ndarray, query_ids: np.ndarray, ref_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best references of every row, the smaller id first on ties; a score that is no number is none."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    k = min(k, scores.shape[1])
    bar = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    row, column = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
    value = scores[row, column]
    order = np.lexsort((ref_ids[column], -value, row))
    row, column, value = row[order], column[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    return pd.DataFrame({"query_id": query_ids[row[kept]], "ref_id": ref_ids[column[kept]], "score": value[kept]})


def _pivots(query: DataFrame, gallery: DataFrame, vector: str, key: str, tile_bytes: int, tile_rows: int | None) -> np.ndarray | None:
    """Unit vectors of as many gallery rows as there are tiles, ``MOST_PIVOTS`` at most, chosen by hash; None if a tile is enough for either side."""
    usable = lambda rows: rows.filter(F.coalesce(_finite(F.col(vector)), F.lit(False))).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    size = lambda rows, side: usable(rows).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("dim")).withColumn("side", F.lit(side))
    sizes = {r.side: r for r in size(gallery, "gallery").unionByName(size(query, "query")).collect()}
    n, dim = sizes["gallery"].n, sizes["gallery"].dim
    tiles = max(math.ceil(r.n / (tile_rows or max(1, tile_bytes // (8 * r.dim)))) for r in sizes.values())
    # smaller tiles as long as there are not enough pairs of them for the tasks of a shuffle
    wanted = math.ceil(math.sqrt(int(gallery.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tiles = min(MOST_PIVOTS, n, max(tiles, min(wanted, n // LEAST_ROWS)))
    if tiles < 2 and max(r.n for r in sizes.values()) <= (tile_rows or max(1, tile_bytes // (8 * dim))):
        return None
    chosen = usable(gallery).filter(F.size("vector") == dim).orderBy(F.xxhash64("id"), "id").limit(max(tiles, 1)).collect()
    matrix = np.array([r.vector for r in chosen]).reshape(-1, dim)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def packed_tiles(
    rows: DataFrame, vector: str, key: str, scope: str | None, tile_bytes: int, tile_rows: int | None = None, pivots: np.ndarray | None = None
) -> DataFrame:
    """Vectors as tiles: one row per scope and tile, with the ids and the matrix as bytes, and a summary.

    Vectors go to the cell of their nearest pivot; a cell of more than ``tile_bytes`` (or
    ``tile_rows`` rows) is cut by hash. Without pivots a scope is one tile. The summary is the number of rows ``n``, the mean direction
    ``centre``, the largest angle to it ``radius``, and whether a ``zero`` vector is in the tile.
    """
    named = F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")
    usable = rows.filter(F.coalesce(_finite(F.col(vector)), F.lit(False)))
    base = usable.select(named.alias("scope"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    per_tile = F.lit(tile_rows) if tile_rows else F.greatest(F.lit(1), F.floor(tile_bytes / (8 * F.max(F.size("vector")))))

    def nearest(batches):
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int64)
            right = np.flatnonzero(pdf["vector"].map(len).to_numpy() == pivots.shape[1])
            if len(right) and len(pivots):
                cell[right] = np.argmax(_matrix(pdf["vector"].iloc[right]) @ pivots.T, axis=1)
            yield pdf.assign(cell=cell)

    if pivots is None:
        placed = base.withColumn("tile", F.lit(0).cast("long"))
    else:
        base = pin(base.mapInPandas(nearest, f"scope string, id {dict(base.dtypes)['id']}, vector array<double>, cell long"))
        sizes = base.groupBy("scope", "cell").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / per_tile).cast("int").alias("parts"))
        placed = attach(base, sizes, ["scope", "cell"], F.col("id"), weight="n")
        placed = placed.withColumn("tile", F.shiftleft("cell", 32) + F.pmod(F.xxhash64("id"), F.col("parts")))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        matrix = _matrix(group["vector"])
        size = np.linalg.norm(matrix, axis=1, keepdims=True)
        unit = matrix / np.maximum(size, 1e-12)
        centre = unit.mean(axis=0)
        centre /= max(np.linalg.norm(centre), 1e-12)
        away = np.arccos(np.clip(unit[size[:, 0] > 0] @ centre, -1.0, 1.0))
        first = group.iloc[0]
        return pd.DataFrame([[first["scope"], first["tile"], matrix.shape[1], group["id"].to_numpy().tobytes(), matrix.tobytes(), len(matrix), centre.tolist(), away.max(initial=0.0), bool((size <= 1e-12).any())]])

    schema = "scope string, tile long, dim int, ids binary, matrix binary, n long, centre array<double>, radius double, zero boolean"
    return placed.groupBy("scope", "tile").applyInPandas(pack, schema)


def _bundles(tiles: DataFrame, tile_bytes: int) -> int:
    """In how many bundles the tiles of a side travel: of about ``tile_bytes`` at most, and enough of them for the tasks of a shuffle."""
    size = tiles.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("dim")), F.lit(0)).alias("cells")).first()
    wanted = math.ceil(math.sqrt(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return max(1, math.ceil(8 * size.cells / tile_bytes), min(wanted, size.n // LEAST_ROWS))


def tile_pairs(left: DataFrame, right: DataFrame, prune: bool, bundles: tuple[int, int] | None = None) -> DataFrame:
    """scope, qt, gt of all pairs of tiles of a scope, with ``bound``, which no cosine in the pair exceeds, and their ``place`` for the query tile, nearest centre first.

    ``qb`` and ``gb`` are the bundles of both tiles, by hash; without ``bundles``, how many there are of each side, a tile is its own.
    """
    summary = lambda tiles, name: tiles.select("scope", F.col("tile").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("centre", "radius", "zero", "n")])
    pairs = summary(left, "qt").join(summary(right, "gt"), "scope")
    bundle = [F.pmod(F.xxhash64(t), F.lit(n)).alias(b) for t, b, n in zip(("qt", "gt"), ("qb", "gb"), bundles)] if bundles else [F.col("qt").alias("qb"), F.col("gt").alias("gb")]
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), A.dot(F.col("qt_centre"), F.col("gt_centre")))))
    # the angle between two vectors is at least that of the centres less both radii
    least = F.greatest(F.lit(0.0), angle - F.col("qt_radius") - F.col("gt_radius") - 1e-6)
    bound = F.when(least >= math.pi, -1.0).otherwise(F.cos(least))
    bound = F.when(F.col("qt_zero") | F.col("gt_zero"), F.greatest(bound, F.lit(0.0))).otherwise(bound)
    order = Window.partitionBy("scope", "qt").orderBy("angle", "gt")
    placed = pairs.withColumns({"angle": angle if prune else F.lit(0.0), "bound": bound if prune else F.lit(float("inf"))}).withColumn("place", F.row_number().over(order))
    return placed.select("scope", "qt", "gt", *bundle, "bound", "place", F.col("qt_n").alias("queries"))


def _unpacked(side: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids and matrix of every tile."""
    return [np.frombuffer(x, np.int64) for x in side["ids"]], [np.frombuffer(x, np.float64).reshape(-1, n) for x, n in zip(side["matrix"], side["dim"])]


def _compared(left: DataFrame, right: DataFrame, pairs: DataFrame, k: int, matcher: Matcher) -> DataFrame:
    """scope, qt, query_id, ref_id and score of the best ``k`` references of every query in the pairs of tiles of each pair of bundles."""
    met = pairs.groupBy("scope", "qt", "qb", "gb").agg(F.collect_list("gt").alias("met"))
    asking = left.select("scope", F.col("tile").alias("qt"), *_PACKED).join(met, ["scope", "qt"])
    offered = right.select("scope", F.col("tile").alias("gt"), *_PACKED).join(pairs.select("scope", "gt", "qb", "gb").distinct(), ["scope", "gt"])
    offered = offered.select(*[F.col(c).alias(c) for c in offered.columns])  # columns of its own
    return _best_of_tiles(asking, offered, k, matcher)


def _best_of_tiles(asking: DataFrame, offered: DataFrame, k: int, matcher: Matcher) -> DataFrame:
    """The best ``k`` of every query among the tiles that its own has ``met``, of one pair of bundles (``qb``, ``gb``) in a task."""

    def compare(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        (query_ids, queries), (ref_ids, refs) = _unpacked(q), _unpacked(g)
        number = {tile: i for i, tile in enumerate(g["gt"])}
        # query tiles that have met the same tiles are compared with them at once
        alike: dict[tuple[int, ...], list[int]] = {}
        for i, met in enumerate(q["met"]):
            alike.setdefault(tuple(sorted(number[t] for t in met if t in number)), []).append(i)
        found = [pd.DataFrame({"qt": [], "query_id": [], "ref_id": [], "score": []}).astype({"qt": "int64", "query_id": "int64", "ref_id": "int64"})]
        for met, tiles in alike.items():
            if not met:
                continue
            tile_of = np.repeat(q["qt"].to_numpy()[tiles], [len(query_ids[i]) for i in tiles])
            asked, vectors = np.concatenate([query_ids[i] for i in tiles]), np.concatenate([queries[i] for i in tiles])
            offers, others = np.concatenate([ref_ids[i] for i in met]), np.concatenate([refs[i] for i in met])
            for i in range(0, len(asked), STRIP):
                rows, part = np.arange(i, min(i + STRIP, len(asked))), []
                step = STRIP * STRIP // len(rows)
                for j in range(0, len(offers), step):
                    scores = matcher(vectors[i : i + STRIP], others[j : j + step])
                    part.append(_best(scores, rows, offers[j : j + step], k))
                best = pd.concat(part).sort_values(["query_id", "score", "ref_id"], ascending=[True, False, True])
                best = best.groupby("query_id").head(k)
                found.append(best.assign(qt=tile_of[best["query_id"]], query_id=asked[best["query_id"]]))
        return pd.concat(found).assign(scope=q["scope"].iloc[0] if len(q) else "")[["scope", "qt", "query_id", "ref_id", "score"]]

    pair = ["scope", "qb", "gb"]
    return asking.groupBy(*pair).cogroup(offered.groupBy(*pair)).applyInPandas(compare, "scope string, qt long, query_id long, ref_id long, score double")


def search(
    query: DataFrame, gallery: DataFrame, k: int, vector: str = "embedding", key: str = "ref_id", scope: str | None = None,
    tile_bytes: int = TILE_BYTES, block_rows: int | None = None, matcher: Matcher = cosine_matrix,
) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` references per query within the gallery tiles that can hold some of its best, and the compared pairs of tiles.

    With ``scope`` (an organisation) queries only meet the gallery of their own. Every query tile is
    first compared with the gallery tile of the nearest centre. Its worst k-th score is a bar; a
    pair of tiles whose bound is below it holds none of the best and isn't compared. The bound is
    that of the cosine, so with another matcher all pairs are. Inside a task the product is made in
    strips, and only ``k`` rows per query leave it. Tiles of ``block_rows`` rows travel in bundles,
    so the copies of a vector are as many as there are bundles of the other side, and so are the
    lists of a query.
    """
    pivots = _pivots(query, gallery, vector, key, tile_bytes, block_rows)
    if pivots is None:  # each scope is one pair of tiles
        left, right = (packed_tiles(side, vector, key, scope, tile_bytes).select("scope", *[F.col("tile").alias(c) for c in ("qt", "gt", "qb", "gb")], *_PACKED) for side in (query, gallery))
        return _best_of_tiles(left.withColumn("met", F.array("gt")), right, k, matcher).select("query_id", "ref_id", "score"), left.select("scope", "qt", "gt").join(right.select("scope"), "scope")
    left, right = (pin(packed_tiles(side, vector, key, scope, tile_bytes, block_rows, pivots)) for side in (query, gallery))
    bundles = (_bundles(left, tile_bytes), _bundles(right, tile_bytes)) if block_rows else None
    pairs = pin(tile_pairs(left, right, matcher is cosine_matrix, bundles))
    first = pairs.filter("place = 1")
    near = pin(_compared(left, right, first, k, matcher))
    kth = near.groupBy("scope", "qt", "query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    bars = kth.groupBy("scope", "qt").agg(F.min("kth").alias("bar"), F.count("kth").alias("full"))
    # a query without k scores yet takes anything
    open_pairs = pairs.filter("place > 1").join(bars, ["scope", "qt"], "left").filter("full is null or full < queries or bound >= bar - 1e-9")
    compared = pin(open_pairs.select(*pairs.columns))
    return near.unionByName(_compared(left, right, compared, k, matcher)).select("query_id", "ref_id", "score"), first.unionByName(compared).select("scope", "qt", "gt")


def block_shortlists(query: DataFrame, gallery: DataFrame, k: int, **options) -> DataFrame:
    """Best ``k`` references per query within the compared tiles of each bundle of the gallery (the cheap first phase of ``search``)."""
    return search(query, gallery, k, **options)[0]


def shortlist(query: DataFrame, gallery: DataFrame, k: int, **options) -> DataFrame:
    """Best ``k`` references per query over the whole gallery, with their ``position``.

    The list is written once: what follows reads it, however often.
    """
    partial = block_shortlists(query, gallery, k, **options)
    return pin(top_per_group(partial, ["query_id"], [F.col("score").desc(), F.col("ref_id")], k))


def cosine(left: Column, right: Column, eps: float = 1e-12) -> Column:
    """Cosine of two arrays, inside the JVM."""
    size = lambda a: F.greatest(A.norm(a), F.lit(eps))
    return A.dot(left, right) / size(left) / size(right)


def with_features(pairs: DataFrame, query: DataFrame, gallery: DataFrame, features: list[str], key: str = "ref_id") -> DataFrame:
    """Pairs with the features of both sides, as ``q_*`` and ``r_*``.

    Only shortlisted references are looked up; one that is shortlisted by very many queries is
    spread over several tasks.
    """
    used = pairs.groupBy(F.col("ref_id").alias("_used")).agg(F.count(F.lit(1)).alias("_uses"))
    refs = gallery.join(used, F.col(key) == F.col("_used")).select(F.col(key).alias("ref_id"), "_uses", *[F.col(f).alias(f"r_{f}") for f in features])
    queries = query.select(F.col(key).alias("_qid"), *[F.col(f).alias(f"q_{f}") for f in features])
    joined = pairs.join(queries, F.col("query_id") == F.col("_qid")).drop("_qid")
    return attach(joined, refs, ["ref_id"], F.col("query_id"), how="inner", weight="_uses").drop("_uses")


def row_cosine(left: np.ndarray, right: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    size = np.maximum(np.linalg.norm(left, axis=1), eps) * np.maximum(np.linalg.norm(right, axis=1), eps)
    return np.einsum("ij,ij->i", left, right) / size


def matcher_column(matcher: Matcher, left: Column, right: Column) -> Column:
    """Score of given pairs by a caller's matcher: two matrices of paired rows in, one score per row out."""

    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        if len(a) == 0:
            return pd.Series([], dtype="float64")
        return pd.Series(np.asarray(matcher(_matrix(a), _matrix(b)), dtype=np.float64))

    return F.pandas_udf(score, T.DoubleType())(left, right)


def hits(left_label: str, right_label: str) -> Column:
    """Whether the labels of a pair agree, compared as text."""
    return F.coalesce(F.col(left_label).cast("string") == F.col(right_label).cast("string"), F.lit(False))


def fused(scores: list[Column]) -> Column:
    """Mean over matchers; null (not scored) if one of them has not scored the pair."""
    total = scores[0]
    for other in scores[1:]:
        total = total + other
    return total / len(scores)


def fused_scores(
    query: DataFrame, gallery: DataFrame, matchers: list[Callable[[Column, Column], Column]], calibrations: list, depth: int,
    vector: str = "embedding", label: str = "identity", key: str = "ref_id", scope: str | None = None,
) -> DataFrame:
    """Shortlist by cosine and score the shortlist with every matcher.

    A matcher maps the two embeddings of a pair to a score column; its calibration (or None)
    turns the score into a probability.
    """
    pairs = shortlist(query, gallery, depth, vector=vector, key=key, scope=scope).select("query_id", "ref_id")
    rows = with_features(pairs, query, gallery, [label, vector], key)
    left, right = F.col(f"q_{vector}").cast("array<double>"), F.col(f"r_{vector}").cast("array<double>")
    scores = []
    for matcher, model in zip(matchers, calibrations):
        raw = matcher(left, right)
        scores.append(raw if model is None else model.predict(raw))
    scored = rows.select("query_id", "ref_id", F.col(f"r_{label}").alias("identity"), fused(scores).alias("score"))
    return scored.filter("score is not null")


def top_identities(pairs: DataFrame, k: int) -> DataFrame:
    """Best ``k`` distinct identities per query, each with its best reference.

    ``pairs`` has ``query_id``, ``ref_id``, ``identity``, ``score``.
    """
    best = F.max_by(F.struct("ref_id", "score"), F.struct(F.col("score"), -F.col("ref_id")))
    rows = pairs.groupBy("query_id", "identity").agg(best.alias("_best")).select("query_id", "identity", "_best.*")
    return top_per_group(rows, ["query_id"], [F.col("score").desc(), F.col("ref_id")], k)


def result_arrays(top: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """One row per query with parallel arrays of ``k`` identities, paths and scores in [0, 1].

    Short lists repeat their last entry. ``top`` has at most ``k`` rows per query.
    """
    used = top.groupBy(F.col("ref_id").alias("_used")).agg(F.count(F.lit(1)).alias("_uses"))
    known = paths.join(used, F.col("ref_id") == F.col("_used")).select("ref_id", "path", "_uses")
    located = attach(top, known, ["ref_id"], F.col("query_id"), weight="_uses")
    entry = F.struct("position", "identity", "ref_id", A.clip01(F.col("score")).alias("score"), swap_variant(F.col("path")).alias("path"), F.col("path").alias("masked"))
    ranked = located.groupBy("query_id").agg(A.pad_with_last(F.sort_array(F.collect_list(entry)), k).alias("_e"))
    take = lambda f: F.transform("_e", lambda e: e[f])
    return ranked.select(
        "query_id", take("identity").alias("class_ids"), take("path").alias("paths"), take("masked").alias("masked_paths"), take("score").alias("scores"), take("ref_id").alias("ref_ids")
    )


def first_distinct(ranked: DataFrame, group: str, name: str, rank: str, k: int) -> DataFrame:
    """First ``k`` distinct names of each ranked list, at their first rank."""
    firsts = ranked.groupBy(group, name).agg(F.min(rank).alias(rank))
    return top_per_group(firsts, [group], [F.col(rank)], k)


def rerank(pairs: DataFrame, k: int, threshold: float = 100.0) -> DataFrame:
    """Local scores over the threshold override the cosine order, position by position.

    ``pairs`` has ``query_id``, ``ref_id``, ``identity``, ``cosine`` and ``local``. The best
    reference of each of the ``k`` best identities by cosine is also ordered by its local score;
    where the local score at a position is over the threshold its reference is taken.
    """
    best = F.max_by(F.struct("ref_id", "cosine", "local"), F.struct(F.col("cosine"), -F.col("ref_id")))
    per_identity = pairs.groupBy("query_id", "identity").agg(best.alias("_b")).select("query_id", "identity", "_b.*")
    top = top_per_group(per_identity, ["query_id"], [F.col("cosine").desc(), F.col("ref_id")], k, "position")
    by_local = Window.partitionBy("query_id").orderBy(F.col("local").desc(), F.col("position"))  # k rows per query
    places = top.withColumn("_local_place", F.row_number().over(by_local))
    other = places.select(
        F.col("query_id").alias("_q"), F.col("_local_place").alias("_p"), F.col("ref_id").alias("_local_ref"), F.col("local").alias("_local_score")
    )
    joined = places.join(other, (F.col("query_id") == F.col("_q")) & (F.col("position") == F.col("_p")))
    chosen = F.when(F.col("_local_score") > threshold, F.col("_local_ref")).otherwise(F.col("ref_id"))
    return joined.select("query_id", "position", chosen.alias("ref_id"))


def nearest_label(pairs: DataFrame, k: int = 1) -> DataFrame:
    """Label of each query by its ``k`` nearest references (``k`` = 1: the nearest one).

    Votes are counted per label; on a tie the label with the nearer reference wins.
    """
    near = top_per_group(pairs, ["query_id"], [F.col("score").desc(), F.col("ref_id")], k)
    votes = near.groupBy("query_id", "identity").agg(F.count(F.lit(1)).alias("_n"), F.min("position").alias("_p"))
    return votes.groupBy("query_id").agg(F.max_by("identity", F.struct(F.col("_n"), -F.col("_p"))).alias("predicted"))


def angle(left: Column, right: Column) -> Column:
    """Angle of two vectors in degrees."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(left, right, 0.0)))))


def calibration_rows(gallery: DataFrame, rows: int = 50, key: str = "ref_id", scope: str | None = None) -> DataFrame:
    """The first gallery rows in key order, of each organisation with ``scope``: the size of the calibration set is a parameter."""
    if scope:
        return top_per_group(gallery, [scope], [F.col(key)], rows, "_place").drop("_place")
    return gallery.orderBy(key).limit(rows)


def identification_input(named_media: DataFrame) -> DataFrame:
    """One row per media file with its label, locality and sequence."""
    return named_media.select(
        F.col("id").alias("mediafile_id"), F.col("identity_id").alias("class_id"), F.col("identity_name").alias("label"), "locality_id",
        F.coalesce("locality_name", F.lit("")).alias("locality_name"), F.nullif("locality_location", F.lit("")).alias("locality_coordinates"),
        F.col("sequence_id").alias("sequence_number"),
    )


# ---- one vector per sequence ----------------------------------------------------------------


def reduce_sequences(rows: DataFrame, sequence: str, key: str, reducer: Column, out: str) -> DataFrame:
    """Give every row of a sequence the value of a caller's reducer, any aggregate expression.

    An aggregate is combined map-side, so a sequence of any size can be reduced.
    """
    reduced = rows.groupBy(sequence).agg(reducer.alias(out), F.count(F.lit(1)).alias("_rows"))
    return attach(rows, reduced, [sequence], F.col(key), weight="_rows").drop("_rows")


def best_of_sequence(rows: DataFrame, sequence: str, vector: str, score: str, ref: str, key: str, method: str) -> DataFrame:
    """Replace the vector of every row by that of the best row of its sequence.

    ``top_score`` takes the row of highest score; ``top_frequent`` the highest-scoring row among
    those that point to the reference most rows of the sequence point to (the smaller reference
    on ties). The smaller key wins equal scores.
    """
    pick = F.max_by(F.col(vector), F.struct(F.col(score), -F.col(key)))
    if method == "top_score":
        chosen = rows.groupBy(sequence).agg(pick.alias("_vector"), F.count(F.lit(1)).alias("_rows"))
    else:
        per_ref = rows.groupBy(sequence, ref).agg(F.count(F.lit(1)).alias("_n"), pick.alias("_v"))
        chosen = per_ref.groupBy(sequence).agg(F.max_by("_v", F.struct(F.col("_n"), -F.col(ref))).alias("_vector"), F.sum("_n").alias("_rows"))
    return attach(rows.drop(vector), chosen, [sequence], F.col(key), weight="_rows").drop("_rows").withColumnRenamed("_vector", vector)


def _angles(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.degrees(np.arccos(np.clip(cosine_matrix(left, right), -1.0, 1.0)))


def _components(linked: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from every row."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(linked)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def cluster_one(keys: np.ndarray, vectors: np.ndarray, scores: np.ndarray, limit: float, multiplier: float) -> np.ndarray:
    """The vector that stands for one sequence of bounded size. A missing score loses to every other."""
    order = np.argsort(keys, kind="stable")
    scores = np.asarray(scores, np.float64)
    vectors, scores = vectors[order], np.where(np.isnan(scores), -np.inf, scores)[order]
    if len(vectors) == 1:
        return vectors[0]
    angles = _angles(vectors, vectors)
    np.fill_diagonal(angles, 361.0)
    closest = angles.min()
    if closest > limit:
        return vectors[np.argmax(scores)]
    label = _components((angles <= multiplier * closest) | np.eye(len(angles), dtype=bool))
    best, chosen = None, None
    for group in np.unique(label):
        members = np.flatnonzero(label == group)
        if len(members) < 2:
            continue
        inside = angles[np.ix_(members, members)][np.tril_indices(len(members), -1)]
        mean = inside.sum() / max((inside > 0).sum(), 1)
        if best is None or mean < best:
            best, chosen = mean, members
    return vectors[chosen].sum(axis=0)


def cluster_sequences(
    rows: DataFrame, sequence: str = "sequence_id", key: str = "ref_id", vector: str = "embedding", score: str = "score",
    limit: float = 45.0, multiplier: float = 2.0, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One vector per sequence: the sum of its tightest cluster of similar views.

    If no two vectors are within ``limit`` degrees the vector of the best score stands for the
    sequence (a null or NaN score loses to every other, and the smaller key wins a tie). Otherwise vectors are linked while they are within ``multiplier`` times the
    smallest angle (closest pairs first, groups being as close as their closest members, which
    makes the groups the connected components of that graph) and the group with the smallest
    mean angle is summed.

    Rows without a finite vector take no part, and a sequence of only such rows gives none.
    Sequences of at most ``block_rows`` rows are one small task each. Longer ones are compared
    block by block: smallest angle, labels and mean angles are reduced inside the tasks.
    """
    rows = rows.filter(F.coalesce(_finite(F.col(vector)), F.lit(False)))
    sizes = rows.groupBy(F.col(sequence).alias("seq")).agg(F.count(F.lit(1)).alias("n"))
    base = rows.select(F.col(sequence).alias("seq"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double")).alias("score"))
    sized = attach(base, sizes, ["seq"], F.col("key"), weight="n")
    schema = "seq long, vector array<double>"

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        vec = cluster_one(pdf["key"].to_numpy(), _matrix(pdf["vector"]), pdf["score"].to_numpy(), limit, multiplier)
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]], "vector": [vec]})

    short = sized.filter(F.col("n") <= block_rows).groupBy("seq").applyInPandas(small, schema)
    long_rows = sized.filter(F.col("n") > block_rows).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    if long_rows.isEmpty():
        chosen = short
    else:
        chosen = short.unionByName(_cluster_long(pin(long_rows), limit, multiplier))
    return chosen.select(F.col("seq").alias(sequence), F.col("vector").alias(vector))


def _compare_blocks(rows: DataFrame, columns: list[str], compare, schema: str) -> DataFrame:
    """Run ``compare(left, right)`` on every pair of blocks of every sequence."""
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    blocked = rows.select("seq", "key", "vector", *columns, "blocks", own.alias("own"))
    left = blocked.withColumnRenamed("own", "a").withColumn("b", every)
    right = blocked.select(*[F.col(c).alias(c) for c in blocked.columns]).withColumnRenamed("own", "b").withColumn("a", every)  # columns of its own
    return left.groupBy("seq", "a", "b").cogroup(right.groupBy("seq", "a", "b")).applyInPandas(compare, schema)


def smallest_angles(rows: DataFrame, sequence: str = "sequence_id", key: str = "ref_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Smallest angle between two vectors of each sequence (``sequence``, ``angle``), compared block by block.

    A sequence of one row has none and is left out; rows without a finite vector take no part.
    """
    base = rows.filter(F.coalesce(_finite(F.col(vector)), F.lit(False))).select(F.col(sequence).alias("seq"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    sizes = base.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    sized = attach(base, sizes, ["seq"], F.col("key"), weight="n").withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    found = _compare_blocks(sized, [], _closest, "seq long, angle double").groupBy("seq").agg(F.min("angle").alias("angle"))
    return found.filter("angle < 361").withColumnRenamed("seq", sequence)


def _block_angles(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    angles = _angles(_matrix(a["vector"]), _matrix(b["vector"]))
    angles[a["key"].to_numpy()[:, None] == b["key"].to_numpy()[None, :]] = 361.0
    return angles


def _closest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    if a.empty or b.empty:
        return pd.DataFrame({"seq": [], "angle": []}).astype({"seq": "int64", "angle": "float64"})
    return pd.DataFrame({"seq": [a["seq"].iloc[0]], "angle": [_block_angles(a, b).min()]})


def _cluster_long(rows: DataFrame, limit: float, multiplier: float) -> DataFrame:
    nearest = pin(_compare_blocks(rows, [], _closest, "seq long, angle double").groupBy("seq").agg(F.min("angle").alias("closest")))
    apart = attach(rows, nearest.filter(F.col("closest") > limit), ["seq"], F.col("key"), how="inner")
    by_score = apart.groupBy("seq").agg(F.max_by("vector", F.struct(F.col("score"), -F.col("key"))).alias("vector"))
    linked = pin(attach(rows, nearest.filter(F.col("closest") <= limit), ["seq"], F.col("key"), how="inner").withColumn("label", F.col("key")))

    def smallest_label(a, b):
        if a.empty or b.empty:
            return pd.DataFrame({"key": [], "label": []}).astype("int64")
        near = _block_angles(a, b) <= multiplier * a["closest"].iloc[0]
        label = np.where(near, b["label"].to_numpy()[None, :], a["label"].to_numpy()[:, None]).min(axis=1)
        return pd.DataFrame({"key": a["key"].to_numpy(), "label": np.minimum(label, a["label"].to_numpy())})

    while True:
        spread = _compare_blocks(linked, ["label", "closest"], smallest_label, "key long, label long").groupBy("key").agg(F.min("label").alias("new"))
        onward = spread.select(F.col("key").alias("new"), F.col("new").alias("jump"))
        jumped = attach(spread, onward, ["new"], F.col("key")).select(F.col("key").alias("_k"), F.least("new", "jump").alias("new"))
        moved = pin(linked.join(jumped, F.col("key") == F.col("_k")).drop("_k"))
        changed = not moved.filter("new != label").isEmpty()
        linked = moved.withColumn("label", F.col("new")).drop("new")
        if not changed:
            break

    def spread_of(a, b):
        if a.empty or b.empty:
            return pd.DataFrame({"seq": [], "label": [], "total": [], "pairs": []}).astype({"seq": "int64", "label": "int64", "total": "float64", "pairs": "int64"})
        angles = _block_angles(a, b)
        same = (a["label"].to_numpy()[:, None] == b["label"].to_numpy()[None, :]) & (a["key"].to_numpy()[:, None] > b["key"].to_numpy()[None, :])
        row, column = np.nonzero(same)
        sums = pd.DataFrame({"label": a["label"].to_numpy()[row], "total": angles[row, column], "pairs": (angles[row, column] > 0).astype("int64")})
        return sums.groupby("label", as_index=False).sum().assign(seq=a["seq"].iloc[0])[["seq", "label", "total", "pairs"]]

    partial = _compare_blocks(linked, ["label"], spread_of, "seq long, label long, total double, pairs long")
    groups = partial.groupBy("seq", "label").agg((F.sum("total") / F.greatest(F.sum("pairs"), F.lit(1))).alias("mean"))
    best = groups.groupBy("seq").agg(F.min_by("label", F.struct("mean", "label")).alias("best"))
    members = attach(linked, best, ["seq"], F.col("key"), how="inner").filter("label = best")
    return by_score.unionByName(vector_per_group(members, "seq", "vector", "sum"))
