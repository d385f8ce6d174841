"""Approximate nearest neighbours by inner product over robust-pruned directed graphs, one per shard of vectors.

Within a shard every vector gets one more component that makes all norms equal, so the largest
inner product is the smallest distance. The graph is built in batches: a greedy search over the
graph so far proposes neighbours, and pruning keeps a neighbour unless one kept before is nearer to
it by the factor alpha; edges are drawn back and pruned the same way. Queries go through each shard
by beam search.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm.tables import kept

# Distinct vectors of a shard, and queries of a block, on average: what a task holds in memory.
SHARD_ROWS, BLOCK_ROWS = 8_192, 4_096
# Out-edges of a vector, beams of building and searching, and the relaxation of pruning.
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 48, 96, 1.2
# Vectors of a shard are alike in size: their largest components are within a factor of two to the power of so much.
BAND = 16
# Vectors whose neighbours are searched at once, and nodes that a search expands at once.
BATCH, EXPAND = 256, 4


def squared(points: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own row of points."""
    apart = points[ids] - queries[:, None, :]
    return np.einsum("bnd,bnd->bn", apart, apart)


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest points that a greedy search from ``start`` finds for each query (-1: none), and their squared distances."""
    b = len(queries)
    rows = np.arange(b)[:, None]
    ids, far, done = np.full((b, beam), -1), np.full((b, beam), np.inf, np.float32), np.ones((b, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    far[:, 0] = squared(points, ids[:, :1], queries)[:, 0]
    seen = np.zeros((b, len(points) + 1), bool)
    seen[:, start] = seen[:, -1] = True  # the last column stands for "no neighbour"
    live = np.arange(b)
    while len(live):
        order = np.argsort(done[live], axis=1, kind="stable")[:, :EXPAND]  # the nearest ones that aren't expanded
        here = live[:, None]
        pick = np.where(done[here, order], -1, ids[here, order])
        done[here, order] = True
        near = np.where(pick[:, :, None] >= 0, graph[pick], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = ~seen[here, near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[here, near] = True
        width = int(fresh.sum(axis=1).max(initial=0))
        if width:
            front = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            near, fresh = np.take_along_axis(near, front, 1), np.take_along_axis(fresh, front, 1)
            apart = np.where(fresh, squared(points, near, queries[live]), np.inf).astype(np.float32)
            all_ids, all_far = np.concatenate((ids[live], near), 1), np.concatenate((far[live], apart), 1)
            all_done = np.concatenate((done[live], ~fresh), 1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            ids[live], far[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_far, all_done))
        live = live[~done[live].all(axis=1)]
    return np.where(np.isfinite(far), ids, -1), far


def robust_prune(points: np.ndarray, candidates: np.ndarray, far: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates (sorted by distance, -1: none) the diverse ones, at most ``degree`` (-1: none)."""
    vectors = points[candidates]
    norms = np.einsum("bnd,bnd->bn", vectors, vectors)
    between = np.maximum(norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1)), 0)
    alive = (candidates >= 0) & np.isfinite(far)
    out, every = np.full((len(candidates), degree), -1, np.int64), np.arange(len(candidates))
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[every, first]
        if not some.any():
            break
        out[some, k] = candidates[every, first][some]
        alive &= alpha * alpha * between[every, first] > far
        alive[every, first] = False
    return out


def augmented(vectors: np.ndarray) -> np.ndarray:
    """Vectors with a component that brings all norms to the largest one."""
    norms = np.einsum("nd,nd->n", vectors, vectors)
    return np.column_stack((vectors, np.sqrt(np.maximum(norms.max() - norms, 0)))).astype(np.float32)


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, int]:
    """Neighbours of every point (-1: none) and the point where searches start."""
    n = len(points)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([start], order[order != start]))
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        at, size = at + len(batch), min(BATCH, 2 * size)
        ids, far = beam_search(points, graph, start, points[batch], beam)
        graph[batch] = robust_prune(points, ids, far, degree, alpha)
        source, target = np.repeat(batch, degree), graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by_target = np.argsort(target, kind="stable")
        source, target = source[by_target], target[by_target]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        new = np.full((len(nodes), int(count.max())), -1)
        new[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        wanted = np.concatenate((graph[nodes], new), 1)
        apart = np.where(wanted >= 0, squared(points, wanted, points[nodes]), np.inf).astype(np.float32)
        nearest = np.argsort(apart, axis=1, kind="stable")[:, : 2 * degree]
        wanted, apart = np.take_along_axis(wanted, nearest, 1), np.take_along_axis(apart, nearest, 1)
        full = np.isfinite(apart).sum(axis=1) > degree
        graph[nodes] = wanted[:, :degree] if wanted.shape[1] >= degree else graph[nodes]
        if full.any():
            graph[nodes[full]] = robust_prune(points, wanted[full], apart[full], degree, alpha)
    return graph, start


def scaled(vectors: np.ndarray, band: int) -> np.ndarray:
    """Vectors of a band in 32-bit floats, with components of at most one. A power of two loses no digits, and no order of products."""
    return np.ldexp(vectors, -BAND * (band + 1)).astype(np.float32)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA,
) -> DataFrame:
    """The ``k`` rows nearest to each query by inner product, all of them if there are fewer.

    ``queries`` is the condition on ``vectors`` that picks the queries; a query's own row is no
    candidate. Returns query_id, rank (from 1), vec_id and score (inner product in double
    precision of the vectors as they are), ties to the smaller id. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor rows without id; vectors of another length meet only
    their like. A repeated row counts once.

    Equal vectors are one node that knows its k + 1 smallest ids, so copies cost nothing and crowd
    nothing out. Shards are cut by size of the vectors, so that no vector vanishes beside a larger
    one in the graph's 32-bit floats, and by hash; one task holds the graph of one shard and one block of
    queries. Each query gets k candidates from each shard, cut to k at the end.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), queries.alias("is_query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct().withColumn("dim", F.size("embedding"))
    copies = rows.select("vec_id", "embedding", "dim").withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    band = F.floor(F.log2(F.array_max(F.transform("embedding", F.abs))) / BAND).cast("int").alias("band")
    nodes = kept(copies.groupBy("embedding", "dim", band).agg(F.collect_list("vec_id").alias("ids")), "vectors")
    asked = rows.filter("is_query")
    # doubles have exponents for some 130 bands
    sizes = {r["band"]: r["n"] for r in nodes.groupBy("band").agg(F.count(F.lit(1)).alias("n")).orderBy("band").collect()}
    shards, shard = 0, F.lit(None).cast("int")
    for one, n in sizes.items():
        count = math.ceil(n / shard_rows)
        place = (F.lit(shards) + F.pmod(F.xxhash64("embedding"), F.lit(count))).cast("int")
        shard, shards = F.when(F.col("band") == one, place).otherwise(shard), shards + count
    shards, blocks = max(1, shards), max(1, math.ceil(asked.count() / block_rows))

    def built(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(least=[min(x) for x in group["ids"]]).sort_values("least")
        x, own = np.stack(group["embedding"].to_numpy()), int(group["band"].iloc[0])
        graph, start = build(augmented(scaled(x, own)), degree, alpha=alpha) if len(x) > beam else (np.empty((0, degree), np.int64), 0)
        ids = [np.sort(np.asarray(i, np.int64)) for i in group["ids"]]
        lengths = np.array([len(i) for i in ids], np.int32)
        return pd.DataFrame([[group["dim"].iloc[0], group["shard"].iloc[0], own, start, x.tobytes(), graph.astype(np.int32).tobytes(), np.concatenate(ids).tobytes(), lengths.tobytes()]])

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        x = np.stack(group["embedding"].to_numpy())
        bands = group["band"].to_numpy(np.int32)
        return pd.DataFrame([[group["dim"].iloc[0], group["block"].iloc[0], group["vec_id"].to_numpy().tobytes(), x.tobytes(), bands.tobytes()]])

    def searched(graphs: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g in graphs.itertuples():
            x = np.frombuffer(g.vectors, np.float64).reshape(-1, g.dim)
            edges = np.frombuffer(g.edges, np.int32).reshape(-1, degree).astype(np.int64)
            ids, lengths = np.frombuffer(g.ids, np.int64), np.frombuffer(g.lengths, np.int32)
            first = np.concatenate(([0], np.cumsum(lengths)))
            points = augmented(scaled(x, g.band))
            for q in asking.itertuples():
                query_ids = np.frombuffer(q.query_ids, np.int64)
                queries = np.frombuffer(q.vectors, np.float64).reshape(-1, g.dim)
                alike = scaled(queries, np.frombuffer(q.bands, np.int32)[:, None])
                for i in range(0, len(queries), BATCH):
                    some = queries[i : i + BATCH]
                    if len(edges):
                        found, _ = beam_search(points, edges, g.start, np.column_stack((alike[i : i + BATCH], np.zeros(len(some), np.float32))), beam)
                    else:
                        found = np.tile(np.arange(len(x)), (len(some), 1))
                    scores = np.einsum("bnd,bd->bn", x[found], some)
                    scores[found < 0] = -np.inf
                    for query, nodes_found, near in zip(query_ids[i : i + BATCH], found, scores, strict=True):
                        # of equal scores all are taken, as their order is by id
                        least = np.partition(near, -min(k + 1, len(near)))[-min(k + 1, len(near))]
                        some_nodes = np.flatnonzero((near >= least) & (nodes_found >= 0))
                        taken = [(ids[first[j] : first[j + 1]], s) for j, s in zip(nodes_found[some_nodes], near[some_nodes], strict=True)]
                        candidates = np.concatenate([c for c, _ in taken])
                        score = np.repeat([s for _, s in taken], [len(c) for c, _ in taken])
                        score, candidates = score[candidates != query], candidates[candidates != query]
                        best = np.lexsort((candidates, -score))[:k]
                        out.append((np.full(len(best), query), candidates[best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    parts = nodes.withColumn("shard", shard)
    graphs = kept(parts.groupBy("dim", "shard").applyInPandas(built, "dim int, shard int, band int, start int, vectors binary, edges binary, ids binary, lengths binary"), "graphs")
    asked = asked.select("vec_id", "embedding", "dim", band, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    asking = asked.groupBy("dim", "block").applyInPandas(packed, "dim int, block int, query_ids binary, vectors binary, bands binary")
    # a stated set of queries meets every shard, block by block
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asking = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    key = ["dim", "shard", "block"]
    found = graphs.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(searched, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
