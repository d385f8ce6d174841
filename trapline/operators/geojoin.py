"""Nearest area and close localities, through tiles and grid cells instead of all pairs.

Coordinates are anonymised to three decimals, so many localities share a point: both operators
work on distinct points and attach the answer to the localities afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions import geometry as G
from trapline.operators.skew import attach
from trapline.session import pin

# Areas of a tile, tiles at most, points of a block, and areas of a leaf of the tree in a task.
TILE_AREAS, MOST_TILES, BLOCK_POINTS, LEAF = 4_096, 10_000, 65_536, 64
# Points whose distances to all leaves are held at once, and places of a block in which close points are counted.
AT_ONCE, CELL_POINTS = 8_192, 1_024
# Cells along a radius. Nothing but the cells that the circle crosses is compared place by place.
STEPS = 8


def with_coordinates(df: DataFrame, location: str = "location") -> DataFrame:
    lat, lon = G.lat_lon(F.col(location))
    return df.withColumns({"lat": lat, "lon": lon})


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size))


def _neighbourhood(points: DataFrame, size: float) -> DataFrame:
    """Every point once for each of the nine cells around it."""
    around = F.sequence(F.lit(-1), F.lit(1))
    return (
        points.withColumn("_dx", F.explode(around))
        .withColumn("_dy", F.explode(around))
        .withColumn("_cx", _cell(F.col("lat"), size) + F.col("_dx"))
        .withColumn("_cy", _cell(F.col("lon"), size) + F.col("_dy"))
        .drop("_dx", "_dy")
    )


def _finite(df: DataFrame) -> DataFrame:
    """Rows with a place: both coordinates are numbers below infinity."""
    return df.filter("abs(lat) < double('infinity') and abs(lon) < double('infinity')")


def _tiled(spots: DataFrame, tile_areas: int) -> DataFrame:
    """``spots`` with the number of their tile: strips of latitude by quantiles, each cut by quantiles of longitude.

    A strip has as many tiles as its spots fill. There are at most about ``MOST_TILES`` tiles, so the
    cuts, which the driver sees, are bounded.
    """
    n = spots.count()
    size = max(tile_areas, math.ceil(n / MOST_TILES))
    strips = max(1, math.isqrt(math.ceil(n / size)))
    at = lambda cuts, value: F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value))
    cuts = spots.approxQuantile("_alat", [i / strips for i in range(1, strips)], 0.25 / strips) if strips > 1 else []
    placed = spots.withColumn("_strip", at(cuts, F.col("_alat")) if cuts else F.lit(0))
    pieces = F.ceil(F.count(F.lit(1)) / size).cast("int")
    quantile = F.percentile_approx("_alon", [i / 201 for i in range(1, 201)], 10_000)
    across = placed.groupBy("_strip").agg(pieces.alias("_pieces"), quantile.alias("_quantiles"))
    # of the quantiles those that lie next to equal parts; one strip is one row
    part = F.transform(F.sequence(F.lit(1), F.col("_pieces")), lambda i: F.element_at("_quantiles", F.least(F.greatest(F.round(i * 201 / F.col("_pieces")).cast("int"), F.lit(1)), F.lit(200))))
    across = across.select("_strip", F.when(F.col("_pieces") > 1, F.slice(part, 1, F.least(F.col("_pieces") - 1, F.lit(199)))).otherwise(F.array().cast("array<double>")).alias("_cuts"))
    joined = placed.join(F.broadcast(across), "_strip")  # at most the square root of MOST_TILES rows
    return joined.withColumn("_tile", F.col("_strip") * 1_000 + F.size(F.filter("_cuts", lambda c: c <= F.col("_alon")))).drop("_strip", "_cuts")


def _box_distance(x: np.ndarray, y: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Distances of points to boxes (rows: least and greatest x, least and greatest y), none above that to any place within."""
    dx = np.maximum(np.maximum(boxes[:, 0] - x[:, None], x[:, None] - boxes[:, 1]), 0)
    dy = np.maximum(np.maximum(boxes[:, 2] - y[:, None], y[:, None] - boxes[:, 3]), 0)
    return np.sqrt(dx * dx + dy * dy)


class _Packed:
    """Places packed into leaves of near ones, each with its box; the nearest are found leaf by leaf, the closest box first."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray):
        leaves = -(-len(x) // LEAF)
        strip = LEAF * max(1, math.isqrt(leaves))
        by_x = np.argsort(x, kind="stable")
        order = np.concatenate([part[np.argsort(y[part], kind="stable")] for part in np.split(by_x, range(strip, len(x), strip))])
        # the last leaf is filled up with its last place
        order = order[np.minimum(np.arange(leaves * LEAF), len(x) - 1)].reshape(leaves, LEAF)
        self.x, self.y, self.ids = x[order], y[order], ids[order]
        self.boxes = np.stack((self.x.min(1), self.x.max(1), self.y.min(1), self.y.max(1)), 1)

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and id of the nearest place of each point, the smaller id on ties."""
        best, found = np.full(len(x), np.inf), np.full(len(x), np.iinfo(np.int64).max)
        step = max(1, AT_ONCE * LEAF // max(LEAF, len(self.boxes)))
        for i in range(0, len(x), step):
            px, py = x[i : i + step], y[i : i + step]
            bound = _box_distance(px, py, self.boxes)
            order = np.argsort(bound, axis=1, kind="stable")
            todo = np.arange(len(px))
            for turn in range(len(self.boxes)):
                leaf = order[todo, turn]
                open_ = bound[todo, leaf] <= best[i + todo]
                todo, leaf = todo[open_], leaf[open_]
                if not len(todo):
                    break
                dx, dy = px[todo, None] - self.x[leaf], py[todo, None] - self.y[leaf]
                far = np.sqrt(dx * dx + dy * dy)
                least = far.min(1)
                ids = np.where(far == least[:, None], self.ids[leaf], np.iinfo(np.int64).max).min(1)
                at = i + todo
                better = (least < best[at]) | ((least == best[at]) & (ids < found[at]))
                best[at[better]], found[at[better]] = least[better], ids[better]
        return best, found


def _nearest_in_tile(points: DataFrame, spots: DataFrame) -> DataFrame:
    """The nearest spot within the tile that a point is sent to (``_tile``), as lat, lon, distance and area_id.

    Points of a tile are dealt into blocks of bounded size, for which the tile's spots are repeated.
    """
    blocks = points.groupBy("_tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK_POINTS).cast("int").alias("_blocks"))
    blocks = F.broadcast(blocks)  # a row per tile
    dealt = points.join(blocks, "_tile").withColumn("_block", F.pmod(F.xxhash64("lat", "lon"), F.col("_blocks")).cast("int"))
    copies = spots.join(blocks, "_tile").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"lat": [], "lon": [], "distance": [], "area_id": []}).astype({"area_id": "int64"})
        far, ids = _Packed(*(right[c].to_numpy() for c in ("_alat", "_alon", "_area"))).nearest(left["lat"].to_numpy(), left["lon"].to_numpy())
        return pd.DataFrame({"lat": left["lat"].to_numpy(), "lon": left["lon"].to_numpy(), "distance": far, "area_id": ids})

    names = ["lat", "lon", "_tile", "_block"]
    grouped = dealt.select(*names).groupBy("_tile", "_block").cogroup(copies.select("_tile", "_block", "_alat", "_alon", "_area").groupBy("_tile", "_block"))
    return grouped.applyInPandas(nearest, "lat double, lon double, distance double, area_id long")


def nearest_area(localities: DataFrame, areas: DataFrame, tile_areas: int = TILE_AREAS) -> DataFrame:
    """Add the closest area (the smaller id on ties) and its distance in degrees; null without a place or without areas.

    Areas on one spot count once. Spots are cut by quantiles into tiles, however unevenly they lie,
    and packed into a tree in the task of a tile. A point is sent to the tile whose box is nearest
    first, and then to those whose box is no farther than what it found there. The driver sees one
    box per tile.
    """
    placed = with_coordinates(localities)
    points = pin(_finite(placed).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("_here")))
    spots = _finite(with_coordinates(areas)).groupBy(F.col("lat").alias("_alat"), F.col("lon").alias("_alon")).agg(F.min(F.col("id").cast("long")).alias("_area"))
    spots = pin(_tiled(pin(spots), tile_areas))
    boxes = spots.groupBy("_tile").agg(F.min("_alat"), F.max("_alat"), F.min("_alon"), F.max("_alon")).orderBy("_tile").toPandas()
    tiles, corners = boxes["_tile"].to_numpy(np.int64), boxes.iloc[:, 1:].to_numpy(np.float64)
    if not len(tiles):
        return placed.withColumns({"closest_area_id": F.lit(None).cast("long"), "area_distance": F.lit(None).cast("double")})

    def closest_box(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i : i + 512]
                yield part.assign(_tile=tiles[_box_distance(part["lat"].to_numpy(), part["lon"].to_numpy(), corners).argmin(1)])

    def other_boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i : i + 512]
                bound = _box_distance(part["lat"].to_numpy(), part["lon"].to_numpy(), corners)
                row, tile = np.nonzero(bound <= part["distance"].to_numpy()[:, None])
                other = tile != bound.argmin(1)[row]
                yield pd.DataFrame({"lat": part["lat"].to_numpy()[row[other]], "lon": part["lon"].to_numpy()[row[other]], "_tile": tiles[tile[other]]})

    sent = "lat double, lon double, _tile long"
    near = pin(_nearest_in_tile(points.select("lat", "lon").mapInPandas(closest_box, sent), spots))
    if len(tiles) > 1:
        near = near.unionByName(_nearest_in_tile(pin(near.mapInPandas(other_boxes, sent)), spots))
    best = F.min(F.struct("distance", "area_id")).alias("_best")
    answers = points.join(near.groupBy("lat", "lon").agg(best), ["lat", "lon"])
    answers = answers.select("lat", "lon", "_here", F.col("_best.area_id").alias("closest_area_id"), F.col("_best.distance").alias("area_distance"))
    return attach(placed, answers, ["lat", "lon"], F.col("id"), weight="_here").drop("_here")


def nearby_points(localities: DataFrame, radius: float = 0.1) -> DataFrame:
    """Pairs of distinct points closer than ``radius`` (a point is close to itself) with the localities there."""
    points = (
        with_coordinates(localities).filter("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("localities"))
    )
    others = points.select(
        F.col("lat").alias("other_lat"), F.col("lon").alias("other_lon"), F.col("localities").alias("other_localities"),
        _cell(F.col("lat"), radius).alias("_cx"), _cell(F.col("lon"), radius).alias("_cy"),
    )
    distance = G.degree_distance(F.col("lat"), F.col("lon"), F.col("other_lat"), F.col("other_lon"))
    pairs = _neighbourhood(points, radius).join(others, ["_cx", "_cy"]).withColumn("distance", distance)
    return pairs.filter(F.col("distance") < radius).drop("_cx", "_cy")


def _around(steps: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Offsets of cells that lie wholly within ``steps`` cells of any place of a cell, and of those that may lie so in part.

    Of two opposite offsets of the second kind only the later one is given. A billionth is left
    for the rounding of the division into cells.
    """
    inner, border = [], []
    for dx in range(-steps - 1, steps + 2):
        for dy in range(-steps - 1, steps + 2):
            least, most = math.hypot(max(abs(dx) - 1, 0), max(abs(dy) - 1, 0)), math.hypot(abs(dx) + 1, abs(dy) + 1)
            if most * (1 + 1e-9) < steps:
                inner.append((dx, dy))
            elif least * (1 - 1e-9) < steps and (dx, dy) > (0, 0):
                border.append((dx, dy))
    return inner, border


def _offsets(offsets: list[tuple[int, int]]) -> Column:
    """One row per offset, as a struct of ``dx`` and ``dy``."""
    return F.explode(F.expr(f"array({', '.join(f'named_struct("dx", {dx}L, "dy", {dy}L)' for dx, dy in offsets)})"))


def _close_counts(pairs: DataFrame, radius: float) -> DataFrame:
    """Of pairs of blocks of places (arrays ``lat``, ``lon``, ``n`` and ``o_lat``, ``o_lon``, ``o_n``) the sums of n that each place has within ``radius`` in the other block."""

    names = pairs.columns

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for lat, lon, n, o_lat, o_lon, o_n in zip(*(batch[c] for c in names), strict=True):
                dx, dy = lat[:, None] - o_lat[None, :], lon[:, None] - o_lon[None, :]
                close = np.sqrt(dx * dx + dy * dy) < radius
                parts += [(lat, lon, close @ o_n), (o_lat, o_lon, n @ close)]
            if parts:
                found = pd.DataFrame(dict(zip(("lat", "lon", "nearby"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))
                yield found.groupby(["lat", "lon"], as_index=False).sum().query("nearby > 0")

    return pairs.mapInPandas(count, "lat double, lon double, nearby long")


def nearby_counts(localities: DataFrame, radius: float = 0.1, steps: int = STEPS, block_points: int = CELL_POINTS) -> DataFrame:
    """Number of localities within ``radius`` of each locality, itself included; 0 without a place.

    Cells are a fraction of the radius wide. Cells wholly inside the circle around any place of a
    cell are counted by their sums, once per cell; those that it crosses are compared in blocks of
    bounded size inside tasks, and only sums leave a task. No pair of places is a row.
    """
    size = radius / steps
    inner, border = _around(steps)
    placed = with_coordinates(localities)
    points = _finite(placed).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    points = pin(points.withColumns({"_cx": _cell(F.col("lat"), size), "_cy": _cell(F.col("lon"), size)}))
    cells = pin(points.groupBy("_cx", "_cy").agg(F.sum("n").alias("_n"), F.ceil(F.count(F.lit(1)) / block_points).cast("int").alias("_blocks")))
    reach = lambda offsets: cells.select("*", _offsets(offsets).alias("_o")).withColumns({"_tx": F.col("_cx") + F.col("_o.dx"), "_ty": F.col("_cy") + F.col("_o.dy")})
    whole = reach(inner).groupBy(F.col("_tx").alias("_cx"), F.col("_ty").alias("_cy")).agg(F.sum("_n").alias("nearby"))
    there = cells.select(F.col("_cx").alias("_tx"), F.col("_cy").alias("_ty"))
    crossed = reach(border).join(there, ["_tx", "_ty"]).select("_cx", "_cy", "_tx", "_ty")
    dealt = points.join(cells.select("_cx", "_cy", "_blocks"), ["_cx", "_cy"]).withColumn("_block", F.pmod(F.xxhash64("lat", "lon"), F.col("_blocks")))
    blocks = pin(dealt.groupBy("_cx", "_cy", "_block").agg(F.collect_list(F.struct("lat", "lon", "n")).alias("_p")))  # about block_points places
    arrays = lambda at, prefix: [F.col(f"{at}.{c}").alias(f"{prefix}{c}") for c in ("lat", "lon", "n")]
    other = blocks.select(F.col("_cx").alias("_tx"), F.col("_cy").alias("_ty"), F.col("_p").alias("_q"))
    pairs = crossed.join(blocks, ["_cx", "_cy"]).join(other, ["_tx", "_ty"]).select(*arrays("_p", ""), *arrays("_q", "o_"))
    parts = points.join(whole, ["_cx", "_cy"]).select("lat", "lon", "nearby").unionByName(_close_counts(pairs, radius))
    per_point = parts.groupBy("lat", "lon").agg(F.sum("nearby").alias("nearby")).join(points.select("lat", "lon", "n"), ["lat", "lon"])
    return attach(placed, per_point, ["lat", "lon"], F.col("id"), weight="n").drop("n").fillna(0, ["nearby"])


def localities_near(localities: DataFrame, locality_id: int, radius: float = 0.1) -> DataFrame:
    """Localities within ``radius`` of one locality, itself included."""
    placed = with_coordinates(localities)
    center = placed.filter(F.col("id") == locality_id).select("lat", "lon").first()
    if center is None or center["lat"] is None:
        return placed.limit(0)
    distance = G.degree_distance(F.lit(center["lat"]), F.lit(center["lon"]), F.col("lat"), F.col("lon"))
    return placed.filter(distance < radius)
