"""Components of a graph whose links come from buckets of candidates, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm.bitmaps import close_pairs
from trapline.llm.tables import kept


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node in ``links`` (``a``, ``b``).

    Distributed union-find by contraction: in each round every node moves to the one of its
    neighbours and itself that comes first in an order, another one each round, and links
    are drawn between the places moved to, until none is left. The first order is that of the nodes,
    in which all links to the smallest node of a bucket or component go at once. The others are by
    hash: in such orders the nodes of any graph, a long chain with ascending numbers too, shrink by
    a share each round, so rounds grow with the logarithm of the nodes. The first neighbour is found with map-side combining, and the
    joins are plain ones between stored tables, so a node with very many links is split by the
    adaptive skew join. No links: no rows.
    """
    links = kept(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes, rounds = None, 0
    while not links.isEmpty():
        rounds += 1
        placed = lambda c: F.struct((F.xxhash64(F.lit(rounds), c) if rounds > 1 else F.lit(0)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ends.groupBy("a").agg(F.min(placed("b")).alias("b"))
        moves = kept(first.select(F.col("a").alias("node"), F.least("b", placed("a"))["n"].alias("to")), "moves")
        if nodes is None:
            nodes = moves.select("node", F.col("to").alias("component"))
        else:
            hop = moves.select(F.col("node").alias("component"), "to")
            nodes = nodes.join(hop, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        own, other = (moves.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        moved = links.join(own, "a").join(other, "b").filter("a_to <> b_to")
        links = kept(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
    if nodes is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    nodes = kept(nodes, "places")
    least = nodes.groupBy("component").agg(F.min("node").alias("least"))  # map-side
    return kept(nodes.join(least, "component").select("node", F.col("least").alias("component")), "components")


def _different(rows: DataFrame) -> DataFrame:
    """One bucket of all those that hold the same nodes (by their number and two 64-bit hashes of the nodes together): they tell the same.

    A node must stand once in a bucket, else its hashes cancel.
    """
    bucket = Window.partitionBy("key")
    marks = {f"_m{i}": F.bit_xor(F.xxhash64(F.lit(i), "node")).over(bucket) for i in (1, 2)}
    marked = kept(rows.withColumns(marks | {"_n": F.count(F.lit(1)).over(bucket)}), "all_buckets")
    one = marked.filter("node = hub").groupBy("_n", "_m1", "_m2").agg(F.min("key").alias("key"))
    return marked.drop("_n", "_m1", "_m2").join(one.select("key"), "key", "left_semi")


def _once(rows: DataFrame) -> DataFrame:
    """Each node of a key once; tasks drop copies only among their own rows. Needs no shuffle besides the one by ``key``."""
    before = F.lag("node").over(Window.partitionBy("key").orderBy("node"))
    return rows.withColumn("_before", before).filter("_before is null or _before <> node").drop("_before")


def connect(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int, rounds: int = 2, known: DataFrame | None = None) -> DataFrame:
    """Components of the graph of all verified pairs that share a bucket, as ``node`` and ``component``.

    ``buckets`` has ``key`` and ``node`` (long), rows may repeat; ``verify`` takes distinct pairs (``a``, ``b``) and
    returns those that are links, of at least ``percent`` % of common members; ``verify.sketches()``
    gives the sizes and bitmaps of the nodes' sets (with ``verify.sets``, if there, also what that makes
    the sets of), and ``verify.prepare``, if there, gets the nodes of all buckets of more than one node first. ``known`` are links (``a``, ``b``) to begin with. Nodes without a
    link are left out.

    Pairs inside a component needn't be looked at. In each of ``rounds`` rounds the smallest node
    of a bucket is compared with all of its nodes that aren't yet in its component, and leaves the
    bucket with all its pairs settled; buckets whose nodes are all in one component are finished.
    A group of n near copies costs about n comparisons that way. What is left after the rounds
    (nodes that share a key but no link) is compared by bitmaps inside tasks, and what these can't
    rule out is verified, in the same tasks if the sets are at hand, so no link is lost.
    """
    links, found, sets = known, None, getattr(verify, "sets", None)
    rows = _once(buckets.select("key", "node")).withColumn("component", F.col("node"))
    for step in range(rounds + 1):
        bucket = Window.partitionBy("key")
        hub = F.min(F.struct("node", "component")).over(bucket)
        open_rows = rows.withColumns({"hub": hub, "lo": F.min("component").over(bucket), "hi": F.max("component").over(bucket)}).filter("lo <> hi")
        columns = ["key", "node", "component", F.col("hub.node").alias("hub"), F.col("hub.component").alias("hub_component")]
        if step == 0:
            open_rows = _different(open_rows.select(*columns))
        open_rows = kept(open_rows.select(*columns) if step else open_rows, "buckets")
        if open_rows.isEmpty():
            break
        if step == 0 and hasattr(verify, "prepare"):
            verify.prepare(open_rows.select(F.col("node").alias("doc_id")).distinct())
        if step < rounds:
            pairs = open_rows.filter("hub_component <> component").select(F.col("hub").alias("a"), F.col("node").alias("b"))
        else:
            pairs = close_pairs(open_rows, verify.sketches(), percent, sets=sets)
        pairs = kept(pairs.distinct(), "pairs")
        new = pairs if step == rounds and sets else kept(verify(pairs).select("a", "b"), "verified")
        if found is not None:  # what is connected already needs its links no more
            links = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(new if links is None else links.union(new))
        if step < rounds:
            rest = open_rows.filter("node <> hub").select("key", "node")
            rows = rest.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    if found is not None:
        return found
    return components(known) if known is not None else buckets.sparkSession.createDataFrame([], "node long, component long")
