"""Shards of near equal size by longest-processing-time scheduling of groups that stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.tables import small_table
from trapline.operators.ordered import row_number_in_group

# Bundles of small groups per shard; also the number of pieces per shard over which a group counts as large.
BUNDLES_PER_SHARD = 512


def longest_first(sizes: dict, shards: int) -> dict:
    """Shard of every item: the largest item first, each to the least-loaded shard (ties: the lowest)."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def schedule(rows: DataFrame, group: str, size: str, shards: int, bundles_per_shard: int = BUNDLES_PER_SHARD) -> DataFrame:
    """``rows`` with column ``shard``: all rows of a group in one shard, the shards' sizes near equal.

    ``group`` is a 64-bit hash of what must stay together (equal hashes stay together also where
    the groups differ, which only coarsens the parts). Groups larger than one part in
    ``shards * bundles_per_shard`` of everything are scheduled one by one, so there are at most
    that many of them; the others are bundled by hash into that many bundles, each scheduled as
    one item. The driver sees two numbers per item, at most twice ``shards * bundles_per_shard``
    items at any size of the input, and the heap runs over those. The loads of two shards differ
    by at most the largest item among them.

    Group sizes are summed map-side first, so a group of any number of rows is one row per task.
    A null group is a group. An empty input gives an empty output.
    """
    parts = shards * bundles_per_shard
    groups = rows.groupBy(F.col(group).alias("_group")).agg(F.sum(size).alias("_size"))
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    bundle = F.pmod(F.coalesce(F.xxhash64("_group"), F.lit(0)), F.lit(parts))
    large = F.col("_size") > total / parts
    items = (
        groups.select(F.when(large, F.col("_group")).alias("alone"), F.when(~large, bundle).alias("bundle"), "_size", large.alias("is_alone"))
        .groupBy("is_alone", "alone", "bundle")
        .agg(F.sum("_size").alias("size"))
        .collect()  # at most two times parts rows, see above
    )
    placed = longest_first({(bool(r.is_alone), r.alone is None, r.alone or 0, r.bundle if r.bundle is not None else -1): r["size"] for r in items}, shards)
    spark = rows.sparkSession
    alone = small_table(spark, [(None if null else key, shard) for (is_alone, null, key, _), shard in placed.items() if is_alone], "_a_group long, _a_shard int")
    bundled = small_table(spark, [(key, shard) for (is_alone, _, _, key), shard in placed.items() if not is_alone], "_b_bundle long, _b_shard int")
    # both tables are bounded by parts
    out = rows.withColumn("_bundle", F.pmod(F.coalesce(F.xxhash64(F.col(group)), F.lit(0)), F.lit(parts)))
    out = out.join(F.broadcast(alone), F.col(group).eqNullSafe(F.col("_a_group")), "left")
    out = out.join(F.broadcast(bundled), F.col("_bundle") == F.col("_b_bundle"), "left")
    return out.withColumn("shard", F.coalesce("_a_shard", "_b_shard")).drop("_a_group", "_a_shard", "_b_bundle", "_b_shard", "_bundle")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_documents(documents: DataFrame, shards: int = 8, bundles_per_shard: int = BUNDLES_PER_SHARD) -> DataFrame:
    """All documents in ``shards`` shards of near equal bytes, equal texts together.

    Returns doc_id, size, text_crc32, law (``bytes``), shard, slot (gapless from 0 in each shard,
    by doc_id) and grown_shard (null: adding a shard may move any row). Null texts are one group
    of size 1 each with a null checksum, empty texts another; repeated rows each take a slot.
    A group larger than a shard's share makes its shard larger than the others.

    Only ids, sizes and hashes are shuffled, never texts. Slots come from a range-partitioned
    order, so a shard isn't numbered in one task.
    """
    text = F.col("text")
    rows = documents.select("doc_id", text_size(text).alias("size"), F.crc32(text).alias("text_crc32"), F.when(text.isNotNull(), F.xxhash64(text)).alias("_text"))
    placed = schedule(rows, "_text", "size", shards, bundles_per_shard).drop("_text")
    numbered = row_number_in_group(placed, "shard", [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "_slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
