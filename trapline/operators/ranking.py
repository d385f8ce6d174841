"""Orders, pages, top lists, neighbours in an order.

``row_number() <= k`` is kept as a filter on the window so that Spark cuts every group to ``k``
rows on the map side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.operators.ordered import next_over_all
from trapline.operators.skew import attach, keys_of


def sort_by(df: DataFrame, column: str, direction: str, allowed: list[str], key: str) -> DataFrame:
    """Order by a column of the allowed list; another column leaves the order as it is."""
    if column not in allowed:
        return df
    chosen = F.col(column).desc() if direction == "desc" else F.col(column).asc()
    return df.orderBy(chosen, F.col(key))


def page(df: DataFrame, order_by: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows; a page outside the range is page 1."""
    start = (number - 1) * size
    if number < 1 or (number > 1 and df.orderBy(*order_by).offset(start).limit(1).isEmpty()):
        start = 0
    return df.orderBy(*order_by).offset(start).limit(size)


def default_order(media: DataFrame, key: str) -> DataFrame:
    return media.orderBy(F.col("identity_is_representative").desc(), F.col("captured_at").asc_nulls_last(), F.col(key))


def top_per_group(df: DataFrame, group: list[str], order_by: list[Column], k: int, out: str = "position") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order_by))).filter(F.col(out) <= k)


def best_representatives(media: DataFrame, orientation: str, k: int = 5) -> DataFrame:
    """Newest ``k`` media per identity from the best tier that has any.

    Tiers: representative of the same orientation, any representative, any media.
    """
    tier = (
        F.when(F.col("identity_is_representative") & (F.col("orientation") == orientation), 0)
        .when(F.col("identity_is_representative"), 1)
        .otherwise(2)
    )
    ranked = top_per_group(
        media.filter("identity_id is not null").withColumn("tier", tier),
        ["identity_id"], [F.col("tier"), F.col("captured_at").desc_nulls_first(), F.col("id")], k,
    )
    return ranked.withColumn("_best", F.min("tier").over(Window.partitionBy("identity_id"))).filter("tier = _best").drop("_best")


def suggestion_card(hits: DataFrame, representatives: DataFrame, k: int = 5) -> DataFrame:
    """Per suggestion the hit first, then the identity's representatives without it, cut at ``k``."""
    first = hits.select("suggestion_id", F.col("hit_id").alias("media_id"), F.lit(0).alias("_rank"))
    rest = hits.join(representatives, "identity_id").filter(F.col("id") != F.col("hit_id"))
    rest = rest.select("suggestion_id", F.col("id").alias("media_id"), F.col("position").alias("_rank"))
    return top_per_group(first.unionByName(rest), ["suggestion_id"], [F.col("_rank")], k).drop("_rank")


def remaining_identities(identities: DataFrame, suggested: DataFrame, media: DataFrame, k: int = 3) -> DataFrame:
    """Identities that were not suggested, by name, with their first ``k`` media."""
    left = identities.filter(F.col("name") != "nan").join(keys_of(suggested, "identity_id"), F.col("id") == F.col("identity_id"), "left_anti")
    shots = media.filter("identity_id is not null").select("identity_id", F.col("id").alias("media_id"), "captured_at")
    top = top_per_group(shots, ["identity_id"], [F.col("captured_at").asc_nulls_last(), F.col("media_id")], k)
    return left.join(top.drop("captured_at"), F.col("id") == F.col("identity_id"), "left").drop("identity_id")


def max_scores(queue: DataFrame, suggestions: DataFrame) -> DataFrame:
    best = suggestions.groupBy("for_id").agg(F.max("score").alias("max_score"))
    return queue.join(best, queue["id"] == best["for_id"], "left").drop("for_id")


def identification_queue(queue: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Unidentified media by best suggestion, those without any first."""
    return max_scores(queue, suggestions).orderBy(F.col("max_score").desc_nulls_first(), F.col("id"))


def next_in_queue(queue: DataFrame, suggestions: DataFrame) -> DataFrame:
    """For every queued item the next one with the same or a lower best score (none counts as 0)."""
    scored = max_scores(queue, suggestions).withColumn("max_score", F.coalesce("max_score", F.lit(0.0)))
    return next_over_all(scored, [F.col("max_score").desc(), F.col("id")], F.col("id"), "next_id")


def first_of_sequence(media: DataFrame, sequence: str, sort_key: str, key: str) -> DataFrame:
    """Add the smallest sort key of the sequence, to keep sequences together in a list."""
    firsts = media.groupBy(sequence).agg(F.min(sort_key).alias("first_in_sequence"), F.count(F.lit(1)).alias("_rows"))
    return attach(media, firsts, [sequence], F.col(key), weight="_rows").drop("_rows")


def newest_unlabelled(media: DataFrame, by: str) -> DataFrame:
    return media.orderBy(F.col(by).desc_nulls_first(), F.col("captured_at").desc_nulls_first(), F.col("id")).limit(1)
