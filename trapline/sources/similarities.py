"""Similarity scores stored with what is known of both sides, bucketed by query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


def save(pairs: DataFrame, queries: DataFrame, gallery: DataFrame, path: str, name: str, columns: list[str], buckets: int = BUCKETS) -> None:
    """Store ``pairs`` (``query_id``, ``ref_id``, ``score``) with ``columns`` of both sides as ``q_...`` and ``r_...``.

    Sides are joined by their ``ref_id``; a pair whose side is unknown stays, with nulls. The
    rows are shuffled to the buckets of their query once, here. ``buckets`` should grow with the
    table, to some 1 GB a bucket.
    """
    side = lambda rows, key, mark: rows.select(F.col("ref_id").alias(key), *[F.col(c).alias(f"{mark}_{c}") for c in columns]).distinct()
    known = pairs.select("query_id", "ref_id", "score").join(side(gallery, "ref_id", "r"), "ref_id", "left").join(side(queries, "query_id", "q"), "query_id", "left")
    ordered = known.select("query_id", "ref_id", "score", *[f"q_{c}" for c in columns], *[f"r_{c}" for c in columns])
    (
        ordered.repartition(buckets, "query_id").write.mode("errorifexists").format("parquet").option("path", path)
        .bucketBy(buckets, "query_id").sortBy("query_id").saveAsTable(name)
    )


def load(spark: SparkSession, path: str, name: str, schema: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The stored scores; grouping, ranking and joining by ``query_id`` need no shuffle.

    A session that doesn't know the table yet needs its ``schema`` and is told of the buckets that lie at ``path``.
    """
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"create table {name} ({schema}) using parquet clustered by (query_id) sorted by (query_id) into {int(buckets)} buckets location '{path}'"
        )
    return spark.table(name)
