"""A table of Parquet files that streams merge their rows into, keyed and in versions.

Rows are dealt by the hash of their key into buckets. A batch rewrites the buckets that it touches
into a folder of its version and then commits a list of which version every bucket stands in,
together with the number of the last batch of each source. A batch whose number is already
committed changes nothing, so a stream may replay it; what a lost batch had written is overwritten.
Readers see committed versions only. One stream at a time may write to a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64

_COMMITS = "bucket int, at int, source string, batch long, version int"


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    """All commits: where each bucket stands, and the last batch of each source; by version."""
    try:
        return spark.read.schema(_COMMITS).parquet(f"{folder}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMITS)


def _latest(commits: DataFrame) -> DataFrame:
    return commits.filter(F.col("version") == commits.agg(F.max("version")).scalar())


def version(spark: SparkSession, folder: str) -> int:
    """The number of the last commit; 0 before the first."""
    return _commits(spark, folder).agg(F.max("version")).first()[0] or 0


def current(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of the last committed version. Only the folders of its buckets are read."""
    if not version(spark, folder):
        return spark.createDataFrame([], schema)
    stands = _latest(_commits(spark, folder)).filter("bucket is not null").select(F.col("bucket").alias("_bucket"), F.col("at").alias("_version"))
    rows = spark.read.schema(f"{schema}, _version int, _bucket int").parquet(f"{folder}/data")
    return rows.join(F.broadcast(stands), ["_bucket", "_version"]).drop("_bucket", "_version")  # one row per bucket


def merging(
    folder: str, key: str, order: str, schema: str, source: str = "stream", keep: Column | None = None, buckets: int = BUCKETS
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that brings the rows of a batch into the table ``folder``.

    Of the rows of one key the one of the greatest ``order`` counts; it replaces the stored row unless
    that has a greater order or fulfils ``keep``, a condition on the stored row; columns that it
    leaves null keep their stored values. Rows without a key are left out. ``source`` names the stream: each
    has batch numbers of its own. All writers of a table must give the same ``buckets``.
    """
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commits = _commits(spark, folder)
        done = _latest(commits).filter((F.col("source") == source) & (F.col("batch") >= number))
        if not done.isEmpty():
            return
        at = version(spark, folder) + 1
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        values = [c for c in names if c != key]
        latest = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*values), F.struct(F.col(order).isNotNull(), order, *[c for c in values if c != order])).alias("_n"))
        touched = latest.select(bucket.alias("_b")).distinct()
        old = current(spark, folder, schema)
        old = old.join(F.broadcast(touched), bucket == F.col("_b"), "left_semi")  # one row per bucket at most
        old = old.select(F.col(key).alias("_key"), F.struct(*names).alias("_o"), (F.lit(False) if keep is None else keep).alias("_kept"))
        joined = latest.join(old, F.col(key) == F.col("_key"), "full_outer")
        stays = F.coalesce(F.col(f"_o.{order}") > F.col(f"_n.{order}"), F.lit(False))
        if keep is not None:
            stays = stays | F.coalesce("_kept", F.lit(False))
        merged = joined.select(
            F.coalesce(F.col(key), "_key").alias(key),
            *[F.when(F.col("_n").isNull() | stays, F.col(f"_o.{c}")).otherwise(F.coalesce(f"_n.{c}", f"_o.{c}")).alias(c) for c in values],
        ).select(*names)
        merged.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/data/_version={at}")
        before = _latest(commits)
        moved = before.filter("bucket is not null").join(F.broadcast(touched), F.col("bucket") == F.col("_b"), "left_anti").select("bucket", "at")
        stands = moved.unionByName(touched.select(F.col("_b").alias("bucket"), F.lit(at).alias("at")))
        others = before.filter(F.col("source").isNotNull() & (F.col("source") != source)).select("source", "batch")
        sources = others.unionByName(spark.range(1).select(F.lit(source).alias("source"), F.lit(number).cast("long").alias("batch")))
        row = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (f.split(" ") for f in _COMMITS.split(", ")[:4])])
        row(stands).unionByName(row(sources)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/version={at}")

    return write
