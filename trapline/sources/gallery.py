"""The gallery of reference images: a table partitioned by organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.schemas import schema
from trapline.session import pin

FEATURES = "struct<vector:array<double>,keypoints:array<array<double>>,image_size:array<int>>"


def to_json(vector: Column, keypoints: Column, image_size: Column) -> Column:
    """Embedding and local features as one JSON text."""
    return F.to_json(F.struct(vector.alias("vector"), keypoints.alias("keypoints"), image_size.alias("image_size")))


def from_json(text: Column) -> Column:
    return F.from_json(text, FEATURES)


def read(spark: SparkSession, path: str, organization_id: int | None = None) -> DataFrame:
    """Gallery rows, of one organisation by partition pruning."""
    rows = spark.read.schema(schema("reference_image")).parquet(path)
    return rows if organization_id is None else rows.filter(F.col("organization_id") == organization_id)


def write(rows: DataFrame, path: str) -> None:
    rows.hint("rebalance", "organization_id").write.mode("errorifexists").partitionBy("organization_id").parquet(path)


def _replace(rows: DataFrame, path: str) -> None:
    """Overwrite the organisations that occur in ``rows``; the others stay."""
    rows.hint("rebalance", "organization_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("organization_id").parquet(path)


def upsert(path: str, organization_id: int, new: DataFrame) -> None:
    """Replace the rows of an organisation that have the image path of a new row, then add the new rows.

    The result is written to the checkpoint folder first, because the table it is read from is
    the table it replaces.
    """
    old = read(new.sparkSession, path, organization_id)
    images = new.select("image_path").distinct()
    merged = old.join(images, "image_path", "left_anti").unionByName(new.withColumn("organization_id", F.lit(organization_id)))
    _replace(pin(merged), path)


def delete(spark: SparkSession, path: str, organization_id: int) -> DataFrame:
    """The gallery without an organisation, for the caller to write as the next version."""
    return read(spark, path).filter(F.col("organization_id") != organization_id)


def count(spark: SparkSession, path: str, organization_id: int) -> int:
    return read(spark, path, organization_id).count()


def page(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` (exclusive) in key order."""
    return rows.orderBy("ref_id").offset(start).limit(end - start)


def pick(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows by key."""
    return rows.join(wanted.select("ref_id").distinct(), "ref_id", "left_semi")
