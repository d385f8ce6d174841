"""Tables stored in an order, so that a page of any depth reads only the ranges it lies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = "page_range"


def write(rows: DataFrame, path: str, order_by: list[Column], ranges: int | None = None) -> None:
    """Store ``rows`` in consecutive ranges of ``order_by`` (which must end in a unique key), with a summary of one row per range.

    One range partitioning, no global sort. Equal keys are in one range. The summary holds the
    number of rows of a range and of all ranges before it.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order_by).withColumn(RANGE, F.spark_partition_id())
    placed.sortWithinPartitions(RANGE, *order_by).write.mode("errorifexists").partitionBy(RANGE).parquet(f"{path}/rows")
    counts = _rows(rows.sparkSession, path, rows.schema).groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/ranges")


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(RANGE, T.IntegerType())])).parquet(f"{path}/rows")


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{RANGE} int, n long, start long").parquet(f"{path}/ranges")


def count(spark: SparkSession, path: str) -> int:
    """Rows of the table, from the summary alone."""
    return _ranges(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read(spark: SparkSession, path: str, schema: T.StructType, order_by: list[Column], start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` (exclusive, from 0) of the table's order; beyond the last row there are none.

    Only the ranges that hold such rows are read, by partition pruning, and only they are sorted.
    """
    wanted = _ranges(spark, path).filter((F.col("start") < end) & (F.col("start") + F.col("n") > start)).orderBy("start").collect()
    table = _rows(spark, path, schema).filter(F.col(RANGE).isin([r[RANGE] for r in wanted])).drop(RANGE)
    if not wanted or end <= start:
        return table.limit(0)
    return table.orderBy(*order_by).offset(max(start, 0) - wanted[0]["start"]).limit(end - max(start, 0))


def page(spark: SparkSession, path: str, schema: T.StructType, order_by: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows; a page outside the range is page 1, which the summary tells."""
    start = (number - 1) * size
    if number < 1 or start >= count(spark, path):
        start = 0
    return read(spark, path, schema, order_by, start, start + size)
