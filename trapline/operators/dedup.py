"""Files of equal content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.operators.ranking import top_per_group
from trapline.operators.skew import attach
from trapline.session import pin


def metadata_order(key: str) -> list[Column]:
    """Annotated first, location descending, time ascending, nulls last everywhere."""
    return [F.col("annotated").desc_nulls_last(), F.col("location").desc_nulls_last(), F.col("captured_at").asc_nulls_last(), F.col(key)]


def first_copies(files: DataFrame, content: str, key: str, order_by: list[Column]) -> DataFrame:
    """Key of the first file of every content.

    One candidate per content and task survives the map side, so a content that a third of all
    files share costs as little as any other.
    """
    return top_per_group(files, [content], order_by, 1, "_position").select(F.col(key).alias("_keeper"))


def mark_duplicates(files: DataFrame, content: str, key: str, order_by: list[Column]) -> DataFrame:
    """Flag every file but the first of its content; joined by the unique key, so without skew."""
    keepers = first_copies(files, content, key, order_by)
    marked = files.join(keepers, F.col(key) == F.col("_keeper"), "left")
    return marked.withColumn("duplicate", F.col("_keeper").isNull()).drop("_keeper")


def split_duplicates(files: DataFrame, content: str, key: str, order_by: list[Column]) -> tuple[DataFrame, DataFrame]:
    """First file of every content, and the others (the kept keys are written once for both)."""
    keepers = pin(first_copies(files, content, key, order_by))
    same = F.col(key) == F.col("_keeper")
    return files.join(keepers, same, "left_semi"), files.join(keepers, same, "left_anti")


def name_of_duplicates(files: DataFrame, content: str, name: str, key: str) -> DataFrame:
    """Give every file of a repeated content the greatest name any of its copies has."""
    groups = files.groupBy(content).agg(F.max(name).alias("_group_name"), F.count(F.lit(1)).alias("copies"))
    joined = attach(files, groups, [content], F.col(key), weight="copies")
    shared = F.when(F.col("copies") > 1, F.coalesce("_group_name", name)).otherwise(F.col(name))
    return joined.withColumn("shared_name", shared).drop("_group_name")
