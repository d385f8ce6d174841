"""File listings, metadata spreadsheets, feature sets, category layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.functions import text as X

# an empty field is a missing value, quoted or not
READ_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "nullValue": "", "emptyValue": ""}
WRITE_OPTIONS = {"header": True, "escape": '"', "quote": '"', "nullValue": "", "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def list_files(spark: SparkSession, folder: str, mask: str = "*", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files below a folder by name pattern, without the excluded suffixes; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", mask).load(folder)
    ).select("path", "length", "modificationTime")
    ending = F.lower(X.suffix(F.col("path")))
    return files.filter(~ending.isin(*[e.lower() for e in exclude])) if exclude else files


def relative_to(files: DataFrame, root: str) -> DataFrame:
    """Listing with ``original_path`` below the root folder."""
    start = F.locate(root.rstrip("/") + "/", "path") + len(root.rstrip("/")) + 1
    return files.withColumn("original_path", F.substr("path", start))


def read_metadata(spark: SparkSession, path: str, schema: str, index: bool = True) -> DataFrame:
    """Metadata CSV with a declared schema; the unnamed index column is dropped."""
    declared = f"_index long, {schema}" if index else schema
    frame = spark.read.options(**READ_OPTIONS).schema(declared).csv(path)
    return frame.drop("_index") if index else frame


def write_metadata(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metadata as CSV files (UTF-8, quoted text may hold line breaks)."""
    df.write.mode(mode).options(**WRITE_OPTIONS).csv(path)


def latest_spreadsheet(files: DataFrame) -> str | None:
    """The CSV whose path sorts last wins."""
    return files.filter(F.lower(X.suffix(F.col("path"))) == ".csv").agg(F.max("path")).first()[0]


def image_paths(files: DataFrame, dataset: str, hashed: bool = False, path: str = "original_path") -> DataFrame:
    """Manifest with the path each file gets inside the dataset."""
    name = X.hashed_name(F.col(path), dataset) if hashed else F.concat(F.lit(f"{dataset}/"), F.col(path))
    return files.withColumn("image_path", name)


def with_category(rows: DataFrame) -> DataFrame:
    """Folder per predicted category, ``class_<id>`` where there is none, and the path in it."""
    category = F.coalesce("predicted_category", F.concat(F.lit("class_"), F.col("predicted_class_id").cast("string")))
    return rows.withColumn("category", category).withColumn("image_path", F.concat_ws("/", "category", "image_path"))


def write_by_category(rows: DataFrame, path: str) -> None:
    """One folder per category.

    Rows are gathered by category first, so that a task writes few files; a category with very
    many rows is split again by the adaptive planner and written by many tasks.
    """
    with_category(rows).hint("rebalance", "category").write.mode("errorifexists").partitionBy("category").parquet(path)


def save_features(rows: DataFrame, path: str) -> None:
    """Feature set: id, label and embedding."""
    rows.select("ref_id", "identity", "embedding").write.mode("errorifexists").parquet(path)


def load_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ref_id long, identity long, embedding array<float>").parquet(path)
