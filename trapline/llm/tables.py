"""Tables that a job writes to the shared folder and reads again."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trapline.session import scratch_path

# Rows of an Arrow batch: with texts of up to some 100 kB each a batch stays well below an executor's memory.
BATCH_ROWS = 512


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it: lineage ends here, and every reader sees the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """Set the session's Arrow batches for rows that hold whole texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have: ``name`` after as many underscores as that takes."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def least_hashed(rows: DataFrame, by: str, id_col: str, n: int) -> DataFrame:
    """Of each class ``by`` the ``n`` rows whose ids have the smallest hashes, as ``by`` and ``id_col``.

    Classes are few (languages, labels). Their sizes come first, by a count with map-side combining,
    so that about n rows of a class are left before they meet in a window.
    """
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))
    hashed = rows.select(by, id_col, F.xxhash64(id_col).alias("_at")).join(F.broadcast(sizes), by)
    # half as many again and 100 more than wanted pass: fewer than n never happens in practice
    likely = hashed.filter((F.col("_at") / 2.0**64 + 0.5) * F.col("_size") <= 1.5 * n + 100)
    order = Window.partitionBy(by).orderBy("_at")
    return likely.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).select(by, id_col)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows that the driver holds. It is handed over as Arrow, so no Python worker starts on the executors for it."""
    kind = T.StructType.fromDDL(schema)
    columns = zip(*rows, strict=True) if rows else [()] * len(kind)
    arrays = [pa.array(list(values), to_arrow_type(field.dataType)) for values, field in zip(columns, kind, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=kind.names), kind)
