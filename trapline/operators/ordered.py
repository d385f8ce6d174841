"""Running numbers and neighbours over one global order, without a single-task window.

The rows are range-partitioned on a total order and written once to the checkpoint folder
together with their range number. Each range is then scanned on its own; what crosses range
borders travels through a summary of one row per range, so the only unpartitioned window in
this module sees as many rows as there are shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.session import pin

RANGE = "_range"


def ordered_ranges(df: DataFrame, order_by: list[Column], partitions: int | None = None) -> DataFrame:
    """Split ``df`` into consecutive ranges of ``order_by`` (which must end in a unique key)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pin(df.repartitionByRange(n, *order_by).withColumn(RANGE, F.spark_partition_id()))


def _within(order_by: list[Column]):
    return Window.partitionBy(RANGE).orderBy(*order_by)


def _before():
    return Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, order_by: list[Column], value: Column, out: str, pinned: bool = False) -> DataFrame:
    """Inclusive running sum of ``value`` over the whole frame in ``order_by`` order."""
    ranges = df if pinned else ordered_ranges(df, order_by)
    totals = ranges.groupBy(RANGE).agg(F.sum(value).alias("_total"))
    offsets = totals.select(RANGE, F.coalesce(F.sum("_total").over(_before()), F.lit(0)).alias("_offset"))
    upto = _within(order_by).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranges.withColumn("_local", F.sum(value).over(upto))
        .join(F.broadcast(offsets), RANGE)  # one row per shuffle partition
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_offset", "_local", RANGE)
    )


def row_number_over_all(df: DataFrame, order_by: list[Column], out: str = "row_no") -> DataFrame:
    """``row_number`` over the whole frame, starting at 1."""
    return running_sum(df, order_by, F.lit(1).cast("long"), out)


def row_number_in_group(df: DataFrame, group: str, order_by: list[Column], out: str = "row_no") -> DataFrame:
    """``row_number`` per group that also holds when one group has most of the rows.

    Also gives ``{out}_count``, the size of the group. A range has at most two groups that go on
    in another range (its first and its last), so what is broadcast has at most twice as many
    rows as there are ranges.
    """
    ranges = ordered_ranges(df, [F.col(group).asc_nulls_first(), *order_by])
    parts = ranges.groupBy(RANGE, group).agg(F.count(F.lit(1)).alias("_n"))
    same = Window.partitionBy(group)
    earlier = same.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        parts.withColumns(
            {"_pieces": F.count(F.lit(1)).over(same), "_span": F.sum("_n").over(same), "_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0))}
        )
        .filter("_pieces > 1")
        .select(F.col(RANGE).alias("_r"), F.col(group).alias("_g"), "_span", "_before")
    )
    local = Window.partitionBy(RANGE, group)
    numbered = ranges.withColumns({"_local": F.row_number().over(local.orderBy(*order_by)), "_size": F.count(F.lit(1)).over(local)})
    here = (F.col(RANGE) == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g"))
    return (
        numbered.join(F.broadcast(spans), here, "left")
        .withColumn(out, F.col("_local") + F.coalesce("_before", F.lit(0)))
        .withColumn(f"{out}_count", F.coalesce("_span", "_size"))
        .drop("_local", "_size", "_r", "_g", "_span", "_before", RANGE)
    )


def next_over_all(df: DataFrame, order_by: list[Column], value: Column, out: str, pinned: bool = False) -> DataFrame:
    """``lead(value)`` over the whole frame; keeps the range column when ``pinned``."""
    ranges = df if pinned else ordered_ranges(df, order_by)
    window = _within(order_by)
    heads = ranges.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").select(RANGE, value.alias("_head"))
    following = heads.select(RANGE, F.lead("_head").over(Window.orderBy(RANGE)).alias("_next_head"))
    ahead = (
        ranges.withColumn("_last", F.lead(F.lit(1)).over(window).isNull())
        .withColumn(out, F.lead(value).over(window))
        .join(F.broadcast(following), RANGE)  # one row per shuffle partition
        .withColumn(out, F.when(F.col("_last"), F.col("_next_head")).otherwise(F.col(out)))
        .drop("_last", "_next_head")
    )
    return ahead if pinned else ahead.drop(RANGE)


def previous_over_all(df: DataFrame, order_by: list[Column], value: Column, out: str, pinned: bool = False) -> DataFrame:
    """``lag(value)`` over the whole frame; keeps the range column when ``pinned``."""
    ranges = df if pinned else ordered_ranges(df, order_by)
    window = _within(order_by)
    tails = (
        ranges.withColumn("_more", F.lead(F.lit(1)).over(window))
        .filter("_more is null")
        .select(RANGE, value.alias("_tail"))
    )
    preceding = tails.select(RANGE, F.lag("_tail").over(Window.orderBy(RANGE)).alias("_prev_tail"))
    back = (
        ranges.withColumn("_rn", F.row_number().over(window))
        .withColumn(out, F.lag(value).over(window))
        .join(F.broadcast(preceding), RANGE)  # one row per shuffle partition
        .withColumn(out, F.when(F.col("_rn") == 1, F.col("_prev_tail")).otherwise(F.col(out)))
        .drop("_rn", "_prev_tail")
    )
    return back if pinned else back.drop(RANGE)
