"""Shots grouped into sequences by the time between them.

Two consecutive shots belong together unless they are more than ``limit`` seconds apart. Rows
are never windowed: they are first reduced (map-side) to cells of one location and one time slot
as long as the limit. Inside a cell no gap can exceed the limit, so only cells need to be
compared with each other, and a location has at most one cell per slot of the calendar however
many shots it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.operators.ordered import ordered_ranges, previous_over_all, running_sum
from trapline.operators.skew import attach
from trapline.session import pin

LOCATION_ORDER = "location desc, nulls last"


def _limit_us(limit_s: float | str) -> Column:
    """The limit in microseconds: a number, or a column that has one value in each location."""
    if isinstance(limit_s, str):
        return F.coalesce((F.col(limit_s) * 1_000_000).cast("long"), F.lit(120_000_000))
    return F.lit(int(limit_s * 1_000_000)).cast("long")


def _cell(us: Column, limit_us: Column) -> Column:
    """Number of the time slot (also for times before 1970)."""
    step = F.greatest(limit_us, F.lit(1))  # with a limit of 0 a slot is one tick of the clock
    return F.floor((us - F.pmod(us, step)) / step)


def _timed(shots: DataFrame, ts: str, limit_us: Column) -> DataFrame:
    us = F.unix_micros(F.col(ts))
    return shots.withColumn("_us", us).withColumn("_cell", _cell(F.col("_us"), limit_us))


def sequence_cells(shots: DataFrame, location: str = "location", ts: str = "captured_at", limit_s: float | str = 120) -> DataFrame:
    """One row per location and slot with its local sequence number, starting at 0 per location.

    ``limit_s`` is a number or the name of a column, the limit of the location's workgroup; where
    that is null, 120 seconds count.
    """
    limit_us = _limit_us(limit_s)
    cells = (
        _timed(shots.filter(F.col(ts).isNotNull()), ts, limit_us)
        .groupBy(F.col(location), "_cell")
        .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count(F.lit(1)).alias("_n"), F.max(limit_us).alias("_limit"))
    )
    in_location = Window.partitionBy(location).orderBy("_cell")
    upto = in_location.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.col("_first") - F.lag("_last").over(in_location)
    return (
        cells.withColumn("_before", F.lag("_last").over(in_location))
        .withColumn("_break", F.coalesce((gap > F.col("_limit")).cast("long"), F.lit(0)))
        .withColumn("_local", F.sum("_break").over(upto))
    )


def location_offsets(cells: DataFrame, location: str, limit_s: float) -> DataFrame:
    """Per location the number of breaks before it, in descending order of the location."""
    limit_us = _limit_us(limit_s)
    summary = cells.groupBy(location).agg(
        F.min("_first").alias("_loc_first"), F.max("_last").alias("_loc_last"), F.max("_local").alias("_loc_breaks")
    )
    order = [F.col(location).desc_nulls_last()]
    ranges = ordered_ranges(summary, order)
    ranges = previous_over_all(ranges, order, F.struct("_loc_last", "_loc_breaks"), "_prev", pinned=True)
    gap = F.col("_loc_first") - F.col("_prev._loc_last")
    border = F.coalesce(((gap < 0) | (gap > limit_us)).cast("long"), F.lit(0)) + F.coalesce("_prev._loc_breaks", F.lit(0))
    offsets = running_sum(ranges, order, border, "_offset_breaks", pinned=True)
    return offsets.select(location, "_offset_breaks", F.col("_prev._loc_last").alias("_loc_before"))


def number_sequences(
    shots: DataFrame, key: str = "media_id", location: str = "location", ts: str = "captured_at", annotated: str | None = None,
    limit_s: float | str = 120, mode: str = "per_locality", out: str = "sequence_number", with_delta: bool = False,
) -> DataFrame:
    """Add the sequence number, and with ``with_delta`` the seconds since the shot before.

    ``per_locality`` numbers each location from 0. ``reference`` numbers the whole frame in the
    order (location descending, time ascending): a step back in time or a gap over the limit
    opens a sequence, a location that follows within the limit continues the one before. Shots
    without time have no number, except a leading one, which is 0 and whose first timed
    successor then has none. That mode numbers the frame of one archive, so its limit is a number.
    """
    limit_us = _limit_us(limit_s)
    cells = sequence_cells(shots, location, ts, limit_s).withColumn("_number", F.col("_local"))
    if mode == "reference" or with_delta:
        cells = pin(cells)  # several readers follow
    if mode == "reference":
        offsets = location_offsets(cells, location, limit_s)
        cells = attach(cells, offsets, [location], F.col("_cell")).withColumn("_number", F.col("_local") + F.col("_offset_breaks"))
        cells = cells.withColumn("_before", F.coalesce("_before", "_loc_before"))
    numbers = cells.select(location, "_cell", "_n", F.col("_number").alias(out), F.col("_before").alias("_cell_before"))
    timed = _timed(shots, ts, limit_us)
    rows = attach(timed, numbers.drop("_cell_before"), [location, "_cell"], F.col(key), weight="_n").drop("_n")
    if mode == "reference":
        rows = _leading_row_rule(rows, shots, key, location, ts, annotated, out)
    if with_delta:
        deltas = _deltas(timed.filter(F.col(ts).isNotNull()), numbers, key, location, annotated)
        rows = rows.join(deltas.withColumnRenamed(key, "_leader"), F.col(key) == F.col("_leader"), "left").drop("_leader")
        delta = F.when(F.col("_us").isNull(), None).when(F.col("_has_delta"), F.col("_delta")).otherwise(F.lit(0))
        rows = rows.withColumn("delta_seconds", delta / F.lit(1e6)).drop("_has_delta", "_delta")
    return rows.drop("_us", "_cell")


def _sort_keys(key: str, location: str, ts: str, annotated: str | None) -> list[Column]:
    tail = [F.col(annotated).desc_nulls_last()] if annotated else []
    return [F.col(location).desc_nulls_last(), F.col(ts).asc_nulls_last(), *tail, F.col(key)]


def _leading_row_rule(rows: DataFrame, shots: DataFrame, key: str, location: str, ts: str, annotated: str | None, out: str) -> DataFrame:
    """Only a frame that starts with a shot without time is special; its two rows are looked up."""
    order = _sort_keys(key, location, ts, annotated)
    head = shots.orderBy(*order).select(F.col(key), F.col(ts)).first()
    if head is None or head[1] is not None:
        return rows
    timed = shots.filter(F.col(ts).isNotNull()).orderBy(*order).select(key).first()
    number = F.when(F.col(key) == F.lit(head[0]), F.lit(0))
    if timed is not None:
        number = number.when(F.col(key) == F.lit(timed[0]), F.lit(None))
    return rows.withColumn(out, number.otherwise(F.col(out)).cast("long"))


def _deltas(timed: DataFrame, numbers: DataFrame, key: str, location: str, annotated: str | None) -> DataFrame:
    """Gap before the first shot of every distinct instant; further shots of an instant have gap 0.

    A slot holds at most as many instants as the clock has ticks in it.
    """
    rank = F.struct(F.coalesce(~F.col(annotated), F.lit(True)) if annotated else F.lit(True), F.col(key))
    instants = timed.groupBy(location, "_cell", "_us").agg(F.min(rank).alias("_lead"))
    in_cell = Window.partitionBy(location, "_cell").orderBy("_us")
    lagged = instants.withColumn("_lag", F.lag("_us").over(in_cell))
    borders = numbers.select(location, "_cell", "_n", "_cell_before")
    joined = attach(lagged, borders, [location, "_cell"], F.col("_us"), weight="_n")
    gap = F.col("_us") - F.coalesce("_lag", "_cell_before")
    return joined.select(F.col(f"_lead.{key}").alias(key), gap.alias("_delta"), F.lit(True).alias("_has_delta"))


def sequence_summary(shots: DataFrame, location: str = "location", ts: str = "captured_at", limit_s: float | str = 120) -> DataFrame:
    """Size, first and last shot of every sequence; needs the cells only, not the rows."""
    cells = sequence_cells(shots, location, ts, limit_s)
    return cells.groupBy(location, F.col("_local").alias("sequence_number")).agg(
        F.sum("_n").alias("shots"), F.min("_first").alias("first_us"), F.max("_last").alias("last_us")
    ).withColumn("duration_s", (F.col("last_us") - F.col("first_us")) / F.lit(1e6))


def unlocated_as_minus_one(numbered: DataFrame, location: str = "location", out: str = "sequence_number") -> DataFrame:
    return numbered.withColumn(out, F.when(F.col(location).isNull(), F.lit(-1).cast("long")).otherwise(F.col(out)))


def sequence_entities(numbered: DataFrame, archive: str, number: str, key: str) -> DataFrame:
    """Local sequence id of every media file: its number, or a new one after the known ones.

    Files without a number get ``known count + position - 1`` in key order; they are entities of
    their own (``is_new``) even where that id is taken.
    """
    from trapline.operators.ordered import row_number_in_group

    known = numbered.filter(F.col(number).isNotNull()).select(archive, number).distinct()
    counts = known.groupBy(archive).agg(F.count(F.lit(1)).alias("_known"))
    open_rows = row_number_in_group(numbered.filter(F.col(number).isNull()), archive, [F.col(key)], "_position")
    fresh = attach(open_rows, counts, [archive], F.col(key)).withColumn(
        "local_id", F.coalesce("_known", F.lit(0)) + F.col("_position") - 1
    )
    kept = numbered.filter(F.col(number).isNotNull()).withColumn("local_id", F.col(number))
    pick = lambda df, new: df.select(archive, key, "local_id", F.lit(new).alias("is_new"))
    return pick(kept, False).unionByName(pick(fresh, True))
