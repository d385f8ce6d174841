"""The batch behaviours that make sense on a stream: ingest, sequences, duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch_folder(spark: SparkSession, path: str, schema: str, format: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """Rows of the files that arrive in a folder; the checkpoint remembers which were read."""
    reader = spark.readStream.format(format).schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> list[int]:
    """Process everything that is there and stop. Same checkpoint, next call: only what is new.

    A replayed batch writes the same file set again: the parquet sink keeps its own log, and
    ``each`` is handed the batch number to make its write repeatable (see ``streaming.upsert``).
    Returns the rows that every stateful operator still holds.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if each is not None:
        writer = writer.foreachBatch(each)
    else:
        writer = writer.format("parquet").option("path", sink)
    query = writer.start()
    query.awaitTermination()
    return [state["numRowsTotal"] for state in (query.lastProgress or {}).get("stateOperators", [])]


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, format: str = "parquet") -> None:
    """Append the rows of new files to the sink, each file once."""
    drain(watch_folder(spark, source, schema, format), sink, checkpoint)


def online_sequences(shots: DataFrame, location: str, ts: str, limit_s: int = 120, late: str = "10 minutes") -> DataFrame:
    """Sequences per location as session windows.

    A gap equal to the limit stays in the session. Sessions appear once, when the watermark has passed
    their end, and leave the state then: it holds the sessions of the last ``late`` and the limit.
    Shots that are later than ``late`` are dropped. ``ending`` closes what is open.
    """
    # session windows are half-open: one microsecond more makes a gap of exactly the limit join
    gap = F.session_window(F.col(ts), f"{limit_s * 1_000_000 + 1} microseconds")
    return (
        shots.filter(F.col(ts).isNotNull())
        .withWatermark(ts, late)
        .groupBy(F.col(location), gap.alias("session"))
        .agg(F.count(F.lit(1)).alias("shots"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))
        .select(location, "shots", "first_at", "last_at")
    )


def ending(shots: DataFrame, location: str, ts: str, limit_s: int = 120, late: str = "10 minutes") -> DataFrame:
    """A last shot, of no location, so much later than all ``shots`` (a table) that it closes their sessions."""
    after = F.max(ts) + F.expr(f"interval {late}") + F.expr(f"interval {2 * limit_s + 1} seconds")
    return shots.agg(after.alias(ts)).filter(F.col(ts).isNotNull()).select(F.lit(None).cast("string").alias(location), ts)


def online_unique(files: DataFrame, content: str, ts: str, late: str = "1 day") -> DataFrame:
    """First file of every content; state is kept for as long as copies may be late."""
    return files.withWatermark(ts, late).dropDuplicatesWithinWatermark([content])
