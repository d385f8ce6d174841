"""Frames of videos and points of a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.operators.ordered import next_over_all, ordered_ranges, running_sum
from trapline.operators.ranking import top_per_group


def key_frames(videos: DataFrame, detections: DataFrame, largest: int = 24) -> DataFrame:
    """Frame that represents a video: of the ``largest`` frames by animal area the widest animal.

    One detection per frame counts, the most confident. Videos without detections use frame 0.
    ``detections`` has ``detection`` (a sortable key), ``w``, ``h`` and the image size.
    """
    per_frame = detections.groupBy("video_id", "frame").agg(
        F.min_by(F.struct("w", "h", "size_0", "size_1"), F.struct(-F.col("confidence"), F.col("detection"))).alias("best")
    ).select("video_id", "frame", "best.*")
    area = (F.col("w") * F.col("h")) / (F.col("size_0") * F.col("size_1"))
    big = top_per_group(
        per_frame.withColumn("_area", area).filter("_area > 0"), ["video_id"], [F.col("_area").desc(), F.col("frame").desc()], largest, "_place"
    )
    ratio = F.col("w") / F.col("h")
    chosen = big.groupBy("video_id").agg(F.min_by("frame", F.struct(-ratio, F.col("_place"))).alias("key_frame"))
    return videos.join(chosen, "video_id", "left").fillna(0, ["key_frame"])


def clip_window(center: Column, frames: Column, size: int) -> tuple[Column, Column]:
    """First frame and end (exclusive) of a clip around ``center``, shifted to fit the video.

    A video shorter than the clip is taken whole.
    """
    start = center - F.lit(-(-size // 2))
    end = center + F.lit(size // 2)
    pushed_end = end + F.greatest(-start, F.lit(0))
    pushed_start = F.greatest(start, F.lit(0))
    last = frames - 1
    fitted = F.when(pushed_end > last, pushed_start + (last - pushed_end)).otherwise(pushed_start)
    short = F.lit(size) > frames
    return F.when(short, F.lit(0)).otherwise(fitted), F.when(short, frames).otherwise(F.least(pushed_end, last))


def capture_trace(points: DataFrame, ts: str, key: str, value: str) -> DataFrame:
    """Points in time order with their step, the value of the next point, and the last two flagged."""
    order = [F.col(ts), F.col(key)]
    ranges = ordered_ranges(points, order)
    ahead = next_over_all(ranges, order, F.col(value), "next", pinned=True)
    total = ranges.agg(F.count(F.lit(1))).scalar()
    numbered = running_sum(ahead, order, F.lit(1).cast("long"), "step", pinned=True)
    return numbered.withColumn("last_segment", F.col("step") > total - 2)
