"""Coordinates, boxes and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lat_lon(location: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a ``"lat,lon"`` text."""
    return F.split_part(location, F.lit(","), F.lit(1)).try_cast("double"), F.split_part(location, F.lit(","), F.lit(2)).try_cast("double")


def rounded_location(lat: Column, lon: Column, order: int = 3) -> Column:
    """Anonymised ``"lat,lon"`` text, rounded half-even."""
    return F.concat(F.bround(lat, order).cast("string"), F.lit(","), F.bround(lon, order).cast("string"))


def degree_distance(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """Euclidean distance in degrees."""
    return F.sqrt((lat - other_lat) * (lat - other_lat) + (lon - other_lon) * (lon - other_lon))


def relative_box(x_min: Column, y_min: Column, x_max: Column, y_max: Column, width: Column, height: Column) -> dict[str, Column]:
    """Centre and size as fractions of the image."""
    return {
        "bbox_x_center": ((x_min + x_max) / 2) / width,
        "bbox_y_center": ((y_min + y_max) / 2) / height,
        "bbox_width": (x_max - x_min) / width,
        "bbox_height": (y_max - y_min) / height,
    }


def pixel_box(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Corners in pixels, truncated toward zero."""
    return {
        "x_min": ((xc - w / 2) * width).cast("int"),
        "y_min": ((yc - h / 2) * height).cast("int"),
        "x_max": ((xc + w / 2) * width).cast("int"),
        "y_max": ((yc + h / 2) * height).cast("int"),
    }


def media_fragment(xc: Column, yc: Column, w: Column, h: Column) -> Column:
    """Box as a media-fragment text in percent; null without a box."""
    x, y = xc - w / 2, yc - h / 2
    return F.when(xc.isNotNull(), F.format_string("xywh=percent:%.4f,%.4f,%.4f,%.4f", x * 100, y * 100, w * 100, h * 100))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, and 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(100.0) * part / F.nullif(whole, F.lit(0)))


def representative_threshold(count: Column, coefficient: float = 5.0) -> Column:
    """Score a further representative must beat; grows with those already chosen."""
    return F.lit(1.0) - F.exp(-count / F.lit(coefficient))
