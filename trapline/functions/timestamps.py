"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions import dictionaries as D
from trapline.functions.arrays import let

EXIF_PATTERN = r"([0-9]{4}):([0-9]{2}):([0-9]{2}) ([0-9]{2}:[0-9]{2}:[0-9]{2}.*)"
# The text layouts that two camera models print into the frame.
OCR_MONTH_FIRST = r"\b(\d{1,2})[-/s.](\d{1,2})[-/s.](\d{4}) (\d{1,2}):(\d{1,2}) ?([AP]M)"
OCR_YEAR_FIRST = r"\d{1,3}Sec (\d{4})/(\d{2})/(\d{2}) (\d{1,2}):(\d{1,2}):(\d{1,2})"


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The ``n`` groups of the first match as an array, by two passes over the text; one empty string without a match."""
    return F.split(F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, "\u0001".join(f"${i}" for i in range(1, n + 1))), "\u0001")


def exif_to_standard(text: Column) -> Column:
    """``YYYY:MM:DD hh:mm:ss`` to ``YYYY-MM-DD hh:mm:ss``, only where it occurs exactly once.

    The trailing ``.*`` takes the rest of the line, so a second match needs a second line.
    """
    once = F.regexp_count(text, F.lit(EXIF_PATTERN)) == 1
    return F.when(once, F.regexp_replace(F.regexp_extract(text, EXIF_PATTERN, 0), EXIF_PATTERN, "$1-$2-$3 $4")).otherwise(text)


def ocr_month_first(text: Column) -> Column:
    """``MM/DD/YYYY hh:mm AM`` as a timestamp; 12 AM is midnight and 12 PM is noon."""

    def stamp(g: Column) -> Column:
        hour12 = F.pmod(g[3].try_cast("int"), F.lit(12))
        hour = F.when(g[5] == "PM", hour12 + 12).otherwise(hour12)
        told = F.format_string("%s-%s-%s %s:%s:00", g[2], F.lpad(g[0], 2, "0"), F.lpad(g[1], 2, "0"), F.lpad(hour.cast("string"), 2, "0"), F.lpad(g[4], 2, "0"))
        return F.when(F.size(g) == 6, F.try_to_timestamp(told, F.lit("yyyy-MM-dd HH:mm:ss")))

    return let(_groups(text, OCR_MONTH_FIRST, 6), stamp)


def ocr_year_first(text: Column) -> Column:
    """``30Sec YYYY/MM/DD h:mm:ss`` as a timestamp."""

    def stamp(g: Column) -> Column:
        told = F.format_string("%s-%s-%s %s:%s:%s", g[0], g[1], g[2], F.lpad(g[3], 2, "0"), F.lpad(g[4], 2, "0"), F.lpad(g[5], 2, "0"))
        return F.when(F.size(g) == 6, F.try_to_timestamp(told, F.lit("yyyy-MM-dd HH:mm:ss")))

    return let(_groups(text, OCR_YEAR_FIRST, 6), stamp)


def ocr_time(text: Column) -> Column:
    return F.coalesce(ocr_month_first(text), ocr_year_first(text))


def lenient(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Parse, with null for what does not parse."""
    return F.try_to_timestamp(text, F.lit(pattern))


def capture_time(
    rows: DataFrame, tags: str, ocr_text: str, file_times: list[Column], blacklist: list[str], read_error: str | None = None,
    text: str = "datetime", error: str = "read_error", source: str = "datetime_source",
) -> DataFrame:
    """Add the capture time as text, what went wrong, and the source of the time.

    First present tag in order of trust; a blacklisted value counts as absent. A QuickTime value
    keeps its place but loses its source name. Then the text printed into the frame, then the
    oldest file system time. A file that could not be read (``read_error``, a column) has its
    error and neither time nor source.

    Every step is a projection of its own, so that each pattern is looked for once.
    """
    present = [F.try_element_at(F.col(tags), F.lit(k)) for k in D.CAPTURE_TIME_TAGS]
    key = F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in zip(D.CAPTURE_TIME_TAGS, present)])
    failed = F.coalesce(F.col(read_error), F.lit("")) if read_error else F.lit("")
    staged = rows.withColumns({"_tag": key, "_raw": F.coalesce(*present), "_failed": failed}).withColumn("_value", exif_to_standard(F.col("_raw")))
    absent = F.col("_value").isNull() | (F.col("_value") == "")
    if blacklist:
        absent = absent | F.col("_value").isin(*blacklist)
    printed = F.date_format(ocr_time(F.col(ocr_text)), "yyyy-MM-dd HH:mm:ss")
    quick = F.col("_tag").startswith("QuickTime")
    staged = staged.withColumns({"_tagged": F.when(~absent, F.col("_value")), "_demoted": F.when(quick, F.col("_value")), "_quick": quick})
    staged = staged.withColumn("_printed", F.when(F.col("_tagged").isNull(), printed))
    oldest = F.date_format(F.least(*file_times) if len(file_times) > 1 else file_times[0], "yyyy-MM-dd HH:mm:ss")
    origin = (
        F.when(F.col("_tagged").isNotNull(), F.when(F.col("_quick"), "").otherwise(F.col("_tag")))
        .when(F.col("_printed").isNotNull(), "OCR")
        .when(F.col("_demoted").isNotNull(), F.col("_tag"))
        .otherwise("File system")
    )
    good = F.col("_failed") == ""
    out = {
        text: F.when(good, F.coalesce("_tagged", "_printed", "_demoted", oldest)).otherwise(""),
        error: F.col("_failed"),
        source: F.when(good, origin).otherwise(""),
    }
    return staged.withColumns(out).drop("_tag", "_raw", "_failed", "_value", "_tagged", "_demoted", "_quick", "_printed")


def local_to_utc(text: Column, zone: str = "Europe/Prague") -> Column:
    """Timestamp of a text: as given if it names an offset, else wall clock of ``zone``."""
    offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    aware = F.try_to_timestamp(text)
    naive = F.to_utc_timestamp(F.try_to_timestamp(text), zone)
    return F.when(offset, aware).otherwise(naive)


def shift(ts: Column, years: int = 0, days: int = 0, hours: int = 0) -> Column:
    """Move by calendar years, days and hours; Feb 29 plus one year is Feb 28."""
    return ts + F.make_interval(F.lit(years), F.lit(0), F.lit(0), F.lit(days), F.lit(hours))


def naive(ts: Column, zone: str = "UTC") -> Column:
    """Wall clock of ``zone`` without zone, as spreadsheets want it."""
    return F.from_utc_timestamp(ts, zone).cast("timestamp_ntz")


def processing_seconds(images: Column, videos: Column) -> Column:
    """Estimated processing time: 10 s, plus 0.5 s per image and 60 s per video."""
    return F.lit(10.0) + images * F.lit(0.5) + videos * F.lit(60.0)


def readable_wait(seconds: Column) -> Column:
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    return (
        F.when(seconds < 60, "in a few seconds")
        .when(seconds < 3600, F.when(minutes == 1, "in a minute").otherwise(F.concat(F.lit("in "), minutes.cast("string"), F.lit(" minutes"))))
        .otherwise(F.when(hours == 1, "in an hour").otherwise(F.concat(F.lit("in "), hours.cast("string"), F.lit(" hours"))))
    )
