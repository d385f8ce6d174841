"""Aggregations: dashboards, roll-ups, histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions import dictionaries as D
from trapline.functions import geometry as G
from trapline.functions import text as X
from trapline.operators.access import tenant_totals
from trapline.session import pin

EARLY_STATUS = ("C", "TAIP", "TAID")


def count_rows() -> Column:
    return F.count(F.lit(1))


def files_per_archive(files: DataFrame, archive: str, path: str) -> DataFrame:
    """Number of files, images and videos of each archive listing (folders are not files)."""
    ending = F.lower(X.suffix(F.col(path)))
    return files.filter(~F.col(path).endswith("/")).groupBy(archive).agg(
        count_rows().alias("file_count"),
        F.count_if(ending.isin(*D.ARCHIVE_IMAGE_SUFFIXES)).alias("image_count"),
        F.count_if(ending.isin(*D.ARCHIVE_VIDEO_SUFFIXES)).alias("video_count"),
    )


def workgroup_dashboard(workgroups: DataFrame, owned_archives: DataFrame, owned_media: DataFrame) -> DataFrame:
    """Counts per workgroup, one pass over archives and one over media."""
    target = F.col("taxon_for_identification_id").isNotNull()
    ready = target & (F.col("identification_status") == "IR")
    archives = owned_archives.groupBy("owner_workgroup_id").agg(
        count_rows().alias("archives"),
        F.count_if(target).alias("archives_with_target"),
        F.count_if(ready).alias("archives_ready"),
    )
    media = owned_media.groupBy("owner_workgroup_id").agg(
        count_rows().alias("media"),
        F.count_if(target).alias("media_with_target"),
        F.count_if(target & F.col("identity_id").isNull()).alias("media_without_identity"),
        F.count_if(target & F.col("identity_is_representative")).alias("representative_media"),
        F.count_if(ready).alias("media_ready"),
    )
    return _zero_filled(workgroups.select(F.col("id").alias("workgroup_id")), [archives, media], "workgroup_id", "owner_workgroup_id")


def _zero_filled(base: DataFrame, counted: list[DataFrame], key: str, other: str) -> DataFrame:
    for counts in counted:
        renamed = counts.withColumnRenamed(other, "_key")
        base = base.join(renamed, F.col(key) == F.col("_key"), "left").drop("_key")
        base = base.fillna(0, [c for c in counts.columns if c != other])
    return base


def user_dashboard(users: DataFrame, owned_archives: DataFrame, owned_media: DataFrame, missing: DataFrame, identities: DataFrame) -> DataFrame:
    """Counts per user: own archives and media, tenant-wide open work, identities of the workgroup.

    Everything is first counted per owner; the tenant sums run over one row per owner. Users
    without a workgroup share the rows without one.
    """
    target = F.col("taxon_for_identification_id").isNotNull()
    per_owner = owned_media.groupBy("owner_id", "owner_workgroup_id").agg(
        count_rows().alias("media"),
        F.count_if(F.col("taxon_id").isNotNull()).alias("known_taxon"),
        F.count_if(F.col("taxon_verified") == False).alias("unverified"),  # noqa: E712
        F.count_if(target).alias("for_identification"),
        F.count_if(target & F.col("identity_id").isNull()).alias("missing_identity"),
        F.count_if(target & F.col("identity_id").isNotNull()).alias("known_identity"),
    )
    missing_per_owner = missing.groupBy("owner_id").agg(count_rows().alias("missing_taxon"))
    # one row per owner, read by every sum below
    per_owner = pin(per_owner.join(missing_per_owner, "owner_id", "left").fillna(0, ["missing_taxon"]))
    own = per_owner.groupBy("owner_id").agg(F.sum("media").alias("media"), F.sum("known_taxon").alias("known_taxon"))
    archives = owned_archives.groupBy("owner_id").agg(count_rows().alias("archives"))
    tenant = tenant_totals(
        per_owner, users, {"media_general": "media", "missing_taxon_general": "missing_taxon", "unverified_general": "unverified"}
    )
    by_group = per_owner.groupBy("owner_workgroup_id").agg(
        *[F.sum(c).alias(c) for c in ("for_identification", "missing_identity", "known_identity")]
    )
    named = identities.groupBy("owner_workgroup_id").agg(count_rows().alias("identities"))
    result = _zero_filled(tenant, [own, archives], "id", "owner_id")
    for counts in (by_group, named):
        renamed = counts.withColumnRenamed("owner_workgroup_id", "_key")
        result = result.join(renamed, F.col("workgroup_id").eqNullSafe(F.col("_key")), "left").drop("_key")
    return result.fillna(0, [c for c in result.columns if c not in ("id", "workgroup_id")])


def archive_list_counts(archives: DataFrame, owned_media: DataFrame) -> DataFrame:
    """Media, media of the target taxon and first capture of every archive."""
    counts = owned_media.groupBy(F.col("parent_id").alias("_archive")).agg(
        count_rows().alias("mediafile_count"),
        F.count_if(F.col("taxon_id") == F.col("taxon_for_identification_id")).alias("mediafile_count_with_taxon"),
        F.min("captured_at").alias("earliest_captured_at"),
    )
    joined = archives.join(counts, archives["id"] == counts["_archive"], "left").drop("_archive")
    return joined.fillna(0, ["mediafile_count", "mediafile_count_with_taxon"])


def identity_rollup(identities: DataFrame, media: DataFrame) -> DataFrame:
    """Media, representatives, distinct localities and last sighting; identities without media stay."""
    counts = media.filter("identity_id is not null").groupBy("identity_id").agg(
        count_rows().alias("mediafile_count"),
        F.count_if("identity_is_representative").alias("representative_count"),
        F.count_if(~F.col("identity_is_representative")).alias("non_representative_count"),
        F.count_distinct("locality_id").alias("locality_count"),
        F.max("captured_at").alias("last_seen"),
    )
    joined = identities.filter(F.col("name") != "nan").join(counts, F.col("id") == F.col("identity_id"), "left").drop("identity_id")
    return joined.fillna(0, ["mediafile_count", "representative_count", "non_representative_count", "locality_count"])


def curation_order(rollup: DataFrame) -> DataFrame:
    """Identities that still have non-representative media, fewest representatives first."""
    return rollup.filter("non_representative_count > 0").orderBy(
        F.col("representative_count"), F.col("non_representative_count").desc(), F.col("id")
    )


def locality_rollup(localities: DataFrame, media: DataFrame) -> DataFrame:
    counts = media.filter("locality_id is not null").groupBy("locality_id").agg(count_rows().alias("mediafile_count"))
    joined = localities.join(counts, localities["id"] == counts["locality_id"], "left").drop("locality_id")
    lat, lon = G.lat_lon(F.col("location"))
    return joined.fillna(0, ["mediafile_count"]).withColumns({"lat": lat, "lon": lon})


def localities_of_identity(media: DataFrame) -> DataFrame:
    """How often each identity was seen at each locality, with its rank by frequency."""
    counts = media.filter("identity_id is not null and locality_id is not null").groupBy("identity_id", "locality_id").agg(count_rows().alias("n"))
    order = Window.partitionBy("identity_id").orderBy(F.col("n").desc(), F.col("locality_id"))
    return counts.withColumn("position", F.row_number().over(order).cast("long"))


def archive_statistics(archives: DataFrame, media: DataFrame, missing: DataFrame, not_classified_id: int | None = None) -> DataFrame:
    """What the detail page of an archive shows.

    Archives in an early status report the number of files at upload. A single-taxon archive has
    no missing taxa. An empty archive has 0 percent.
    """
    known = F.col("taxon_id")
    if not_classified_id is not None:
        known = F.when(F.col("taxon_id") != not_classified_id, F.col("taxon_id"))
    stats = media.groupBy(F.col("parent_id").alias("_archive")).agg(
        count_rows().alias("media"),
        F.count_if("identity_is_representative").alias("representative"),
        F.count_if("taxon_verified").alias("verified"),
        F.count_if(F.col("taxon_verified") == False).alias("unverified"),  # noqa: E712
        F.count_distinct("identity_id").alias("identities"),
        F.count_distinct(known).alias("taxa"),
    )
    gaps = missing.groupBy(F.col("parent_id").alias("_gap_archive")).agg(count_rows().alias("missing_taxon"))
    joined = archives.join(stats, F.col("id") == F.col("_archive"), "left").join(gaps, F.col("id") == F.col("_gap_archive"), "left")
    counted = ["media", "representative", "verified", "unverified", "identities", "taxa", "missing_taxon"]
    joined = joined.drop("_archive", "_gap_archive").fillna(0, counted)
    shown = F.when(F.col("taxon_status").isin(*EARLY_STATUS), F.col("mediafiles_at_upload")).otherwise(F.col("media"))
    return (
        joined.withColumn("shown_media", shown)
        .withColumn("with_taxon", F.col("shown_media") - F.col("missing_taxon"))
        .withColumn("taxon_percent", G.percent(F.col("with_taxon"), F.col("shown_media")))
        .withColumn("verified_percent", G.percent(F.col("verified"), F.col("shown_media")))
    )


def capture_bounds(media: DataFrame, archive: str) -> DataFrame:
    return media.groupBy(archive).agg(F.min("captured_at").alias("earliest"), F.max("captured_at").alias("latest"))


def taxon_at_bounds(media: DataFrame, archive: str, key: str) -> DataFrame:
    """Taxon of the first and of the last shot; a shot without time comes last, so it is the latest."""
    early = F.struct(F.col("captured_at").isNull(), F.col("captured_at"), F.col(key))
    late = F.struct(F.col("captured_at").isNull(), F.col("captured_at"), -F.col(key))
    return media.groupBy(archive).agg(F.min_by("taxon_id", early).alias("earliest_taxon"), F.max_by("taxon_id", late).alias("latest_taxon"))


def taxon_histogram(named_media: DataFrame) -> DataFrame:
    """Media per taxon name; the bucket without a name counts 0."""
    return named_media.groupBy("taxon_name").agg(F.count("taxon_name").alias("n"))


def uploads_per_day(media: DataFrame, ts: str, user: str) -> DataFrame:
    return media.groupBy(F.to_date(ts).alias("date"), F.col(user)).agg(count_rows().alias("n"))


def date_tree(rows: DataFrame, ts: str, zone: str = "Europe/Prague") -> DataFrame:
    """Distinct local dates per year and month, newest first; months sort by name, last first.

    Days are made distinct before they are gathered, so a month holds at most 31 of them.
    """
    day = F.to_date(F.from_utc_timestamp(F.col(ts), zone))
    days = rows.filter(F.col(ts).isNotNull()).select(day.alias("day")).distinct()
    months = days.groupBy(F.year("day").alias("year"), F.date_format("day", "MMMM").alias("month")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("day"), asc=False), lambda d: d.cast("string")), ",").alias("days")
    )
    order = Window.partitionBy("year").orderBy(F.col("month").desc())  # at most 12 rows per year
    return months.withColumn("position", F.row_number().over(order).cast("long"))


def class_extremes(rows: DataFrame, label: str) -> DataFrame:
    """Most and least common class with their counts; the smaller label wins ties."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(count_rows().alias("n"))
    most, least = F.struct(F.col("n"), -F.col("label")), F.struct(F.col("n"), F.col("label"))
    return counts.agg(
        F.max_by("label", most).alias("most_common"), F.max("n").alias("most_count"),
        F.min_by("label", least).alias("least_common"), F.min("n").alias("least_count"),
    )


def vector_per_group(rows: DataFrame, group: str, vector: str, how: str = "mean") -> DataFrame:
    """Mean (or sum) of vectors per group, component by component.

    Every batch of rows is summed in its task, so what is gathered per group is one vector for
    each of the batches that hold rows of it, at most one in some thousand rows of a large group.
    Rows without a vector don't count. The vectors of a group are of one length.
    """
    kind = rows.select(group).schema[0].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, vectors = batch.column(0), batch.column(1)
            lengths = np.diff(np.asarray(vectors.offsets))
            code = np.asarray(keys.dictionary_encode(null_encoding="encode").indices)
            values = np.asarray(vectors.flatten(), dtype=np.float64)
            out = []
            for size in np.unique(lengths):  # one in practice
                at = np.flatnonzero(lengths == size)
                order = at[np.argsort(code[at], kind="stable")]
                first = np.flatnonzero(np.concatenate(([True], code[order][1:] != code[order][:-1])))
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
                matrix = values[starts[:, None] + np.arange(size)] if size else np.empty((len(order), 0))
                sums, counts = np.add.reduceat(matrix, first, axis=0), np.diff(np.append(first, len(order)))
                out.append(pa.RecordBatch.from_arrays([keys.take(pa.array(order[first])), pa.array(list(sums), pa.list_(pa.float64())), pa.array(counts.astype(np.int64))], [group, "total", "n"]))
            yield from out

    usable = rows.select(group, F.col(vector).cast("array<double>").alias(vector)).filter(F.col(vector).isNotNull())
    sums = usable.mapInArrow(partial, f"`{group}` {kind}, total array<double>, n long").groupBy(group).agg(F.collect_list("total").alias("_totals"), F.sum("n").alias("_n"))
    start = F.transform(F.col("_totals")[0], lambda x: F.lit(0.0))
    total = F.aggregate("_totals", start, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))
    out = sums.select(group, total.alias(vector), "_n")
    if how == "mean":
        out = out.withColumn(vector, F.transform(vector, lambda x: x / F.col("_n")))
    return out.drop("_n")


def map_summary(points: DataFrame) -> DataFrame:
    """Extent, mean centre and zoom level of points with ``lat`` and ``lon``."""
    known = points.filter("lat is not null and lon is not null")
    summary = known.agg(
        count_rows().alias("n"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.avg("lat").alias("lat_mean"), F.avg("lon").alias("lon_mean"),
    )
    widest = F.greatest(F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min"))
    zoom = F.when(widest < 10, 6).when(widest < 30, 5).when(widest < 60, 4).otherwise(3)
    return summary.withColumn("zoom", zoom)
