"""Media, observation and archive queries: lookups, filters, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions import arrays as A
from trapline.functions import dictionaries as D
from trapline.functions import text as X
from trapline.functions.geometry import representative_threshold
from trapline.operators.skew import attach, keys_of


def lookup(fact: DataFrame, dimension: DataFrame, key: str, prefix: str, columns: list[str]) -> DataFrame:
    """Left join of a many-to-one reference, its columns prefixed.

    No broadcast hint: the dimension may grow with the data, so the size-based choice and the
    skew handling of the adaptive planner decide.
    """
    picked = dimension.select(F.col("id").alias(f"_{prefix}_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
    return fact.join(picked, F.col(key) == F.col(f"_{prefix}_id"), "left").drop(f"_{prefix}_id")


def media_with_names(media: DataFrame, localities: DataFrame, taxa: DataFrame, identities: DataFrame) -> DataFrame:
    """Media with the names of their locality, taxon and identity."""
    named = lookup(media, localities, "locality_id", "locality", ["name", "location"])
    named = lookup(named, taxa, "taxon_id", "taxon", ["name"])
    return lookup(named, identities, "identity_id", "identity", ["name", "code", "juv_code"])


# ---- observations of a media file -----------------------------------------------------------


def observation_flags(observations: DataFrame, taxa: DataFrame) -> DataFrame:
    """One row per media file with what its observations say.

    A taxon is missing if it is null, "Not Classified", or "Animalia" that was not verified.
    Aggregated before any join with media, so that a file with very many observations costs one
    partial row per task.
    """
    named = lookup(observations, taxa, "taxon_id", "taxon", ["name"])
    name, unverified = F.col("taxon_name"), F.col("taxon_verified") == False  # noqa: E712
    placeholder = (
        name.isNull()
        | (name == D.TAXON_NOT_CLASSIFIED)
        | ((name == D.TAXON_ANY_ANIMAL) & F.coalesce(unverified, F.lit(False)))
    )
    return named.groupBy("mediafile_id").agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.bool_or(~placeholder).alias("has_valid"),
        F.bool_or(~F.coalesce(F.col("taxon_verified"), F.lit(False))).alias("has_unverified"),
        F.bool_and(F.coalesce(F.col("taxon_verified"), F.lit(True))).alias("all_verified"),
        F.min("taxon_id").alias("min_taxon"),
        F.max("taxon_id").alias("max_taxon"),
        F.bool_or(F.col("taxon_id").isNull()).alias("has_null_taxon"),
    )


def with_flags(media: DataFrame, flags: DataFrame) -> DataFrame:
    return media.join(flags, media["id"] == flags["mediafile_id"], "left").drop("mediafile_id")


def missing_taxon(owned: DataFrame, flags: DataFrame) -> DataFrame:
    """Media of mixed archives without any observation of a valid taxon."""
    valid = flags.filter("has_valid").select("mediafile_id")
    mixed = owned.filter(~F.col("contains_single_taxon"))
    return mixed.join(valid, mixed["id"] == valid["mediafile_id"], "left_anti")


def missing_verification(owned: DataFrame, flags: DataFrame) -> DataFrame:
    """Media of mixed archives with an observation that is not verified."""
    open_ones = flags.filter("has_unverified").select("mediafile_id")
    mixed = owned.filter(~F.col("contains_single_taxon"))
    return mixed.join(open_ones, mixed["id"] == open_ones["mediafile_id"], "left_semi")


def with_observed_taxon(media: DataFrame, observations: DataFrame, taxon: Column) -> DataFrame:
    """Media having an observation of the given taxon."""
    ids = keys_of(observations.filter(F.col("taxon_id") == taxon), "mediafile_id")
    return media.join(ids, media["id"] == ids["mediafile_id"], "left_semi")


def for_suggestion(media: DataFrame, flags: DataFrame) -> DataFrame:
    """Media with a predicted taxon whose observations all carry one and the same placeholder."""
    one_value = F.when(F.col("has_null_taxon"), F.col("min_taxon").isNull()).otherwise(F.col("min_taxon") == F.col("max_taxon"))
    ready = flags.filter(~F.col("has_valid") & one_value).select("mediafile_id")
    return media.filter("predicted_taxon_id is not null").join(ready, F.col("id") == F.col("mediafile_id"), "left_semi")


def single_taxon(flags: DataFrame, mixed_id: int) -> DataFrame:
    """The one taxon of a media file, the id of "Mixed" for several, null for none."""
    return flags.select(
        "mediafile_id",
        F.when(F.col("min_taxon") == F.col("max_taxon"), F.col("min_taxon"))
        .when(F.col("min_taxon").isNotNull(), F.lit(mixed_id).cast("long"))
        .alias("taxon_id"),
        "all_verified",
    )


# ---- option filters -------------------------------------------------------------------------


def upload_state(
    archives: DataFrame, single_taxon: bool | None = None, without_target: bool | None = None, identities: bool | None = None
) -> DataFrame:
    """Archives by upload state; an option left out is no condition."""
    if single_taxon is not None:
        archives = archives.filter(F.col("contains_single_taxon") == single_taxon)
    if without_target is not None:
        archives = archives.filter(F.col("taxon_for_identification_id").isNull() == without_target)
    if identities is not None:
        archives = archives.filter(F.col("contains_identities") == identities)
    return archives


def facets(media: DataFrame, date_from: str | None = None, date_to: str | None = None, text: str | None = None, contains: dict[str, str] | None = None, **equal) -> DataFrame:
    """Media by equality, case-insensitive containment, capture date (both ends included) and free text."""
    for column, value in equal.items():
        media = media.filter(F.col(column) == value)
    for column, value in (contains or {}).items():
        media = media.filter(X.contains_ignoring_case(F.col(column), value))
    if date_from:
        media = media.filter(F.to_date("captured_at") >= F.lit(date_from).cast("date"))
    if date_to:
        media = media.filter(F.to_date("captured_at") <= F.lit(date_to).cast("date"))
    if text:
        names = [F.col(c) for c in ("taxon_name", "locality_name", "identity_name")]
        media = media.filter(X.contains_ignoring_case(X.search_text(*names), text))
    return media


def form_flags(media: DataFrame, videos: bool = False, images: bool = False, orientation: str = "All", hide_empty: bool = False) -> DataFrame:
    """The list form: videos or images only, one orientation, without files where nothing was seen."""
    if videos != images:
        media = media.filter(F.col("media_type") == ("video" if videos else "image"))
    if orientation != "All":
        media = media.filter(F.col("orientation") == orientation)
    if hide_empty:
        media = media.filter(~F.coalesce(F.col("taxon_name") == D.TAXON_NOTHING, F.lit(False)))
    return media


def notification_filter(notes: DataFrame, level: int | None = None, read: bool | None = None, after: str | None = None, before: str | None = None, text: str | None = None) -> DataFrame:
    """Notifications by level, read state, creation time and message text."""
    if level is not None:
        notes = notes.filter(F.col("level") == level)
    if read is not None:
        notes = notes.filter(F.col("read") == read)
    if after:
        notes = notes.filter(F.col("created_at") >= F.lit(after).cast("timestamp"))
    if before:
        notes = notes.filter(F.col("created_at") <= F.lit(before).cast("timestamp"))
    if text:
        notes = notes.filter(X.contains_ignoring_case(F.col("message"), text))
    return notes


def split_readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and videos that could be read, and those that could not."""
    known = files.filter(F.col("media_type").isin("image", "video"))
    return known.filter(F.col("read_error") == ""), known.filter(F.col("read_error") != "")


def without_file(files: DataFrame, column: str) -> DataFrame:
    return files.filter(F.col(column).isNull() | (F.col(column) == ""))


def gallery_media(media: DataFrame, observations: DataFrame, workgroups: DataFrame) -> DataFrame:
    """Whether each media file of a workgroup may stand in its gallery, as ``used_for_init``.

    It has to be a representative of a known identity and, where the workgroup has a default
    taxon, to have an observation of that taxon.
    """
    taxa = workgroups.select(F.col("id").alias("_wg"), F.col("default_taxon_id").alias("_default"))
    rows = media.filter("owner_workgroup_id is not null").join(taxa, F.col("owner_workgroup_id") == F.col("_wg"), "left")
    seen = keys_of(observations.filter("taxon_id is not null"), "mediafile_id", "taxon_id").select(F.col("mediafile_id").alias("_m"), F.col("taxon_id").alias("_taxon"))
    rows = rows.join(seen, (F.col("id") == F.col("_m")) & (F.col("_default") == F.col("_taxon")), "left")
    fits = F.col("_default").isNull() | F.col("_m").isNotNull()
    used = F.coalesce(F.col("identity_is_representative"), F.lit(False)) & F.col("identity_id").isNotNull() & fits
    return rows.withColumn("used_for_init", used).select(*media.columns, "used_for_init")


def representative_candidates(media: DataFrame, detections: DataFrame, order: list[str], coefficient: float = 5.0) -> DataFrame:
    """Whether each media file with an identity is good enough for a further representative of it.

    The score is the orientation score of the first detection in ``order``, or its confidence
    where there is none and it has a class, or 0; half of it has to beat a threshold that grows
    with the representatives the identity has. ``detections`` has ``mediafile_id``,
    ``orientation_score``, ``confidence`` and ``class``.
    """
    score = F.coalesce("orientation_score", F.when(F.col("class").isNotNull(), F.col("confidence")), F.lit(0.0))
    first = detections.groupBy("mediafile_id").agg(F.min_by(score, F.struct(*order)).alias("_score"))
    known = media.filter("identity_id is not null")
    counts = known.groupBy("identity_id").agg(F.count_if("identity_is_representative").alias("_chosen"), F.count(F.lit(1)).alias("_media"))
    rows = attach(known, counts, ["identity_id"], F.col("id"), weight="_media").join(first, F.col("id") == F.col("mediafile_id"), "left")
    threshold = representative_threshold(F.col("_chosen"), coefficient)
    return rows.select("id", threshold.alias("threshold"), (F.coalesce("_score", F.lit(0.0)) / 2 > threshold).alias("is_candidate"))


def detection_observations(rows: DataFrame, mode: str = "all", threshold: float = 0.5) -> DataFrame:
    """Observations from the detections that an import brings, with boxes as shares of the image.

    ``rows`` has ``mediafile_id``, ``detections`` (see ``functions.arrays``), ``identity_id``,
    ``taxon_id``, ``predicted_taxon_id`` and ``predicted_taxon_confidence``. With ``all`` every
    detection is an observation, and only the first gets the identity. With ``reference`` each
    file keeps one observation that every detection overwrites: the box is that of the last, the
    orientation the last known one, and the identity stays. A weak orientation is unknown, ``left``
    counts as front. Files without detections give nothing.
    """
    every = rows.filter(F.size("detections") > 0)
    known = lambda d: A.orientation_code(d["orientation"], d["orientation_score"], threshold, left_as_front=True)
    if mode == "all":
        found = every.select("*", F.posexplode("detections").alias("position", "d")).withColumn("orientation", known(F.col("d")))
        identity = F.when(F.col("position") == 0, F.col("identity_id"))
    else:
        codes = F.array_compact(F.transform("detections", known))
        found = every.withColumns({"position": F.lit(0), "d": F.element_at("detections", -1), "orientation": F.try_element_at(codes, F.lit(-1))})
        identity = F.col("identity_id")
    box, height, width = F.col("d")["bbox"], F.col("d")["size"][0], F.col("d")["size"][1]
    return found.select(
        "mediafile_id", "position", identity.alias("identity_id"), "taxon_id", "predicted_taxon_id", "predicted_taxon_confidence",
        ((box[0] + box[2]) / 2 / width).alias("bbox_x_center"), ((box[1] + box[3]) / 2 / height).alias("bbox_y_center"),
        ((box[2] - box[0]) / width).alias("bbox_width"), ((box[3] - box[1]) / height).alias("bbox_height"), "orientation",
    )
