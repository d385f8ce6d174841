"""Imports that change several tables at once: media, observations, and the taxa, identities and localities they name.

Names are looked up once per distinct key, missing keys get new ids in one allocation per table,
and all returned tables agree on them: new keys are numbered over ranges that are written to the
shared folder, so ids stay the same for every reader. Tables that grow with the data are joined by
``merge``: stored tables are far smaller than their rows, and Spark would send them through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions import arrays as A
from trapline.functions import geometry as G
from trapline.functions.timestamps import local_to_utc
from trapline.operators.media import detection_observations
from trapline.operators.merge import SHEET_FIELDS, get_or_create, greatest_id, last_given, normalised_sheet
from trapline.operators.ordered import row_number_over_all
from trapline.operators.skew import attach
from trapline.session import pin

# What an import may bring besides ``archive_id``, ``path`` and ``position``.
INCOMING = {
    "original_path": "string", "media_type": "string", "datetime": "string", "predicted_category": "string", "predicted_category_raw": "string",
    "predicted_prob_raw": "double", "unique_name": "string", "detections": None,
}


@dataclass(frozen=True)
class Archive:
    """The tables of an archive store.

    ``taxa`` has id and name; ``identities`` id, name, code, coat_type and owner_workgroup_id;
    ``localities`` id, name, location and owner_id; ``media`` id, archive_id, path,
    original_filename, media_type, captured_at, locality_id, taxon_id, identity_id,
    identity_is_representative, predicted_taxon_id, predicted_taxon_confidence, orientation,
    metadata_json and updated_by; ``observations`` the columns of
    ``media.detection_observations``. Tables may have more columns, which new rows leave null.
    """

    media: DataFrame
    observations: DataFrame
    taxa: DataFrame
    identities: DataFrame
    localities: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def ids_of(rows: DataFrame, dimension: DataFrame, on: dict[str, str], out: str, spread_by: Column) -> DataFrame:
    """``rows`` with the id of the dimension row whose keys they name; of equal keys the smallest id.

    ``on`` maps columns of the dimension to columns of ``rows``. A name that many rows share is
    spread over several tasks. Rows without a name get none.
    """
    name = next(iter(on))
    keys = dimension.filter(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(*on).agg(F.min("id").alias(out)).withColumnsRenamed(on)
    return attach(rows, keys, list(on.values()), spread_by, shuffled=True)


def _last_rows(incoming: DataFrame, captured: Column) -> DataFrame:
    """One row per file: the last one, with the last time that could be read."""
    columns = [c for c in incoming.columns if c not in ("archive_id", "path")]
    timed = incoming.withColumn("_captured", captured)
    one = timed.groupBy("archive_id", "path").agg(
        F.max_by(F.struct(*columns), "position").alias("_r"), F.max_by("_captured", F.when(F.col("_captured").isNotNull(), F.col("position"))).alias("captured")
    )
    return one.select("archive_id", "path", "captured", "_r.*")


def import_archives(
    before: Archive, archives: DataFrame, incoming: DataFrame, create_missing: bool = True, zone: str = "Europe/Prague", observations: str = "reference", threshold: float = 0.5
) -> tuple[Archive, DataFrame]:
    """All tables after the processed metadata of some archives came in, and the ``status`` of every file.

    ``archives`` has id, owner_id, owner_workgroup_id, contains_single_taxon, contains_identities,
    taxon_for_identification_id and locality (a name or null); ``incoming`` archive_id, path,
    position and any of ``INCOMING``, one row per file (of several the last counts). Rows of
    unknown archives and without a path are left out.

    Files are matched by archive and path. Missing ones are created, with the archive's locality and
    as representatives if the archive holds identities of one taxon; without ``create_missing`` they
    are ``deleted``, which changes nothing. Every file that is there gets the compact record of its
    row. Files that no user has edited get the time (if it can be read; without offset it is wall
    clock of ``zone``), the taxon (the archive's outranks the prediction), the predicted taxon and
    confidence, in archives with identities the identity by name within the workgroup, and their
    observations are replaced by those of the detections, if there are any. Names create rows only
    where they are used. New ids go on after the greatest, in the order of keys.
    """
    missing = {c: F.lit(None).cast(kind) for c, kind in INCOMING.items() if kind and c not in incoming.columns}
    detected = "detections" in incoming.columns
    rows = incoming.filter("path is not null").withColumns(missing)
    record = A.compact_json(incoming, [c for c in incoming.columns if c != "position"])
    rows = _last_rows(rows.withColumn("record", record), local_to_utc(F.col("datetime"), zone))
    settings = archives.select(
        F.col("id").alias("archive_id"), "owner_id", "owner_workgroup_id", F.coalesce("contains_single_taxon", F.lit(False)).alias("single"),
        F.coalesce("contains_identities", F.lit(False)).alias("extract"), "taxon_for_identification_id", F.col("locality").alias("_locality"),
    )
    rows = attach(rows, settings, ["archive_id"], F.col("path"), how="inner")
    have = before.media.select("archive_id", "path", F.col("id").alias("known_id"), F.col("updated_by").isNotNull().alias("edited"))
    rows = rows.join(have.hint("merge"), ["archive_id", "path"], "left")
    found = F.col("known_id").isNotNull()
    live = found | F.lit(create_missing)
    update = live & ~F.coalesce("edited", F.lit(False))
    base = F.when(found, "found").otherwise("created" if create_missing else "deleted")
    fixed = F.when(F.col("single"), F.col("taxon_for_identification_id"))
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = pin(
        rows.withColumns({
            "status": F.when(update, F.concat(base, F.lit(" and not updated by user"))).otherwise(base),
            "update": update, "create": live & ~found, "fixed": fixed,
            "category": F.when(update & fixed.isNull(), given("predicted_category")),
            "raw": F.when(update, given("predicted_category_raw")),
            "identity": F.when(update & F.col("extract"), given("unique_name")),
            "place": F.when(live & ~found, given("_locality")),
        })
    )
    names = rows.select(F.col("category").alias("name")).union(rows.select("raw"))
    taxa = get_or_create(before.taxa, names, ["name"])
    identities = get_or_create(before.identities, rows.select(F.col("identity").alias("name"), "owner_workgroup_id"), ["name", "owner_workgroup_id"])
    localities = get_or_create(before.localities, rows.select(F.col("place").alias("name"), "owner_id"), ["name", "owner_id"])
    spread = F.col("path")
    known = ids_of(rows, taxa, {"name": "category"}, "category_id", spread)
    known = ids_of(known, taxa, {"name": "raw"}, "raw_id", spread)
    known = ids_of(known, identities, {"name": "identity", "owner_workgroup_id": "owner_workgroup_id"}, "found_identity", spread)
    known = ids_of(known, localities, {"name": "place", "owner_id": "owner_id"}, "place_id", spread)
    fresh = row_number_over_all(rows.filter("create").select("archive_id", "path"), [F.col("archive_id"), F.col("path")], "_new")
    fresh = fresh.select("archive_id", "path", (greatest_id(before.media) + F.col("_new")).alias("new_id"))
    codes = A.orientation_code
    seen = F.array_compact(F.transform("detections", lambda d: codes(d["orientation"], d["orientation_score"], threshold, left_as_front=True))) if detected else None
    final = pin(
        known.join(fresh.hint("merge"), ["archive_id", "path"], "left").withColumns({
            "media_id": F.coalesce("known_id", "new_id"), "taxon": F.coalesce("fixed", "category_id"),
            "facing": F.try_element_at(seen, F.lit(-1)) if detected else F.lit(None).cast("string"),
        })
    )
    return Archive(_media_after(before.media, final), _observations_after(before.observations, final, observations, threshold, detected), taxa, identities, localities), final.select("archive_id", "path", "status")


def _media_after(media: DataFrame, final: DataFrame) -> DataFrame:
    values = {
        "captured_at": F.col("captured"), "taxon_id": F.col("taxon"), "predicted_taxon_id": F.col("raw_id"),
        "predicted_taxon_confidence": F.when(F.col("raw").isNotNull(), F.col("predicted_prob_raw").cast("double")), "identity_id": F.col("found_identity"), "orientation": F.col("facing"),
    }
    brought = final.filter("media_id is not null").select("media_id", "update", "record", *[v.alias(f"_u_{c}") for c, v in values.items()])
    changed = {c: F.when(F.col("update"), F.coalesce(f"_u_{c}", c)).otherwise(F.col(c)) for c in values}
    changed["metadata_json"] = F.coalesce("record", "metadata_json")
    old = media.join(brought.hint("merge"), media["id"] == F.col("media_id"), "left").withColumns(changed).select(*media.columns)
    created = final.filter("create").select(
        F.col("media_id").alias("id"), "archive_id", "path", F.col("original_path").alias("original_filename"), "media_type", F.col("place_id").alias("locality_id"),
        F.when(F.col("single") & F.col("extract"), True).otherwise(False).alias("identity_is_representative"), F.col("record").alias("metadata_json"), *[v.alias(c) for c, v in values.items()],
    )
    return old.unionByName(created, allowMissingColumns=True).select(*media.columns)


def _observations_after(before: DataFrame, final: DataFrame, mode: str, threshold: float, detected: bool) -> DataFrame:
    if not detected:
        return before
    rows = final.filter(F.col("update") & (F.size("detections") > 0))
    made = detection_observations(
        rows.select(
            F.col("media_id").alias("mediafile_id"), "detections", F.col("found_identity").alias("identity_id"), F.col("taxon").alias("taxon_id"),
            F.col("raw_id").alias("predicted_taxon_id"), F.when(F.col("raw").isNotNull(), F.col("predicted_prob_raw").cast("double")).alias("predicted_taxon_confidence"),
        ),
        mode, threshold,
    )
    replaced = rows.select(F.col("media_id").alias("mediafile_id"))
    return before.join(replaced.hint("merge"), "mediafile_id", "left_anti").unionByName(made, allowMissingColumns=True).select(*before.columns)


def update_from_sheet(before: Archive, sheet: DataFrame, position: str, owner_workgroup_id: Column, owner_id: Column) -> Archive:
    """All tables after a curated spreadsheet of one archive was applied, field by field where a value is given.

    ``before.media`` are the archive's files, matched by cleaned ``original_filename``; ``sheet`` has
    ``original_path`` and any of ``SHEET_FIELDS`` under their usual names. Rows of one file count as
    applied one after another, rows of unknown files change nothing. The taxon is found or created
    by name; the identity by code within the workgroup, else by name; a name beside a code renames
    the code's identity, and a coat type is the identity's. The locality is found or created by
    name for the owner, and takes the rounded coordinates of its last row.
    """
    named = normalised_sheet(sheet).select("original_path", position, *SHEET_FIELDS)
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    final = last_given(named.withColumns({c: text(c) for c in SHEET_FIELDS}), ["original_path"], position)
    order = named.groupBy("original_path").agg(F.max(position).alias("_last"))
    final = final.join(order.hint("merge"), "original_path")
    files = before.media.select(F.col("id").alias("_id"), F.col("original_filename").alias("original_path"))
    matched = pin(final.join(files.hint("merge"), "original_path").withColumns({"workgroup": owner_workgroup_id, "owner": owner_id, "by_name": F.when(F.col("code").isNull(), F.col("unique_name"))}))
    taxa = get_or_create(before.taxa, matched.select(F.col("predicted_category").alias("name")), ["name"])
    by_code = get_or_create(before.identities, matched.select("code", F.col("workgroup").alias("owner_workgroup_id")), ["code", "owner_workgroup_id"])
    identities = get_or_create(pin(by_code), matched.select(F.col("by_name").alias("name"), F.col("workgroup").alias("owner_workgroup_id")), ["name", "owner_workgroup_id"])
    localities = get_or_create(before.localities, matched.select(F.col("locality_name").alias("name"), F.col("owner").alias("owner_id")), ["name", "owner_id"])
    spread = F.col("_id")
    known = ids_of(matched, taxa, {"name": "predicted_category"}, "new_taxon", spread)
    known = ids_of(known, identities, {"code": "code", "owner_workgroup_id": "workgroup"}, "coded", spread)
    known = ids_of(known, identities, {"name": "by_name", "owner_workgroup_id": "workgroup"}, "called", spread)
    known = ids_of(known, localities, {"name": "locality_name", "owner_id": "owner"}, "new_locality", spread)
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    known = pin(known.withColumns({"new_identity": F.coalesce("coded", "called"), "new_location": F.when(lat.isNotNull() & lon.isNotNull(), G.rounded_location(lat, lon))}))
    values = {
        "taxon_id": F.col("new_taxon"), "identity_id": F.col("new_identity"), "locality_id": F.col("new_locality"),
        "captured_at": F.try_to_timestamp("datetime"), "orientation": F.upper(F.substring("orientation", 1, 1)),
    }
    update = known.select("_id", *[v.alias(f"_u_{c}") for c, v in values.items()])
    media = before.media.join(update.hint("merge"), F.col("id") == F.col("_id"), "left").withColumns({c: F.coalesce(f"_u_{c}", c) for c in values}).select(*before.media.columns)
    return Archive(
        media, before.observations, taxa,
        _described(identities, known, "new_identity", {"name": F.when(F.col("coded").isNotNull(), F.col("unique_name")), "coat_type": F.col("coat_type")}),
        _described(localities, known, "new_locality", {"location": F.col("new_location")}),
    )


def _described(dimension: DataFrame, rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """The dimension with the last values that rows give to its entries, combined map-side."""
    given = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("_d"), F.struct("_last", "_id").alias("_at"), *[v.alias(f"_u_{c}") for c, v in values.items()])
    last = given.groupBy("_d").agg(*[F.max_by(f"_u_{c}", F.when(F.col(f"_u_{c}").isNotNull(), F.col("_at"))).alias(f"_u_{c}") for c in values])
    joined = dimension.join(last.hint("merge"), F.col("id") == F.col("_d"), "left")
    return joined.withColumns({c: F.coalesce(f"_u_{c}", c) for c in values}).select(*dimension.columns)
