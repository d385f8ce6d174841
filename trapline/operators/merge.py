"""Overlays, imports and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.functions import dictionaries as D
from trapline.functions import geometry as G
from trapline.functions import text as X
from trapline.operators.ordered import row_number_over_all
from trapline.operators.skew import attach
from trapline.session import pin


def overlay(base: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """Left join by ``key``: a given value of the update wins, its new columns are appended.

    A key that occurs several times in the update repeats the row of the base.
    """
    renamed = update.select(*[F.col(c).alias(f"_u_{c}") for c in update.columns])
    joined = base.join(renamed, F.col(key) == F.col(f"_u_{key}"), "left")
    columns = [
        F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in update.columns and c != key else F.col(c) for c in base.columns
    ]
    added = [F.col(f"_u_{c}").alias(c) for c in update.columns if c not in base.columns]
    return joined.select(*columns, *added)


def species_frame(spark: SparkSession) -> DataFrame:
    """The species table; a fixed number of rows, so it may be broadcast."""
    return spark.createDataFrame(D.species_rows(), list(D.SPECIES_FIELDS))


def translate_species(rows: DataFrame, label: str) -> DataFrame:
    """Add the species of a corrected label; labels outside the table become the unknown label."""
    table = F.broadcast(species_frame(rows.sparkSession))
    joined = rows.join(table, F.col(label) == F.col("czech_label"), "left")
    return joined.withColumn("czech_label", F.coalesce("czech_label", F.lit(D.UNKNOWN_LABEL)))


def dictionary_report(table: DataFrame, key: str) -> DataFrame:
    """Number of labels, of keys that collide after normalising, and of values with stray blanks."""
    dirty = F.lit(False)
    for c in table.columns:
        dirty = dirty | (F.col(c) != F.trim(c))
    normal = F.lower(X.strip_accents(F.trim(key)))
    return table.agg(
        F.count(F.lit(1)).alias("labels"),
        (F.count(F.lit(1)) - F.count_distinct(normal)).alias("duplicate_keys"),
        F.count_if(dirty | (F.col(key) != normal)).alias("dirty_rows"),
    )


def media_of_paths(predictions: DataFrame, path: str, files: DataFrame, file: str, root: str) -> DataFrame:
    """Join predicted absolute paths to files by their path below ``root``; misses are dropped."""
    relative = F.regexp_replace(X.swap_variant(F.col(path)), f"^{root}", "")
    return predictions.withColumn("_relative", relative).join(files, F.col("_relative") == F.col(file)).drop("_relative")


# ---- merge maps -----------------------------------------------------------------------------


def resolve_merges(merges: DataFrame, source: str = "from_id", target: str = "to_id", position: str = "position") -> DataFrame:
    """Final target of every source of a batch of merges.

    A source merged twice goes with its first merge; merges into itself are dropped. Chains are
    followed by pointer doubling (a chain of n steps takes log2(n) rounds, each written to the
    checkpoint folder); what still points at a source after that is part of a cycle and dropped.
    """
    ordered = F.struct(F.col(position), F.col(target))
    current = pin(
        merges.filter(F.col(source) != F.col(target))
        .groupBy(source)
        .agg(F.min_by(target, ordered).alias(target), F.min(position).alias(position))
    )
    rounds = max(current.count(), 1).bit_length()
    for _ in range(rounds):
        onward = current.select(F.col(source).alias(target), F.col(target).alias("_next"))
        jumped = attach(current, onward, [target], F.col(source))
        hops = jumped.filter("_next is not null")
        if hops.isEmpty():
            return current
        current = pin(jumped.withColumn(target, F.coalesce("_next", target)).drop("_next"))
    sources = current.select(F.col(source).alias("_source"))
    return current.join(sources, F.col(target) == F.col("_source"), "left_anti")


def repoint(facts: DataFrame, resolved: DataFrame, column: str, key: str) -> DataFrame:
    """Facts of a merged-away row now refer to its target."""
    moves = resolved.select(F.col("from_id").alias(column), F.col("to_id").alias("_to"))
    # rows that refer to nothing, often a third of all, needn't be joined
    pointing = attach(facts.filter(F.col(column).isNotNull()), moves, [column], F.col(key))
    return pointing.withColumn(column, F.coalesce("_to", column)).select(*facts.columns).union(facts.filter(F.col(column).isNull()))


def _states(target_rows: DataFrame, source_rows: DataFrame, fields: dict[str, str | None]) -> DataFrame:
    """Per target and field the first value that is not unknown, and the position it came from.

    ``fields`` maps a field to its "unknown" value (None for null). The target's own value has
    position null, read as before every source.
    """
    everything = target_rows.withColumn("_position", F.lit(-1).cast("long")).unionByName(source_rows, allowMissingColumns=True)
    aggregates = []
    for field, unknown in fields.items():
        known = F.col(field).isNotNull() if unknown is None else (F.col(field) != unknown)
        at = F.when(known, F.col("_position"))
        aggregates += [F.min_by(field, at).alias(f"_value_{field}"), F.min(at).alias(f"_at_{field}")]
    return everything.groupBy("_target").agg(*aggregates)


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


IDENTITY_FIELDS: dict[str, str | None] = {"sex": "U", "coat_type": "U", "birth_date": None, "death_date": None}
KEPT_FIELDS = ("code", "juv_code")


def merge_identities(identities: DataFrame, resolved: DataFrame, merged_on: str) -> DataFrame:
    """Apply resolved merges to the identities.

    Per target: unknown sex, coat type and dates are filled by the first source that has them;
    codes stay; every source adds its note and a line saying what differed when it was merged.
    Merged-away identities are gone.
    """
    fields = {f: u for f, u in IDENTITY_FIELDS.items() if f in identities.columns}
    compared = [f for f in (*IDENTITY_FIELDS, *KEPT_FIELDS) if f in identities.columns]
    sources = identities.join(resolved, F.col("id") == F.col("from_id")).withColumnsRenamed({"to_id": "_target", "position": "_position"})
    sources = sources.drop("from_id")
    touched = resolved.select(F.col("to_id").alias("_t")).distinct()
    targets = identities.join(touched, F.col("id") == F.col("_t"), "left_semi").withColumn("_target", F.col("id"))
    states = _states(targets, sources, fields)
    kept = targets.select("_target", F.col("name").alias("_target_name"), *[F.col(f).alias(f"_kept_{f}") for f in KEPT_FIELDS if f in compared])
    known = states.join(kept, "_target")
    rows = attach(sources, known, ["_target"], F.col("id"))
    pieces = []
    for f in compared:
        if f in fields:
            unknown = F.lit(fields[f])
            before = F.when(F.col(f"_at_{f}") < F.col("_position"), F.col(f"_value_{f}")).otherwise(unknown)
        else:
            before = F.col(f"_kept_{f}")
        line = F.concat(F.lit(f"{f}: "), _shown(before), F.lit(" , "), _shown(F.col(f)))
        pieces.append(F.when(~before.eqNullSafe(F.col(f)), line))
    differences = F.array_join(F.array_compact(F.array(*pieces)), "\n  ")
    text = F.concat(
        F.lit("\n"), F.col("note"), F.lit("\nmerged: "), F.col("_target_name"), F.lit(" + "), F.col("name"), F.lit(f", {merged_on}\n"), differences
    )
    texts = rows.groupBy("_target").agg(F.sort_array(F.collect_list(F.struct(F.col("_position"), text.alias("text")))).alias("_texts"))
    added = texts.select("_target", F.array_join(F.transform("_texts", lambda x: x["text"]), "").alias("_added"))
    left = identities.join(resolved, F.col("id") == F.col("from_id"), "left_anti")
    merged = left.join(states, F.col("id") == F.col("_target"), "left").drop("_target")
    merged = merged.join(added, F.col("id") == F.col("_target"), "left").drop("_target")
    filled = {f: F.coalesce(F.col(f"_value_{f}"), F.col(f)) for f in fields}
    filled["note"] = F.concat(F.col("note"), F.coalesce("_added", F.lit("")))
    return merged.withColumns(filled).select(*identities.columns)


def merge_localities(localities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Apply resolved merges to the localities: notes are appended, a missing location is taken over.

    A location that the target no longer needs is kept in the note.
    """
    sources = localities.join(resolved, F.col("id") == F.col("from_id")).withColumnsRenamed({"to_id": "_target", "position": "_position"})
    sources = sources.drop("from_id")
    touched = resolved.select(F.col("to_id").alias("_t")).distinct()
    targets = localities.join(touched, F.col("id") == F.col("_t"), "left_semi").withColumn("_target", F.col("id"))
    states = _states(targets, sources, {"location": None})
    rows = attach(sources, states, ["_target"], F.col("id"))
    had_one = F.coalesce(F.col("_at_location") < F.col("_position"), F.lit(False))
    extra = F.when(had_one & F.col("location").isNotNull(), F.concat(F.lit("\n  location: "), F.col("location"))).otherwise("")
    text = F.concat(F.lit("\n\nMerged from "), F.col("name"), F.lit(":\n  "), F.col("note"), extra)
    texts = rows.groupBy("_target").agg(F.sort_array(F.collect_list(F.struct(F.col("_position"), text.alias("text")))).alias("_texts"))
    added = texts.select("_target", F.array_join(F.transform("_texts", lambda x: x["text"]), "").alias("_added"))
    left = localities.join(resolved, F.col("id") == F.col("from_id"), "left_anti")
    merged = left.join(states, F.col("id") == F.col("_target"), "left").drop("_target")
    merged = merged.join(added, F.col("id") == F.col("_target"), "left").drop("_target")
    return merged.withColumns(
        {"location": F.coalesce("_value_location", "location"), "note": F.concat("note", F.coalesce("_added", F.lit("")))}
    ).select(*localities.columns)


# ---- get or create --------------------------------------------------------------------------


def greatest_id(table: DataFrame) -> Column:
    """The greatest id of a table as a scalar subquery; -1 for an empty one."""
    return table.agg(F.coalesce(F.max("id"), F.lit(-1))).scalar()


def get_or_create(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing dimension rows plus one new row per key that is not there yet.

    The first key is the name or the code, further ones the tenant; texts are kept whole. Null and
    empty names create nothing. New ids continue after the greatest one, in key order.
    """
    name = keys[0]
    wanted = incoming.select(*keys).filter(F.col(name).isNotNull() & (F.col(name) != "")).distinct()
    have = existing.select(*[F.col(k).alias(f"_h_{k}") for k in keys]).distinct()
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    fresh = wanted.join(have.hint("merge"), match, "left_anti")  # a dimension grows with the data: the driver never holds it
    numbered = row_number_over_all(fresh, [F.col(k).asc_nulls_first() for k in keys], "_new")
    created = numbered.select((greatest_id(existing) + F.col("_new")).alias("id"), *keys)
    return existing.unionByName(created, allowMissingColumns=True)


# ---- imports --------------------------------------------------------------------------------


def import_metadata(existing: DataFrame, incoming: DataFrame, path: str, create_missing: bool = True, archive_taxon: Column | None = None) -> DataFrame:
    """Bring processed metadata into the media table.

    Files are matched by path; missing ones are created or reported as deleted. Fields a user
    has edited stay. The taxon of a single-taxon archive outranks the prediction. The status
    column says what happened to each incoming row.
    """
    have = existing.select(F.col(path).alias("_path"), *[F.col(c).alias(f"_old_{c}") for c in existing.columns if c != path])
    joined = incoming.join(have, F.col(path) == F.col("_path"), "left")
    found = F.col("_path").isNotNull()
    untouched = F.col("_old_updated_by").isNull()
    base = F.when(found, F.lit("found")).otherwise(F.lit("created" if create_missing else "deleted"))
    live = found | F.lit(create_missing)
    status = F.when(live & untouched, F.concat(base, F.lit(" and not updated by user"))).otherwise(base)
    taxon = F.col("predicted_category")
    if archive_taxon is not None:
        taxon = F.coalesce(archive_taxon, taxon)
    update = live & untouched
    return joined.select(
        path,
        status.alias("status"),
        F.when(update, taxon).otherwise(F.col("_old_taxon")).alias("taxon"),
        F.when(update, F.coalesce("datetime", "_old_captured_at")).otherwise(F.col("_old_captured_at")).alias("captured_at"),
        F.when(update, F.col("predicted_category_raw")).otherwise(F.col("_old_predicted_taxon")).alias("predicted_taxon"),
        F.when(update, F.col("predicted_prob_raw").cast("double")).otherwise(F.col("_old_confidence")).alias("confidence"),
        F.col("_old_updated_by").alias("updated_by"),
    )


def import_counts(imported: DataFrame) -> DataFrame:
    """Rows created, found, deleted and failed."""
    word = F.split(F.col("status"), " ")[0]
    return imported.agg(*[F.count_if(word == w).alias(w) for w in ("created", "found", "deleted", "error")])


SPREADSHEET_ALIASES = {
    "original path": "original_path",
    "category": "taxon",
    "unique name": "unique_name",
    "location_name": "locality_name",
    "locality name": "locality_name",
    "lat": "latitude",
    "lon": "longitude",
}


def read_names(sheet: DataFrame, aliases: dict[str, str]) -> DataFrame:
    return sheet.withColumnsRenamed({k: v for k, v in aliases.items() if k in sheet.columns})


def clean_path(path: Column) -> Column:
    return F.trim(F.replace(path, F.lit("\\"), F.lit("/")))


def last_given(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row per key: of every column the last value given, as if the rows were applied in order."""
    columns = [c for c in rows.columns if c not in (*keys, position)]
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position)))
    return rows.groupBy(*keys).agg(*[latest(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_rows"))


SHEET_FIELDS = ("predicted_category", "code", "unique_name", "locality_name", "latitude", "longitude", "datetime", "coat_type", "orientation")


def normalised_sheet(sheet: DataFrame) -> DataFrame:
    """Spreadsheet with canonical column names, cleaned paths and every known column present."""
    named = read_names(sheet, SPREADSHEET_ALIASES)
    missing = {c: F.lit(None).cast("string") for c in SHEET_FIELDS if c not in named.columns}
    return named.withColumns({**missing, "original_path": clean_path(F.col("original_path"))})


def apply_spreadsheet(media: DataFrame, sheet: DataFrame, position: str) -> DataFrame:
    """Overlay a curated spreadsheet on the media table, field by field where a value is given.

    The identity goes by code, else by name; coordinates are rounded; the orientation is the
    first letter. ``media`` has ``original_path``, ``taxon``, ``identity_code``,
    ``identity_name``, ``locality``, ``location``, ``captured_at``, ``coat_type``, ``orientation``.
    """
    final = last_given(normalised_sheet(sheet).select("original_path", position, *SHEET_FIELDS), ["original_path"], position)
    update = final.select(*[F.col(c).alias(f"_s_{c}") for c in final.columns])
    joined = media.join(update, F.col("original_path") == F.col("_s_original_path"), "left")
    s = lambda c: F.nullif(F.col(f"_s_{c}"), F.lit(""))
    by_code = s("code").isNotNull()
    lat, lon = F.col("_s_latitude").try_cast("double"), F.col("_s_longitude").try_cast("double")
    located = s("locality_name").isNotNull() & lat.isNotNull() & lon.isNotNull()
    return joined.withColumns(
        {
            "taxon": F.coalesce(s("predicted_category"), "taxon"),
            "identity_code": F.coalesce(s("code"), "identity_code"),
            "identity_name": F.when(by_code | s("unique_name").isNotNull(), F.coalesce(F.trim(s("unique_name")), "identity_name")).otherwise(F.col("identity_name")),
            "locality": F.coalesce(s("locality_name"), "locality"),
            "location": F.when(located, G.rounded_location(lat, lon)).otherwise(F.col("location")),
            "captured_at": F.coalesce(F.try_to_timestamp(s("datetime")), "captured_at"),
            "coat_type": F.coalesce(s("coat_type"), "coat_type"),
            "orientation": F.coalesce(F.upper(F.substring(F.trim(s("orientation")), 1, 1)), "orientation"),
        }
    ).select(*media.columns)


def spreadsheet_counts(media: DataFrame, sheet: DataFrame) -> DataFrame:
    """How many rows matched, which fields they gave, and how many name a file that is not there."""
    rows = normalised_sheet(sheet)
    known = media.select(F.col("original_path").alias("_known")).distinct()
    joined = rows.join(known, F.col("original_path") == F.col("_known"), "left")
    found = F.col("_known").isNotNull()
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    identity = given("code") | given("unique_name")
    coordinates = given("locality_name") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    fields = [
        given("predicted_category"), given("code"), given("unique_name"), given("locality_name"), coordinates,
        given("datetime"), given("coat_type"), given("orientation"),
    ]
    count = F.lit(0)
    for f in fields:
        count = count + f.cast("int")
    return joined.agg(
        F.count_if(found).alias("matched"),
        F.sum(F.when(found, count).otherwise(0)).alias("fields_updated"),
        F.count_if(found & identity).alias("identities"),
        F.count_if(found & given("locality_name")).alias("localities"),
        F.count_if(~found).alias("unknown_files"),
        F.count(F.lit(1)).alias("sheet_rows"),
    )


def import_identities(existing: DataFrame, sheet: DataFrame, position: str) -> tuple[DataFrame, DataFrame]:
    """Import identities of one workgroup, keyed by code, else by name.

    Returns the identity table after the import (with a ``status`` column) and the rejected
    sheet rows, whose key fits several existing identities. A key that is repeated in the sheet
    counts as applied row after row.
    """
    rows = sheet.withColumns(
        {
            "_by_code": F.coalesce(F.col("code"), F.lit("")) != "",
            "sex": X.first_letter_code(F.col("sex"), ("M", "F", "U")),
            "coat_type": X.coat_code(F.col("coat_type")),
        }
    ).withColumn("_key", F.when(F.col("_by_code"), F.col("code")).otherwise(F.nullif(F.col("name"), F.lit(""))))
    final = last_given(rows.filter("_key is not null"), ["_by_code", "_key"], position)
    keys = existing.select("id", F.explode(F.array(
        F.struct(F.lit(True).alias("_kc"), F.col("code").alias("_kk")), F.struct(F.lit(False).alias("_kc"), F.col("name").alias("_kk")),
    )).alias("k")).select("id", "k.*").filter("_kk is not null")
    hits = keys.groupBy("_kc", "_kk").agg(F.count(F.lit(1)).alias("_hits"), F.min("id").alias("_hit"))
    matched = final.join(hits, (F.col("_by_code") == F.col("_kc")) & (F.col("_key") == F.col("_kk")), "left").drop("_kc", "_kk")
    rejected = matched.filter("_hits > 1").select("_key", "_hits", "_rows")
    usable = matched.filter("_hits is null or _hits = 1")
    fields = [c for c in ("name", "code", "sex", "coat_type", "note", "juv_code") if c in sheet.columns]
    # an identity hit by code and by name takes the code row, the more specific one
    one = usable.filter("_hits = 1").groupBy("_hit").agg(F.max_by(F.struct(*fields), F.col("_by_code")).alias("_u"))
    update = one.select("_hit", *[F.col(f"_u.{c}").alias(f"_u_{c}") for c in fields])
    old = existing.join(update, F.col("id") == F.col("_hit"), "left")
    given = lambda c: F.nullif(F.col(f"_u_{c}"), F.lit(""))
    kept = old.select(
        *[F.coalesce(given(c), F.col(c)).alias(c) if c in fields else F.col(c) for c in existing.columns],
        F.when(F.col("_hit").isNotNull(), "updated").otherwise("unchanged").alias("status"),
    )
    fresh = row_number_over_all(usable.filter("_hits is null"), [F.col("_by_code").desc(), F.col("_key")], "_new")
    created = fresh.select((greatest_id(existing) + F.col("_new")).alias("id"), *fields, F.lit("created").alias("status"))
    return kept.unionByName(created, allowMissingColumns=True), rejected


LOCALITY_ALIASES = {"Location": "location", "Latitude": "latitude", "Longitude": "longitude", "lat": "latitude", "lon": "longitude", "Lat": "latitude", "Lon": "longitude"}


def import_localities(existing: DataFrame, sheet: DataFrame, position: str, tenant: str | None = None) -> DataFrame:
    """Get or create localities by name within their tenant and set their rounded coordinates.

    Coordinates come from two columns or from one ``"lat,lon"`` text. Without ``tenant``, a column
    of both tables, all localities belong to one.
    """
    keys = ["name", *([tenant] if tenant else [])]
    named = read_names(sheet, LOCALITY_ALIASES)
    if "location" in named.columns:
        lat, lon = G.lat_lon(F.col("location"))
    else:
        lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    placed = named.select(*keys, position, F.when(lat.isNotNull() & lon.isNotNull(), G.rounded_location(lat, lon)).alias("_location"))
    final = last_given(placed.filter("name is not null and name != ''"), keys, position).drop("_rows")
    everyone = get_or_create(existing, final.select(*keys), keys)
    update = final.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.col("name") == F.col("_k_name")
    if tenant:
        same = same & F.col(tenant).eqNullSafe(F.col(f"_k_{tenant}"))
    joined = everyone.join(update, same, "left")
    return joined.withColumn("location", F.coalesce("_location", "location")).select(*existing.columns)


# ---- identification results -----------------------------------------------------------------


def explode_results(results: DataFrame) -> DataFrame:
    """Parallel top-k arrays of every query as one row per suggestion, best first."""
    zipped = F.arrays_zip("class_ids", "labels", "paths", "scores")
    return results.select("media_id", F.posexplode(zipped).alias("rank", "_r")).select(
        "media_id", "rank", F.col("_r.class_ids").alias("identity_id"), F.col("_r.labels").alias("name"),
        F.col("_r.paths").alias("path"), F.col("_r.scores").alias("score"),
    )


def import_results(results: DataFrame, suggestions: DataFrame, threshold: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """Identities assigned outright, and the suggestion table after the import.

    A best score over the threshold assigns its identity. Otherwise the suggestions of that
    media file are replaced. Scores are clipped to 1, so the default threshold assigns nothing.
    """
    sure = F.coalesce(F.col("scores")[0] > F.lit(threshold), F.lit(False))
    assigned = results.filter(sure).select("media_id", F.col("class_ids")[0].alias("identity_id"))
    fresh = explode_results(results.filter(~sure)).withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown")))
    replaced = results.filter(~sure).select("media_id")
    kept = suggestions.join(replaced, "media_id", "left_anti")
    return assigned, kept.unionByName(fresh)


# ---- curation of a selection ----------------------------------------------------------------


def bulk_update(media: DataFrame, selected: DataFrame, values: dict[str, Column], user_id: int, key: str = "id") -> DataFrame:
    """Set columns of the selected media and note who did it; the rest stays as it is."""
    chosen = selected.select(F.col(key).alias("_chosen")).distinct()
    joined = media.join(chosen, F.col(key) == F.col("_chosen"), "left")
    hit = F.col("_chosen").isNotNull()
    updates = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}
    updates["updated_by_id"] = F.when(hit, F.lit(user_id).cast("long")).otherwise(F.col("updated_by_id"))
    return joined.withColumns(updates).drop("_chosen")


def bulk_delete(media: DataFrame, selected: DataFrame, key: str = "id") -> DataFrame:
    chosen = selected.select(F.col(key).alias("_chosen")).distinct()
    return media.join(chosen, F.col(key) == F.col("_chosen"), "left_anti")


def confirm_predictions(observations: DataFrame, selected: DataFrame, spread_by: Column) -> DataFrame:
    """Observations of the selected media take the predicted taxon and count as verified."""
    sizes = observations.groupBy("mediafile_id").agg(F.count(F.lit(1)).alias("_observations"))
    chosen = selected.select(F.col("id").alias("mediafile_id"), F.col("predicted_taxon_id").alias("_predicted"), F.lit(True).alias("_hit"))
    chosen = chosen.join(sizes, "mediafile_id")
    joined = attach(observations, chosen, ["mediafile_id"], spread_by, weight="_observations")
    hit = F.coalesce("_hit", F.lit(False))
    return joined.withColumns(
        {"taxon_id": F.when(hit, F.col("_predicted")).otherwise(F.col("taxon_id")), "taxon_verified": F.when(hit, True).otherwise(F.col("taxon_verified"))}
    ).drop("_predicted", "_hit", "_observations")


def latest_snapshot(snapshots: DataFrame, group: str, order: str, value: str) -> DataFrame:
    return snapshots.groupBy(group).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


# ---- exports --------------------------------------------------------------------------------


def metadata_sync(named_media: DataFrame) -> DataFrame:
    """Metadata record per media file with the curated values over the processed ones."""
    return named_media.select(
        "id",
        F.coalesce("taxon_name", "predicted_category").alias("predicted_category"),
        F.coalesce("identity_name", "unique_name").alias("unique_name"),
        F.col("locality_name").alias("locality name"),
        F.when(F.col("locality_location") != "", F.col("locality_location")).alias("locality coordinates"),
        F.col("original_filename").alias("original_path"),
        F.nullif("identity_code", F.lit("")).alias("code"),
        F.nullif("identity_juv_code", F.lit("")).alias("juv_code"),
        F.col("archive_name").alias("uploaded_archive"),
    )


def metadata_is_complete(media: DataFrame, archive: str, category: str) -> DataFrame:
    """Whether every record of an archive has a predicted category; otherwise its file must be remade."""
    return media.groupBy(archive).agg(F.bool_and(F.col(category).isNotNull()).alias("complete"))


def keep_listed(metadata: DataFrame, media: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Metadata rows whose file is in the media table (with its curated values), and the others."""
    have = media.select(F.col(path).alias("_path"), F.col("taxon").alias("_taxon"))
    joined = metadata.join(have, F.col(path) == F.col("_path"), "left")
    present = joined.filter("_path is not null").withColumn("predicted_category", F.coalesce("_taxon", "predicted_category"))
    return present.drop("_path", "_taxon"), joined.filter("_path is null").drop("_path", "_taxon")


def register_export(named_media: DataFrame, source: str, key: str = "id") -> DataFrame:
    """Rows for the national species register, numbered in key order (no projected coordinates)."""
    day = F.coalesce(F.date_format("captured_at", "yyyyMMdd"), F.lit(""))
    lat, lon = F.split_part("locality_location", F.lit(","), F.lit(1)), F.split_part("locality_location", F.lit(","), F.lit(2))
    # only the keys are put in order and written, not the joined rows
    numbers = row_number_over_all(named_media.select(F.col(key).alias("_key")), [F.col("_key")], "PORADI")
    rows = named_media.join(numbers, F.col(key) == F.col("_key"))
    return rows.select(
        "PORADI", F.col(key).alias("ID_NALEZ"), F.col("taxon_name").alias("DRUH"), F.when(F.col("taxon_name").isNotNull(), "").alias("CESKE_JMENO"),
        F.col("owner_name").alias("AUTOR"), day.alias("DATUM_OD"), day.alias("DATUM_DO"), F.col("locality_name").alias("NAZ_LOKAL"),
        F.col("locality_id").alias("ID_LOKAL"), lat.alias("latitude"), lon.alias("longitude"), F.lit(source).alias("ZDROJ"),
        F.lit(0).alias("NEGATIV"), F.lit("").alias("POCET"), F.lit("").alias("POCITANO"),
    )
