"""Queries that change tables: imports, merges, bulk edits, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.functions import dictionaries as D
from trapline.functions import geometry as G
from trapline.operators import access, media, merge, rollups, sequences, status
from trapline.operators.skew import keys_of
from trapline.plans.registry import query
from trapline.plans.relational import flags, named, owned

# ---- set operations -------------------------------------------------------------------------


@query(
    "set2_union_of_failures",
    """select media_id, read_error, cast(null as varchar) as location, 'files' as kind from uploads where read_error <> ''
       union all select media_id, null, location, 'shots' from shots where captured_at is null""",
)
def _(t):
    files = t.uploads.filter("read_error != ''").select("media_id", "read_error", F.lit("files").alias("kind"))
    shots = t.shots.filter("captured_at is null").select("media_id", "location", F.lit("shots").alias("kind"))
    return files.unionByName(shots, allowMissingColumns=True)


@query("set3_distinct_dates", "select distinct cast(captured_at as date) as day, location from shots")
def _(t):
    return t.shots.select(F.to_date("captured_at").alias("day"), "location").distinct()


@query("set4_set_difference", "select id from media where id not in (select mediafile_id from album_media)")
def _(t):
    return t.media.join(keys_of(t.album_media, "mediafile_id"), F.col("id") == F.col("mediafile_id"), "left_anti").select("id")


@query(
    "set5_get_or_create_taxa",
    """with n as (select distinct p_type as name from part where p_type not in (select name from taxa))
       select id, name from taxa union all select (select max(id) from taxa) + row_number() over (order by name), name from n""",
)
def _(t):
    return merge.get_or_create(t.taxa, t.raw("part").select(F.col("p_type").alias("name")), ["name"])


@query(
    "set5_get_or_create_identities",
    """with n as (select distinct p_brand as name, p_size % 5 as owner_workgroup_id from part)
       select id, name, owner_workgroup_id from identities
       union all select (select max(id) from identities) + row_number() over (order by name, owner_workgroup_id), name, owner_workgroup_id from n""",
)
def _(t):
    incoming = t.raw("part").select(F.col("p_brand").alias("name"), (F.col("p_size") % 5).cast("long").alias("owner_workgroup_id"))
    return merge.get_or_create(t.identities.select("id", "name", "owner_workgroup_id"), incoming, ["name", "owner_workgroup_id"])


# ---- merges ---------------------------------------------------------------------------------

MERGED_ON = "2024-06-01"


def identity_chain(t):
    """Identities are merged step by step into the first one of their block of eight (into itself: no merge)."""
    return t.identities.select(F.col("id").alias("from_id"), (F.col("id") - F.least(F.col("id") % 8, F.lit(1))).alias("to_id"), F.col("id").alias("position"))


IDENTITY_MERGE = f"""
    with w as (select *, min(id) over (partition by id // 8) as target, first_value(name) over (partition by id // 8 order by id) as target_name,
        first_value(code) over (partition by id // 8 order by id) as target_code, first_value(juv_code) over (partition by id // 8 order by id) as target_juv,
        coalesce(first_value(case when sex <> 'U' then sex end ignore nulls) over (partition by id // 8 order by id rows between unbounded preceding and 1 preceding), 'U') as sex_before,
        coalesce(first_value(case when coat_type <> 'U' then coat_type end ignore nulls) over (partition by id // 8 order by id rows between unbounded preceding and 1 preceding), 'U') as coat_before,
        first_value(birth_date ignore nulls) over (partition by id // 8 order by id rows between unbounded preceding and 1 preceding) as birth_before
      from identities),
    d as (select *, concat(chr(10), note, chr(10), 'merged: ', target_name, ' + ', name, ', {MERGED_ON}', chr(10),
        concat_ws(concat(chr(10), '  '), case when sex <> sex_before then concat('sex: ', sex_before, ' , ', sex) end,
          case when coat_type <> coat_before then concat('coat_type: ', coat_before, ' , ', coat_type) end,
          case when birth_date is distinct from birth_before then concat('birth_date: ', coalesce(cast(birth_before as varchar), 'None'), ' , ', coalesce(cast(birth_date as varchar), 'None')) end,
          case when code is distinct from target_code then concat('code: ', coalesce(target_code, 'None'), ' , ', coalesce(code, 'None')) end,
          case when juv_code is distinct from target_juv then concat('juv_code: ', coalesce(target_juv, 'None'), ' , ', coalesce(juv_code, 'None')) end)) as added from w)"""


@query(
    "set6_identity_merge",
    f"""{IDENTITY_MERGE} select target as id, min(target_name) as name, coalesce(first(sex order by id) filter (sex <> 'U'), 'U') as sex,
          coalesce(first(coat_type order by id) filter (coat_type <> 'U'), 'U') as coat_type, first(birth_date order by id) filter (birth_date is not null) as birth_date,
          min(target_code) as code, concat(first(note order by id), string_agg(case when id <> target then added end, '' order by id)) as note
        from d group by target""",
)
def _(t):
    columns = ["id", "name", "sex", "coat_type", "birth_date", "code", "juv_code", "note"]
    merged = merge.merge_identities(t.identities.select(*columns), merge.resolve_merges(identity_chain(t)), MERGED_ON)
    return merged.drop("juv_code")


@query(
    "set6_repointed_media",
    """with f as (select id, min(id) over (partition by id // 8) as target from identities)
       select m.id, coalesce(f.target, m.identity_id) as identity_id from media m left join f on f.id = m.identity_id""",
)
def _(t):
    return merge.repoint(t.media.select("id", "identity_id"), merge.resolve_merges(identity_chain(t)), "identity_id", "id")


LOCALITY_MERGE = """
    with w as (select *, min(id) over (partition by owner_id) as target,
        first_value(location ignore nulls) over (partition by owner_id order by id rows between unbounded preceding and 1 preceding) as location_before from localities),
    d as (select *, concat(chr(10), chr(10), 'Merged from ', name, ':', chr(10), '  ', note,
        case when location_before is not null and location is not null then concat(chr(10), '  location: ', location) else '' end) as added from w)"""


@query(
    "set7_locality_merge",
    f"""{LOCALITY_MERGE} select target as id, first(name order by id) as name, first(location order by id) filter (location is not null) as location,
          concat(first(note order by id), coalesce(string_agg(case when id <> target then added end, '' order by id), '')) as note from d group by target""",
)
def _(t):
    firsts = t.localities.groupBy("owner_id").agg(F.min("id").alias("to_id"))
    merges = t.localities.join(firsts, "owner_id").select(F.col("id").alias("from_id"), "to_id", F.col("id").alias("position"))
    return merge.merge_localities(t.localities.select("id", "name", "location", "note"), merge.resolve_merges(merges))


# ---- imports --------------------------------------------------------------------------------


def known_media(t):
    """Media of the archive before the import: the German files are new, one source was edited."""
    edited = F.when(F.col("source") == "src3", F.lit(7).cast("long"))
    return t.uploads.filter("lang != 'de'").select(
        "original_path", edited.alias("updated_by"), F.lit("old taxon").alias("taxon"),
        F.expr("timestamp'2020-01-01'").alias("captured_at"), F.lit("old prediction").alias("predicted_taxon"), F.lit(0.5).alias("confidence"),
    )


def processed(t):
    """Metadata rows as the processing writes them."""
    return t.uploads.select(
        "original_path", F.when(F.col("read_error") == "", F.expr("timestamp'2024-01-01' + make_dt_interval(int(media_id % 100))")).alias("datetime"),
        F.concat(F.lit("taxon "), F.col("media_id") % 7).alias("predicted_category"),
        F.concat(F.lit("raw "), F.col("media_id") % 5).alias("predicted_category_raw"), (F.col("n_chars") / 20001).alias("predicted_prob_raw"),
    )


IMPORTED = """
    with i as (select original_path, lang <> 'de' as known, lang <> 'de' and source = 'src3' as edited, media_id, n_chars, read_error from uploads)"""


@query(
    "set8_metadata_import",
    f"""{IMPORTED} select original_path, concat(case when known then 'found' else 'created' end, case when edited then '' else ' and not updated by user' end) as status,
      case when edited then 'old taxon' else concat('taxon ', cast(media_id % 7 as varchar)) end as taxon,
      epoch_us(case when edited then timestamp '2020-01-01' when read_error = '' then timestamp '2024-01-01' + to_days(cast(media_id % 100 as int)) when known then timestamp '2020-01-01' end) as captured_us,
      case when edited then 'old prediction' else concat('raw ', cast(media_id % 5 as varchar)) end as predicted_taxon,
      case when edited then 0.5e0 else n_chars / 20001 end as confidence from i""",
)
def _(t):
    rows = merge.import_metadata(known_media(t), processed(t), "original_path")
    return rows.select("original_path", "status", "taxon", F.unix_micros("captured_at").alias("captured_us"), "predicted_taxon", "confidence")


@query(
    "agg18_import_counts",
    "select cast(0 as bigint) as created, count(*) filter (lang <> 'de') as found, count(*) filter (lang = 'de') as deleted, cast(0 as bigint) as error from uploads",
)
def _(t):
    return merge.import_counts(merge.import_metadata(known_media(t), processed(t), "original_path", create_missing=False))


def media_records(t):
    rows = media.lookup(named(t), t.archives, "parent_id", "archive", ["name", "owner_id"])
    return rows.withColumns({"predicted_category": F.when(F.col("taxon_verified").isNotNull(), F.lit("processed")), "unique_name": F.lit(None).cast("string")})


@query(
    "set9_metadata_sync",
    """select m.id, coalesce(x.name, case when m.taxon_verified is not null then 'processed' end) as predicted_category, i.name as unique_name, l.name as "locality name",
         l.location as "locality coordinates", m.original_filename as original_path, i.code, i.juv_code, a.name as uploaded_archive
       from media m left join taxa x on x.id = m.taxon_id left join identities i on i.id = m.identity_id left join localities l on l.id = m.locality_id left join archives a on a.id = m.parent_id""",
)
def _(t):
    return merge.metadata_sync(media_records(t))


@query("set9_consistency_gate", "select parent_id, bool_and(taxon_verified is not null) as complete from media group by 1")
def _(t):
    return merge.metadata_is_complete(media_records(t), "parent_id", "predicted_category")


@query(
    "set10_sync_listed_files",
    """select original_path, case when lang <> 'de' then 'old taxon' else concat('taxon ', cast(media_id % 7 as varchar)) end as predicted_category, lang = 'de' as deleted from uploads""",
)
def _(t):
    kept, gone = merge.keep_listed(processed(t), known_media(t), "original_path")
    pick = lambda df, flag: df.select("original_path", "predicted_category", F.lit(flag).alias("deleted"))
    return pick(kept, False).unionByName(pick(gone, True))


@query(
    "set11_register_export",
    """select row_number() over (order by m.id) as "PORADI", m.id as "ID_NALEZ", x.name as "DRUH", case when x.name is not null then '' end as "CESKE_JMENO", u.username as "AUTOR",
         strftime(m.captured_at, '%Y%m%d') as "DATUM_OD", strftime(m.captured_at, '%Y%m%d') as "DATUM_DO", l.name as "NAZ_LOKAL", m.locality_id as "ID_LOKAL",
         split_part(l.location, ',', 1) as latitude, split_part(l.location, ',', 2) as longitude, 'trapline' as "ZDROJ", 0 as "NEGATIV", '' as "POCET", '' as "POCITANO"
       from media m left join taxa x on x.id = m.taxon_id left join localities l on l.id = m.locality_id left join archives a on a.id = m.parent_id left join users u on u.id = a.owner_id""",
)
def _(t):
    rows = media.lookup(media_records(t), t.users, "archive_owner_id", "owner", ["username"]).withColumnRenamed("owner_username", "owner_name")
    rows = rows.select("id", "captured_at", "taxon_name", "locality_name", "locality_location", "locality_id", "owner_name")
    return merge.register_export(rows, "trapline")


def sheet(t):
    """A curated spreadsheet: one row per file, and a second one for French files; German files are unknown."""
    one = t.uploads.select(
        F.replace(F.col("original_path"), F.lit("/"), F.lit("\\")).alias("original path"), F.col("media_id").alias("row"),
        F.when(F.col("read_error") == "", F.concat(F.lit("T"), F.col("media_id") % 7)).alias("predicted_category"),
        F.when(F.col("source") == "src1", F.concat(F.lit("B"), F.col("media_id"))).alias("code"),
        F.when(F.col("source").isin("src1", "src2"), F.concat(F.lit("name"), F.col("media_id"))).alias("unique_name"),
        F.col("lang").alias("locality name"), F.lit("48.12345").alias("lat"), F.lit("13.98765").alias("lon"),
        F.when(F.col("source") == "src4", F.lit("2023-05-06 07:08:09")).alias("datetime"), F.lit(" left").alias("orientation"),
    )
    again = one.filter("`locality name` = 'fr'").select(
        F.concat(F.lit(" "), F.col("original path")).alias("original path"), (F.col("row") + 1000000000).alias("row"), F.lit("T9").alias("predicted_category"),
        *[F.lit(None).cast("string").alias(c) for c in ("code", "unique_name", "locality name", "lat", "lon", "datetime")], F.lit("Right").alias("orientation"),
    )
    return one.unionByName(again)


def sheet_media(t):
    return known_media(t).select(
        "original_path", "taxon", F.lit("B0").alias("identity_code"), F.lit("nobody").alias("identity_name"), F.lit("somewhere").alias("locality"),
        F.lit(None).cast("string").alias("location"), "captured_at", F.lit("U").alias("coat_type"), F.lit("U").alias("orientation"),
    )


@query(
    "set12_spreadsheet_update",
    """select original_path, case when lang = 'fr' then 'T9' when read_error = '' then concat('T', cast(media_id % 7 as varchar)) else 'old taxon' end as taxon,
         case when source = 'src1' then concat('B', cast(media_id as varchar)) else 'B0' end as identity_code,
         case when source in ('src1', 'src2') then concat('name', cast(media_id as varchar)) else 'nobody' end as identity_name,
         lang as locality, '48.123,13.988' as location, epoch_us(case when source = 'src4' then timestamp '2023-05-06 07:08:09' else timestamp '2020-01-01' end) as captured_us,
         'U' as coat_type, case when lang = 'fr' then 'R' else 'L' end as orientation from uploads where lang <> 'de'""",
)
def _(t):
    updated = merge.apply_spreadsheet(sheet_media(t), sheet(t), "row")
    return updated.withColumn("captured_us", F.unix_micros("captured_at")).drop("captured_at")


@query(
    "agg19_spreadsheet_counts",
    """with k as (select *, lang <> 'de' as known from uploads)
       select count(*) filter (known) + count(*) filter (lang = 'fr') as matched,
         cast(sum(case when known then (read_error = '')::int + (source = 'src1')::int + (source in ('src1', 'src2'))::int + 1 + 1 + (source = 'src4')::int + 1 else 0 end) + 2 * count(*) filter (lang = 'fr') as bigint) as fields_updated,
         count(*) filter (known and source in ('src1', 'src2')) as identities, count(*) filter (known) as localities, count(*) filter (not known) as unknown_files,
         count(*) + count(*) filter (lang = 'fr') as sheet_rows from k""",
)
def _(t):
    return merge.spreadsheet_counts(sheet_media(t), sheet(t))


def identity_sheet(t):
    """One row per customer: by code where there is one, the rest by a brand name that may be new."""
    c = F.col
    return t.identities.select(
        c("id").alias("row"), F.when(c("sex") == "M", c("code")).alias("code"),
        F.when(c("sex") == "M", F.concat(F.lit("renamed "), c("id"))).when(c("sex") == "F", c("coat_text")).otherwise("").alias("name"),
        F.when(c("coat_type") == "S", "male").otherwise("x").alias("sex"), F.lit("Marbled").alias("coat_type"), F.lit("imported").alias("note"),
    )


@query(
    "set13_import_identities",
    """with s as (select id, name as old_name, sex as old_sex, coat_type as old_coat, code, note, sex = 'M' and code is not null as hit from identities),
       n as (select distinct coat_text as name from identities where sex = 'F'
             union select concat('renamed ', cast(id as varchar)) from identities where sex = 'M' and code is null)
       select id, case when hit then concat('renamed ', cast(id as varchar)) else old_name end as name, code, case when hit and old_coat = 'S' then 'M' else old_sex end as sex,
         case when hit then 'M' else old_coat end as coat_type, case when hit then 'imported' else note end as note, case when hit then 'updated' else 'unchanged' end as status from s
       union all select (select max(id) from identities) + row_number() over (order by name), name, null,
         case when exists (select 1 from identities i where i.coat_type = 'S' and ((i.sex = 'F' and i.coat_text = n.name) or concat('renamed ', cast(i.id as varchar)) = n.name)) then 'M' end, 'M', 'imported', 'created' from n""",
)
def _(t):
    existing = t.identities.select("id", "name", "code", "sex", "coat_type", "note")
    merged, _rejected = merge.import_identities(existing, identity_sheet(t), "row")
    return merged


@query(
    "set13_rejected_identities",
    """select owner_workgroup_id, count(*) as hits from identities group by 1 having count(*) > 1""",
)
def _(t):
    """Identities that share a name: the sheet row for that name is ambiguous."""
    existing = t.identities.select("id", F.col("owner_workgroup_id").cast("string").alias("name"), F.lit(None).cast("string").alias("code"), "sex", "coat_type", "note")
    rows = t.workgroups.select(
        F.col("id").alias("row"), F.lit(None).cast("string").alias("code"), F.col("id").cast("string").alias("name"), F.lit("F").alias("sex"), F.lit("N").alias("coat_type"), F.lit("").alias("note")
    )
    _merged, rejected = merge.import_identities(existing, rows, "row")
    return rejected.select(F.col("_key").cast("long").alias("owner_workgroup_id"), F.col("_hits").alias("hits"))


@query(
    "set14_import_localities",
    """with l as (select id, concat('place ', cast(id // 2 as varchar)) as name, id % 2 as tenant, location from localities),
       p as (select concat('place ', cast(n_nationkey as varchar)) as name, 0 as tenant, n_nationkey as k from nation
         union all select n_name, n_regionkey % 3, n_nationkey from nation),
       q as (select *, concat(cast(round_even(48.00049e0 + k, 3) as varchar), ',', cast(round_even(13.12345e0 + k, 3) as varchar)) as place from p)
       select l.id, l.name, l.tenant, coalesce(q.place, l.location) as location from l left join q using (name, tenant) union all
       select (select max(id) from l) + row_number() over (order by name, tenant), name, tenant, place from q anti join l using (name, tenant)""",
)
def _(t):
    """Two tenants have localities of the same names; one of them imports."""
    place, nation = F.concat(F.lit("place "), (F.col("id") / 2).cast("long")), t.raw("nation")
    known = t.localities.select("id", place.alias("name"), (F.col("id") % 2).cast("int").alias("tenant"), "location")
    point = [F.col("n_nationkey").alias("row"), (F.lit(48.00049) + F.col("n_nationkey")).alias("Lat"), (F.lit(13.12345) + F.col("n_nationkey")).alias("Lon")]
    rows = nation.select(F.concat(F.lit("place "), F.col("n_nationkey")).alias("name"), F.lit(0).alias("tenant"), *point)
    rows = rows.union(nation.select("n_name", (F.col("n_regionkey") % 3).cast("int"), *point))
    return merge.import_localities(known, rows, "row", "tenant")


# ---- identification results -----------------------------------------------------------------


def results(t):
    """Top-3 results per gallery row as parallel arrays."""
    c = F.col
    three = lambda f: F.array(*[f(i) for i in range(3)])
    return t.gallery.select(
        c("ref_id").alias("media_id"), three(lambda i: (c("identity") + i) % 10).alias("class_ids"),
        three(lambda i: F.when((c("ref_id") + i) % 11 == 0, "").otherwise(F.concat(F.lit("lynx "), (c("identity") + i) % 10))).alias("labels"),
        three(lambda i: F.concat(F.lit("/data/images/"), c("ref_id") + i, F.lit(".jpg"))).alias("paths"),
        three(lambda i: F.greatest(F.lit(0.0), c("embedding")[0].cast("double")) + (2 - i)).alias("scores"),
    )


RESULTS = """with r as (select ref_id as media_id, n as rank, (identity + n) % 10 as identity_id, case when (ref_id + n) % 11 = 0 then '' else concat('lynx ', cast((identity + n) % 10 as varchar)) end as name,
    concat('/data/images/', cast(ref_id + n as varchar), '.jpg') as path, greatest(0e0, cast(embedding[1] as double)) + (2 - n) as score from gallery, (select unnest([0, 1, 2]) as n))"""


@query("src8_parallel_arrays", f"{RESULTS} select media_id, cast(rank as int) as rank, identity_id, name, path, score from r")
def _(t):
    return merge.explode_results(results(t))


@query(
    "set15_import_results",
    f"""{RESULTS}, b as (select media_id, max(score) > 2.1 as sure from r group by 1)
    select 'assigned' as kind, r.media_id, r.identity_id, null as name, null as score from r join b using (media_id) where sure and rank = 0
    union all select 'suggested', r.media_id, r.identity_id, coalesce(nullif(r.name, ''), 'Unknown'), r.score from r join b using (media_id) where not sure
    union all select 'suggested', media_id, 77, 'stale', 0.25e0 from b where sure""",
)
def _(t):
    stale = t.gallery.select(
        F.col("ref_id").alias("media_id"), F.lit(0).alias("rank"), F.lit(77).cast("long").alias("identity_id"), F.lit("stale").alias("name"),
        F.lit("").alias("path"), F.lit(0.25).alias("score"),
    )
    assigned, suggested = merge.import_results(results(t), stale, threshold=2.1)
    a = assigned.select(F.lit("assigned").alias("kind"), "media_id", "identity_id")
    return a.unionByName(suggested.select(F.lit("suggested").alias("kind"), "media_id", "identity_id", "name", "score"), allowMissingColumns=True)


# ---- curation of a selection ----------------------------------------------------------------


@query(
    "set16_bulk_edit",
    """select id, case when id in (select id from missing_taxon) then 3 else taxon_id end as taxon_id, case when id in (select id from missing_taxon) then 7 else updated_by_id end as updated_by_id,
         coalesce(taxon_verified, false) or id in (select id from missing_taxon) as verified from media
       where id not in (select id from missing_verification where identity_id is null and id not in (select id from missing_taxon))""",
)
def _(t):
    rows, seen = owned(t), flags(t)
    gaps = media.missing_taxon(rows, seen).select("id")
    open_ones = media.missing_verification(rows, seen).filter("identity_id is null").select("id").join(gaps, "id", "left_anti")
    edited = merge.bulk_update(t.media, gaps, {"taxon_id": F.lit(3).cast("long"), "taxon_verified": F.lit(True)}, user_id=7)
    left = merge.bulk_delete(edited, open_ones)
    return left.select("id", "taxon_id", "updated_by_id", F.coalesce("taxon_verified", F.lit(False)).alias("verified"))


@query(
    "set17_confirm_prediction",
    """select o.mediafile_id, o.obs_no, case when m.id is not null then m.predicted_taxon_id else o.taxon_id end as taxon_id, case when m.id is not null then true else o.taxon_verified end as taxon_verified
       from observations o left join missing_taxon m on m.id = o.mediafile_id""",
)
def _(t):
    selected = media.missing_taxon(owned(t), flags(t))
    return merge.confirm_predictions(t.observations, selected, F.col("obs_no"))


LEGACY_CASE = " ".join(f"when '{k}' then '{v}'" for k, v in D.LEGACY_STATUS.items())


@query("set18_legacy_status", f"select id, case taxon_status {LEGACY_CASE} else taxon_status end as taxon_status from archives")
def _(t):
    return t.archives.select("id", status.migrated_status(F.col("taxon_status")).alias("taxon_status"))


@query(
    "set19_backfill",
    """with g as (select media_id, archive_id, captured_at, captured_at - lag(captured_at) over (partition by location order by captured_at, media_id) as gap, location from shots where captured_at is not null),
       n as (select *, sum(case when gap > interval 120 second then 1 else 0 end) over (partition by location order by captured_at, media_id) as number from g),
       b as (select archive_id, min(captured_at) as a, max(captured_at) as z from shots group by 1), k as (select archive_id, count(distinct number) as sequences from n group by 1),
       u as (select archive_id, count(*) as untimed from shots where captured_at is null group by 1)
    select a.id, epoch_us(b.a) as earliest_us, epoch_us(b.z) as latest_us, coalesce(k.sequences, 0) + coalesce(u.untimed, 0) as sequences,
      case when a.contains_single_taxon and a.taxon_for_identification_id is null then 3 else a.taxon_for_identification_id end as taxon_for_identification_id
    from archives a left join b on b.archive_id = a.id left join k on k.archive_id = a.id left join u on u.archive_id = a.id""",
)
def _(t):
    bounds = rollups.capture_bounds(t.shots, "archive_id")
    entities = sequences.sequence_entities(sequences.number_sequences(t.shots), "archive_id", "sequence_number", "media_id")
    counts = entities.groupBy(F.col("archive_id").alias("_a")).agg(F.count_distinct("local_id", "is_new").alias("sequences"))
    rows = t.archives.join(bounds, F.col("id") == F.col("archive_id"), "left").join(counts, F.col("id") == F.col("_a"), "left")
    default = F.when(F.col("contains_single_taxon"), F.coalesce("taxon_for_identification_id", F.lit(3).cast("long"))).otherwise(F.col("taxon_for_identification_id"))
    return rows.select(
        "id", F.unix_micros("earliest").alias("earliest_us"), F.unix_micros("latest").alias("latest_us"),
        F.coalesce("sequences", F.lit(0)).alias("sequences"), default.alias("taxon_for_identification_id"),
    )


@query(
    "set20_latest_snapshot",
    "select workgroup_id, max(media_id) as snapshot_id, arg_max(metadata_json, media_id) as suggestions from shots group by 1",
)
def _(t):
    rows = t.shots.select("workgroup_id", F.col("media_id").alias("snapshot_id"), F.col("metadata_json").alias("suggestions"))
    return merge.latest_snapshot(rows, "workgroup_id", "snapshot_id", "suggestions")


# ---- exports --------------------------------------------------------------------------------


@query(
    "src13_export_identities",
    """select id, name, code, juv_code, sex, coat_type, note, birth_date from identities where owner_workgroup_id = (select workgroup_id from users where id = 7)""",
)
def _(t):
    who = access.viewer(t.users, 7)
    return t.identities.filter(F.col("owner_workgroup_id") == who.workgroup_id).select("id", "name", "code", "juv_code", "sex", "coat_type", "note", "birth_date")


@query(
    "src13_export_localities",
    """select l.id, l.name, l.note, try_cast(split_part(l.location, ',', 1) as double) as lat, try_cast(split_part(l.location, ',', 2) as double) as lon, count(m.id) as mediafile_count
       from localities l left join media m on m.locality_id = l.id group by all""",
)
def _(t):
    return rollups.locality_rollup(t.localities, t.media).select("id", "name", "note", "lat", "lon", "mediafile_count")


@query(
    "src13_locality_records",
    """select m.locality_id, m.id, m.original_filename, strftime(m.captured_at, '%Y-%m-%d %H:%M:%S') as captured, x.name as taxon, i.name as identity
       from media m left join taxa x on x.id = m.taxon_id left join identities i on i.id = m.identity_id where m.locality_id is not null""",
)
def _(t):
    rows = named(t).filter("locality_id is not null")
    return rows.select(
        "locality_id", "id", "original_filename", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured"),
        F.col("taxon_name").alias("taxon"), F.col("identity_name").alias("identity"),
    )


@query(
    "mth7_representative_candidate",
    """with c as (select identity_id, count(*) filter (identity_is_representative) as n from media where identity_id is not null group by 1),
       s as (select mediafile_id, first(case when det_no % 3 = 0 then confidence else orientation_score end order by det_no, part_no, supp_no) as score from detections group by 1)
    select m.id, 1 - exp(-c.n / 5e0) as threshold, coalesce(s.score, 0e0) / 2 > 1 - exp(-c.n / 5e0) as is_candidate
    from media m join c on c.identity_id = m.identity_id left join s on s.mediafile_id = m.id""",
)
def _(t):
    """Every third detection has no orientation score, so that its confidence counts."""
    detections = t.detections.withColumn("orientation_score", F.when(F.col("det_no") % 3 != 0, F.col("orientation_score")))
    return media.representative_candidates(t.media, detections, ["det_no", "part_no", "supp_no"])
