"""Queries of the imports that create rows in several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.operators import archive_import
from trapline.plans.registry import query

# ---- processed metadata ---------------------------------------------------------------------

SPLIT = "n_chars % 5 <> 0"  # files that the archive has before the import


def store(t) -> archive_import.Archive:
    """Tables before the import: four fifths of the uploads, one in seven edited by a user."""
    media = t.uploads.filter(SPLIT).select(
        F.col("media_id").alias("id"), "archive_id", F.col("original_path").alias("path"), F.col("original_path").alias("original_filename"), F.lit("image").alias("media_type"),
        F.expr("timestamp'2020-01-01'").alias("captured_at"), F.lit(None).cast("long").alias("locality_id"), F.lit(1).cast("long").alias("taxon_id"), F.lit(None).cast("long").alias("identity_id"),
        F.lit(False).alias("identity_is_representative"), F.lit(None).cast("long").alias("predicted_taxon_id"), F.lit(None).cast("double").alias("predicted_taxon_confidence"),
        F.lit("N").alias("orientation"), F.lit("{}").alias("metadata_json"), F.expr("case when media_id % 7 = 0 then 3 end").cast("long").alias("updated_by"),
    )
    observations = media.filter("id % 2 = 0").select(
        F.col("id").alias("mediafile_id"), F.lit(0).alias("position"), F.lit(None).cast("long").alias("identity_id"), F.lit(1).cast("long").alias("taxon_id"),
        F.lit(None).cast("long").alias("predicted_taxon_id"), F.lit(None).cast("double").alias("predicted_taxon_confidence"),
        *[F.lit(None).cast("double").alias(c) for c in ("bbox_x_center", "bbox_y_center", "bbox_width", "bbox_height")], F.lit("N").alias("orientation"),
    )
    identities = t.identities.select("id", "name", "code", "coat_type", "owner_workgroup_id")
    return archive_import.Archive(media, observations, t.taxa, identities, t.localities.select("id", "name", "location", "owner_id"))


def archives(t):
    return t.archives.filter("id < 10").select(
        "id", "owner_id", (F.col("owner_id") % 5).alias("owner_workgroup_id"), "contains_single_taxon", "contains_identities", "taxon_for_identification_id",
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("valley "), F.col("id") % 2)).alias("locality"),
    )


def incoming(t):
    """A row for every upload, and a later one for every French file."""
    one = t.uploads.select(
        "archive_id", F.col("original_path").alias("path"), F.col("media_id").alias("position"), "original_path", F.when(F.col("media_id") % 9 == 0, "video").otherwise("image").alias("media_type"),
        F.expr("case when media_id % 4 = 0 then 'unreadable' else '2024-01-15 12:30:00' end").alias("datetime"),
        F.expr("case when media_id % 6 = 0 then '' else concat('animal ', cast(n_chars % 11 as string)) end").alias("predicted_category"),
        F.expr("case when media_id % 3 <> 0 then concat('raw ', cast(n_chars % 5 as string)) end").alias("predicted_category_raw"), (F.col("n_chars") / 20001).alias("predicted_prob_raw"),
        F.concat(F.lit("lynx "), F.col("n_chars") % 13).alias("unique_name"),
        F.expr("""case when media_id % 2 = 0 then array(named_struct('bbox', array(0e0, 0e0, 10e0, 20e0), 'size', array(100e0, 200e0), 'orientation', 'right', 'orientation_score', 0.9e0),
          named_struct('bbox', array(10e0, 20e0, 50e0, 60e0), 'size', array(100e0, 200e0), 'orientation', 'left', 'orientation_score', case when media_id % 5 = 0 then 0.1e0 else 0.8e0 end)) end""").alias("detections"),
    )
    again = t.uploads.filter("lang = 'fr'").select(F.col("original_path").alias("path"))
    later = one.join(again.hint("merge"), "path").withColumns({"position": F.col("position") + 1000000000, "datetime": F.lit("no time"), "predicted_category": F.lit("late")}).select(*one.columns)
    return one.unionByName(later)


def imported(t):
    return archive_import.import_archives(store(t), archives(t), incoming(t))


IMPORT_SQL = """with a as (select *, owner_id % 5 as wg, case when id % 3 <> 0 then concat('valley ', cast(id % 2 as varchar)) end as loc from archives where id < 10),
    i as (select u.*, u.media_id % 7 = 0 and n_chars % 5 <> 0 as edited, n_chars % 5 <> 0 as known, a.wg, a.owner_id as own, a.loc, a.contains_single_taxon as single, a.contains_identities as ext, a.taxon_for_identification_id as fix
      from uploads u join a on a.id = u.archive_id),
    r as (select *, case when single then fix end as fixed, case when edited or (single and fix is not null) then null when lang = 'fr' then 'late' when media_id % 6 = 0 then null else concat('animal ', cast(n_chars % 11 as varchar)) end as category,
      case when not edited and media_id % 3 <> 0 then concat('raw ', cast(n_chars % 5 as varchar)) end as raw, case when not edited and ext then concat('lynx ', cast(n_chars % 13 as varchar)) end as identity,
      case when not known then loc end as place from i),
    nt as (select distinct name from (select category as name from r union all select raw from r) where name is not null and name not in (select name from taxa)),
    t2 as (select id, name from taxa union all select (select max(id) from taxa) + row_number() over (order by name), name from nt),
    ni as (select distinct identity as name, wg from r where identity is not null and not exists (select 1 from identities x where x.name = identity and x.owner_workgroup_id = wg)),
    i2 as (select id, name, code, coat_type, owner_workgroup_id from identities union all select (select max(id) from identities) + row_number() over (order by name, wg), name, null, null, wg from ni),
    nl as (select distinct place as name, own from r where place is not null and not exists (select 1 from localities x where x.name = place and x.owner_id = own)),
    l2 as (select id, name, location, owner_id from localities union all select (select max(id) from localities) + row_number() over (order by name, own), name, null, own from nl),
    m as (select r.*, case when known then media_id else (select max(media_id) from uploads where n_chars % 5 <> 0) + row_number() over (partition by known order by archive_id, original_path) end as mid from r),
    f as (select m.*, coalesce(fixed, x.id) as taxon, y.id as raw_id, z.id as identity_id, q.id as place_id from m left join t2 x on x.name = category left join t2 y on y.name = raw
      left join (select min(id) as id, name, owner_workgroup_id from i2 group by 2, 3) z on z.name = identity and z.owner_workgroup_id = wg left join (select min(id) as id, name, owner_id from l2 group by 2, 3) q on q.name = place and q.owner_id = own)"""


@query(
    "set8_import_media",
    f"""{IMPORT_SQL} select mid as id, archive_id, original_path as path, case when known then 'image' when media_id % 9 = 0 then 'video' else 'image' end as media_type,
      epoch_us(case when not edited and media_id % 4 <> 0 then timestamp '2024-01-15 11:30:00' when known then timestamp '2020-01-01' end) as captured_us, place_id as locality_id,
      case when edited or (known and taxon is null) then 1 else taxon end as taxon_id, identity_id, case when known then false else single and ext end as identity_is_representative, raw_id as predicted_taxon_id,
      case when raw is not null then n_chars / 20001 end as predicted_taxon_confidence,
      case when edited then 'N' when media_id % 2 = 0 then case when media_id % 5 = 0 then 'U' else 'F' end when known then 'N' end as orientation, case when known and media_id % 7 = 0 then 3 end as updated_by from f
    union all select media_id, archive_id, original_path, 'image', epoch_us(timestamp '2020-01-01'), null, 1, null, false, null, null, 'N', case when media_id % 7 = 0 then 3 end
      from uploads where n_chars % 5 <> 0 and archive_id not in (select id from a)""",
)
def _(t):
    """Media after an import: created, updated, and left alone where a user edited them."""
    media = imported(t)[0].media
    return media.select(
        "id", "archive_id", "path", "media_type", F.unix_micros("captured_at").alias("captured_us"), "locality_id", "taxon_id", "identity_id", "identity_is_representative",
        "predicted_taxon_id", "predicted_taxon_confidence", "orientation", "updated_by",
    )


@query(
    "set8_import_observations",
    f"""{IMPORT_SQL}, n as (select * from f where not edited and media_id % 2 = 0)
    select mid as mediafile_id, 0 as position, identity_id, taxon as taxon_id, raw_id as predicted_taxon_id, case when raw is not null then n_chars / 20001 end as predicted_taxon_confidence,
      30 / 200e0 as bbox_x_center, 40 / 100e0 as bbox_y_center, 40 / 200e0 as bbox_width, 40 / 100e0 as bbox_height, case when media_id % 5 = 0 then 'U' else 'F' end as orientation from n
    union all select media_id, 0, null, 1, null, null, null, null, null, null, 'N' from uploads where n_chars % 5 <> 0 and media_id % 2 = 0 and media_id not in (select mid from n)""",
)
def _(t):
    return imported(t)[0].observations


@query("set8_import_dimensions", f"{IMPORT_SQL} select 'taxon' as kind, id, name, null as tenant from t2 union all select 'identity', id, name, owner_workgroup_id from i2 union all select 'locality', id, name, owner_id from l2")
def _(t):
    after = imported(t)[0]
    part = lambda table, kind, tenant: table.select(F.lit(kind).alias("kind"), "id", "name", tenant.cast("long").alias("tenant"))
    return (
        part(after.taxa, "taxon", F.lit(None)).unionByName(part(after.identities, "identity", F.col("owner_workgroup_id"))).unionByName(part(after.localities, "locality", F.col("owner_id")))
    )


@query(
    "set8_import_status",
    f"{IMPORT_SQL} select archive_id, original_path as path, concat(case when known then 'found' else 'created' end, case when edited then '' else ' and not updated by user' end) as status from r",
)
def _(t):
    return imported(t)[1]


# ---- spreadsheet ----------------------------------------------------------------------------


def sheet(t):
    """One row for every upload, and a later one for every French file; only four fifths are files of the archive."""
    one = t.uploads.select(
        F.replace(F.col("original_path"), F.lit("/"), F.lit("\\")).alias("original path"), F.col("media_id").alias("row"),
        F.when(F.col("media_id") % 3 == 0, F.concat(F.lit("species "), F.col("n_chars") % 7)).alias("predicted_category"),
        F.when(F.col("media_id") % 4 == 0, F.concat(F.lit("C"), F.col("n_chars") % 50)).alias("code"), F.when(F.col("media_id") % 8 < 6, F.concat(F.lit(" cat "), F.col("n_chars") % 9)).alias("unique_name"),
        F.concat(F.lit("ridge "), F.col("lang")).alias("locality name"), F.concat(F.lit("48."), F.col("media_id")).alias("lat"), F.when(F.col("media_id") % 2 == 0, "13.25").alias("lon"),
        F.when(F.col("media_id") % 5 == 0, "2023-05-06 07:08:09").alias("datetime"), F.when(F.col("media_id") % 16 == 0, "M").alias("coat_type"), F.lit(" left").alias("orientation"),
    )
    again = one.join(t.uploads.filter("lang = 'fr'").select(F.col("media_id").alias("row")).hint("merge"), "row")
    later = again.select(
        F.concat(F.lit(" "), F.col("original path")).alias("original path"), (F.col("row") + 1000000000).alias("row"), F.lit("late species").alias("predicted_category"),
        *[F.lit(None).cast("string").alias(c) for c in one.columns[3:-1]], F.lit("right").alias("orientation"),
    )
    return one.unionByName(later.select(*one.columns))


def from_sheet(t):
    return archive_import.update_from_sheet(store(t), sheet(t), "row", F.lit(2).cast("long"), F.lit(7).cast("long"))


SHEET_SQL = """with s as (select *, case when lang = 'fr' then 'late species' when media_id % 3 = 0 then concat('species ', cast(n_chars % 7 as varchar)) end as species, case when media_id % 4 = 0 then concat('C', cast(n_chars % 50 as varchar)) end as code,
      case when media_id % 8 < 6 then concat('cat ', cast(n_chars % 9 as varchar)) end as called, concat('ridge ', lang) as place, case when lang = 'fr' then 1000000000 else 0 end + media_id as pos,
      case when media_id % 2 = 0 then concat(cast(round_even(cast(concat('48.', cast(media_id as varchar)) as double), 3) as varchar), ',13.25') end as spot from uploads where n_chars % 5 <> 0),
    nt as (select distinct species as name from s where species is not null and species not in (select name from taxa)),
    t2 as (select id, name from taxa union all select (select max(id) from taxa) + row_number() over (order by name), name from nt),
    nc as (select distinct code from s where code is not null and not exists (select 1 from identities x where x.code = s.code and x.owner_workgroup_id = 2)),
    i1 as (select id, name, code, coat_type, owner_workgroup_id from identities union all select (select max(id) from identities) + row_number() over (order by code), null, code, null, 2 from nc),
    nn as (select distinct called as name from s where code is null and called is not null and not exists (select 1 from i1 x where x.name = called and x.owner_workgroup_id = 2)),
    i2 as (select * from i1 union all select (select max(id) from i1) + row_number() over (order by name), name, null, null, 2 from nn),
    nl as (select distinct place as name from s where not exists (select 1 from localities x where x.name = place and x.owner_id = 7)),
    l2 as (select id, name, location, owner_id from localities union all select (select max(id) from localities) + row_number() over (order by name), name, null, 7 from nl),
    k as (select s.*, x.id as species_id, coalesce(c.id, n.id) as ident, c.id as coded, l.id as place_id from s left join t2 x on x.name = species left join (select min(id) as id, code from i2 where owner_workgroup_id = 2 and code is not null group by 2) c on c.code = s.code
      left join (select min(id) as id, name from i2 where owner_workgroup_id = 2 group by 2) n on s.code is null and n.name = called left join (select min(id) as id, name from l2 where owner_id = 7 group by 2) l on l.name = place)"""


@query(
    "set12_sheet_media",
    f"""{SHEET_SQL} select media_id as id, coalesce(species_id, 1) as taxon_id, ident as identity_id, place_id as locality_id,
      epoch_us(case when media_id % 5 = 0 then timestamp '2023-05-06 07:08:09' else timestamp '2020-01-01' end) as captured_us, case when lang = 'fr' then 'R' else 'L' end as orientation from k""",
)
def _(t):
    return from_sheet(t).media.select("id", "taxon_id", "identity_id", "locality_id", F.unix_micros("captured_at").alias("captured_us"), "orientation")


@query(
    "set5_sheet_identities",
    f"""{SHEET_SQL}, u as (select ident, max_by(called, pos) filter (coded is not null and called is not null) as name, max(case when media_id % 16 = 0 then 'M' end) as coat from k where ident is not null group by 1)
    select i2.id, coalesce(u.name, i2.name) as name, code, coalesce(coat, coat_type) as coat_type, owner_workgroup_id from i2 left join u on u.ident = i2.id""",
)
def _(t):
    """Identities by code or name within a workgroup; a name beside a code renames."""
    return from_sheet(t).identities


@query(
    "set5_sheet_localities",
    f"""{SHEET_SQL}, u as (select place_id, max_by(spot, pos) filter (spot is not null) as spot from k group by 1)
    select l2.id, name, coalesce(spot, location) as location, owner_id from l2 left join u on u.place_id = l2.id""",
)
def _(t):
    """Localities by name of one owner, with the coordinates of the last row that has some."""
    return from_sheet(t).localities


@query("set12_sheet_taxa", f"{SHEET_SQL} select id, name from t2")
def _(t):
    return from_sheet(t).taxa
