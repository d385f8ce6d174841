"""Queries over media, observations, archives and users: filters, joins, aggregations, status."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.functions import dictionaries as D
from trapline.functions import text as X
from trapline.operators import access, media, rollups, status
from trapline.operators.skew import keys_of
from trapline.plans.registry import query

USER, LONE_USER = 7, 11  # one with and one without a workgroup
NO_GROUP = "select id from users where workgroup_id is null"


def owned(t):
    return access.media_with_archive(t.media, t.archives, t.users)


def owned_archives(t):
    return access.with_owner(t.archives, t.users)


def flags(t):
    return media.observation_flags(t.observations, t.taxa)


def named(t):
    return media.media_with_names(t.media, t.localities, t.taxa, t.identities)


# ---- filters --------------------------------------------------------------------------------


@query(
    "flt1_tenant_media",
    f"""select id, parent_id, owner_id from owned where owner_workgroup_id = (select workgroup_id from users where id = {USER})
        union all select id, parent_id, owner_id from owned where owner_id = {LONE_USER}""",
)
def _(t):
    pick = lambda u: owned(t).filter(access.tenant_predicate(access.viewer(t.users, u))).select("id", "parent_id", "owner_id")
    return pick(USER).unionByName(pick(LONE_USER))


@query(
    "flt1_visible_archives_per_user",
    """select u.id, u.workgroup_id, count(o.aid) as archives from users u left join
         (select a.id as aid, a.owner_id, w.workgroup_id from archives a join users w on w.id = a.owner_id) o
         on case when u.workgroup_id is not null then o.workgroup_id = u.workgroup_id else o.owner_id = u.id end
       group by 1, 2""",
)
def _(t):
    return access.visible_counts(owned_archives(t), t.users, "archives")


@query(
    "flt2_write_access",
    f"""select id, owner_workgroup_id is not distinct from (select workgroup_id from users where id = {LONE_USER}) or owner_id = {LONE_USER} as may_write,
          owner_id = {LONE_USER} as may_write_strict from owned""",
)
def _(t):
    who = access.viewer(t.users, LONE_USER)
    return owned(t).select("id", access.may_write(who).alias("may_write"), access.may_write(who, strict=True).alias("may_write_strict"))


@query(
    "flt3_upload_state",
    """select 'single' as kind, id from archives where contains_single_taxon and taxon_for_identification_id is not null
       union all select 'mixed', id from archives where not contains_single_taxon
       union all select 'unidentified', id from archives where taxon_for_identification_id is not null and not contains_identities""",
)
def _(t):
    lists = {
        "single": dict(single_taxon=True, without_target=False),
        "mixed": dict(single_taxon=False),
        "unidentified": dict(without_target=False, identities=False),
    }
    out = None
    for kind, options in lists.items():
        one = media.upload_state(t.archives, **options).select(F.lit(kind).alias("kind"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "flt4_media_facets",
    """select media_id, owner_id from shots where media_type = 'image' and orientation = 'L' and lower(location) like '%c%'
         and cast(captured_at as date) between date '2024-01-05' and date '2024-01-20' and not identity_is_representative""",
)
def _(t):
    return media.facets(
        t.shots, date_from="2024-01-05", date_to="2024-01-20", contains={"location": "C"},
        media_type="image", orientation="L", identity_is_representative=False,
    ).select("media_id", "owner_id")


IDENTITY_ROLLUP = """
    with r as (select i.id, i.name, i.code, i.juv_code, i.sex, i.coat_type, i.owner_workgroup_id, count(m.id) as mediafile_count,
        count(*) filter (m.identity_is_representative) as representative_count,
        count(*) filter (not m.identity_is_representative) as non_representative_count,
        count(distinct m.locality_id) as locality_count, max(m.captured_at) as last_seen
      from identities i left join media m on m.identity_id = i.id where i.name <> 'nan' group by all)"""


@query(
    "flt5_identity_filter",
    f"""{IDENTITY_ROLLUP} select id, mediafile_count from r where mediafile_count between 100 and 100000 and cast(last_seen as date) >= date '1998-01-01'
        and lower(name) like '%cust%' and lower(code) like '%b%' and sex in ('M', 'F', 'U') and coat_type = 'S'""",
)
def _(t):
    rolled = rollups.identity_rollup(t.identities, t.media)
    return media.facets(rolled, contains={"name": "cust", "code": "b"}, coat_type="S").filter(
        F.col("mediafile_count").between(100, 100000) & (F.to_date("last_seen") >= F.lit("1998-01-01").cast("date"))
    ).select("id", "mediafile_count")


@query(
    "flt6_locality_filter",
    "select l.id, a.name as area_name from localities l join areas a on a.id = l.area_id where lower(l.name) like '%supplier%' and a.name like '%A%'",
)
def _(t):
    joined = media.lookup(t.localities, t.areas, "area_id", "area", ["name"])
    return joined.filter(X.contains_ignoring_case(F.col("name"), "Supplier") & F.col("area_name").contains("A")).select("id", "area_name")


@query(
    "flt7_text_search",
    """select m.id from media m left join taxa x on x.id = m.taxon_id left join localities l on l.id = m.locality_id
         left join identities i on i.id = m.identity_id
       where lower(concat(coalesce(x.name, ''), ' ', coalesce(l.name, ''), ' ', coalesce(i.name, ''))) like '%lynx supp%'
         or lower(concat(coalesce(x.name, ''), ' ', coalesce(l.name, ''), ' ', coalesce(i.name, ''))) like '%  customer%'""",
)
def _(t):
    return media.facets(named(t), text="Lynx Supp").select("id").unionByName(media.facets(named(t), text="  customer").select("id"))


@query(
    "flt8_notifications",
    """select id, user_id from notifications where level = 1 and not read and created_at >= timestamp '2024-01-03' and created_at <= timestamp '2024-01-25'
         and lower(message) like '%click%'""",
)
def _(t):
    return media.notification_filter(t.notifications, 1, False, "2024-01-03", "2024-01-25", "CLICK").select("id", "user_id")


@query(
    "flt9_form_flags",
    """select m.id from media m left join taxa x on x.id = m.taxon_id where media_type = 'video' and orientation = 'R'
         and not coalesce(x.name = 'Nothing', false)""",
)
def _(t):
    with_taxon = media.lookup(t.media, t.taxa, "taxon_id", "taxon", ["name"])
    return media.form_flags(with_taxon, videos=True, orientation="R", hide_empty=True).select("id")


@query("flt10_missing_taxon", "select id, parent_id, owner_workgroup_id from missing_taxon")
def _(t):
    return media.missing_taxon(owned(t), flags(t)).select("id", "parent_id", "owner_workgroup_id")


@query("flt11_missing_verification", "select id, parent_id, owner_workgroup_id from missing_verification")
def _(t):
    return media.missing_verification(owned(t), flags(t)).select("id", "parent_id", "owner_workgroup_id")


def typed_uploads(t):
    return t.uploads.withColumn("media_type", X.media_type(F.col("original_path")))


@query(
    "flt12_readable_and_failed",
    """select media_id, read_error = '' as readable from uploads where lower(original_path) like '%.jpg' or lower(original_path) like '%.mp4'""",
)
def _(t):
    good, failed = media.split_readable(typed_uploads(t))
    return good.select("media_id", F.lit(True).alias("readable")).unionByName(failed.select("media_id", F.lit(False).alias("readable")))


@query("flt13_without_file", "select media_id from uploads where media_id % 9 = 1 or media_id % 7 = 0")
def _(t):
    path = F.when(F.col("media_id") % 9 == 1, "").when(F.col("media_id") % 7 == 0, None).otherwise(F.col("original_path"))
    return media.without_file(t.uploads.withColumn("file", path), "file").select("media_id")


@query("flt14_drop_folders", "select media_id, sha256(content) as content_hash from uploads where media_id % 9 <> 1")
def _(t):
    content = F.when(F.col("media_id") % 9 != 1, F.col("content"))
    return t.uploads.select("media_id", X.content_hash(content).alias("content_hash")).filter("content_hash != ''")


@query(
    "flt15_gallery_media",
    """select o.id, o.identity_is_representative and o.identity_id is not null and (w.default_taxon_id is null
           or exists (select 1 from observations b where b.mediafile_id = o.id and b.taxon_id = w.default_taxon_id)) as used_for_init
       from owned o join workgroups w on w.id = o.owner_workgroup_id""",
)
def _(t):
    """Each workgroup has a default taxon of its own, the last one has none."""
    return media.gallery_media(owned(t), t.observations, t.workgroups).select("id", "used_for_init")


@query(
    "flt16_archives_ready",
    "select id from archives where identification_status = 'IR' and taxon_for_identification_id is not null and not contains_identities",
)
def _(t):
    return media.upload_state(t.archives, without_target=False, identities=False).filter("identification_status = 'IR'").select("id")


@query(
    "flt17_media_of_target_taxon",
    """select o.id, o.parent_id from owned o where exists (select 1 from observations b where b.mediafile_id = o.id
         and b.taxon_id = o.taxon_for_identification_id)""",
)
def _(t):
    rows = owned(t)
    hits = keys_of(t.observations.filter("taxon_id is not null"), "mediafile_id", "taxon_id").withColumnRenamed("taxon_id", "observed")
    same = (rows["id"] == hits["mediafile_id"]) & (rows["taxon_for_identification_id"] == hits["observed"])
    return rows.join(hits, same, "left_semi").select("id", "parent_id")


@query(
    "flt18_for_suggestion",
    """with k as (select b.mediafile_id, x.name, b.taxon_id,
          x.name is null or x.name = 'Not Classified' or (x.name = 'Animalia' and coalesce(b.taxon_verified = false, false)) as placeholder
        from observations b left join taxa x on x.id = b.taxon_id)
    select m.id from media m join k on k.mediafile_id = m.id where m.predicted_taxon_id is not null
    group by 1 having bool_and(placeholder) and count(distinct coalesce(k.taxon_id, -1)) = 1""",
)
def _(t):
    return media.for_suggestion(t.media, flags(t)).select("id")


@query("flt19_archive_consistency", "select id, taxon_id is not distinct from taxon_for_identification_id as consistent from owned")
def _(t):
    return owned(t).select("id", F.col("taxon_id").eqNullSafe(F.col("taxon_for_identification_id")).alias("consistent"))


ARCHIVE_STATS = """
    with c as (select parent_id, count(*) as media, count(*) filter (identity_is_representative) as representative,
        count(*) filter (taxon_verified) as verified, count(*) filter (not taxon_verified) as unverified,
        count(distinct identity_id) as identities, count(distinct case when taxon_id <> 0 then taxon_id end) as taxa from media group by 1),
    g as (select parent_id, count(*) as missing_taxon from missing_taxon group by 1),
    s as (select a.*, coalesce(c.media, 0) as media, coalesce(c.representative, 0) as representative, coalesce(c.verified, 0) as verified,
        coalesce(c.unverified, 0) as unverified, coalesce(c.identities, 0) as identities, coalesce(c.taxa, 0) as taxa,
        coalesce(g.missing_taxon, 0) as missing_taxon,
        case when a.taxon_status in ('C', 'TAIP', 'TAID') then a.mediafiles_at_upload else coalesce(c.media, 0) end as shown_media
      from archives a left join c on c.parent_id = a.id left join g on g.parent_id = a.id)"""


def archive_stats(t):
    missing = media.missing_taxon(owned(t), flags(t))
    return rollups.archive_statistics(t.archives, t.media, missing, not_classified_id=0)


@query(
    "flt20_uploads_of_localities",
    f"""{ARCHIVE_STATS}, m as (select parent_id, count(*) filter (taxon_id = taxon_for_identification_id) as hits,
          first(taxon_id order by captured_at nulls last, id) as earliest_taxon, first(taxon_id order by captured_at desc nulls first, id) as latest_taxon
        from owned group by 1)
    select s.locality_id, s.id, s.name, s.shown_media, s.representative,
      case when s.taxon_for_identification_id is not null then coalesce(m.hits, 0) end as with_target, m.earliest_taxon, m.latest_taxon
    from s left join m on m.parent_id = s.id where s.locality_id is not null""",
)
def _(t):
    bounds = rollups.taxon_at_bounds(t.media, "parent_id", "id")
    hits = rollups.archive_list_counts(t.archives.select("id"), owned(t)).select(F.col("id").alias("_aid"), "mediafile_count_with_taxon")
    rows = archive_stats(t).filter("locality_id is not null").join(hits, F.col("id") == F.col("_aid"), "left")
    rows = rows.join(bounds, F.col("id") == F.col("parent_id"), "left")
    target = F.when(F.col("taxon_for_identification_id").isNotNull(), F.col("mediafile_count_with_taxon"))
    return rows.select("locality_id", "id", "name", "shown_media", "representative", target.alias("with_target"), "earliest_taxon", "latest_taxon")


# ---- joins ----------------------------------------------------------------------------------


@query(
    "jn1_media_with_references",
    """select m.id, l.name as locality_name, x.name as taxon_name, i.name as identity_name, a.name as archive_name, u.username as owner_name, p.name as predicted_name
       from media m left join localities l on l.id = m.locality_id left join taxa x on x.id = m.taxon_id left join taxa p on p.id = m.predicted_taxon_id
       left join identities i on i.id = m.identity_id left join archives a on a.id = m.parent_id left join users u on u.id = a.owner_id""",
)
def _(t):
    rows = media.lookup(named(t), t.taxa, "predicted_taxon_id", "predicted", ["name"])
    rows = media.lookup(rows, t.archives, "parent_id", "archive", ["name", "owner_id"])
    rows = media.lookup(rows, t.users, "archive_owner_id", "owner", ["username"]).withColumnRenamed("owner_username", "owner_name")
    return rows.select("id", "locality_name", "taxon_name", "identity_name", "archive_name", "owner_name", "predicted_name")


@query(
    "jn2_shared_or_tenant_media",
    f"""select distinct o.id from owned o left join album_media am on am.mediafile_id = o.id left join album_shares s on s.album_id = am.album_id
        where s.user_id = {USER} or o.owner_workgroup_id = (select workgroup_id from users where id = {USER})""",
)
def _(t):
    who = access.viewer(t.users, USER)
    return access.accessible_media(owned(t), t.album_media, t.album_shares, who).select("id")


@query(
    "jn3_spreadsheet_overlay",
    """with u as (select original_path, 'updated' as read_error, cast(null as varchar) as lang, media_id * 2 as extra from uploads where lang <> 'fr'
         union all select original_path, null, 'xx', null from uploads where lang = 'de')
       select m.media_id, coalesce(u.read_error, m.read_error) as read_error, coalesce(u.lang, m.lang) as lang, u.extra
       from uploads m left join u on u.original_path = m.original_path""",
)
def _(t):
    from trapline.operators.merge import overlay

    rows = t.uploads
    base = rows.filter("lang != 'fr'").selectExpr("original_path", "'updated' as read_error", "string(null) as lang", "media_id * 2 as extra")
    more = rows.filter("lang = 'de'").selectExpr("original_path", "string(null) as read_error", "'xx' as lang", "bigint(null) as extra")
    merged = overlay(rows.select("media_id", "original_path", "read_error", "lang"), base.unionByName(more), "original_path")
    return merged.select("media_id", "read_error", "lang", "extra")


@query("jn4_semi_join", "select id from media where id in (select mediafile_id from observations where taxon_verified)")
def _(t):
    return t.media.join(keys_of(t.observations.filter("taxon_verified"), "mediafile_id"), F.col("id") == F.col("mediafile_id"), "left_semi").select("id")


@query("jn5_anti_join", "select id from media where id not in (select mediafile_id from observations where taxon_verified)")
def _(t):
    return t.media.join(keys_of(t.observations.filter("taxon_verified"), "mediafile_id"), F.col("id") == F.col("mediafile_id"), "left_anti").select("id")


SPECIES_VALUES = ", ".join(
    "(" + ", ".join("'" + v.strip().replace("'", "''") + "'" for v in row) + ")" for row in D.species_rows()
)


@query(
    "jn6_species_translation",
    f"""with d(czech_label, species, genus, family, class, red_list) as (values {SPECIES_VALUES}),
      l as (select media_id, case media_id % 4 when 0 then 'liska obecna' when 1 then 'prase divoke' when 2 then 'jelen evropsky' else 'nezname' end as label from uploads)
    select media_id, coalesce(d.czech_label, 'nevime') as czech_label, coalesce(d.species, 'n/a') as "Species", d.family as "Family" from l left join d on d.czech_label = l.label""",
)
def _(t):
    from trapline.operators.merge import translate_species

    labelled = t.uploads.select("media_id", X.correct_label(F.element_at(X.parts(F.col("original_path")), 5)).alias("label"))
    return translate_species(labelled, "label").select("media_id", "czech_label", F.coalesce("Species", F.lit("n/a")).alias("Species"), "Family")


@query(
    "str8_dictionary_hygiene",
    """with l as (select distinct concat(case when media_id % 50 = 0 then ' ' else '' end, case when media_id % 2 = 0 then upper(lang) else lang end, '_',
          string_split(original_path, '/')[5]) as label, lang from uploads)
    select count(*) as labels, count(*) - count(distinct lower(strip_accents(trim(label)))) as duplicate_keys,
      count(*) filter (label <> trim(label) or label <> lower(strip_accents(trim(label)))) as dirty_rows from l""",
)
def _(t):
    """The labels that folders give, as a dictionary: spellings that collide, and values that aren't clean."""
    from trapline.operators.merge import dictionary_report

    spelt = F.when(F.col("media_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang"))
    label = F.concat(F.when(F.col("media_id") % 50 == 0, " ").otherwise(""), spelt, F.lit("_"), F.element_at(X.parts(F.col("original_path")), 5))
    return dictionary_report(t.uploads.select(label.alias("label"), "lang").distinct(), "label")


@query(
    "jn13_predicted_path_to_media",
    """select g.ref_id, o.ref_id as media_id from gallery g join gallery o
         on concat('images/', cast(o.ref_id as varchar), '.jpg') = regexp_replace(replace(concat('/data/masked_images/', cast(g.ref_id * 2 as varchar), '.jpg'), '/masked_images/', '/images/'), '^/data/', '')""",
)
def _(t):
    from trapline.operators.merge import media_of_paths

    predictions = t.gallery.select("ref_id", F.concat(F.lit("/data/masked_images/"), (F.col("ref_id") * 2).cast("string"), F.lit(".jpg")).alias("path"))
    files = t.gallery.select(F.col("ref_id").alias("media_id"), F.concat(F.lit("images/"), F.col("ref_id").cast("string"), F.lit(".jpg")).alias("file"))
    return media_of_paths(predictions, "path", files, "file", root="/data/").select("ref_id", "media_id")


# ---- aggregations ---------------------------------------------------------------------------


@query(
    "agg1_workgroup_dashboard",
    """with a as (select a.*, u.workgroup_id from archives a join users u on u.id = a.owner_id)
    select w.id as workgroup_id,
      (select count(*) from a where a.workgroup_id = w.id) as archives,
      (select count(*) from a where a.workgroup_id = w.id and taxon_for_identification_id is not null) as archives_with_target,
      (select count(*) from a where a.workgroup_id = w.id and taxon_for_identification_id is not null and identification_status = 'IR') as archives_ready,
      (select count(*) from owned o where o.owner_workgroup_id = w.id) as media,
      (select count(*) from owned o where o.owner_workgroup_id = w.id and taxon_for_identification_id is not null) as media_with_target,
      (select count(*) from owned o where o.owner_workgroup_id = w.id and taxon_for_identification_id is not null and identity_id is null) as media_without_identity,
      (select count(*) from owned o where o.owner_workgroup_id = w.id and taxon_for_identification_id is not null and identity_is_representative) as representative_media,
      (select count(*) from owned o where o.owner_workgroup_id = w.id and taxon_for_identification_id is not null and identification_status = 'IR') as media_ready
    from workgroups w""",
)
def _(t):
    return rollups.workgroup_dashboard(t.workgroups, owned_archives(t), owned(t))


TENANT = "case when u.workgroup_id is not null then o.owner_workgroup_id = u.workgroup_id else o.owner_id = u.id end"
SAME_GROUP = "o.owner_workgroup_id is not distinct from u.workgroup_id and o.taxon_for_identification_id is not null"


@query(
    "agg2_user_dashboard",
    f"""with n as (select u.id, u.workgroup_id, count(o.id) filter ({TENANT}) as media_general,
        count(o.id) filter (({TENANT}) and o.taxon_verified = false) as unverified_general,
        count(o.id) filter (o.owner_id = u.id) as media, count(o.id) filter (o.owner_id = u.id and o.taxon_id is not null) as known_taxon,
        count(o.id) filter ({SAME_GROUP}) as for_identification,
        count(o.id) filter ({SAME_GROUP} and o.identity_id is null) as missing_identity,
        count(o.id) filter ({SAME_GROUP} and o.identity_id is not null) as known_identity
      from users u, owned o group by 1, 2)
    select n.*, (select count(*) from missing_taxon o, users u where u.id = n.id and ({TENANT})) as missing_taxon_general,
      (select count(*) from archives a where a.owner_id = n.id) as archives,
      (select count(*) from identities i where i.owner_workgroup_id is not distinct from n.workgroup_id) as identities
    from n""",
)
def _(t):
    rows = owned(t)
    return rollups.user_dashboard(t.users.select("id", "workgroup_id"), owned_archives(t), rows, media.missing_taxon(rows, flags(t)), t.identities)


@query(
    "agg3_filtered_counts",
    """select a.id, count(o.id) as mediafile_count, count(o.id) filter (o.taxon_id = a.taxon_for_identification_id) as mediafile_count_with_taxon,
         epoch_us(min(o.captured_at)) as earliest_us from archives a left join media o on o.parent_id = a.id group by 1""",
)
def _(t):
    counts = rollups.archive_list_counts(t.archives.select("id"), owned(t))
    return counts.select("id", "mediafile_count", "mediafile_count_with_taxon", F.unix_micros("earliest_captured_at").alias("earliest_us"))


@query(
    "agg4_identity_rollup",
    f"{IDENTITY_ROLLUP} select id, mediafile_count, representative_count, locality_count, epoch_us(last_seen) as last_seen_us from r",
)
def _(t):
    return rollups.identity_rollup(t.identities, t.media).select(
        "id", "mediafile_count", "representative_count", "locality_count", F.unix_micros("last_seen").alias("last_seen_us")
    )


@query(
    "agg5_curation_order",
    f"{IDENTITY_ROLLUP} select id, representative_count, non_representative_count from r where non_representative_count > 0 order by 2, 3 desc, 1",
)
def _(t):
    return rollups.curation_order(rollups.identity_rollup(t.identities, t.media)).select("id", "representative_count", "non_representative_count")


@query(
    "agg6_locality_rollup",
    """select l.id, l.name, count(m.id) as mediafile_count, try_cast(split_part(l.location, ',', 1) as double) as lat,
         try_cast(split_part(l.location, ',', 2) as double) as lon from localities l left join media m on m.locality_id = l.id group by all order by l.name""",
)
def _(t):
    return rollups.locality_rollup(t.localities, t.media).select("id", "name", "mediafile_count", "lat", "lon").orderBy("name", "id")


STATS_COLUMNS = "id, shown_media, representative, verified, unverified, identities, taxa, missing_taxon"


@query(
    "agg7_archive_statistics",
    f"""{ARCHIVE_STATS} select {STATS_COLUMNS}, shown_media - missing_taxon as with_taxon,
      case when shown_media = 0 then 0e0 else 100e0 * (shown_media - missing_taxon) / shown_media end as taxon_percent,
      case when shown_media = 0 then 0e0 else 100e0 * verified / shown_media end as verified_percent from s""",
)
def _(t):
    return archive_stats(t).select(*STATS_COLUMNS.split(", "), "with_taxon", "taxon_percent", "verified_percent")


@query("agg8_capture_bounds", "select archive_id, epoch_us(min(captured_at)) as earliest_us, epoch_us(max(captured_at)) as latest_us from shots group by 1")
def _(t):
    bounds = rollups.capture_bounds(t.shots, "archive_id")
    return bounds.select("archive_id", F.unix_micros("earliest").alias("earliest_us"), F.unix_micros("latest").alias("latest_us"))


@query(
    "agg9_taxon_at_bounds",
    """with r as (select *, row_number() over (partition by archive_id order by captured_at nulls last, media_id) as a,
        row_number() over (partition by archive_id order by captured_at desc nulls first, media_id) as z from shots)
    select archive_id, max(taxon_id) filter (a = 1) as earliest_taxon, max(taxon_id) filter (z = 1) as latest_taxon from r group by 1""",
)
def _(t):
    return rollups.taxon_at_bounds(t.shots, "archive_id", "media_id")


@query(
    "agg10_localities_of_identity",
    """select identity_id, locality_id, count(*) as n, row_number() over (partition by identity_id order by count(*) desc, locality_id) as position
       from media where identity_id is not null and locality_id is not null group by 1, 2""",
)
def _(t):
    return rollups.localities_of_identity(t.media)


@query("agg11_taxon_histogram", "select x.name as taxon_name, count(x.name) as n from media m left join taxa x on x.id = m.taxon_id group by 1")
def _(t):
    return rollups.taxon_histogram(media.lookup(t.media, t.taxa, "taxon_id", "taxon", ["name"]))


@query("agg12_uploads_per_day", "select cast(captured_at as date) as date, owner_id, count(*) as n from shots group by 1, 2")
def _(t):
    return rollups.uploads_per_day(t.shots, "captured_at", "owner_id")


@query(
    "agg13_files_per_archive",
    """select archive_id, count(*) as file_count, count(*) filter (lower(original_path) like '%.jpg') as image_count,
         count(*) filter (lower(original_path) like '%.mp4') as video_count from uploads group by 1""",
)
def _(t):
    return rollups.files_per_archive(t.uploads, "archive_id", "original_path")


@query(
    "agg14_date_tree",
    """with d as (select distinct cast(timezone('Europe/Prague', captured_at::timestamptz) as date) as day from shots where captured_at is not null
         union select distinct cast(timezone('Europe/Prague', captured_at::timestamptz) as date) from media),
    m as (select cast(year(day) as int) as year, monthname(day) as month, string_agg(cast(day as varchar), ',' order by day desc) as days from d group by 1, 2)
    select *, row_number() over (partition by year order by month desc) as position from m""",
)
def _(t):
    return rollups.date_tree(t.shots.select("captured_at").unionByName(t.media.select("captured_at")), "captured_at")


@query(
    "agg15_class_extremes",
    """with c as (select identity as label, count(*) as n from gallery group by 1)
    select (select label from c order by n desc, label limit 1) as most_common, (select max(n) from c) as most_count,
      (select label from c order by n, label limit 1) as least_common, (select min(n) from c) as least_count""",
)
def _(t):
    return rollups.class_extremes(t.gallery, "identity")


MIXED_ID = 99


@query(
    "agg16_taxon_from_observations",
    f"""select mediafile_id, case when count(distinct taxon_id) = 1 then max(taxon_id) when count(distinct taxon_id) > 1 then {MIXED_ID} end as taxon_id
        from observations group by 1""",
)
def _(t):
    return media.single_taxon(flags(t), MIXED_ID).select("mediafile_id", "taxon_id")


@query(
    "agg17_all_verified",
    "select m.id, coalesce(bool_and(coalesce(o.taxon_verified, true)), true) as verified from media m left join observations o on o.mediafile_id = m.id group by 1",
)
def _(t):
    return media.with_flags(t.media, flags(t)).select("id", F.coalesce("all_verified", F.lit(True)).alias("verified"))


@query(
    "agg20_max_suggestion_score",
    """with s as (select ref_id as id, cast(embedding[n + 1] as double) as score from gallery, (select unnest([0, 1, 2]) as n) where is_query)
       select g.ref_id as id, max(s.score) as max_score from gallery g left join s on s.id = g.ref_id group by 1""",
)
def _(t):
    from trapline.operators.ranking import max_scores

    scores = t.gallery.filter("is_query").select(F.col("ref_id").alias("for_id"), F.explode(F.slice("embedding", 1, 3).cast("array<double>")).alias("score"))
    return max_scores(t.gallery.select(F.col("ref_id").alias("id")), scores)


@query(
    "agg21_mean_vector_per_group",
    """with c as (select sequence_id, unnest(range(1, 65)) as position, unnest(embedding) as v from gallery),
      a as (select sequence_id, position, avg(cast(v as double)) as m, sum(cast(v as double)) as s from c group by 1, 2)
    select sequence_id, max(m) filter (position = 1) as first_mean, max(m) filter (position = 64) as last_mean, sum(s) as total from a group by 1""",
)
def _(t):
    means = rollups.vector_per_group(t.gallery, "sequence_id", "embedding")
    sums = rollups.vector_per_group(t.gallery, "sequence_id", "embedding", "sum").select(
        "sequence_id", F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v).alias("total")
    )
    return means.select("sequence_id", F.col("embedding")[0].alias("first_mean"), F.col("embedding")[63].alias("last_mean")).join(sums, "sequence_id")


@query(
    "agg22_map_summary",
    """with p as (select try_cast(split_part(location, ',', 1) as double) as lat, try_cast(split_part(location, ',', 2) as double) as lon from localities where location is not null)
    select count(*) as n, min(lat) as lat_min, max(lat) as lat_max, min(lon) as lon_min, max(lon) as lon_max, avg(lat) as lat_mean, avg(lon) as lon_mean,
      case when greatest(max(lat) - min(lat), max(lon) - min(lon)) < 10 then 6 when greatest(max(lat) - min(lat), max(lon) - min(lon)) < 30 then 5
        when greatest(max(lat) - min(lat), max(lon) - min(lon)) < 60 then 4 else 3 end as zoom from p""",
)
def _(t):
    return rollups.map_summary(rollups.locality_rollup(t.localities, t.media))


# ---- status ---------------------------------------------------------------------------------


@query(
    "st1_updated_status",
    f"""{ARCHIVE_STATS}, n as (select id, case when taxon_status in ('TV', 'TKN', 'TAID') then
          case when missing_taxon > 0 then 'TAID' when unverified > 0 then 'TKN' else 'TV' end else taxon_status end as status from s)
    select id, case when status in ('C','F','TAIP','TAID','TKN','TV','IR','IAIP','IAID','ID','U') then status else 'U' end as status from n""",
)
def _(t):
    return archive_stats(t).select("id", status.updated_status(F.col("taxon_status"), F.col("missing_taxon"), F.col("unverified")).alias("status"))


LABEL_CASE = " ".join(f"when '{k}' then '{v}'" for k, v in D.STATUS_LABELS.items())


@query(
    "st2_status_view",
    f"""select id, case taxon_status {LABEL_CASE} else 'Unknown' end as status,
      case taxon_status when 'TKN' then 'All media files have taxon.' when 'TV' then 'All taxons are verified.' else status_message end as status_message,
      case taxon_status when 'TAID' then 'secondary' when 'F' then 'danger' when 'TKN' then 'primary' when 'TV' then 'success' when 'U' then 'warning' else 'dark' end as status_style,
      case identification_status {LABEL_CASE} else 'Unknown' end as identification_label,
      case taxon_status when 'TKN' then 'All media files have taxon.' when 'TV' then 'All taxons are verified.' else status_message end as identification_message,
      case when identification_status = 'F' then 'danger' when identification_status = 'U' then 'warning' when identification_status = 'IAIP' then 'secondary'
        when identification_status = 'IAID' then 'primary' when taxon_status = 'F' then 'danger' when taxon_status in ('TKN', 'TV') then 'secondary' else 'dark' end as identification_style
    from archives""",
)
def _(t):
    c = F.col
    views = {
        **status.taxon_status_view(c("taxon_status"), c("status_message")),
        **status.identification_status_view(c("taxon_status"), c("identification_status"), c("status_message")),
    }
    return t.archives.select("id", *[v.alias(k) for k, v in views.items()])


@query(
    "st3_next_step",
    """select a.id, case when taxon_status = 'TAID' then 'Annotate taxa' when taxon_status = 'TKN' then 'Verify taxa'
         when taxon_status = 'TV' and u.workgroup_id is not null then 'Go to identification' end as step from archives a left join users u on u.id = a.owner_id""",
)
def _(t):
    return owned_archives(t).select("id", status.next_step(F.col("taxon_status"), F.col("owner_workgroup_id")).alias("step"))


@query(
    "st4_finished_workgroups",
    """select u.workgroup_id as owner_workgroup_id, count(*) filter (identification_status = 'IAIP') as running,
         count(*) filter (identification_status = 'IAIP') = 0 as finished from archives a join users u on u.id = a.owner_id where u.workgroup_id is not null group by 1""",
)
def _(t):
    return status.finished_workgroups(owned_archives(t))


@query(
    "st5_recommended_action",
    f"""with n as (select u.id, (select count(*) from missing_taxon o where {TENANT}) as missing_taxa,
          (select count(*) from missing_verification o where {TENANT}) as unverified from users u)
    select *, case when missing_taxa > 0 then 'annotate_missing_taxa' when unverified > 0 then 'verify_taxa' else 'upload_species' end as action from n""",
)
def _(t):
    rows, seen = owned(t), flags(t)
    users = t.users.select("id", "workgroup_id")
    a = access.visible_counts(media.missing_taxon(rows, seen), users, "missing_taxa")
    b = access.visible_counts(media.missing_verification(rows, seen), users, "unverified")
    joined = a.join(b.select("id", "unverified"), "id")
    return joined.select("id", "missing_taxa", "unverified", status.recommended_action(F.col("missing_taxa"), F.col("unverified")).alias("action"))


@query(
    "st5_identification_actions",
    """with n as (select w.id, w.identification_initiated as i,
        (select count(*) from owned o where o.owner_workgroup_id = w.id and o.identity_is_representative and o.taxon_for_identification_id is not null) as representative,
        (select count(*) from archives a join users u on u.id = a.owner_id where u.workgroup_id = w.id and a.taxon_status in ('TKN', 'TV') and not a.contains_identities
           and a.taxon_for_identification_id is not null) as unidentified,
        (select count(*) from owned o where o.owner_workgroup_id = w.id and o.identity_id is null and o.id % 10 = 0 and w.id <> 2) as to_confirm from workgroups w)
    select id, case when not i and representative = 0 then 'primary' else 'secondary' end as upload_identified,
      case when not i and representative > 0 then 'primary' else 'secondary' end as init_identification,
      case when i and unidentified = 0 and to_confirm = 0 then 'primary' else 'secondary' end as upload_unidentified,
      case when i and unidentified > 0 and to_confirm = 0 then 'primary' else 'secondary' end as run_identification,
      case when to_confirm > 0 then 'primary' else 'secondary' end as confirm_identification from n""",
)
def _(t):
    target = F.col("taxon_for_identification_id").isNotNull()
    waiting = F.col("identity_id").isNull() & (F.col("id") % 10 == 0) & (F.col("owner_workgroup_id") != 2)
    m = owned(t).groupBy("owner_workgroup_id").agg(
        F.count_if(target & F.col("identity_is_representative")).alias("representative"), F.count_if(waiting).alias("to_confirm")
    )
    new = target & F.col("taxon_status").isin("TKN", "TV") & ~F.col("contains_identities")
    a = owned_archives(t).groupBy(F.col("owner_workgroup_id").alias("_wg")).agg(F.count_if(new).alias("unidentified"))
    rows = t.workgroups.join(m, F.col("id") == F.col("owner_workgroup_id"), "left").join(a, F.col("id") == F.col("_wg"), "left")
    rows = rows.fillna(0, ["representative", "to_confirm", "unidentified"])
    c = F.col
    actions = status.identification_actions(c("identification_initiated"), c("representative"), c("unidentified"), c("to_confirm"))
    return rows.select("id", *[v.alias(k) for k, v in actions.items()])
