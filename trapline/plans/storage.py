"""Queries that go through files: listings, CSV and parquet round trips, gallery versions, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.functions import text as X
from trapline.operators.scan import path_columns
from trapline.plans.registry import query
from trapline.plans.reid import SHORT, roles, shortlisted
from trapline.session import scratch_path
from trapline.sources import files, gallery, paged, similarities
from trapline.streaming import online, upsert

CSV_SCHEMA = ("media_id long, original_path string, content string, read_error string, n_chars long")


@query("src1_metadata_csv", "select media_id, original_path, sha256(content) as content_hash, nullif(read_error, '') as read_error, n_chars from uploads")
def _(t):
    """Write as CSV, read back with a declared schema; texts hold quotes and line breaks."""
    path = scratch_path(t.spark, "metadata")
    rows = t.uploads.select("media_id", "original_path", "content", F.nullif("read_error", F.lit("")).alias("read_error"), "n_chars")
    files.write_metadata(rows.select(F.col("media_id").alias("_index"), *rows.columns), path)
    back = files.read_metadata(t.spark, path, CSV_SCHEMA)
    return back.select("media_id", "original_path", F.sha2("content", 256).alias("content_hash"), "read_error", "n_chars")


@query("src2_failed_rows", "select media_id, original_path, read_error from uploads where read_error <> ''")
def _(t):
    path = scratch_path(t.spark, "failed")
    files.write_metadata(t.uploads.filter("read_error != ''").select("media_id", "original_path", "read_error"), path)
    schema = ("media_id long, original_path string, read_error string")
    return files.read_metadata(t.spark, path, schema, index=False)


@query("src4_table_scan", "select o.id, a.name as archive_name, u.username from owned o join archives a on a.id = o.parent_id join users u on u.id = o.owner_id where o.media_type = 'video'")
def _(t):
    from trapline.operators.media import lookup

    rows = lookup(t.media.filter("media_type = 'video'"), t.archives, "parent_id", "archive", ["name", "owner_id"])
    return lookup(rows, t.users, "archive_owner_id", "owner", ["username"]).select("id", "archive_name", F.col("owner_username").alias("username"))


def gallery_rows(t):
    text = gallery.to_json(F.col("embedding").cast("array<double>"), F.array(F.array(F.lit(1.0), F.lit(2.0))), F.array(F.lit(600), F.lit(400)))
    return t.gallery.select(
        "ref_id", F.col("organization_id").cast("int").alias("organization_id"), F.col("path").alias("image_path"), F.col("identity").alias("class_id"),
        F.concat(F.lit("lynx "), "identity").alias("label"), text.alias("embedding"),
    )


@query(
    "src5_gallery_upsert",
    """select ref_id, organization_id, case when organization_id = 1 and is_query then concat('new ', cast(identity as varchar)) else concat('lynx ', cast(identity as varchar)) end as label from gallery""",
)
def _(t):
    """The query images of organisation 1 are encoded again with new labels."""
    path = scratch_path(t.spark, "gallery")
    gallery.write(gallery_rows(t), path)
    fresh = gallery_rows(t).join(t.gallery.filter("is_query").select("ref_id"), "ref_id", "left_semi").filter("organization_id = 1")
    gallery.upsert(path, 1, fresh.withColumn("label", F.concat(F.lit("new "), "class_id")))
    return gallery.read(t.spark, path).select("ref_id", F.col("organization_id").cast("long").alias("organization_id"), "label")


@query(
    "src6_gallery_scan",
    """with o as (select ref_id, row_number() over (order by ref_id) as rn from gallery where organization_id = 2)
       select 'page' as kind, ref_id from o where rn between 21 and 40 union all select 'rest', ref_id from gallery where organization_id <> 2
       union all select 'picked', ref_id from gallery where organization_id = 2 and is_query""",
)
def _(t):
    path = scratch_path(t.spark, "gallery")
    gallery.write(gallery_rows(t), path)
    rows = gallery.read(t.spark, path, 2)
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "ref_id")
    picked = gallery.pick(rows, t.gallery.filter("is_query"))
    return kind(gallery.page(rows, 20, 40), "page").unionByName(kind(gallery.delete(t.spark, path, 2), "rest")).unionByName(kind(picked, "picked"))


@query(
    "src6_stored_row_range",
    """with o as (select ref_id, identity, path, row_number() over (order by ref_id) as rn, count(*) over () as n from gallery)
       select ref_id, identity, path from o where rn > n - 25 and rn <= n - 5""",
)
def _(t):
    """A range of rows near the end of the gallery, from a table stored in key order."""
    path, order = scratch_path(t.spark, "paged"), [F.col("ref_id")]
    rows = t.gallery.select("ref_id", "identity", "path")
    paged.write(rows, path, order)
    n = paged.count(t.spark, path)
    return paged.read(t.spark, path, rows.schema, order, n - 25, n - 5)


@query(
    "top_2_stored_page",
    """with o as (select media_id, owner_id, row_number() over (order by captured_at desc nulls last, media_id) - 1 as place, count(*) over () as n from shots)
       select media_id, owner_id from o where place // 24 = (n // 24) // 2""",
)
def _(t):
    """The page in the middle of all media, from a table stored in display order."""
    path, order = scratch_path(t.spark, "paged"), [F.col("captured_at").desc_nulls_last(), F.col("media_id")]
    rows = t.shots.select("media_id", "owner_id", "captured_at")
    paged.write(rows, path, order)
    middle = paged.count(t.spark, path) // 24 // 2 + 1
    return paged.page(t.spark, path, rows.schema, order, middle, 24).select("media_id", "owner_id")


@query("src7_embedding_json", "select ref_id, cast(embedding[1] as double) as first, cast(embedding[64] as double) as last, 2e0 as key_y, 600 as width from gallery")
def _(t):
    parsed = gallery_rows(t).select("ref_id", gallery.from_json(F.col("embedding")).alias("f"))
    return parsed.select(
        "ref_id", F.col("f.vector")[0].alias("first"), F.col("f.vector")[63].alias("last"), F.col("f.keypoints")[0][1].alias("key_y"), F.col("f.image_size")[0].alias("width")
    )


CATEGORY = "case when read_error <> '' then concat('class_', cast(media_id % 7 as varchar)) else concat('taxon ', lang) end"


@query(
    "src9_category_layout",
    f"select {CATEGORY} as category, count(*) as files, min(concat({CATEGORY}, '/', 'data/', original_path)) as first_path from uploads group by 1",
)
def _(t):
    path = scratch_path(t.spark, "categories")
    rows = files.image_paths(t.uploads, "data").select(
        "media_id", "image_path", F.when(F.col("read_error") == "", F.concat(F.lit("taxon "), "lang")).alias("predicted_category"), (F.col("media_id") % 7).alias("predicted_class_id")
    )
    files.write_by_category(rows, path)
    back = t.spark.read.schema("media_id long, image_path string, category string").parquet(path)
    return back.groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.min("image_path").alias("first_path"))


@query(
    "src10_dataset_manifest",
    "select media_id, concat('data/', sha256(original_path), lower(regexp_extract(original_path, '(\\.[^./]+)$', 1))) as image_path from uploads",
)
def _(t):
    return files.image_paths(t.uploads, "data", hashed=True).select("media_id", "image_path")


@query("src11_feature_set", "select ref_id, identity, cast(embedding[1] as double) as first, cast(len(embedding) as int) as dims from gallery")
def _(t):
    path = scratch_path(t.spark, "features")
    files.save_features(t.gallery, path)
    return files.load_features(t.spark, path).select("ref_id", "identity", F.col("embedding")[0].cast("double").alias("first"), F.size("embedding").alias("dims"))


@query(
    "src11_similarity_save",
    f"{SHORT} select query_id, max(score) as best, arg_min(ref_id, position) as best_ref, arg_min(identity, position) as best_identity, any_value(query_identity) as identity, count(*) as kept from k group by 1",
)
def _(t):
    """The shortlist is saved with the metadata of both sides, read back and grouped by query where it lies."""
    path = scratch_path(t.spark, "similarities")
    name = "similarities_" + path.rsplit("-", 1)[1]
    similarities.save(shortlisted(t), *roles(t), path, name, ["identity", "sequence_id"])
    rows = similarities.load(t.spark, path, name)
    best = F.max_by(F.struct("ref_id", "r_identity"), F.struct("score", -F.col("ref_id")))
    found = rows.groupBy("query_id").agg(F.max("score").alias("best"), best.alias("_b"), F.first("q_identity").alias("identity"), F.count(F.lit(1)).alias("kept"))
    return found.select("query_id", "best", F.col("_b.ref_id").alias("best_ref"), F.col("_b.r_identity").alias("best_identity"), "identity", "kept")


@query("src12_latest_spreadsheet", "select media_id, lang from uploads")
def _(t):
    """Two spreadsheets lie in the folder; the one whose path sorts last is read."""
    root = scratch_path(t.spark, "upload")
    files.write_metadata(t.uploads.select("media_id", F.lit("old").alias("lang")), f"{root}/a")
    files.write_metadata(t.uploads.select("media_id", "lang"), f"{root}/b")
    latest = files.latest_spreadsheet(files.list_files(t.spark, root, "*.csv"))
    folder = latest.rsplit("/", 1)[0]  # Spark writes a spreadsheet as a folder of parts
    return files.read_metadata(t.spark, folder, ("media_id long, lang string"), index=False)


@query("src13_export_media_csv", "select id, original_filename, strftime(captured_at, '%Y-%m-%d') as day from media")
def _(t):
    path = scratch_path(t.spark, "media")
    files.write_metadata(t.media.select("id", "original_filename", F.date_format("captured_at", "yyyy-MM-dd").alias("day")), path)
    return files.read_metadata(t.spark, path, ("id long, original_filename string, day string"), index=False)


FOLDERS = """with f as (select media_id, source, case media_id % 5 when 0 then concat('2021-03-11_Háj ', source, '.zip') when 1 then concat('20210311/', source) when 2 then concat(source, '/2021-03-11')
    when 3 then concat('_imported/', source) else 'plain' end as path from uploads)"""


@query(
    "str12_upload_folders",
    f"""{FOLDERS}, c as (select media_id, path, case media_id % 5 when 0 then '2021-03-11' when 1 then '2021-03-11' when 2 then '2021-03-11' else '' end as date,
        case media_id % 5 when 0 then concat('Háj ', source) when 1 then source when 2 then source else '' end as locality from f)
    select media_id, date, locality, replace(strip_accents(concat(locality, '_', date, '.zip')), ' ', '_') as zip_name, media_id % 5 = 3 as skipped,
      case when media_id % 5 in (3, 4) then 'Name of the directory or file is not in correct format. Skipping.' end as error from c""",
)
def _(t):
    from trapline.operators.scan import classify_upload_folders

    path = F.expr("""case media_id % 5 when 0 then concat('2021-03-11_Háj ', source, '.zip') when 1 then concat('20210311/', source) when 2 then concat(source, '/2021-03-11')
        when 3 then concat('_imported/', source) else 'plain' end""")
    return classify_upload_folders(t.uploads.select("media_id", path.alias("path"))).select("media_id", "date", "locality", "zip_name", "skipped", "error")


@query("str12_known_localities", f"{FOLDERS} select media_id, source in ('src1', 'src2') as locality_exists from f where media_id % 5 in (1, 2)")
def _(t):
    from trapline.operators.scan import classify_upload_folders, mark_known

    path = F.when(F.col("media_id") % 5 == 1, F.concat(F.lit("20210311/"), "source")).when(F.col("media_id") % 5 == 2, F.concat("source", F.lit("/2021-03-11"))).otherwise("plain")
    folders = classify_upload_folders(t.uploads.select("media_id", path.alias("path"))).filter("error is null")
    known = t.uploads.filter("source in ('src1', 'src2')").select(F.col("source").alias("name"))
    return mark_known(folders, known, "locality", "name", "locality_exists").select("media_id", "locality_exists")


# ---- streams --------------------------------------------------------------------------------

EVENT_SCHEMA = ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def event_stream(t):
    rows = online.watch_folder(t.spark, f"{t.folder}/events.parquet*", EVENT_SCHEMA)
    return rows.select(F.col("event_id").alias("media_id"), F.col("event_type").alias("location"), F.col("ts").cast("timestamp").alias("captured_at"), "props")


@query("stm1_folder_ingest", "select media_id, location, epoch_us(modified_at) as us from tagged")
def _(t):
    """Drained twice with one checkpoint: the second run finds nothing new."""
    sink, checkpoint = scratch_path(t.spark, "ingested"), scratch_path(t.spark, "offsets")
    for _run in range(2):
        online.drain(event_stream(t), sink, checkpoint)
    rows = t.spark.read.schema("media_id long, location string, captured_at timestamp, props string").parquet(sink)
    return rows.select("media_id", "location", F.unix_micros("captured_at").alias("us"))


STORED = "path string, media_id long, shots_at timestamp, value double, edited boolean"


@query(
    "stm1_folder_merge",
    """with e as (select *, concat(event_type, '/', cast(user_id as varchar)) as path, ts as seen from events),
       first as (select path, arg_max({'event_id': event_id, 'seen': seen, 'value': value}, {'seen': seen, 'event_id': event_id}) as x from e group by path),
       late as (select path, max(event_id) as event_id, max(seen) + interval 1 day as seen from e where user_id % 3 = 0 group by path
         union all select concat('new/', cast(user_id as varchar)), max(event_id), max(seen) from e where user_id % 5 = 0 group by 1)
       select path, case when edited then x.event_id else coalesce(late.event_id, x.event_id) end as media_id, epoch_us(case when edited then x.seen else coalesce(late.seen, x.seen) end) as us, x.value, coalesce(edited, false) as edited
       from (select *, x.event_id % 4 = 0 as edited from first) f full join late using (path)""",
)
def _(t):
    """A stream merged into a table by path, drained twice and its batch replayed; then a second stream updates a third of the paths and adds some."""
    table, checkpoint, later = scratch_path(t.spark, "merged"), scratch_path(t.spark, "offsets"), scratch_path(t.spark, "later")
    path = F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"))
    shaped = lambda rows: rows.select(path.alias("path"), F.col("event_id").alias("media_id"), F.col("ts").cast("timestamp").alias("shots_at"), "value", (F.col("event_id") % 4 == 0).alias("edited"))
    first = upsert.merging(table, "path", "shots_at", STORED, source="events")
    for _run in range(2):
        online.drain(shaped(online.watch_folder(t.spark, f"{t.folder}/events.parquet*", EVENT_SCHEMA)), "", checkpoint, each=first)
    first(shaped(t.raw("events")).withColumn("value", F.lit(-1.0)), 0)  # a replay of batch 0 changes nothing, whatever it brings
    grouped = lambda rows, by, day: rows.groupBy(by.alias("path")).agg(F.max("event_id").alias("media_id"), (F.max(F.col("ts").cast("timestamp")) + F.make_dt_interval(F.lit(day))).alias("shots_at"))
    updates = grouped(t.raw("events").filter("user_id % 3 = 0"), path, 1).unionByName(grouped(t.raw("events").filter("user_id % 5 = 0"), F.concat(F.lit("new/"), F.col("user_id").cast("string")), 0))
    updates.withColumns({"value": F.lit(None).cast("double"), "edited": F.lit(None).cast("boolean")}).write.parquet(later)
    second = upsert.merging(table, "path", "shots_at", STORED, source="later", keep=F.col("edited"))
    online.drain(online.watch_folder(t.spark, later, STORED), "", scratch_path(t.spark, "offsets"), each=second)
    rows = upsert.current(t.spark, table, STORED)
    return rows.select("path", "media_id", F.unix_micros("shots_at").alias("us"), "value", F.coalesce("edited", F.lit(False)).alias("edited"))


@query(
    "stm2_online_sequences",
    """with g as (select *, modified_at - lag(modified_at) over (partition by location order by modified_at, media_id) as gap from tagged),
       n as (select *, sum(case when gap > interval 120 second then 1 else 0 end) over (partition by location order by modified_at, media_id) as number from g)
    select location, count(*) as shots, epoch_us(min(modified_at)) as first_us, epoch_us(max(modified_at)) as last_us from n group by location, number""",
)
def _(t):
    """Each session is written once, when it is closed; a last shot closes those that are open when the stream has ended."""
    sink, checkpoint, last = scratch_path(t.spark, "sessions"), scratch_path(t.spark, "offsets"), scratch_path(t.spark, "last")
    shots = event_stream(t).select("location", "captured_at")
    t.spark.createDataFrame([], "location string, captured_at timestamp").write.parquet(last)
    both = shots.union(online.watch_folder(t.spark, last, "location string, captured_at timestamp"))
    sessions = online.online_sequences(both, "location", "captured_at")
    online.drain(sessions, sink, checkpoint)
    online.ending(t.tagged.select("location", F.col("modified_at").alias("captured_at")), "location", "captured_at").write.mode("append").parquet(last)
    online.drain(sessions, sink, checkpoint)
    rows = t.spark.read.schema("location string, shots long, first_at timestamp, last_at timestamp").parquet(sink)
    return rows.select("location", "shots", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


@query("stm3_online_unique", "select distinct props as content from events")
def _(t):
    """One row of every content, whichever came first."""
    sink, checkpoint = scratch_path(t.spark, "unique"), scratch_path(t.spark, "offsets")
    online.drain(online.online_unique(event_stream(t), "props", "captured_at", "60 days"), sink, checkpoint)
    return t.spark.read.schema("media_id long, location string, captured_at timestamp, props string").parquet(sink).select(F.col("props").alias("content"))


@query("src3_listing_columns", "select media_id, lower(regexp_extract(original_path, '(\\.[^./]+)$', 1)) as ending from uploads where lower(original_path) not like '%.txt'")
def _(t):
    """What a listing excludes by suffix, on the paths of the uploads."""
    rows = path_columns(t.uploads).withColumn("ending", F.lower(X.suffix(F.col("original_path"))))
    return rows.filter(~F.col("ending").isin(".txt")).select("media_id", "ending")
