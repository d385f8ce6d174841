"""Queries over the scalar functions: text and paths, times, geometry, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.functions import arrays as A
from trapline.functions import dictionaries as D
from trapline.functions import geometry as G
from trapline.functions import text as X
from trapline.functions import timestamps as DT
from trapline.operators import media
from trapline.plans.registry import query

def path():
    return F.col("original_path")


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


# ---- text and paths -------------------------------------------------------------------------


# paths with letters and marks of other scripts
FOREIGN = "concat(original_path, case media_id % 3 when 0 then '/שָׁלוֹם' when 1 then '/ά̃Ђ̆' else '/ạ̊ǟ' end)"


@query("str1_strip_accents", f"select media_id, strip_accents({FOREIGN}) as plain from uploads")
def _(t):
    return t.uploads.select("media_id", X.strip_accents(F.expr(FOREIGN)).alias("plain"))


@query("udf4_strip_accents_arrow", "select media_id, strip_accents(original_path) as plain from uploads")
def _(t):
    return t.uploads.select("media_id", X.strip_accents_any(path()).alias("plain"))


@query(
    "str2_path_hash_name",
    """select media_id, concat('media_data/', sha256(original_path), lower(regexp_extract(original_path, '(\\.[^./]+)$', 1)))
         as hashed from uploads""",
)
def _(t):
    return t.uploads.select("media_id", X.hashed_name(path()).alias("hashed"))


@query("str3_content_hash", "select media_id, sha256(content) as content_hash from uploads")
def _(t):
    return t.uploads.select("media_id", X.content_hash(F.col("content")).alias("content_hash"))


@query(
    "str4_media_type",
    """select media_id, case when lower(original_path) like '%.mp4' then 'video' when lower(original_path) like '%.jpg' then 'image'
         else 'unknown' end as media_type from uploads""",
)
def _(t):
    return t.uploads.select("media_id", X.media_type(path()).alias("media_type"))


LABELS_SQL = "case lower(strip_accents({0})) " + " ".join(
    f"when '{k}' then '{v}'" for k, v in D.LABEL_CORRECTIONS.items() if k is not None
) + " else coalesce(lower(strip_accents({0})), 'nevime') end"
KNOWN_SQL = "case when {0} in (" + quoted(r[0].strip() for r in D.species_rows()) + ") then {0} else 'nevime' end"


@query(
    "str5_path_structure",
    f"""
    with p as (select *, string_split(original_path, '/') as parts from uploads),
    q as (select *, parts[1] in ('TRIDENA', 'NETRIDENA') as archive_tree, parts[len(parts) - 1] as folder from p),
    r as (select *, {LABELS_SQL.format("folder")} as corrected from q)
    select media_id, parts[len(parts)] as filename, regexp_extract(original_path, '(\\.[^./]+)$', 1) as suffix,
      case when lower(original_path) like '%.mp4' then 'video' when lower(original_path) like '%.jpg' then 'image' else 'unknown' end as media_type,
      parts[1] = 'TRIDENA' as annotated,
      case when archive_tree then parts[3] end as vanilla_location,
      case when archive_tree then replace(replace(replace(replace(replace(lower(strip_accents(parts[3])), ' ', ''), 'druhy_', ''), '_', ''), '3l-', ''), '-', '') end as location,
      case when archive_tree then regexp_extract(original_path, '/([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})/', 1) end as date,
      cast(len(parts) as int) as path_len,
      case when not archive_tree then 'rys ostrovid' when parts[1] <> 'TRIDENA' or len(parts) = 4 then 'nevime'
        else {KNOWN_SQL.format("corrected")} end as czech_label,
      case when parts[1] = 'TRIDENA' and len(parts) <> 4 then folder end as vanilla_species
    from r""",
)
def _(t):
    from trapline.operators.scan import path_columns

    kept = "filename suffix media_type annotated vanilla_location location date path_len czech_label vanilla_species".split()
    return path_columns(t.uploads).select("media_id", *kept)


@query(
    "str6_clean_location",
    """select media_id, replace(replace(replace(replace(replace(lower(strip_accents(string_split(original_path, '/')[3])), ' ', ''),
         'druhy_', ''), '_', ''), '3l-', ''), '-', '') as location from uploads""",
)
def _(t):
    return t.uploads.select("media_id", X.clean_location(F.element_at(X.parts(path()), 3)).alias("location"))


@query(
    "str7_species_label",
    f"""with r as (select media_id, {LABELS_SQL.format("string_split(original_path, '/')[5]")} as corrected from uploads)
    select media_id, corrected, {KNOWN_SQL.format("corrected")} as czech_label from r""",
)
def _(t):
    corrected = X.correct_label(F.element_at(X.parts(path()), 5))
    return t.uploads.select("media_id", corrected.alias("corrected")).withColumn("czech_label", X.known_label(F.col("corrected")))


@query("str9_date_in_path", "select media_id, string_split(original_path, '/')[4] as date from uploads")
def _(t):
    return t.uploads.select("media_id", X.date_in_path(path()).alias("date"))


@query(
    "str10_identity_in_path",
    """select media_id, string_split(original_path, '/')[5] as parent_name,
         case when string_split(original_path, '/')[1] = 'rysi' then string_split(original_path, '/')[3] end as third_part from uploads""",
)
def _(t):
    return t.uploads.select(
        "media_id",
        X.identity_of_parent_folder(path()).alias("parent_name"),
        X.identity_of_third_part(path()).alias("third_part"),
    )


FOLDER_SQL = """case media_id % 4 when 0 then concat('2021-0', cast(1 + media_id % 9 as varchar), '-11_Mala_', source)
  when 1 then concat(source, '_202112', cast(10 + media_id % 30 as varchar)) when 2 then concat(source, '_20211345')
  else concat('plain', source) end"""


@query(
    "str11_date_and_locality",
    f"""with f as (select media_id, source, {FOLDER_SQL} as name from uploads)
    select media_id, name,
      case when media_id % 4 = 0 then substr(name, 1, 10) when media_id % 4 = 1 and media_id % 30 <= 21 then right(name, 8) end as date,
      case when media_id % 4 = 0 then concat('Mala_', source) when media_id % 4 = 1 and media_id % 30 <= 21 then source end as locality
    from f""",
)
def _(t):
    named = t.uploads.withColumn("name", F.expr(FOLDER_SQL.replace("varchar", "string")))
    return X.split_date_and_locality(named, "name").select("media_id", "name", "date", "locality")


CODE_SQL = "concat(name, ' B', cast(id as varchar), 'x')"


@query(
    "str13_code_in_name",
    f"""select id, {CODE_SQL} as full_name, case when id % 2 = 0 then concat('B', cast(id as varchar)) end as code,
          case when id % 2 = 0 then concat(name, ' x') end as name_without_code,
          case when id % 2 = 0 then concat(name, ' x') else 'plain' end as applied
        from names where id % 2 = 0
        union all select id, 'plain' as full_name, null, null, 'plain' from names where id % 2 <> 0""",
)
def _(t):
    full = F.when(F.col("id") % 2 == 0, F.expr(CODE_SQL.replace("varchar", "string"))).otherwise("plain")
    return t.names.select("id", full.alias("full_name")).select(
        "id",
        "full_name",
        X.code_in_name(F.col("full_name")).alias("code"),
        X.name_without_code(F.col("full_name")).alias("name_without_code"),
        F.coalesce(F.trim(X.name_without_code(F.col("full_name"))), F.col("full_name")).alias("applied"),
    )


@query(
    "str14_check_date",
    """select id, try_cast(nullif(regexp_extract(name, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') as date) as check_date from archives""",
)
def _(t):
    return t.archives.select("id", X.date_in_name(F.col("name")).alias("check_date"))


@query(
    "str15_export_name",
    """select m.id, concat(coalesce(l.name, 'no_locality'), '_', coalesce(strftime(m.captured_at, '%Y-%m-%d'), 'no_date'), '_IMG_', cast(m.id as varchar), '_',
         coalesce(x.name, 'no_taxon'), '_', coalesce(i.name, 'no_identity'), '.JPG') as export_name
       from media m left join localities l on l.id = m.locality_id left join taxa x on x.id = m.taxon_id
       left join identities i on i.id = m.identity_id""",
)
def _(t):
    from trapline.operators.media import media_with_names

    return media_with_names(t.media, t.localities, t.taxa, t.identities).select(
        "id",
        X.export_name(
            F.col("locality_name"), F.col("captured_at"), F.col("original_filename"), F.col("taxon_name"),
            F.col("identity_name"), F.col("original_filename"),
        ).alias("export_name"),
    )


@query(
    "str16_original_filename",
    """select media_id, string_split(original_path, '/')[6] as filename,
         regexp_replace(string_split(original_path, '/')[6], '\\.[^.]+$', '') as stem from uploads""",
)
def _(t):
    return t.uploads.select("media_id", X.basename(path()).alias("filename"), X.stem(path()).alias("stem"))


@query(
    "str17_levenshtein_plain",
    "select media_id, levenshtein(strip_accents(string_split(original_path, '/')[5]), 'jelen') as distance from uploads",
)
def _(t):
    plain = X.strip_accents(F.element_at(X.parts(path()), 5))
    return t.uploads.select("media_id", F.levenshtein(plain, F.lit("jelen")).cast("long").alias("distance"))


@query(
    "str18_split_location",
    """select id, try_cast(split_part(location, ',', 1) as double) as lat, try_cast(split_part(location, ',', 2) as double) as lon from localities""",
)
def _(t):
    lat, lon = G.lat_lon(F.col("location"))
    return t.localities.select("id", lat.alias("lat"), lon.alias("lon"))


SEX_TEXT = "case id % 4 when 0 then 'male' when 1 then 'Female' when 2 then 'x' else 'unknown' end"
COAT_TEXT = "case id % 5 when 0 then 'Spotted' when 1 then 'Marbled' when 2 then 'Nothing' when 3 then 'Xx' else 'Unspotted' end"


@query(
    "str19_code_normalisation",
    f"""select id, case id % 4 when 0 then 'M' when 1 then 'F' when 3 then 'U' end as sex,
          case id % 5 when 0 then 'S' when 1 then 'M' when 2 then 'N' when 4 then 'N' end as coat,
          case id % 3 when 0 then 'R' when 1 then 'L' end as orientation from identities""",
)
def _(t):
    facing = F.expr("case id % 3 when 0 then ' right' when 1 then 'Left' else 'up?' end")
    allowed = ("L", "R", "F", "B", "N")
    return t.identities.select(
        "id",
        X.first_letter_code(F.expr(SEX_TEXT), ("M", "F", "U")).alias("sex"),
        X.coat_code(F.expr(COAT_TEXT)).alias("coat"),
        X.first_letter_code(facing, allowed).alias("orientation"),
    )


WORDS_SQL = "string_split_regex(lower(concat(coalesce(x.name, ''), ' ', coalesce(l.name, ''))), '\\W+')"


@query(
    "str20_ranked_text_match",
    f"""with r as (select m.id, cast(list_contains({WORDS_SQL}, 'lynx') as int) + cast(list_contains({WORDS_SQL}, 'supplier') as int) as rank
          from media m left join taxa x on x.id = m.taxon_id left join localities l on l.id = m.locality_id)
    select * from r where rank > 0""",
)
def _(t):
    """Media ranked by how many words of a phrase occur in taxon and locality names."""
    from trapline.operators.media import media_with_names

    named = media_with_names(t.media, t.localities, t.taxa, t.identities)
    rank = X.token_overlap(X.search_text(F.col("taxon_name"), F.col("locality_name")), "Lynx lynx supplier")
    return named.select("id", rank.alias("rank")).filter("rank > 0")


@query("str21_variant_path", "select ref_id, replace(path, '/masked_images/', '/images/') as path from gallery")
def _(t):
    return t.gallery.select("ref_id", X.swap_variant(F.col("path")).alias("path"))


# ---- times ----------------------------------------------------------------------------------


@query(
    "dt1_exif_datetime",
    """select media_id, case when exif_original is null then null else
         concat(substr(exif_original, 1, 4), '-', substr(exif_original, 6, 2), '-', substr(exif_original, 9)) end as standard from tagged""",
)
def _(t):
    return t.tagged.select("media_id", DT.exif_to_standard(F.col("exif_original")).alias("standard"))


def tag_map():
    """Tags of a file as a map; absent tags are absent keys."""
    pairs = F.array(
        F.struct(F.lit("QuickTime:CreateDate").alias("k"), F.col("quicktime_create").alias("v")),
        F.struct(F.lit("EXIF:CreateDate").alias("k"), F.col("exif_create").alias("v")),
        F.struct(F.lit("EXIF:DateTimeOriginal").alias("k"), F.col("exif_original").alias("v")),
    )
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


OCR_SQL = """case media_id % 5
    when 0 then strptime(concat('2022-01-', lpad(cast(1 + media_id % 28 as varchar), 2, '0'), ' ', lpad(cast(12 + (1 + media_id % 12) % 12 as varchar), 2, '0'), ':07:00'), '%Y-%m-%d %H:%M:%S')
    when 1 then strptime(concat('2021-05-', lpad(cast(1 + media_id % 28 as varchar), 2, '0'), ' 07:0', cast(media_id % 10 as varchar), ':33'), '%Y-%m-%d %H:%M:%S') end"""


@query(
    "dt2_capture_time",
    f"""with x as (select *, {OCR_SQL} as ocr,
          concat(replace(substr(quicktime_create, 1, 10), ':', '-'), substr(quicktime_create, 11)) as quick,
          concat(replace(substr(exif_original, 1, 10), ':', '-'), substr(exif_original, 11)) as original from tagged)
    select media_id, case when media_id % 17 = 3 then 'cannot open' else '' end as read_error,
      case when media_id % 17 = 3 then '' when quicktime_create is not null then quick
        when exif_create is not null and exif_create <> '0000-00-00 00:00:00' then concat(replace(substr(exif_create, 1, 10), ':', '-'), substr(exif_create, 11))
        when exif_create is null and exif_original is not null then original
        when ocr is not null then strftime(ocr, '%Y-%m-%d %H:%M:%S') else strftime(modified_at, '%Y-%m-%d %H:%M:%S') end as datetime,
      case when media_id % 17 = 3 or quicktime_create is not null then ''
        when exif_create is not null and exif_create <> '0000-00-00 00:00:00' then 'EXIF:CreateDate'
        when exif_create is null and exif_original is not null then 'EXIF:DateTimeOriginal'
        when ocr is not null then 'OCR' else 'File system' end as datetime_source
    from x""",
)
def _(t):
    """The blacklist is a parameter; here it also holds the all-zero time."""
    tagged = t.tagged.withColumn("tags", tag_map())
    blacklist = [*D.CAPTURE_TIME_BLACKLIST, "0000-00-00 00:00:00"]
    broken = tagged.withColumn("broken", F.when(F.col("media_id") % 17 == 3, F.lit("cannot open")))
    found = DT.capture_time(broken, "tags", "ocr_text", [F.col("modified_at"), F.col("modified_at") + F.expr("interval 1 hour")], blacklist, "broken")
    return found.select("media_id", "datetime", "read_error", "datetime_source")


@query("dt3_ocr_time", f"select media_id, epoch_us({OCR_SQL}) as ocr_us from tagged")
def _(t):
    return t.tagged.select("media_id", F.unix_micros(DT.ocr_time(F.col("ocr_text"))).alias("ocr_us"))


@query(
    "dt4_lenient_parse",
    """select media_id, epoch_us(try_strptime(case when exif_create like '0000%' then null else exif_create end, '%Y:%m:%d %H:%M:%S')) as us
       from tagged""",
)
def _(t):
    return t.tagged.select("media_id", F.unix_micros(DT.lenient(F.col("exif_create"), "yyyy:MM:dd HH:mm:ss")).alias("us"))


@query(
    "dt5_local_to_utc",
    """select media_id, case when media_id % 5 = 0 then null when media_id % 2 = 0
         then epoch_us(timezone('Europe/Prague', date_trunc('second', modified_at)))
         else epoch_us(date_trunc('second', modified_at) - interval 2 hour) end as us from tagged""",
)
def _(t):
    text = F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss")
    given = F.when(F.col("media_id") % 5 == 0, "not a time").when(F.col("media_id") % 2 == 0, text).otherwise(F.concat(text, F.lit("+02:00")))
    return t.tagged.select("media_id", F.unix_micros(DT.local_to_utc(given)).alias("us"))


@query(
    "dt6_shift_time",
    "select id, epoch_us(captured_at + interval 1 year + interval 3 day - interval 5 hour) as us from media",
)
def _(t):
    return t.media.select("id", F.unix_micros(DT.shift(F.col("captured_at"), years=1, days=3, hours=-5)).alias("us"))


@query(
    "dt7_naive_time",
    "select media_id, strftime(timezone('Europe/Prague', captured_at::timestamptz), '%Y-%m-%d %H:%M:%S') as wall_clock from shots",
)
def _(t):
    return t.shots.select("media_id", F.date_format(DT.naive(F.col("captured_at"), "Europe/Prague"), "yyyy-MM-dd HH:mm:ss").alias("wall_clock"))


@query(
    "dt8_processing_estimate",
    """with f as (select archive_id, lower(original_path) as p from uploads),
    c as (select archive_id, count(*) filter (p like '%.jpg') as images, count(*) filter (p like '%.mp4') as videos from f group by 1),
    s as (select *, 10e0 + images * 0.5e0 + videos * 60e0 as seconds from c)
    select archive_id, seconds, case when seconds < 60 then 'in a few seconds'
      when seconds < 3600 then case when floor(seconds / 60) = 1 then 'in a minute' else concat('in ', cast(cast(floor(seconds / 60) as bigint) as varchar), ' minutes') end
      when floor(seconds / 3600) = 1 then 'in an hour' else concat('in ', cast(cast(floor(seconds / 3600) as bigint) as varchar), ' hours') end as wait from s""",
)
def _(t):
    from trapline.operators.rollups import files_per_archive

    counts = files_per_archive(t.uploads, "archive_id", "original_path")
    return counts.select("archive_id", DT.processing_seconds(F.col("image_count"), F.col("video_count")).alias("seconds")).withColumn(
        "wait", DT.readable_wait(F.col("seconds"))
    )


# ---- geometry -------------------------------------------------------------------------------


@query(
    "mth1_round_location",
    """select id, round_even(try_cast(split_part(location, ',', 1) as double) / 7, 3) as lat,
         round_even(try_cast(split_part(location, ',', 2) as double) / 7, 3) as lon from localities""",
)
def _(t):
    lat, lon = G.lat_lon(F.col("location"))
    rounded = G.rounded_location(lat / 7, lon / 7)
    lat2, lon2 = G.lat_lon(rounded)
    return t.localities.select("id", lat2.alias("lat"), lon2.alias("lon"))


DET = "select mediafile_id, det_no, part_no, supp_no"


@query(
    "mth3_relative_box",
    f"""{DET}, ((x_min + x_max) / 2) / img_w as bbox_x_center, ((y_min + y_max) / 2) / img_h as bbox_y_center,
        (x_max - x_min) / img_w as bbox_width, (y_max - y_min) / img_h as bbox_height from detections""",
)
def _(t):
    return boxes(t).select(*KEY, "bbox_x_center", "bbox_y_center", "bbox_width", "bbox_height")


KEY = ["mediafile_id", "det_no", "part_no", "supp_no"]


def boxes(t):
    c = F.col
    return t.detections.withColumns(
        G.relative_box(c("x_min"), c("y_min"), c("x_max"), c("y_max"), c("img_w"), c("img_h"))
    )


@query(
    "mth4_pixel_box",
    f"""with b as ({DET}, ((x_min + x_max) / 2) / 7e0 as xc, ((y_min + y_max) / 2) / 9e0 as yc, (x_max - x_min) / 7e0 as w,
        (y_max - y_min) / 9e0 as h from detections)
    {DET}, cast(trunc((xc - w / 2) * 3) as int) as x_min, cast(trunc((yc - h / 2) * 5) as int) as y_min,
      cast(trunc((xc + w / 2) * 3) as int) as x_max, cast(trunc((yc + h / 2) * 5) as int) as y_max from b""",
)
def _(t):
    c = F.col
    relative = t.detections.select(
        *KEY, *[v.alias(k) for k, v in G.relative_box(c("x_min"), c("y_min"), c("x_max"), c("y_max"), F.lit(7.0), F.lit(9.0)).items()]
    )
    box = G.pixel_box(c("bbox_x_center"), c("bbox_y_center"), c("bbox_width"), c("bbox_height"), F.lit(3), F.lit(5))
    return relative.select(*KEY, *[v.alias(k) for k, v in box.items()])


@query(
    "mth5_media_fragment",
    f"""with b as ({DET}, ((x_min + x_max) / 2) / img_w as xc, ((y_min + y_max) / 2) / img_h as yc, (x_max - x_min) / img_w as w,
        (y_max - y_min) / img_h as h from detections)
    {DET}, printf('xywh=percent:%.4f,%.4f,%.4f,%.4f', (xc - w / 2) * 100, (yc - h / 2) * 100, w * 100, h * 100) as fragment from b""",
)
def _(t):
    c = F.col
    fragment = G.media_fragment(c("bbox_x_center"), c("bbox_y_center"), c("bbox_width"), c("bbox_height"))
    return boxes(t).select(*KEY, fragment.alias("fragment"))


@query(
    "mth6_percent",
    """select parent_id, case when count(*) = 0 then 0e0 else 100e0 * count(*) filter (taxon_verified) / count(*) end as verified_percent
       from media group by 1""",
)
def _(t):
    counts = t.media.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("taxon_verified").alias("v"))
    return counts.select("parent_id", G.percent(F.col("v"), F.col("n")).alias("verified_percent"))


# ---- arrays ---------------------------------------------------------------------------------


def detection_text():
    """A detection list as the text of a list of dicts, as model outputs are stored in CSV."""
    no = F.col("det_no").cast("string")
    name = F.when(F.col("det_no") == 2, F.lit('"Geoffroy\'s cat"')).when(F.col("det_no") == 3, F.lit("'Nonelike None'")).otherwise(F.concat(F.lit("'"), F.col("class"), F.lit("'")))
    pieces = ("[{'bbox': [", no, ", 2.0, 9.0, 8.0], 'confidence': 0.", no, ", 'class': ", name)
    tail = ", 'size': [400, 600], 'orientation': 'left', 'orientation_score': None}]"
    whole = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in (*pieces, tail)])
    return F.when(F.col("det_no") == 4, F.lit("[{'bbox': [1.0, ")).otherwise(whole)


@query(
    "arr1_parse_detections",
    f"""{DET}, case when det_no <> 4 then 1 end as n, case det_no when 2 then 'Geoffroy''s cat' when 3 then 'Nonelike None' when 4 then null else class end as first_class,
      case when det_no <> 4 then cast(concat('0.', cast(det_no as varchar)) as double) end as first_confidence,
      case when det_no <> 4 then cast(det_no as double) end as first_x, cast(null as double) as first_score, case when det_no = 4 then '[{{''bbox'': [1.0, ' end as error from detections""",
)
def _(t):
    parsed = t.detections.select(*KEY, "class", detection_text().alias("text")).withColumn("d", A.parse_detections(F.col("text")))
    first = A.first_or_null(F.col("d"))
    return parsed.select(
        *KEY, F.size("d").alias("n"), first["class"].alias("first_class"), first["confidence"].alias("first_confidence"),
        first["bbox"][0].alias("first_x"), first["orientation_score"].alias("first_score"),
        A.unparsed(F.col("text"), F.col("d")).alias("error"),
    )


IMPORTED = """with d as (select *, row_number() over (partition by mediafile_id order by det_no, part_no, supp_no, x_max, y_max) - 1 as position, count(*) over (partition by mediafile_id) as n from detections),
  c as (select *, case when orientation not in ('back', 'front', 'left', 'right', 'unknown') then null when orientation_score < 0.5 then 'U'
      else case orientation when 'back' then 'B' when 'front' then 'F' when 'left' then 'F' when 'right' then 'R' else 'U' end end as code from d),
  o as (select mediafile_id, position, n, code, (x_min + x_max) / 2e0 / img_w as bbox_x_center, (y_min + y_max) / 2e0 / img_h as bbox_y_center,
      (x_max - x_min) / cast(img_w as double) as bbox_width, (y_max - y_min) / cast(img_h as double) as bbox_height, last_value(code ignore nulls) over (partition by mediafile_id order by position rows between unbounded preceding and unbounded following) as last_code from c)"""


def imported_detections(t):
    one = F.struct(
        F.array(*[F.col(c).cast("double") for c in ("x_min", "y_min", "x_max", "y_max")]).alias("bbox"), F.array(F.col("img_h"), F.col("img_w")).alias("size"),
        F.col("orientation").alias("orientation"), F.col("orientation_score").alias("orientation_score"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("det_no", "part_no", "supp_no", one.alias("d"))))  # the few detections of a file
    files = t.detections.groupBy("mediafile_id").agg(F.transform(ordered, lambda x: x["d"]).alias("detections"))
    return files.withColumns({"identity_id": F.col("mediafile_id") % 7, "taxon_id": F.lit(3), "predicted_taxon_id": F.lit(4), "predicted_taxon_confidence": F.lit(0.5)})


BOX = "bbox_x_center, bbox_y_center, bbox_width, bbox_height"


@query(
    "arr3_observations_of_detections",
    f"""{IMPORTED} select 'all' as mode, mediafile_id, cast(position as int) as position, case when position = 0 then mediafile_id % 7 end as identity_id, {BOX}, code as orientation from o
    union all select 'reference', mediafile_id, 0, mediafile_id % 7, {BOX}, last_code from o where position = n - 1""",
)
def _(t):
    """Every detection as an observation, and the one observation that the last detection leaves."""
    rows = imported_detections(t)
    shown = lambda mode: media.detection_observations(rows, mode).select(
        F.lit(mode).alias("mode"), "mediafile_id", "position", "identity_id", *BOX.split(", "), "orientation"
    )
    return shown("all").unionByName(shown("reference"))


def detection_list():
    """0 to 3 detections per row, derived from one detector row."""
    one = lambda i: F.struct(
        (F.col("confidence") + F.lit(0.125 * i)).alias("confidence"), F.lit(i).alias("position"), F.col("class").alias("class"),
        F.col("orientation_score").alias("orientation_score"),
    )
    return F.slice(F.array(one(2), one(0), one(1)), F.lit(1), F.pmod(F.col("det_no"), F.lit(4)))


@query(
    "arr2_first_detection",
    f"{DET}, case when det_no % 4 > 0 then confidence + 0.25e0 end as confidence, case when det_no % 4 > 0 then class end as class from detections",
)
def _(t):
    first = A.first_or_null(detection_list())
    return t.detections.select(*KEY, first["confidence"].alias("confidence"), first["class"].alias("class"))


@query(
    "arr3_explode_detections",
    f"""with p as (select unnest([0, 1, 2]) as pos)
    {DET}, pos, confidence + case pos when 0 then 0.25e0 when 1 then 0e0 else 0.125e0 end as confidence from detections, p where pos < det_no % 4
    union all {DET}, null, null from detections where det_no % 4 = 0""",
)
def _(t):
    return t.detections.withColumn("d", detection_list()).select(*KEY, F.posexplode_outer("d").alias("pos", "d")).select(
        *KEY, "pos", F.col("d.confidence").alias("confidence")
    )


@query(
    "arr4_best_detection",
    f"{DET}, case when det_no % 4 > 0 then confidence + 0.25e0 end as confidence, case when det_no % 4 > 0 then 2 end as position from detections",
)
def _(t):
    best = A.best_by_confidence(detection_list())
    return t.detections.select(*KEY, best["confidence"].alias("confidence"), best["position"].alias("position"))


LOGITS = "list_transform(embedding[1:10], lambda x: cast(x as double))"


def logits(t):
    return t.gallery.select("ref_id", F.slice("embedding", 1, 10).cast("array<double>").alias("logits"))


@query(
    "arr5_argmax",
    f"""with l as (select ref_id, {LOGITS} as logits from gallery)
    select ref_id, cast(list_position(logits, list_max(logits)) - 1 as bigint) as class_id, list_max(logits) as top from l""",
)
def _(t):
    return logits(t).select("ref_id", A.argmax(F.col("logits")).alias("class_id"), F.array_max("logits").alias("top"))


@query(
    "arr6_count_above",
    f"""with l as (select ref_id, {LOGITS} as logits from gallery)
    select ref_id, cast(len(list_filter(logits, lambda x: x > 0e0)) as int) as above_0, cast(len(list_filter(logits, lambda x: x > 0.1e0)) as int) as above_01 from l""",
)
def _(t):
    return logits(t).select(
        "ref_id", A.count_above(F.col("logits"), 0.0).alias("above_0"), A.count_above(F.col("logits"), 0.1).alias("above_01")
    )


@query(
    "arr7_matched_keypoints",
    """with v as (select ref_id, list_transform(embedding, lambda x: cast(x as double)) as v from gallery),
    g as (select ref_id, list_sort(list_filter(v, lambda x: x >= 0.05e0), 'DESC') as good from v)
    select ref_id, cast(case when len(good) < 10 then 0 else least(len(good), 10) end as int) as n,
      case when len(good) >= 10 then good[1] end as best, case when len(good) >= 10 then good[10] end as tenth from g""",
)
def _(t):
    points = F.transform(F.col("embedding").cast("array<double>"), lambda s, i: F.struct(s.alias("score"), i.alias("kp0"), (i * 2).alias("kp1")))
    kept = t.gallery.select("ref_id", A.matched_keypoints(points, threshold=0.05).alias("kp"))
    return kept.select(
        "ref_id", F.size("kp").alias("n"), F.try_element_at("kp", F.lit(1))["score"].alias("best"),
        F.try_element_at("kp", F.lit(10))["score"].alias("tenth"),
    )


@query(
    "arr8_mask_keypoints",
    f"""{DET}, case when round_even(x_min / 8, 0) <= 6 and round_even(y_min / 8, 0) <= 3 then confidence else 0e0 end as first,
      case when round_even(x_max / 8, 0) <= 6 and round_even(y_max / 8, 0) <= 3 then confidence else 0e0 end as second from detections""",
)
def _(t):
    visible = F.array(*[F.lit(f"{x},{y}") for x in range(7) for y in range(4)])
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), "confidence")
    masked = A.mask_confidence(F.array(point("x_min", "y_min"), point("x_max", "y_max")), visible)
    return t.detections.select(*KEY, masked.alias("m")).select(*KEY, F.col("m")[0].alias("first"), F.col("m")[1].alias("second"))


@query(
    "arr9_json_lookup",
    """select media_id, cast(json_extract_string(metadata_json, '$.k') as bigint) as k, json_exists(metadata_json, '$.missing') as has_missing
       from shots""",
)
def _(t):
    bag = F.try_parse_json("metadata_json")
    return t.shots.select(
        "media_id", F.try_variant_get(bag, "$.k", "bigint").alias("k"),
        F.get_json_object("metadata_json", "$.missing").isNotNull().alias("has_missing"),
    )


@query(
    "arr10_compact_record",
    """select media_id, concat('{"media_id":', cast(media_id as varchar), case when captured_at is not null then concat(',"location":"', location, '"') else '' end,
         ',"orientation":"', orientation, '"', case when media_id % 4 = 0 then '' else ',"size":2.5' end, '}') as record from shots""",
)
def _(t):
    located = t.shots.withColumn("location", F.when(F.col("captured_at").isNotNull(), F.col("location")))
    sized = located.withColumn("size", F.when(F.col("media_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.lit(2.5)))
    return sized.select("media_id", A.compact_json(sized, ["media_id", "location", "orientation", "size"]).alias("record"))


@query(
    "arr11_pad_with_last",
    f"{DET}, case det_no % 3 when 0 then 'a,a,a,a' when 1 then 'a,b,b,b' else 'a,b,c,c' end as padded from detections",
)
def _(t):
    short = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), F.pmod(F.col("det_no"), F.lit(3)) + 1)
    return t.detections.select(*KEY, F.array_join(A.pad_with_last(short, 4), ",").alias("padded"))


@query("arr12_clip_scores", "select media_id, greatest(0e0, least(1e0, score / 10)) as clipped from shots")
def _(t):
    return t.shots.select("media_id", A.clip01(F.col("score") / 10).alias("clipped"))


@query(
    "arr13_orientation_code",
    f"""{DET}, case when orientation = 'tail' then null when orientation_score < 0.5 then 'U'
      when orientation = 'left' then 'L' when orientation = 'front' then 'F' else 'R' end as code from detections""",
)
def _(t):
    return t.detections.select(*KEY, A.orientation_code(F.col("orientation"), F.col("orientation_score")).alias("code"))
