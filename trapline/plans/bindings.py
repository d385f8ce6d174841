"""The camera-trap tables, as views over the driver tables.

Every view is one SELECT that runs unchanged in Spark and in DuckDB (``//`` and ``varchar`` are
spelled the DuckDB way and replaced for Spark).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # shots: the time line of one camera per event type
    "shots": """
        select event_id as media_id, event_type as location,
          case when event_id % 97 = 0 then null else ts end as captured_at,
          event_id % 2 = 0 as annotated, user_id as owner_id, user_id % 10 as workgroup_id,
          user_id as archive_id,
          case when event_id % 7 = 0 then 'video' else 'image' end as media_type,
          case event_id % 5 when 0 then 'L' when 1 then 'R' when 2 then 'F' when 3 then 'B' else 'U' end as orientation,
          event_id % 11 = 0 as identity_is_representative,
          case when event_id % 13 = 0 then null else event_id % 17 end as taxon_id,
          value as score, props as metadata_json
        from {events}""",
    # uploads: files with a folder layout, a text standing for the bytes, and read errors
    "uploads": """
        select doc_id as media_id,
          concat(case doc_id % 3 when 0 then 'TRIDENA' when 1 then 'NETRIDENA' else 'rysi' end, '/LY2019/',
            upper(source), '_', lang, '/2019-07-', lpad(cast(1 + doc_id % 28 as varchar), 2, '0'), '/',
            case doc_id % 4 when 0 then 'Liška' when 1 then 'divočák' when 2 then 'jelen' else 'neznámé' end, '/',
            cast(doc_id as varchar), case doc_id % 9 when 0 then '.MP4' when 1 then '.txt' else '.jpg' end)
            as original_path,
          text as content, case when n_chars < 100 then 'too short' else '' end as read_error, lang, source,
          n_chars, doc_id % 10 as archive_id
        from {documents}""",
    "media": """
        select o_orderkey as id, o_custkey as parent_id,
          case when o_custkey % 3 = 0 then null else o_custkey % 40 end as identity_id,
          o_orderpriority = '1-URGENT' as identity_is_representative, o_orderdate as captured_at,
          o_orderkey % 13 as predicted_taxon_id,
          case when o_orderkey % 9 = 0 then null else o_orderkey % 12 end as taxon_id,
          case when o_orderstatus = 'F' then true when o_orderstatus = 'O' then false else null end as taxon_verified,
          case when o_orderkey % 10 = 0 then null else o_orderkey % 100 end as locality_id,
          case o_orderkey % 4 when 0 then 'L' when 1 then 'R' when 2 then 'F' else 'B' end as orientation,
          case when o_orderkey % 7 = 0 then 'video' else 'image' end as media_type,
          case when o_orderkey % 6 = 0 then o_custkey % 25 else null end as updated_by_id,
          o_orderkey // 4 as sequence_id, o_totalprice as total,
          concat('upload_', cast(o_custkey as varchar), '/IMG_', cast(o_orderkey as varchar), '.JPG') as original_filename
        from {orders}""",
    "observations": """
        select l_orderkey as mediafile_id, l_linenumber as obs_no,
          case when l_partkey % 5 = 0 then null else l_partkey % 12 end as taxon_id,
          case when l_returnflag = 'R' then true when l_returnflag = 'N' then false else null end as taxon_verified
        from {lineitem}""",
    "taxa": """
        select cast(n_nationkey as bigint) as id, case n_nationkey when 0 then 'Not Classified' when 1 then 'Animalia'
            when 2 then 'Nothing' when 3 then 'Lynx lynx' when 4 then 'Homo sapiens' else n_name end as name
        from {nation}""",
    "archives": """
        select c_custkey as id, concat(c_name, '_2021-0', cast(1 + c_custkey % 9 as varchar), '-1', cast(c_custkey % 10 as varchar)) as name,
          cast(c_nationkey as bigint) as owner_id, c_custkey % 2 = 0 as contains_single_taxon,
          c_custkey % 5 = 0 as contains_identities,
          case when c_custkey % 4 = 0 then null else c_custkey % 12 end as taxon_for_identification_id,
          case c_custkey % 9 when 0 then 'C' when 1 then 'F' when 2 then 'TAIP' when 3 then 'TAID' when 4 then 'TKN'
            when 5 then 'TV' when 6 then 'TAID' when 7 then 'Taxa known' else 'XX' end as taxon_status,
          case c_custkey % 5 when 0 then 'IR' when 1 then 'IAIP' when 2 then 'IAID' when 3 then 'U' else 'IR' end
            as identification_status,
          c_custkey % 50 as mediafiles_at_upload, 'imported' as status_message,
          case when c_custkey % 8 = 0 then null else c_custkey % 100 end as locality_id,
          c_acctbal as balance
        from {customer}""",
    "users": """
        select cast(n_nationkey as bigint) as id, n_name as username,
          case when n_nationkey % 11 = 0 then null else cast(n_regionkey as bigint) end as workgroup_id,
          n_nationkey % 5 = 0 as workgroup_admin
        from {nation}""",
    "workgroups": """
        select cast(r_regionkey as bigint) as id, r_name as name, case when r_regionkey = 4 then null else r_regionkey + 2 end as default_taxon_id,
          r_regionkey % 2 = 0 as identification_initiated
        from {region}""",
    "identities": """
        select c_custkey as id, c_name as name, cast(c_nationkey as bigint) as owner_id,
          cast(c_nationkey % 5 as bigint) as owner_workgroup_id, c_mktsegment as coat_text,
          case c_custkey % 4 when 0 then 'S' when 1 then 'M' when 2 then 'N' else 'U' end as coat_type,
          case c_custkey % 3 when 0 then 'M' when 1 then 'F' else 'U' end as sex,
          case when c_custkey % 6 = 0 then null else concat('B', cast(c_custkey as varchar)) end as code,
          case when c_custkey % 7 = 0 then null else concat('J', cast(c_custkey as varchar)) end as juv_code,
          concat('note ', cast(c_custkey as varchar)) as note,
          case when c_custkey % 5 = 0 then null else date '2010-01-01' + cast(c_custkey % 3000 as int) end as birth_date
        from {customer}""",
    "localities": """
        select s_suppkey as id, s_name as name, cast(s_nationkey as bigint) as owner_id,
          case when s_suppkey % 17 = 0 then null else concat(cast(48 + (s_suppkey * 37 % 500) / 1000e0 as varchar), ',',
            cast(13 + (s_suppkey * 53 % 500) / 1000e0 as varchar)) end as location,
          concat('note ', cast(s_suppkey as varchar)) as note,
          case when s_suppkey % 4 = 0 then null else cast(s_nationkey as bigint) end as area_id
        from {supplier}""",
    "areas": """
        select cast(n_nationkey as bigint) as id, n_name as name, concat(cast(48 + (n_nationkey * 7 % 25) / 50e0 as varchar), ',',
          cast(13 + (n_nationkey * 11 % 25) / 50e0 as varchar)) as location
        from {nation}""",
    "gallery": """
        select vec_id as ref_id, embedding, cast(label as bigint) as identity, vec_id % 5 = 0 as is_query,
          vec_id // 4 as sequence_id, vec_id % 3 as organization_id,
          concat('/data/masked_images/', cast(vec_id as varchar), '.jpg') as path
        from {embeddings}""",
    "names": """
        select min(doc_id) as id, name, min(doc_id) % 2 as workgroup_id, count(*) as n_media,
          case when min(doc_id) % 3 = 0 then null else concat('B', cast(min(doc_id) // 2 as varchar)) end as code
        from (select doc_id, lower(concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2))) as name from {documents}) as n
        where length(name) > 3 group by name""",
    "files": """
        select p_partkey as media_id, concat('IMG_', upper(p_name), '.jpg') as original_filename,
          p_partkey % 2 as workgroup_id
        from {part}""",
    "file_identities": """
        select distinct split_part(p_name, ' ', 2) as name,
          case when split_part(p_name, ' ', 1) = 'red' then null else split_part(p_name, ' ', 1) end as code
        from {part}""",
    # one detection per row; a media file has as many rows as the detector found animals
    "detections": """
        select l_orderkey as mediafile_id, l_linenumber as det_no, l_partkey as part_no, l_suppkey as supp_no,
          l_linenumber * 10 as x_min, l_linenumber * 5 as y_min, l_linenumber * 10 + l_quantity as x_max,
          l_linenumber * 5 + l_quantity * 2 as y_max, l_discount * 10 + 0.0e0 as confidence,
          case l_returnflag when 'A' then 'animal' when 'N' then 'person' else 'vehicle' end as class,
          400 as img_h, 600 as img_w,
          case l_linestatus when 'F' then case when l_linenumber % 2 = 0 then 'left' else 'front' end
            else case when l_linenumber % 2 = 0 then 'right' else 'tail' end end as orientation,
          l_tax * 10 + 0.0e0 as orientation_score
        from {lineitem}""",
    "album_media": "select l_suppkey % 50 as album_id, l_orderkey as mediafile_id from {lineitem}",
    "album_shares": "select s_suppkey % 50 as album_id, cast(s_nationkey as bigint) as user_id from {supplier}",
    "notifications": """
        select event_id as id, user_id, event_id % 3 as level, event_id % 2 = 0 as read, ts as created_at,
          concat('Notice ', event_type, ' ', cast(event_id % 50 as varchar)) as message
        from {events}""",
    # text tags and reading times of files whose capture time is not known yet
    "tagged": """
        select event_id as media_id,
          case when event_id % 6 = 0 then replace(substr(cast(ts as varchar), 1, 19), '-', ':') end as quicktime_create,
          case when event_id % 4 = 1 then replace(substr(cast(ts as varchar), 1, 19), '-', ':')
            when event_id % 4 = 2 then '0000-00-00 00:00:00' end as exif_create,
          case when event_id % 3 = 0 then replace(substr(cast(ts as varchar), 1, 19), '-', ':') end as exif_original,
          case event_id % 5
            when 0 then concat('CAM 01/', lpad(cast(1 + event_id % 28 as varchar), 2, '0'), '/2022 ', cast(1 + event_id % 12 as varchar), ':07 PM 12C')
            when 1 then concat('30Sec 2021/05/', lpad(cast(1 + event_id % 28 as varchar), 2, '0'), ' 7:0', cast(event_id % 10 as varchar), ':33')
            else 'no date here' end as ocr_text,
          ts as modified_at, user_id as owner_id, event_type as location
        from {events}""",
}


def _spark_text(sql: str) -> str:
    return sql.replace("//", "div").replace("varchar", "string")


class Tables:
    """Driver tables and camera-trap views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def __getattr__(self, view: str) -> DataFrame:
        if view not in VIEWS:
            raise AttributeError(view)
        sql = _spark_text(VIEWS[view])
        sources = {name: self.raw(name) for name in re.findall(r"\{(\w+)\}", sql)}
        df = self.spark.sql(sql, **sources)
        # the files carry wall-clock timestamps without zone; the session zone is UTC
        for field in df.schema.fields:
            if field.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(field.name, df[field.name].cast("timestamp"))
        return df


# Views used by the checking SQL only: joins that the Spark side builds with operators.
ORACLE_VIEWS: dict[str, str] = {
    "owned": """
        select m.*, a.owner_id, u.workgroup_id as owner_workgroup_id, a.contains_single_taxon, a.contains_identities,
          a.taxon_for_identification_id, a.taxon_status, a.identification_status
        from media m left join archives a on a.id = m.parent_id left join users u on u.id = a.owner_id""",
    "valid_obs": """
        select o.* from observations o join taxa x on x.id = o.taxon_id
        where x.name <> 'Not Classified' and not (x.name = 'Animalia' and coalesce(o.taxon_verified = false, false))""",
    "missing_taxon": """
        select * from owned where not contains_single_taxon and id not in (select mediafile_id from valid_obs)""",
    "missing_verification": """
        select * from owned where not contains_single_taxon
          and id in (select mediafile_id from observations where coalesce(taxon_verified, false) = false)""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names, as common table expressions."""
    texts = {**{k: re.sub(r"[{}]", "", v) for k, v in VIEWS.items()}, **ORACLE_VIEWS}
    body = sql.strip()
    used: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in texts:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                pending.append(texts[name])
    ctes = ",\n".join(f"{name} as ({texts[name].strip()})" for name in texts if name in used)
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
