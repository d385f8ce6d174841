"""Queries over orders: sequences, windows, top lists, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.functions import text as X
from trapline.operators import dedup, media, ordered, ranking, sequences
from trapline.plans.registry import query

PER_LOCALITY = """
    with g as (select *, captured_at - lag(captured_at) over (partition by location order by captured_at, media_id) as gap
      from shots where captured_at is not null),
    n as (select *, cast(sum(case when gap > interval 120 second then 1 else 0 end) over (partition by location order by captured_at, media_id) as bigint) as sequence_number from g)"""

REFERENCE = """
    with g as (select *, epoch_us(captured_at) - lag(epoch_us(captured_at)) over (order by location desc, captured_at, annotated desc, media_id) as gap
      from {src} where captured_at is not null),
    n as (select *, cast(sum(case when gap < 0 or gap > 120000000 then 1 else 0 end) over (order by location desc, captured_at, annotated desc, media_id rows unbounded preceding) as bigint) as sequence_number from g)"""


@query(
    "win1_sequence_summary",
    f"""{PER_LOCALITY} select location, sequence_number, count(*) as shots, epoch_us(min(captured_at)) as first_us, epoch_us(max(captured_at)) as last_us,
          (epoch_us(max(captured_at)) - epoch_us(min(captured_at))) / 1e6 as duration_s from n group by 1, 2""",
)
def _(t):
    return sequences.sequence_summary(t.shots)


@query(
    "win1_sequences_per_locality",
    f"""{PER_LOCALITY} select s.media_id, n.sequence_number from shots s left join n using (media_id)""",
)
def _(t):
    return sequences.number_sequences(t.shots).select("media_id", "sequence_number")


@query(
    "win1_sequences_whole_frame",
    f"{REFERENCE.format(src='shots')} select s.media_id, n.sequence_number from shots s left join n using (media_id)",
)
def _(t):
    return sequences.number_sequences(t.shots, annotated="annotated", mode="reference").select("media_id", "sequence_number")


@query(
    "win1_sequences_of_workgroups",
    """with s as (select media_id, concat(cast(workgroup_id as varchar), '/', location) as place, workgroup_id % 3 * 3600 as lim, epoch_us(captured_at) as us from shots where captured_at is not null),
      g as (select *, us - lag(us) over (partition by place order by us, media_id) as gap from s)
    select media_id, cast(sum(case when gap > lim * 1000000 then 1 else 0 end) over (partition by place order by us, media_id rows unbounded preceding) as bigint) as sequence_number from g""",
)
def _(t):
    """Every workgroup has a limit of its own, one of them 0."""
    rows = t.shots.filter("captured_at is not null").withColumns(
        {"location": F.concat(F.col("workgroup_id").cast("string"), F.lit("/"), F.col("location")), "limit": F.col("workgroup_id") % 3 * 3600}
    )
    return sequences.number_sequences(rows, limit_s="limit").select("media_id", "sequence_number")


@query(
    "win2_delta_to_previous",
    f"{REFERENCE.format(src='shots')} select s.media_id, n.gap / 1e6 as delta_seconds from shots s left join n using (media_id)",
)
def _(t):
    numbered = sequences.number_sequences(t.shots, annotated="annotated", mode="reference", with_delta=True)
    return numbered.select("media_id", "delta_seconds")


@query(
    "win3_unlocated_shots",
    """with s as (select media_id, case when media_id % 19 = 0 then null else location end as location, captured_at from shots),
      g as (select *, captured_at - lag(captured_at) over (partition by location order by captured_at, media_id) as gap from s where captured_at is not null),
      n as (select *, cast(sum(case when gap > interval 480 second then 1 else 0 end) over (partition by location order by captured_at, media_id) as bigint) as number from g)
    select s.media_id, case when s.location is null then -1 else n.number end as sequence_number from s left join n using (media_id)""",
)
def _(t):
    shots = t.shots.withColumn("location", F.when(F.col("media_id") % 19 != 0, F.col("location")))
    return sequences.unlocated_as_minus_one(sequences.number_sequences(shots, limit_s=480)).select("media_id", "sequence_number")


@query(
    "win4_sequence_entities",
    f"""{PER_LOCALITY}, s as (select sh.media_id, sh.archive_id, n.sequence_number from shots sh left join n using (media_id)),
      k as (select archive_id, count(distinct sequence_number) as known from s group by 1)
    select s.archive_id, s.media_id, coalesce(s.sequence_number, k.known + row_number() over (partition by s.archive_id, s.sequence_number is null order by s.media_id) - 1) as local_id
    from s join k using (archive_id)""",
)
def _(t):
    entities = sequences.sequence_entities(sequences.number_sequences(t.shots), "archive_id", "sequence_number", "media_id")
    return entities.select("archive_id", "media_id", "local_id")


HASHED = """with h as (select *, sha256(content) as content_hash, case when media_id % 5 = 0 then null else concat('name', cast(media_id % 30 as varchar)) end as unique_name from uploads)"""


def hashed(t):
    name = F.when(F.col("media_id") % 5 != 0, F.concat(F.lit("name"), (F.col("media_id") % 30).cast("string")))
    return t.uploads.select(
        "media_id", "archive_id", X.content_hash(F.col("content")).alias("content_hash"), name.alias("unique_name"),
        (F.col("media_id") % 2 == 0).alias("annotated"), F.col("lang").alias("location"),
        F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, int(media_id % 40))").alias("captured_at"),
    )


@query(
    "win5_name_of_duplicates",
    f"""{HASHED} select media_id, count(*) over (partition by content_hash) as copies,
          case when count(*) over (partition by content_hash) > 1 then coalesce(max(unique_name) over (partition by content_hash), unique_name) else unique_name end as shared_name from h""",
)
def _(t):
    return dedup.name_of_duplicates(hashed(t), "content_hash", "unique_name", "media_id").select("media_id", "copies", "shared_name")


@query(
    "jn14_duplicate_partners",
    f"""{HASHED} select media_id, min(media_id) over (partition by content_hash) as first_copy from h""",
)
def _(t):
    from trapline.operators.skew import attach

    rows = hashed(t).select("media_id", "content_hash")
    firsts = rows.groupBy("content_hash").agg(F.min("media_id").alias("first_copy"), F.count(F.lit(1)).alias("copies"))
    return attach(rows, firsts, ["content_hash"], F.col("media_id"), weight="copies").select("media_id", "first_copy")


@query("win6_first_of_sequence", "select id, sequence_id, epoch_us(min(captured_at) over (partition by sequence_id)) as first_us from media")
def _(t):
    rows = ranking.first_of_sequence(t.media, "sequence_id", "captured_at", "id")
    return rows.select("id", "sequence_id", F.unix_micros("first_in_sequence").alias("first_us")).orderBy("first_us", "sequence_id", "id")


@query("win7_next_media", "select id, lead(id) over (order by captured_at desc, id) as next_id from media")
def _(t):
    return ordered.next_over_all(t.media.select("id", "captured_at"), [F.col("captured_at").desc(), F.col("id")], F.col("id"), "next_id").select("id", "next_id")


SUGGESTED = """select ref_id as id, ref_id * 10 + n as suggestion_id, (ref_id + n * 7) % 40 as identity_id, (ref_id * 3 + n) % 500 as hit_id, cast(embedding[n + 1] as double) as score
  from gallery, (select unnest([0, 1, 2]) as n) where is_query"""


def suggestions(t):
    n = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")
    return t.gallery.filter("is_query").select("ref_id", "embedding", n).select(
        F.col("ref_id").alias("for_id"), (F.col("ref_id") * 10 + F.col("n")).alias("suggestion_id"),
        ((F.col("ref_id") + F.col("n") * 7) % 40).alias("identity_id"), ((F.col("ref_id") * 3 + F.col("n")) % 500).alias("hit_id"),
        F.element_at("embedding", F.col("n") + 1).cast("double").alias("score"),
    )


def queue(t):
    return t.gallery.select(F.col("ref_id").alias("id"))


@query(
    "win8_next_in_queue",
    f"""with s as ({SUGGESTED}), q as (select g.ref_id as id, coalesce(max(s.score), 0e0) as max_score from gallery g left join s on s.id = g.ref_id group by 1)
    select id, max_score, lead(id) over (order by max_score desc, id) as next_id from q""",
)
def _(t):
    return ranking.next_in_queue(queue(t), suggestions(t))


SCORED = "select ref_id, sequence_id, identity, cast(embedding[1] as double) as score, ref_id % 3 as best_ref, cast(embedding[64] as double) as mark from gallery"


@query(
    "win9_best_of_sequence",
    f"""with s as ({SCORED}),
    t as (select *, row_number() over (partition by sequence_id order by score desc, ref_id) as rn from s),
    f as (select sequence_id, best_ref, count(*) as n, row_number() over (partition by sequence_id order by count(*) desc, best_ref) as rn from s group by 1, 2),
    u as (select s.*, row_number() over (partition by s.sequence_id order by score desc, ref_id) as rn from s join f on f.sequence_id = s.sequence_id and f.best_ref = s.best_ref and f.rn = 1)
    select s.ref_id, t.mark as top_score_mark, u.mark as top_frequent_mark from s join t on t.sequence_id = s.sequence_id and t.rn = 1
      join u on u.sequence_id = s.sequence_id and u.rn = 1""",
)
def _(t):
    from trapline.operators.similarity import best_of_sequence

    rows = t.gallery.select(
        "ref_id", "sequence_id", F.col("embedding")[0].cast("double").alias("score"), (F.col("ref_id") % 3).alias("best_ref"),
        F.slice("embedding", 64, 1).alias("vector"),
    )
    a = best_of_sequence(rows, "sequence_id", "vector", "score", "best_ref", "ref_id", "top_score").select("ref_id", F.col("vector")[0].cast("double").alias("top_score_mark"))
    b = best_of_sequence(rows, "sequence_id", "vector", "score", "best_ref", "ref_id", "top_frequent").select("ref_id", F.col("vector")[0].cast("double").alias("top_frequent_mark"))
    return a.join(b, "ref_id")


FRAMES = """select mediafile_id as video_id, part_no as frame, det_no, supp_no, confidence, x_max - x_min as w, y_max - y_min as h from detections"""


@query(
    "win10_video_key_frame",
    f"""with f as ({FRAMES}),
    b as (select *, row_number() over (partition by video_id, frame order by confidence desc, det_no, supp_no) as rn from f),
    a as (select *, row_number() over (partition by video_id order by w * h / (400 * 600) desc, frame desc) as ra from b where rn = 1 and w * h > 0),
    r as (select *, row_number() over (partition by video_id order by w / h desc, ra) as rr from a where ra <= 24)
    select m.id as video_id, coalesce(r.frame, 0) as key_frame from media m left join r on r.video_id = m.id and r.rr = 1""",
)
def _(t):
    from trapline.operators.frames import key_frames

    frames = t.detections.select(
        F.col("mediafile_id").alias("video_id"), F.col("part_no").alias("frame"), F.struct("det_no", "supp_no").alias("detection"), "confidence",
        (F.col("x_max") - F.col("x_min")).alias("w"), (F.col("y_max") - F.col("y_min")).alias("h"),
        F.lit(400).alias("size_0"), F.lit(600).alias("size_1"),
    )
    return key_frames(t.media.select(F.col("id").alias("video_id")), frames)


@query(
    "win11_clip_window",
    """with v as (select id, 20 + id % 50 as n, id % 47 as c from media),
    a as (select *, c - 8 as s0, c + 7 as e0 from v), b as (select *, greatest(s0, 0) as s1, e0 + greatest(-s0, 0) as e1 from a),
    d as (select *, case when e1 > n - 1 then s1 + (n - 1 - e1) else s1 end as s, least(e1, n - 1) as e from b)
    select id, case when 15 > n then 0 else s end as start_frame, case when 15 > n then n else e end as end_frame from d""",
)
def _(t):
    from trapline.operators.frames import clip_window

    start, end = clip_window(F.col("c"), F.col("n"), 15)
    rows = t.media.select("id", (F.col("id") % 50 + 20).alias("n"), (F.col("id") % 47).alias("c"))
    return rows.select("id", start.alias("start_frame"), end.alias("end_frame"))


@query(
    "win12_capture_trace",
    """with p as (select media_id, captured_at, 48 + (owner_id * 37 % 500) / 1000e0 as lat from shots where captured_at is not null),
      o as (select *, row_number() over (order by captured_at, media_id) as step, count(*) over () as n, lead(lat) over (order by captured_at, media_id) as next_lat from p)
    select media_id, step, next_lat, step > n - 2 as last_segment from o""",
)
def _(t):
    from trapline.operators.frames import capture_trace

    points = t.shots.filter("captured_at is not null").select("media_id", "captured_at", (F.lit(48) + (F.col("owner_id") * 37 % 500) / 1000).alias("lat"))
    return capture_trace(points, "captured_at", "media_id", "lat").select("media_id", "step", F.col("next").alias("next_lat"), "last_segment")


# ---- top lists ------------------------------------------------------------------------------


@query(
    "top_1_sorted_identities",
    """select i.id, i.name, count(m.id) as mediafile_count from identities i left join media m on m.identity_id = i.id group by 1, 2""",
)
def _(t):
    from trapline.operators.rollups import identity_rollup

    rolled = identity_rollup(t.identities, t.media).select("id", "name", "mediafile_count")
    return ranking.sort_by(rolled, "mediafile_count", "desc", ["name", "mediafile_count"], "id")


@query("top_2_page", "select media_id, owner_id from shots order by captured_at desc nulls last, media_id limit 24 offset 72")
def _(t):
    order = [F.col("captured_at").desc_nulls_last(), F.col("media_id")]
    return ranking.page(t.shots.select("media_id", "owner_id", "captured_at"), order, 4, 24).select("media_id", "owner_id")


@query("top_3_default_order", "select media_id, identity_is_representative from shots")
def _(t):
    return ranking.default_order(t.shots, "media_id").select("media_id", "identity_is_representative")


@query(
    "top_4_best_representatives",
    """with r as (select identity_id, id, case when identity_is_representative and orientation = 'L' then 0 when identity_is_representative then 1 else 2 end as tier, captured_at
        from media where identity_id is not null),
      b as (select *, min(tier) over (partition by identity_id) as best from r),
      n as (select *, row_number() over (partition by identity_id order by captured_at desc, id) as position from b where tier = best)
    select identity_id, id, tier, position from n where position <= 5""",
)
def _(t):
    best = ranking.best_representatives(t.media, "L")
    return best.select("identity_id", "id", "tier", F.col("position").cast("long").alias("position"))


@query(
    "top_5_suggestion_card",
    f"""with s as ({SUGGESTED}), r as (select identity_id, id, row_number() over (partition by identity_id order by captured_at desc, id) as p from media
        where identity_id is not null and identity_is_representative),
      u as (select suggestion_id, hit_id as media_id, 0 as rank from s union all
        select s.suggestion_id, r.id, r.p from s join r on r.identity_id = s.identity_id and r.p <= 5 where r.id <> s.hit_id),
      n as (select *, row_number() over (partition by suggestion_id order by rank) as position from u)
    select suggestion_id, media_id, position from n where position <= 5""",
)
def _(t):
    newest = [F.col("captured_at").desc(), F.col("id")]
    reps = ranking.top_per_group(t.media.filter("identity_id is not null and identity_is_representative"), ["identity_id"], newest, 5)
    card = ranking.suggestion_card(suggestions(t), reps.select("identity_id", "id", "position"))
    return card.select("suggestion_id", "media_id", F.col("position").cast("long").alias("position"))


@query(
    "top_6_remaining_identities",
    f"""with s as ({SUGGESTED}), m as (select identity_id, id as media_id, row_number() over (partition by identity_id order by captured_at, id) as position from media where identity_id is not null)
    select i.id, i.name, m.media_id, m.position from identities i left join m on m.identity_id = i.id and m.position <= 3
    where i.name <> 'nan' and i.id not in (select identity_id from s where score > 0)""",
)
def _(t):
    left = ranking.remaining_identities(t.identities.select("id", "name"), suggestions(t).filter("score > 0"), t.media)
    return left.select("id", "name", "media_id", F.col("position").cast("long").alias("position")).orderBy("name", "id", "position")


@query(
    "top_7_identification_queue",
    f"with s as ({SUGGESTED}) select g.ref_id as id, max(s.score) as max_score from gallery g left join s on s.id = g.ref_id group by 1",
)
def _(t):
    return ranking.identification_queue(queue(t), suggestions(t))


@query("top_8_newest_unlabelled", "select id, parent_id from missing_taxon order by parent_id desc, captured_at desc, id limit 1")
def _(t):
    from trapline.plans.relational import flags, owned

    return ranking.newest_unlabelled(media.missing_taxon(owned(t), flags(t)), "parent_id").select("id", "parent_id")


DEDUP_ORDER = "media_id % 2 = 0 desc, lang desc, media_id % 40, media_id"


@query("top_11_metadata_order", "select media_id, media_id % 2 = 0 as annotated, lang as location from uploads")
def _(t):
    return hashed(t).orderBy(*dedup.metadata_order("media_id")).select("media_id", "annotated", "location")


@query(
    "set1_content_dedup",
    f"""with r as (select media_id, row_number() over (partition by sha256(content) order by {DEDUP_ORDER}) as rn from uploads)
    select media_id, rn > 1 as duplicate from r""",
)
def _(t):
    return dedup.mark_duplicates(hashed(t), "content_hash", "media_id", dedup.metadata_order("media_id")).select("media_id", "duplicate")


@query(
    "set1_duplicates_table",
    f"""with r as (select media_id, row_number() over (partition by sha256(content) order by {DEDUP_ORDER}) as rn from uploads)
    select media_id from r where rn > 1""",
)
def _(t):
    _kept, others = dedup.split_duplicates(hashed(t), "content_hash", "media_id", dedup.metadata_order("media_id"))
    return others.select("media_id")
