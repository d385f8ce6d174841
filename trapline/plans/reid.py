"""Queries over embeddings and model outputs: search, calibration, fusion, splits."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from trapline.functions import arrays as A
from trapline.operators import calibration, modelout, similarity, splits
from trapline.plans.registry import query
from trapline.plans.relational import named

SHORTLIST = 10

COSINES = """
    with v as (select ref_id, identity, is_query, sequence_id, path, list_transform(embedding, lambda x: cast(x as double)) as e from gallery),
    u as (select *, sqrt(list_dot_product(e, e)) as n, e[1:32] as a, e[33:64] as b from v),
    c as (select q.ref_id as query_id, g.ref_id, q.identity as query_identity, g.identity, q.sequence_id as query_sequence, g.sequence_id, g.path,
        list_dot_product(q.e, g.e) / (q.n * g.n) as score, list_dot_product(q.a, g.a) / sqrt(list_dot_product(q.a, q.a)) / sqrt(list_dot_product(g.a, g.a)) as score_a,
        list_dot_product(q.b, g.b) / sqrt(list_dot_product(q.b, q.b)) / sqrt(list_dot_product(g.b, g.b)) as score_b
      from u q join u g on q.is_query and not g.is_query),
    s as (select *, row_number() over (partition by query_id order by score desc, ref_id) as position from c)"""
SHORT = f"{COSINES}, k as (select * from s where position <= {SHORTLIST})"


def roles(t):
    rows = t.gallery
    return rows.filter("is_query"), rows.filter("not is_query")


def shortlisted(t, **options):
    return similarity.shortlist(*roles(t), SHORTLIST, **options)


def labelled(t):
    """Shortlisted pairs with labels, sequences and embeddings of both sides."""
    q, g = roles(t)
    return similarity.with_features(shortlisted(t), q, g, ["identity", "sequence_id", "embedding"])


@query("sim3_top_shortlist", f"{SHORT} select query_id, ref_id, position, score from k")
def _(t):
    rows = shortlisted(t)
    return rows.select("query_id", "ref_id", F.col("position").cast("long").alias("position"), "score")


@query("sim4_blocked_priority", f"{SHORT} select query_id, ref_id, score from k")
def _(t):
    """Small blocks, so that many partial lists are merged; the result is that of one block."""
    return shortlisted(t, block_rows=64).select("query_id", "ref_id", "score")


@query("top_10_nearest_gallery_image", f"{COSINES} select query_id, ref_id from s where position = 1")
def _(t):
    return similarity.shortlist(*roles(t), 1).select("query_id", "ref_id")


@query("sim1_cosine", f"{SHORT} select query_id, ref_id, score as cosine from k")
def _(t):
    return labelled(t).select("query_id", "ref_id", similarity.cosine(F.col("q_embedding").cast("array<double>"), F.col("r_embedding").cast("array<double>")).alias("cosine"))


@query("jn9_query_gallery_blocks", f"{COSINES} select query_id, max(score) as best, min(score) filter (position <= {SHORTLIST}) as last_kept from s group by 1")
def _(t):
    """Every query meets the whole gallery in tiles of 32 rows; what leaves the tiles is the shortlist."""
    return shortlisted(t, block_rows=32).groupBy("query_id").agg(F.max("score").alias("best"), F.min("score").alias("last_kept"))


@query("jn10_given_pairs", f"{SHORT} select query_id, ref_id, query_identity as q_identity, identity as r_identity, query_sequence as q_sequence_id, sequence_id as r_sequence_id from k")
def _(t):
    return labelled(t).select("query_id", "ref_id", "q_identity", "r_identity", "q_sequence_id", "r_sequence_id")


@query("sim2_pair_hits", f"{SHORT} select query_id, ref_id, query_identity = identity as hit from k")
def _(t):
    return labelled(t).select("query_id", "ref_id", similarity.hits("q_identity", "r_identity").alias("hit"))


def first_half(left, right):
    part = lambda side: F.slice(side, 1, 32)
    return similarity.cosine(part(left), part(right))


def second_half(left, right):
    part = lambda side: F.slice(side, 33, 32)
    return similarity.matcher_column(similarity.row_cosine, part(left), part(right))


def double_vectors():
    return F.col("q_embedding").cast("array<double>"), F.col("r_embedding").cast("array<double>")


@query("sim5_scores_on_shortlist", f"{SHORT} select query_id, ref_id, score_a as score from k")
def _(t):
    return labelled(t).select("query_id", "ref_id", first_half(*double_vectors()).alias("score"))


@query("udf1_matcher_hook", f"{SHORT} select query_id, ref_id, score_b as score from k")
def _(t):
    return labelled(t).select("query_id", "ref_id", second_half(*double_vectors()).alias("score"))


@query("sim10_fused_scores", f"{SHORT} select query_id, ref_id, (score_a + score_b) / 2 as score from k where score_a > 0")
def _(t):
    """Pairs that the first matcher did not score are dropped."""
    first = first_half(*double_vectors())
    scored = labelled(t).select("query_id", "ref_id", similarity.fused([F.when(first > 0, first), second_half(*double_vectors())]).alias("score"))
    return scored.filter("score is not null")


def identified(t):
    pairs = labelled(t).select("query_id", "ref_id", F.col("r_identity").alias("identity"), "score")
    return similarity.top_identities(pairs, 3)


TOP_IDENTITIES = f"""{SHORT}, i as (select *, row_number() over (partition by query_id, identity order by score desc, ref_id) as r from k),
    t as (select query_id, identity, ref_id, score, path, row_number() over (partition by query_id order by score desc, ref_id) as p from i where r = 1)"""


@query("sim11_top_identities", f"{TOP_IDENTITIES} select query_id, identity, ref_id, score, p as position from t where p <= 3")
def _(t):
    rows = identified(t)
    return rows.select("query_id", "identity", "ref_id", "score", F.col("position").cast("long").alias("position"))


@query(
    "sim11_result_arrays",
    f"""{TOP_IDENTITIES}, n as (select query_id, least(max(p), 3) as last from t group by 1), x as (select query_id, last, unnest([1, 2, 3]) as slot from n),
      f as (select x.query_id, x.slot, t.identity, replace(t.path, '/masked_images/', '/images/') as path, greatest(0e0, least(1e0, t.score)) as score
        from x join t on t.query_id = x.query_id and t.p = least(x.slot, x.last))
    select query_id, string_agg(cast(identity as varchar), ',' order by slot) as identities, string_agg(path, ',' order by slot) as paths, sum(score) as total from f group by 1""",
)
def _(t):
    arrays = similarity.result_arrays(identified(t), t.gallery, 3)
    return arrays.select(
        "query_id", F.array_join(F.transform("class_ids", lambda i: i.cast("string")), ",").alias("identities"), F.array_join("paths", ",").alias("paths"),
        F.aggregate("scores", F.lit(0.0), lambda a, s: a + s).alias("total"),
    )


@query(
    "sim12_rerank",
    f"""{SHORT}, i as (select *, row_number() over (partition by query_id, identity order by score desc, ref_id) as r from k),
      b as (select query_id, ref_id, score_b * 100 as local, row_number() over (partition by query_id order by score desc, ref_id) as p from i where r = 1),
      d as (select * from b where p <= 3), l as (select *, row_number() over (partition by query_id order by local desc, p) as lp from d)
    select d.query_id, d.p as position, case when l.local > 20 then l.ref_id else d.ref_id end as ref_id from d join l on l.query_id = d.query_id and l.lp = d.p""",
)
def _(t):
    local = second_half(*double_vectors()) * 100
    rows = labelled(t).select("query_id", "ref_id", F.col("r_identity").alias("identity"), F.col("score").alias("cosine"), local.alias("local"))
    chosen = similarity.rerank(rows, 3, threshold=20.0)
    return chosen.select("query_id", F.col("position").cast("long").alias("position"), "ref_id")


@query(
    "sim13_first_distinct",
    f"""{SHORT}, f as (select query_id, identity, min(position) as position from k group by 1, 2), r as (select *, row_number() over (partition by query_id order by position) as n from f)
    select query_id, identity, position from r where n <= 3""",
)
def _(t):
    q, g = roles(t)
    ranked = similarity.with_features(shortlisted(t), q, g, ["identity"]).withColumnRenamed("r_identity", "identity")
    ranked = ranked.select("query_id", "identity", F.col("position").cast("long").alias("rank"))
    return similarity.first_distinct(ranked, "query_id", "identity", "rank", 3).select("query_id", "identity", F.col("rank").alias("position"))


@query("sim14_decode_labels", f"{SHORT} select k.query_id, k.ref_id, x.name as label from k left join taxa x on x.id = k.identity")
def _(t):
    from trapline.operators.media import lookup

    rows = labelled(t).select("query_id", "ref_id", "r_identity")
    return lookup(rows, t.taxa, "r_identity", "label", ["name"]).select("query_id", "ref_id", F.col("label_name").alias("label"))


def with_identity(t):
    return labelled(t).select("query_id", "ref_id", F.col("r_identity").alias("identity"), "q_identity", "score")


@query("sim15_nearest_neighbour", f"{COSINES} select query_id, identity as predicted from s where position = 1")
def _(t):
    return similarity.nearest_label(with_identity(t), 1)


@query(
    "sim15_label_voting",
    f"""{COSINES}, w as (select query_id, identity, count(*) as n, min(position) as p from s where position <= 5 group by 1, 2),
      r as (select *, row_number() over (partition by query_id order by n desc, p) as rn from w) select query_id, identity as predicted from r where rn = 1""",
)
def _(t):
    return similarity.nearest_label(with_identity(t), 5)


@query("sim16_angles", f"{SHORT} select query_id, ref_id, degrees(acos(greatest(-1e0, least(1e0, score)))) as angle from k")
def _(t):
    vec = lambda side: F.col(f"{side}_embedding").cast("array<double>")
    return labelled(t).select("query_id", "ref_id", similarity.angle(vec("q"), vec("r")).alias("angle"))


@query(
    "sim16_smallest_angle_of_groups",
    """with v as (select ref_id, sequence_id, list_transform(embedding, lambda x: cast(x as double)) as e from gallery)
    select a.sequence_id, min(degrees(acos(greatest(-1e0, least(1e0, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e))))))) as angle
    from v a join v b on a.sequence_id = b.sequence_id and a.ref_id < b.ref_id group by 1""",
)
def _(t):
    return similarity.smallest_angles(t.gallery)


SCOPED = f"""{COSINES}, o as (select s.query_id, s.ref_id, s.score, row_number() over (partition by s.query_id order by s.score desc, s.ref_id) as position
    from s join gallery q on q.ref_id = s.query_id join gallery g on g.ref_id = s.ref_id and g.organization_id = q.organization_id)"""


@query("sim3_shortlist_of_organisation", f"{SCOPED} select query_id, ref_id, score, position from o where position <= {SHORTLIST}")
def _(t):
    """A query only meets the gallery of its own organisation."""
    rows = shortlisted(t, scope="organization_id")
    return rows.withColumn("position", F.col("position").cast("long"))


def _spread(n: int) -> str:
    """One round of passing the smallest label along the edges (three rounds reach all of four vectors)."""
    return f"""l{n} as (select l.ref_id, l.sequence_id, least(l.label, coalesce(min(o.label), l.label)) as label from l{n - 1} l
        left join edge on edge.i = l.ref_id left join l{n - 1} o on o.ref_id = edge.j group by l.ref_id, l.sequence_id, l.label)"""


@query(
    "sim17_sequence_clusters",
    f"""with v as (select ref_id, sequence_id, list_transform(embedding, lambda x: cast(x as double)) as e from gallery),
      u as (select *, sqrt(list_dot_product(e, e)) as n from v),
      pr as (select a.sequence_id, a.ref_id as i, b.ref_id as j, degrees(acos(greatest(-1e0, least(1e0, list_dot_product(a.e, b.e) / (a.n * b.n))))) as angle
        from u a join u b on a.sequence_id = b.sequence_id and a.ref_id <> b.ref_id),
      th as (select u.sequence_id, min(angle) as theta from u left join pr using (sequence_id) group by 1),
      edge as (select pr.* from pr join th using (sequence_id) where angle <= 2 * theta),
      l0 as (select ref_id, sequence_id, ref_id as label from u), {_spread(1)}, {_spread(2)}, {_spread(3)},
      gr as (select pr.sequence_id, a.label, sum(angle) filter (i > j) / greatest(count(*) filter (i > j and angle > 0), 1) as mean
        from pr join l3 a on a.ref_id = i join l3 b on b.ref_id = j and b.label = a.label group by 1, 2),
      best as (select sequence_id, first(label order by mean, label) as label from gr group by 1),
      mem as (select l3.ref_id, l3.sequence_id from best join l3 using (sequence_id, label) join th using (sequence_id) where theta <= 85
        union all select first(u.ref_id order by u.e[1] desc, u.ref_id), sequence_id from u join th using (sequence_id) where theta is null or theta > 85 group by sequence_id),
      un as (select mem.sequence_id, unnest(range(1, 65)) as position, unnest(u.e) as x from mem join u on u.ref_id = mem.ref_id),
      sm as (select sequence_id, position, sum(x) as s from un group by 1, 2)
    select sequence_id, sqrt(sum(s * s)) as length, max(s) filter (position = 1) as first from sm group by 1""",
)
def _(t):
    """One vector per sequence, shown by its length and its first component."""
    rows = t.gallery.select("ref_id", "sequence_id", "embedding", F.col("embedding")[0].cast("double").alias("score"))
    found = similarity.cluster_sequences(rows, limit=85.0)
    return found.select("sequence_id", A.norm(F.col("embedding")).alias("length"), F.col("embedding")[0].alias("first"))


@query("sim18_calibration_rows", "select ref_id, identity from gallery where not is_query order by ref_id limit 50")
def _(t):
    return similarity.calibration_rows(roles(t)[1]).select("ref_id", "identity")


@query(
    "sim18_calibration_rows_of_organisations",
    "select ref_id, organization_id from (select *, row_number() over (partition by organization_id order by ref_id) as n from gallery where not is_query) where n <= 20",
)
def _(t):
    return similarity.calibration_rows(roles(t)[1], 20, scope="organization_id").select("ref_id", "organization_id")


@query(
    "sim19_identification_input",
    """select m.id as mediafile_id, m.identity_id as class_id, i.name as label, m.locality_id, coalesce(l.name, '') as locality_name, l.location as locality_coordinates, m.sequence_id as sequence_number
       from media m left join identities i on i.id = m.identity_id left join localities l on l.id = m.locality_id""",
)
def _(t):
    return similarity.identification_input(named(t))


# ---- calibration ----------------------------------------------------------------------------


def calibration_pairs(t):
    """Every pair of the calibration rows, scored and marked as hit or miss."""
    rows = similarity.calibration_rows(roles(t)[1])
    every = similarity.shortlist(rows, rows, 50)
    paired = similarity.with_features(every, rows, rows, ["identity"])
    return paired.select("query_id", "ref_id", "score", similarity.hits("q_identity", "r_identity").alias("hit"))


@query(
    "sim6_calibration_pairs",
    """with v as (select ref_id, identity, list_transform(embedding, lambda x: cast(x as double)) as e from gallery where not is_query order by ref_id limit 50)
    select a.ref_id as query_id, b.ref_id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) as score, a.identity = b.identity as hit from v a, v b""",
)
def _(t):
    return calibration_pairs(t)


CALIBRATION_PAIRS = """
    cal as (select * from u where not is_query order by ref_id limit 50),
    train as (select round(list_dot_product(x.e, y.e) / (x.n * y.n), 12) as x, (x.identity = y.identity)::int as hit from cal x, cal y)"""

# isotonic fit by its min-max formula, knots, monotone cubic through the middles between them
ISOTONIC = """
    lim as (select min(x) as x0, max(x) as x1, cast(min(hit) as double) as low, cast(max(hit) as double) as high from train),
    tx as (select x, count(*) as w, sum(hit) as h from train group by 1),
    tr as (select row_number() over (order by x) as i, x, sum(w) over (order by x) as cw, sum(h) over (order by x) as ch, w, h from tx),
    tb as (select j.i as j, m.i as m, cast(m.ch - j.ch + j.h as double) / cast(m.cw - j.cw + j.w as double) as mean from tr j join tr m on m.i >= j.i),
    tm as (select j, m, min(mean) over (partition by j order by m desc rows unbounded preceding) as lowest from tb),
    fit as (select m as i, max(lowest) as y from tm group by 1),
    st as (select tr.x, y, lag(y) over (order by tr.i) as py, lead(y) over (order by tr.i) as ny from fit join tr on tr.i = fit.i),
    kn as (select x, y, lead(x) over (order by x) as nx, lead(y) over (order by x) as ny from st where py is null or ny is null or y <> py or y <> ny),
    ax as (select distinct x from (select (x + nx) / 2 as x from kn where nx is not null union all select x0 from lim union all select x1 from lim)),
    ay as (select ax.x, coalesce((select y + (ax.x - kn.x) / (nx - kn.x) * (ny - y) from kn where ax.x >= kn.x and ax.x < nx), (select y from kn where nx is null)) as y from ax),
    d1 as (select x, y, lead(x) over (order by x) - x as h, (lead(y) over (order by x) - y) / (lead(x) over (order by x) - x) as d from ay),
    d2 as (select *, lag(h) over (order by x) as hp, lag(d) over (order by x) as dp, lead(h) over (order by x) as hn, lead(d) over (order by x) as dn,
        lag(h, 2) over (order by x) as hpp, lag(d, 2) over (order by x) as dpp from d1),
    d3 as (select *, case when hp is null then ((2 * h + hn) * d - h * dn) / (h + hn) when h is null then ((2 * hp + hpp) * dp - hp * dpp) / (hp + hpp)
        when dp * d > 0 then ((2 * h + hp) + (h + 2 * hp)) / ((2 * h + hp) / dp + (h + 2 * hp) / d) else 0 end as raw,
        case when hp is null then d when h is null then dp end as own, case when hp is null then dn when h is null then dpp end as other from d2),
    d4 as (select x, y, case when own is null then raw when raw * own <= 0 then 0 when own * other < 0 and abs(raw) > 3 * abs(own) then 3 * own else raw end as s from d3),
    iv as (select x, y, s, lead(x) over (order by x) as nx, lead(y) over (order by x) as ny, lead(s) over (order by x) as ns from d4)"""


@query(
    "sim7_isotonic_scores",
    f"""{SHORT}, {CALIBRATION_PAIRS}, {ISOTONIC},
    ev as (select k.query_id, k.ref_id, k.score, (k.score - iv.x) / (iv.nx - iv.x) as t, iv.nx - iv.x as h, iv.y, iv.s, iv.ny, iv.ns
      from k left join iv on iv.nx is not null and k.score >= iv.x and k.score < iv.nx)
    select ev.query_id, ev.ref_id, case when ev.score < lim.x0 then lim.low when ev.score >= lim.x1 then lim.high
        else (1 + 2 * t) * (1 - t) ** 2 * y + t * (1 - t) ** 2 * h * s + t ** 2 * (3 - 2 * t) * ny + t ** 2 * (t - 1) * h * ns end as score from ev, lim""",
)
def _(t):
    model = calibration.fit_isotonic(calibration_pairs(t))
    return calibration.calibrated(shortlisted(t).select("query_id", "ref_id", "score"), model)


@query("sim8_logistic_scores")
def _(t):
    model = calibration.fit_logistic(calibration_pairs(t))
    return shortlisted(t).select("query_id", "ref_id", model.predict(F.col("score")).alias("score"))


def tagged(sql: str, tag: str) -> str:
    """The calibration SQL under other names, for a second matcher."""
    names = r"\b(train|lim|tx|tr|tb|tm|fit|st|kn|ax|ay|d[1-4]|iv)\b"
    return re.sub(names, rf"\1_{tag}", sql)


def half_training(half: str, tag: str) -> str:
    cos = f"list_dot_product(x.{half}, y.{half}) / sqrt(list_dot_product(x.{half}, x.{half})) / sqrt(list_dot_product(y.{half}, y.{half}))"
    return f"train_{tag} as (select round({cos}, 12) as x, (x.identity = y.identity)::int as hit from cal x, cal y)"


def predicted(half: str) -> str:
    t, h = f"((k.score_{half} - iv_{half}.x) / (iv_{half}.nx - iv_{half}.x))", f"(iv_{half}.nx - iv_{half}.x)"
    curve = f"(1 + 2 * {t}) * (1 - {t}) ** 2 * y + {t} * (1 - {t}) ** 2 * {h} * s + {t} ** 2 * (3 - 2 * {t}) * ny + {t} ** 2 * ({t} - 1) * {h} * ns"
    return f"""p_{half} as (select k.query_id, k.ref_id, case when k.score_{half} < lim_{half}.x0 then lim_{half}.low when k.score_{half} >= lim_{half}.x1 then lim_{half}.high else {curve} end as score
        from k cross join lim_{half} left join iv_{half} on iv_{half}.nx is not null and k.score_{half} >= iv_{half}.x and k.score_{half} < iv_{half}.nx)"""


@query(
    "sim9_calibrated_fusion",
    f"""{SHORT}, cal as (select * from u where not is_query order by ref_id limit 50), {half_training('a', 'a')}, {half_training('b', 'b')},
      {tagged(ISOTONIC, 'a')}, {tagged(ISOTONIC, 'b')}, {predicted('a')}, {predicted('b')}
    select query_id, ref_id, (p_a.score + p_b.score) / 2 as score from p_a join p_b using (query_id, ref_id)""",
)
def _(t):
    """Shortlist, two calibrated matchers, mean."""
    return calibrated_fusion(t).select("query_id", "ref_id", "score")


def calibrated_fusion(t):
    q, g = roles(t)
    rows = similarity.calibration_rows(g)
    train = similarity.with_features(similarity.shortlist(rows, rows, 50), rows, rows, ["identity", "embedding"])
    matchers = [first_half, second_half]
    hit = similarity.hits("q_identity", "r_identity").alias("hit")
    models = [calibration.fit_isotonic(train.select(m(*double_vectors()).alias("score"), hit)) for m in matchers]
    return similarity.fused_scores(q, g, matchers, models, SHORTLIST)


@query("udf2_calibrator_hook", f"{SHORT} select query_id, ref_id, (1 / (1 + exp(-(4 * score_a + 1))) + score_b) / 2 as score from k")
def _(t):
    """A caller's calibration is anything with ``predict(Column)``; the second matcher stays uncalibrated."""
    q, g = roles(t)
    models = [calibration.LogisticCalibration(4.0, 1.0), None]
    return similarity.fused_scores(q, g, [first_half, second_half], models, SHORTLIST).select("query_id", "ref_id", "score")


@query(
    "udf3_sequence_reducer_hook",
    "select ref_id, max(abs(cast(embedding[1] as double))) over (partition by sequence_id) as strongest from gallery",
)
def _(t):
    rows = t.gallery.select("ref_id", "sequence_id", F.col("embedding")[0].cast("double").alias("x"))
    return similarity.reduce_sequences(rows, "sequence_id", "ref_id", F.max(F.abs("x")), "strongest").select("ref_id", "strongest")


@query("sim11_reidentification")
def _(t):
    """The whole chain: shortlist, calibrated matchers, fusion, best distinct identities."""
    top = similarity.top_identities(calibrated_fusion(t), 3)
    return top.select("query_id", "identity", "ref_id", "score", F.col("position").cast("long").alias("position"))


RELIABLE = f"""{SHORT}, h as (select score, query_identity = identity as hit from k where score > 0 and score <= 1),
    b as (select cast(ceil(score * 10) as int) as bin, count(*) as size, avg(hit::int) as hit_rate from h group by 1)"""


@query("spl6_reliability_bins", f"{RELIABLE} select bin, size, hit_rate, bin / 10e0 - 0.05 as center from b")
def _(t):
    rows = with_identity(t).select("score", (F.col("q_identity") == F.col("identity")).alias("hit"))
    return calibration.reliability_bins(rows, "score", "hit")


@query("spl6_calibration_error", f"{RELIABLE} select sum(size * abs(hit_rate - (bin / 10e0 - 0.05))) / sum(size) as ece from b")
def _(t):
    rows = with_identity(t).select("score", (F.col("q_identity") == F.col("identity")).alias("hit"))
    return calibration.calibration_error(calibration.reliability_bins(rows, "score", "hit"))


# ---- model outputs --------------------------------------------------------------------------

LOGITS = """
    with l as (select ref_id, list_transform(embedding[1:10], lambda x: cast(x as double)) as l from gallery),
    e as (select ref_id, list_transform(l, lambda x: exp((x - list_max(l)) / 0.05e0)) as e from l),
    p as (select ref_id, list_transform(e, lambda x: x / list_sum(e)) as p from e)"""
THRESHOLDS = [0.3 + 0.05 * i for i in range(10)]
LABELS = ["Homo sapiens", "Vehicle", *[f"taxon {i}" for i in range(2, 10)]]


def probabilities(t):
    rows = t.gallery.select("ref_id", F.slice("embedding", 1, 10).alias("logits"))
    return modelout.with_probabilities(rows, "logits", 0.05)


@query("post1_softmax", f"{LOGITS} select ref_id, p[1] as first, p[10] as last, list_max(p) as top, list_sum(p) as total from p")
def _(t):
    return probabilities(t).select(
        "ref_id", F.col("probs")[0].alias("first"), F.col("probs")[9].alias("last"), F.array_max("probs").alias("top"),
        F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("total"),
    )


CLASSIFIED = f"""{LOGITS}, r as (select ref_id, list_max(p) as prob_raw, cast(list_position(p, list_max(p)) - 1 as bigint) as class_id_raw from p),
    c as (select *, prob_raw > 0.3e0 + 0.05e0 * class_id_raw as sure from r),
    t as (select ref_id, class_id_raw, prob_raw, case when sure then class_id_raw else 10 end as class_id, case when sure then prob_raw else 1 - prob_raw end as prob from c)"""


def classified(t):
    return modelout.thresholded(probabilities(t), THRESHOLDS)


@query("post2_thresholds", f"{CLASSIFIED} select * from t")
def _(t):
    return classified(t).select("ref_id", "class_id_raw", "prob_raw", "class_id", "prob")


LABEL_SQL = "case {0} when 0 then 'Homo sapiens' when 1 then 'Vehicle' when 10 then 'Not Classified' when 11 then 'Animalia' else concat('taxon ', cast({0} as varchar)) end"


@query("post3_labels", f"{CLASSIFIED} select ref_id, {LABEL_SQL.format('class_id')} as category, {LABEL_SQL.format('class_id_raw')} as category_raw from t")
def _(t):
    labels = modelout.extended_labels(LABELS)
    return classified(t).select("ref_id", modelout.label_of(F.col("class_id"), labels).alias("category"), modelout.label_of(F.col("class_id_raw"), labels).alias("category_raw"))


@query(
    "post4_detector_fallback",
    f"""{CLASSIFIED}, d as (select mediafile_id, first(class order by det_no, part_no, supp_no) as class, first(confidence order by det_no, part_no, supp_no) as confidence from detections group by 1)
    select t.ref_id, case when class_id = 10 and d.class is not null then case d.class when 'person' then 0 when 'vehicle' then 1 else 11 end else class_id end as class_id,
      case when class_id = 10 and d.class is not null then d.confidence else prob end as prob from t left join d on d.mediafile_id = t.ref_id""",
)
def _(t):
    first = t.detections.groupBy("mediafile_id").agg(F.min_by(F.struct("class", "confidence"), F.struct("det_no", "part_no", "supp_no")).alias("detection"))
    rows = classified(t).join(first, F.col("ref_id") == F.col("mediafile_id"), "left")
    return modelout.detector_fallback(rows, modelout.extended_labels(LABELS)).select("ref_id", "class_id", "prob")


@query("post5_label_map", "select count(*) as labels, count(*) = count(distinct id) as unique, min(id) = 0 and max(id) = count(*) - 1 as dense, cast(0 as bigint) as unnamed from taxa")
def _(t):
    return modelout.check_label_map(t.taxa)


@query(
    "post6_import_record",
    "select media_id, concat('raw ', cast(media_id % 5 as varchar)) as category, cast(n_chars as double) / 20001 as confidence from uploads",
)
def _(t):
    rows = t.uploads.select(
        "media_id", F.concat(F.lit("raw "), F.col("media_id") % 5).alias("predicted_category_raw"), (F.col("n_chars") / 20001).cast("string").alias("predicted_prob_raw")
    )
    return modelout.import_record(rows).select("media_id", "category", "confidence")


# ---- splits ---------------------------------------------------------------------------------


def samples(t):
    return t.gallery.select("ref_id", "identity", "sequence_id")


@query("spl1_repeated_only", "select media_id from uploads where sha256(content) in (select sha256(content) from uploads group by 1 having count(*) > 1)")
def _(t):
    rows = t.uploads.select("media_id", F.sha2("content", 256).alias("content_hash"))
    return splits.repeated_only(rows, "content_hash").select("media_id")


SPLIT = """
    with n as (select ref_id, identity, sequence_id, row_number() over (partition by identity order by ref_id) as rn, count(*) over (partition by identity) as n from gallery),
    c as (select *, rn <= ceil(n * (1 - 0.8e0)) as counted from n), f as (select sequence_id, min(ref_id) as first_test from c where counted group by 1),
    p as (select c.*, counted or coalesce(c.ref_id > f.first_test, false) as test from c left join f using (sequence_id)),
    s as (select *, case when not test then 'train' when bool_or(not test) over (partition by identity) then 'test' end as split from p)"""


@query("spl2_split_ratio", f"{SPLIT} select ref_id, split from s")
def _(t):
    return splits.split_ratio(samples(t), "identity", "sequence_id", "ref_id").select("ref_id", "split")


@query(
    "spl3_drop_tail",
    f"""{SPLIT}, k as (select identity, count(*) as n from s where split = 'train' group by 1)
    select s.ref_id, s.split from s left join k using (identity) where split is not null and not coalesce(k.n < 25, false)""",
)
def _(t):
    placed = splits.split_ratio(samples(t), "identity", "sequence_id", "ref_id")
    return splits.drop_tail(placed, "identity", "ref_id", 25).select("ref_id", "split")


@query(
    "spl4_factorize",
    """with f as (select identity, min(ref_id) as first from gallery group by 1), n as (select identity, row_number() over (order by first) - 1 as label_index from f)
       select ref_id, label_index from gallery join n using (identity)""",
)
def _(t):
    return splits.factorize(samples(t), "identity", "ref_id").select("ref_id", "label_index")


@query("spl5_nearest_accuracy", f"{COSINES} select avg((identity = query_identity)::int) as accuracy from s where position = 1")
def _(t):
    truth = roles(t)[0].select(F.col("ref_id").alias("query_id"), F.col("identity").alias("truth"))
    return splits.accuracy(similarity.nearest_label(with_identity(t), 1).join(truth, "query_id"), "predicted", "truth")


@query(
    "spl7_best_epoch",
    """with r as (select *, row_number() over (partition by location order by score desc, media_id) as rn from shots)
       select location, media_id as best_step, score, owner_id from r where rn = 1""",
)
def _(t):
    return splits.best_epoch(t.shots, "location", "media_id", "score", ["score", "owner_id"])


@query(
    "flt21_chunks",
    "select media_id, cast(ntile(7) over (order by media_id) - 1 as bigint) as chunk from shots where media_type = 'image' and annotated",
)
def _(t):
    """A chain of steps: two equality filters, then chunks."""
    keep = lambda column, value: lambda df: df.filter(F.col(column) == value)
    rows = t.shots.transform(keep("media_type", "image")).transform(keep("annotated", True))
    return splits.chunks(rows.select("media_id"), "media_id", 7)
