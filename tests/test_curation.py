"""Merges, imports, files and streams."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from trapline.operators import access, media, merge
from trapline.session import scratch_path
from trapline.sources import files, gallery, paged, similarities
from trapline.streaming import online


def test_merge_chains_cycles_and_selves(spark):
    rows = [(2, 1, 0), (3, 2, 1), (4, 3, 2), (5, 5, 3), (6, 7, 4), (7, 8, 5), (8, 6, 6), (9, 6, 7), (4, 9, 8), (20, 21, 9)]
    merges = spark.createDataFrame(rows, "from_id long, to_id long, position long")
    got = {r["from_id"]: r["to_id"] for r in merge.resolve_merges(merges).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 20: 21}  # 6, 7 and 8 are a cycle and 9 leads into it


def test_long_chain(spark):
    merges = spark.range(1, 100).select(F.col("id").alias("from_id"), (F.col("id") - 1).alias("to_id"), F.col("id").alias("position"))
    assert {r["to_id"] for r in merge.resolve_merges(merges).collect()} == {0}


def test_identity_merge(spark):
    rows = [
        (1, "A", "U", "S", None, "B1", None, "na"), (2, "B", "M", "U", dt.date(2020, 1, 2), None, "J", "nb"),
        (3, "C", "F", "S", dt.date(2021, 1, 2), "B1", None, "nc"), (4, "D", "U", "U", None, None, None, "nd"),
    ]
    identities = spark.createDataFrame(rows, "id long, name string, sex string, coat_type string, birth_date date, code string, juv_code string, note string")
    resolved = merge.resolve_merges(spark.createDataFrame([(2, 1, 5), (3, 1, 7)], "from_id long, to_id long, position long"))
    got = {r["id"]: r for r in merge.merge_identities(identities, resolved, "2024-01-01").collect()}
    assert set(got) == {1, 4}
    one = got[1]
    assert (one["sex"], one["coat_type"], one["birth_date"], one["code"]) == ("M", "S", dt.date(2020, 1, 2), "B1")
    assert one["note"] == (
        "na\nnb\nmerged: A + B, 2024-01-01\nsex: U , M\n  coat_type: S , U\n  birth_date: None , 2020-01-02\n  code: B1 , None\n  juv_code: None , J"
        "\nnc\nmerged: A + C, 2024-01-01\nsex: M , F\n  birth_date: 2020-01-02 , 2021-01-02"
    )
    assert got[4]["note"] == "nd"


def test_locality_merge(spark):
    rows = [(1, "A", None, "na"), (2, "B", "1,2", "nb"), (3, "C", "3,4", "nc"), (4, "D", None, "nd")]
    localities = spark.createDataFrame(rows, "id long, name string, location string, note string")
    resolved = merge.resolve_merges(spark.createDataFrame([(2, 1, 0), (3, 1, 1), (4, 1, 2)], "from_id long, to_id long, position long"))
    (got,) = merge.merge_localities(localities, resolved).collect()
    assert got["location"] == "1,2"
    assert got["note"] == "na\n\nMerged from B:\n  nb\n\nMerged from C:\n  nc\n  location: 3,4\n\nMerged from D:\n  nd"


def test_get_or_create(spark):
    existing = spark.createDataFrame([(7, "a"), (3, "b")], "id long, name string")
    incoming = spark.createDataFrame([("c",), ("a",), ("c",), ("",), (None,), ("long name",)], "name string")
    got = {r["name"]: r["id"] for r in merge.get_or_create(existing, incoming, ["name"]).collect()}
    assert got == {"a": 7, "b": 3, "c": 8, "long name": 9}
    alike = spark.createDataFrame([("x" * 50 + "1",), ("x" * 50 + "2",)], "name string")
    assert merge.get_or_create(existing, alike, ["name"]).count() == 4
    empty = spark.createDataFrame([], "id long, name string")
    assert {r["id"] for r in merge.get_or_create(empty, incoming, ["name"]).collect()} == {0, 1, 2}


def test_overlay_fans_out(spark):
    base = spark.createDataFrame([("p", 1, "x"), ("q", 2, "y")], "path string, a long, b string")
    update = spark.createDataFrame([("p", 10, None), ("p", None, "n")], "path string, a long, c string")
    got = sorted((r["path"], r["a"], r["b"], r["c"]) for r in merge.overlay(base, update, "path").fillna("-").collect())
    assert got == [("p", 1, "x", "n"), ("p", 10, "x", "-"), ("q", 2, "y", "-")]


def test_import_keeps_edits(spark):
    columns = "path string, updated_by long, taxon string, captured_at timestamp, predicted_taxon string, confidence double"
    now = dt.datetime(2024, 1, 1)
    existing = spark.createDataFrame([("a", None, "old", now, None, None), ("b", 5, "mine", now, None, None)], columns)
    incoming = spark.createDataFrame(
        [("a", None, "new", "raw", 0.5), ("b", now, "new", "raw", 0.5), ("c", now, "new", "raw", 0.5)],
        "path string, datetime timestamp, predicted_category string, predicted_category_raw string, predicted_prob_raw double",
    )
    got = {r["path"]: r for r in merge.import_metadata(existing, incoming, "path").collect()}
    assert (got["a"]["taxon"], got["a"]["captured_at"], got["a"]["status"]) == ("new", now, "found and not updated by user")
    assert (got["b"]["taxon"], got["b"]["status"], got["b"]["predicted_taxon"]) == ("mine", "found", None)
    assert got["c"]["status"] == "created and not updated by user"
    single = {r["path"]: r["taxon"] for r in merge.import_metadata(existing, incoming, "path", archive_taxon=F.lit("Lynx lynx")).collect()}
    assert single == {"a": "Lynx lynx", "b": "mine", "c": "Lynx lynx"}
    gone = merge.import_metadata(existing, incoming, "path", create_missing=False)
    assert merge.import_counts(gone).first().asDict() == {"created": 0, "found": 2, "deleted": 1, "error": 0}


def test_results_import(spark):
    rows = [(1, [4, 5], ["x", ""], ["p", "q"], [0.9, 0.2]), (2, [6, 7], ["y", "z"], ["r", "s"], [0.3, 0.1])]
    results = spark.createDataFrame(rows, "media_id long, class_ids array<long>, labels array<string>, paths array<string>, scores array<double>")
    old = spark.createDataFrame([(2, 0, 1, "stale", "", 0.0), (3, 0, 1, "kept", "", 0.0)], "media_id long, rank int, identity_id long, name string, path string, score double")
    assigned, table = merge.import_results(results, old, threshold=0.5)
    assert [tuple(r) for r in assigned.collect()] == [(1, 4)]
    assert sorted((r["media_id"], r["name"]) for r in table.collect()) == [(2, "y"), (2, "z"), (3, "kept")]
    assigned, table = merge.import_results(results, old)
    assert assigned.isEmpty() and ("Unknown" in {r["name"] for r in table.collect()})


def test_write_access(spark):
    rows = spark.createDataFrame([(1, 7, None), (2, 8, None), (3, 8, 1), (4, None, None)], "id long, owner_id long, owner_workgroup_id long")
    who = access.Viewer(7, None)
    got = lambda **o: {r["id"]: r["w"] for r in rows.select("id", access.may_write(who, **o).alias("w")).collect()}
    assert got() == {1: True, 2: True, 3: False, 4: False}
    assert got(strict=True, accept_none=True) == {1: True, 2: False, 3: False, 4: True}


def test_for_suggestion(spark):
    taxa = spark.createDataFrame([(0, "Not Classified"), (1, "Animalia"), (2, "Lynx lynx")], "id long, name string")
    obs = [(1, 0, None), (1, 0, True), (2, 0, None), (2, None, None), (3, 1, False), (4, 1, True), (5, 2, True), (5, 0, None), (6, None, None)]
    observations = spark.createDataFrame(obs, "mediafile_id long, taxon_id long, taxon_verified boolean")
    flags = media.observation_flags(observations, taxa)
    rows = spark.createDataFrame([(i, 2 if i != 6 else None) for i in range(1, 8)], "id long, predicted_taxon_id long")
    assert {r["id"] for r in media.for_suggestion(rows, flags).collect()} == {1, 3}


def test_search_text_keeps_the_separator_of_nulls(spark):
    rows = spark.createDataFrame([("Lynx", None, "Bob")], "taxon_name string, locality_name string, identity_name string")
    assert media.facets(rows, text="lynx  bob").count() == 1 and media.facets(rows, text="lynx bob").count() == 0


def test_csv_round_trip(spark):
    rows = [(0, 'a "quoted", text\nwith a line', None, "x"), (1, "", "é\\n", "y"), (2, "  spaces ", "a,b", "z")]
    df = spark.createDataFrame(rows, "_index long, t string, u string, v string")
    path = scratch_path(spark, "csv")
    files.write_metadata(df, path)
    back = files.read_metadata(spark, path, "t string, u string, v string").orderBy("v").collect()
    # in a spreadsheet an empty text is a missing value
    assert [(r["t"], r["u"], r["v"]) for r in back] == [tuple(v or None for v in r[1:]) for r in rows]


def test_listing(spark):
    root = scratch_path(spark, "tree")
    spark.range(1).write.csv(f"{root}/a/x")
    spark.range(1).write.parquet(f"{root}/b")
    names = {r["original_path"].split("/")[0] for r in files.relative_to(files.list_files(spark, root, "part-*", (".PARQUET",)), root if root.startswith("file:") else f"file:{root}").collect()}
    assert names == {"a"}
    assert files.latest_spreadsheet(files.list_files(spark, root)).endswith(".csv")


def test_gallery_versions(spark):
    path = scratch_path(spark, "gallery")
    columns = "ref_id long, organization_id int, image_path string, class_id long, label string, embedding string"
    gallery.write(spark.createDataFrame([(1, 1, "a", 1, "x", "{}"), (2, 1, "b", 1, "x", "{}"), (3, 2, "a", 1, "x", "{}")], columns), path)
    new = spark.createDataFrame([(9, 1, "a", 2, "new", "{}")], columns)
    for _again in range(2):
        gallery.upsert(path, 1, new)
    assert {(r["ref_id"], r["organization_id"]) for r in gallery.read(spark, path).collect()} == {(9, 1), (2, 1), (3, 2)}
    assert gallery.count(spark, path, 1) == 2
    assert [r["ref_id"] for r in gallery.page(gallery.read(spark, path, 1), 1, 2).collect()] == [9]


def test_ingest_reads_every_file_once(spark):
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "offsets"))
    spark.range(5).write.parquet(source)
    online.ingest(spark, source, "id long", sink, checkpoint)
    online.ingest(spark, source, "id long", sink, checkpoint)
    spark.range(5, 8).write.mode("append").parquet(source)
    online.ingest(spark, source, "id long", sink, checkpoint)
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(8))


def test_stream_sequences_join_at_the_limit(spark):
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "offsets"))
    start = dt.datetime(2024, 1, 1)
    seconds = [0, 120, 241, 10_000]
    rows = [("a", start + dt.timedelta(seconds=s)) for s in seconds]
    spark.createDataFrame(rows, "location string, captured_at timestamp").write.parquet(source)
    stream = online.watch_folder(spark, source, "location string, captured_at timestamp")
    online.drain(online.online_sequences(stream, "location", "captured_at"), sink, checkpoint)
    got = sorted((r["shots"], r["last_at"]) for r in spark.read.parquet(sink).collect())
    assert got == [(1, rows[2][1]), (2, rows[1][1])]  # the session of the late sentinel stays open


def test_stream_drops_repeated_content(spark):
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "offsets"))
    start = dt.datetime(2024, 1, 1)
    rows = [(f"h{i % 3}", start + dt.timedelta(seconds=i)) for i in range(9)]
    spark.createDataFrame(rows, "h string, at timestamp").write.parquet(source)
    stream = online.watch_folder(spark, source, "h string, at timestamp")
    online.drain(online.online_unique(stream, "h", "at"), sink, checkpoint)
    assert sorted(r["h"] for r in spark.read.parquet(sink).collect()) == ["h0", "h1", "h2"]


def test_spreadsheet_last_row_wins(spark):
    sheet = spark.createDataFrame(
        [(0, "x\\a.jpg", "T1", "B1", None), (1, " x/a.jpg ", "T2", None, "right"), (2, "missing", "T3", None, None)],
        "row long, `original path` string, predicted_category string, code string, orientation string",
    )
    columns = "original_path string, taxon string, identity_code string, identity_name string, locality string, location string, captured_at timestamp, coat_type string, orientation string"
    table = spark.createDataFrame([("x/a.jpg", "old", None, "n", "l", None, None, "U", "U"), ("x/b.jpg", "old", None, "n", "l", None, None, "U", "U")], columns)
    got = {r["original_path"]: r for r in merge.apply_spreadsheet(table, sheet, "row").collect()}
    assert (got["x/a.jpg"]["taxon"], got["x/a.jpg"]["identity_code"], got["x/a.jpg"]["orientation"]) == ("T2", "B1", "R")
    assert got["x/b.jpg"]["taxon"] == "old"
    counts = merge.spreadsheet_counts(table, sheet).first()
    assert (counts["matched"], counts["unknown_files"], counts["fields_updated"]) == (2, 1, 4)


def test_identity_import_rejects_ambiguous_keys(spark):
    existing = spark.createDataFrame(
        [(1, "A", "B1", "U", "U", ""), (2, "B", "B1", "U", "U", ""), (3, "C", "B3", "U", "U", "")], "id long, name string, code string, sex string, coat_type string, note string"
    )
    rows = [(0, "B1", "X", "male", "Spotted", "n"), (1, "B3", "", "f", "Marbled", None), (2, None, "D", "?", "Unspotted", "n"), (3, None, None, "m", "S", "n")]
    sheet = spark.createDataFrame(rows, "row long, code string, name string, sex string, coat_type string, note string")
    table, rejected = merge.import_identities(existing, sheet, "row")
    got = {r["id"]: (r["name"], r["sex"], r["coat_type"], r["status"]) for r in table.collect()}
    assert got == {1: ("A", "U", "U", "unchanged"), 2: ("B", "U", "U", "unchanged"), 3: ("C", "F", "M", "updated"), 4: ("D", None, "N", "created")}
    assert [r["_key"] for r in rejected.collect()] == ["B1"]


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_stored_pages(spark, ranges):
    path, order = scratch_path(spark, "paged"), [F.col("at").desc_nulls_last(), F.col("id")]
    rows = [(i, None if i % 9 == 0 else i * 37 % 100) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, at int")
    paged.write(df, path, order, ranges)
    ordered = [i for i, at in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    ids = lambda found: [r["id"] for r in found.collect()]
    assert paged.count(spark, path) == 500
    for start, end in ((0, 500), (0, 1), (123, 124), (60, 200), (490, 700), (500, 510), (-5, 3), (10, 10), (20, 10)):
        assert ids(paged.read(spark, path, df.schema, order, start, end)) == ordered[max(start, 0) : max(end, 0)]
    for number, first in ((1, 0), (17, 480), (18, 0), (0, 0), (-3, 0), (9, 240)):
        assert ids(paged.page(spark, path, df.schema, order, number, 30)) == ordered[first : first + 30]


def test_deep_page_reads_one_range(spark):
    path, df = scratch_path(spark, "paged"), spark.range(10_000)
    paged.write(df, path, [F.col("id")], 20)
    (place,) = spark.read.parquet(f"{path}/ranges").filter("start <= 9000 and start + n > 9010").collect()
    deep = paged.page(spark, path, df.schema, [F.col("id")], 901, 10)
    assert [r["id"] for r in deep.collect()] == list(range(9000, 9010))
    (pruned,) = re.findall(r"PartitionFilters: \[(.*?)\]", deep._jdf.queryExecution().executedPlan().toString())
    assert f"(page_range#" in pruned and f"= {place['page_range']})" in pruned
    assert spark.read.parquet(f"{path}/rows").filter(F.col("page_range") == place["page_range"]).count() == place["n"] < 1500


def test_stored_pages_of_an_empty_table(spark):
    path, df = scratch_path(spark, "paged"), spark.range(0)
    paged.write(df, path, [F.col("id")])
    assert paged.count(spark, path) == 0 and paged.page(spark, path, df.schema, [F.col("id")], 3, 10).collect() == []


def test_saved_similarities_need_no_shuffle(spark):
    path, name = scratch_path(spark, "similarities"), "similarities_test"
    pairs = [(q, 100 + r, (q * r % 7) / 7) for q in range(30) for r in range(10)] + [(99, 100, 0.5)]
    sides = spark.createDataFrame([(i, i % 5, f"p{i}") for i in [*range(30), *range(100, 109)]], "ref_id long, identity long, path string")
    similarities.save(spark.createDataFrame(pairs, "query_id long, ref_id long, score double"), sides, sides, path, name, ["identity", "path"], 4)
    schema = spark.table(name).schema
    assert schema.names == ["query_id", "ref_id", "score", "q_identity", "q_path", "r_identity", "r_path"]
    spark.sql(f"drop table {name}")  # an outside table: its files stay, as for another session
    back = similarities.load(spark, path, name, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema), 4)
    known = lambda i: (i % 5, f"p{i}") if i < 30 or 100 <= i < 109 else (None, None)
    assert {tuple(r) for r in back.collect()} == {(q, r, s, *known(q), *known(r)) for q, r, s in pairs}
    best = back.groupBy("query_id").agg(F.max("score").alias("best"))
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString() and best.count() == 31
