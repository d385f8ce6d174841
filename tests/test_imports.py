"""Imports that create rows in several tables: cases the queries don't hold."""

import datetime as dt
import json
import re

import pytest

from pyspark.sql import functions as F
from trapline.operators import archive_import as I
from trapline.operators import merge
from trapline.session import pin

MEDIA = (
    "id long, archive_id long, path string, original_filename string, media_type string, captured_at timestamp, locality_id long, taxon_id long, identity_id long, "
    "identity_is_representative boolean, predicted_taxon_id long, predicted_taxon_confidence double, orientation string, metadata_json string, updated_by long"
)
OBSERVATIONS = (
    "mediafile_id long, position int, identity_id long, taxon_id long, predicted_taxon_id long, predicted_taxon_confidence double, "
    "bbox_x_center double, bbox_y_center double, bbox_width double, bbox_height double, orientation string"
)
OLD = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def before(spark):
    file = lambda i, a, p, edited=None: (i, a, p, p, "image", OLD, None, 1, None, False, None, None, "N", "{}", edited)
    return I.Archive(
        spark.createDataFrame([file(1, 1, "a"), file(2, 1, "b", 9), file(3, 2, "a")], MEDIA),
        spark.createDataFrame([(1, 0, None, 1, None, None, None, None, None, None, "N"), (2, 0, 5, 1, None, None, None, None, None, None, "N")], OBSERVATIONS),
        spark.createDataFrame([(1, "fox"), (2, "lynx")], "id long, name string"),
        spark.createDataFrame([(5, "Ada", "A1", "S", 0), (6, "Ada", None, "S", 0), (7, "Bea", "B1", "S", 1)], "id long, name string, code string, coat_type string, owner_workgroup_id long"),
        spark.createDataFrame([(3, "ridge", "1.0,2.0", 4)], "id long, name string, location string, owner_id long"),
    )


ARCHIVES = "id long, owner_id long, owner_workgroup_id long, contains_single_taxon boolean, contains_identities boolean, taxon_for_identification_id long, locality string"


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_import(spark, before):
    archives = spark.createDataFrame([(1, 4, 0, False, True, None, "ridge"), (2, 4, 1, True, True, 2, "valley")], ARCHIVES)
    box = [{"bbox": [0.0, 0.0, 10.0, 20.0], "size": [100.0, 200.0], "orientation": "right", "orientation_score": 0.9}]
    incoming = spark.createDataFrame(
        [
            (1, "a", 1, "never", "wolf", "Ada", box), (1, "a", 2, "2024-07-01T10:00:00Z", "", None, None),  # the later row counts, as does the time that can be read
            (1, "b", 3, "2024-07-01 10:00:00", "wolf", "Cleo", box), (1, "c", 4, "2024-07-01 10:00:00", "fox", "Cleo", box),
            (2, "z", 5, None, "wolf", "Bea", None), (9, "a", 6, None, "moose", "Dan", None), (1, None, 7, None, None, None, None),
        ],
        "archive_id long, path string, position int, datetime string, predicted_category string, unique_name string, "
        "detections array<struct<bbox: array<double>, size: array<double>, orientation: string, orientation_score: double>>",
    )
    after, status = I.import_archives(before, archives, incoming)
    assert set(after.tables()) == {"media", "observations", "taxa", "identities", "localities"}
    media = {r["id"]: r for r in after.media.collect()}
    assert (media[1]["taxon_id"], media[1]["captured_at"], media[1]["identity_id"]) == (1, dt.datetime(2024, 7, 1, 10), None)
    edited = media[2]
    assert (edited["taxon_id"], edited["captured_at"], edited["orientation"]) == (1, OLD, "N") and json.loads(edited["metadata_json"])["unique_name"] == "Cleo"
    assert media[3] == before.media.filter("id = 3").first()
    created = {r["path"]: r for i, r in media.items() if i > 3}
    assert sorted(i for i in media) == [1, 2, 3, 4, 5]
    assert (created["c"]["locality_id"], created["c"]["identity_is_representative"], created["c"]["captured_at"]) == (3, False, dt.datetime(2024, 7, 1, 8))
    assert (created["z"]["taxon_id"], created["z"]["identity_id"], created["z"]["identity_is_representative"], created["z"]["locality_id"]) == (2, 7, True, 4)
    assert rows_of(after.taxa, "id", "name") == [(1, "fox"), (2, "lynx")]  # wolf and moose are named by no row that counts
    assert rows_of(after.identities, "id", "name", "owner_workgroup_id")[-1] == (8, "Cleo", 0)
    assert rows_of(after.localities, "id", "name", "owner_id") == [(3, "ridge", 4), (4, "valley", 4)]
    assert rows_of(after.observations, "mediafile_id", "orientation") == [(1, "N"), (2, "N"), (created["c"]["id"], "R")]
    assert dict(rows_of(status, "path", "status")) == {"a": "found and not updated by user", "b": "found", "c": "created and not updated by user", "z": "created and not updated by user"}


def test_import_without_creating(spark, before):
    archives = spark.createDataFrame([(1, 4, 0, False, False, None, None)], ARCHIVES)
    incoming = spark.createDataFrame([(1, "a", 1, "elk"), (1, "new", 2, "owl")], "archive_id long, path string, position int, predicted_category string")
    after, status = I.import_archives(before, archives, incoming, create_missing=False)
    assert rows_of(status, "path", "status") == [("a", "found and not updated by user"), ("new", "deleted")]
    assert rows_of(after.media, "id", "taxon_id") == [(1, 3), (2, 1), (3, 1)] and rows_of(after.taxa, "name") == [("elk",), ("fox",), ("lynx",)]
    nothing = incoming.limit(0)
    after, status = I.import_archives(before, archives, nothing)
    assert status.isEmpty() and all(rows_of(t, *t.columns) == rows_of(getattr(before, n), *t.columns) for n, t in after.tables().items() if n in ("taxa", "localities"))


def test_sheet(spark, before):
    sheet = spark.createDataFrame(
        [("a", 1, "wolf", "A1", "Ada II", "new place", "48.12345", None), ("b", 2, None, None, "Eve", None, None, " M "), ("a", 3, "", None, None, "", None, None), ("no file", 4, "bear", "Z9", "Zoe", "z", None, None)],
        "original_path string, row int, predicted_category string, code string, unique_name string, locality_name string, latitude string, coat_type string",
    )
    own = I.Archive(before.media.filter("archive_id = 1"), before.observations, before.taxa, before.identities, before.localities)
    after = I.update_from_sheet(own, sheet.withColumn("longitude", F.col("latitude")), "row", F.lit(0).cast("long"), F.lit(4).cast("long"))
    assert rows_of(after.media.fillna(0), "id", "taxon_id", "identity_id", "locality_id") == [(1, 3, 5, 4), (2, 1, 8, 0)]
    assert rows_of(after.taxa, "name") == [("fox",), ("lynx",), ("wolf",)]
    assert rows_of(after.identities.fillna(""), "id", "name", "code", "coat_type") == [(5, "Ada II", "A1", "S"), (6, "Ada", "", "S"), (7, "Bea", "B1", "S"), (8, "Eve", "", "M")]
    assert rows_of(after.localities, "id", "name", "location") == [(3, "ridge", "1.0,2.0"), (4, "new place", "48.123,48.123")]


def sent_whole(df):
    """Keys of the joins that send one side to all tasks; what crosses ranges has a row per range."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [k for k in re.findall(r"Broadcast(?:HashJoin|NestedLoopJoin) (\[[^\]]*\])?", plan) if "_range" not in k]


def test_lookups_never_hold_a_dimension_on_the_driver(spark, before):
    """Stored tables are small files, of which Spark would send all rows, eight times each for the salts."""
    identities = pin(before.identities)
    rows = pin(spark.createDataFrame([(1, "Ada", 0), (2, "Bea", 0), (3, None, 1)], "k long, called string, tenant long"))
    found = I.ids_of(rows, identities, {"name": "called", "owner_workgroup_id": "tenant"}, "found", F.col("k"))
    assert sent_whole(found) == [] and rows_of(found, "k", "found") == [(1, 5), (2, None), (3, None)]
    made = merge.get_or_create(identities, rows.select(F.col("called").alias("name"), F.col("tenant").alias("owner_workgroup_id")), ["name", "owner_workgroup_id"])
    assert sent_whole(made) == [] and rows_of(made, "id", "name") == [(5, "Ada"), (6, "Ada"), (7, "Bea"), (8, "Bea")]


def test_sheet_never_holds_a_table_on_the_driver(spark, before):
    own = I.Archive(**{n: pin(t.filter("archive_id = 1") if n == "media" else t) for n, t in before.tables().items()})
    sheet = pin(spark.createDataFrame([("a", 1, "wolf", "A1", "Ada", "ridge", "1.5"), ("b", 2, "fox", None, "Cleo", "top", None)], "`original path` string, row int, predicted_category string, code string, unique_name string, `locality name` string, lat string"))
    after = I.update_from_sheet(own, sheet.withColumn("lon", F.col("lat")), "row", F.lit(0).cast("long"), F.lit(4).cast("long"))
    assert {n: sent_whole(t) for n, t in after.tables().items()} == dict.fromkeys(after.tables(), [])
    assert rows_of(after.media, "id", "taxon_id", "identity_id", "locality_id") == [(1, 3, 5, 3), (2, 1, 8, 4)]


def test_import_never_holds_a_table_on_the_driver(spark, before):
    stored = I.Archive(**{n: pin(t) for n, t in before.tables().items()})
    archives = spark.createDataFrame([(1, 4, 0, False, True, None, "ridge")], ARCHIVES)
    box = [{"bbox": [0.0, 0.0, 10.0, 20.0], "size": [100.0, 200.0], "orientation": "right", "orientation_score": 0.9}]
    incoming = pin(spark.createDataFrame([(1, "a", 1, "wolf", "Ada", box), (1, "n", 2, "fox", "Cleo", box)], "archive_id long, path string, position int, predicted_category string, unique_name string, detections array<struct<bbox: array<double>, size: array<double>, orientation: string, orientation_score: double>>"))
    after, status = I.import_archives(stored, archives, incoming)
    assert {n: sent_whole(t) for n, t in after.tables().items()} == dict.fromkeys(after.tables(), [])
    assert rows_of(after.media.filter("archive_id = 1"), "id", "taxon_id", "identity_id") == [(1, 3, 5), (2, 1, None), (4, 1, 8)]
    assert rows_of(after.observations, "mediafile_id", "identity_id") == [(1, 5), (2, 5), (4, 8)]
    assert rows_of(status, "path", "status") == [("a", "found and not updated by user"), ("n", "created and not updated by user")]
