"""Golden values of the scalar functions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from trapline.functions import arrays as A
from trapline.functions import dictionaries as D
from trapline.functions import geometry as G
from trapline.functions import text as X
from trapline.functions import timestamps as DT
from trapline.operators.scan import classify_upload_folders, path_columns


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


def col_of(spark, values, function, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_strip_accents(spark):
    words = ["Příliš žluťoučký kůň", "Ångström", "áb", "plain", None]
    expected = ["Prilis zlutoucky kun", "Angstrom", "ab", "plain", None]
    assert col_of(spark, words, X.strip_accents) == expected
    assert col_of(spark, words, X.strip_accents_any) == expected


def test_hashed_name(spark):
    name = col_of(spark, ["myfilenameverylongtohide.myextension"], X.hashed_name)[0]
    assert name.startswith("media_data/e86ec") and name.endswith(".myextension")
    assert "/" not in col_of(spark, ["a/b.JPG"], lambda c: X.hashed_name(c, None))[0]


@pytest.mark.parametrize(
    "path, suffix, stem",
    [("a/b.tar.gz", ".gz", "b.tar"), ("a/.hidden", "", ".hidden"), ("a.d/plain", "", "plain"), ("x.JPG", ".JPG", "x"), ("a/x.", "", "x.")],
)
def test_suffix_and_stem(spark, path, suffix, stem):
    assert col_of(spark, [path], X.suffix) == [suffix]
    assert col_of(spark, [path], X.stem) == [stem]


def test_species_labels(spark):
    labels = [None, "jelen", "Liška", "rys ostrovid", "xyz"]
    assert col_of(spark, labels, X.correct_label) == ["nevime", "jelen evropsky", "liska obecna", "rys ostrovid", "xyz"]
    assert col_of(spark, labels, lambda c: X.known_label(X.correct_label(c))) == ["nevime", "jelen evropsky", "liska obecna", "rys ostrovid", "nevime"]


def test_species_table_is_clean():
    rows = D.species_rows()
    assert len(rows) == 91 and all(len(r) == 6 for r in rows)
    assert len({r[0] for r in rows}) == 91
    assert all(cell == cell.strip() for r in rows for cell in r)


def test_path_columns(spark):
    paths = [
        "NETRIDENA/LY2019/PRACHATICE/2019-07-01/2019-07-01_12-00-00_0001.jpg",
        "TRIDENA/LY2019/3L-Druhy_Háj 1/2019-07-01/liška/x.avi",
        "TRIDENA/LY2019/LOC/x.jpg",
        "rys1/2019/B12/y.PNG",
        "set/image/meadow/z.jpg",
        "a/b.jpg",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, original_path string")
    r = [x.asDict() for x in path_columns(df).orderBy("i").collect()]
    assert (r[0]["location"], r[0]["date"], r[0]["annotated"], r[0]["czech_label"]) == ("prachatice", "2019-07-01", False, "nevime")
    assert (r[1]["location"], r[1]["media_type"], r[1]["czech_label"], r[1]["vanilla_species"]) == ("haj1", "video", "liska obecna", "liška")
    assert (r[2]["path_len"], r[2]["czech_label"], r[2]["date"]) == (4, "nevime", "LY2019")
    assert (r[3]["czech_label"], r[3]["location"], r[3]["date"], r[3]["annotated"]) == ("rys ostrovid", None, None, False)
    # an image folder above the location names it
    image = spark.createDataFrame([("x/image/meadow/z.jpg",)], "original_path string")
    assert path_columns(image).first()["location"] == "meadow" and path_columns(image).first()["annotated"] is None
    assert r[5]["location"] is None and r[5]["path_len"] is None and r[5]["media_type"] == "image"


def test_dates_in_names(spark):
    df = spark.createDataFrame([(n,) for n in ("2021-02-31_a_b", "place_20210203", "place_20211301", "nodate", "18991231_x", "20210203")], "name string")
    got = [(r["date"], r["locality"]) for r in X.split_date_and_locality(df, "name").collect()]
    assert got == [("2021-02-31", "a_b"), ("20210203", "place"), (None, None), (None, None), (None, None), (None, None)]
    assert col_of(spark, ["B12 x", "none"], X.code_in_name) == ["B12", None]
    assert col_of(spark, ["a 2021-02-03.zip", "a 2021-02-31.zip", "b"], X.date_in_name) == [dt.date(2021, 2, 3), None, None]


def test_upload_folders(spark):
    paths = ["20210203/Háj a", "Háj a/2021-02-04", "2021-02-05_Les.zip", "Háj a", "_imported/x", "junk"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    r = [x.asDict() for x in classify_upload_folders(df).orderBy("i").collect()]
    assert [(x["date"], x["locality"]) for x in r[:3]] == [("2021-02-03", "Háj a"), ("2021-02-04", "Háj a"), ("2021-02-05", "Les")]
    assert r[0]["zip_name"] == "Haj_a_2021-02-03.zip"
    assert r[3]["parent_dir_to_be_deleted"] and r[3]["error"] is None
    assert r[4]["skipped"] and not r[0]["skipped"]
    assert r[5]["error"] is not None


def test_exif_time(spark):
    values = ["2022:10:05 10:11:56", "2022:10:05 10:11:56+02:00", "2022:10:05 10:11:56\n2022:10:05 10:11:57", "other", None]
    assert col_of(spark, values, DT.exif_to_standard) == ["2022-10-05 10:11:56", "2022-10-05 10:11:56+02:00", values[2], "other", None]


def test_ocr_time(spark):
    values = ["x 02/03/2022 12:07 PM", "02-03-2022 12:07 AM", "2/3/2022 1:07PM", "30Sec 2021/05/06 7:08:09", "13/45/2022 1:07 PM", "none"]
    expected = [dt.datetime(2022, 2, 3, 12, 7), dt.datetime(2022, 2, 3, 0, 7), dt.datetime(2022, 2, 3, 13, 7), dt.datetime(2021, 5, 6, 7, 8, 9), None, None]
    assert col_of(spark, values, DT.ocr_time) == expected


def test_times(spark):
    assert col_of(spark, ["2024-01-01 12:00:00", "2024-07-01 12:00:00", "2024-07-01 12:00:00Z", "bad"], DT.local_to_utc) == [
        dt.datetime(2024, 1, 1, 11), dt.datetime(2024, 7, 1, 10), dt.datetime(2024, 7, 1, 12), None,
    ]
    assert col_of(spark, [dt.datetime(2024, 2, 29)], lambda c: DT.shift(c, years=1), "timestamp") == [dt.datetime(2025, 2, 28)]
    assert col_of(spark, [59.0, 60.0, 179.0, 3600.0, 7300.0], DT.readable_wait, "double") == [
        "in a few seconds", "in a minute", "in 2 minutes", "in an hour", "in 2 hours",
    ]


def test_geometry(spark):
    assert col_of(spark, ["48.1234567,13.9"], lambda c: G.rounded_location(*G.lat_lon(c))) == ["48.123,13.9"]
    assert col_of(spark, ["nonsense", None], lambda c: G.lat_lon(c)[0]) == [None, None]
    box = G.relative_box(*[F.lit(x) for x in (10.0, 20.0, 30.0, 60.0, 100.0, 200.0)])
    row = spark.range(1).select(*[v.alias(k) for k, v in box.items()]).first()
    assert (row["bbox_x_center"], row["bbox_y_center"], row["bbox_width"], row["bbox_height"]) == (0.2, 0.2, 0.2, 0.2)
    assert one(spark, G.media_fragment(F.lit(0.5), F.lit(0.5), F.lit(0.2), F.lit(0.4))) == "xywh=percent:40.0000,30.0000,20.0000,40.0000"
    assert one(spark, G.percent(F.lit(1), F.lit(0))) == 0.0 and one(spark, G.percent(F.lit(1), F.lit(4))) == 25.0
    assert math.isclose(one(spark, G.representative_threshold(F.lit(5))), 1 - math.exp(-1))


def test_arrays(spark):
    values = [[1.0, 3.0, 3.0], [2.0], []]
    assert col_of(spark, values, A.argmax, "array<double>")[:2] == [1, 0]
    soft = col_of(spark, [[1000.0, 1000.0], [0.0, math.log(3)]], A.softmax, "array<double>")
    assert soft[0] == [0.5, 0.5] and math.isclose(soft[1][1], 0.75)
    assert col_of(spark, [["a"], ["a", "b", "c", "d"]], lambda c: A.pad_with_last(c, 3), "array<string>") == [["a"] * 3, ["a", "b", "c", "d"]]
    assert col_of(spark, [-0.5, 0.5, 1.5], A.clip01, "double") == [0.0, 0.5, 1.0]
    unit = col_of(spark, [[3.0, 4.0], [0.0, 0.0]], A.unit, "array<double>")
    assert unit == [[0.6, 0.8], [0.0, 0.0]]


def test_detections(spark):
    text = "[{'bbox': [1, 2, 3, 4], 'confidence': 0.5, 'class': 'animal', 'size': [4, 6], 'orientation': 'left', 'orientation_score': None}, {'bbox': [1, 2, 3, 4], 'confidence': 0.9, 'class': 'person', 'size': [4, 6], 'orientation': 'left', 'orientation_score': 0.2}]"
    parsed = spark.createDataFrame([(text,), ("[]",), (None,)], "t string").select(A.parse_detections(F.col("t")).alias("d"))
    rows = parsed.select(A.best_by_confidence(F.col("d"))["class"].alias("best"), A.first_or_null(F.col("d"))["class"].alias("first")).collect()
    assert [tuple(r) for r in rows] == [("person", "animal"), (None, None), (None, None)]


def test_detections_with_quotes_and_words(spark):
    quoted = """[{'bbox': [1.0], 'class': "Geoffroy's cat", 'confidence': None, 'orientation': 'Nonelike None True'}]"""
    df = spark.createDataFrame([(quoted,), ("[{'bbox': [1.0",), (None,)], "t string").withColumn("d", A.parse_detections(F.col("t")))
    got = df.select(F.col("d")[0]["class"], F.col("d")[0]["confidence"], F.col("d")[0]["orientation"], A.unparsed(F.col("t"), F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("Geoffroy's cat", None, "Nonelike None True", None), (None, None, None, "[{'bbox': [1.0"), (None, None, None, None)]


def test_compact_json_has_no_nan(spark):
    df = spark.createDataFrame([(1, float("nan"), "NaN"), (2, 2.5, None)], "i int, x double, s string")
    got = [r[0] for r in df.select(A.compact_json(df, ["i", "x", "s"])).collect()]
    assert got == ['{"i":1,"s":"NaN"}', '{"i":2,"x":2.5}']


def test_keypoints(spark):
    points = [(0.8 + i / 100, i) for i in range(25)]
    df = spark.createDataFrame([(points,), (points[:12],)], "p array<struct<score:double,at:int>>")
    got = [r["k"] for r in df.select(A.matched_keypoints(F.col("p")).alias("k")).collect()]
    assert [x["at"] for x in got[0]] == list(range(24, 14, -1)) and got[1] == []


def test_orientation(spark):
    df = spark.createDataFrame([("left", 0.9), ("left", 0.4), ("sideways", 0.9), ("back", None)], "w string, s double")
    got = df.select(A.orientation_code(F.col("w"), F.col("s")).alias("a"), A.orientation_code(F.col("w"), F.col("s"), left_as_front=True).alias("b")).collect()
    assert [tuple(r) for r in got] == [("L", "F"), ("U", "U"), (None, None), ("B", "B")]
