"""Name, file name and coordinate matching against brute force."""

import math
import random

import numpy as np
import pytest

from trapline.operators import fuzzy, geojoin


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def random_names(seed, n=70):
    rng = random.Random(seed)
    names = set()
    while len(names) < n:
        names.add("".join(rng.choice("abc ") for _ in range(rng.randint(1, 14))))
    return [(i, name, i % 2, rng.randint(0, 3), None) for i, name in enumerate(sorted(names))]


def test_distances_of_many_pairs():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abßé ") for _ in range(n)) for n in [1, 2, 3, 5, 8, 13, 31, 63, 64, 64, 65, 90, 200]]
    lengths = np.array([len(x) for x in texts], np.int32)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    some = np.minimum(lengths[a], lengths[b]) <= fuzzy.WORD
    got = fuzzy._distances(fuzzy._code_points(texts, lengths), lengths, a[some], b[some])
    assert got.tolist() == [edit_distance(texts[i], texts[j]) for i, j in zip(a[some], b[some], strict=True)]


def test_distances_by_masks():
    """Words of 16, 32 and 64 letters give what letters compared one by one give."""
    rng = random.Random(9)
    for longest in (5, 16, 17, 32, 33, 64, 100, 140):
        texts = ["".join(rng.choice("abcdßé山 ") for _ in range(rng.randint(1, longest))) for _ in range(40)]
        lengths = np.array([len(x) for x in texts], np.int32)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
        some = np.minimum(lengths[a], lengths[b]) <= fuzzy.WORD
        codes = fuzzy._code_points(texts, lengths)
        got = fuzzy._distances(codes, lengths, a[some], b[some], fuzzy._masks(codes, lengths))
        assert got.tolist() == [edit_distance(texts[i], texts[j]) for i, j in zip(a[some], b[some], strict=True)]


@pytest.mark.parametrize("letters, longest", [("abcdefgh", 12), ("ab", 3_000), ("abcdefghijklmnopqrstuvwxyz", 1_500), ("aé山ßz", 40)])
def test_pairs_that_may_match(letters, longest):
    """A product of matrices leaves the pairs that lengths and common letters leave, also where letters share a column."""
    rng = random.Random(longest)
    sides = [["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)] for n in (50, 70)]
    lengths = [np.array([len(x) for x in side], np.int32) for side in sides]
    counts = [fuzzy._letter_counts(side, n) for side, n in zip(sides, lengths)]
    got = [(i, j) for a, b in fuzzy._may_match(lengths[0], counts[0], lengths[1], counts[1]) for i, j in zip(a.tolist(), b.tolist())]
    common = np.minimum(counts[0][:, None, :], counts[1][None, :, :]).sum(axis=2)
    n, m = lengths[0][:, None], lengths[1][None, :]
    fits = (np.abs(n - m) <= (n + m - 1) // 4) & (np.maximum(n, m) - common <= (n + m - 1) // 4)
    assert sorted(got) == [tuple(x) for x in np.argwhere(fits).tolist()] and len(got) == len(set(got)) and got


def test_names_are_read_once(spark):
    """Suggestions read the names several times; what the names are made from is read for them once."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    names = spark.createDataFrame(random_names(1), SCHEMA).mapInPandas(counted, SCHEMA)
    for suggest in (fuzzy.locality_suggestions, fuzzy.identity_suggestions):
        before = read.value
        assert suggest(names, "tenant").count() and read.value - before == 70


def test_long_names_and_letters_beyond_ascii(spark):
    rng = random.Random(6)
    change = lambda text, n: "".join(rng.choice("xy") if i in set(rng.sample(range(len(text)), n)) else c for i, c in enumerate(text))
    long = "".join(rng.choice("abcdefghij") for _ in range(150))
    texts = [long, change(long, 20), change(long, 75), "山川湖海", "山川湖泊", "straße am see", "strasse am see", "дом у реки", "дом у горы", "x" * 60, "x" * 66, "x" * 80]
    frame = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, tenant int, name string")
    got = {(r["id_1"], r["id_2"], r["distance"]) for r in fuzzy.similar_texts(frame, "tenant", "id", "name").collect()}
    pairs = [(i, j, edit_distance(texts[i], texts[j])) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    assert got == {(i, j, d) for i, j, d in pairs if d < (len(texts[i]) + len(texts[j])) / 4}


SCHEMA = "id long, name string, tenant int, n_media long, code string"


@pytest.mark.parametrize("seed", range(4))
def test_similar_names_are_complete(spark, seed):
    rows = random_names(seed)
    got = fuzzy.locality_suggestions(spark.createDataFrame(rows, SCHEMA), "tenant").collect()
    expected = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[2] == b[2]:
                d = edit_distance(a[1], b[1])
                if d < (len(a[1]) + len(b[1])) / 4:
                    expected.add((a[0], b[0], d) if a[3] < b[3] else (b[0], a[0], d))
    assert {(r["from_id"], r["to_id"], r["distance"]) for r in got} == expected and len(got) == len(expected)


@pytest.mark.parametrize("block", [4_096, 7])
def test_similar_texts_in_blocks(spark, block):
    rng = random.Random(11)
    syllables = ["ka", "lo", "mi", "ren", "stu", "vor", "ž"]
    names = sorted({"".join(rng.choice(syllables) for _ in range(rng.randint(1, 6))) + str(rng.randint(0, 30)) for _ in range(120)})
    texts = spark.createDataFrame([(i % 2, i, n) for i, n in enumerate(names)] + [(0, 900, ""), (0, 901, None)], "tenant int, id long, name string")
    got = {(r["tenant"], r["id_1"], r["id_2"], r["distance"]) for r in fuzzy.similar_texts(texts, "tenant", "id", "name", block).collect()}
    expected = {
        (i % 2, i, j, d) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and i % 2 == j % 2 and (d := edit_distance(a, b)) < (len(a) + len(b)) / 4
    }
    assert got == expected


def test_candidates_are_fewer_than_pairs(spark):
    rng = random.Random(12)
    names = sorted({"".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(6)) + str(rng.randint(0, 999)) for _ in range(2_000)})
    texts = spark.createDataFrame([(0, i, n) for i, n in enumerate(names)], "tenant int, id long, name string")
    met = fuzzy.candidate_pairs(texts, "tenant", "id", "name").count()
    assert met < 0.5 * len(names) * (len(names) - 1) / 2


def test_copies_accents_and_codes(spark):
    rows = [
        (1, "Háj", 0, 5, "B1"), (2, "Haj", 0, 9, None), (3, "Haj", 0, 1, None), (4, "Zcela jiny nazev", 0, 1, "B1"),
        (5, "Haj", 1, 1, "B1"), (6, "Dlouhy nazev A", 0, 1, None), (7, "Dlouhy nazev", 0, 1, None), (8, "", 0, 1, None), (9, "", 0, 1, None),
    ]
    names = spark.createDataFrame(rows, SCHEMA)
    got = {(r["from_id"], r["to_id"], r["distance"]) for r in fuzzy.identity_suggestions(names, "tenant").collect()}
    assert got == {(1, 2, 0), (3, 2, 0), (4, 1, 0), (7, 6, 2)}
    with_null = {(r["from_id"], r["to_id"]) for r in fuzzy.identity_suggestions(names, "tenant", null_codes_match=True).collect()}
    assert (3, 2) in with_null and (9, 2) in with_null and (8, 2) in with_null


def test_suggestion_order(spark):
    rows = random_names(9)
    found = fuzzy.locality_suggestions(spark.createDataFrame(rows, SCHEMA), "tenant")
    ordered = fuzzy.suggestion_order(found, "tenant").collect()
    assert len(ordered) == found.count()
    for tenant in {r["tenant"] for r in ordered}:
        own = sorted((r for r in ordered if r["tenant"] == tenant), key=lambda r: r["position"])
        keys = [(r["distance"], -len(r["kept_name"]), r["from_id"], r["to_id"]) for r in own]
        assert keys == sorted(keys) and [r["position"] for r in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("short", [False, True])
def test_names_in_filenames(spark, short):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abAB") for _ in range(n))
    files = [(i, text(rng.randint(0, 12)), i % 2) for i in range(60)]
    identities = [(f"i{i}", text(rng.randint(1 if short else 3, 5)), rng.choice([None, "", text(3)]), i % 2) for i in range(25)]
    got = fuzzy.names_in_filenames(
        spark.createDataFrame(files, "media_id long, filename string, tenant int"),
        spark.createDataFrame(identities, "identity string, name string, code string, tenant int"),
    ).collect()
    expected = {}
    for m, name, tenant in files:
        for i, pattern, code, owner in identities:
            hits = (pattern.lower() in name.lower()) + bool(code and code.lower() in name.lower())
            if hits and tenant == owner:
                expected[m, i] = 0.1 * hits
    assert {(r["media_id"], r["identity"]): pytest.approx(r["score"]) for r in got} == expected


def places(rng, n, box):
    return [(i, f"{rng.uniform(-box, box):.3f},{rng.uniform(-box, box):.3f}" if rng.random() > 0.1 else None) for i in range(n)]


@pytest.mark.parametrize("box", [0.4, 80.0])
def test_nearest_area(spark, box):
    rng = random.Random(int(box))
    localities, areas = places(rng, 60, box), places(rng, 12, box)
    areas += [(50, areas[0][1]), (51, "0.0,0.0"), (52, "junk")]
    localities += [(100, "200.0,170.0"), (101, "no place"), (102, "0.0,0.0")]
    got = geojoin.nearest_area(spark.createDataFrame(localities, "id long, location string"), spark.createDataFrame(areas, "id long, location string")).collect()
    point = lambda s: tuple(map(float, s.split(","))) if s and "," in s else None
    for r in got:
        here = point(r["location"])
        if here is None:
            assert r["closest_area_id"] is None
            continue
        best = min((math.sqrt((here[0] - p[0]) ** 2 + (here[1] - p[1]) ** 2), i) for i, s in areas if (p := point(s)))
        assert (r["closest_area_id"], r["area_distance"]) == (best[1], pytest.approx(best[0]))
    assert len(got) == len(localities)


def test_nearby(spark):
    rng = random.Random(3)
    rows = places(rng, 80, 0.3) + [(200, "0.0,0.0"), (201, "0.0,0.0"), (202, "0.1,0.0")]
    df = spark.createDataFrame(rows, "id long, location string")
    point = {i: tuple(map(float, s.split(","))) for i, s in rows if s}
    near = lambda a, b: math.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) < 0.1
    got = {r["id"]: r["nearby"] for r in geojoin.nearby_counts(df).collect()}
    assert got == {i: sum(near(point[i], p) for p in point.values()) if i in point else 0 for i, _ in rows}
    assert {r["id"] for r in geojoin.localities_near(df, 200).collect()} == {i for i, p in point.items() if near(p, (0.0, 0.0))}


def test_patterns_in_shards_and_blocks(spark):
    """A stem that all files and patterns share gathers nothing: a file meets every shard once, and no group exceeds its share."""
    files = spark.createDataFrame([(i, f"Panthera_{i:04d}_Panthera.JPG", i % 3 and 1) for i in range(900)] + [(900, None, 1), (901, "", 1), (902, "Panthera_0001", None)], "media_id long, filename string, tenant int")
    identities = spark.createDataFrame([(f"i{i}", f"panthera_{i:04d}", "panthera" if i % 2 else None, 1) for i in range(400)] + [("none", None, None, 1), ("all", "panthera", "", 1)], "identity string, name string, code string, tenant int")
    got = {(r["media_id"], r["identity"]): round(r["score"], 3) for r in fuzzy.names_in_filenames(files, identities, shard_patterns=100, block_files=50).collect()}
    mine = [i for i in range(900) if i % 3]
    expected = {(i, f"i{j}"): 0.1 for i in mine for j in range(1, 400, 2)} | {(i, "all"): 0.1 for i in mine}
    expected |= {(i, f"i{i}"): 0.2 if i % 2 else 0.1 for i in mine if i < 400}
    assert got == expected
    patterns = fuzzy._patterns(identities)
    text = files.selectExpr("tenant", "media_id", "lower(filename) as _text").filter("tenant = 1 and _text is not null")
    dealt, spread = fuzzy.placed_files(text, patterns, 100, 50)
    shards = -(-patterns.count() // 100)
    assert dealt.count() == text.count() * shards
    for placed, share in ((dealt, 50), (spread, 100)):
        assert placed.groupBy("tenant", "_shard", "_block").count().agg({"count": "max"}).first()[0] < 2 * share


def test_nothing_to_match(spark):
    files, identities = "media_id long, filename string, tenant int", "identity string, name string, code string, tenant int"
    empty = lambda schema: spark.createDataFrame([], schema)
    assert fuzzy.names_in_filenames(empty(files), empty(identities)).isEmpty()
    assert fuzzy.names_in_filenames(spark.createDataFrame([(1, "a", 1)], files), empty(identities)).isEmpty()
    place = "id long, location string"
    one = spark.createDataFrame([(1, "1.0,2.0"), (2, None)], place)
    assert {(r["closest_area_id"], r["area_distance"]) for r in geojoin.nearest_area(one, empty(place)).collect()} == {(None, None)}
    assert geojoin.nearest_area(empty(place), one).isEmpty() and geojoin.nearby_counts(empty(place)).isEmpty()
    odd = spark.createDataFrame([(1, "NaN,1.0"), (2, "Infinity,1.0"), (3, "1.0,1.0")], place)
    assert {r["id"]: r["closest_area_id"] for r in geojoin.nearest_area(odd, odd).collect()} == {1: None, 2: None, 3: 3}
    assert {r["id"]: r["nearby"] for r in geojoin.nearby_counts(odd).collect()} == {1: 0, 2: 0, 3: 1}


@pytest.mark.parametrize("tile", [20, 200])
def test_nearest_of_many_areas(spark, tile):
    """Areas in a dense town and far ones, points far from every area: tiles stay of like size and the answers exact."""
    rng = np.random.default_rng(tile)
    areas = np.round(np.concatenate((rng.normal(0, 0.05, (900, 2)), rng.uniform(-80, 80, (300, 2)), np.stack((np.full(100, 7.0), np.linspace(-9, 9, 100)), 1))), 3)
    points = np.round(np.concatenate((rng.normal(0, 0.1, (300, 2)), rng.uniform(-80, 80, (100, 2)), rng.uniform(1e6, 2e6, (20, 2)))), 3)
    frame = lambda a: spark.createDataFrame([(i, f"{x},{y}") for i, (x, y) in enumerate(a.tolist())], "id long, location string")
    got = {r["id"]: (r["closest_area_id"], r["area_distance"]) for r in geojoin.nearest_area(frame(points), frame(areas), tile).collect()}
    far = np.sqrt((points[:, None, 0] - areas[None, :, 0]) ** 2 + (points[:, None, 1] - areas[None, :, 1]) ** 2)
    assert got == {i: (int(far[i].argmin()), float(far[i].min())) for i in range(len(points))}
    spots = geojoin.with_coordinates(frame(areas)).selectExpr("lat as _alat", "lon as _alon", "id as _area").dropDuplicates(["_alat", "_alon"])
    sizes = [r["count"] for r in geojoin._tiled(spots, tile).groupBy("_tile").count().collect()]
    assert max(sizes) < 3 * tile and len(sizes) <= 3 * 1300 / tile


def test_packed_places_look_into_few_leaves():
    rng = np.random.default_rng(1)
    places_ = rng.uniform(0, 1, (20_000, 2))
    tree = geojoin._Packed(places_[:, 0], places_[:, 1], np.arange(20_000))
    x, y = rng.uniform(0, 1, (2, 50))
    best, found = tree.nearest(x, y)
    far = np.sqrt((x[:, None] - places_[:, 0]) ** 2 + (y[:, None] - places_[:, 1]) ** 2)
    assert (best == far.min(1)).all() and (found == far.argmin(1)).all()
    assert (geojoin._box_distance(x, y, tree.boxes) <= best[:, None]).sum(1).max() <= 9  # of 313 leaves


def test_nearby_counts_of_a_town(spark):
    """100,000 places of one town: sums instead of pairs."""
    rng = np.random.default_rng(4)
    xy = rng.normal(0, 0.06, (100_000, 2))
    xy[:1000] = np.round(xy[:1000], 1)  # whole multiples of the radius apart
    df = spark.createDataFrame([(i, f"{x!r},{y!r}") for i, (x, y) in enumerate(xy.tolist())], "id long, location string")
    counts = geojoin.nearby_counts(df)
    got = {r["id"]: r["nearby"] for r in counts.select("id", "nearby").collect()}
    some = np.concatenate((np.arange(300), rng.integers(0, 100_000, 700)))
    for i in some.tolist():
        assert got[i] == int((np.sqrt((xy[i, 0] - xy[:, 0]) ** 2 + (xy[i, 1] - xy[:, 1]) ** 2) < 0.1).sum())
    assert len(got) == 100_000


def test_offsets_of_cells():
    inner, border = geojoin._around(4)
    assert (0, 0) in inner and not set(inner) & set(border)
    both = set(border) | {(-x, -y) for x, y in border}
    rng = np.random.default_rng(9)
    a, b = rng.uniform(-9, 9, (2, 20_000, 2))
    near = np.hypot(*(a - b).T) < 4
    apart = [tuple(x) for x in (np.floor(b) - np.floor(a)).astype(int).tolist()]
    assert all(n for n, o in zip(near, apart, strict=True) if o in inner) and all(o in both or o in inner for n, o in zip(near, apart, strict=True) if n)
