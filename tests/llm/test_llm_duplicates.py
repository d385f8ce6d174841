"""Duplicates, components and benchmark passages against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.llm import bitmaps, components, decontaminate, jaccard, lines, tokens

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def united(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- components -----------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 400 + i) for i in range(50)] + [(7, 7), (8, 9), (8, 9)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    used = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: c for n, c in united(used, links).items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_to_the_smallest_nodes_go_in_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "kept", lambda df, name, keep=components.kept: written.append(name) or keep(df, name))
    links = [(hub, n) for hub in (0, 5_000, 9_000) for n in range(hub + 1, hub + 3_000)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r["component"]: r["count"] for r in got.groupBy("component").count().collect()} == {0: 3_000, 5_000: 3_000, 9_000: 3_000}
    assert written.count("moves") == 1


@pytest.mark.parametrize("shape", ["ascending", "descending", "shuffled", "comb"])
def test_rounds_grow_with_the_logarithm(spark, monkeypatch, shape):
    written = []
    monkeypatch.setattr(components, "kept", lambda df, name, keep=components.kept: written.append(name) or keep(df, name))
    n = 1000
    order = list(range(n)) if shape != "descending" else list(range(n))[::-1]
    if shape == "shuffled":
        random.Random(1).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] if shape != "comb" else [(2 * i, 2 * i + 2) for i in range(n // 2 - 1)] + [(2 * i, 2 * i + 1) for i in range(n // 2)]
    got = components.components(spark.createDataFrame(links, "a long, b long").coalesce(1))
    assert got.filter("component = 0").count() == n
    assert written.count("moves") <= 24


class Asked:
    """Verifies by a list of links, and notes what it was asked; nothing can be ruled out by bitmaps."""

    def __init__(self, spark, nodes, links=None):
        self.spark, self.nodes, self.links, self.pairs = spark, nodes, links, []

    def sketches(self):
        return self.spark.createDataFrame([(n, 1, b"\0" * 8) for n in self.nodes], "node long, n long, bitmap binary")

    def __call__(self, pairs):
        self.pairs.extend((r["a"], r["b"]) for r in pairs.collect())
        if self.links is None:
            return pairs
        table = self.spark.createDataFrame(list(self.links), "x long, y long")
        return pairs.join(table, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")))


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_connect_loses_no_link(spark, rounds):
    rng = random.Random(rounds)
    true_links = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(35)}
    buckets = [(k, n) for k in range(14) for n in rng.sample(range(60), rng.randint(1, 16))]
    verify = Asked(spark, range(60), true_links)
    got = components.connect(spark.createDataFrame(buckets, "key long, node long"), verify, 75, rounds)
    met = {tuple(sorted(p)) for k in range(14) for p in itertools.combinations(sorted(n for b, n in buckets if b == k), 2)}
    expected = united(range(60), met & true_links)
    assert {r["node"]: r["component"] for r in got.collect()} == {n: c for n, c in expected.items() if (met & true_links) and any(n in p for p in met & true_links)}
    assert {tuple(sorted(p)) for p in verify.pairs} <= met


def test_connect_compares_a_large_group_by_its_hubs(spark):
    buckets = spark.createDataFrame([(k, n) for k in range(3) for n in range(400)], "key long, node long")
    verify = Asked(spark, range(400))
    got = components.connect(buckets, verify, 75)
    assert {r["component"] for r in got.collect()} == {0} and len(verify.pairs) == 399


@pytest.mark.parametrize("times", [2, 3, 4])
def test_connect_tells_buckets_of_repeated_nodes_apart(spark, times):
    groups = [(0, 1), (0, 2), (3, 4), (5, 6, 7), (8, 9)]
    repeated = [(k, n) for k, group in enumerate(groups) for n in group for _ in range(times)]
    mixed = [(k, n) for k, group in enumerate(groups) for i, n in enumerate(group) for _ in range(times if i else 1)]
    for rows in (repeated, mixed):
        got = components.connect(spark.createDataFrame(rows, "key long, node long").repartition(4), Asked(spark, range(10)), 75)
        assert {r["node"]: r["component"] for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5, 7: 5, 8: 8, 9: 8}


@pytest.mark.parametrize("block", [2_048, 5])
def test_close_pairs_against_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    base = tokens.mix(np.arange(300, dtype=np.uint64))
    sets = [np.sort(base[rng.random(300) < rng.choice([0.05, 0.5, 0.9, 0.95])]) for _ in range(60)]
    rows = [(k, n, n if n % 7 else 0) for k in range(6) for n in range(60) if rng.random() < 0.5 and len(sets[n])]
    sketches = spark.createDataFrame([(n, len(s), bitmaps.bitmap(s)) for n, s in enumerate(sets)], "node long, n long, bitmap binary")
    got = bitmaps.close_pairs(spark.createDataFrame(rows, "key long, node long, component long"), sketches, 75, block)
    found = {tuple(r) for r in got.collect()}
    met = {(a, b) for k in range(6) for (_, a, x), (_, b, y) in itertools.combinations(sorted(r for r in rows if r[0] == k), 2) if x != y}
    linked = {(a, b) for a, b in met if bitmaps.enough(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 75)}
    assert linked and linked <= found <= met and len(found) < len(met) / 2


@pytest.mark.parametrize("block", [2_048, 50])
def test_close_pairs_with_sets_give_few_links(spark, block):
    rng = np.random.default_rng(4)
    base = tokens.mix(np.arange(80, dtype=np.uint64))
    # pairs of a group share some three quarters of their members: most are near the threshold, on both sides
    sets = [np.sort(base[rng.random(80) < 0.86]) for _ in range(150)] + [np.sort(tokens.mix(base + np.uint64(k))) for k in range(10)]
    sketches = spark.createDataFrame([(n, len(s), bitmaps.bitmap(s), s.tobytes()) for n, s in enumerate(sets)], "node long, n long, bitmap binary, members binary")
    rows = spark.createDataFrame([(1, n, n if n % 9 else 0) for n in range(160)], "key long, node long, component long")
    read = lambda members: [np.frombuffer(x, np.uint64) for x in members]
    found = [tuple(r) for r in bitmaps.close_pairs(rows, sketches, 75, block, read).collect()]
    linked = {(a, b) for a, b in itertools.combinations(range(160), 2) if (a % 9 or b % 9) and bitmaps.enough(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 75)}
    same = [(0, n) for n in range(0, 160, 9)]
    assert set(found) <= linked and len(linked) > 1_000 and len(found) < (160 if block > 160 else 160 * 10)
    assert united(range(160), [*found, *same]) == united(range(160), [*linked, *same])


def test_bitmaps_of_many_pairs_as_of_one():
    rng = np.random.default_rng(5)
    sets = [tokens.mix(rng.integers(0, 400, n).astype(np.uint64)) for n in rng.integers(1, 300, 60)]
    sets = [np.unique(s) for s in sets]
    pairs = [(i, j) for i in range(60) for j in range(60)]
    n, m = (np.array([len(sets[p[k]]) for p in pairs]) for k in (0, 1))
    maps = [[bitmaps.bitmap(sets[p[k]]) for p in pairs] for k in (0, 1)]
    expected = [k for k in range(len(pairs)) if bitmaps.enough(bitmaps.most_common(maps[0][k], maps[1][k], n[k], m[k]), n[k], m[k], 75)]
    assert lines.possibly_alike(n, m, *maps, 75).tolist() == expected
    texts = ["ab".encode(), "täglich eine Zeile".encode(), b"aaaaaaaaaaaaaaaa", b"\xff short", b"a longer line of some words"] * 3
    assert all(np.array_equal(a, np.unique(lines.shingles(b))) for a, b in zip(lines.line_sets(texts), texts, strict=True))


# ---- jaccard join ---------------------------------------------------------------------------


def shingle_set(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute_components(rows):
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingle_set(text))
    links = [
        (i, j)
        for i, j in itertools.combinations(sorted(sets), 2)
        if any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j])
    ]
    return united(sets, links)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = make(40)
    texts = [make(rng.randint(1, 120)) for _ in range(n // 2)]
    while len(texts) < n:
        kind, base = rng.random(), list(rng.choice(texts))
        if kind < 0.5:  # a near copy
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
        elif kind < 0.7:  # texts that share a passage
            base = make(rng.randint(0, 30)) + passage + make(rng.randint(0, 30))
        elif kind < 0.8:
            base = passage + make(rng.randint(0, 14))
        else:
            base = base[: max(1, int(len(base) * rng.uniform(0.6, 1)))]
        texts.append(base)
    return [(i, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("parts", [4_000, 1])
def test_jaccard_join_against_all_pairs(spark, seed, parts, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT_PARTS", parts)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(docs).collect()}
    expected = brute_components(rows)
    assert got == {i: (len(shingle_set(t)), expected[i]) for i, t in rows}


def test_linked_sets_share_a_signature():
    """Of random sets and random classes of frequent tokens, every linked pair meets."""
    rng = np.random.default_rng(6)
    for turn in range(400):
        size = int(rng.choice([1, 2, 3, 4, 5, 7, 12, 40, 150]))
        base = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        other = base[rng.random(len(base)) > rng.choice([0, 0.1, 0.2])]
        other = np.unique(np.concatenate((other, rng.integers(0, 2**63, int(rng.integers(0, 1 + size // 4))).astype(np.uint64))))
        share = rng.choice([0, 0.3, 0.9, 1])
        frequent = np.unique(np.concatenate((base, other))[rng.random(len(base) + len(other)) < share])
        common = len(np.intersect1d(base, other))
        if len(other) and bitmaps.enough(common, len(base), len(other), 75):
            assert len(np.intersect1d(jaccard.signatures(base, frequent), jaccard.signatures(other, frequent))), (turn, size, share)


def test_signatures_of_frequent_tokens_stay_linear():
    shingles = np.unique(np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64))
    assert len(jaccard.signatures(shingles, shingles)) < 4 * len(shingles)


def test_bitmaps_bound_the_intersection():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 600, int(rng.integers(1, 400))).astype(np.uint64)) for _ in range(2))
        a, b = tokens.mix(a), tokens.mix(b)
        assert bitmaps.most_common(bitmaps.bitmap(a), bitmaps.bitmap(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_jaccard_join_of_odd_rows(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(9, None), (8, ""), (7, " \n\t"), (6, "one two"), (5, "ONE  two"), (4, "two one"), (3, long), (2, long + " end"), (2, long + " end"), (None, long), (None, None), (1, "é" * 5)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_shingles int, key string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [(9, 0, 9), (8, 0, 8), (7, 0, 7), (6, 1, 5), (5, 1, 5), (4, 1, 4), (3, 29_996, 2), (2, 29_997, 2), (2, 29_997, 2), (None, 29_996, None), (None, 0, None), (1, 1, 1)], key=str
    )
    assert jaccard.link_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_jaccard_join_of_rows_repeated_over_partitions(spark):
    rows = corpus(4, 60)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows * 2, 2), "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.link_components(docs).select("doc_id", "n_shingles", "component_id").collect())
    expected = brute_components(rows)
    assert got == sorted([(i, len(shingle_set(t)), expected[i]) for i, t in rows] * 2)


def test_many_ids_to_compare_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rows = corpus(3, 40)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


# ---- lines ----------------------------------------------------------------------------------


def line_shingles(line):
    line = line.strip(" \t\n\v\f\r").translate(LOWER)
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))} if line else set()


def brute_lines(rows, candidates=None):
    places = [(i, n, line_shingles(line)) for i, text in rows if text is not None for n, line in enumerate(text.split("\n"))]
    places = [p for p in places if p[2]]
    sets = {}
    for i, n, s in places:
        sets.setdefault(frozenset(s), []).append((i, n))
    keys = list(sets)
    links = [(x, y) for x, y in itertools.combinations(range(len(keys)), 2) if 100 * len(keys[x] & keys[y]) >= 75 * len(keys[x] | keys[y])]
    group = united(range(len(keys)), links)
    first = {}
    for x, k in enumerate(keys):
        first[group[x]] = min([*([first[group[x]]] if group[x] in first else []), *sets[k]])
    return {(i, n, *first[group[x]]) for x, k in enumerate(keys) for i, n in sets[k] if (i, n) != first[group[x]]}


def test_lines_against_all_pairs(spark):
    rng = random.Random(8)
    alphabet = "abcdefghijklmnopqrstuvwxyz é"
    line = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(3, 120)))
    pool = [line() for _ in range(40)]

    def pick():
        base = rng.choice(pool)
        if rng.random() < 0.3:
            at = rng.randrange(len(base))
            base = base[:at] + rng.choice("XYZ") + base[at + 1 :]
        return rng.choice(["", " ", "\t"]) + (base.upper().replace("É", "é") if rng.random() < 0.1 else base)

    rows = [(i, "\n".join(rng.choice([pick(), line(), ""]) for _ in range(rng.randint(1, 6)))) for i in range(70)]
    got = {tuple(r) for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    expected = brute_lines(rows)
    # bands find nearly all links; whatever is found is right
    assert len(got & expected) >= 0.97 * len(expected) and got <= expected | {g for g in got if g[:2] in {e[:2] for e in expected}}


def test_lines_that_stand_in_two_tasks(spark):
    rng = random.Random(12)
    line = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(100)).strip()
    texts = []
    for _ in range(20):
        base = "s" + line() + "e"
        texts += [base, base[:-1] + "!"]
    rows = list(enumerate(texts * 2))
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    assert {tuple(r) for r in lines.repeated_lines(docs).collect()} == brute_lines(rows)


def test_lines_of_odd_rows(spark):
    long = "x" * 200_000
    rows = [(3, None), (2, ""), (1, "\n\n"), (4, "same line\nsame line"), (5, " SAME line "), (5, " SAME line "), (None, "same line"), (6, long), (7, long + "\n" + "ab"), (8, "ab")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, line_no int")
    got = sorted(tuple(r) for r in lines.repeated_lines(docs).collect())
    assert got == [(4, 1, 4, 0), (5, 0, 4, 0), (5, 0, 4, 0), (7, 0, 6, 0), (8, 0, 7, 1)]
    left = {r["doc_id"]: r["text"] for r in lines.documents_without(docs.filter("doc_id > 3"), lines.repeated_lines(docs)).collect()}
    assert left == {4: "same line", 5: "", 6: long, 7: "ab", 8: ""}
    assert lines.repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_of_the_bands():
    rng = random.Random(9)
    found = total = 0
    for _ in range(300):
        base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(150))
        other = list(base)
        for _ in range(2):
            other[rng.randrange(150)] = rng.choice("QRST")
        a, b = base.encode(), "".join(other).encode()
        x, y = np.unique(lines.shingles(a)), np.unique(lines.shingles(b))
        common = len(np.intersect1d(x, y))
        if 100 * common >= 75 * (len(x) + len(y) - common):
            keys = lines.band_keys([a, b])
            total += 1
            found += bool((keys[0] == keys[1]).any())
    assert total > 100 and found / total >= 0.95


# ---- benchmark passages ---------------------------------------------------------------------


def test_masks_meet_every_accepted_passage():
    for window in range(15, 21):
        for wrong in itertools.combinations(range(window), window // 5):
            assert any(all(at + i not in wrong for i, bit in enumerate(mask) if bit == "1") for mask in decontaminate.MASKS for at in range(window - len(mask) + 1))
    for window in range(6, 15):
        assert len(decontaminate.MASKS[0]) <= window


def brute_passages(docs, items):
    split = lambda text: [w for w in re.split(r"[\W_]+", text.lower()) if w]
    found = {}
    for i, text in docs:
        words = split(text or "")
        for k, item in items:
            wanted = split(item or "")
            window = min(20, len(wanted))
            need = window - (window // 5 if window >= 15 else 0)
            if window < 6:
                continue
            best = 0
            for shift in range(-len(wanted), len(words)):
                equal = [0 <= shift + j < len(words) and words[shift + j] == w for j, w in enumerate(wanted)]
                best = max([best, *(sum(equal[o : o + window]) for o in range(len(wanted) - window + 1))])
            if best >= need:
                found[(i, k)] = (window, max(best, found.get((i, k), (0, 0))[1]))
    return {(i, k, *v) for (i, k), v in found.items()}


@pytest.mark.parametrize("chunk", [500_000, 40])
def test_passages_against_all_alignments(spark, chunk):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(60)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(make(rng.choice([3, 6, 9, 15, 18, 25, 40])))) for k in range(12)] + [(0, "other text of item none"), (50, None), (51, "")]
    docs = []
    for i in range(60):
        text = make(rng.randint(0, 40))
        if rng.random() < 0.7:
            item = rng.choice(items[:12])[1].split()
            part = item[rng.choice([0, 0, rng.randrange(len(item))]) :]
            part = [w if rng.random() > 0.12 else rng.choice(words) for w in part]
            text[len(text) // 2 : len(text) // 2] = part
        docs.append((i, rng.choice([" ", ", ", " \n"]).join(w.upper() if rng.random() < 0.2 else w for w in text)))
    docs += [(100, None), (101, ""), (None, items[3][1] + " x")]
    got = decontaminate.passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:2], "item_id long, text string"), broadcast_seeds=chunk)
    assert {tuple(r) for r in got.collect()} == brute_passages(docs, items)


def test_documents_without_passages(spark):
    item = " ".join(f"b{i}" for i in range(30))
    rows = [(1, "clean text of some words here"), (2, "x " * 5 + item), (2, "x " * 5 + item), (None, item), (None, None), (3, ""), (4, "y " * 50_000 + item)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(0, item, 1)], "item_id long, text string, doc_id int")
    assert sorted(((r["doc_id"], r["text"]) for r in decontaminate.without_passages(docs, benchmark).collect()), key=str) == sorted([(1, rows[0][1]), (None, None), (3, "")], key=str)
    assert decontaminate.without_passages(docs, benchmark.limit(0)).count() == 7
    assert decontaminate.passages(docs.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_rows_of_one_id_that_hit_one_alignment(spark, order):
    item = [f"b{i}" for i in range(20)]
    chance = item[:6] + [f"x{i}" for i in range(14)]  # meets a seed at the same shift, and is no passage
    for key in (None, 7):
        rows = [(key, " ".join(chance)), (key, " ".join(item))][::order]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
        got = decontaminate.passages(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
        assert [tuple(r) for r in got.collect()] == [(key, 1, 20, 20)]


def test_decontamination_keeps_columns_of_any_name(spark):
    item = " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "clean text", 5, 6, "a"), (2, item, 7, 8, "b")], "doc_id long, text string, key int, _key int, _llm_key string")
    left = decontaminate.without_passages(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, "clean text", 5, 6, "a")]


def test_decontamination_runs_no_python(spark, folder):
    docs, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.passages(docs, benchmark)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
