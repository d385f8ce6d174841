"""Operators that judge each text or url by itself, and the models they learn."""

import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from trapline.llm import language, pseudo_likelihood, toxicity, urls

LONG = "word " * 60_000


# ---- urls -----------------------------------------------------------------------------------

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.Example.ORG/es/1?x=/de/", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("https://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("https://x.com/DE/", "x.com", "/DE/", None, "allow"),
        ("https://org", "org", "", None, "allow"),
        ("https://casino.net?x", "casino.net", "", None, "block"),
        ("https://casinos.net/", "casinos.net", "/", None, "allow"),
        ("https://www.cheap-pills.org/", "www.cheap-pills.org", "/", "org/", "allow"),
        ("https://poker.net/", "poker.net", "/", None, "allow"),
        ("https://poker.net/free-poker", "poker.net", "/free-poker", None, "block"),
        ("https://bet.net/win-win", "bet.net", "/win-win", None, "block"),
        ("a://b://c", "b:", "//c", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://" + "a" * 100_000 + ".org/", "a" * 100_000 + ".org", "/", "org/", "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x"), (1, url, "x"), (None, url, "y")], "page_id long, url string, host string")
    got = urls.judge_pages(pages, rules=RULES).collect()
    assert len(got) == 3
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_url_terms_against_a_scan_of_every_place():
    rng = random.Random(2)
    vocabulary = urls.Vocabulary(("ab", "aba"), {"ba": 0.5, "c": 0.6, "ab-c": 0.5})
    machine = urls.automaton(vocabulary)
    beside = lambda text, i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
    for _ in range(300):
        text = "".join(rng.choice("abc-é") for _ in range(rng.randint(0, 12)))
        expected = {t for t in ("ab", "aba", "ba", "c", "ab-c") for i in range(len(text)) if text.startswith(t, i) and not beside(text, i - 1) and not beside(text, i + len(t))}
        assert urls.terms_in(text, machine) == expected


def test_urls_of_an_empty_table(spark):
    assert urls.judge_pages(spark.createDataFrame([], "page_id long, url string")).count() == 0


# ---- languages ------------------------------------------------------------------------------


def slow_prediction(text, profiles):
    """The out-of-place distance with dictionaries."""
    letters = [c if c.isalpha() else " " for c in text.lower()]
    padded = " " + " ".join("".join(letters).split()) + " "
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            if padded[i : i + n] != " ":
                counts[padded[i : i + n]] = counts.get(padded[i : i + n], 0) + 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    order = sorted((-n, code(g)) for g, n in counts.items())[: language.PROFILE]
    far = {}
    for name, profile in profiles.items():
        rank = {c: i for i, c in enumerate(profile)}
        far[name] = sum(abs(rank[c] - i) if c in rank else language.PROFILE for i, (_, c) in enumerate(order))
    best = min(far, key=lambda name: (far[name], name))
    return best, 1 - far[best] / (language.PROFILE * len(order))


def test_language_against_dictionaries(spark):
    rng = random.Random(1)
    words = {"aa": ["the", "of", "and", "thing"], "bb": ["der", "die", "und", "über"], "cc": ["le", "été", "de", "que"]}
    make = lambda name: " ".join(rng.choice(words[name]) for _ in range(rng.randint(1, 30))) + rng.choice(["", ".", " 42!", "\n"])
    rows = [(i, make(name), name) for i, name in enumerate(rng.choice(list(words)) for _ in range(90))]
    profiles = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50)
    by_name = {name: [int(profiles.codes[i]) for i in np.argsort(np.where(r[:-1] < 0, 10**9, r[:-1]))[: (r[:-1] >= 0).sum()]] for name, r in zip(profiles.languages, profiles.ranks)}
    assert set(by_name) == set(words)
    for _, text, name in rows[:40]:
        got = profiles.predict(text)
        expected = slow_prediction(text, by_name)
        assert got[0] == expected[0] and got[1] == pytest.approx(expected[1])


def test_language_functions_travel_by_value(spark):
    """A fresh interpreter without the package reads what a worker is sent."""
    packed = cloudpickle.dumps((language.grams, language.Profiles({"xx": [ord("a")]})))
    code = "import pickle, sys; f, p = pickle.load(sys.stdin.buffer); assert 'trapline' not in sys.modules; print(f('ab1 \u00e9')[0].tolist()[:2], p.predict('a!'))"
    done = subprocess.run([sys.executable, "-c", code], cwd="/", input=packed, capture_output=True, timeout=60)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.startswith(b"[97, 98] ('xx', ")


def test_language_of_odd_rows(spark):
    rows = [(0, None, "en"), (1, "", "en"), (2, "42 + 1 = 43", "en"), (3, "the thing and the other thing", "en"), (4, LONG, "en"), (5, "der die das und", "de"), (5, "der die das und", "de"), (None, "the word", "en"), (6, "der", None)]
    schema = "doc_id long, text string, lang string, lang_pred string, score int"
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    got = language.identify_documents(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2))
    assert by[4]["lang_pred"] == "en" and by[6]["lang_pred"] == "de" and by[None]["held_out"] is None
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.identify_documents(spark.createDataFrame([], schema)).count() == 0
    nothing = language.identify_documents(spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")).first()
    assert nothing["lang_pred"] == "und"


def test_language_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = language.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.9


# ---- toxicity -------------------------------------------------------------------------------


def slow_segments(values):
    """Maximal scoring segments by their recursive definition: the best segment (shortest, then leftmost), then both sides."""
    best = None
    for i in range(len(values)):
        for j in range(i + 1, len(values) + 1):
            total = sum(values[i:j])
            if total > 1e-9 and (best is None or total > best[0] + 1e-9 or (abs(total - best[0]) <= 1e-9 and j - i < best[2] - best[1])):
                best = (total, i, j)
    if best is None:
        return []
    _, i, j = best
    return slow_segments(values[:i]) + [best] + [(t, a + j, b + j) for t, a, b in slow_segments(values[j:])]


def test_segments_against_the_definition():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(0, 12)
        hits = [(i, rng.choice([0.3, 0.7, 1.1, 1.9])) for i in range(n) if rng.random() < 0.4]
        values = [-0.25] * n
        for i, s in hits:
            values[i] = s
        got = [(round(s, 6), a, b) for s, a, b in toxicity.segments(hits, n, 0.25)]
        expected = [(round(s, 6), a, b) for s, a, b in slow_segments(values)]
        assert [g[0] for g in got] == [e[0] for e in expected], (values, got, expected)


def test_log_odds():
    counts = {"the": (900, 100), "idiot": (0, 60), "once": (0, 1), "rare": (1, 0), "none": (0, 0)}
    odds = toxicity.log_odds(counts)
    assert set(odds) == {"idiot"}
    assert toxicity.log_odds({}) == {} and toxicity.log_odds({"a": (3, 0)}) == {}


def test_toxic_documents_of_the_tables(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").filter("held_out")
    rows = [(r["predicted"], r["toxic"], r["score"]) for r in got.collect()]
    assert sum(p == t for p, t, _ in rows) / len(rows) >= 0.9
    assert all(0 <= s <= 1 and p == (s >= 0.7) for p, _, s in rows)


def test_toxicity_of_odd_rows(spark):
    bad, good = "you idiot scum loser moron", "that is a fine day with some words"
    rows = [(i, f"{bad} {i}" if i % 2 else f"{good} {i}", i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(100, None, "x"), (101, "", "x"), (102, LONG, "x"), (None, bad, "x"), (103, bad, "x"), (103, bad, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (100, None), (101, 1), (7, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 66
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[103] > by[102] and by[100] == by[101] == by[102] and by[None] == by[103]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score_documents(empty, labels).count() == 0
    one_class = toxicity.score_documents(docs, labels.filter("toxic = 0")).collect()
    assert {r["score"] for r in one_class} == {0.5}


def test_scores_agree_over_samples(spark):
    rng = random.Random(4)
    plain, bad = [f"w{i}" for i in range(300)], [f"bad{i}" for i in range(12)]
    rows = []
    for i in range(3000):
        toxic = i % 20 == 0
        words = [rng.choice(plain) for _ in range(30)]
        for _ in range(rng.choice([1, 2, 3]) if toxic else rng.random() < 0.15):
            words[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int").drop("toxic"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    every, some = toxicity.learn(docs, labels), toxicity.learn(docs, labels, sample=600)
    weights = {r["toxic"]: r["weight"] for r in toxicity.sampled(docs, labels, 600).collect()}
    assert weights == {0: 4.75, 1: 1.0}
    # without weights the means are 0.079 and 0.153, and the text of one toxic word goes from 0.30 to 0.70
    means = [sum(model.score(t) for _, t, _ in rows) / len(rows) for model in (every, some)]
    assert abs(means[0] - means[1]) < 0.02
    one = " ".join(plain[:29] + bad[:1])
    assert abs(every.score(one) - some.score(one)) < 0.05


def test_passages_hold_the_toxic_words(spark):
    model = toxicity.Model({"idiot": 3.0, "scum": 3.0}, 0.25, 1.0, 0.01)
    text = "a " * 40 + "idiot b scum " + "a " * 40 + "scum"
    (row,) = spark.createDataFrame([(text,)], "t string").select(toxicity.find_passages(F.col("t"), model).alias("p")).collect()
    assert [(p["first"], p["end"]) for p in row["p"]][0] == (40, 43)


# ---- pseudo-likelihood ----------------------------------------------------------------------


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    network = pseudo_likelihood.Network.start(5, 2, 3)
    ids = rng.integers(0, 6, 40)
    around = network.around(ids)
    values = network.vector().astype(np.float64)
    loss = lambda v: -float(network.filled(v).log_probabilities(around, ids).astype(np.float64).mean())
    trained = network.filled(values)
    squares = [np.zeros_like(p) for p in trained.parts()]
    trained.train(around, ids, squares, rate=1e-3)
    step = trained.vector() - network.vector()
    for place in rng.integers(0, len(values), 25):  # the first step of Adagrad goes against the sign of the gradient
        up, down = values.copy(), values.copy()
        up[place] += 1e-2
        down[place] -= 1e-2
        slope = (loss(up) - loss(down)) / 2e-2
        if abs(slope) > 1e-3:
            assert np.sign(step[place]) == -np.sign(slope)


def test_a_step_against_plain_sums():
    rng = np.random.default_rng(1)
    for n, hidden in ((128, 4), (128, 3), (70, 4)):  # with and without whole blocks and pairs of columns
        network = pseudo_likelihood.Network.start(9, 2, hidden)
        ids = rng.integers(0, 10, n)
        around = network.around(ids)
        embed, base, out, bias = (p.astype(np.float64) for p in network.parts())
        grads = [np.zeros_like(p) for p in (embed, base, out, bias)]
        for words, own in zip(around, ids, strict=True):
            h = np.tanh(base + sum(embed[k][w] for k, w in enumerate(words)))
            p = np.exp(h @ out + bias)
            p = p / p.sum() - (np.arange(10) == own)
            back = (out @ p) * (1 - h * h)
            for k, w in enumerate(words):
                grads[0][k][w] += back / n
            for grad, more in zip(grads[1:], (back, np.outer(h, p), p), strict=True):
                grad += more / n
        squares = [np.ones_like(p) for p in network.parts()]
        network.train(around, ids, squares, rate=0.5)
        for new, old, square, grad in zip(network.parts(), (embed, base, out, bias), squares, grads, strict=True):
            assert square == pytest.approx(1 + grad * grad, abs=1e-5)
            assert new == pytest.approx(old - 0.5 * grad / np.sqrt(1 + grad * grad), abs=1e-5)


def test_texts_are_read_together_as_alone():
    spaces = "".join(f"a{chr(c)}b" for c in range(0x110000) if chr(c).isspace() or c in (0, 0x200B, 0x180E, 0xFEFF))
    texts = ["first", None, "", " \u3000\x1c", " the cat\tTHE \n", "\u0130ST \u03a3\u0391\u03a3 x\0y \U0010ffff\u4e00q", spaces, "cat rare words"]
    for some in (texts, texts[1:4], []):
        words, lengths = pseudo_likelihood.words_of_all(pa.array(["cut", *some], pa.string()).slice(1))
        assert words.to_pylist() == [w for t in some for w in pseudo_likelihood.words_of(t)]
        assert lengths.tolist() == [len(pseudo_likelihood.words_of(t)) for t in some]
    pairs = np.unique(np.concatenate([before << 21 | char for before, char, _ in [pseudo_likelihood.spelled(["rare", "words", "here"])]]))
    spelling = pseudo_likelihood.Spelling(pairs, np.arange(1.0, len(pairs) + 1))
    known = pseudo_likelihood.Lexicon({"the": 1, "cat": 2, "a": 3}, 2, np.array([0, 1, 2, 2]), np.log([1.0, 1.0, 0.25, 0.75]), spelling)
    symbols, lengths, fixed = known.read(pa.array(texts))
    assert symbols.tolist() == [known.symbols[i] for t in texts for i in pseudo_likelihood.ids_of(t, known.numbers)]
    for text, got in zip(texts, fixed, strict=True):
        expected = 0.0
        for word in pseudo_likelihood.words_of(text):
            number = known.numbers.get(word, 0)
            before, char, _ = pseudo_likelihood.spelled([word])
            expected += known.within[number] if number else spelling.log_pairs(before, char).sum()
        assert got == pytest.approx(expected, abs=1e-9)


def test_words_are_counted_whole_when_a_task_knows_too_many(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "COUNT_AT", 30)
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(20)) for i in range(300)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = {r["word"]: r["n"] for r in pseudo_likelihood.word_counts(docs).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == Counter(w for t in texts for w in pseudo_likelihood.words_of(t))


def test_probabilities_sum_to_one():
    network = pseudo_likelihood.Network.start(4, 2, 3)
    ids = np.array([1, 2, 3, 0, 4])
    around = network.around(ids)
    assert (around[0][:2] == 5).all() and (around[0][2:] == [2, 3]).all()
    total = sum(np.exp(network.log_probabilities(around, np.full(5, k))) for k in range(5))
    assert np.allclose(total, 1)


def test_scores_against_one_text_at_a_time(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 50))) for _ in range(60)] + [None, "", "  \n", LONG]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "a b")], "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    words = pseudo_likelihood.vocabulary(docs, 5)
    assert len(words) == 5 and words[0] == "word"
    network = pseudo_likelihood.train(docs, words, rounds=1, one_in=2, step=32)
    numbers = {w: i + 1 for i, w in enumerate(words)}
    got = {r["doc_id"]: r for r in pseudo_likelihood.score(docs, network, words).collect()}
    assert len(got) == 65
    for i, text in enumerate(texts):
        ids = pseudo_likelihood.ids_of(text, numbers)
        expected = network.log_probabilities(network.around(ids), ids).sum() if len(ids) else 0
        assert got[i]["n_tokens"] == len(ids) and got[i]["log_probability"] == pytest.approx(expected, rel=1e-3, abs=1e-3)
        assert (got[i]["per_token"] is None) == (len(ids) == 0)


def test_every_word_has_a_probability_of_its_own(spark):
    rng = random.Random(6)
    known = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(rng.choice(known[: 1 + int(400 * rng.random() ** 2)]) for _ in range(40)) for _ in range(200)] + [f"{w}a" for w in known[:50]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = pseudo_likelihood.lexicon(docs, 20, 7)
    assert len(words.numbers) > 300 and words.size == 27
    for symbol in range(1, 28):  # the known words of a symbol share its probability
        assert not (words.symbols == symbol).any() or np.exp(words.within[words.symbols == symbol]).sum() == pytest.approx(1)
    spell = words.spelling.log_probabilities
    assert spell(["abcde"])[0] > spell(["a?cde"])[0] > spell(["\u4e00?\u4e01??"])[0] and np.isfinite(spell(["\0", "\U0010ffff" * 1000])).all()
    assert spell(["ab", "abc", "ab"]) == pytest.approx([spell(["ab"])[0], spell(["abc"])[0], spell(["ab"])[0]])
    frame = [f"{known[0]} {w} {known[1]}" for w in (*known[300:310], "aaaaaaaa", "zq?zq", "hgfedcba")]
    got = pseudo_likelihood.score(spark.createDataFrame(list(enumerate(frame)), "doc_id long, text string"), pseudo_likelihood.train(docs, words), words).collect()
    by_id = {r["doc_id"]: r["log_probability"] for r in got}
    assert len({round(v, 6) for i, v in by_id.items() if i >= 10}) == 3 and by_id[11] < by_id[10] < max(by_id[i] for i in range(10))


def test_every_position_is_trained_on_once(spark):
    lengths = np.array([0, 1, 2, 3, 50, 1])
    for rounds in (1, 2, 3):  # each position has one turn, and long texts are dealt evenly
        taken = pseudo_likelihood.turns(lengths, rounds)
        assert len(taken) == 57 and set(taken) <= set(range(rounds)) and np.ptp(np.bincount(taken[6:56], minlength=rounds)) <= 1
    # equal texts of two words: positions that are left out of one are left out of all
    texts = [f"{a}{b} {b}{a}" for a in "abcd" for b in "efgh"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 60)], "doc_id long, text string").coalesce(1)
    words = sorted({w for t in texts for w in t.split()})
    network = pseudo_likelihood.train(docs, words, step=8)
    per_token = [r["per_token"] for r in pseudo_likelihood.score(docs.limit(16), network, words).collect()]
    assert len(per_token) == 16 and min(per_token) > -1.5  # -3.5 by chance


def test_training_raises_the_likelihood(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    words = pseudo_likelihood.vocabulary(docs)
    mean = lambda network: pseudo_likelihood.score(docs, network, words).agg(F.sum("log_probability") / F.sum("n_tokens")).first()[0]
    assert mean(pseudo_likelihood.train(docs, words)) > mean(pseudo_likelihood.Network.start(len(words))) + 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pseudo_likelihood.score_documents(empty).count() == 0
