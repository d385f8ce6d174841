"""Collocations against counting in plain Python, and the transducers they are counted in."""

import random
import re
from collections import Counter, defaultdict

import pytest

from trapline.llm import phrases
from trapline.llm.transducer import Transducer, union


def brute(rows, longest=3, least=10, share=50, top=2000):
    counts, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            found = re.findall(r"[^ \t]+", piece)
            words[lang] += len(found)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(found[i : i + k]) for i in range(len(found) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= share * f[p[i:j]]}
        ranked = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, words[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, monkeypatch, seed):
    """Few words, so that phrases are frequent; small bounds take every branch."""
    monkeypatch.setattr(phrases, "RANGE_PATHS", 20)
    monkeypatch.setattr(phrases, "HELD_PATHS", 50)
    monkeypatch.setattr(phrases, "HELD_ROWS", 70)
    monkeypatch.setattr(phrases, "HELD_HASHES", 100)
    monkeypatch.setattr(phrases, "FAN_IN", 2)
    rng = random.Random(seed)
    words = ["The", "of", "naïve", "É", "東京", "a\x00b", "x\N{NO-BREAK SPACE}y", "-", "w1", "w2", "w3"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(60)))
    rows = [(text(), rng.choice(["en", "en", "fr", None, "und", ""])) for _ in range(120)] + [(None, "en"), ("", None), ("in a row " * 2000, "long"), (" .\t,", "blank")]
    docs = spark.createDataFrame([(t, lang, None) for t, lang in rows], "text string, lang string, part int").repartition(5)
    for longest, top in ((3, 2000), (3, 7), (4, 50)):
        assert rows_of(phrases.collocations(docs, longest=longest, top=top)) == brute(rows, longest, top=top)


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    assert rows_of(phrases.collocations(docs)) == brute(rows)


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")).collect() == []


def test_full_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_BLOCK", 8)
    monkeypatch.setattr(phrases, "LEAST_BITS", 8)
    monkeypatch.setattr(phrases, "MOST_BITS", 8)
    rows = [(f"a b c d{i % 3} e f", "en") for i in range(40)]
    assert rows_of(phrases.collocations(spark.createDataFrame(rows, "text string, lang string"))) == brute(rows)


def test_transducers():
    rng = random.Random(0)
    parts = [{tuple(rng.choice("abc") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 4) for _ in range(60)} for _ in range(5)]
    machines = [Transducer.unpack(Transducer.of(sorted(p.items())).pack()) for p in parts]
    for part, machine in zip(parts, machines, strict=True):
        assert dict(machine.paths()) == part and list(machine.paths()) == sorted(part.items())
    total = Counter()
    for part in parts:
        total.update(part)
    whole = union(machines)
    assert list(whole.paths()) == sorted(total.items())
    assert all(whole(p) == total[p] for p in total) and whole(("a", "z")) == whole(("z",)) == whole(()) == 0
    # equal states are one: nine sequences over two words share their ends
    square = Transducer.of(sorted({(a, b): 7 for a in "xyz" for b in "uvw"}.items()))
    assert len(square.counts) == 3 and len(square.labels) == 6
    assert list(Transducer.of([]).paths()) == []
    with pytest.raises(ValueError, match="ascend"):
        Transducer.of([(("b",), 1), (("a",), 1)])
