"""Phrase collocations: counts of contiguous word sequences in transducers, joined by ranges of prefixes.

A phrase that is frequent enough is made of frequent words and phrases, so levels of words, pairs,
triples and so on are counted by hash one after another, and each level looks only at what the
level before left over. These passes leave nothing frequent out; they only keep the rest from being
written. What is left is counted as text: a task sorts its sequences, cuts them into ranges of their
first two words and builds a transducer for each. The transducers of a range are united in a tree,
their weights summed. To look up the parts of phrases, every range asks the ranges of the parts for
the different parts it needs, and composes its phrases with the answers.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm import tokens
from trapline.llm.tables import kept
from trapline.llm.transducer import Transducer, summed_rows, union

# Candidates: words of a phrase at most, and occurrences at least. A phrase goes if a longer one has this share of its occurrences.
WORDS, LEAST, SHARE = 3, 10, 50
# The score is this many times a * a / (l * r); each language's first TOP phrases are returned.
SCALE, TOP = 1_000_000, 2_000
# The bytes that end a piece, and those that end a word.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
GAP = BREAK.copy()
GAP[[*b" \t"]] = True
# Hashes that a task holds before it gives out their sums, sequences of pieces before it adds them up, and different ones before it gives out transducers.
HELD_HASHES, HELD_ROWS, HELD_PATHS = 4_000_000, 3_000_000, 1_000_000
# Bits of a filter for each frequent hash, and of a filter at least and at most (16 MB); a full filter lets more through and loses nothing.
BITS, LEAST_BITS, MOST_BITS = 16, 2**16, 2**27
_BLOCK = 2**16  # bits of a filter that one task packs
# Sequences of a range about, ranges at most, transducers united in one step, and copies of a range's transducer for its askers.
RANGE_PATHS, MOST_RANGES, FAN_IN, COPIES = 50_000, 4_000, 16, 8

_UNKNOWN = "und"


class Words:
    """The words of some rows, with hashes, and which ones go on in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = tokens.flat(texts)
        data = tokens.LOWER[data]
        gap = GAP[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(~gap & (edge[:-1] | np.concatenate(([True], gap[:-1]))[: len(data)]))
        self.ends = np.flatnonzero(~gap & (edge[1:] | np.concatenate((gap[1:], [True]))[: len(data)])) + 1
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(self.starts, offsets)))
        breaks = np.cumsum(BREAK[data], dtype=np.int32)[self.starts]  # a word's first byte is none
        self.goes_on = (rows[1:] == rows[:-1]) & (breaks[1:] == breaks[:-1])  # of every word but the last
        coded = langs.fill_null(_UNKNOWN).dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = np.asarray(coded.indices).astype(np.int64)[rows]
        # the different words, and the number of each word among them; only the different ones are hashed
        sizes = np.concatenate(([0], np.cumsum(self.ends - self.starts))).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(sizes), pa.py_buffer(data[~gap])).dictionary_encode()
        self.names, self.number = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        chars, cuts = tokens.flat(self.names)
        self.hashes = tokens.span_hashes(chars, cuts[:-1], cuts[1:])[self.number]
        self.first = tokens.mix(self.hashes ^ lang_hashes(self.langs)[self.lang])

    def __len__(self) -> int:
        return len(self.starts)

    def keys(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the sequences of ``length`` words that start at ``at``; those of two words order them by their first."""
        key = self.first[at]
        if length > 1:
            key = (key >> np.uint64(32) << np.uint64(32)) | (tokens.mix(self.hashes[at + 1]) >> np.uint64(32))
        for k in range(2, length):
            key = tokens.mix(key * np.uint64(0xD6E8FEB86659FD93) + self.hashes[at + k])
        return key

    def passing(self, filters: list[Filter], longest: int) -> Iterator[np.ndarray]:
        """For 1 to ``longest`` words, the starts of the sequences in one piece that pass their filter (if there is one), as do their parts."""
        passed = np.ones(len(self), bool)
        for length in range(1, longest + 1):
            if length > 1:
                passed = np.append(passed[:-1] & passed[1:] & self.goes_on, False) if len(self) else passed
            at = np.flatnonzero(passed)
            if length <= len(filters):
                good = filters[length - 1](self.keys(at, length))
                passed[at] = good
                at = at[good]
            yield at


def lang_hashes(langs: list[str]) -> np.ndarray:
    data, offsets = tokens.flat(pa.array(langs, pa.large_string()))
    return tokens.mix(tokens.span_hashes(data, offsets[:-1], offsets[1:]) + np.uint64(1))


class Filter:
    """Bits of hashes; a hash whose bit isn't set isn't frequent."""

    def __init__(self, size: int, blocks: dict[int, bytes]):
        self.size = size
        self.bits = np.zeros(size // 8, np.uint8)
        for block, data in blocks.items():
            self.bits[block * _BLOCK // 8 : block * _BLOCK // 8 + len(data)] = np.frombuffer(data, np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        cells = tokens.mix(keys) & np.uint64(self.size - 1)
        return (self.bits[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for i, j, _, _ in tokens.pieces(batch.column("text")):
            yield Words(batch.column("text").slice(i, j - i), batch.column("lang").slice(i, j - i))


def hash_counts(rows: DataFrame, filters, length: int) -> DataFrame:
    """``key`` and ``n`` of the sequences of ``length`` words, summed in tasks; for words also ``lang`` and ``n`` of all words of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: defaultdict[str, int] = defaultdict(int)
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "n": n.astype(np.int64), "lang": pa.nulls(len(keys), pa.string())})

        for words in _pieces(batches):
            *_, at = words.passing(filters.value, length)
            held.append(words.keys(at, length))
            size += len(held[-1])
            if length == 1:
                for lang, n in zip(words.langs, np.bincount(words.lang, minlength=len(words.langs)).tolist(), strict=True):
                    totals[lang] += n
            if size >= HELD_HASHES:
                yield out()
                held, size = [], 0
        yield out()
        if totals:
            yield pa.RecordBatch.from_pydict({"key": pa.nulls(len(totals), pa.int64()), "n": pa.array(totals.values(), pa.int64()), "lang": pa.array(totals, pa.string())})

    return rows.mapInArrow(count, "key long, n long, lang string")


def filter_of(frequent: DataFrame, n: int) -> Filter:
    """The filter of the column ``key`` of ``n`` rows, packed in blocks; ``MOST_BITS`` bounds it."""
    size = LEAST_BITS
    while size < min(BITS * n, MOST_BITS):
        size *= 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = tokens.mix(np.asarray(batch.column("key")).view(np.uint64)) & np.uint64(size - 1)
            yield pa.RecordBatch.from_pydict({"block": (cells // np.uint64(_BLOCK)).astype(np.int64), "cell": (cells % np.uint64(_BLOCK)).astype(np.int32)})

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(_BLOCK, bool)
        bits[np.asarray(table.column("cell").combine_chunks())] = True
        return pa.table({"block": table.column("block").slice(0, 1), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    cells = frequent.select("key").mapInArrow(place, "block long, cell int").distinct()
    return Filter(size, {r.block: bytes(r.bits) for r in cells.groupBy("block").applyInArrow(pack, "block long, bits binary").collect()})


def _places(keys: np.ndarray) -> np.ndarray:
    """Where sequences with these hashes (of their first two words, or their word) lie in the order of ranges; not negative."""
    return (keys >> np.uint64(1)).astype(np.int64)


class Sequences:
    """Counts of the different sequences of a task, as rows of numbers: the language's and the words', 0 behind the last."""

    def __init__(self, longest: int):
        self.longest = longest
        self.number: dict[str, int] = {}  # words and languages, from 1 on
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def _numbers(self, names: list[str]) -> np.ndarray:
        number = self.number
        return np.array([number.setdefault(name, len(number) + 1) for name in names], np.int64)

    def add(self, words: Words, filters: list[Filter]) -> None:
        """Count the sequences that pass."""
        if not len(words):
            return
        local = words.number  # which tells words apart without hashes
        langs, ranks = self._numbers(words.langs), None
        for length, at in enumerate(words.passing(filters, self.longest), 1):
            if length == 1:  # only frequent words get a number
                some = np.unique(local[at])
                number = np.zeros(len(words.names), np.int64)
                number[some] = self._numbers(words.names.take(pa.array(some)).to_pylist())
                base, code = len(number), words.lang[at] * len(number) + local[at]
            else:
                code = ranks[at] * base + local[at + length - 1]
            _, first, inverse, counts = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
            ranks = np.zeros(len(words), np.int64)
            ranks[at] = inverse
            table = np.zeros((len(first), self.longest + 1), np.int32)
            table[:, 0] = langs[words.lang[at[first]]]
            for k in range(length):
                table[:, k + 1] = number[local[at[first] + k]]
            self.held.append((table, counts.astype(np.int64)))
            self.size += len(first)

    def sum(self) -> int:
        """Add up what is held; gives the number of different sequences."""
        if self.held:
            self.held = [summed_rows(*(np.concatenate(x) for x in zip(*self.held, strict=True)))]
        self.size = len(self.held[0][0]) if self.held else 0
        return self.size

    def transducers(self, cuts: np.ndarray) -> Iterator[tuple[int, Transducer]]:
        """A transducer for each range."""
        self.sum()
        if not self.size:
            return
        (table, counts), names = self.held[0], list(self.number)
        ranges = ranges_of(table, names, cuts)
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.zeros(len(names) + 1, np.int32)
        rank[np.array(order) + 1] = np.arange(1, len(names) + 1)
        table, words = rank[table], [names[i] for i in order]
        rows = np.lexsort((*table.T[::-1], ranges))
        table, counts, ranges = table[rows], counts[rows], ranges[rows]
        starts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(ranges)], strict=True):
            yield int(ranges[i]), Transducer.of_table(table[i:j], counts[i:j], words)


def ranges_of(table: np.ndarray, names: list[str], cuts: np.ndarray) -> np.ndarray:
    """The ranges of sequences (rows of a language and words: 1 + their place in ``names``)."""
    data, offsets = tokens.flat(pa.array([*names, ""], pa.large_string()))
    hashes = tokens.span_hashes(data, offsets[:-1], offsets[1:])
    key = tokens.mix(hashes[table[:, 1] - 1] ^ tokens.mix(hashes[table[:, 0] - 1] + np.uint64(1)))
    if table.shape[1] > 2:
        two = (key >> np.uint64(32) << np.uint64(32)) | (tokens.mix(hashes[table[:, 2] - 1]) >> np.uint64(32))
        key = np.where(table[:, 2] > 0, two, key)
    return np.searchsorted(cuts, _places(key), "right")


def shard_transducers(rows: DataFrame, filters, cuts, longest: int) -> DataFrame:
    """``range``, ``part`` and the packed ``machine`` of the sequences that pass, by task and range. A path is the language and the words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sequences(longest)

        def out() -> Iterator[pa.RecordBatch]:
            for at, machine in held.transducers(cuts.value):
                yield pa.RecordBatch.from_pydict({"range": [at], "machine": pa.array([machine.pack()], pa.binary())})

        for words in _pieces(batches):
            held.add(words, filters.value)
            if held.size >= HELD_ROWS and held.sum() >= HELD_PATHS:
                yield from out()
                held = Sequences(longest)
        yield from out()

    return rows.mapInArrow(build, "range long, machine binary").withColumn("part", F.spark_partition_id().cast("long"))


def united(machines: DataFrame, parts: int) -> DataFrame:
    """One transducer for each range: unions of ``FAN_IN`` tasks' parts at a time until one is left."""

    def unite(table: pa.Table) -> pa.Table:
        whole = union(map(Transducer.unpack, table.column("machine").to_pylist()))
        return pa.table({"range": table.column("range").slice(0, 1), "part": table.column("part").slice(0, 1), "machine": pa.array([whole.pack()], pa.binary())})

    while True:
        parts = -(-parts // FAN_IN)
        machines = machines.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("range", "part").applyInArrow(unite, "range long, part long, machine binary")
        if parts <= 1:
            return machines.drop("part")


def _ranges(paths: list[tuple[str, ...]], cuts: np.ndarray) -> np.ndarray:
    names = sorted({w for p in paths for w in p[:3]})
    at = {w: i + 1 for i, w in enumerate(names)}
    return ranges_of(np.array([[at[w] for w in (*p, *[""] * 2)[:3]] if len(p) > 2 else [at[p[0]], at[p[1]], 0] for p in paths], np.int64), names, cuts).astype(np.int64)


def _cuts_in(path: tuple[str, ...]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """First part and rest after each word but the last."""
    return [(path[: k + 1], (path[0], *path[k + 1 :])) for k in range(1, len(path) - 1)]


def scored(machines: DataFrame, cuts, least: int) -> DataFrame:
    """lang, phrase, words, a, l, r and score of every phrase of two words or more that is seen ``least`` times.

    ``machines`` has one transducer a range. Arithmetic is in integers of any size.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column("range").to_pylist(), batch.column("machine").to_pylist(), strict=True):
                parts = list({p for path, n in Transducer.unpack(data).paths() if len(path) > 2 and n >= least for cut in _cuts_in(path) for p in cut})
                if parts:
                    yield pa.RecordBatch.from_pydict({"asker": np.full(len(parts), at, np.int64), "range": _ranges(parts, cuts.value), "lang": [p[0] for p in parts], "part": [" ".join(p[1:]) for p in parts]})

    def answer(asked: pa.Table, machine: pa.Table) -> pa.Table:
        count = Transducer.unpack(machine.column("machine")[0].as_py()) if machine.num_rows else lambda path: 0
        found = [count((lang, *part.split(" "))) for lang, part in zip(asked.column("lang").to_pylist(), asked.column("part").to_pylist(), strict=True)]
        return pa.table({"asker": asked.column("asker"), "lang": asked.column("lang"), "part": asked.column("part"), "n": pa.array(found, pa.int64())})

    def compose(answers: pa.Table, machine: pa.Table) -> pa.Table:
        known = {(lang, *part.split(" ")): n for lang, part, n in zip(*[answers.column(c).to_pylist() for c in ("lang", "part", "n")], strict=True)}
        rows = []
        for path, a in Transducer.unpack(machine.column("machine")[0].as_py()).paths() if machine.num_rows else ():
            if len(path) > 2 and a >= least:
                cut = min((SCALE * a * a // (known[x] * known[y]), k, known[x], known[y]) for k, (x, y) in enumerate(_cuts_in(path)))
                rows.append((path[0], " ".join(path[1:]), len(path) - 1, a, cut[2], cut[3], cut[0]))
        names = {"lang": pa.string(), "phrase": pa.string(), "words": pa.int32(), "a": pa.int64(), "l": pa.int64(), "r": pa.int64(), "score": pa.int64()}
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(names.values())], names=list(names))

    asked = machines.mapInArrow(ask, "asker long, range long, lang string, part string").withColumn("copy", F.pmod("asker", F.lit(COPIES)))
    copies = machines.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long"))))
    answers = asked.groupBy("range", "copy").cogroup(copies.groupBy("range", "copy")).applyInArrow(answer, "asker long, lang string, part string, n long")
    return answers.groupBy("asker").cogroup(machines.groupBy("range")).applyInArrow(compose, "lang string, phrase string, words int, a long, l long, r long, score long")


def collocations(documents: DataFrame, longest: int = WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases.

    A-Z count as a-z. Pieces end at . , ; : ! ? and line breaks, words at spaces and tabs. A phrase
    of 2 to ``longest`` words that is seen a >= ``least`` times within pieces of a language (null:
    ``und``) is cut after the first words so that ``floor(SCALE * a * a / (l * r))`` is lowest, l and
    r being the occurrences of both parts; of equal cuts the one after fewer words counts. Phrases
    inside a longer one that has ``share`` % of their occurrences go, whether that one stays or not.
    Ranks are by score and a, descending, then phrase; n counts the words of the language. Null and
    empty texts have no words, long texts are read whole, repeated rows count again, and no rows give no rows.

    Counts are sums over all documents. Only filters (``MOST_BITS`` at most), cuts between ranges
    (``MOST_RANGES``) and nothing of the counts go through the driver.
    """
    spark = documents.sparkSession
    rows = documents.select("text", "lang")
    filters, frequent, totals = [], [], None
    for length in range(1, longest + 1):
        counted = hash_counts(rows, spark.sparkContext.broadcast(list(filters)), length)
        if length == 1:
            counted = kept(counted, "words")  # read twice
            totals = counted.filter("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
        many = kept(counted.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key"), f"frequent{length}")
        frequent.append((many, many.count()))
        filters.append(filter_of(*frequent[-1]))
    ranges = min(MOST_RANGES, max(1, math.ceil(sum(n for _, n in frequent) / RANGE_PATHS)))
    cuts = spark.sparkContext.broadcast(_range_cuts([many for many, _ in frequent[:2]], ranges))
    machines = kept(shard_transducers(rows, spark.sparkContext.broadcast(filters), cuts, longest), "machines")
    parts = machines.agg(F.max("part")).first()[0]
    whole = kept(united(machines, 1 if parts is None else parts + 1), "united")
    found = kept(scored(whole, cuts, least), "scored")
    return best(found, totals, share, top)


def _range_cuts(frequent: list[DataFrame], ranges: int) -> np.ndarray:
    """Places between the ranges: quantiles of the frequent words and pairs."""
    if ranges == 1:
        return np.empty(0, np.int64)
    places = frequent[0].unionByName(frequent[1]) if len(frequent) > 1 else frequent[0]
    at = places.select(F.shiftrightunsigned("key", 1).alias("place"))
    found = at.agg(F.percentile_approx("place", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("cuts")).first().cuts or []
    return np.unique(np.array(found, np.int64))


def best(found: DataFrame, totals: DataFrame, share: int, top: int) -> DataFrame:
    """Phrases that no longer one covers, ranked within their languages."""
    words = F.split("phrase", " ")
    starts = F.explode(F.expr("sequence(1, words - size + 1)"))
    inner = found.filter("words > 2").select("lang", "words", "a", words.alias("all")).withColumn("size", F.explode(F.expr("sequence(2, words - 1)")))
    inner = inner.withColumn("start", starts).select("lang", F.array_join(F.slice("all", F.col("start"), F.col("size")), " ").alias("phrase"), "a")
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = found.join(covered, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
