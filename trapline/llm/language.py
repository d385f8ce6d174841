"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm.tables import least_hashed

# n-grams of one to three characters; a character takes 21 bits of a code.
LENGTHS = (1, 2, 3)
# Length of a profile, of languages and of documents.
PROFILE = 300
# Documents per language that profiles are learned from, the ones of the smallest hash.
SAMPLE = 2_000
UNKNOWN = "und"

RESULT = "lang_pred string, score double"

# Which code points are letters, a bit each; as a value, so that it travels with the functions that read it.
LETTERS = np.packbits(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000), bitorder="little")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a text: lower case, words of letters with one space around each."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = (LETTERS[chars >> 3] >> (chars & 7).astype(np.uint8) & 1).astype(bool)
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    chars = np.where(letter, chars, 32).astype(np.int64)
    chars = chars[letter | np.concatenate(([True], letter[:-1]))]
    codes = [chars[chars != 32]]
    for n in LENGTHS[1:]:
        code = chars[: len(chars) - n + 1]
        for k in range(1, n):
            code = (code << 21) | chars[k : len(chars) - n + 1 + k]
        codes.append(code)
    codes = np.sort(np.concatenate(codes))
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """The profiles of all languages, and the out-of-place distance of a document to each."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.languages, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([np.asarray(profiles[name], np.int64) for name in self.languages] or [np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.languages), len(self.codes) + 1), -1, np.int64)
        for row, name in zip(self.ranks, self.languages, strict=True):
            row[np.searchsorted(self.codes, profiles[name])] = np.arange(len(profiles[name]))

    def distances(self, order: np.ndarray) -> np.ndarray:
        """Sum over the document's n-grams of how far each is out of place, as a share of the most possible."""
        at = np.searchsorted(self.codes, order)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == order[known]
        ranks = self.ranks[:, np.where(known, at, len(self.codes))]
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(order))), self.size)
        return apart.sum(axis=1) / (self.size * len(order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the smallest distance (ties: the first by name) and one less that distance."""
        codes, counts = grams(text) if text else ((), ())
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        far = self.distances(ranked(codes, counts, self.size))
        return self.languages[int(far.argmin())], float(1 - far.min())


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, size: int = PROFILE) -> Profiles:
    """Profiles from a bounded sample: of every language the ``sample`` documents whose ids have the smallest hashes.

    Rows without text, language or id teach nothing. n-grams are counted by Spark; only the
    profiles, ``size`` codes a language, come to the driver. No labelled rows: no profiles.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null and id is not null")
    picked = least_hashed(rows.select("lang", "id"), "lang", "id", sample).distinct()
    chosen = rows.join(F.broadcast(picked), ["lang", "id"]).select("lang", "text")  # sample rows of each language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pandas()
            for lang, texts in table.groupby("lang")["text"]:
                found = [grams(t) for t in texts]
                codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                total = np.bincount(where, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "code": codes, "n": total})

    counts = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in counts.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= size).select("lang", "code", "rank").collect():
        profiles.setdefault(row.lang, []).append((row.rank, row.code))
    return Profiles({lang: [code for _, code in sorted(found)] for lang, found in profiles.items()}, size)


def identify(text: Column, profiles: Profiles) -> Column:
    """Struct of ``lang_pred`` and ``score`` (0 to 1) for every whole text.

    Null and letterless texts are ``und`` with score 0, as is everything without profiles. Each
    text is judged by itself: no shuffle, and a very long text costs one sort of its n-grams.
    """

    @F.pandas_udf(RESULT)
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([profiles.predict(t if isinstance(t, str) else None) for t in texts], columns=["lang_pred", "score"])

    return predicted(text)


def trains(id_col: str = "doc_id") -> Column:
    """Whether a document's id lets it teach: crc32 of the id as text, modulo 5, isn't 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def identify_documents(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out`` (the id doesn't teach), ``lang_pred`` and ``score`` of every document.

    A null id counts as held out neither way: ``held_out`` is null. Repeated rows stay.
    """
    profiles = learn(documents.filter(trains()), sample=sample)
    return documents.select("doc_id", (~trains()).alias("held_out"), identify(F.col("text"), profiles).alias("_found")).select("doc_id", "held_out", "_found.*")
