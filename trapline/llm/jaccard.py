"""Jaccard self-join of texts on word shingles, by prefixes of token combinations.

A document's tokens are the hashes of its distinct shingles. Two documents that link share all but
a few of them, so they share something in a prefix of a common order of all tokens. The order is:
rare tokens first, by hash, then the frequent ones, by hash. A rare token is indexed by itself. The
frequent ones are dealt by hash into classes, and what is indexed is every pair of tokens of one
class: a class of x tokens can lose x - 1 of them before no pair is common, so the prefix is
extended until the losses that it survives exceed those that a linked document may have. Texts that
only share a frequent passage have enough rare tokens and don't meet; texts that consist of
frequent passages meet in many small buckets instead of a few large ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm import tokens
from trapline.llm.bitmaps import bitmap, enough, most_common
from trapline.llm.components import connect
from trapline.llm.tables import kept, small_batches

# Words of a shingle; a link has 100 * intersection >= PERCENT * union.
WORDS = 5
PERCENT = 75
# A token is frequent if it is seen in a share of at least 1 / FREQUENT_PARTS of all documents, so
# there are at most FREQUENT_PARTS times as many of them as a document has tokens on average.
FREQUENT_PARTS = 4_000
# A task counts its tokens after each so many of them, and reports those seen this often.
COUNT_EVERY, SEEN = 2_000_000, 3
# Ids of documents to compare that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000

SKETCH = "doc_id long, n long, key binary, bitmap binary, token long, seen long"


def documents_of(batch: pa.RecordBatch, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every text of a batch."""
    for i, j, data, offsets in tokens.pieces(batch.column("text")):
        data = tokens.LOWER[data]
        starts, ends, first = tokens.word_spans(data, offsets)
        hashes = tokens.span_hashes(data, starts, ends)
        for row in range(i, j):
            yield row, np.unique(tokens.shingle_hashes(hashes[first[row - i] : first[row - i + 1]], words))


def set_key(shingles: np.ndarray) -> bytes:
    """A 128-bit hash of a set."""
    sums = [int(tokens.mix(shingles ^ np.uint64(odd)).sum(dtype=np.uint64)) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    return (sums[0] | sums[1] << 64).to_bytes(16, "little")


def band_limits(largest: int, percent: int = PERCENT) -> list[int]:
    """Smallest sizes of the bands: sets that can link are in the same band or in neighbouring ones."""
    limits = [1]
    while limits[-1] <= largest:
        limits.append(max(limits[-1] + 1, (limits[-1] - 1) * 100 // percent + 1))
    return limits


def signatures(shingles: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Index keys of a set (sorted, distinct hashes); ``frequent`` is sorted. Linked sets share one at least."""
    n = len(shingles)
    need = n - -(-percent * n // 100) + 1  # one more than a linked set may lack
    at = np.minimum(np.searchsorted(frequent, shingles), max(len(frequent) - 1, 0))
    is_frequent = frequent[at] == shingles if len(frequent) else np.zeros(n, bool)
    rare = shingles[~is_frequent]
    if len(rare) >= need:
        return rare[:need]
    common, need = shingles[is_frequent], need - len(rare)
    limits = band_limits(n, percent)
    found = [rare]
    for band in (len(limits) - 2, len(limits) - 1):  # this set's band, and the next for larger sets
        smallest = limits[max(band - 1, 0)]
        classes = smallest * percent // 300  # of three tokens that stay two can be spared for their classes
        seed = np.uint64(0x9E3779B97F4A7C15 * (band + 1) & (2**64 - 1))
        if classes == 0:
            found.append(tokens.mix(common[:need] ^ seed))
            continue
        dealt = (tokens.mix(common + seed) % np.uint64(classes)).astype(np.int64)
        first = np.zeros(len(common), bool)
        first[np.unique(dealt, return_index=True)[1]] = True
        upto = int(np.searchsorted(np.cumsum(~first), need)) + 1
        order = np.argsort(dealt[:upto], kind="stable")
        dealt, members = dealt[:upto][order], common[:upto][order]
        apart = 1
        while apart < len(members) and (same := dealt[apart:] == dealt[:-apart]).any():
            found.append(tokens.mix(members[:-apart][same] * np.uint64(0xD6E8FEB86659FD93) + members[apart:][same] + seed))
            apart += 1
    return np.concatenate(found)


def sketches(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """One row a document (doc_id, n, key, bitmap), and rows of tokens that a task has seen often (token, seen)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: set[bytes] = set()
        gathered: list[np.ndarray] = []
        size = 0

        def often():
            found, seen = np.unique(np.concatenate(gathered), return_counts=True) if gathered else (np.empty(0, np.uint64), np.empty(0, np.int64))
            found, seen = found[seen >= SEEN], seen[seen >= SEEN]
            none = [None] * len(found)
            return pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(none, pa.binary()), pa.array(found.view(np.int64)), pa.array(seen.astype(np.int64))], names)

        names = ["doc_id", "n", "key", "bitmap", "token", "seen"]
        for batch in batches:
            sizes, made, maps = [], [], []
            for _, shingles in documents_of(batch, words):
                sizes.append(len(shingles))
                made.append(set_key(shingles) if len(shingles) else None)
                maps.append(bitmap(shingles) if len(shingles) else None)
                if len(shingles) and made[-1] not in keys:
                    keys.add(made[-1])
                    gathered.append(shingles)
                    size += len(shingles)
                    if size >= COUNT_EVERY:
                        yield often()
                        gathered, size = [], 0
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(made, pa.binary()), pa.array(maps, pa.binary()), none, none], names)
        yield often()

    return documents.select("doc_id", "text").mapInArrow(sketch, SKETCH)


def link_components(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links) of every row.

    A-Z count as a-z, and words end at space and the controls 9 to 13. A text with fewer words than
    a shingle has one token, the whole; null, empty and wordless texts have none and link with
    nothing. A row without doc_id makes no links and has a null component. Repeated rows stay;
    rows that share a doc_id are one document. Whole texts are compared, and links are exact up
    to equal 64-bit hashes of different shingles within one pair.

    Shuffled are the index keys (about a quarter of the tokens, 16 bytes each), the bitmaps, and
    the tokens of the pairs that these leave. The frequent tokens are broadcast: see ``FREQUENT_PARTS`` for their bound.
    """
    spark = documents.sparkSession
    rows = small_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    sketch = kept(sketches(rows, words), "sketch")
    info = sketch.filter("token is null")
    total = info.count()
    often = sketch.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= max(2 * SEEN, total // FREQUENT_PARTS))
    frequent = spark.sparkContext.broadcast(np.sort(np.fromiter((r.token for r in often.select("token").toLocalIterator()), np.int64).view(np.uint64)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: set[bytes] = set()  # copies within a task are indexed once; equal keys link them all
        for batch in batches:
            ids, found, nodes = batch.column("doc_id").to_pylist(), [], []
            for row, shingles in documents_of(batch, words):
                if ids[row] is None or not len(shingles) or (key := set_key(shingles)) in keys:
                    continue
                keys.add(key)
                found.append(signatures(shingles, frequent.value, percent))
                nodes.append(np.full(len(found[-1]), ids[row], np.int64))
            if found:
                yield pa.RecordBatch.from_pydict({"key": np.concatenate(found).view(np.int64), "node": np.concatenate(nodes)})

    buckets = rows.mapInArrow(index, "key long, node long")
    # texts with equal sets are linked by their keys alone
    classes = kept(info.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least <> most"), "classes")
    copies = info.select("doc_id", "key").join(classes, "key").filter("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    found = connect(buckets, Verifier(rows, info, words, percent), percent, known=copies)
    out = info.select("doc_id", F.col("n").alias("n_shingles")).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


class Verifier:
    """Links among candidate pairs: sizes and bitmaps rule most out, the others are compared token by token."""

    def __init__(self, rows: DataFrame, info: DataFrame, words: int, percent: int):
        self.rows, self.words, self.percent = rows, words, percent
        self.info = info.select("doc_id", "n", "key", "bitmap").filter("n > 0 and doc_id is not null")

    def tokens(self, pairs: DataFrame) -> DataFrame:
        """The tokens of the documents in ``pairs``, from their texts."""
        words = self.words

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [s.tobytes() for _, s in documents_of(batch, words)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "tokens"])

        ids = kept(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "compared")
        if ids.count() <= BROADCAST_IDS:  # else the texts are shuffled
            ids = F.broadcast(ids)
        return kept(self.rows.join(ids, "doc_id", "left_semi").mapInArrow(read, "doc_id long, tokens binary"), "tokens")

    def sketches(self) -> DataFrame:
        return self.info.select(F.col("doc_id").alias("node"), "n", "bitmap")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent
        of = lambda table, c: table.select(*[F.col(x).alias(c if x == "doc_id" else f"{c}_{x}") for x in table.columns])

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_bitmap", "b_bitmap", "a_key", "b_key")]
                same = [k == l for k, l in zip(*cols[4:], strict=True)]
                keep = [s or enough(most_common(x, y, n, m), n, m, percent) for s, n, m, x, y in zip(same, *cols[:4], strict=True)]
                out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.bool_())], ["a", "b", "same"])
                yield out.filter(pa.array(keep, pa.bool_()))

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("a_tokens").to_pylist(), batch.column("b_tokens").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.sort(np.concatenate((x, y)))
                    keep.append(enough(int((both[1:] == both[:-1]).sum()), len(x), len(y), percent))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        # sizes first: they are narrow, and rule out most pairs that only share a passage
        sizes = self.info.select("doc_id", "n").distinct()
        alike = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
        near = pairs.join(of(sizes, "a"), "a").join(of(sizes, "b"), "b").filter(alike).select("a", "b").distinct()
        sketched = near.join(of(self.info, "a"), "a").join(of(self.info, "b"), "b").select("a", "b", "a_n", "b_n", "a_bitmap", "b_bitmap", "a_key", "b_key")
        left = kept(sketched.mapInArrow(possible, "a long, b long, same boolean"), "possible")
        compare = left.filter("not same").select("a", "b").distinct()
        sets = self.tokens(compare)
        compare = compare.join(of(sets, "a"), "a").join(of(sets, "b"), "b")
        return left.filter("same").select("a", "b").union(compare.select("a", "b", "a_tokens", "b_tokens").mapInArrow(linked, "a long, b long"))
