"""Alignment of two tokenizers over a corpus, with the corpus-wide counts of linked token pairs.

Both tokenizers never join a character that isn't white space with a space behind it, so a text is
cut there into segments that are tokenized on their own. The different segments of a piece of the
corpus are tokenized once, and everything a document needs is summed over its segments. Three
passes over the texts, none of which shuffles text: the first sums the pairs of each task, which
give the distinct pairs and a minimal perfect hash of them; the sums are then added as dense vectors
indexed by the hash, in a tree; the last pass aligns the documents again and looks the counts up.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm import tokens
from trapline.llm.perfect_hash import SHARD_KEYS, Counts, PerfectHash, shard_of
from trapline.llm.tables import kept

TOKENIZERS = "/opt/tokenizers"
# Bytes of text that a task aligns at once, segments aligned at once, and different pairs summed before they are given out.
PIECE_BYTES, AT_ONCE, HELD_PAIRS = 8_000_000, 20_000, 1_000_000
# Segments that the first tokenizer reads as one text.
JOINED = 256
# Pairs whose counts a task holds at once (16 bytes each and the hash); more pairs take more passes.
BLOCK_PAIRS = 4_000_000
# Rows of sums that go into one dense vector, and vectors that are added in one step.
VECTOR_ROWS, FAN_IN = 2_000_000, 16

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_of_character() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as characters: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, made in a task from the contents of their files."""

    def __init__(self, first: bytes, second: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(first.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        of = byte_of_character()
        written = self.a.get_vocab(with_added_tokens=False)
        made = [b""] * (max(written.values()) + 1)
        for token, i in written.items():
            made[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        space = "\N{LOWER ONE EIGHTH BLOCK}"
        read = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(space, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(space)
        self.width = len(read)  # a pair is id_a * width + id_b
        joined = {"a": made, "b": read}
        self.bytes = {k: np.frombuffer(b"".join(v), np.uint8) for k, v in joined.items()}
        self.offsets = {k: np.concatenate(([0], np.cumsum([len(x) for x in v]))).astype(np.int64) for k, v in joined.items()}
        self.ends = {sep: pa.array([f"{i}{sep}" for i in range(max(len(made), len(read)))], pa.large_string()) for sep in (",", "|", ";")}
        self.check(pieces, space)

    def check(self, pieces: list[str], space: str) -> None:
        """Segments may be tokenized alone only if no piece goes on with a space, and texts get a space in front."""
        if any(space in p.lstrip(space) for p in pieces):
            raise ValueError("a piece of the second tokenizer reaches over a space")

    def encode(self, segments: list[str], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both tokenizers for segments that start with a space (their bytes are ``data``), and the number of each segment's ids.

        The first tokenizer reads many segments at once: its tokens show by their bytes whose they are.
        """
        open_ = np.fromiter((s[-1].isspace() for s in segments), bool, len(segments))  # cut elsewhere, so not joined with the next
        number = np.arange(len(segments))
        cuts = [0, *np.flatnonzero(open_ | np.concatenate((open_[1:], [True])) | (number % JOINED == JOINED - 1)) + 1]
        units = ["".join(segments[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        a = self._flat([e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)])
        read, ends = self.spelled("a", a)
        if np.array_equal(read, data):
            n_a = np.diff(np.searchsorted(ends, offsets, "right"))
        else:
            single = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
            a, n_a = self._flat(single), np.fromiter(map(len, single), np.int64, len(single))
        b = [ids or [self.space] for ids in self.b.encode([s[1:] for s in segments], num_threads=1)]  # it adds the space
        return a, n_a, self._flat(b), np.fromiter(map(len, b), np.int64, len(b))

    @staticmethod
    def _flat(lists: list[list[int]]) -> np.ndarray:
        return np.fromiter(itertools.chain.from_iterable(lists), np.int64)

    def spelled(self, side: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``ids`` one after another, and the end of each."""
        starts, sizes = self.offsets[side][ids], self.offsets[side][ids + 1] - self.offsets[side][ids]
        ends = np.cumsum(sizes)
        return self.bytes[side][np.repeat(starts - (ends - sizes), sizes) + np.arange(sizes.sum())], ends


def segments_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different segments of ``texts`` with a space in front, the segment at every place, and each text's first place (n + 1 entries).

    Cut is before a space that follows a printable ASCII character or one of the letters U+00C0 to
    U+07FF. A null or empty text has no segment.
    """
    data, offsets = tokens.flat(texts)
    some = np.flatnonzero(np.diff(offsets))
    data = np.insert(data, offsets[some], 32)
    offsets = offsets + np.searchsorted(some, np.arange(len(offsets)), "left")
    before, lead = np.concatenate(([0], data[:-1])), np.concatenate(([0, 0], data[:-2]))
    solid = ((before > 32) & (before < 127)) | ((before >= 128) & (lead >= 0xC3) & (lead <= 0xDF))
    starts = np.zeros(len(data) + 1, bool)
    starts[:-1] = (data == 32) & solid[: len(data)]
    starts[offsets] = True
    cuts = np.flatnonzero(starts).astype(np.int64)
    made = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    return made.dictionary, np.asarray(made.indices), np.searchsorted(cuts, offsets)


class Segments:
    """What the different segments of a piece of the corpus contribute: token, group and link numbers, and pairs."""

    def __init__(self, aligner: Aligner, segments: pa.Array, strings: bool):
        parts = [self._part(aligner, segments.slice(i, AT_ONCE), strings) for i in range(0, len(segments), AT_ONCE)]
        joined = [np.concatenate(x) for x in zip(*(p[:6] for p in parts), strict=True)] if parts else [np.empty(0, np.int64)] * 6
        self.right, self.n_a, self.n_b, self.n_groups, self.n_links, self.pairs = joined
        self.right = self.right.astype(bool)
        self.written = [s for p in parts for s in p[6]]

    @staticmethod
    def _part(aligner: Aligner, segments: pa.Array, strings: bool):
        data, offsets = tokens.flat(segments)
        a, n_a, b, n_b = aligner.encode(segments.to_pylist(), data, offsets)
        right = np.ones(len(segments), bool)
        for side, ids, n in (("a", a, n_a), ("b", b, n_b)):  # both must spell the segment
            read, ends = aligner.spelled(side, ids)
            upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n)))]
            same = np.diff(upto) == np.diff(offsets)
            if same.all():
                differ = np.flatnonzero(read != data)
                same[np.searchsorted(offsets, differ, "right") - 1] = False
            else:
                same &= [read[upto[k] : upto[k + 1]].tobytes() == data[offsets[k] : offsets[k + 1]].tobytes() for k in range(len(same))]
            right &= same
        a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
        n_a, n_b = n_a * right, n_b * right
        ends_a, ends_b = aligner.spelled("a", a)[1], aligner.spelled("b", b)[1]
        starts_a = np.concatenate(([0], ends_a[:-1]))
        # the tokens of B from the one that holds A's first byte to the one that holds its last
        low, high = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(ends_b, ends_a, "left")
        links = high - low + 1
        left = np.repeat(np.arange(len(a)), links)
        upto = np.cumsum(links)
        pairs = a[left] * aligner.width + b[low[left] + np.arange(len(left)) - (upto - links)[left]]
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, both), np.searchsorted(ends_b, both)  # last tokens of the groups
        first = np.concatenate(([0], np.cumsum(n_a)))
        n_links = np.concatenate(([0], upto))[first]
        groups = np.searchsorted(last_a, first)
        written = []
        if strings:
            closes_a, closes_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
            closes_a[last_a], closes_b[last_b] = True, True
            group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
            # a group's A tokens come before its B tokens, behind all tokens of earlier groups
            tokens_b, tokens_a = np.concatenate(([0], last_b + 1)), np.concatenate((last_a + 1, [0]))
            place = np.concatenate((np.arange(len(a)) + tokens_b[group_a], np.arange(len(b)) + tokens_a[group_b]))
            size = len(aligner.ends[","])
            which = np.concatenate((a + size * closes_a, b + 2 * size * closes_b))
            table = pa.concat_arrays([aligner.ends[sep] for sep in (",", "|", ";")])
            ordered = np.empty(len(which), np.int64)
            ordered[place] = which
            chars, at = tokens.flat(table.take(pa.array(ordered)))
            cuts = at[first + np.concatenate(([0], np.cumsum(n_b)))]
            chars = chars.tobytes()
            written = [chars[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return right, n_a, n_b, np.diff(groups), np.diff(n_links), pairs, written


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about ``PIECE_BYTES``."""
    waiting, size = [], 0
    for batch in batches:
        for i, j, _, offsets in tokens.pieces(batch.column("text"), PIECE_BYTES):
            if waiting and size + offsets[-1] > PIECE_BYTES:
                yield pa.concat_batches(waiting)
                waiting, size = [], 0
            waiting.append(batch.slice(i, j - i))
            size += int(offsets[-1])
    if waiting:
        yield pa.concat_batches(waiting)


def _whole(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from each text's first place to the next one's."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[first])


def _usable(found: Segments, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts all of whose segments both tokenizers spell."""
    return _whole(~found.right[at], first) == 0


def pair_sums(rows: DataFrame, files) -> DataFrame:
    """``pair`` and ``n``, its links in some texts: the sums of one task, given out whenever it holds many pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value)
        held, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        for piece in _pieces(batches):
            segments, at, first = segments_of(piece.column("text"))
            found = Segments(aligner, segments, strings=False)
            usable = np.repeat(_usable(found, at, first), np.diff(first))
            times = np.bincount(at[usable], minlength=len(segments))
            keys = np.concatenate((held, found.pairs))
            weights = np.concatenate((sums, np.repeat(times, found.n_links)))
            order = np.argsort(keys, kind="stable")
            keys, weights = keys[order], weights[order]
            starts = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
            held = keys[starts]
            sums = np.add.reduceat(weights, starts) if len(starts) else sums[:0]
            held, sums = held[sums > 0], sums[sums > 0]
            if len(held) >= HELD_PAIRS:
                yield pa.RecordBatch.from_pydict({"pair": held, "n": sums})
                held, sums = held[:0], sums[:0]
        if len(held):
            yield pa.RecordBatch.from_pydict({"pair": held, "n": sums})

    return rows.select("text").mapInArrow(count, "pair long, n long")


def hashed(pairs: DataFrame, shards: int) -> DataFrame:
    """The minimal perfect hash of distinct pairs: ``shard``, ``size``, ``function`` and the ``keys`` by index."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("pair")).view(np.uint64)
            yield pa.RecordBatch.from_pydict({"pair": keys.view(np.int64), "shard": shard_of(keys, shards)})

    def build(table: pa.Table) -> pa.Table:
        keys = np.asarray(table.column("pair").combine_chunks()).view(np.uint64)
        function = PerfectHash.of(keys)
        by_index = np.empty(len(keys), np.uint64)
        by_index[function(keys)] = keys
        return pa.table({"shard": table.column("shard").slice(0, 1), "size": [len(keys)], "function": [function.pack()], "keys": [by_index.tobytes()]})

    return pairs.mapInArrow(shard, "pair long, shard long").groupBy("shard").applyInArrow(build, "shard long, size long, function binary, keys binary")


def _added(vectors: DataFrame, parts: int) -> DataFrame:
    """The vectors of each shard added ``FAN_IN`` at a time until one is left."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(data, np.int64) for data in table.column("counts").to_pylist()], axis=0)
        return pa.table({"shard": table.column("shard").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": [total.tobytes()]})

    while parts > 1:
        parts = -(-parts // FAN_IN)
        vectors = vectors.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("shard", "part").applyInArrow(add, "shard long, part long, counts binary")
    return vectors


def pair_counts(sums: DataFrame) -> tuple[DataFrame, int]:
    """``shard``, ``size``, ``function``, ``keys`` and ``counts`` of all pairs, and the number of shards.

    The sums are dealt to dense vectors of one shard each, and these are added in a tree.
    """
    distinct = kept(sums.select("pair").distinct(), "pairs")
    shards = max(1, math.ceil(distinct.count() / SHARD_KEYS))
    table = kept(hashed(distinct, shards), "hash")
    parts = max(1, math.ceil(sums.count() / shards / VECTOR_ROWS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("pair")).view(np.uint64)
            yield pa.RecordBatch.from_pydict({"shard": shard_of(keys, shards), "pair": keys.view(np.int64), "n": np.asarray(batch.column("n"))})

    def vector(sums: pa.Table, known: pa.Table) -> pa.Table:
        row = known.slice(0, 1).to_pylist()[0]
        keys = np.frombuffer(row["keys"], np.uint64)
        counts = np.zeros(len(keys), np.int64)
        if sums.num_rows:
            pairs = np.asarray(sums.column("pair").combine_chunks()).view(np.uint64)
            at = PerfectHash.unpack(row["function"])(pairs)
            if not (keys[at] == pairs).all():
                raise ValueError("a pair is not in the hash")
            np.add.at(counts, at, np.asarray(sums.column("n").combine_chunks()))
        return pa.table({"shard": [row["shard"]], "part": [row["part"]], "counts": [counts.tobytes()]})

    part = F.pmod(F.monotonically_increasing_id(), F.lit(parts))
    dealt = sums.mapInArrow(deal, "shard long, pair long, n long").withColumn("part", part)
    functions = table.select("shard", "function", "keys").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    vectors = dealt.groupBy("shard", "part").cogroup(functions.groupBy("shard", "part"))

    made = _added(vectors.applyInArrow(vector, "shard long, part long, counts binary"), parts)
    return kept(table.join(made.select("shard", "counts"), "shard"), "counts"), shards


def best_of(counts: DataFrame, width: int) -> np.ndarray:
    """The highest count of every id of the second tokenizer; as long as its vocabulary."""

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, found in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                ids, found = (np.frombuffer(keys, np.uint64) % np.uint64(width)).astype(np.int64), np.frombuffer(found, np.int64)
                best = np.zeros(width, np.int64)
                np.maximum.at(best, ids, found)
                some = np.flatnonzero(best)
                yield pa.RecordBatch.from_pydict({"id": some, "best": best[some]})

    rows = counts.select("keys", "counts").mapInArrow(highest, "id long, best long").groupBy("id").agg(F.max("best").alias("best")).collect()
    best = np.zeros(width, np.int64)
    for row in rows:
        best[row.id] = row.best
    return best


def _aligned(rows: DataFrame, files, shared) -> DataFrame:
    """One row a document, with what the links in the shards of ``shared`` (counts, best of each B id) sum to."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value)
        shards, parts, best = shared.value
        counts = Counts(shards, parts)
        for piece in _pieces(batches):
            segments, at, first = segments_of(piece.column("text"))
            found = Segments(aligner, segments, strings=True)
            known, where = np.unique(found.pairs, return_inverse=True)
            count = counts(known.view(np.uint64))
            is_best = (count > 0) & (count == best[known % aligner.width])
            upto = np.concatenate(([0], np.cumsum(found.n_links)))
            usable = _usable(found, at, first)
            columns = {"doc_id": piece.column("doc_id")}
            for name in ("n_a", "n_b", "n_groups", "n_links"):
                columns[name] = _whole(getattr(found, name)[at], first) * usable
            for name, values in (("n_best", is_best), ("count_sum", count)):
                columns[name] = _whole(_whole(values[where], upto)[at], first) * usable
            at, first = at.tolist(), first.tolist()
            written = []
            for k, good in enumerate(usable.tolist()):
                text = b"".join([found.written[s] for s in at[first[k] : first[k + 1]]]) if good else b""
                written.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
            yield pa.RecordBatch.from_pydict(columns | {"groups_sha256": pa.array(written, pa.string())})

    return rows.mapInArrow(align, RESULT)


def align_documents(documents: DataFrame, folder: str = TOKENIZERS, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    ``first`` (byte-level) and ``second`` (pieces) are files in ``folder``; the driver reads them and
    sends their contents. Tokens of a space and the text are linked where their byte ranges overlap,
    and groups end where tokens of both do. ``n_best`` counts the links whose pair of ids is, over
    all documents, the most frequent one of its second id, ``count_sum`` adds up the counts of the
    links' pairs. Null and empty texts, and texts that a tokenizer doesn't spell back, have zeros
    and ''. Repeated rows count each time and stay; a null doc_id stays null; long texts are aligned
    whole. No rows: no rows.

    What tasks hold is bounded: a piece of ``PIECE_BYTES`` (or one text), ``HELD_PAIRS`` sums, one
    shard's vector, and the counts of ``BLOCK_PAIRS`` pairs, which are broadcast. With more pairs the
    last pass is repeated for each block of them, and its sums are added.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    contents = []
    for name in (first, second):
        with open(os.path.join(folder, name), "rb") as file:
            contents.append(file.read())
    files = spark.sparkContext.broadcast(tuple(contents))
    width = Aligner(*contents).width
    counts, shards = pair_counts(kept(pair_sums(rows, files), "sums"))
    best = best_of(counts, width)
    blocks = max(1, math.ceil(shards * SHARD_KEYS / BLOCK_PAIRS))
    aligned = None
    for block in range(blocks):
        parts = {r.shard: (bytes(r.function), bytes(r["keys"]), bytes(r["counts"])) for r in counts.filter(F.col("shard") % blocks == block).drop("size").collect()}
        found = _aligned(rows, files, spark.sparkContext.broadcast((shards, parts, best)))
        aligned = found if aligned is None else aligned.union(found)
    if blocks == 1:
        return aligned
    # a row gives one row a block; rows that are equal in all else repeat and are counted
    same = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    summed = aligned.groupBy(*same).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.expr(f"count(1) div {blocks}").alias("_rows"))
    each = summed.withColumns({c: F.expr(f"{c} div _rows") for c in ("n_best", "count_sum")})
    return each.withColumn("_rows", F.explode(F.expr("sequence(1, _rows)"))).select(*aligned.columns)

