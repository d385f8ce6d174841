"""Near-duplicate lines by MinHash over character shingles; one line of each component stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm import tokens
from trapline.llm.bitmaps import bitmap, folded
from trapline.llm.components import connect
from trapline.llm.tables import kept, small_batches

# Characters of a shingle; two lines are alike if they share PERCENT of their shingles.
SHINGLE, PERCENT = 8, 75
# Hashes of a band, and bands: a pair at the threshold shares a band with a probability of 0.98, at 0.85 with 0.9994.
ROWS, BANDS = 4, 10

_ODD = (tokens.mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_NEWLINE = 10
# Characters that are hashed at once, and ids of lines that are broadcast at most (8 bytes each).
PIECE_CHARS, BROADCAST_IDS = 100_000, 1_000_000


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every line, and for each row (n + 1 entries) the number of its first line. A text has a line at least."""
    breaks = np.flatnonzero(data == _NEWLINE)
    # an empty text starts where the next one does: each keeps its own line
    owner = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1))
    order = np.lexsort((np.concatenate((np.zeros(len(offsets) - 1), np.ones(len(breaks)))), np.concatenate((offsets[:-1], breaks + 1)), owner))
    starts, owner = np.concatenate((offsets[:-1], breaks + 1))[order], owner[order]
    last = np.concatenate((owner[1:] != owner[:-1], [True])) if len(owner) else np.empty(0, bool)
    ends = np.where(last, offsets[owner + 1], np.concatenate((starts[1:], [0])) - 1) if len(owner) else np.empty(0, np.int64)
    return starts, ends, np.searchsorted(owner, np.arange(len(offsets)))


def trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line borders without the spaces and control characters at both ends."""
    ink = np.flatnonzero(~tokens.SPACE[data])
    first, last = np.searchsorted(ink, starts), np.searchsorted(ink, ends) - 1
    some = first <= last
    ink = np.concatenate((ink, [0]))
    return np.where(some, ink[np.minimum(first, len(ink) - 1)], starts), np.where(some, ink[last] + 1, starts)


def lines_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a batch: first row, lower-cased bytes, line starts, ends and hashes, and first line numbers of the rows."""
    for i, _, data, offsets in tokens.pieces(batch.column("text")):
        data = tokens.LOWER[data]
        starts, ends, first = line_spans(data, offsets)
        starts, ends = trimmed(data, starts, ends)
        yield i, data, starts, ends, tokens.span_hashes(data, starts, ends), first


def shingles(line: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` characters of a line; a shorter line is one shingle."""
    chars = np.frombuffer(line.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = min(size, len(chars))
    if not n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(chars) - n + 1, np.uint64)
    for k, odd in enumerate(tokens.powers(0x9E3779B97F4A7C15, n + 1)[1:]):
        total += (chars[k : len(chars) - n + 1 + k] + np.uint64(1)) * odd
    return tokens.mix(total)


def packed_shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the shingles of all lines (as ``shingles``), and where those of each line start and end."""
    chars = np.frombuffer(b"\n".join(lines).decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.append(np.flatnonzero(chars == _NEWLINE), len(chars))
    starts = np.append(0, ends[:-1] + 1)
    total = np.zeros(max(len(chars) - SHINGLE + 1, 0), np.uint64)
    plus = chars + np.uint64(1)
    for k, odd in enumerate(tokens.powers(0x9E3779B97F4A7C15, SHINGLE + 1)[1:]):
        total += plus[k : len(total) + k] * odd
    short = np.flatnonzero(ends - starts < SHINGLE)
    whole = [shingles(lines[i]) for i in short]  # lines of one shingle go behind the others
    first, last = starts, ends - SHINGLE + 1
    first[short], last[short] = len(total) + np.arange(len(short)), len(total) + np.arange(len(short)) + 1
    return np.concatenate([tokens.mix(total), *whole]), first, last


def band_keys(lines: list[bytes]) -> np.ndarray:
    """Lines x bands: hashes of the band number and the MinHash values in the band. No line is empty."""
    keys = np.empty((len(lines), BANDS), np.uint64)
    sizes = np.cumsum([len(line) + 1 for line in lines])
    i = 0
    while i < len(lines):  # pieces that stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + PIECE_CHARS)))
        found, first, last = packed_shingles(lines[i:j])
        values = np.append((found >> np.uint64(32)).astype(np.uint32), np.uint32(0))
        cuts = np.stack((first, last), 1).ravel()
        # the ends of lines are cut out as segments of their own
        order = np.argsort(first, kind="stable")
        cuts = cuts.reshape(-1, 2)[order].ravel()
        for band in range(BANDS):
            key = np.full(j - i, band + 1, np.uint64)
            for odd in _ODD[band * ROWS : (band + 1) * ROWS]:
                least = np.minimum.reduceat(values * odd, cuts)[::2]
                key = tokens.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            keys[i + order, band] = key
        i = j
    return keys


def line_sets(lines: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingles of every line. No line is empty."""
    sets: list[np.ndarray] = []
    sizes = np.cumsum([len(line) + 1 for line in lines])
    while (i := len(sets)) < len(lines):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + PIECE_CHARS)))
        found, first, last = packed_shingles(lines[i:j])
        for start, end in zip(first.tolist(), last.tolist(), strict=True):
            own = np.sort(found[start:end])
            new = own[1:] != own[:-1]
            sets.append(own if new.all() else own[np.concatenate(([True], new))])
    return sets


def possibly_alike(n: np.ndarray, m: np.ndarray, p: list[bytes], q: list[bytes], percent: int) -> np.ndarray:
    """Numbers of the pairs of sets (n and m members, bitmaps p and q) that bitmaps don't rule out."""
    most = np.minimum(n, m)
    sizes = np.array([(len(x), len(y)) for x, y in zip(p, q, strict=True)], np.int64).reshape(-1, 2)
    for left, right in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == (left, right)).all(axis=1))
        x, y = (np.frombuffer(b"".join([maps[i] for i in at]), np.uint8).reshape(len(at), size) for maps, size in ((p, left), (q, right)))
        size = min(left, right)
        apart = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(axis=1, dtype=np.int64)
        most[at] = np.minimum(most[at], (n[at] + m[at] - apart) // 2)
    return np.flatnonzero(100 * most >= percent * (n + m - most))


def _fresh(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None = None) -> Iterator[tuple[list[int], list[bytes]]]:
    """Hashes and bytes of the lines that a task meets for the first time, without empty ones; of those with ``wanted`` (sorted) hashes, if given."""
    seen: set[int] = set()
    for batch in batches:
        for _, data, starts, ends, hashes, _ in lines_of(batch):
            ids, lines = [], []
            raw = data.tobytes()
            if wanted is not None:
                own = hashes.view(np.int64)
                met = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own if len(wanted) else np.zeros(len(own), bool)
                starts, ends, hashes = starts[met], ends[met], hashes[met]
            for start, end, h in zip(starts.tolist(), ends.tolist(), hashes.view(np.int64).tolist(), strict=True):
                if end > start and h not in seen:
                    seen.add(h)
                    ids.append(h)
                    lines.append(raw[start:end])
            if ids:
                yield ids, lines


class Verifier:
    """Of candidate pairs of line hashes those whose lines share enough shingles."""

    def __init__(self, rows: DataFrame, percent: int):
        self.rows, self.percent, self.lines = rows, percent, None

    def prepare(self, nodes: DataFrame) -> None:
        """Keep the lines of ``nodes`` (one column, ``doc_id``) with the sizes and bitmaps of their sets."""

        ids, wanted = kept(nodes.withColumnRenamed("doc_id", "id"), "met"), None
        if ids.count() <= BROADCAST_IDS:  # else the lines are shuffled
            wanted = nodes.sparkSession.sparkContext.broadcast(np.sort(np.asarray(ids.toArrow().column("id"), np.int64)))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, lines in _fresh(batches, None if wanted is None else wanted.value):
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "line": pa.array(lines, pa.binary())})

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = line_sets(batch.column("line").to_pylist())
                columns = [batch.column("id"), batch.column("line"), pa.array(map(len, sets), pa.int64()), pa.array(map(bitmap, sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "line", "n", "bitmap"])

        met = self.rows.select("text").mapInArrow(read, "id long, line binary")
        if wanted is None:
            met = met.join(ids, "id", "left_semi")
        self.lines = kept(met.dropDuplicates(["id"]).mapInArrow(sketch, "id long, line binary, n long, bitmap binary"), "lines")

    sets = staticmethod(line_sets)

    def sketches(self) -> DataFrame:
        return self.lines.select(F.col("id").alias("node"), "n", "bitmap", F.col("line").alias("members"))

    def __call__(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent
        of = lambda c: self.lines.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("line", "n", "bitmap")])
        names = [f"{c}_{x}" for x in ("n", "bitmap", "line") for c in "ab"]

        def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, m = (np.asarray(batch.column(c)) for c in names[:2])
                at = possibly_alike(n, m, *[batch.column(c).to_pylist() for c in names[2:4]], percent)
                close = batch.take(pa.array(at))
                x, y = (close.column(c).to_pylist() for c in names[4:])
                lines = list({*x, *y})  # the smallest line of a bucket is in many pairs
                sets = dict(zip(lines, line_sets(lines), strict=True))
                both = [np.sort(np.concatenate((sets[i], sets[j]))) for i, j in zip(x, y, strict=True)]
                common = np.array([np.count_nonzero(s[1:] == s[:-1]) for s in both], np.int64)
                yield close.select(["a", "b"]).filter(pa.array(100 * common >= percent * (n[at] + m[at] - common)))

        return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", *names).mapInArrow(alike, "a long, b long")


def repeated_lines(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, line_no (from 0), first_doc and first_line of every line that repeats an earlier one.

    Lines are compared without case (A-Z) and white space at the ends. Lines in a component of
    pairs that share at least ``percent`` % of their shingles of eight characters are one line, of
    which the occurrence of the smallest doc_id and line_no stays and isn't listed; so are equal
    lines within a document. Blank lines never repeat. Null and empty texts have no lines to drop;
    rows without doc_id are left alone; a document that comes twice repeats itself if the rows have
    one id and text, so their lines are listed once each, unless they are the first.

    A node is a distinct line, known by a 64-bit hash. Copies are dropped within tasks before
    anything is shuffled. Candidates come from ``BANDS`` bands and are compared exactly.
    """
    rows = small_batches(documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for i, _, starts, ends, hashes, first in lines_of(batch):
                count = np.diff(first)
                owner = np.repeat(ids[i : i + len(count)], count)
                place = np.arange(len(starts)) - np.repeat(first[:-1], count)
                some = ends > starts
                yield pa.RecordBatch.from_pydict({"doc_id": owner[some], "line_no": place[some].astype(np.int32), "id": hashes[some].view(np.int64)})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lines in _fresh(batches):
            keys = band_keys(lines)
            yield pa.RecordBatch.from_pydict({"key": keys.ravel().view(np.int64), "node": np.repeat(np.array(ids, np.int64), BANDS)})

    places = kept(rows.mapInArrow(number, "doc_id long, line_no int, id long"), "places")
    found = connect(rows.select("text").mapInArrow(index, "key long, node long"), Verifier(rows, percent), percent)
    firsts = places.groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = kept(firsts.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "first", "n", F.coalesce("component", "id").alias("component")), "firsts")
    groups = firsts.groupBy("component").agg(F.min("first").alias("stays"), F.sum("n").alias("n")).filter("n > 1")
    lost = kept(firsts.join(groups.select("component", "stays"), "component").select("id", "stays"), "lost")
    return places.join(lost, "id").filter("doc_id <> stays.doc_id or line_no <> stays.line_no").select("doc_id", "line_no", F.col("stays.doc_id").alias("first_doc"), F.col("stays.line_no").alias("first_line"))


def documents_without(documents: DataFrame, repeated: DataFrame) -> DataFrame:
    """``documents`` with the listed lines taken out of their texts; a text that loses all its lines is empty."""
    drop = repeated.groupBy("doc_id").agg(F.collect_set("line_no").alias("_llm_drop"))
    lines = F.split("text", "\n")
    left = F.filter(F.transform(lines, lambda line, i: F.when(F.array_contains("_llm_drop", i), None).otherwise(line)), lambda line: line.isNotNull())
    text = F.when(F.col("_llm_drop").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return documents.join(drop, "doc_id", "left").withColumn("text", text).select(*documents.columns)
