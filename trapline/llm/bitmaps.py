"""Parity bitmaps of sets: upper bounds of intersections that rule out most pairs without looking at the sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sets of a block that are compared with each other at once, and bytes of a comparison.
BLOCK_SETS, AT_ONCE = 2_048, 16_000_000
# Keys of a node, the smallest ones, by which a pair is told to have met before.
FIRST_KEYS = 8


def bitmap(members: np.ndarray) -> bytes:
    """Parities of the set's hashes in at least two cells per member (a power of two, 64 at least)."""
    cells = 64
    while cells < 2 * len(members):
        cells *= 2
    parity = np.bincount((members & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows) of fewer cells: the halves added without carry, until there are ``size`` bytes."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def most_common(a: bytes, b: bytes, n: int, m: int) -> int:
    """An upper bound of the members that two sets of n and m share: every different cell costs one of them a member."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return min(n, m, (n + m - int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())) // 2)


def enough(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def possible(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the rows of both sides that may share enough: (sizes, component, bitmap rows of one length each)."""
    (n, group, bits), (m, other, more) = left, right
    size = min(bits.shape[1], more.shape[1])
    x, y = folded(bits, size).view(np.uint64), folded(more, size).view(np.uint64)
    step = max(1, AT_ONCE // max(1, y.nbytes))
    for i in range(0, len(x), step):
        apart = np.bitwise_count(x[i : i + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
        both = n[i : i + step, None] + m[None, :]
        common = np.minimum(np.minimum(n[i : i + step, None], m[None, :]), (both - apart) // 2)
        a, b = np.nonzero((100 * common >= percent * (both - common)) & (group[i : i + step, None] != other[None, :]))
        yield a + i, b


def common_counts(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of ``others`` shares with ``own`` (sorted, distinct, not empty)."""
    members = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, members), len(own) - 1)
    return np.bincount(np.repeat(np.arange(len(others)), [len(x) for x in others]), own[at] == members, len(others)).astype(np.int64)


def close_pairs(rows: DataFrame, sketches: DataFrame, percent: int, block_sets: int = BLOCK_SETS, sets: Callable[[list[bytes]], list[np.ndarray]] | None = None) -> DataFrame:
    """Pairs (``a`` < ``b``) of nodes that share a ``key``, are in different components and may share enough.

    ``rows`` has key, node and component, ``sketches`` node, n and bitmap. The nodes of a key are
    compared in blocks of bounded size inside tasks, and only what the bitmaps leave comes out. A
    node goes to as many tasks as its key has blocks. A pair that shares many keys comes out where
    it meets first, as far as the ``FIRST_KEYS`` smallest keys of both tell.

    With ``sets``, which makes the sets (sorted and distinct, none empty) of what is in a column
    ``members`` of ``sketches``, pairs are compared exactly, and of a block's links only those come
    out that connect something anew: fewer than it has nodes, however many pairs are close.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_sets).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    firsts = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_KEYS).alias("firsts"))  # a node has few keys
    placed = rows.select("key", "node", "component").join(sizes, "key").withColumn("own", own).join(sketches.join(firsts, "node"), "node")
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    names = ["key", "i", "j", "own", "node", "component", "n", "bitmap", "firsts"] + ["members"] * (sets is not None)
    dealt = placed.select(*names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compared(key: int, group: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own, node, component, n, maps, firsts, *members = group
        if len(np.unique(component)) < 2:
            return
        made: dict[int, np.ndarray] = {}
        label = np.unique(component, return_inverse=True)[1]

        def linked(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Of the pairs of rows those that are links and connect what wasn't connected in this block."""
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            cuts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                x, others = a[start], b[start:end]
                others = others[label[others] != label[x]]
                if not len(others):
                    continue
                if fresh := [i for i in (x, *others.tolist()) if i not in made]:
                    made.update(zip(fresh, sets([members[0][i] for i in fresh]), strict=True))
                common = common_counts(made[x], [made[i] for i in others.tolist()])
                others = others[100 * common >= percent * (n[x] + n[others] - common)]
                labels, first = np.unique(label[others], return_index=True)
                if len(first):
                    label[np.isin(label, labels)] = label[x]
                    yield np.full(len(first), node[x]), node[others[first]]

        before = np.array([[*x, *[key] * (FIRST_KEYS - len(x))] for x in firsts], np.int64)  # keys below this one count
        length = np.array([len(x) for x in maps])
        sides = {}
        for block in np.unique(own):
            for size in np.unique(length[own == block]):
                at = np.flatnonzero((own == block) & (length == size))
                sides[block, size] = (at, (n[at], component[at], np.frombuffer(b"".join(maps[at]), np.uint8).reshape(len(at), size)))
        blocks = sorted({b for b, _ in sides})
        for first, (nodes, left) in sides.items():
            for second, (others, right) in sides.items():
                # sets that share enough have bitmaps of one length or of neighbouring ones
                if first > second or not first[1] <= 2 * second[1] <= 4 * first[1] or (len(blocks) == 2 and first[0] == second[0]):
                    continue
                for a, b in possible(left, right, percent):
                    a, b = nodes[a], others[b]
                    for k in range(0, len(a), AT_ONCE // 512):
                        x, y = a[k : k + AT_ONCE // 512], b[k : k + AT_ONCE // 512]
                        met = ((before[x][:, :, None] == before[y][:, None, :]) & (before[x] < key)[:, :, None]).any(axis=(1, 2))
                        if not members:
                            yield node[x[~met]], node[y[~met]]
                        elif not met.all():
                            yield from linked(x[~met], y[~met])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] | None = None

        def done(columns: list[np.ndarray], last: bool):
            key = np.stack(columns[:3], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            cuts = [0, *cuts.tolist(), len(key)]
            for start, end in zip(cuts[: -1 if last else -2], cuts[1:], strict=False):
                if end - start > 1:
                    yield from compared(int(key[start, 0]), [c[start:end] for c in columns[3:]])
            return [c[cuts[-2] :] for c in columns]

        def out(found):
            a, b = found
            return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

        for batch in batches:
            objects = lambda c: np.array([*batch.column(c).to_pylist(), None], object)[:-1]
            columns = [objects(c) if c in ("bitmap", "firsts", "members") else np.asarray(batch.column(c)) for c in names]
            if waiting is not None:
                columns = [np.concatenate(x) for x in zip(waiting, columns, strict=True)]
            step = done(columns, False)
            while True:
                try:
                    found = next(step)
                except StopIteration as end:
                    waiting = end.value
                    break
                if len(found[0]):
                    yield out(found)
        if waiting is not None:
            for found in done(waiting, True):
                if len(found[0]):
                    yield out(found)

    return dealt.mapInArrow(compare, "a long, b long").filter("a <> b")
