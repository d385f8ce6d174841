"""Minimal perfect hashing of integers in shards of bounded size, and dense count vectors indexed by it.

A shard's function is a cascade of bit arrays: a key that falls alone on a bit of a level is placed
there, the others go on to the next level, which has its own seed. The index of a key is the number
of set bits before its own, so n keys get the indices 0 to n - 1. Any other integer gets some index
too or none; the keys themselves, stored by index, tell whether an index is meant.
"""

from __future__ import annotations

import numpy as np

from trapline.llm.tokens import mix

# Keys of a shard on average, cells of a level for each key left, and levels at most.
SHARD_KEYS, CELLS, LEVELS = 65_536, 2, 64

_SEED = 0x9E3779B97F4A7C15


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every key (uint64)."""
    return (mix(keys ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(shards)).astype(np.int64)


def _cells(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64(_SEED * (level + 1) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """The function of one shard: sizes of its levels and their bits one after another."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(bits))).astype(np.int64)  # set bits before each

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """The function of distinct ``keys`` (uint64)."""
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = CELLS * len(left)
            cells = _cells(left, len(sizes), size)
            alone = np.bincount(cells, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[cells]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def __len__(self) -> int:
        return int(self.before[-1])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of every key (uint64); -1 where no level has a place for it."""
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.starts[level] + _cells(keys[open_], level, size)
            here = self.bits[at]
            found[open_[here]] = self.before[at[here]]
            open_ = open_[~here]
        return found

    def pack(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], np.int64).tobytes()
        return head + np.packbits(self.bits, bitorder="little").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8).tolist()
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 * (n + 1)), count=sum(sizes), bitorder="little")
        return cls(sizes, bits.astype(bool))


class Counts:
    """Counts of the keys of some shards: by shard the function, the keys and the counts in the order of its indices."""

    def __init__(self, shards: int, parts: dict[int, tuple[bytes, bytes, bytes]]):
        self.shards = shards
        self.parts = {s: (PerfectHash.unpack(f), np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)) for s, (f, k, c) in parts.items()}

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The count of every key (uint64), 0 where none of these shards holds the key."""
        out = np.zeros(len(keys), np.int64)
        shard = shard_of(keys, self.shards)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, (function, known, counts) in self.parts.items():
            rows = order[ends[s] : ends[s + 1]]
            at = function(keys[rows])
            right = at >= 0
            right[right] = known[at[right]] == keys[rows[right]]
            out[rows[right]] = counts[at[right]]
        return out
