"""Minimal acyclic transducers from sequences of words to counts, built incrementally from sorted input."""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np

Path = tuple[str, ...]


def summed_rows(table: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, ascending, with the sums of their counts."""
    if not len(table):
        return table, counts
    order = np.lexsort(table.T[::-1])
    table, counts = table[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], (table[1:] != table[:-1]).any(axis=1))))
    return table[starts], np.add.reduceat(counts, starts)


class Transducer:
    """States with the count of the sequences that end there (0: none) and arcs in the order of their words.

    States with equal counts and arcs are one state. Arcs lead to earlier states, and the root is
    the last one. A table of sequences has a row each, with 1 + the number of the word in ``words``
    (which ascend), and 0 behind the last word.
    """

    def __init__(self, words: list[str], counts: np.ndarray, starts: np.ndarray, labels: np.ndarray, targets: np.ndarray):
        self.words, self.counts, self.starts, self.labels, self.targets = words, counts, starts, labels, targets
        self._arcs: dict[int, dict[str, int]] = {}

    @classmethod
    def of_table(cls, table: np.ndarray, counts: np.ndarray, words: list[str]) -> Transducer:
        """From ascending sequences with counts above 0. Only the states of the last sequence are open."""
        used = np.unique(table[table > 0])
        table = np.where(table > 0, np.searchsorted(used, table) + 1, 0)
        words = [words[i - 1] for i in used.tolist()]
        differ = np.concatenate((np.ones((1, table.shape[1]), bool), table[1:] != table[:-1])) if len(table) else np.ones((0, 1), bool)
        same = np.argmax(differ, axis=1)  # words that a sequence begins with like the one before
        same[:1] = 0
        if (~differ.any(axis=1)).any() or (table[1:] < table[:-1])[np.arange(len(table) - 1), same[1:]].any():
            raise ValueError("sequences must ascend")
        register: dict[tuple, int] = {}
        open_: list[list] = [[0, []]]  # count and arcs
        last: list[int] = []

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                count, arcs = open_.pop()
                state = (count, *arcs)
                number = register.get(state)
                if number is None:
                    number = register[state] = len(register)
                open_[-1][1] += (last[len(open_) - 1], number)

        for path, length, begin, count in zip((table - 1).tolist(), (table > 0).sum(axis=1).tolist(), same.tolist(), counts.tolist(), strict=True):
            close(begin)
            for _ in range(begin, length):
                open_.append([0, []])
            open_[-1][0] = count
            last = path
        close(0)
        states = [*register, (open_[0][0], *open_[0][1])]
        starts = np.cumsum([0, *(len(state) // 2 for state in states)]).astype(np.int32)
        arcs = np.array([x for state in states for x in state[1:]], np.int32).reshape(-1, 2)
        return cls(words, np.array([state[0] for state in states], np.int64), starts, arcs[:, 0].copy(), arcs[:, 1].copy())

    @classmethod
    def of(cls, items: Iterable[tuple[Path, int]]) -> Transducer:
        """From ascending sequences with counts above 0."""
        items = list(items)
        words = sorted({w for path, _ in items for w in path})
        at = {w: i + 1 for i, w in enumerate(words)}
        longest = max((len(path) for path, _ in items), default=1)
        table = np.array([[*(at[w] for w in path), *[0] * (longest - len(path))] for path, _ in items], np.int32).reshape(-1, longest)
        return cls.of_table(table, np.array([n for _, n in items], np.int64), words)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All sequences, ascending, and their counts."""
        states, rows, found = np.array([len(self.counts) - 1]), np.zeros((1, 0), np.int32), []
        while len(states):
            final = self.counts[states] > 0
            found.append((rows[final], self.counts[states[final]]))
            n = self.starts[states + 1] - self.starts[states]
            arcs = np.repeat(self.starts[states] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows = np.column_stack((np.repeat(rows, n, axis=0), self.labels[arcs] + 1)).astype(np.int32)
            states = self.targets[arcs]
        depth = max(rows.shape[1] for rows, _ in found)
        table = np.concatenate([np.pad(rows, ((0, 0), (0, depth - rows.shape[1]))) for rows, _ in found])
        return summed_rows(table, np.concatenate([counts for _, counts in found]))

    def paths(self) -> Iterable[tuple[Path, int]]:
        """All sequences and their counts, ascending."""
        table, counts = self.table()
        for row, count in zip(table.tolist(), counts.tolist(), strict=True):
            yield tuple(self.words[i - 1] for i in row if i), count

    def __call__(self, path: Path) -> int:
        """The count of a sequence, 0 where it isn't accepted."""
        state = len(self.counts) - 1
        for word in path:
            if state not in self._arcs:
                here = slice(self.starts[state], self.starts[state + 1])
                self._arcs[state] = {self.words[k]: t for k, t in zip(self.labels[here].tolist(), self.targets[here].tolist(), strict=True)}
            state = self._arcs[state].get(word)
            if state is None:
                return 0
        return int(self.counts[state])

    def pack(self) -> bytes:
        return pickle.dumps((self.words, self.counts, self.starts, self.labels, self.targets), 5)

    @classmethod
    def unpack(cls, data: bytes) -> Transducer:
        return cls(*pickle.loads(data))


def union(parts: Iterable[Transducer]) -> Transducer:
    """The transducer of all sequences of ``parts``, with the sums of their counts."""
    parts = list(parts)
    words = sorted({w for part in parts for w in part.words})
    at = {w: i + 1 for i, w in enumerate(words)}
    tables = [part.table() for part in parts]
    depth = max((table.shape[1] for table, _ in tables), default=1)
    moved = []
    for part, (table, _) in zip(parts, tables, strict=True):
        number = np.array([0, *(at[w] for w in part.words)], np.int32)
        moved.append(np.pad(number[table], ((0, 0), (0, depth - table.shape[1]))))
    if not moved:
        return Transducer.of([])
    return Transducer.of_table(*summed_rows(np.concatenate(moved), np.concatenate([counts for _, counts in tables])), words)
