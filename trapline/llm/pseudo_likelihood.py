"""Masked pseudo-likelihood of texts under a bidirectional window network.

Every token is hidden in turn and predicted from the tokens on both sides of it. The network has
one hidden layer over position-specific embeddings and a softmax over symbols: each of the most
frequent words is one, the other words that are seen often enough are dealt by their endings into
classes of one symbol each, and all words that are left are one symbol. A word's probability is that of
its symbol by the network times that of the word among the words of the symbol: by its count in a
class, by its spelling among the words that are left. The network is trained in numpy, in every task
on all positions of the documents of the task, and the tasks' parameters are averaged after each round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.tables import kept, small_batches

# Words that are symbols (symbol 0 is any word without another), words on each side, and hidden units.
VOCABULARY, SIDE, HIDDEN = 255, 2, 16
# Classes of the other words, letters of the ending that deals a word, and the share of all tokens (1 / WORD_PARTS) above
# which a word is known; there are at most WORD_PARTS known words.
CLASSES, ENDING, WORD_PARTS = 128, 3, 200_000
# Pairs of characters that the spelling keeps counts of, and the weight of single characters against them.
PAIRS, BACK = 200_000, 10.0
# Most frequent characters whose pairs are looked up in a table.
TABLE = 255
# Every position is trained on once, in steps of STEP examples; each of the ROUNDS averages takes its share of the positions of every document.
STEP, ROUNDS, RATE = 256, 2, 0.1
# A task reports the words that it has counted when it knows so many.
COUNT_AT = 200_000
# Tokens that are scored at once: their logits stay in the processor's cache. Products of matrices take BLOCK tokens or COLUMNS symbols each.
CHUNK, BLOCK, COLUMNS = 512, 64, 192


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def words_of_all(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, each text's as by ``words_of``, and the number of words of each."""
    split = pc.utf8_split_whitespace(pa.array([text.lower() if text else "" for text in texts.to_pylist()], pa.string()))
    words, owner = split.flatten(), pc.list_parent_indices(split)
    if len(words) and pc.min(pc.binary_length(words)).as_py() == 0:  # white space at the ends of a text, or no text
        some = pc.greater(pc.binary_length(words), 0)
        words, owner = words.filter(some), owner.filter(some)
    return words, np.bincount(np.asarray(owner), minlength=len(texts))


def word_counts(documents: DataFrame) -> DataFrame:
    """Every ``word`` of all documents and how often it is seen (``n``), counted in tasks and summed by Spark."""

    def summed(found: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        if not found:
            return []
        whole = pa.Table.from_batches(found).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return whole.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            found.append(pa.RecordBatch.from_arrays(words_of_all(batch.column("text"))[0].value_counts().flatten(), ["word", "n"]))
            size += len(found[-1])
            if size > 2 * COUNT_AT:
                found = summed(found)
                if (size := sum(map(len, found))) > COUNT_AT:
                    yield from found
                    found, size = [], 0
        yield from summed(found)

    return documents.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(documents: DataFrame, size: int = VOCABULARY) -> list[str]:
    """The most frequent words of all documents; ties by the word."""
    return [r.word for r in word_counts(documents).orderBy(F.desc("n"), "word").limit(size).collect()]


def spelled(words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all characters of all words: the character before (0 at the start), the character (0 at the end), and the number of the word."""
    every = pc.replace_substring(pa.array(words, pa.string()), "\0", "\1")
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(every)], every), "\0")[0].as_py()
    chars = np.frombuffer((f"\0{joined}\0" if len(every) else "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
    return chars[:-1], chars[1:], np.cumsum(chars[:-1] == 0) - 1


@dataclass
class Spelling:
    """Probabilities of words by each character after the one before; unseen pairs fall back on the character, unseen characters on all."""

    pairs: np.ndarray  # sorted: the character before * 2^21 + the character
    n: np.ndarray

    def __post_init__(self) -> None:
        self.before, at = np.unique(self.pairs >> 21, return_inverse=True)
        self.n_before = np.bincount(at, self.n, len(self.before))
        self.chars, at = np.unique(self.pairs & (2**21 - 1), return_inverse=True)
        self.n_chars = np.bincount(at, self.n, len(self.chars))

    @staticmethod
    def _of(keys: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, n[at], 0.0)

    def log_pairs(self, before: np.ndarray, char: np.ndarray) -> np.ndarray:
        alone = (self._of(self.chars, self.n_chars, char) + 1 / 0x110000) / (self.n.sum() + 1)
        p = (self._of(self.pairs, self.n, before << 21 | char) + BACK * alone) / (self._of(self.before, self.n_before, before) + BACK)
        return np.log(p)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of every character, 0 for all but the most frequent, and ``log_pairs`` of those by both numbers. Made in the tasks."""
        top = np.union1d(self.chars[np.argsort(-self.n_chars, kind="stable")[:TABLE]], [0])
        number = np.zeros(0x110000, np.int16)
        number[top] = np.arange(1, len(top) + 1)
        logs = np.zeros((len(top) + 1, len(top) + 1))
        logs[1:, 1:] = self.log_pairs(np.repeat(top, len(top)), np.tile(top, len(top))).reshape(len(top), len(top))
        return number, logs

    def log_probabilities(self, words: list[str] | pa.Array) -> np.ndarray:
        before, char, owner = spelled(words)
        number, logs = self.table
        first, second = number[before], number[char]
        every = logs[first, second]
        if len(rare := np.flatnonzero((first == 0) | (second == 0))):
            every[rare] = self.log_pairs(before[rare], char[rare])
        return np.bincount(owner, every, len(words))


@dataclass
class Lexicon:
    """The symbol of every known word and its log-probability among the words of that symbol; other words have symbol 0 and a spelling."""

    numbers: dict[str, int]
    size: int
    symbols: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # by number; without any the number is the symbol
    within: np.ndarray = field(default_factory=lambda: np.empty(0))
    spelling: Spelling | None = None

    @staticmethod
    def of(words: list[str] | Lexicon) -> Lexicon:
        return words if isinstance(words, Lexicon) else Lexicon({w: i + 1 for i, w in enumerate(words)}, len(words))

    @cached_property
    def known(self) -> tuple[pa.Array, np.ndarray]:
        """All known words, and their numbers after the 0 of the others. Made in the tasks."""
        return pa.array(self.numbers.keys(), pa.string()), np.array([0, *self.numbers.values()], np.int64)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of all texts one after another, the lengths of the texts, and the log-probabilities of their words within the symbols."""
        words, lengths = words_of_all(texts)
        known, numbers = self.known
        at = pc.index_in(words, value_set=known)
        found = numbers[np.asarray(at.fill_null(-1)) + 1]
        if not len(self.symbols):
            return found, lengths, np.zeros(len(lengths))
        logs = self.within[found]
        if at.null_count:
            logs[np.asarray(at.is_null())] += self.spelling.log_probabilities(words.filter(at.is_null()))
        return self.symbols[found], lengths, np.bincount(np.repeat(np.arange(len(lengths)), lengths), logs, len(lengths))


def lexicon(documents: DataFrame, size: int = VOCABULARY, classes: int = CLASSES, parts: int = WORD_PARTS) -> Lexicon:
    """All words seen at least twice that make up a ``parts``-th of all tokens or more, and the spelling of the rest.

    The driver gets the known words, ``parts`` at most, and ``PAIRS`` pairs of characters.
    """
    counts = kept(word_counts(documents), "word_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(2, -(-total // parts))
    known = [(r.word, r.n) for r in counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").collect()]
    head = min(size, len(known))
    symbols = np.array([0, *(i + 1 if i < head else head + 1 + zlib.crc32(w[-ENDING:].encode()) % classes for i, (w, _) in enumerate(known))], np.int64)
    n = np.array([1, *(n for _, n in known)], np.float64)
    within = np.log(n / np.bincount(symbols, n)[symbols])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, char, owner = spelled(batch.column("word"))
            found, at = np.unique(before << 21 | char, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"pair": found, "n": np.bincount(at, np.asarray(batch.column("n"), np.float64)[owner], len(found))})

    rest = counts.filter(F.col("n") < least).select("word", "n").mapInArrow(pairs, "pair long, n double")
    top = sorted((r.pair, r.n) for r in rest.groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(PAIRS).collect())
    spelling = Spelling(np.array([p for p, _ in top], np.int64), np.array([m for _, m in top], np.float64))
    return Lexicon({w: i + 1 for i, (w, _) in enumerate(known)}, head + classes, symbols, within, spelling)


@dataclass
class Network:
    """hidden = tanh(sum of the embeddings of the words around, by place); logits = hidden . out + bias."""

    embed: np.ndarray  # places x (vocabulary + 2) x hidden; the last word stands for beyond the text
    base: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(size: int, side: int = SIDE, hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        shapes = ((2 * side, size + 2, hidden), (hidden,), (hidden, size + 1), (size + 1,))
        scales = (0.1, 0.0, 0.1, 0.0)
        return Network(*(np.float32(scale) * rng.standard_normal(shape, dtype=np.float32) for shape, scale in zip(shapes, scales, strict=True)))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.base, self.out, self.bias]

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, values: np.ndarray) -> Network:
        out, at = [], 0
        for part in self.parts():
            out.append(values[at : at + part.size].reshape(part.shape).astype(np.float32))
            at += part.size
        return Network(*out)

    def around(self, ids: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The words on both sides of every position of one text, or of the positions ``at``."""
        side, beyond = len(self.embed) // 2, self.embed.shape[1] - 1
        padded = np.concatenate((np.full(side, beyond), ids, np.full(side, beyond)))
        places = (*range(side), *range(side + 1, 2 * side + 1))
        return np.stack([padded[k : k + len(ids)] if at is None else padded[at + k] for k in places], 1)

    def rows(self, around: np.ndarray) -> np.ndarray:
        """By place, the rows of all embeddings one after another that the words around have."""
        places, size, _ = self.embed.shape
        return np.ascontiguousarray(around.T) + size * np.arange(places)[:, None]

    def hidden(self, rows: np.ndarray) -> np.ndarray:
        met = self.embed.reshape(-1, self.embed.shape[2]).take(rows, axis=0, mode="clip")
        total = self.base + met[0]
        for more in met[1:]:
            total += more
        return np.tanh(total)

    def weights(self) -> tuple[np.ndarray, bool]:
        """Output weights with the bias below them, and whether no logit can overflow: hidden values are within 1."""
        whole = np.vstack((self.out, self.bias))
        return whole, bool(np.abs(whole).sum(axis=0).max() <= 60)

    def log_probabilities(self, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
        weights, bounded = self.weights()
        h = self.hidden(self.rows(around))
        logits = with_ones(h) @ weights
        at = np.arange(len(ids)), ids
        if bounded:  # a ratio: the difference of two logarithms is coarse where a word is nearly certain
            p = np.exp(logits, out=logits)
            return np.log(p[at].astype(np.float64) / (p @ np.ones(p.shape[1], np.float32)))
        logits -= logits.max(axis=1)[:, None]
        own = logits[at]
        return own - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32))

    def train(self, around: np.ndarray, ids: np.ndarray, squares: list[np.ndarray], rate: float = RATE) -> None:
        """One step of Adagrad on the mean negative log-probability of the hidden words."""
        n = len(ids)
        rows = self.rows(around)
        h = self.hidden(rows)
        with_one = with_ones(h)
        weights, bounded = self.weights()
        p = (blocks(with_one) @ weights).reshape(n, -1)
        if not bounded:
            p -= p.max(axis=1, keepdims=True)
        total = np.exp(p, out=p) @ np.ones(p.shape[1], np.float32)
        p[np.arange(n), ids] -= total
        share = (1 / (total * n))[:, None]  # the softmax is never divided out: its few factors are
        back = (blocks(p) @ np.ascontiguousarray(self.out.T)).reshape(n, -1) * (share * (1 - h * h))
        shared = (with_one * share).T
        outer = np.concatenate([shared @ p[:, i : i + COLUMNS] for i in range(0, p.shape[1], COLUMNS)], axis=1)
        places, size, hidden = self.embed.shape
        rows = rows.ravel().astype(np.min_scalar_type(places * size))
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        last = np.flatnonzero(np.concatenate((rows[1:] != rows[:-1], [True])))
        # each column is summed on its own, as a part of a complex number two of them at a time
        of_row = back.astype(np.float64).take(order % n, axis=0).view(np.float64 if hidden % 2 else np.complex128)
        sums = np.cumsum(of_row, axis=0).take(last, axis=0).view(np.float64)
        sums[1:] -= sums[:-1].copy()
        embed, met = sums.astype(np.float32), rows[last].astype(np.int64)
        # embeddings that weren't met have no gradient, and stay
        square, part = squares[0].reshape(-1, hidden), self.embed.reshape(-1, hidden)
        now = square.take(met, axis=0) + embed * embed
        square[met] = now
        part[met] = part.take(met, axis=0) - rate * embed / np.sqrt(now + 1e-8)
        for part, square, gradient in zip(self.parts()[1:], squares[1:], (back.sum(axis=0), outer[:-1], outer[-1]), strict=True):
            square += gradient * gradient
            part -= rate * gradient / np.sqrt(square + 1e-8)


def with_ones(h: np.ndarray) -> np.ndarray:
    """Hidden values and the 1 that the bias is multiplied by."""
    out = np.ones((len(h), h.shape[1] + 1), np.float32)
    out[:, :-1] = h
    return out


def blocks(rows: np.ndarray) -> np.ndarray:
    """The rows in blocks of ``BLOCK``, or in one if they don't fill them: products of small blocks stay in the processor's cache."""
    return rows.reshape(-1, BLOCK, rows.shape[1]) if len(rows) % BLOCK == 0 else rows[None]


def ids_of(text: str | None, numbers: dict[str, int]) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(numbers.get, words, repeat(0)), np.int64, len(words))


def encode(documents: DataFrame, words: list[str] | Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the ``symbols`` of the whole text (32-bit numbers one after another) and ``fixed``, the log-probability of its words within them."""
    known = Lexicon.of(words)
    kind = documents.select(id_col).schema[0].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths, fixed = known.read(batch.column("text"))
            offsets = np.concatenate(([0], np.cumsum(lengths * 4)))
            buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat.astype(np.int32))]
            symbols = pa.Array.from_buffers(pa.large_binary(), len(lengths), buffers).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), symbols, pa.array(fixed)], ["id", "symbols", "fixed"])

    rows = small_batches(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(read, f"id {kind}, symbols binary, fixed double")


def unpacked(symbols: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts of a batch one after another, and the lengths of the texts."""
    _, starts, data = symbols.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(starts, np.int64)[symbols.offset : symbols.offset + len(symbols) + 1] if len(symbols) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return whole.view(np.int32), np.diff(offsets) // 4


def padded(flat: np.ndarray, lengths: np.ndarray, network: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with what stands for beyond a text between them, where each token is in that, and the places around a token."""
    side, beyond = len(network.embed) // 2, network.embed.shape[1] - 1
    at = np.arange(len(flat)) + np.repeat(side * np.arange(1, len(lengths) + 1), lengths)
    out = np.full(len(flat) + side * (len(lengths) + 1), beyond)
    out[at] = flat
    return out, at, np.array([*range(-side, 0), *range(1, side + 1)])


def turns(lengths: np.ndarray, parts: int) -> np.ndarray:
    """For every token of texts of these lengths the one of ``parts`` turns that takes it, by its place and the length of its text."""
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return (place + np.repeat(lengths, lengths)) % parts


def train(documents: DataFrame, words: list[str] | Lexicon, rounds: int = ROUNDS, one_in: int = 1, step: int = STEP, hidden: int = HIDDEN) -> Network:
    """Fit the network on one in ``one_in`` positions of every document, by default on all of them; see ``fit``."""
    return fit(encode(documents, words, "text"), Lexicon.of(words).size, rounds, one_in, step, hidden)


def fit(encoded: DataFrame, size: int, rounds: int = ROUNDS, one_in: int = 1, step: int = STEP, hidden: int = HIDDEN) -> Network:
    """Fit the network of ``size`` symbols on all positions of the ``encoded`` texts, each in one of the rounds.

    Each task starts from the last average, makes its steps and returns its parameters with the
    number of its examples; Spark averages them by that weight, so what is gathered grows with the
    input and the driver sees one network. Which round takes a position depends on the text alone.
    """
    network = Network.start(size, hidden=hidden)
    for turn in range(rounds):
        begin = network

        def learn(batches: Iterator[pa.RecordBatch], begin: Network = begin, turn: int = turn) -> Iterator[pa.RecordBatch]:
            own = begin.filled(begin.vector())
            squares = [np.zeros_like(p) for p in own.parts()]
            around, wanted, seen = np.empty((0, len(own.embed)), np.int64), np.empty(0, np.int64), 0
            for batch in batches:
                flat, lengths = unpacked(batch.column("symbols"))
                text, at, places = padded(flat, lengths, own)
                at = at[turns(lengths, rounds * one_in) == turn]
                i = 0
                while i < len(at):
                    some = at[i : i + step - len(wanted)]
                    i += len(some)
                    more, ids = text[some[:, None] + places], text[some]
                    around, wanted = (np.concatenate((around, more)), np.concatenate((wanted, ids))) if len(wanted) else (more, ids)
                    if len(wanted) == step:
                        own.train(around, wanted, squares)
                        seen += step
                        around, wanted = around[:0], wanted[:0]
            if len(wanted):
                own.train(around, wanted, squares)
                seen += len(wanted)
            if seen:
                values = own.vector()
                yield pa.RecordBatch.from_pydict({"place": np.arange(len(values)), "total": values.astype(np.float64) * seen, "weight": np.full(len(values), float(seen))})

        parts = encoded.select("symbols").mapInArrow(learn, "place long, total double, weight double")
        means = parts.groupBy("place").agg((F.sum("total") / F.sum("weight")).alias("mean")).orderBy("place").collect()  # the network's size
        if means:
            network = network.filled(np.array([r["mean"] for r in means]))
    return network


def score(documents: DataFrame, network: Network, words: list[str] | Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, log_probability (summed over all tokens of the whole text) and per_token.

    A null, empty or blank text has 0 tokens, the sum 0 and no mean. Each row is scored by itself,
    a long text in chunks of positions; repeated rows stay.
    """
    return score_encoded(encode(documents, words, id_col, text_col), network, id_col)


def score_encoded(encoded: DataFrame, network: Network, id_col: str = "doc_id") -> DataFrame:
    """As ``score``, of texts that are ``encoded`` already."""
    kind = encoded.select("id").schema[0].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths = unpacked(batch.column("symbols"))
            text, at, places = padded(flat, lengths, network)
            logs = np.empty(len(at))
            for i in range(0, len(at), CHUNK):
                some = at[i : i + CHUNK]
                logs[i : i + CHUNK] = network.log_probabilities(text[some[:, None] + places], text[some])
            sums = np.asarray(batch.column("fixed")) + np.bincount(np.repeat(np.arange(len(lengths)), lengths), logs, len(lengths))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lengths), pa.array(sums)], [id_col, "n_tokens", "log_probability"])

    out = encoded.mapInArrow(scored, f"`{id_col}` {kind}, n_tokens long, log_probability double")
    return out.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_probability") / F.col("n_tokens")))


def score_documents(documents: DataFrame) -> DataFrame:
    """Train on all documents and score them: doc_id, n_tokens, log_probability, per_token. Texts are looked up once."""
    rows = small_batches(documents.select("doc_id", "text"))
    words = lexicon(rows)
    encoded = kept(encode(rows, words), "encoded")
    return score_encoded(encoded, fit(encoded, words.size))
