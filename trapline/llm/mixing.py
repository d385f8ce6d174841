"""Mixing sources to target weights by blocks of words.

The texts of a source, in the order of their ids, are one stream of words, cut into blocks of a
fixed length. Output shards consist of slots, one block each. How many slots of a shard each source
gets is drawn; the slots of a source are numbered over all shards, and a slot's block is its number
under a pseudorandom permutation of the source's blocks, another one for each pass. Slots and
blocks then meet by index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.llm.tables import free_name, small_table
from trapline.llm.tokens import mix as scramble
from trapline.operators.ordered import running_sum

BLOCK_WORDS = 64
SHARD_SLOTS = 65_536
# Weights of the sources in the order of their names (by code point, null last), repeating.
WEIGHTS = (5, 2, 1)
# A word is taken so many times at most.
MOST_TIMES = 3
SEED = 20_240_817


def word_count(text: Column) -> Column:
    """Number of words, which end at space and the controls 9 to 13; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_TIMES) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is shared again by weight."""
    found: dict[int, float] = {}
    while len(found) < len(sizes):
        left, weight = total - sum(found.values()), sum(w for i, w in enumerate(weights) if i not in found)
        shares = {i: left * weights[i] / weight for i in range(len(sizes)) if i not in found}
        above = [i for i, share in shares.items() if share > most * sizes[i]]
        if not above:
            found |= shares
        found |= {i: float(most * sizes[i]) for i in above}
    return [found[i] for i in range(len(sizes))]


def draw_counts(quotas: list[int], shard_slots: int, seed: int = SEED) -> list[np.ndarray]:
    """Slots of each source in every shard: multinomial by what the sources are still to give.

    A draw above that is cut, and its slots are drawn again among the others, so that over all
    shards each source gives its quota.
    """
    left, counts = np.array(quotas, np.int64), []
    while left.sum():
        draw, size = np.zeros_like(left), min(shard_slots, int(left.sum()))
        rng = np.random.default_rng([seed, len(counts)])
        while (missing := size - draw.sum()) > 0:
            rest = left - draw
            draw += np.minimum(rng.multinomial(missing, rest / rest.sum()), rest)
        counts.append(draw)
        left = left - draw
    return counts


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of ``index`` in a pseudorandom permutation of 0 .. n - 1 chosen by ``key``, for each row.

    Four Feistel rounds over the next power of four, repeated until the place is below n.
    """
    index, n, key = (np.asarray(x).astype(np.uint64) for x in (index, n, key))
    half = np.maximum((np.frexp(np.maximum(n.astype(np.float64) - 1, 1))[1] + 1) // 2, 1).astype(np.uint64)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        h, k = half[todo], key[todo]
        mask = (np.uint64(1) << h) - np.uint64(1)
        left, right = out[todo] >> h, out[todo] & mask
        for turn in range(4):
            left, right = right, left ^ (scramble(right + k * np.uint64(2 * turn + 1) + np.uint64(turn)) & mask)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def _block(slot: pd.Series, source_no: pd.Series, blocks: pd.Series, seed: pd.Series) -> pd.Series:
    turn = slot.to_numpy() // blocks.to_numpy()
    key = scramble((seed.to_numpy() * 1_000_003 + source_no.to_numpy()).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + turn.astype(np.uint64))
    return pd.Series(permuted(slot.to_numpy() % blocks.to_numpy(), blocks.to_numpy(), key))


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix as (rows, spans).

    ``rows``, one per document: key, size (words), source_no, source_size, target (words of its
    source in the mix) and its words' place in the source's stream, ``start`` to ``end``.
    ``spans``, one per piece of a document in a slot: shard, slot (of the source), source_no,
    key, size, start and end of the document, first_word (in the document) and words.

    All sources share the words of all documents by weight, but no source gives more than three
    times its words and no block is taken more often than that. Each source's taken words come
    within about a block of its target. Null sources are one source, the last. Null, empty and
    wordless texts have size 0 and no spans. Repeated rows each have words of their own. Draws
    and permutations depend on ``seed`` and sizes alone, so reruns agree.

    The driver sees one row per source and draws one count per source and shard; texts aren't
    shuffled; streams are laid out over a range-partitioned order, so a large source is no task.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.crc32(F.col(text)).alias("crc"))
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("size"), F.col("crc")]
    laid = running_sum(rows, order, F.col("size"), "upto")
    sizes = sorted(((r.source, int(r.n)) for r in laid.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    names, totals = [s for s, _ in sizes], [n for _, n in sizes]
    goals = targets(totals, [weights[i % len(weights)] for i in range(len(sizes))], float(sum(totals))) if sizes else []
    blocks = [-(-n // block_words) for n in totals]
    quotas = [min(MOST_TIMES * b, round(goal * b / n)) if n else 0 for goal, b, n in zip(goals, blocks, totals, strict=True)]
    before = [sum(totals[:i]) for i in range(len(totals))]
    table = small_table(spark, list(zip(names, range(len(names)), totals, goals, before, strict=True)), "_name string, source_no int, source_size long, target double, _before long")
    rows = laid.join(table, F.col("source").eqNullSafe(F.col("_name"))).select(
        "key", "size", "source_no", "source_size", "target", (F.col("upto") - F.col("size") - F.col("_before")).alias("start"), (F.col("upto") - F.col("_before")).alias("end")
    )
    given, draws = np.zeros(len(totals), np.int64), []
    for shard, counts in enumerate(draw_counts(quotas, shard_slots, seed)):
        draws += [(shard, i, blocks[i], int(given[i]), int(given[i] + c - 1)) for i, c in enumerate(counts.tolist()) if c]
        given += counts
    drawn = small_table(spark, draws, "shard int, source_no int, blocks long, first long, last long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = drawn.repartition(parts, "shard", "source_no").select("shard", "source_no", "blocks", F.explode(F.sequence("first", "last")).alias("slot"))
    slots = slots.select("shard", "source_no", "slot", _block("slot", "source_no", "blocks", F.lit(seed)).alias("block"))
    first, last = F.col("start"), F.col("end") - 1
    per_block = lambda x: F.floor(x / block_words).cast("long")
    pieces = rows.filter("size > 0").select("key", "size", "source_no", "start", "end", F.explode(F.sequence(per_block(first), per_block(last))).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    pieces = pieces.select("*", (begin - F.col("start")).alias("first_word"), (F.least(F.col("end"), (F.col("block") + 1) * block_words) - begin).alias("words"))
    # the planner takes the slots for as few rows as were drawn, and would broadcast them all
    return rows, pieces.join(slots.hint("merge"), ["source_no", "block"]).drop("block")


def mix_documents(documents: DataFrame, **parameters) -> DataFrame:
    """How much of every document the mix takes: doc_id, size, source_size, target and taken (words, repeats counted)."""
    return taken(*mix(documents, "doc_id", **parameters)).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def taken(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with the words that ``spans`` hold of each."""
    place = ["source_no", "start", "end"]  # rows of some size have places of their own
    sums = spans.groupBy(*place).agg(F.sum("words").alias("taken"))
    some = rows.filter("size > 0").join(sums, place, "left").select(*rows.columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return some.union(rows.filter("size = 0").select(*rows.columns, F.lit(0).cast("long").alias("taken")))


def repeated(documents: DataFrame, **parameters) -> DataFrame:
    """The documents as the mix has them: each row as often as its words are taken, with its columns.

    A row of which the mix takes 1.4 times the words comes once or twice, by a hash of its id and
    text. Rows equal in id, source and text share their words and come equally often.
    """
    key, share, copies, copy = (free_name(documents, name) for name in ("mix_key", "mix_times", "mix_copies", "mix_copy"))
    keyed = documents.withColumn(key, F.xxhash64("doc_id", "source", "text"))
    found = taken(*mix(keyed, key, **parameters)).groupBy(F.col("key").alias(key)).agg(F.try_divide(F.sum("taken"), F.sum("size")).alias(share))
    chance = F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(1_000_003)) / 1_000_003
    times = found.filter(F.col(share) > 0).select(key, F.floor(F.col(share) + chance).cast("int").alias(copies)).filter(F.col(copies) > 0)
    return keyed.join(times, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*documents.columns)
