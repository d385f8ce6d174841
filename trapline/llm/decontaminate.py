"""Benchmark passages in training text, found by spaced-seed hashing with DataFrame functions alone.

A seed is a fixed mask over consecutive words: the words at its ones are hashed, the others may be
anything. The two masks below meet every stretch of 15 to 20 words of which a fifth was replaced
(checked over all choices of places in the tests), so the search loses nothing that the
verification would accept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.tables import free_name

MASKS = ("111011", "110100010001")
# A passage is a stretch of so many words, or the whole of a shorter benchmark item.
WINDOW = 20
# Of each so many words of a passage one may differ, if the passage has LEAST_TOLERANT words or more.
ONE_IN, LEAST_TOLERANT = 5, 15
# Most seeds that are broadcast at once; more of them are searched for in several passes.
BROADCAST_SEEDS = 500_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits (an empty string may stand first or last); null for null."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def seeds(tokens: Column, at: Column) -> Column:
    """Array of the hash of every mask laid at word ``at``. A mask that doesn't fit hashes too few words to meet an item's."""
    return F.array(*[F.xxhash64(F.lit(k), *[F.get(tokens, at + i) for i, bit in enumerate(mask) if bit == "1"]) for k, mask in enumerate(MASKS)])


def places(tokens: Column) -> Column:
    """0 to the last place where the shortest mask fits; null where none does."""
    last = F.size(tokens) - min(map(len, MASKS))
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))


def window_of(n: Column) -> Column:
    """Words of the passages looked for in an item of ``n`` words."""
    return F.least(n, F.lit(WINDOW))


def needed(n: Column) -> Column:
    """Words of a passage that must be equal."""
    window = window_of(n)
    return window - F.when(window >= LEAST_TOLERANT, F.floor(window / ONE_IN)).otherwise(0).cast("int")


def index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The items (item, item_id, item_words, n) and their seeds (seed, item, item_at, n)."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.filter(words(F.col(text_col)), lambda w: w != "").alias("item_words"))
    items = items.filter("item_words is not null").distinct().withColumns({"item": F.xxhash64("item_id", "item_words"), "n": F.size("item_words")})
    placed = items.select("item", "n", "item_words", F.explode(places(F.col("item_words"))).alias("item_at"))
    masks = F.arrays_zip(seeds(F.col("item_words"), F.col("item_at")).alias("seed"), F.array(*[F.lit(len(m)) for m in MASKS]).alias("span"))
    laid = placed.select("item", "n", "item_at", F.explode(masks).alias("_m")).filter(F.col("item_at") + F.col("_m.span") <= F.col("n"))
    return items, laid.select(F.col("_m.seed").alias("seed"), "item", "item_at", "n")


def passages(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Documents that hold a passage of a benchmark item: ``id_col``, item_id, window, matched.

    A document holds a passage if, at one alignment, of some 20 consecutive words of the item (all,
    if it has fewer) at most a fifth differ from the document's; passages of under 15 words must be
    equal, and items of fewer than six words are not looked for. ``matched`` is the most equal
    words found in a window, one row per document and item. Case and punctuation don't count.

    Null and empty texts hold nothing, null ids are reported as null, rows that share an id are
    reported together, and repeated items count once. Empty tables give no rows.

    Seeds of the benchmark are broadcast in chunks of at most ``broadcast_seeds`` rows, one pass
    over the documents for each chunk; texts aren't shuffled, and what is shuffled are the few
    words that a hit is verified on.
    """
    items, laid = index(benchmark)
    chunks = max(1, -(-laid.count() // broadcast_seeds))
    # rows of one id may have different texts, so a hit belongs to an id and a text
    docs = documents.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), words(F.col(text_col)).alias("_words")).filter(F.size("_words") >= min(map(len, MASKS)))
    alignment, found = ["_id", "_text", "item", "_shift"], None
    for chunk in range(chunks):
        some = laid if chunks == 1 else laid.filter(F.pmod(F.xxhash64("item", "item_at"), F.lit(chunks)) == chunk)
        placed = docs.select("_id", "_text", "_words", F.explode(places(F.col("_words"))).alias("_at"))
        hits = placed.select("_id", "_text", "_words", "_at", F.explode(seeds(F.col("_words"), F.col("_at"))).alias("seed")).join(F.broadcast(some), "seed")  # bounded above
        shift = F.col("_at") - F.col("item_at")
        skipped = F.greatest(-shift, F.lit(0))
        hits = hits.select("_id", "_text", "item", shift.alias("_shift"), F.slice("_words", F.greatest(shift, F.lit(0)) + 1, F.col("n") - skipped).alias("_part"))
        hits = hits.groupBy(*alignment).agg(F.first("_part").alias("_part"))  # all of them are equal
        found = hits if found is None else found.union(hits).groupBy(*alignment).agg(F.first("_part").alias("_part"))
    skipped = F.greatest(-F.col("_shift"), F.lit(0))
    equal = F.transform(F.col("item_words"), lambda w, i: F.coalesce(F.get(F.col("_part"), i - F.col("_skip")) == w, F.lit(False)).cast("int"))
    within = lambda o: F.aggregate(F.slice(F.col("_equal"), o + 1, window_of(F.col("n"))), F.lit(0), lambda total, e: total + e)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("n") - window_of(F.col("n"))), within))
    checked = found.join(items, "item").withColumn("_skip", skipped).withColumn("_equal", equal).withColumn("matched", best)
    kept = checked.filter(F.col("matched") >= needed(F.col("n")))
    return kept.groupBy(F.col("_id").alias(id_col), "item_id", window_of(F.col("n")).alias("window")).agg(F.max("matched").alias("matched"))


def without_passages(documents: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The documents that hold no passage of ``benchmark``, with all their columns; repeated rows stay or go together."""
    key = free_name(documents, "key")
    keyed = documents.withColumn(key, F.xxhash64("doc_id", "text"))
    bad = passages(keyed, benchmark, key, "text", broadcast_seeds).select(key).distinct()
    return keyed.join(bad, key, "left_anti").select(*documents.columns)
