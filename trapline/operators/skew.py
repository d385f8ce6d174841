"""Joins of facts with per-key summaries that survive a key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more fact rows than this is joined apart from the others.
HEAVY_ROWS = 1_000_000
SALTS = 8
# Most keys that are salted by their weight, and most salts of one.
HEAVY_KEYS, MOST_SALTS = 1_000, 4_096


def attach(
    fact: DataFrame, summary: DataFrame, on: list[str], spread_by: Column, how: str = "left", weight: str | None = None,
    heavy_rows: int = HEAVY_ROWS, salts: int = SALTS, shuffled: bool = False,
) -> DataFrame:
    """Left (or inner) join of ``fact`` with a summary that has one row per key.

    Keys compare null-safe, so the null group stays a group. ``spread_by`` is a column of the
    fact with many values.

    With ``weight``, the column of the summary that counts the fact rows of a key, the rows of a
    key of more than ``heavy_rows`` rows are salted in proportion to them, and its summary row is
    repeated as often. Only a hash and the number of salts of the ``HEAVY_KEYS`` heaviest keys are
    broadcast, 16 bytes a key at any size of the data; keys beyond them, and what is uneven
    besides, are left to the adaptive skew join.
    Without it (for summaries much smaller than the fact) each summary row is repeated ``salts``
    times and the fact rows of a key are spread over as many tasks; what is still too large there
    is split by the adaptive skew join. Spark takes the copies for as small as the files they come
    from, so a summary that grows with the data is ``shuffled``: the driver never holds it.
    """
    if weight is not None:
        return _attach_by_weight(fact, summary, on, spread_by, how, weight, heavy_rows)
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = summary.select(
        *[F.col(c).alias(f"_k_{c}") for c in on],
        *[F.col(c) for c in summary.columns if c not in on],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_k_salt"),
    )
    condition = _same(on, "_k_") & (F.col("_salt") == F.col("_k_salt"))
    copies = copies.hint("merge") if shuffled else copies
    return salted.join(copies, condition, how).drop("_salt", "_k_salt", *[f"_k_{c}" for c in on])


def _same(on: list[str], prefix: str) -> Column:
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return condition


def _attach_by_weight(
    fact: DataFrame, summary: DataFrame, on: list[str], spread_by: Column, how: str, weight: str, heavy_rows: int
) -> DataFrame:
    key_hash = F.xxhash64(*on)
    salts = F.least(F.ceil(F.col(weight) / max(heavy_rows, 1)), F.lit(MOST_SALTS)).cast("int")
    heaviest = summary.filter(F.col(weight) > heavy_rows).select(key_hash.alias("_hash"), salts.alias("_salts")).orderBy(F.desc("_salts"), "_hash").limit(HEAVY_KEYS)
    # keys of one hash, if that ever happens, are salted alike on both sides
    heaviest = F.broadcast(heaviest.groupBy("_hash").agg(F.max("_salts").alias("_salts")))
    known = lambda rows: rows.withColumn("_hash", key_hash).join(heaviest, "_hash", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    salted = known(fact).withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.col("_salts")).cast("int"))
    values = [c for c in summary.columns if c not in on]
    copies = known(summary).select(
        *[F.col(c).alias(f"_k_{c}") for c in on], *[F.col(c).alias(f"_v_{c}") for c in values], F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_k_salt")
    )
    joined = salted.join(copies, _same(on, "_k_") & (F.col("_salt") == F.col("_k_salt")), how)
    return joined.select(*fact.columns, *[F.col(f"_v_{c}").alias(c) for c in values])


def keys_of(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct keys, combined map-side, for use as the right side of a semi or anti join."""
    return df.select(*columns).distinct()
