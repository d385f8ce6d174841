"""Training and test sets, label numbers, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.operators.ordered import row_number_in_group, row_number_over_all
from trapline.operators.skew import attach
from trapline.session import pin


def repeated_only(rows: DataFrame, identity: str) -> DataFrame:
    """Drop identities that occur once."""
    often = rows.groupBy(identity).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(identity).alias("_id"))
    return rows.join(often, F.col(identity) == F.col("_id"), "left_semi")


def split_ratio(rows: DataFrame, identity: str, observation: str, key: str, train: float = 0.8) -> DataFrame:
    """Add ``split``: the first part of every identity is the test set.

    ``ceil(n * (1 - train))`` rows per identity, in key order, are test rows. A later row of an
    observation that is already in the test set follows it there. Test identities that never
    occur in the training set get no split.
    """
    share = 1 - train
    numbered = row_number_in_group(rows, identity, [F.col(key)], "_rn")
    counted = numbered.withColumn("_counted", F.col("_rn") <= F.ceil(F.col("_rn_count") * F.lit(share)))
    first = counted.groupBy(observation).agg(F.min(F.when(F.col("_counted"), F.col(key))).alias("_first_test"), F.count(F.lit(1)).alias("_seen"))
    joined = attach(counted, first, [observation], F.col(key), weight="_seen")
    follows = F.col(observation).isNotNull() & (F.col(key) > F.col("_first_test"))
    test = F.col("_counted") | F.coalesce(follows, F.lit(False))
    placed = pin(joined.withColumn("_test", test).select(*rows.columns, "_test"))
    trained = placed.groupBy(identity).agg(F.bool_or(~F.col("_test")).alias("_trained"), F.count(F.lit(1)).alias("_rows"))
    known = attach(placed, trained, [identity], F.col(key), weight="_rows")
    split = F.when(~F.col("_test"), "train").when(F.col("_trained"), "test")
    return known.withColumn("split", split).select(*rows.columns, "split")


def drop_tail(rows: DataFrame, identity: str, key: str, fewest: int, both: bool = True) -> DataFrame:
    """Drop identities with fewer than ``fewest`` training rows from the test set (and the training set)."""
    counts = rows.groupBy(identity).agg(F.count_if(F.col("split") == "train").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    joined = attach(rows, counts, [identity], F.col(key), weight="_rows")
    rare = (F.col("_n") > 0) & (F.col("_n") < fewest)
    cut = rare if both else rare & (F.col("split") == "test")
    return joined.filter(F.col("split").isNotNull() & ~cut).drop("_n", "_rows")


def factorize(rows: DataFrame, label: str, key: str) -> DataFrame:
    """Number the labels from 0 in the order of their first appearance; null is -1."""
    firsts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    numbers = row_number_over_all(firsts, [F.col("_first")], "_n").select(label, "_rows", (F.col("_n") - 1).alias("label_index"))
    joined = attach(rows, numbers, [label], F.col(key), weight="_rows").drop("_rows")
    return joined.withColumn("label_index", F.coalesce("label_index", F.lit(-1).cast("long")))


def chunks(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Cut the rows in key order into ``n`` consecutive chunks, the first ones longer by one if need be."""
    numbered = row_number_over_all(rows, [F.col(key)], "_rn")
    sized = numbered.withColumn("_total", rows.agg(F.count(F.lit(1))).scalar())
    place, size, rest = F.col("_rn") - 1, F.expr(f"_total div {n}"), F.col("_total") % n
    in_long = place < rest * (size + 1)
    chunk = F.when(in_long, F.floor(place / (size + 1))).otherwise(rest + F.floor((place - rest * (size + 1)) / F.greatest(size, F.lit(1))))
    return sized.withColumn("chunk", chunk.cast("long")).drop("_rn", "_total")


def accuracy(predicted: DataFrame, prediction: str, label: str) -> DataFrame:
    return predicted.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def best_epoch(history: DataFrame, run: str, step: str, metric: str, scores: list[str]) -> DataFrame:
    """Step of the highest metric of every run (the first one on ties) with the other scores of that step."""
    best = F.max_by(F.struct(F.col(step).alias("best_step"), *scores), F.struct(F.col(metric), -F.col(step)))
    return history.filter(F.col(metric).isNotNull()).groupBy(run).agg(best.alias("_b")).select(run, "_b.*")
