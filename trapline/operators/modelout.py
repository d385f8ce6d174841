"""What becomes of the classifier's and the detector's outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions import arrays as A
from trapline.functions import dictionaries as D

# Taxon that a detector class stands for when the classifier is not sure.
DETECTOR_TAXA = {"person": "Homo sapiens", "vehicle": "Vehicle", "animal": "Animalia"}


def with_probabilities(rows: DataFrame, logits: str, temperature: float = 1.0) -> DataFrame:
    return rows.withColumn("probs", A.softmax(F.col(logits).cast("array<double>"), temperature))


def thresholded(rows: DataFrame, thresholds: list[float], probs: str = "probs") -> DataFrame:
    """Raw top class, and the class after thresholds.

    A class must exceed its own threshold; otherwise the class id is the number of classes and
    the probability one minus the top probability.
    """
    limits = F.array(*[F.lit(float(x)) for x in thresholds])
    raw = rows.withColumns({"class_id_raw": A.argmax(F.col(probs)), "prob_raw": F.array_max(probs)})
    sure = F.col("prob_raw") > F.element_at(limits, (F.col("class_id_raw") + 1).cast("int"))
    return raw.withColumns(
        {
            "class_id": F.when(sure, F.col("class_id_raw")).otherwise(F.lit(len(thresholds)).cast("long")),
            "prob": F.when(sure, F.col("prob_raw")).otherwise(1 - F.col("prob_raw")),
        }
    )


def extended_labels(labels: list[str]) -> list[str]:
    """Labels of the model plus "Not Classified" and "Animalia"."""
    return [*labels, D.TAXON_NOT_CLASSIFIED, D.TAXON_ANY_ANIMAL]


def label_of(class_id: Column, labels: list[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), (class_id + 1).cast("int"))


def detector_fallback(rows: DataFrame, labels: list[str], detection: str = "detection") -> DataFrame:
    """Rows that were not classified take the taxon and confidence of their first detection.

    ``detection`` is a struct with ``class`` and ``confidence``, null where nothing was found.
    """
    ids = {name: i for i, name in enumerate(labels)}
    open_row = (F.col("class_id") == ids[D.TAXON_NOT_CLASSIFIED]) & F.col(detection).isNotNull()
    taxon = F.lit(None).cast("long")
    for word, name in DETECTOR_TAXA.items():
        if name in ids:
            taxon = F.when(F.col(f"{detection}.class") == word, F.lit(ids[name]).cast("long")).otherwise(taxon)
    usable = F.coalesce(open_row & taxon.isNotNull(), F.lit(False))
    return rows.withColumns(
        {
            "prob": F.when(usable, F.col(f"{detection}.confidence")).otherwise(F.col("prob")),
            "class_id": F.when(usable, taxon).otherwise(F.col("class_id")),
        }
    )


def check_label_map(labels: DataFrame) -> DataFrame:
    """Whether the ids of a label map are dense (0 to n - 1) and each used once."""
    return labels.agg(
        F.count(F.lit(1)).alias("labels"),
        (F.count(F.lit(1)) == F.count_distinct("id")).alias("unique"),
        ((F.min("id") == 0) & (F.max("id") == F.count(F.lit(1)) - 1)).alias("dense"),
        F.count_if(F.col("name").isNull() | (F.col("name") == "")).alias("unnamed"),
    )


def import_record(rows: DataFrame) -> DataFrame:
    """Category and probability for the import; old outputs without raw values use the thresholded ones."""
    raw = "predicted_category_raw" in rows.columns
    return rows.withColumns(
        {
            "category": F.col("predicted_category_raw") if raw else F.col("predicted_category"),
            "confidence": (F.col("predicted_prob_raw") if raw else F.col("predicted_prob")).cast("double"),
        }
    )
