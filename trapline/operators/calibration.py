"""Scores to probabilities: isotonic and logistic calibration, reliability.

Fitting runs in Spark ML. What comes to the driver is the fitted model: the knots of a monotone
curve over a calibration set whose size is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def monotone_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Derivatives of the shape-preserving cubic through the points (Fritsch and Carlson, 1980)."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.array([d[0], d[0]])
    slopes = np.zeros(len(x))
    rising = d[:-1] * d[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        harmonic = (w1 + w2) / (w1 / d[:-1] + w2 / d[1:])
    slopes[1:-1] = np.where(rising, harmonic, 0.0)
    for end, h0, h1, d0, d1 in ((0, h[0], h[1], d[0], d[1]), (-1, h[-1], h[-2], d[-1], d[-2])):
        slope = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if slope * d0 <= 0:
            slope = 0.0
        elif d0 * d1 < 0 and abs(slope) > 3 * abs(d0):
            slope = 3 * d0
        slopes[end] = slope
    return slopes


@dataclass(frozen=True)
class IsotonicCalibration:
    """Monotone cubic through the middles between the steps of an isotonic fit."""

    x: np.ndarray
    y: np.ndarray
    low: float
    high: float

    def values(self, scores: np.ndarray) -> np.ndarray:
        x, y = self.x, self.y
        scores = np.asarray(scores, dtype=np.float64)
        if len(x) == 1:
            curve = np.full_like(scores, y[0])
        else:
            m = monotone_slopes(x, y)
            i = np.clip(np.searchsorted(x, scores, side="right") - 1, 0, len(x) - 2)
            h = x[i + 1] - x[i]
            t = (scores - x[i]) / h
            curve = (
                (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * h * m[i] + t**2 * (3 - 2 * t) * y[i + 1] + t**2 * (t - 1) * h * m[i + 1]
            )
        curve = np.where(scores < x[0], self.low, curve)
        curve = np.where(scores > x[-1], self.high, curve)
        # a trace of the raw score keeps equal levels in order
        return curve + scores * np.finfo(np.float64).eps

    def predict(self, score: Column) -> Column:
        def evaluate(scores: pd.Series) -> pd.Series:
            return pd.Series(self.values(scores.to_numpy()))

        return F.pandas_udf(evaluate, T.DoubleType())(score)


def fit_isotonic(pairs: DataFrame, score: str = "score", hit: str = "hit") -> IsotonicCalibration:
    """Fit on (score, hit) pairs. Scores that agree to 12 decimals count as equal."""
    rows = pairs.select(F.round(F.col(score).cast("double"), 12).alias("features"), F.col(hit).cast("double").alias("label"))
    bounds = rows.agg(F.min("features"), F.max("features"), F.min("label"), F.max("label"), F.count(F.lit(1))).first()
    if not bounds[4]:
        raise ValueError("no calibration pairs")
    model = IsotonicRegression(isotonic=True).fit(rows.withColumn("weight", F.lit(1.0)))
    steps = np.asarray(model.boundaries, dtype=np.float64)
    levels = np.asarray(model.predictions, dtype=np.float64)
    steps, first = np.unique(steps, return_index=True)
    levels = levels[first]
    # only the ends of flat stretches are knots
    knot = np.ones(len(steps), dtype=bool)
    if len(steps) > 2:
        knot[1:-1] = (levels[1:-1] != levels[:-2]) | (levels[1:-1] != levels[2:])
    x, y = steps[knot], levels[knot]
    at = np.unique(np.concatenate([(x[:-1] + x[1:]) / 2, [bounds[0], bounds[1]]]))
    return IsotonicCalibration(at, np.interp(at, x, y), float(bounds[2]), float(bounds[3]))


def calibrated(pairs: DataFrame, model: IsotonicCalibration | None, score: str = "score") -> DataFrame:
    """Pairs with calibrated scores; it is an error to ask for it without a fitted model."""
    if model is None:
        raise ValueError("the calibration is not fitted")
    return pairs.withColumn(score, model.predict(F.col(score)))


@dataclass(frozen=True)
class LogisticCalibration:
    slope: float
    intercept: float

    def predict(self, score: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(score * F.lit(self.slope) + F.lit(self.intercept))))


def fit_logistic(pairs: DataFrame, score: str = "score", hit: str = "hit", c: float = 1.0) -> LogisticCalibration:
    """L2-regularised logistic fit; ``c`` is the inverse strength over the whole sample."""
    rows = pairs.select(F.col(score).cast("double").alias("_score"), F.col(hit).cast("double").alias("label"))
    n = rows.count()
    assembled = VectorAssembler(inputCols=["_score"], outputCol="features").transform(rows)
    model = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(assembled)
    return LogisticCalibration(float(model.coefficients[0]), float(model.intercept))


def reliability_bins(scored: DataFrame, score: str, hit: str, bins: int = 10) -> DataFrame:
    """Size and hit rate per right-closed score bin; 0 and what is outside (0, 1] is in none."""
    edges = np.linspace(0, 1, bins + 1)
    index = F.lit(0)
    for edge in edges[:-1]:
        index = index + (F.col(score) > F.lit(float(edge))).cast("int")
    inside = scored.filter((F.col(score) > 0) & (F.col(score) <= F.lit(float(edges[-1]))))
    center = F.element_at(F.array(*[F.lit(float(e + (edges[1] - edges[0]) / 2)) for e in edges[:-1]]), F.col("bin"))
    rows = inside.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("size"), F.avg(F.col(hit).cast("double")).alias("hit_rate"))
    return rows.withColumn("center", center)


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error over the reliability bins."""
    gap = F.abs(F.col("hit_rate") - F.col("center"))
    return bins.agg((F.sum(F.col("size") * gap) / F.sum("size")).alias("ece"))
