"""Toxic passages as maximum-scoring segments of token log-odds.

Every token has a score: how much likelier it is in toxic text than in other text, by counts with a
Dirichlet prior, less a drift that makes ordinary text score below zero. A linear scan finds all
maximal segments of positive score. How high a segment scores by chance in a text of some length
follows an extreme-value law, fitted on texts that aren't toxic; the chances of a text's segments
together give its score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.tables import least_hashed

# Labelled documents of either class that are learned from at most, the ones of the smallest hash.
SAMPLE = 10_000
# Dirichlet prior: so many occurrences of every token in toxic text, and as many in other text as its size is to the toxic one's.
PRIOR = 0.5
# Standard errors that a token's log-odds is moved towards zero, and the drift: the score of ordinary tokens.
CAUTION, DRIFT = 2.0, 0.25
# Segments less likely by chance than this are passages of a document.
SIGNIFICANT = 0.05
THRESHOLD = 0.7

_TOKEN = re.compile(r"\w+")


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def log_odds(counts: dict[str, tuple[int, int]], prior: float = PRIOR, caution: float = CAUTION) -> dict[str, float]:
    """Log-odds of tokens from their counts in (other, toxic) text; only those clearly above zero.

    The prior holds both classes alike for a token, and an estimate counts as far as it is above
    ``caution`` standard errors.
    """
    other, toxic = (sum(c[i] for c in counts.values()) for i in (0, 1))
    found = {}
    if not other or not toxic:
        return found
    ratio = other / toxic
    for token, (n, t) in counts.items():
        a, b = t + prior, n + prior * ratio
        sure = math.log(a * ratio / b) - caution * math.sqrt(1 / a + 1 / b)
        if sure > 0:
            found[token] = sure
    return found


def segments(scores: list[tuple[int, float]], n: int, drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of a text, as (score, first, end).

    ``scores`` are the places and scores of the tokens above zero, all of the other n tokens score
    -``drift``. A candidate joins the ones before it back to the nearest that began lower, if it
    ends higher than that one; each is pushed and popped once, so the scan is linear.
    """
    found: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum at the end
    total, at = 0.0, 0
    for place, score in scores:
        total -= drift * (place - at)
        low, at = total, place + 1
        total += score
        first = place
        k = len(found) - 1
        while k >= 0:
            while k >= 0 and found[k][2] >= low:
                k -= 1
            if k < 0 or found[k][3] >= total:
                break
            first, low = found[k][0], found[k][2]
            del found[k:]
            k = len(found) - 1
        found.append((first, place + 1, low, total))
    return [(high - low, first, end) for first, end, low, high in found]


@dataclass(frozen=True)
class Model:
    """Scores of tokens, the extreme-value law of chance segments, and the map to a probability."""

    odds: dict[str, float]
    drift: float = DRIFT
    rate: float = 1.0  # lambda: chance falls by e for so much more score
    size: float = 1.0  # K: chance segments per token
    bias: float = 0.0
    slope: float = 0.0

    def passages(self, text: str | None) -> tuple[list[tuple[float, int, int]], int]:
        """All segments of a text with their expected numbers by chance in place of the score, and its tokens."""
        words = tokens_of(text)
        get = self.odds.get
        scores = [(i, s) for i, w in enumerate(words) if (s := get(w)) is not None]
        n = max(len(words), 1)
        return [(self.size * n * math.exp(-self.rate * s), first, end) for s, first, end in segments(scores, n, self.drift)], len(words)

    def evidence(self, found: list[tuple[float, int, int]]) -> float:
        """How unlikely the segments are by chance (natural logarithm): the sum of the significant ones, or the best one."""
        chances = [-math.log(max(-math.expm1(-e), 1e-300)) for e, _, _ in found]
        return max(sum(c for c in chances if c >= -math.log(SIGNIFICANT)), max(chances, default=0.0))

    def score(self, text: str | None) -> float:
        """Probability of being toxic. Texts without passages share the lowest."""
        x = self.bias + self.slope * math.log1p(self.evidence(self.passages(text)[0]))
        return 1 / (1 + math.exp(-max(min(x, 50.0), -50.0)))


def fit_law(best: list[tuple[float, int]]) -> tuple[float, float]:
    """Rate and size of the extreme-value law from the best segment scores and lengths of ordinary texts.

    The scores less the logarithm of the length over the rate follow a Gumbel law of one place and
    scale; the rate is found by iterating the moments.
    """
    if len(best) < 2:
        return 1.0, 1.0
    scores, lengths = (np.array(x, float) for x in zip(*best, strict=True))
    rate = 1.0
    for _ in range(30):
        rest = scores - np.log(np.maximum(lengths, 1)) / rate
        rate = min(max(math.pi / math.sqrt(6 * max(rest.var(), 1e-6)), 0.05), 20.0)
    place = (scores - np.log(np.maximum(lengths, 1)) / rate).mean() - 0.5772156649 / rate
    return rate, math.exp(min(rate * place, 50.0))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Bias and slope of y on x, each example counting ``weight`` times (once), with a small ridge on the slope, by Newton steps."""
    weight = np.ones_like(x) if weight is None else weight
    design, w = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    ridge = np.diag([1e-6, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + ridge, design.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def sampled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text``, ``toxic`` and ``weight`` of at most ``sample`` labelled documents of either class, by the smallest hashes of their ids.

    ``weight`` is how many labelled documents of its class a sampled one stands for.
    """
    marked = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = marked.groupBy("toxic").agg(F.greatest(F.count(F.lit(1)) / sample, F.lit(1.0)).alias("weight"))
    picked = least_hashed(marked, "toxic", "doc_id", sample).join(F.broadcast(sizes), "toxic")  # at most twice the sample, and two rows
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter("text is not null").select("text", "toxic", "weight")


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, prior: float = PRIOR, caution: float = CAUTION, drift: float = DRIFT) -> Model:
    """Fit a model on a bounded sample of labelled documents.

    Tokens are counted by Spark, once per document, and only those whose log-odds can be above
    zero come to the driver; the law and the map are fitted on one number or two per sampled
    document. Half of the sample (by hash of the text) gives the token scores for the other half
    and the other way round, so that the law and the map see scores of texts that weren't counted.
    Token scores and the law compare shares within a class and don't depend on how common a class
    is. The map does: there each example counts for the labelled documents it stands for, so that
    a class thinned by ``sample`` keeps its natural share.
    Without labelled documents of both classes every text scores 0.5.
    """
    rows = sampled(documents, labels, sample).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))

    @F.pandas_udf("array<string>")
    def distinct_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted(set(tokens_of(t))) for t in texts])

    told = rows.select("half", "toxic", F.explode(distinct_tokens("text")).alias("token"))
    counts = told.groupBy("token").agg(*[F.count(F.when((F.col("half") == h) & (F.col("toxic") == t), 1)).alias(f"n{h}{t}") for h in (0, 1) for t in (0, 1)])
    # a token never seen in toxic text has log-odds below zero; the sample bounds the number of tokens
    found = [(r.token, (r.n00, r.n01), (r.n10, r.n11)) for r in counts.filter("n01 + n11 > 1").toLocalIterator()]
    rest = counts.filter("n01 + n11 <= 1").agg(*[F.coalesce(F.sum(f"n{h}{t}"), F.lit(0)).alias(f"n{h}{t}") for h in (0, 1) for t in (0, 1)]).first()
    halves = []
    for learned in (1, 0):  # scores for half 0 come from half 1
        side = {token: (first, second)[learned] for token, first, second in found}
        side[""] = (rest[f"n{learned}0"], rest[f"n{learned}1"])
        halves.append(log_odds(side, prior, caution))
    both = {token: (a[0] + b[0], a[1] + b[1]) for token, a, b in found}
    both[""] = (rest["n00"] + rest["n10"], rest["n01"] + rest["n11"])
    for odds in halves:
        odds.pop("", None)
    odds = log_odds(both, prior, caution)
    odds.pop("", None)
    models = [Model(half, drift) for half in halves]

    @F.pandas_udf("array<double>")
    def seen(text: pd.Series, half: pd.Series) -> pd.Series:
        out = []
        for t, h in zip(text, half, strict=True):
            words = tokens_of(t)
            scores = [(i, s) for i, w in enumerate(words) if (s := models[h].odds.get(w)) is not None]
            out.append([float(len(words)), *sorted((s for s, _, _ in segments(scores, len(words), drift)), reverse=True)])
        return pd.Series(out)

    examples = [(r.toxic, r.weight, r.seen[0], r.seen[1:]) for r in rows.select("toxic", "weight", seen("text", "half").alias("seen")).collect()]
    if len({e[0] for e in examples}) < 2:
        return Model(odds, drift)
    rate, size = fit_law([(best[0] if best else 0.0, n) for toxic, _, n, best in examples if not toxic])
    law = Model(odds, drift, rate, size)
    x = np.array([math.log1p(law.evidence([(size * max(n, 1) * math.exp(-rate * s), 0, 0) for s in best])) for _, _, n, best in examples])
    bias, slope = fit_logistic(x, *(np.array(c, float) for c in list(zip(*examples, strict=True))[:2]))
    return Model(odds, drift, rate, size, bias, max(slope, 0.0))


def score(text: Column, model: Model) -> Column:
    """Probability (0 to 1) that each whole text is toxic; null and empty texts have no passage and score lowest."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t if isinstance(t, str) else None) for t in texts], dtype=float)

    return scored(text)


def find_passages(text: Column, model: Model) -> Column:
    """The significant segments of each text: array of first token, end and chance (p-value)."""

    @F.pandas_udf("array<struct<first:int,end:int,chance:double>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                every = [(-math.expm1(-e), first, end) for e, first, end in model.passages(t if isinstance(t, str) else None)[0]]
                out.append([{"first": first, "end": end, "chance": p} for p, first, end in every if p <= SIGNIFICANT])
            yield pd.Series(out)

    return found(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether labels of a document may not be learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def score_documents(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.7 on) of every document.

    Learns from the labels of documents that aren't held out. A null id is held out neither way
    (null). Every row is scored by itself, without a shuffle; repeated rows stay. Null and empty
    texts score lowest, and a very long text is read whole in one linear scan.
    """
    model = learn(documents, labels.filter(~held_out()), sample)
    rows = documents.select("doc_id", held_out().alias("held_out"), score(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
