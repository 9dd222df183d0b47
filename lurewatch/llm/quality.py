"""Document quality by ordinal cumulative-link regression on graded ratings.

All grades share one weight per hashed text feature; ordered thresholds cut the score into grades:
P(grade <= k) is the logistic function of threshold k minus the score. The model gives an expected
grade and tail probabilities P(grade >= k); a document is kept when the tail probability of the
lowest wanted grade reaches one half.

The model is fitted on a bounded sample of rated documents (``textmodel.SAMPLE``); every document is
scored on its whole text.

Defined results: a null or empty text is scored on its empty feature set; without rated documents the
expected grade is 0 and nothing is kept; grades that no rated document has get no probability of
their own; repeated rows are scored alike. Columns of the input with the names added here are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import Sent, small_batches
from lurewatch.llm.textmodel import SAMPLE, Features, Sample, labelled, minimise, sigmoid

PENALTY = 0.1
KEPT_GRADE = 1
KEPT_TAIL = 0.5
TOP_GRADE = 2


@dataclass
class Ordinal:
    """Weights by hashed feature, and the thresholds between neighbouring grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, found: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return sigmoid(self.weights[found].sum() - self.thresholds)


def label_grade() -> Column:
    """Grades of the label table: 0 for low quality, 1 for good but toxic text, 2 for good text."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), TOP_GRADE)


def _thresholds(point: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logarithms of the steps between them."""
    return point[0] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(point[1:], -20, 20)))])


def fit(sample: Sample, grades: np.ndarray, top: int = TOP_GRADE) -> Ordinal:
    """Maximum likelihood with a penalty on the weights."""
    sample = sample.telling(grades.astype(float), np.ones(sample.rows))
    width = sample.width
    below, above = np.maximum(grades - 1, 0), np.minimum(grades, top - 1)

    def loss(point):
        cuts = _thresholds(point[width:])
        z = sample.dot(point[:width])
        upper = np.where(grades < top, sigmoid(cuts[above] - z), 1.0)
        lower = np.where(grades > 0, sigmoid(cuts[below] - z), 0.0)
        inside = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / inside, lower * (1 - lower) / inside
        value = -float(np.log(inside).sum()) + PENALTY / 2 * float(point[:width] @ point[:width])
        by_cut = np.bincount(below, weights=np.where(grades > 0, low, 0.0), minlength=top) - np.bincount(
            above, weights=np.where(grades < top, up, 0.0), minlength=top)
        after = np.cumsum(by_cut[::-1])[::-1]  # a step moves all later thresholds
        steps = np.exp(np.clip(point[width + 1:], -20, 20))
        return value, np.concatenate([
            sample.back(up - low) + PENALTY * point[:width], [after[0]], after[1:] * steps])

    share = np.clip([(grades <= k).mean() for k in range(top)], 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 0.1 * np.arange(top))
    start = np.concatenate([np.zeros(width), [cuts[0]], np.log(np.maximum(np.diff(cuts), 0.1))])
    point = minimise(loss, start)
    return Ordinal(sample.spread(point[:width]), _thresholds(point[width:]))


def graded(docs: DataFrame, labels: DataFrame, grade: Column | None = None, top: int = TOP_GRADE,
           kept_grade: int = KEPT_GRADE, kept_tail: float = KEPT_TAIL, most: int = SAMPLE) -> DataFrame:
    """Add ``expected_grade``, ``p_ge_<k>`` and ``kept``."""
    tails = [f"p_ge_{k}" for k in range(1, top + 1)]
    docs = docs.drop("expected_grade", "kept", *tails)
    sample, truth = labelled(docs, labels, {"grade": label_grade() if grade is None else grade}, most)
    if not sample.rows:
        return docs.withColumns({n: F.lit(0.0) for n in ["expected_grade", *tails]}).withColumn("kept", F.lit(False))
    small_batches(docs.sparkSession)
    shared = Sent(docs.sparkSession, fit(sample, truth["grade"], top))

    @F.pandas_udf(f"struct<{', '.join(f'{n}: double' for n in tails)}>")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.load()
        features = Features(model.weights != 0)
        for batch in texts:
            yield pd.DataFrame([model.tails(features.of(t or "")) for t in batch],
                               columns=tails, dtype="float64")

    found = docs.withColumn("_tails", score("text")).select(*docs.columns, "_tails.*")
    return found.withColumn("expected_grade", sum(F.col(n) for n in tails)).withColumn(
        "kept", F.col(f"p_ge_{kept_grade}") >= kept_tail)
