"""Toxicity by a chain of linear classifiers over hashed text.

Categories are predicted one after the other. A later category's model sees, besides the text, the
probabilities of the earlier ones. It is trained on out-of-fold probabilities, made by models that
have not seen the row, so that it meets the same kind of input as when it scores new documents.

Models are fitted on a bounded sample of labelled documents (``textmodel.SAMPLE``); every document is
scored on its whole text.

Defined results: a null or empty text is scored on its empty feature set; a category with one class
only among the labels gets that class's rate as a constant probability; without labelled documents
nothing is rejected and all probabilities are 0; repeated rows are scored alike. Columns of the input
with the names added here are replaced.
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

FOLDS = 3
PENALTY = 0.1
THRESHOLD = 0.5


@dataclass
class Link:
    """One model: weights by hashed feature, weights of the earlier probabilities, and a constant."""

    weights: np.ndarray
    earlier: np.ndarray
    constant: float


def fit_link(sample: Sample, truth: np.ndarray, earlier: np.ndarray, rows: np.ndarray):
    """Logistic regression on the marked rows, with the earlier probabilities as further inputs.

    Returns weights by hashed feature, weights of the earlier probabilities, the constant, and all
    rows' probabilities."""
    used, y = rows.astype(float), truth.astype(float)
    sample = sample.telling(y, used)
    width, chain = sample.width, earlier.shape[1]
    rate = float(np.clip(y[rows].mean() if rows.any() else 0.0, 1e-6, 1 - 1e-6))

    def scores(point):
        return sample.dot(point[:width]) + earlier @ point[width:-1] + point[-1]

    def loss(point):
        z = scores(point)
        value = float(used @ (np.logaddexp(0, z) - y * z)) + PENALTY / 2 * float(point[:-1] @ point[:-1])
        residual = used * (sigmoid(z) - y)
        return value, np.concatenate([sample.back(residual) + PENALTY * point[:width],
                                      earlier.T @ residual + PENALTY * point[width:-1], [residual.sum()]])

    start = np.zeros(width + chain + 1)
    start[-1] = np.log(rate / (1 - rate))
    if 0 < y[rows].sum() < rows.sum():
        start = minimise(loss, start)
    return sample.spread(start[:width]), start[width:-1], float(start[-1]), sigmoid(scores(start))


def fit_chain(sample: Sample, truths: dict[str, np.ndarray], folds: int = FOLDS) -> dict[str, Link]:
    fold = np.arange(sample.rows) % folds
    earlier = np.empty((sample.rows, 0))
    chain = {}
    for number, (name, truth) in enumerate(truths.items()):
        weights, links, constant, _ = fit_link(sample, truth, earlier, np.ones(sample.rows, dtype=bool))
        chain[name] = Link(weights, links, constant)
        if number + 1 < len(truths):
            unseen = np.zeros(sample.rows)
            for k in range(folds):
                unseen[fold == k] = fit_link(sample, truth, earlier, fold != k)[3][fold == k]
            earlier = np.column_stack([earlier, unseen])
    return chain


def probabilities(chain: dict[str, Link], found: np.ndarray) -> list[float]:
    made: list[float] = []
    for link in chain.values():
        z = link.weights[found].sum() + link.earlier @ np.array(made) + link.constant
        made.append(float(sigmoid(np.array([z]))[0]))
    return made


def scored(docs: DataFrame, chain: dict[str, Link], prefix: str = "p_") -> DataFrame:
    """Add ``p_<category>`` for each category of the chain."""
    small_batches(docs.sparkSession)
    names = [prefix + n for n in chain]
    shared = Sent(docs.sparkSession, chain)  # a fixed number of weights per category

    @F.pandas_udf(f"struct<{', '.join(f'`{n}`: double' for n in names)}>")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        links = shared.load()
        features = Features(sum(np.abs(link.weights) for link in links.values()) > 0)
        for batch in texts:
            rows = [probabilities(links, features.of(t or "")) for t in batch]
            yield pd.DataFrame(rows, columns=names, dtype="float64")

    return docs.drop(*names).withColumn("_scores", score("text")).select(
        *[c for c in docs.columns if c not in names], "_scores.*")


def label_categories() -> dict[str, Column]:
    """The categories of the label table in the order of the chain: junk, then toxic."""
    return {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}


def toxic_scores(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None,
                 most: int = SAMPLE) -> DataFrame:
    """The documents with a probability per category."""
    categories = categories or label_categories()
    sample, truths = labelled(docs, labels, categories, most)
    if not sample.rows:
        return docs.withColumns({f"p_{n}": F.lit(0.0) for n in categories})
    return scored(docs, fit_chain(sample, truths))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents with their probabilities and whether they are rejected as toxic."""
    return toxic_scores(docs, labels, **options).withColumn("rejected", F.col("p_toxic") >= threshold)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    found = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    return judged(found, labels, threshold, **options).where(~F.col("rejected")).select("_row.*")
