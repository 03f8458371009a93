"""What the two classifiers that learn from ``labels`` share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Bound of the labelled rows that a classifier is fitted on; the first by hash of the id.
TRAINING_ROWS = 20_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = TRAINING_ROWS) -> DataFrame:
    """(text, label, fold): at most ``rows`` labelled documents for which ``usable`` holds; fold is 0 to 3 by hash.

    The chosen ids are broadcast (``rows`` bounds them), so no text is shuffled.  Null labels are left out; null texts
    are empty.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(usable & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")
    return written(joined.select("text", "label", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(4)).cast("int").alias("fold")), "labelled")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights, the last of them the constant, by Newton's method with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (p - y) / len(x) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
