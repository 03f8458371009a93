"""Operator 9: quality by regularised quadratic discriminant analysis of document statistics.

Executors turn each text into a few transformed statistics.  Those of the training rows, of which there is a bound, come to
the driver, sixteen numbers each, for class means and covariances; each class's covariance is shrunk towards the pooled one and that
towards a sphere; scores are Mahalanobis log-density differences by cached Cholesky factors, put on a 0 to 1 scale.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import TRAINING_ROWS, fit_logistic, logistic, training_rows
from .shared import read, remainder

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Classes of bytes: 0 lower case, 1 upper case, 2 digits, 3 blanks, 4 newlines, 5 ends of sentences and clauses,
# 6 other signs, 7 control characters, 8 beyond ASCII.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[:128] = 6
_CLASS[:32] = 7
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 5
NAMES = ("size", "words", "upper", "digits", "blanks", "lines", "clauses", "signs", "control", "beyond", "length", "spread", "distinct", "top", "again", "short")


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a text; logs of sizes and of odds, so that they are near normal."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    counts = np.bincount(_CLASS[data], minlength=9)
    words = _WORD.findall((text or "").lower())
    k = len(words)
    sizes = np.fromiter(map(len, words), np.float64, k) if k else np.zeros(1)
    seen = Counter(words)
    lines = [x for x in (text or "").split("\n") if x]
    odds = lambda part, whole: float(np.log((part + 0.5) / (whole - part + 0.5)))
    return [
        float(np.log1p(n)),
        float(np.log1p(k)),
        *(odds(int(counts[c]), n) for c in (1, 2, 3, 4, 5, 6, 7, 8)),
        float(np.log1p(sizes.mean())),
        float(np.log1p(sizes.std())),
        odds(len(seen), k),
        odds(max(seen.values(), default=0), k),
        odds(len(lines) - len(set(lines)), len(lines)),
        odds(int((sizes <= 3).sum()) if k else 0, k),
    ]


@dataclass
class Discriminant:
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse Cholesky factors, cached
    log_determinants: list[float]
    scale: tuple[float, float]
    centre: np.ndarray
    spread: np.ndarray

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        z = np.clip((x - self.centre) / self.spread, -8, 8)
        d = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * ld for m, f, ld in zip(self.means, self.factors, self.log_determinants, strict=True)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return logistic(a * np.arcsinh(self.difference(x)) + b)


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Discriminant:
    """The discriminant with the shrinkage that does best on fold 0 when fitted on the others, then that fold's scale."""
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - centre) / spread, -8, 8)
    inner, d = fold > 0, x.shape[1]

    def shape(shrink: float, sphere: float, rows: np.ndarray) -> Discriminant:
        parts = [z[rows & (y == k)] for k in (0, 1)]
        means = [p.mean(axis=0) for p in parts]
        covariances = [(p - m).T @ (p - m) / max(1, len(p)) for p, m in zip(parts, means, strict=True)]
        pooled = sum(c * len(p) for c, p in zip(covariances, parts, strict=True)) / max(1, sum(map(len, parts)))
        factors, logs = [], []
        for c in covariances:
            c = (1 - shrink) * c + shrink * pooled
            c = (1 - sphere) * c + sphere * np.trace(c) / d * np.eye(d) + 1e-6 * np.eye(d)
            low = np.linalg.cholesky(c)
            factors.append(np.linalg.inv(low))
            logs.append(2 * float(np.log(np.diag(low)).sum()))
        return Discriminant(means, factors, logs, (1.0, 0.0), centre, spread)

    best, least = None, np.inf
    for shrink in (0.02, 0.1, 0.3, 0.6, 1.0):
        for sphere in (0.01, 0.05, 0.2):
            q = shape(shrink, sphere, inner)
            t = np.arcsinh(q.difference(x[~inner]))
            w = fit_logistic(t[:, None], y[~inner])
            p = np.clip(logistic(w[0] * t + w[1]), 1e-9, 1 - 1e-9)
            loss = -float(np.mean(y[~inner] * np.log(p) + (1 - y[~inner]) * np.log(1 - p)))
            if loss < least:
                best, least = q, loss
                best.scale = (float(w[0]), float(w[1]))
    return best


def train(rows: DataFrame) -> Discriminant | float:
    """From (text, label, fold) rows, at most TRAINING_ROWS; a constant score if a class has under two rows in a fold."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [statistics(t) for t in b["text"]], "label": b["label"], "fold": b["fold"]})

    got = rows.mapInPandas(measure, "x array<double>, label int, fold int").toPandas()
    y, fold = got["label"].to_numpy(), got["fold"].to_numpy()
    if any(((y == k) & ((fold > 0) == f)).sum() < 2 for k in (0, 1) for f in (False, True)):
        return float((y.sum() + 0.5) / (len(y) + 1))
    return fit(np.array(got["x"].tolist()), y, fold)


def score(spark: SparkSession, model: Discriminant | float, text: Column) -> Column:
    """0 to 1 for each text; null texts count as empty."""
    shared = spark.sparkContext.broadcast(model)  # a few small matrices

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if isinstance(shared.value, float):
                yield pd.Series([shared.value] * len(texts), dtype=float)
            else:
                x = np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES))
                yield pd.Series(shared.value.score(x))

    return F.pandas_udf(scores, "double")(text.cast("string"))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAINING_ROWS) -> Discriminant | float:
    """A discriminant from at most ``rows`` rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) tells of and
    ``usable`` holds for, or a constant score where there are too few.

    Null labels and ids teach nothing; null texts are empty; of several labels of an id the larger counts; repeated
    documents count each; of equal ids' hashes the lower id is chosen first; other columns are ignored.
    """
    return train(training_rows(docs, labels, "quality", usable, rows))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = learn(docs, read(spark, sf_dir, "labels"), ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), score(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
