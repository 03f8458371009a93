"""Operator 7: toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding: lower case, homoglyphs (Cyrillic, Greek, full width) to Latin letters, digit and sign substitutions to the
letters they stand for, marks that join or have no width dropped, letters spaced out put together; words are runs of
letters and digits.  The lexicon's terms are whole words and word beginnings,
each weighted by a lower confidence bound of its log odds in toxic against other documents.  One automaton over
" word " and " beginning" keys finds them all; a word counts once, by its heaviest term, and not inside an exception
phrase.  The sum, alone and by the text's length, gives the score.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import TRAINING_ROWS, fit_logistic, logistic, training_rows
from .shared import held, read, remainder

LEAST_WEIGHT = 2.0
BEGINNINGS = range(4, 9)
NOTHING_LEARNED = -2.0  # the logit of each text then: a score of 0.12

# Characters that look like Latin letters, and signs and digits that stand for them.
_CYRILLIC = dict(zip("авеіјкмнорстухѕԁԛԝһӏ", "abeijkmhopctyxsdqwhl", strict=True))
_GREEK = dict(zip("αβεικνορτυχ", "abeiknoptux", strict=True))
_SIGNS = dict(zip("0134578@$!|", "oieastbasil", strict=True))
_WIDE = {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF21 + i): chr(97 + i) for i in range(26)}
# Characters without width.
_NOTHING = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x0300, 0x0370)])
_FOLD = str.maketrans(_CYRILLIC | _GREEK | _WIDE | {k: v for k, v in _SIGNS.items() if k not in "!|"})
_INSIDE = re.compile(r"(?<=\w)[!|](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .*_-][^\W_]){2,}(?![^\W_])")
_BETWEEN = re.compile(r"[ .*_-]")


def folded_words(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if "!" in text or "|" in text:
        text = _INSIDE.sub(lambda m: _SIGNS[m[0]], text)
    if not text.isascii():
        text = text.translate(_NOTHING)
    return _WORD.findall(_SPACED.sub(lambda m: _BETWEEN.sub("", m[0]), text.translate(_FOLD)))


def terms(words: list[str]) -> set[str]:
    """Whole words as ``word ``, word beginnings without the space."""
    found = {w + " " for w in words}
    for w in set(words):
        found.update(w[:n] for n in BEGINNINGS if len(w) > n)
    return found


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    logit: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            a.add_word(" " + term, (len(term) + 1, weight))
        for phrase in self.exceptions:
            key = " " + " ".join(folded_words(phrase)) + " "
            a.add_word(key, (len(key), -1.0))
        a.make_automaton()
        return a


def features(automaton, words: list[str]) -> tuple[float, float, float]:
    """(heaviest term, log of the weights' sum, log of that sum for 100 words)"""
    if not words or not len(automaton):
        return 0.0, 0.0, 0.0
    hits: dict[int, float] = {}
    spans = []
    for end, (size, weight) in automaton.iter(" " + " ".join(words) + " "):
        start = end - size + 1
        if weight < 0:
            spans.append((start, end))
        elif weight > hits.get(start, 0.0):
            hits[start] = weight
    if spans:
        hits = {s: w for s, w in hits.items() if not any(a <= s < b for a, b in spans)}
    if not hits:
        return 0.0, 0.0, 0.0
    total = sum(hits.values())
    return max(hits.values()), float(np.log1p(total)), float(np.log1p(100 * total / len(words)))


def _counted(rows: DataFrame, of: Callable[[str], set[str]]) -> DataFrame:
    """(term, n): in how many of the rows' texts each term is; counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"term": list(found), "n": list(found.values())})

        for b in batches:
            for text in b["text"].to_pylist():
                found.update(of(text))
                if len(found) > 250_000:
                    yield out()
                    found.clear()
        if found:
            yield out()

    return rows.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, least_documents: int = 3) -> Lexicon:
    """A lexicon from the (text, label, fold) rows of folds 1 to 3 and its score's scale from those of fold 0.

    Counts of terms meet in Spark; what comes to the driver are the terms that weigh enough, each of which is in
    ``least_documents`` or more toxic ones of the bounded training rows.  Where no term is learned, as without rows of both labels, each text gets the same low score: nothing is toxic.
    """
    spark = rows.sparkSession
    base = rows.where("fold > 0")
    sizes = {r["label"]: r["n"] for r in base.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, logit=[0.0, 0.0, 0.0, NOTHING_LEARNED])
    toxic = _counted(base.where("label = 1"), lambda t: terms(folded_words(t))).where(F.col("n") >= least_documents)
    others = _counted(base.where("label = 0"), lambda t: terms(folded_words(t))).withColumnRenamed("n", "others")
    a, b = F.col("n") + 0.5, F.coalesce("others", F.lit(0)) + 0.5
    low = F.log(a / (n1 + 1)) - F.log(b / (n0 + 1)) - 1.64 * F.sqrt(1 / a + 1 / b)
    weighed = toxic.join(others, "term", "left").select("term", low.alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)
    weights = {r["term"]: r["weight"] for r in weighed.collect()}
    if not weights:
        return Lexicon({}, logit=[0.0, 0.0, 0.0, NOTHING_LEARNED])
    lexicon = Lexicon(weights)
    # Exception phrases: a term's word with its neighbour, if several documents have them and no toxic one.
    heard = spark.sparkContext.broadcast(lexicon)

    def phrases(text: str) -> set[str]:
        words = folded_words(text)
        bad = [w + " " in heard.value.weights or any(w[:n] in heard.value.weights for n in BEGINNINGS if len(w) > n) for w in words]
        return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], bad, bad[1:], strict=False) if x or y}

    clean = _counted(base.where("label = 0"), phrases).where(F.col("n") >= least_documents)
    said = clean.join(_counted(base.where("label = 1"), phrases), "term", "left_anti")
    lexicon.exceptions = sorted(r["term"] for r in said.select("term").collect())
    # The scale, on documents that the lexicon hasn't seen; three numbers for each of at most TRAINING_ROWS rows.
    ready = spark.sparkContext.broadcast(Lexicon(lexicon.weights, lexicon.exceptions))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = _automaton(ready.value)
            yield pd.DataFrame([(*features(a, folded_words(t)), int(y)) for t, y in zip(b["text"], b["label"], strict=True)], columns=["a", "b", "c", "label"])

    fold = rows.where("fold = 0").select("text", "label").mapInPandas(measure, "a double, b double, c double, label int").toPandas()
    if fold["label"].nunique() == 2:
        lexicon.logit = fit_logistic(fold[["a", "b", "c"]].to_numpy(), fold["label"].to_numpy()).tolist()
    else:
        lexicon.logit = [1.0, 0.0, 0.0, NOTHING_LEARNED]
    return lexicon


def _automaton(lexicon: Lexicon):
    return held(lexicon.name, lexicon.automaton)


def score(spark: SparkSession, lexicon: Lexicon, text: Column) -> Column:
    """0 to 1 for each text; null and empty texts get the score of a text without a hit."""
    shared = spark.sparkContext.broadcast(lexicon)  # terms of the bounded training rows

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.array(shared.value.logit)
        for texts in batches:
            a = _automaton(shared.value)
            x = np.array([features(a, folded_words(t)) for t in texts]).reshape(-1, 3)
            yield pd.Series(logistic(x @ w[:3] + w[3]))

    return F.pandas_udf(scores, "double")(text.cast("string"))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAINING_ROWS) -> Lexicon:
    """A lexicon from at most ``rows`` rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) tells of and ``usable``
    holds for.

    Null labels and ids teach nothing; null texts are empty; of several labels of an id the larger counts; repeated
    documents count each; of equal ids' hashes the lower id is chosen first; other columns are ignored.  Without labels,
    documents or both labels nothing is learned, and each text gets the same low score.
    """
    return train(training_rows(docs, labels, "toxic", usable, rows))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    lexicon = learn(docs, read(spark, sf_dir, "labels"), ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), score(spark, lexicon, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
