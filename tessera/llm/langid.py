"""Operator 10: language ID by interpolated Kneser-Ney character models in sorted hash arrays.

Spark counts the character n-grams of each language over all training documents (executors count words first, so a
word's letters are walked once a task).  All of them are in the model, so it grows with the distinct n-grams of a
language, which its letters bound, not with its rows: 24 bytes each come to the driver.  For each language and order the
model holds sorted 64-bit hashes with log probabilities, and sorted hashes of contexts with back-off weights.  A word's cost
under each language doesn't depend on its neighbours, so workers remember the costs of words they have seen; a document's
cross-entropy is the sum of its words' costs by their length.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held, read, remainder

ORDER = 4
DISCOUNT = 0.75
GRAMS_AT_ONCE = 50_000  # that come to the driver in one row
TEMPERATURES = (0.25, 0.5, 1.0, 2.0, 4.0)
BYTES_AT_ONCE = 1 << 20  # characters of texts whose words are held as lists
WORDS_AT_ONCE = 20_000  # words whose n-grams are looked up together
SEEN_WORDS = 200_000
UNDETERMINED = "und"
SCORE = "lang_pred string, score double, entropy double, rejected boolean"

_WORD = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD], np.uint64)


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """For each place of ``codes``, the hash of the ``order`` codes that end there (the first order - 1 are undefined)."""
    out = np.full(len(codes), np.uint64(order), np.uint64)
    for back in range(order):
        out[back:] += (codes[: len(codes) - back] + np.uint64(1)) * _MULTIPLIERS[back]
        out ^= out >> np.uint64(29)
        out *= _MULTIPLIERS[5]
    return out ^ out >> np.uint64(32)


def row_hashes(codes: np.ndarray) -> np.ndarray:
    """The hash of each row of codes, as :func:`gram_hashes` has it of the same codes in a text."""
    n = codes.shape[1]
    out = np.full(len(codes), np.uint64(n), np.uint64)
    for back in range(n):
        out += (codes[:, n - 1 - back].astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[back]
        out ^= out >> np.uint64(29)
        out *= _MULTIPLIERS[5]
    return out ^ out >> np.uint64(32)


def codes_of(grams: list[str], order: int = ORDER) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, order)


def letters(word: str) -> str:
    """Letters only: the word pattern also takes number signs such as fractions."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


@dataclass
class Table:
    """Sorted hashes and their values."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        return cls(keys[order], values[order])

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found?)"""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at], self.keys[at] == keys


def kneser_ney(grams: dict[str, int], order: int = ORDER, discount: float = DISCOUNT) -> tuple[list[Table], list[Table], float]:
    """:func:`kneser_ney_of` n-grams and their counts."""
    return kneser_ney_of(codes_of(list(grams), order), np.fromiter(grams.values(), np.float64, len(grams)), discount)


def kneser_ney_of(codes: np.ndarray, n: np.ndarray, discount: float = DISCOUNT) -> tuple[list[Table], list[Table], float]:
    """Log probabilities of n-grams and log back-off weights of contexts by order, and that of an unknown character, from
    different n-grams, a row of codes each, and their counts.

    The highest order has counts, each lower one the number of different characters before (continuation counts).
    """
    order = codes.shape[1]
    levels = [(codes, n.astype(np.float64), np.zeros(0, np.int64))]  # n-grams, counts, which of the next level ends each
    for _ in range(order - 1):
        ends = levels[-1][0][:, 1:]
        _, first, which, times = np.unique(row_hashes(ends), return_index=True, return_inverse=True, return_counts=True)
        levels[-1] = (*levels[-1][:2], which)
        levels.append((ends[first], times.astype(np.float64), np.zeros(0, np.int64)))
    alphabet = len(levels[-1][0]) + 1
    lower = np.full(len(levels[-1][0]), 1.0 / alphabet)
    logs, weights = [], []
    unknown = 1.0 / alphabet
    for k in range(1, order + 1):
        grams, c, _ = levels[order - k]
        contexts, which, types = np.unique(row_hashes(grams[:, :-1]), return_inverse=True, return_counts=True)
        totals = np.bincount(which, c, len(contexts))
        weight = discount * types / totals
        if k > 1:
            lower = lower[levels[order - k][2]]
        p = np.maximum(c - discount, 0) / totals[which] + weight[which] * lower
        if k == 1 and len(weight):
            unknown = weight[0] / alphabet
        logs.append(Table.of(row_hashes(grams), np.log(p)))
        weights.append(Table.of(contexts, np.log(weight)) if k > 1 else Table(np.zeros(0, np.uint64), np.zeros(0)))
        lower = p
    return logs, weights, float(np.log(unknown))


@dataclass
class Model:
    languages: list[str]
    tables: list[tuple[list[Table], list[Table], float]]
    temperature: float = 1.0
    limits: list[float] = field(default_factory=list)
    order: int = ORDER
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def costs(self, words: list[str]) -> np.ndarray:
        """(len(words), languages + 1): natural log probability of each word by language, and its characters.

        A character's cost depends on it and the ``order`` - 1 before it, so each different n-gram of the words is looked up
        once.
        """
        pad = self.order - 1
        text = "".join(START * pad + w + END for w in words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(sizes + pad) - sizes
        begin = np.cumsum(sizes) - sizes
        place = np.repeat(starts - begin, sizes) + np.arange(sizes.sum())
        hashes = [gram_hashes(codes, n) for n in range(1, self.order + 1)]
        _, first, which = np.unique(hashes[-1][place], return_index=True, return_inverse=True)
        place = place[first]
        out = np.zeros((len(words), len(self.languages) + 1))
        for k, (logs, weights, unknown) in enumerate(self.tables):
            total, open_ = np.zeros(len(place)), np.arange(len(place))
            for n in range(self.order, 0, -1):
                value, found = logs[n - 1].get(hashes[n - 1][place[open_]])
                total[open_[found]] += value[found]
                open_ = open_[~found]
                if n > 1:
                    weight, known = weights[n - 1].get(hashes[n - 2][place[open_] - 1])
                    total[open_[known]] += weight[known]
            total[open_] += unknown
            out[:, k] = np.add.reduceat(total[which], begin)
        out[:, -1] = sizes
        out[np.fromiter((not w for w in words), bool, len(words))] = 0
        return out

    def entropies(self, texts: list[str | None], seen: Seen | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropies by text and language (nats a character) and the characters counted.

        Texts are taken some ``BYTES_AT_ONCE`` characters at a time, with the costs of words already ``seen``.
        """
        seen = seen or Seen(len(self.languages) + 1)
        sums, at = np.zeros((len(texts), len(self.languages) + 1)), 0
        while at < len(texts):
            last, size = at, 0
            while last < len(texts) and (last == at or size + len(texts[last] or "") <= BYTES_AT_ONCE):
                size += len(texts[last] or "")
                last += 1
            found = [_WORD.findall(t.lower()) if t else [] for t in texts[at:last]]
            seen.learn(set().union(*found), self)
            words = np.fromiter(map(seen.places.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
            ends = np.cumsum([0, *map(len, found)])
            for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                if a < b:
                    sums[at + i] = seen.costs[words[a:b]].sum(axis=0)
            at = last
        sizes = sums[:, -1]
        return -sums[:, :-1] / np.maximum(sizes, 1)[:, None], sizes


@dataclass
class Seen:
    """The costs of words that a worker remembers, in a table of ``SEEN_WORDS`` rows or as many as one lot of texts has."""

    width: int
    places: dict[str, int] = field(default_factory=dict)
    costs: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def learn(self, words: set[str], model: Model) -> None:
        new = list(words.difference(self.places))
        if len(self.places) + len(new) > max(SEEN_WORDS, len(new)):
            self.places.clear()
            new = list(words)
        need = max(SEEN_WORDS, len(self.places) + len(new))
        if self.costs.shape != (need, self.width):
            table = np.zeros((need, self.width))
            table[: len(self.places)] = self.costs[: len(self.places)]
            self.costs = table
        for at in range(0, len(new), WORDS_AT_ONCE):
            part, n = new[at : at + WORDS_AT_ONCE], len(self.places)
            self.places.update(zip(part, range(n, n + len(part)), strict=True))
            self.costs[n : n + len(part)] = model.costs([letters(w) for w in part])


def remembered(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """:meth:`Model.entropies` with what the worker remembers of words it has seen."""
    return model.entropies(texts, held(model.name, lambda: Seen(len(model.languages) + 1)))


def classify(model: Model, texts: list[str | None]) -> pd.DataFrame:
    n = len(texts)
    if not model.languages:
        none = [not any(map(letters, _WORD.findall(t or ""))) for t in texts]
        return pd.DataFrame({"lang_pred": [UNDETERMINED] * n, "score": 0.0, "entropy": None, "rejected": none})
    h, sizes = remembered(model, texts)
    best = h.argmin(axis=1)
    least = h[np.arange(n), best]
    logits = -(h - least[:, None]) * np.sqrt(sizes)[:, None] * model.temperature
    score = 1 / np.exp(np.maximum(logits, -700)).sum(axis=1)
    none = sizes == 0
    limits = np.array(model.limits or [np.inf] * len(model.languages))
    return pd.DataFrame(
        {
            "lang_pred": np.where(none, UNDETERMINED, np.array(model.languages, object)[best]),
            "score": np.where(none, 0.0, score),
            "entropy": pd.Series(np.where(none, np.nan, least)).astype(object).where(~none, None),
            "rejected": none | (least > limits[best]),
        }
    )


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all (text, lang) rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = held("gram counts", lambda: defaultdict(Counter))
        words.clear()
        grams: Counter = Counter()

        def flush() -> None:
            for lang, found in words.items():
                for w, c in found.items():
                    if w := letters(w):
                        w = START * (order - 1) + w + END
                        for i in range(len(w) - order + 1):
                            grams[lang, w[i : i + order]] += c
            words.clear()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"lang": [k[0] for k in grams], "gram": [k[1] for k in grams], "n": list(grams.values())})

        for b in batches:
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                words[lang].update(_WORD.findall(text.lower()))
            if sum(map(len, words.values())) > 150_000:
                flush()
            if len(grams) > 250_000:
                yield rows()
                grams.clear()
        flush()
        if grams:
            yield rows()

    counted = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    return counted.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_codes(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, codes, n): the (lang, gram, n) rows, up to ``GRAMS_AT_ONCE`` of a language in a row, as uint32 and float64."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[list[str], list[int]]] = defaultdict(lambda: ([], []))

        def out(lang: str) -> pa.RecordBatch:
            grams, n = found.pop(lang)
            codes = codes_of(grams, order).tobytes()
            return pa.RecordBatch.from_pydict({"lang": [lang], "codes": pa.array([codes], pa.binary()), "n": pa.array([np.array(n, np.float64).tobytes()], pa.binary())})

        for b in batches:
            for lang, gram, n in zip(*(b[x].to_pylist() for x in ("lang", "gram", "n")), strict=True):
                grams, times = found[lang]
                grams.append(gram)
                times.append(n)
                if len(grams) >= GRAMS_AT_ONCE:
                    yield out(lang)
        for lang in list(found):
            yield out(lang)

    return counted.mapInArrow(pack, "lang string, codes binary, n binary")


def own_entropies(rows: DataFrame, model: Model) -> DataFrame:
    """(lang, n, total, square, top, loss0, ...) over all (text, lang) rows with a letter: their number, sum, sum of squares
    and maximum of the entropy under their own language, and the sum of the loss at each of ``TEMPERATURES``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    losses = [f"loss{i}" for i in range(len(TEMPERATURES))]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = {x: i for i, x in enumerate(shared.value.languages)}
        sums = np.zeros((len(numbers), 3 + len(losses)))
        top = np.full(len(numbers), -np.inf)
        for b in batches:
            h, sizes = remembered(shared.value, b["text"].tolist())
            some = sizes > 0
            h, root, truth = h[some], np.sqrt(sizes[some])[:, None], b["lang"][some].map(numbers).to_numpy(np.int64)
            own = h[np.arange(len(h)), truth]
            np.maximum.at(top, truth, own)
            values = [np.ones(len(own)), own, own * own]
            for t in TEMPERATURES:
                z = -(h - h.min(axis=1, keepdims=True)) * root * t
                values.append(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(h)), truth])
            for i, v in enumerate(values):
                sums[:, i] += np.bincount(truth, v, len(numbers))
        out = pd.DataFrame(sums, columns=["n", "total", "square", *losses])
        out.insert(0, "lang", shared.value.languages)
        out.insert(4, "top", top)
        yield out[out["n"] > 0]

    kinds = "lang string, n double, total double, square double, top double, " + ", ".join(f"{x} double" for x in losses)
    parts = rows.mapInPandas(measure, kinds).groupBy("lang")
    return parts.agg(*[F.sum(x).alias(x) for x in ("n", "total", "square")], F.max("top").alias("top"), *[F.sum(x).alias(x) for x in losses])


def train(docs: DataFrame) -> Model:
    """Models of all non-null langs of ``docs`` that have a letter; rows with null text or lang teach nothing.

    Repeated rows teach as often as they stand there; an empty table gives a model of no language, under which all texts are
    ``und``; other columns are ignored.

    The temperature of the scores and each language's limit of entropy, over which a text is rejected, are set on all of
    these rows; one row a language comes to the driver.
    """
    parts: dict[str, list[tuple[bytes, bytes]]] = defaultdict(list)
    for r in gram_codes(gram_counts(docs)).toLocalIterator(prefetchPartitions=True):
        parts[r["lang"]].append((r["codes"], r["n"]))
    languages, tables = sorted(parts), []
    for x in languages:
        codes, n = (b"".join(y) for y in zip(*parts.pop(x), strict=True))
        tables.append(kneser_ney_of(np.frombuffer(codes, np.uint32).reshape(-1, ORDER), np.frombuffer(n, np.float64)))
    model = Model(languages, tables)
    if not languages:
        return model
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    found = own_entropies(rows, model).toPandas().set_index("lang").loc[languages]
    model.temperature = TEMPERATURES[int(found.filter(like="loss").sum().to_numpy().argmin())]
    mean = found["total"] / found["n"]
    std = np.sqrt(np.maximum(found["square"] / found["n"] - mean**2, 0))
    # far above all that the language's own texts have, short and odd ones too
    model.limits = (found["top"] + 2 * std + 0.5).tolist()
    return model


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct of lang_pred, score, entropy and rejected for each text.

    Null texts and texts without a letter are ``und``, with score 0, and rejected; ties go to the first language.  Where no
    language was learned every text is ``und`` with score 0, and only those without a letter are rejected.
    """
    shared = spark.sparkContext.broadcast(model)  # 16 bytes an n-gram and context

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield classify(shared.value, texts.tolist())

    return F.pandas_udf(score, SCORE)(text.cast("string"))


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``docs`` with a column ``language`` (see :func:`predict`), learned from ``training``'s text and lang."""
    return docs.withColumn("language", predict(docs.sparkSession, train(training), F.col("text")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), predict(spark, model, F.col("text")).alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
