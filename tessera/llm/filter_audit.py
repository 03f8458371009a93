"""Operator 12: how five filters interact, by the multilinear extension of each part's removals.

A document's mask tells which filters it fails.  A part's documents are counted by mask, 32 numbers whatever its size, and
these give its removal polynomial: the sum over masks of count * (1 - product of (1 - x_i) over the mask's filters), in one
variable a filter.  At a corner (each variable 0 or 1) it is the number of documents that a set of filters removes, so a
step's survivors are the part's documents less a corner.  A filter's Shapley value is the integral from 0 to 1 of the partial
derivative by its variable along the diagonal, in exact fractions; times the number of orders it is the whole number of
documents that the filter removes, added up over all orders.

Texts are read once and leave only a digest.  The whole table's duplicates are told by digests: counts by (digest, mask, part,
labels, doc_id), the smallest doc_id of each, and the smallest of each digest, all with partial sums before they are shuffled,
so a text that a third of the rows share is a row a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations, permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
    "toxic_lost long, shapley long"
)


def text_mask(text: Column, words: Column) -> Column:
    """Bits 0 to 3: the text fails A (under 50 words), B (under 65 % distinct words), C (over 5 % capitals), D (odd marks)."""
    n = F.size(words)
    fails = [
        n < 50,
        F.size(F.array_distinct(words)) * 100 < n * 65,
        F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 5,
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by source and failed filters, bit i for filter i, and those labelled so."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(f"({WORD})")).alias("words"),
    )
    told = told.select("doc_id", "part", "digest", text_mask(F.col("text"), F.col("words")).alias("mask"))
    rows = told.groupBy("digest", "mask", "part", "doc_id").agg(F.count("*").alias("n"))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(one("quality"), one("toxic"))
    marked = rows.join(known, "doc_id", "left").fillna(0, ["quality", "toxic"])
    # of each group the rows, and its smallest id with the rows that have it: those aren't after any of their own group
    kind = ["digest", "mask", "part", "quality", "toxic"]
    groups = marked.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    least = groups.groupBy("digest").agg(F.min("low.doc_id").alias("least"))
    passing = F.col("no_id") + F.when(F.col("low.doc_id") == F.col("least"), F.col("low.n")).otherwise(0)
    split = groups.join(least, "digest").select(
        "part", "mask", "quality", "toxic", F.explode(F.array(F.struct(passing.alias("n"), F.lit(0).alias("again")), F.struct((F.col("n") - passing).alias("n"), F.lit(1 << 4).alias("again")))).alias("x")
    )
    counted = split.where("x.n > 0").groupBy("part", (F.col("mask") + F.col("x.again")).cast("int").alias("mask"))
    return counted.agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("quality")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("bad")).withColumnRenamed("bad", "toxic")


def subsets(mask: int) -> list[int]:
    """The non-empty sets of filters within ``mask``."""
    bits = [1 << i for i in range(mask.bit_length()) if mask >> i & 1]
    return [sum(some) for k in range(1, len(bits) + 1) for some in combinations(bits, k)]


def removal_polynomial(counts: dict[int, int]) -> dict[int, int]:
    """Coefficients by set of variables (as bits) of the sum over masks of count * (1 - product of (1 - x_i))."""
    out: dict[int, int] = {}
    for mask, n in counts.items():
        for s in subsets(mask):
            out[s] = out.get(s, 0) + (n if s.bit_count() % 2 else -n)
    return out


def corner(polynomial: dict[int, int], ones: int) -> int:
    """The polynomial's value where the variables of ``ones`` are 1 and the others 0."""
    return sum(c for s, c in polynomial.items() if s & ones == s)


def shapley(polynomial: dict[int, int], i: int) -> Fraction:
    """The integral over t in 0..1 of the partial derivative by x_i where all variables are t: each term with x_i and k - 1
    others is c * t^(k - 1), so it gives c / k."""
    return sum((Fraction(c, s.bit_count()) for s, c in polynomial.items() if s >> i & 1), Fraction(0))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The rows of the report, all orders and steps of each part, from (part, mask, n, good, toxic)."""
    orders = ["".join(p) for p in permutations(filters)]
    bit = {f: 1 << i for i, f in enumerate(filters)}
    names = [x.split()[0] for x in REPORT.split(", ")]

    def of_part(part: str, rows: list) -> pd.DataFrame:
        every, good, toxic = ({r["mask"]: r[c] for r in rows} for c in ("n", "good", "toxic"))
        all_of, good_of, toxic_of = map(removal_polynomial, (every, good, toxic))
        at = {s: (corner(all_of, s), corner(good_of, s), corner(toxic_of, s)) for s in range(1 << len(filters))}
        failing = {f: sum(n for m, n in every.items() if m & b) for f, b in bit.items()}
        value = {f: int(shapley(all_of, i) * len(orders)) for i, f in enumerate(filters)}
        out, total = [], sum(every.values())
        for order in orders:
            before = 0
            for step, f in enumerate(order, 1):
                after = before | bit[f]
                removed, good_lost, toxic_lost = (x - y for x, y in zip(at[after], at[before], strict=True))
                out.append((part, order, step, total - at[after][0], removed, failing[f] - removed, every.get(bit[f], 0), good_lost, toxic_lost, value[f]))
                before = after
        return pd.DataFrame(out, columns=names)

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, rows in zip(b["part"], b["rows"], strict=True):
                yield of_part(part, [r if isinstance(r, dict) else r.asDict() for r in rows])

    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))  # 32 at most
    return parts.mapInPandas(report, REPORT)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step: how many documents are kept, removed, and so on; see ``REPORT``.

    Null texts are empty (they fail A); null sources are the part '' with the empty ones; repeated rows count once each, and
    rows of one text and the same smallest doc_id aren't copies of a smaller one, nor are rows without an id; several labels
    of an id count if any is 1, null ids have none; an empty table gives no rows; other columns are ignored.
    """
    return audit(mask_counts(docs, labels))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
