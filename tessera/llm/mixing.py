"""Operator 3: mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Documents of each source are shuffled (by hash) and queued, the whole queue up to ``repeats`` times.  A document's
virtual finish time is the cumulative size of its source up to it, divided by the source's target.  All queues merge by
finish time: a global range sort, cut off where the total reaches the budget.

No window runs over a whole source or over all rows.  Cumulative sums are taken within hash buckets of a source, or
within ranges of finish time, and moved up by the sums of the buckets or ranges before; the numbers of buckets and
ranges grow with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import range_bounds, range_bucket, read, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BEFORE = (W.unboundedPreceding, -1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` of all sizes by weight; a
    target stops at ``repeats`` times its source's size and the excess is shared by weight among the others until no
    target is above.  That fixed point is a water level: with the sources in order of (limit / weight), the level for
    those not yet full is (budget - limits of the full ones) / (weights of the rest).
    """
    sums = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    turn = W.orderBy(F.col("source").asc_nulls_last())  # over sources, a narrow row each: one task, whatever the documents
    rated = sums.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("limit", F.lit(float(repeats)) * F.col("source_size"))
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everyone = W.partitionBy()
    levels = rated.select(
        "*",
        (F.sum("source_size").over(everyone) * F.lit(share)).alias("budget"),
        F.coalesce(F.sum("limit").over(order.rowsBetween(*BEFORE)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("rest"),
    ).withColumn("level", (F.col("budget") - F.col("full")) / F.col("rest"))
    # The first source whose own limit is above the level is not full; its level holds for all after it.
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    level = F.min_by("level", F.when(fits, F.col("limit") / F.col("weight"))).over(everyone)
    return levels.select(
        "source", "source_size", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit"))).alias("target")
    )


def turn_of(doc_id: Column, text: Column, seed: int = 7) -> Column:
    """A document's place in the shuffle."""
    return F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("long"), F.lit(-1)), text)


def word_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, turn): words of the text (null: 0) and the shuffled place, a hash of the id."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        turn_of(F.col("doc_id"), F.col("text")).alias("turn"),
    )


def queue_positions(sizes: DataFrame, rows: int) -> DataFrame:
    """Adds ``start``: the sizes before a row in its source's shuffled queue."""
    buckets = max(256, rows // 50_000)
    dealt = sizes.withColumn("bucket", F.pmod("turn", F.lit(buckets)).cast("int"))
    before = (
        dealt.groupBy("source", "bucket")
        .agg(F.sum("size").alias("bucket_size"))
        .select("source", "bucket", F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(*BEFORE)), F.lit(0)).alias("bucket_start"))
    )
    queue = W.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(*BEFORE)
    a, b = dealt.withColumn("within", F.coalesce(F.sum("size").over(queue), F.lit(0))).alias("a"), before.alias("b")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket"))
    return a.join(b, same).select("a.doc_id", "a.source", "a.size", "a.turn", (F.col("bucket_start") + F.col("within")).alias("start"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words the mix takes of it, repeats counted).

    Null texts have size 0 and nothing is taken of them; null sources are a source of their own, the last; documents of
    equal finish time are ordered by the shuffle's hash; repeated rows are queued once each; an empty table gives no
    rows; other columns are ignored.  The budget, ``share`` of all sizes rounded down, is met to the word: the document
    at the cut gives only what is left.
    """
    sizes = written(word_sizes(docs), "sizes")
    targets = written(source_targets(sizes, weights, share, repeats), "targets")
    total = sizes.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    budget = int(total["words"] * share)
    a, t = queue_positions(sizes, total["rows"]).alias("a"), targets.alias("t")
    queued = a.join(t, F.col("a.source").eqNullSafe(F.col("t.source"))).select("a.*", "source_size", "target")
    # Ties of finish time are drawn apart by the shuffle's hash, within one part in 2^40 of the time.
    apart = F.lit(1.0) + F.pmod(F.col("turn"), F.lit(4096)) / F.lit(float(1 << 52))
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).where("size > 0")
    finish = (F.col("start") + F.col("copy") * F.col("source_size") + F.col("size")) / F.col("target")
    timed = written(copies.withColumn("finish", finish * apart), "finish")
    bounds = range_bounds(timed, "finish", max(256, total["rows"] * repeats // 50_000))
    ranged = timed.withColumn("span", range_bucket(F.col("finish"), bounds, "double"))
    before = (
        ranged.groupBy("span")
        .agg(F.sum("size").alias("span_size"))
        .select("span", "span_size", F.coalesce(F.sum("span_size").over(W.orderBy("span").rowsBetween(*BEFORE)), F.lit(0)).alias("span_start"))
    )
    # Each range is sorted within; positions go on from the sizes of the ranges before, and the budget cuts them off.
    sorted_in = W.partitionBy("span").orderBy("finish", "turn", "doc_id", "copy", "size").rowsBetween(*BEFORE)
    placed = (
        ranged.withColumn("within", F.coalesce(F.sum("size").over(sorted_in), F.lit(0)))
        .join(F.broadcast(before), "span")  # at most 65,536 ranges
        .withColumn("position", F.col("span_start") + F.col("within"))
    )
    taken = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("position")))
    got = placed.groupBy("source", "doc_id", "turn", "start", "size").agg(F.sum(taken).alias("taken"))
    q, g = queued.alias("q"), got.alias("g")
    same = (
        F.col("q.source").eqNullSafe(F.col("g.source"))
        & F.col("q.doc_id").eqNullSafe(F.col("g.doc_id"))
        & (F.col("q.turn") == F.col("g.turn"))
        & (F.col("q.start") == F.col("g.start"))
        & (F.col("q.size") == F.col("g.size"))
    )
    return q.join(g, same, "left").select(
        "q.doc_id", "q.size", "q.source_size", "q.target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "q.source", "q.turn"
    )


def op3_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("source", "turn")
