"""Operator 5: Merkle tree fingerprints of documents, with DataFrame functions only.

A text is cut into sections (at blank lines and before headings), these into paragraphs (lines) and these into
sentences.  Nothing is dropped at a cut, so the parts joined are the text.  A sentence's hash is SHA-256 of its bytes; a
node's is SHA-256 of its level and its children's hashes.  The fingerprint lists the tree from the root down:

    root / section : sentence sentence | sentence ; section : ...

the root in full (roots are equal just for equal texts), sections and paragraphs by 8 hex digits before ``:`` and
``.``, and sentences by 8 digits each.  Where branches of two fingerprints differ is where the texts were edited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import range_bounds, range_bucket, read

#: Cuts between characters; what is before and after stays whole.
SECTION = r"(?<=\n\n)(?!\n)|(?<=\n)(?=#{1,6} )"
PARAGRAPH = r"(?<=\n)(?!\n)"
SENTENCE = r"(?<=[.!?;:,] )"


def _hash(data: Column) -> Column:
    return F.sha2(data, 256)


def fingerprint(text: Column) -> Column:
    """``root/section:paragraph.sentences|paragraph.sentences;section:...`` of the text."""
    paragraphs = lambda s: F.transform(
        F.split(s, PARAGRAPH), lambda p: F.transform(F.split(p, SENTENCE), lambda x: _hash(x.cast("binary")))
    )
    # level by level: hashes of sentences, then of each node over its children, kept with the short list below it
    tree = F.transform(
        F.split(text, SECTION),
        lambda s: F.transform(
            paragraphs(s),
            lambda p: F.struct(
                _hash(F.concat(F.lit("p"), F.array_join(p, ""))).alias("h"),
                F.array_join(F.transform(p, lambda x: F.substring(x, 1, 8)), " ").alias("below"),
            ),
        ),
    )
    sections = F.transform(
        tree,
        lambda s: F.struct(
            _hash(F.concat(F.lit("s"), F.array_join(F.transform(s, lambda p: p["h"]), ""))).alias("h"),
            F.array_join(F.transform(s, lambda p: F.concat(F.substring(p["h"], 1, 8), F.lit("."), p["below"])), "|").alias("below"),
        ),
    )
    # a one-element array binds the sections once for root and list
    whole = F.transform(
        F.array(sections),
        lambda t: F.concat(
            _hash(F.concat(F.lit("d"), F.array_join(F.transform(t, lambda s: s["h"]), ""))),
            F.lit("/"),
            F.array_join(F.transform(t, lambda s: F.concat(F.substring(s["h"], 1, 8), F.lit(":"), s["below"])), ";"),
        ),
    )
    return F.element_at(whole, 1)


def root(print_: Column) -> Column:
    return F.substring_index(print_, "/", 1)


def leaves(print_: Column) -> Column:
    """The sentences' short hashes, without those of the nodes above."""
    bare = F.regexp_replace(F.substring_index(print_, "/", -1), r"[0-9a-f]{8}[:.]", "")
    return F.split(bare, "[ |;:.]+")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints: 1 for equal roots, else shared distinct sentences over all (Dice)."""
    x, y = F.array_distinct(leaves(a)), F.array_distinct(leaves(b))
    dice = 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(dice)


def edits(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections of ``b`` that no section of ``a`` equals: where the texts differ."""
    nodes = lambda x: F.transform(F.split(F.substring_index(x, "/", -1), ";"), lambda s: F.substring_index(s, ":", 1))
    # a one-element array binds the nodes once, and what only ``b`` has is found by hashing
    both = F.transform(F.array(F.struct(nodes(a).alias("a"), nodes(b).alias("b"))), lambda n: F.struct(F.array_except(n["b"], n["a"]).alias("new"), n["b"].alias("b")))
    told = F.transform(both, lambda n: F.filter(F.transform(n["b"], lambda s, i: F.when(F.array_contains(n["new"], s), i)), lambda i: i.isNotNull()))
    return F.element_at(told, 1)


def with_next(docs: DataFrame, rows_a_range: int = 20_000) -> DataFrame:
    """doc_id, text, fingerprint, next_text and next_fingerprint of the next row by descending doc_id (after the last:
    the first).

    Rows are shuffled once, into ranges of doc_id; each range's first row also goes to the range before, as the one that
    follows its last.  Only ids are read to find the ranges.  Null ids come last; rows of equal id are ordered by
    text.
    """
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1))
    ids = one.select(key.alias("key"))
    rows = ids.count()
    bounds = range_bounds(ids, "key", max(256, -(-rows // rows_a_range)))
    spans = (
        ids.withColumn("span", range_bucket(F.col("key"), bounds, "long"))
        .groupBy("span")
        .agg(F.min("key").alias("first"))
        .orderBy("span")
        .collect()
    )  # one row a range, at most 65,536
    if not spans:
        return one.select("doc_id", "text", F.lit("").alias("fingerprint"), F.lit("").alias("next_text"), F.lit("").alias("next_fingerprint"))
    ends = [(s["span"], s["first"], spans[i - 1]["span"]) for i, s in enumerate(spans)]  # the last goes to the first's turn
    ends = docs.sparkSession.createDataFrame(ends, "span int, first long, before int")
    printed = one.withColumn("fingerprint", fingerprint(F.col("text"))).withColumn("key", key).withColumn("span", range_bucket(key, bounds, "long"))
    # a visitor: a row that stands behind the last of the range before
    home = F.struct(F.col("span").alias("at"), F.lit(0).alias("visitor"))
    away = F.struct(F.col("before").alias("at"), F.lit(1).alias("visitor"))
    turns = F.when(F.col("key") == F.col("first"), F.array(home, away)).otherwise(F.array(home))
    placed = printed.join(F.broadcast(ends), "span").withColumn("v", F.explode(turns))  # at most 65,536 ranges
    dealt = placed.select("doc_id", "text", "fingerprint", "key", "v.at", "v.visitor")
    order = W.partitionBy("at").orderBy("visitor", "key", "text")
    return (
        dealt.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_fingerprint", F.lead("fingerprint").over(order))
        .where("visitor = 0")
        .select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    )


def op5_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_sections) of each document.

    The edited text ends in the beginning of the next one; ``edited_sections`` are its sections (numbers from 0) whose branches
    differ from all of the document's.  Null texts are empty and have no characters; a text is its own next one where it is
    alone; repeated rows have a row each, and next to each other change nothing; null ids come last; an empty table gives no
    rows; other columns are ignored.
    """
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2)
    edited = F.concat(F.expr("substring(text, 1, int(char_length(text) - floor(char_length(text) / 2)))"), F.expr("substring(next_text, 1, int(floor(char_length(text) / 2)))"))
    rows = with_next(docs).select("doc_id", n.alias("n_chars"), "fingerprint", "next_fingerprint", F.when(half > 0, edited).otherwise(F.col("text")).alias("edited"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        edits(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited_sections"),
    )


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_rows(read(spark, sf_dir, "documents"))
