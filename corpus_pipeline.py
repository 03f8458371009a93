"""The corpus pipeline: language ID, toxicity, near duplicates, mixing and packing of ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.  All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, ngram_join, packing, toxicity
from tessera.llm.shared import read, unused, written

TOXIC_FROM = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: without a letter, or unlike every language learned from ``lang``.

    Where ``lang`` is null throughout no language is learned, and only documents without a letter go: null, empty and
    letterless texts.  Each row is judged by its text alone, so repeated rows stay or go together; an empty table stays
    empty; other columns stay as they are, whatever their names.
    """
    name = unused(docs, "_language")
    found = docs.withColumn(name, langid.predict(spark, langid.train(docs), F.col("text")))
    return found.where(~F.col(f"{name}.rejected")).select(docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic, by a lexicon learned from the labels of the documents that are left.

    Where nothing can be learned, as without labels of both kinds, no document goes.  Null and empty texts have no toxic
    word and stay; repeated rows stay or go together; an empty table stays empty; other columns stay as they are.
    """
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"), F.lit(True))
    name = unused(docs, "_score")
    scored = docs.withColumn(name, toxicity.score(spark, lexicon, F.col("text")))
    return scored.where(F.col(name) < TOXIC_FROM).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: of those with the smallest doc_id (nulls last) the one whose text
    has the least digest.

    Rows are told apart by id and text, so another text of the same id stays if it is no near duplicate; of rows with the same
    id and text the least by the other columns stays.  Rows without a word are near to nothing and all stay; an empty table
    stays empty.
    """
    row, whole = unused(docs, "_row"), unused(docs, "_whole")
    text = F.col("text").cast("string")
    name = F.unhex(F.sha2(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text), 256))
    found = ngram_join.near_classes(docs, row=name).where("component is not null")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    stay = first.select(F.col("first.row").alias(row))
    worded = F.coalesce(text.rlike(mixing.WORD), F.lit(False))
    ordered = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    kept = docs.where(worded).withColumn(row, name).join(stay, row)
    kept = kept.groupBy(row).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*ordered)).alias(whole))
    return docs.where(~worded).unionByName(kept.select(*[F.col(f"{whole}.`{c}`") for c in docs.columns]))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, as many times as it takes them; one taken in part is whole.

    Null, empty and wordless texts have no words to take and go; null sources are a source; rows of one id, text and source
    are taken equally often; an empty table stays empty; other columns go with their row.
    """
    turn, times, copy = unused(docs, "_turn"), unused(docs, "_times"), unused(docs, "_copy")
    taken = mixing.mix(docs).where("taken > 0").groupBy("doc_id", "turn", "source")
    taken = taken.agg(F.ceil(F.sum("taken") / F.sum("size")).cast("int").alias(times))
    turned = docs.withColumn(turn, mixing.turn_of(F.col("doc_id"), F.col("text"))).alias("d")
    t = taken.alias("t")
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col(f"d.{turn}") == F.col("t.turn")) & F.col("d.source").eqNullSafe(F.col("t.source"))
    found = turned.join(t, same).select("d.*", F.col(f"t.{times}").alias(times))
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document left, with its sequence and place; null and empty texts are one token, repeated rows are
    packed each, an empty table gives no rows and other columns are left out."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can't express the models; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
