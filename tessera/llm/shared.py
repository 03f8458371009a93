"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a fresh temporary folder is set on a single machine (a local master); a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one folder per application."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage: lost executors reread files, they don't recompute what led
    to them.  The files go with the application's folder.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with more underscores before it as long as ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, buckets: int) -> tuple[list, list[list]]:
    """Quantile bounds that cut ``key`` into about ``buckets`` ranges of equal row counts.

    Two levels of about sqrt(buckets) bounds each, at most 65,536 numbers in all, whatever the data.
    """
    fan = max(2, min(256, round(buckets**0.5)))
    total = fan * fan
    cuts = df.agg(F.percentile_approx(key, [i / total for i in range(1, total)], 10 * total)).first()[0]
    cuts = sorted(set(cuts or []))
    groups = [cuts[i : i + fan] for i in range(0, len(cuts), fan)] or [[]]
    return [g[-1] for g in groups[:-1]], groups


def range_bucket(key: Column, bounds: tuple[list, list[list]], kind: str) -> Column:
    """The range of ``bounds`` that holds ``key``: 0 for keys up to the first bound; null keys get -1."""
    tops, groups = bounds
    fan = max(map(len, groups), default=1)
    top = F.array(*[F.lit(x).cast(kind) for x in tops]).cast(f"array<{kind}>")
    low = F.array(*[F.array(*[F.lit(x).cast(kind) for x in g]).cast(f"array<{kind}>") for g in groups])
    outer = F.size(F.filter(top, lambda b: b < key))
    inner = F.size(F.filter(F.element_at(low, outer + 1), lambda b: b < key))
    return F.when(key.isNull(), F.lit(-1)).otherwise(outer * (fan + 1) + inner).cast("int")


_HELD: dict[str, object] = {}


def held(name: str, make):
    """What a Python worker keeps from task to task under ``name``: one thing at a time, so that workers which go from one
    operator to the next don't add up what each of them remembers."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]
