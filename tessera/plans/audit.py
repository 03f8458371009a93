"""The audit of an embedding store on disk: every file told by what claims it, every claim by what is there."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.runs import integrity
from tessera.sources.store import PARTS, exists, read_cells, read_site_meta

CELLS = "cell_id bigint, patch_ref string, cls array<float>, site_id string"
PATCHES = "cell_id bigint, prow int, pcol int, vec array<float>, site_id string"
META = "site_id string, n_cells bigint, embed_dim int, patch_grid array<int>"


def store_files(spark: SparkSession, out: str) -> DataFrame:
    """(path, part, site_id, bytes) of all files under a store, as tasks list them; ``part`` and ``site_id`` are null for those
    that aren't in a site's folder of a known part.  Names that begin with a dot or a line aren't data, and
    Spark lists no empty files: neither count."""
    root = re.sub("^[a-z0-9]+:/*", "/", f"{out.rstrip('/')}/")
    empty = spark.createDataFrame([], "path string, length bigint")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).select("path", "length") if exists(spark, out) else empty
    at = F.substring_index("path", root, -1)
    known = rf"^({'|'.join(PARTS)})/site_id=([^/]+)/[^/]+$"
    of = lambda i: F.when(at.rlike(known), F.regexp_extract(at, known, i))
    return rows.select(at.alias("path"), of(1).alias("part"), F.url_decode(F.replace(of(2), F.lit("+"), F.lit("%2B"))).alias("site_id"), F.col("length").alias("bytes"))


def unowned(files: DataFrame) -> DataFrame:
    """(path, bytes, problem) of files that no site owns: outside of the known parts, or of a site without metadata, which a
    stopped run has left."""
    whole = files.where("part = 'meta'").select("site_id").distinct().withColumn("_whole", F.lit(True))
    loose = files.join(whole, "site_id", "left").where("_whole is null and not startswith(path, 'runs/')")
    why = F.when(F.col("part").isNull(), F.lit("in no part of the store")).otherwise(F.lit("of a site without metadata"))
    return loose.select("path", "bytes", why.alias("problem"))


def audited(spark: SparkSession, out: str) -> DataFrame:
    """One row a site of any part: (site_id, ok, problems, files, bytes).

    Files, cells, patches and metadata are read from the store and joined by site: parts without a file, numbers that differ,
    cells without patches and patches without a cell, patches that aren't the stated grid or size are told, as well as all
    that :func:`tessera.operators.runs.integrity` finds.
    """
    files = store_files(spark, out)
    there = {p: exists(spark, f"{out}/{p}") for p in PARTS}
    table = lambda part, ddl: read_cells(spark, f"{out}/{part}", StructType.fromDDL(ddl)) if there[part] else spark.createDataFrame([], ddl)
    cells, patches = table("cells", CELLS), table("patches", PATCHES)
    meta = read_site_meta(spark, f"{out}/meta", META) if there["meta"] else spark.createDataFrame([], META)
    size = F.aggregate("vec", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    each = patches.groupBy("site_id", "cell_id").agg(
        F.max(size).alias("max_abs"), F.count("*").alias("n"), F.max("prow").alias("prow"), F.max("pcol").alias("pcol"), F.min(F.size("vec")).alias("dim0"), F.max(F.size("vec")).alias("dim1")
    )
    report = integrity(cells, meta, each)
    sides = cells.select("site_id", "cell_id", F.lit(1).alias("c")).join(each.withColumn("p", F.lit(1)), ["site_id", "cell_id"], "full")
    sides = sides.join(meta.select("site_id", "embed_dim", "patch_grid"), "site_id", "left")
    odd = (F.col("prow") + 1 != F.col("patch_grid")[0]) | (F.col("pcol") + 1 != F.col("patch_grid")[1]) | (F.col("n") != F.col("patch_grid")[0] * F.col("patch_grid")[1])
    counted = sides.groupBy("site_id").agg(
        F.count_if(F.col("c").isNotNull() & F.col("p").isNull()).alias("bare"),
        F.count_if(F.col("c").isNull()).alias("stray"),
        F.count_if(odd).alias("odd"),
        F.count_if((F.col("dim0") != F.col("embed_dim")) | (F.col("dim1") != F.col("embed_dim"))).alias("dims"),
    )
    owned = files.where("site_id is not null").groupBy("site_id").agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), *[F.count_if(F.col("part") == p).alias(f"_{p}") for p in PARTS]
    )
    all_ = report.join(counted, "site_id", "full").join(owned, "site_id", "full")
    more = [
        *[F.when(F.coalesce(f"_{p}", F.lit(0)) == 0, f"{p} has no file") for p in PARTS],
        F.when(F.col("bare") > 0, F.concat(F.col("bare").cast("string"), F.lit(" cells without patches"))),
        F.when(F.col("stray") > 0, F.concat(F.col("stray").cast("string"), F.lit(" cells of patches are unknown"))),
        F.when(F.col("odd") > 0, F.concat(F.col("odd").cast("string"), F.lit(" cells' patches aren't the stated grid"))),
        F.when(F.col("dims") > 0, F.concat(F.col("dims").cast("string"), F.lit(" cells' patches aren't of the stated size"))),
    ]
    problems = F.concat(F.coalesce("problems", F.array().cast("array<string>")), F.filter(F.array(*more), lambda x: x.isNotNull()))
    return all_.select("site_id", (F.size(problems) == 0).alias("ok"), problems.alias("problems"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
