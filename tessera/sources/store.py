"""The embedding store: cells and patches by site, site metadata, run records and the site catalog."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CELLS_A_FILE = 100_000
CATALOG = "map<string, struct<resolutions: array<string>>>"


def write_cells(cells: DataFrame, path: str) -> None:
    """Hive-partitioned by site_id, a file or more for each ``CELLS_A_FILE`` cells; a rewrite replaces only the sites it holds."""
    part = F.floor(F.col("cell_id") / CELLS_A_FILE)
    ready = cells.repartition(F.col("site_id"), part).sortWithinPartitions("site_id", "cell_id")
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("site_id").parquet(path)


def read_cells(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All sites' cells; ids stay text even if they look like numbers, and a filter on site_id reads only its folders.  With
    the ``schema`` given a store without any cell can be read."""
    reader = spark.read.option("mergeSchema", "false")
    found = (reader if schema is None else reader.schema(schema)).parquet(path)
    return found.withColumn("site_id", F.col("site_id").cast("string"))


def cell(spark: SparkSession, path: str, site: str, cell_id: int) -> DataFrame:
    """The rows of one cell, of cells or patches; only its site's folder is listed and, in it, row groups that may hold it."""
    return read_cells(spark, path).where((F.col("site_id") == site) & (F.col("cell_id") == cell_id))


def patch_of(spark: SparkSession, out: str, ref: str) -> DataFrame:
    """The patches that a cell's ``patch_ref`` (``<site>/patches#<cell>``) stands for."""
    path, _, index = ref.rpartition("#")
    return cell(spark, f"{out}/patches", path.removesuffix("/patches"), int(index))


def patch_shapes(patches: DataFrame) -> DataFrame:
    """(site_id, n_cells, rows, cols, dim) of stored patches; of the vectors only one a site is looked at."""
    grid = patches.groupBy("site_id").agg(F.countDistinct("cell_id").alias("n_cells"), (F.max("prow") + 1).alias("rows"), (F.max("pcol") + 1).alias("cols"))
    one = patches.where("prow = 0 and pcol = 0").groupBy("site_id").agg(F.max(F.size("vec")).alias("dim"))
    return grid.join(one, "site_id", "left")


def write_site_meta(meta: DataFrame, path: str) -> None:
    """One JSON row a site; the ground size of a patch is the cell's by its patches across, null if unknown."""
    across = F.when(F.col("patch_grid")[1] > 0, F.col("patch_grid")[1])
    rows = meta.withColumn("patch_ground_m", F.col("cell_ground_m") / across)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("site_id").json(path)


def read_site_meta(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    found = spark.read.json(path) if schema is None else spark.read.schema(schema).json(path)
    return found.withColumn("site_id", F.col("site_id").cast("string"))


def append_run(run: DataFrame, path: str) -> None:
    """Adds the record of a run, keyed by its run_id."""
    run.write.mode("append").json(path)


def record_run(sites: DataFrame, settings: dict[str, object], path: str, run_id: str) -> None:
    """Says before the work what a run is going to do: its settings, the time and its sites (a name each)."""
    named = F.create_map(*[F.lit(x) for k, v in settings.items() for x in (k, str(v))]) if settings else F.lit(None).cast("map<string, string>")
    row = sites.select("site_id").distinct().agg(F.sort_array(F.collect_list("site_id")).alias("sites"))
    append_run(row.select(F.lit(run_id).alias("run_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"), F.size("sites").alias("n_sites"), "sites", named.alias("settings")), path)


def staged(df: DataFrame, path: str) -> DataFrame:
    """Writes a step of a run to a folder of the store and reads it back, so that what comes after doesn't repeat it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(pos, site_key, resolutions, default_res) from a JSON object of {key: {"resolutions": [...]}}; the first is the default."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", CATALOG)).alias("pos", "site_key", "entry"))
    found = rows.select("pos", "site_key", F.col("entry.resolutions").alias("resolutions"))
    return found.withColumn("default_res", F.try_element_at("resolutions", F.lit(1)))


class Conflict(ValueError):
    """Another writer has committed since the version was read that a change builds on."""


def write_tables(tables: dict[str, DataFrame], root: str, version: str, after: str | None | bool = True) -> None:
    """Writes tables of one state to new folders and then names their version as the current one: readers see all of it or
    nothing, and a folder that is being read is never written to.

    ``after`` is the version that the change builds on (None: there was none yet; True: whichever is current now).  The log has
    a numbered entry a commit, made by creating its file, which only one writer can: the other gets a :class:`Conflict`.  Until
    then nothing of the tables counts, so what a failed try has left is written over under the same name; a version that is in
    the log can't be written again.
    """
    spark = next(iter(tables.values())).sparkSession
    log = version_log(spark, root)
    if version in log:
        raise ValueError(f"version {version} is committed")
    if after is not True and (log[-1] if log else None) != after:
        raise Conflict(f"{root} is at version {log[-1] if log else None}, not {after}")
    # folders are named by the entry that the writer tries for and by the writer, so two writers never share one
    attempt = f"{len(log):06d}-{uuid.uuid4().hex[:8]}"
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/{name}/version={version}/{attempt}")
    if not create(spark, f"{root}/_versions/{len(log):06d}.json", json.dumps({"version": version, "attempt": attempt})):
        raise Conflict(f"another writer has committed entry {len(log)} of {root}")


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file that doesn't exist yet, whole or not at all; False if there is one.

    The text is written beside it and renamed, which fails where the name is taken.  That holds on local disks and HDFS; an
    object store whose rename is a copy can't keep two writers apart.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.{uuid.uuid4().hex}"))
    files = target.getFileSystem(conf)
    if files.exists(target):
        return False
    out = files.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    try:
        context.rename(context.makeQualified(beside), context.makeQualified(target), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        files.delete(beside, False)
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def _entries(spark: SparkSession, root: str) -> list[dict]:
    """The log's entries, in order; one small file a commit."""
    if not exists(spark, f"{root}/_versions"):
        return []
    rows = spark.read.schema("version string, attempt string").option("pathGlobFilter", "[0-9]*.json").json(f"{root}/_versions").withColumn("file", F.col("_metadata.file_name"))
    return [r.asDict() for r in rows.orderBy("file").collect()]


def version_log(spark: SparkSession, root: str) -> list[str]:
    """All committed versions, the first first."""
    return [e["version"] for e in _entries(spark, root)]


def current_version(spark: SparkSession, root: str) -> str | None:
    """The version that was committed last, or None before the first."""
    log = version_log(spark, root)
    return log[-1] if log else None


def read_table(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame | None:
    """A table of a committed version, the current one if None; None where there is no such version."""
    found = [e for e in _entries(spark, root) if version in (None, e["version"])]
    return spark.read.parquet(f"{root}/{name}/version={found[-1]['version']}/{found[-1]['attempt']}") if found else None


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def write_patches(patches: DataFrame, path: str) -> None:
    """(site_id, cell_id, prow, pcol, vec) rows, Hive-partitioned by site like the cells."""
    part = F.floor(F.col("cell_id") / (CELLS_A_FILE // 100))
    ready = patches.repartition(F.col("site_id"), part).sortWithinPartitions("site_id", "cell_id", "prow", "pcol")
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("site_id").parquet(path)


PARTS = ("cells", "patches", "meta")


def done_sites(spark: SparkSession, out: str) -> DataFrame:
    """(site_id, has_cells, has_patches, has_meta) of all sites that the store has anything of.

    Metadata is written last, when a site's cells and patches are whole.
    """
    told = None
    for part in PARTS:
        path = f"{out}/{part}"
        if not exists(spark, path):
            continue
        read = read_site_meta(spark, path, "site_id string") if part == "meta" else read_cells(spark, path, StructType.fromDDL("cell_id bigint, site_id string"))
        one = read.select("site_id", F.lit(part).alias("part")).distinct()
        told = one if told is None else told.unionByName(one)
    if told is None:
        told = spark.createDataFrame([], "site_id string, part string")
    return told.groupBy("site_id").agg(*[F.coalesce(F.bool_or(F.col("part") == p), F.lit(False)).alias(f"has_{p}") for p in PARTS])


def site_state(spark: SparkSession, out: str, site: str) -> DataFrame:
    """One row for a site: what the store has of it, the numbers it holds and those its metadata claims; each part is read from
    the site's folder alone."""
    mine = F.col("site_id") == site
    one = spark.createDataFrame([(site,)], "site_id string")
    if exists(spark, f"{out}/cells"):
        cells = read_cells(spark, f"{out}/cells", StructType.fromDDL("cell_id bigint, cls array<float>, site_id string")).where(mine)
        one = one.join(cells.groupBy("site_id").agg(F.count("*").alias("stored_cells"), F.max(F.size("cls")).alias("stored_dim")), "site_id", "left")
    if exists(spark, f"{out}/patches"):
        patches = read_cells(spark, f"{out}/patches", StructType.fromDDL("cell_id bigint, prow int, pcol int, vec array<float>, site_id string")).where(mine)
        shapes = patch_shapes(patches).select("site_id", F.col("n_cells").alias("cells_with_patches"), F.array("rows", "cols").alias("stored_grid"))
        one = one.join(shapes, "site_id", "left")
    if exists(spark, f"{out}/meta"):
        one = one.join(read_site_meta(spark, f"{out}/meta").where(mine).select("site_id", F.col("n_cells"), "embed_dim", "patch_grid", "model"), "site_id", "left")
    return one


def flattened(rows: DataFrame) -> DataFrame:
    """Nested columns as columns of their own, named with dots; lists and maps are left out."""
    out = []

    def add(fields: list, path: str) -> None:
        for f in fields:
            name, kind = f"{path}{f.name}", f.dataType
            if kind.typeName() == "struct":
                add(kind.fields, f"{name}.")
            elif kind.typeName() not in ("array", "map"):
                out.append(F.col(".".join(f"`{x}`" for x in name.split("."))).alias(name))

    add(rows.schema.fields, "")
    return rows.select(*out)
