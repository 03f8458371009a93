"""Image and mask tiles in ``.npz`` archives, decoded inside tasks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.names import site_id
from tessera.operators.stats import SUMMARY, mask_summary
from tessera.schemas import IMAGE_TILES, MASK_TILES
from tessera.sources import archives


def _files(spark: SparkSession, root: str, folders: tuple[str, ...]) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(root)
    parts = F.split("path", "/")
    return rows.select("path", "content", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), parts.alias("parts")).where(F.col("folder").isin(*folders))


def read_tiles(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """One row an image tile under ``root/<site>/<split>``; ``problem`` tells why a file couldn't be read.

    Only headers and small arrays are read, by seeks, where Python workers can open the files; elsewhere whole files are.
    """
    uri = qualified(spark, root)
    if archives.seekable(uri):
        archives.register(spark)
        return spark.read.format("npz_tiles").option("splits", ",".join(splits)).load(uri).drop("bytes_read")
    fields = archives.FIELDS

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, split, name, site in zip(b["path"], b["content"], b["folder"], b["name"], b["site_id"], strict=True):
                row = dict.fromkeys(fields) | {"site_id": site, "tile": name.removesuffix(".npz"), "split": split, "path": path}
                try:
                    row |= archives.tile_header(io.BytesIO(content))
                except archives.FAULTS as e:
                    row["problem"] = archives.told(e)
                rows.append(row)
            yield pd.DataFrame(rows, columns=fields).astype({"w": "Int32", "h": "Int32", "srid": "Int32"})

    files = _files(spark, root, splits).withColumn("site_id", site_id(F.element_at("parts", -3))).drop("parts")
    return files.mapInPandas(decode, IMAGE_TILES)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, by the session's default file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def read_mask_counts(files: DataFrame) -> DataFrame:
    """The rows of :func:`mask_files`, decoded, with the counts that statistics need in place of pixels."""
    kinds = MASK_TILES.replace("classify array<int>", SUMMARY)
    fields = [x.split()[0] for x in kinds.split(", ")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                row = dict.fromkeys(fields) | {k: r[k] for k in r if k in fields}
                try:
                    mask = decoded_mask(archives.opened(r["mask_path"]) if r["content"] is None else io.BytesIO(r["content"]))
                    row |= {"height": mask.shape[0], "width": mask.shape[1], **mask_summary(mask)}
                except archives.FAULTS as e:
                    row["problem"] = archives.told(e)
                rows.append(row)
            yield pd.DataFrame(rows, columns=fields).astype({c: "Int32" for c in ("height", "width", "row0", "row1", "col0", "col1")} | {"annotated": "Int64"})

    return files.mapInPandas(decode, kinds)


def decoded_mask(file) -> np.ndarray:
    """The mask of an archive; its other arrays aren't read."""
    with zipfile.ZipFile(file) as z:
        mask = archives.stored_array(z, "CLASSIFY")
    if mask.ndim != 2:
        raise ValueError(f"mask has {mask.ndim} dimensions")
    return mask.astype(np.int32)


def mask_files(spark: SparkSession, root: str) -> DataFrame:
    """Masks under ``<version>/<resolution>/<site>/{train,valannot}`` with their bytes, by their place alone.  The bytes are
    only read where they are used: a listing doesn't touch them, and where Python workers can open the files ``content`` is null
    and they read the mask alone."""
    parts, n = F.col("parts"), F.size("parts")
    above = lambda k: F.try_element_at(parts, -F.lit(k))
    content = F.lit(None).cast("binary") if archives.seekable(qualified(spark, root)) else F.col("content")
    return _files(spark, root, ("trainannot", "valannot")).select(
        above(3).alias("site"), above(4).alias("resolution"), F.when(n >= 5, above(5)).alias("dataset_version"), F.regexp_replace("folder", "annot$", "").alias("split"),
        F.regexp_replace("name", r"\.npz$", "").alias("tile_id"), F.col("path").alias("mask_path"), content.alias("content"),
    )


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """(image_path) of the images beside the masks of :func:`mask_files`; none is read."""
    return _files(spark, root, ("train", "val")).select(F.col("path").alias("image_path"))


def pixel_rows(tiles: DataFrame, files: DataFrame) -> DataFrame:
    """(path, row, col, r, g, b) of image tiles: ``files`` are their ``binaryFile`` rows."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    bands = [z[k].astype(np.float32) for k in ("RED", "GREEN", "BLUE")]
                h, w = bands[0].shape
                row, col = np.divmod(np.arange(h * w, dtype=np.int32), w)
                yield pd.DataFrame({"path": path, "row": row, "col": col} | {k: v.ravel() for k, v in zip("rgb", bands, strict=True)})

    wanted = files.join(tiles.where("problem is null").select("path"), "path", "left_semi").select("path", "content")
    return wanted.mapInPandas(decode, "path string, row int, col int, r float, g float, b float")
