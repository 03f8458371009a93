"""Class statistics of annotation tiles and their rollup by site and resolution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.classes import NO_DATA, TARGETS, is_no_data, known_bit, target
from tessera.operators.percentiles import exact_percentiles


def class_histogram(pixels: DataFrame, tile: list[str], original: str = "original_class_id", count: str | None = None) -> DataFrame:
    """(tile..., original_class_id, pixel_count); ``count`` is a column of pixel counts, else each row is a pixel."""
    n = F.count("*") if count is None else F.sum(count)
    return pixels.groupBy(*tile, F.col(original).cast("int").alias("original_class_id")).agg(n.cast("bigint").alias("pixel_count"))


def invalid_classes(histogram: DataFrame, tile: list[str]) -> DataFrame:
    """Tiles with ids outside the map and the no-data ids: (tile..., invalid), the ids sorted."""
    bad = histogram.where(target(F.col("original_class_id")).isNull())
    return bad.groupBy(*tile).agg(F.sort_array(F.collect_set("original_class_id")).alias("invalid"))


def class_rollup(histogram: DataFrame, tile: list[str]) -> DataFrame:
    """One wide row a tile, without the tiles that have an invalid id.

    One aggregate of conditional sums: no pivot pass and no join with the map.  A tile that stays has ids of the map and of no
    data only, so its different ids are the bits that are set of a number.
    """
    t, n = F.col("target"), F.col("pixel_count")
    part = lambda when: F.coalesce(F.sum(F.when(when, n)), F.lit(0)).cast("bigint")
    wide = histogram.withColumn("target", target(F.col("original_class_id"))).groupBy(*tile).agg(
        F.sum(n).cast("bigint").alias("total_pixels"),
        part(t == 0).alias("pixels_no_data"),
        *[part(t == k).alias(f"pixels_class_{k}") for k in TARGETS],
        F.bit_count(F.bit_or(known_bit(F.col("original_class_id")))).cast("smallint").alias("n_unique_orig_classes"),
        F.count_if(t.isNull()).alias("bad"),
    )
    known = sum((F.col(f"pixels_class_{k}") for k in TARGETS), F.col("pixels_no_data"))
    return (
        wide.where("bad = 0")
        .drop("bad")
        .withColumn("pixels_unmapped", F.col("total_pixels") - known)
        .withColumn("no_data_frac", F.when(F.col("total_pixels") > 0, F.col("pixels_no_data") / F.col("total_pixels")).otherwise(0.0))
    )


def annotation_box(pixels: DataFrame, tile: list[str], original: Column, row: Column, col: Column, total: Column) -> DataFrame:
    """How much of a tile the box around its annotated pixels takes, and how dense it is; both 0 without any.

    ``total`` is an aggregate: the pixels of the tile.
    """
    seen = ~is_no_data(original)
    box = pixels.groupBy(*tile).agg(
        F.min(F.when(seen, row)).alias("row0"),
        F.max(F.when(seen, row)).alias("row1"),
        F.min(F.when(seen, col)).alias("col0"),
        F.max(F.when(seen, col)).alias("col1"),
        F.count_if(seen).alias("annotated"),
        total.alias("total"),
    )
    area = (F.col("row1") - F.col("row0") + 1) * (F.col("col1") - F.col("col0") + 1)
    return box.select(
        *tile,
        F.when(F.col("annotated") > 0, area / F.col("total")).otherwise(F.lit(0.0)).alias("annot_bbox_area_frac"),
        F.when(F.col("annotated") > 0, F.col("annotated") / area).otherwise(F.lit(0.0)).alias("annot_in_bbox_density"),
    )


SUMMARY = "class_ids array<int>, class_counts array<bigint>, row0 int, row1 int, col0 int, col1 int, annotated bigint"


def mask_summary(mask: np.ndarray) -> dict:
    """What statistics need of a mask (rows x columns): its ids with their counts, and the box around what isn't no data."""
    ids, counts = np.unique(mask, return_counts=True)
    seen = ~np.isin(mask, NO_DATA)
    rows, cols = np.flatnonzero(seen.any(axis=1)), np.flatnonzero(seen.any(axis=0))
    box = [int(rows[0]), int(rows[-1]), int(cols[0]), int(cols[-1])] if len(rows) else [None] * 4
    return {"class_ids": ids.astype(np.int32).tolist(), "class_counts": counts.tolist(), **dict(zip(("row0", "row1", "col0", "col1"), box, strict=True)), "annotated": int(seen.sum())}


LOT = 1 << 20  # pixels that are summarised at once, or one larger mask


def mask_summaries(pixels: np.ndarray, sizes: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, ...]:
    """:func:`mask_summary` of many masks at once, their pixels one after the other: the number of different ids of each, all
    ids and their counts, (row0, row1, col0, col1) and the number of annotated pixels."""
    n = len(sizes)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(n), sizes)
    order = np.lexsort((pixels, owner))
    told = pixels[order]
    first = np.flatnonzero(np.r_[True, (np.diff(told) != 0) | (np.diff(owner) != 0)]) if len(told) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(told)])
    seen = np.flatnonzero(~np.isin(pixels, NO_DATA))
    mine = owner[seen]
    row, col = np.divmod(seen - starts[mine], widths[mine])
    annotated = np.bincount(mine, minlength=n)
    box = np.zeros((4, n), np.int64)
    some = np.flatnonzero(annotated)
    at = np.searchsorted(mine, some)
    if len(some):
        box[:, some] = [f.reduceat(x, at) for x in (row, col) for f in (np.minimum, np.maximum)]
    return np.bincount(owner[first], minlength=n), told[first], counts, box, annotated


def summarised(masks: DataFrame) -> DataFrame:
    """``masks`` with :func:`mask_summary` of their ``classify`` in its place: a narrow row a mask, not a row a pixel."""
    keep = [f for f in masks.schema.fields if f.name not in ("classify", "problem")]
    names = [f.name for f in keep]
    schema = StructType([*keep, *StructType.fromDDL(SUMMARY).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, sizes = 0, np.asarray(pa.compute.list_value_length(b["classify"])).astype(np.int64)
            total = np.cumsum(sizes)
            while at < len(sizes):
                last = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + LOT, "right")))
                part = b.slice(at, last - at)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in names], *columns(part["classify"], sizes[at:last], part["width"])], schema.names)
                at = last

    def columns(masks: pa.Array, sizes: np.ndarray, widths: pa.Array) -> list[pa.Array]:
        width = np.asarray(pa.compute.fill_null(widths, 0)).astype(np.int64)
        sizes_seen = np.where(width > 0, sizes, 0)  # a mask without a width has no pixels
        pixels = np.asarray(masks.flatten()).astype(np.int64)[np.repeat(width > 0, sizes)]
        n, ids, counts, box, annotated = mask_summaries(pixels, sizes_seen, np.maximum(width, 1))
        begin = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(begin, pa.array(x)) for x in (ids.astype(np.int32), counts.astype(np.int64))]
        return [*lists, *[pa.array(x.astype(np.int32), mask=annotated == 0) for x in box], pa.array(annotated.astype(np.int64))]

    return masks.where(F.col("classify").isNotNull()).select(*names, "classify").mapInArrow(run, schema)


def tile_rows(masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The wide statistics row of each mask tile and its long class counts; tiles with an invalid id are in neither.

    ``masks`` have a ``classify`` array, or the columns of :func:`summarised` already.
    """
    tile = ["tile_id", "site", "resolution", "dataset_version", "split", "mask_path", "height", "width"]
    box = ["row0", "row1", "col0", "col1", "annotated"]
    told = summarised(masks) if "classify" in masks.columns else masks.where(F.col("class_ids").isNotNull())
    each = told.select(*tile, *box, F.explode(F.arrays_zip("class_ids", "class_counts")).alias("c"))
    each = each.select(*tile, *box, F.col("c.class_ids").alias("original_class_id"), F.col("c.class_counts").alias("n"))
    histogram = class_histogram(each, tile, count="n")
    area = (F.col("row1") - F.col("row0") + 1) * (F.col("col1") - F.col("col0") + 1)
    some = F.col("annotated") > 0
    rows = (
        class_rollup(class_histogram(each, [*tile, *box], count="n"), [*tile, *box])
        .withColumn("annot_bbox_area_frac", F.when(some, area / F.col("total_pixels")).otherwise(F.lit(0.0)))
        .withColumn("annot_in_bbox_density", F.when(some, F.col("annotated") / area).otherwise(F.lit(0.0)))
        .drop(*box)
    )
    wide = rows
    long = histogram.join(wide.select("mask_path"), "mask_path", "left_semi").select("tile_id", "site", "resolution", "split", "original_class_id", "pixel_count")
    return rows, long


def site_rollup(tiles: DataFrame, classes: DataFrame) -> DataFrame:
    """Statistics by (site, resolution) of the tiles table, with distinct original classes of the long one.

    Both sides shrink to one row a group before they are joined.  Only train and val are counted as splits.
    """
    key = ["site", "resolution"]
    frac = F.col("no_data_frac").cast("double")
    base = tiles.groupBy(*key).agg(
        F.max("dataset_version").alias("dataset_version"),
        F.count_if(F.col("split") == "train").alias("n_tiles_train"),
        F.count_if(F.col("split") == "val").alias("n_tiles_val"),
        F.count("*").alias("n_tiles_total"),
        F.sum("total_pixels").cast("bigint").alias("total_pixels"),
        F.sum("pixels_no_data").cast("bigint").alias("total_no_data_pixels"),
        F.avg(frac).alias("mean_no_data_frac"),
        F.avg(F.when(frac > 0.9, 1.0).otherwise(0.0)).alias("frac_tiles_mostly_no_data"),
        *[F.sum(f"pixels_class_{k}").cast("bigint").alias(f"pixels_class_{k}") for k in TARGETS if f"pixels_class_{k}" in tiles.columns],
    )
    union = classes.groupBy(*key).agg(F.countDistinct("original_class_id").cast("smallint").alias("n_unique_orig_classes_union"))
    shares = exact_percentiles(tiles, key, frac, [0.5, 0.9]).withColumnsRenamed({"p0": "median_no_data_frac", "p1": "p90_no_data_frac"})
    return base.join(shares, key, "left").join(union, key, "left").fillna(0, ["n_unique_orig_classes_union"])
