"""Keeping the statistics tables of annotation masks: whole and incremental updates, and their validation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.maintenance import append, new_rows, pair_images, prune, reconcile_links, validate
from tessera.operators.runs import sampled
from tessera.operators.stats import site_rollup, tile_rows
from tessera.schemas import TILE_CLASSES, TILES
from tessera.sources.npz import image_files, mask_files, read_mask_counts
from tessera.sources.store import current_version, read_table, remove, staged, write_tables

TABLES = ("tiles", "tiles_orig_classes", "site_resolution")
EXACT = ["height", "width", "total_pixels", "pixels_no_data", "pixels_unmapped", "n_unique_orig_classes"]
CLOSE = ["no_data_frac", "annot_bbox_area_frac", "annot_in_bbox_density"]


def coerced(table: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in its order and types; missing ones are null, others go."""
    kinds = [x.split(" ", 1) for x in schema.split(", ")]
    return table.select(*[(F.col(c) if c in table.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds])


def scanned(files: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tiles, tiles_orig_classes) of mask files, with their images' links."""
    wide, long = tile_rows(read_mask_counts(files))
    linked = pair_images(wide, images).withColumn("scanned_at", F.current_timestamp())
    return coerced(linked, TILES), coerced(long, TILE_CLASSES)


def update(spark: SparkSession, root: str, store: str, version: str, full: bool = False, pruned: bool = False) -> dict[str, DataFrame]:
    """Brings the tables under ``store`` up to the masks under ``root`` and makes ``version`` the current one.

    Only masks that the tiles table doesn't have are decoded (``full``: all).  Links of all tiles are found anew; with
    ``pruned`` tiles whose mask is gone are dropped, by the whole tile key in the class counts too.  The rollup is that of
    the new tables.  Returns the tables as stored.  Of two updates at once that build on the same version one raises; a failed
    one can be tried again under the same name.
    """
    base = current_version(spark, store)
    files, images = mask_files(spark, root), image_files(spark, root)
    on_disk = files.select("mask_path")
    old = None if full else read_table(spark, store, "tiles")
    if old is None:
        tiles, classes = scanned(files, images)
    else:
        known = read_table(spark, store, "tiles_orig_classes")
        more, counts = scanned(new_rows(files, old), images)
        tiles = reconcile_links(append(old, more), pair_images(on_disk, images))
        classes = append(known, counts)
        if pruned:
            tiles, classes = prune(tiles, classes, on_disk)
    work = f"{store}/_parts/{uuid.uuid4().hex}"  # tiles and counts once, for the tables and for the rollup
    parts = {name: staged(coerced(t, kinds), f"{work}/{name}") for name, t, kinds in (("tiles", tiles, TILES), ("tiles_orig_classes", classes, TILE_CLASSES))}
    write_tables({**parts, "site_resolution": site_rollup(*parts.values())}, store, version, base)
    remove(spark, work)
    return {name: read_table(spark, store, name) for name in TABLES}


def validate_store(spark: SparkSession, root: str, store: str, sample: int = 0, seed: int = 0) -> DataFrame:
    """Tiles that a new scan counts otherwise than the stored table: (tile key, mismatched); ``sample`` (0: all) tiles, by hash.

    Only the masks of the tiles that are looked at are decoded.
    """
    if current_version(spark, store) is None:
        raise ValueError(f"{store} has no tables")
    stored = read_table(spark, store, "tiles")
    some = sampled(stored, sample, "mask_path", seed) if sample else stored
    files = mask_files(spark, root).join(some.select("mask_path"), "mask_path", "left_semi")
    again, _ = scanned(files, image_files(spark, root))
    return validate(some, again, ["mask_path"], EXACT + [c for c in stored.columns if c.startswith("pixels_class_")], CLOSE)
