"""Keeping the statistics tables: new tiles, appends, prunes, duplicates, links and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TILE_KEY = ["tile_id", "site", "resolution", "split"]


def new_rows(found: DataFrame, known: DataFrame, key: str | list[str] = "mask_path") -> DataFrame:
    """Rows of ``found`` whose key isn't in ``known``."""
    keys = [key] if isinstance(key, str) else key
    return found.join(known.select(*keys), keys, "left_anti")


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows by column name; a column that one lacks is null there."""
    return old.unionByName(new, allowMissingColumns=True)


def prune(tiles: DataFrame, classes: DataFrame, on_disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiles whose mask is still on disk, and the class rows of those, by the whole tile key."""
    kept = tiles.join(on_disk.select("mask_path"), "mask_path", "left_semi")
    return kept, classes.join(kept.select(*TILE_KEY), TILE_KEY, "left_semi")


def orphans(classes: DataFrame, tiles: DataFrame, key: list[str] = TILE_KEY) -> DataFrame:
    """Class rows without a tile."""
    return classes.join(tiles.select(*key), key, "left_anti")


def pair_images(masks: DataFrame, images: DataFrame) -> DataFrame:
    """Adds image_path and image_exists: the image of the mask's own name, else of ``image_`` for ``mask_``."""
    directory = F.regexp_replace(F.col("mask_path"), "annot/([^/]*)$", "/")
    name = F.substring_index("mask_path", "/", -1)
    other = F.regexp_replace(name, "^mask_", "image_")
    named = masks.withColumn("_same", F.concat(directory, name)).withColumn("_other", F.concat(directory, other))
    one, two = images.select(F.col("image_path").alias("_a")).distinct(), images.select(F.col("image_path").alias("_b")).distinct()
    joined = named.join(one, F.col("_same") == F.col("_a"), "left").join(two, F.col("_other") == F.col("_b"), "left")
    path = F.coalesce("_a", "_b")
    return joined.withColumn("image_path", path).withColumn("image_exists", path.isNotNull()).drop("_same", "_other", "_a", "_b")


def reconcile_links(tiles: DataFrame, links: DataFrame, key: str = "mask_path") -> DataFrame:
    """Takes image_path and image_exists from ``links``; tiles that aren't there lose theirs."""
    rest = tiles.drop("image_path", "image_exists")
    return rest.join(links.select(key, "image_path", "image_exists"), key, "left").withColumn("image_exists", F.coalesce("image_exists", F.lit(False)))


def duplicates(rows: DataFrame, group: Column, order: list[Column], content: Column | None = None, ranked: bool = False) -> DataFrame:
    """Adds ``copies``, ``place`` (1: the one to keep, else 2; ``ranked``: all places) and ``conflict`` (the contents differ).

    ``order`` are values, the least first.  A group is an aggregate of one row that is joined back, so a group of any size is
    spread; only of rows with the very same order values one is picked in a window.  ``ranked`` sorts whole groups.
    """
    content = F.lit(0) if content is None else content
    told = rows.withColumn("_group", group).withColumn("_content", content).withColumn("_order", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    sums = told.groupBy("_group").agg(
        F.count("*").alias("copies"), F.min("_order").alias("_first"), (~F.min("_content").eqNullSafe(F.max("_content"))).alias("conflict")
    )
    s = sums.withColumnRenamed("_group", "_g")
    joined = told.join(s, F.col("_group").eqNullSafe(F.col("_g")))
    if ranked:
        place = F.row_number().over(W.partitionBy("_group").orderBy("_order"))
    else:
        same = F.row_number().over(W.partitionBy("_group", "_order").orderBy("_content"))
        place = F.when((F.col("_order") == F.col("_first")) & (same == 1), 1).otherwise(2)
    return joined.withColumn("place", place).drop("_group", "_g", "_content", "_order", "_first")


def deduplicated(tiles: DataFrame, verify: bool = False, content: Column | None = None) -> DataFrame:
    """One tile for each image that exists, ``mask_`` files first; with ``verify``, groups whose contents differ stay."""
    linked = tiles.where(F.col("image_exists"))
    first = F.substring_index("mask_path", "/", -1).startswith("mask_")
    ranked = duplicates(linked, F.col("image_path"), [~first, F.col("mask_path")], content)
    keep = (F.col("place") == 1) | (F.col("conflict") if verify else F.lit(False))
    rest = tiles.where(~F.coalesce("image_exists", F.lit(False)))
    return ranked.where(keep).drop("copies", "place", "conflict").unionByName(rest)


def validate(stored: DataFrame, recomputed: DataFrame, key: list[str], exact: list[str], close: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Rows of ``stored`` that differ from ``recomputed``: key and ``mismatched`` columns; a missing row differs in all.

    Numbers of ``close`` may differ by ``tolerance`` times the stored value, or times 1 if that is smaller.
    """
    s, r = stored.alias("s"), recomputed.withColumn("_found", F.lit(True)).alias("r")
    joined = s.join(r, key, "left")
    off = [F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in exact]
    for c in close:
        a, b = F.col(f"s.{c}"), F.col(f"r.{c}")
        near = F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a))
        off.append(F.when(~F.coalesce(near, F.lit(False)), F.lit(c)))
    told = F.filter(F.array(*off), lambda x: x.isNotNull())
    return joined.select(*key, told.alias("mismatched")).where(F.size("mismatched") > 0)


