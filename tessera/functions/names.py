"""Site ids, tile file names and patch references, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def site_id(key: Column) -> Column:
    """Each run of other characters than letters and digits becomes one ``_``; none at the ends."""
    return F.regexp_replace(F.regexp_replace(key, "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")


def archived_site_id(key: Column) -> Column:
    """The archived rule: ``/`` becomes ``__``."""
    return F.replace(key, F.lit("/"), F.lit("__"))


def site_key(directory: Column) -> Column:
    """The path without its last two parts, if it has more than two; else as it is."""
    parts = F.split(directory, "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, F.size(parts) - 2), "/")).otherwise(directory)


def colliding_sites(sites: DataFrame, key: str = "site_key") -> DataFrame:
    """Ids that more than one key maps to: (site_id, keys)."""
    named = sites.select(key).distinct().withColumn("site_id", site_id(F.col(key)))
    return named.groupBy("site_id").agg(F.sort_array(F.collect_list(key)).alias("keys")).where(F.size("keys") > 1)


TILE_NAME = r"^(.*)_(\d+)_(\d+)\.npz$"


def tile_key(name: Column) -> Column:
    """The blob's key in ``<key>_<col>_<row>.npz``, without ``image_`` and ``_part``; null for other names."""
    key = F.regexp_extract(name, TILE_NAME, 1)
    return F.when(F.regexp_like(name, F.lit(TILE_NAME)), F.replace(F.regexp_replace(key, "^image_", ""), F.lit("_part"), F.lit("")))


def tile_col(name: Column) -> Column:
    return F.when(F.regexp_like(name, F.lit(TILE_NAME)), F.regexp_extract(name, TILE_NAME, 2).cast("int"))


def tile_row(name: Column) -> Column:
    return F.when(F.regexp_like(name, F.lit(TILE_NAME)), F.regexp_extract(name, TILE_NAME, 3).cast("int"))


def patch_ref(path: Column, index: Column) -> Column:
    return F.concat(path, F.lit("#"), index.cast("string"))


def ref_path(ref: Column) -> Column:
    """What is before the last ``#``."""
    return F.regexp_extract(ref, r"^(.*)#[^#]*$", 1)


def ref_index(ref: Column) -> Column:
    return F.substring_index(ref, "#", -1).cast("bigint")


def cell_key(index: Column) -> Column:
    """``cell_`` and at least four digits."""
    digits = index.cast("string")
    return F.concat(F.lit("cell_"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def relative_ref(ref: Column, root: Column) -> Column:
    under = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(ref, under), F.substring(ref, F.length(under) + 1, F.length(ref))).otherwise(ref)


def absolute_ref(ref: Column, root: Column) -> Column:
    return F.when(F.startswith(ref, F.lit("/")), ref).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), ref))


def blob_ids(blobs: DataFrame, key: str = "key", site: str = "site") -> DataFrame:
    """Adds ``blob_id``: the first eight characters of the cleaned key, or the whole where a site has them twice."""
    clean = F.regexp_replace(F.col(key), "[^0-9A-Za-z_-]", "_")
    short = F.substring(clean, 1, 8)
    many = F.count("*").over(W.partitionBy(site, short))
    return blobs.withColumn("blob_id", F.when(many > 1, clean).otherwise(short))
