"""Site runs: catalog, shards, resume, status and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OK, SKIPPED, FAILED, MISSING = "ok", "skipped", "failed", "missing"


def shard(sites: DataFrame, order: str, index: int, shards: int, limit: int = 0) -> DataFrame:
    """Every ``shards``-th site from ``index`` on, in the given order; a limit (0: none) holds after that."""
    if not 0 <= index < shards:
        raise ValueError("the shard's index is outside 0..shards-1")
    numbered = sites.withColumn("_n", F.row_number().over(W.orderBy(order)) - 1)  # a catalog's rows: few
    mine = numbered.where(F.col("_n") % shards == index)
    if limit:
        mine = mine.where(F.floor(F.col("_n") / shards) < limit)
    return mine.drop("_n")


def to_do(sites: DataFrame, done: DataFrame, key: str = "site_id", parts: tuple[str, ...] = ("has_cells", "has_meta")) -> DataFrame:
    """Sites without all of the ``parts``: a manifest without its metadata, or metadata without a manifest, isn't done."""
    whole = done.where(reduce(Column.__and__, map(F.col, parts)))
    return sites.join(whole.select(key), key, "left_anti")


def resolved(sites: DataFrame, tiles: DataFrame, rasters: DataFrame) -> DataFrame:
    """Adds tiles_path, rgb_path and ``problem`` (null, or why a site can't run, at most 70 characters)."""
    t, r = tiles.select("site_key", "res", "tiles_path"), rasters.select("site_key", "res", "rgb_path")
    known = rasters.select("site_key").distinct().withColumn("_known", F.lit(True))
    joined = sites.join(t, ["site_key", "res"], "left").join(r, ["site_key", "res"], "left").join(known, "site_key", "left")
    why = (
        F.when(F.col("tiles_path").isNull(), F.concat(F.lit("no tiles for "), "site_key", F.lit(" at "), "res"))
        .when(F.col("_known").isNull(), F.concat(F.lit("no raster for "), "site_key"))
        .when(F.col("rgb_path").isNull(), F.concat(F.lit("no raster at "), "res", F.lit(" for "), "site_key"))
    )
    return joined.withColumn("problem", F.substring(why, 1, 70)).drop("_known")


def status(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of results by what came of them."""
    s = F.col("status")
    return results.groupBy(*(by or [])).agg(
        F.count("*").alias("n_sites"), F.count_if(s == OK).alias("n_ok"), F.count_if(s == SKIPPED).alias("n_skipped"), F.count_if(s == FAILED).alias("n_failed")
    )


def pick(rows: DataFrame, name: str, text: str, order: str) -> DataFrame:
    """The first row whose name holds ``text``, whatever the case."""
    return rows.where(F.contains(F.lower(F.col(name)), F.lit(text.lower()))).orderBy(order).limit(1)


def with_prefix(rows: DataFrame, name: str, prefixes: list[str]) -> DataFrame:
    cond = F.lit(False)
    for p in prefixes:
        cond |= F.col(name).startswith(p)
    return rows.where(cond)


def largest(rows: DataFrame, size: Column, tie: str, limit: int | None = None) -> DataFrame:
    """Rows by size, largest first; all of them if there is no limit."""
    ordered = rows.orderBy(size.desc(), tie)
    return ordered if limit is None else ordered.limit(limit)


def sampled(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows by a seeded hash of their key: the same ones however the table is partitioned."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


SALTS = 64


def sampled_by_file(rows: DataFrame, n: int, file: str, key: str, seed: int = 0, turn: Column | None = None) -> DataFrame:
    """About ``n`` rows in equal parts of every file, at least one of each, by a seeded hash of their key (or by ``turn``).

    The first of each of ``SALTS`` shares of a file are found before the first of the file, so no task sorts a whole file.
    """
    files = max(1, rows.select(file).distinct().count())
    each = max(1, n // files)
    order = [F.xxhash64(F.lit(seed), key) if turn is None else turn, F.col(key)]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(SALTS)))
    first = lambda df, *by: df.withColumn("_turn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_turn") <= each).drop("_turn")
    return first(first(salted, file, "_salt"), file).drop("_salt")


def integrity(cells: DataFrame, meta: DataFrame, patches: DataFrame, site: str = "site_id") -> DataFrame:
    """One row a site of any of the three: ok and the problems found.

    ``cells`` has (site, cell_id, patch_ref, cls), ``meta`` (site, n_cells, embed_dim), ``patches`` (site, cell_id, max_abs).
    """
    c = cells.groupBy(site).agg(
        F.count("*").alias("n"),
        F.countDistinct("cell_id").alias("distinct_ids"),
        F.min("cell_id").alias("low"),
        F.max("cell_id").alias("high"),
        F.count_if(F.substring_index("patch_ref", "#", -1).cast("bigint") != F.col("cell_id")).alias("bad_refs"),
        F.min(F.size("cls")).alias("dim0"),
        F.max(F.size("cls")).alias("dim1"),
        F.count_if(F.exists("cls", lambda x: F.isnan(x) | x.isNull())).alias("bad_vectors"),
    )
    p = patches.groupBy(site).agg(F.count("*").alias("n_patches"), F.count_if(F.col("max_abs") == 0).alias("empty_patches"))
    m = meta.select(site, F.col("n_cells").alias("meta_cells"), "embed_dim")
    all_ = c.join(m, site, "full").join(p, site, "full")
    told = [
        F.when(F.col("n").isNull(), "no cells"),
        F.when(F.col("meta_cells").isNull(), "no metadata"),
        F.when(F.col("n_patches").isNull(), "no patches"),
        F.when(F.col("n") != F.col("meta_cells"), "cells and metadata differ in number"),
        F.when(F.col("n") != F.col("n_patches"), "cells and patches differ in number"),
        F.when((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("distinct_ids") != F.col("n")), "cell ids aren't 0 to n - 1"),
        F.when(F.col("bad_refs") > 0, "patch references differ from cell ids"),
        F.when((F.col("dim0") != F.col("embed_dim")) | (F.col("dim1") != F.col("embed_dim")), "vectors differ from the stated size"),
        F.when(F.col("bad_vectors") > 0, "vectors hold no numbers"),
        F.when(F.col("empty_patches") > 0, "patches are empty"),
    ]
    problems = F.filter(F.array(*told), lambda x: x.isNotNull())
    return all_.select(site, (F.size(problems) == 0).alias("ok"), problems.alias("problems"))
