"""Whole runs: sites from tiles to numbered cells with embeddings and patches, for many sites in one plan."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geo import native_resolution, pixel_box_to_world
from tessera.functions.names import patch_ref
from tessera.functions.projections import reprojected_boxes
from tessera.operators.embedding import Embedder, TokenEmbedder, embed, embed_tokens, patch_rows
from tessera.operators.polygons import cut_pieces, footprint_polygons, polygon_semi_join, trapezoids
from tessera.operators.runs import FAILED, OK, SKIPPED
from tessera.operators.spatial import box_semi_join, clip_to, grid_counters, grid_info, pixel_areas, pixel_grid, total_bounds, window_coverage, with_cell_ids
from tessera.sources.store import done_sites, patch_shapes, read_cells, record_run, remove, staged, write_cells, write_patches, write_site_meta

Stage = Callable[[DataFrame, str], DataFrame]


def in_raster_systems(tiles: DataFrame, rasters: DataFrame) -> DataFrame:
    """Tile boxes in the system of their site's raster; as they are where either table doesn't say its ``srid``."""
    if "srid" not in tiles.columns or "srid" not in rasters.columns:
        return tiles
    known = tiles.join(rasters.select("site_id", F.col("srid").alias("_to")), "site_id")
    moved = reprojected_boxes(known, F.col("srid"), F.col("_to"))
    return moved.withColumn("srid", F.col("_to")).drop("_to").where("xmin is not null").select(tiles.columns)


def site_grid(tiles: DataFrame, rasters: DataFrame, patch: int, pixels: DataFrame | None = None, least: float = 0.02, block: int = 256, keep_footprint: bool = True, stage: Stage | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, info): the numbered cells of ``patch`` pixels that touch a tile and aren't void, and what is told of the grid.

    ``tiles`` are boxes by site_id, ``rasters`` (site_id, width, height, geo_transform), ``pixels`` their pixels (site_id, row,
    col, r, g, b).  Tiles are brought to the raster's reference system (``srid``, if both say it), then cut to the polygons of
    its data (``keep_footprint``) or to its extent, each tile by itself, and cells are those that touch what is left of one; the
    box around all of it is snapped outward to the raster's pixels and whole patches.  Without pixels nothing is known of data,
    and all cells stay.  Boxes meet in buckets of a cell's side, which each site has by its own resolution.  ``stage`` writes a
    step and reads it back: what is left of tiles, cells near them and cells kept are each used more than once.
    """
    stage = stage or (lambda step, name: step)
    site, place = ["site_id"], ["site_id", "row", "col"]
    side = rasters.select("site_id", (native_resolution(F.col("geo_transform")) * patch).alias("_side"))
    tiles = in_raster_systems(tiles, rasters)
    polygon = pixels is not None and keep_footprint
    if polygon:
        pieces = trapezoids(footprint_polygons(pixels, rasters), ["site_id", "region"])
        cut = cut_pieces(tiles.join(side, site), pieces.join(side, site), "_side", site)
    else:
        gt, zero = F.col("geo_transform"), F.lit(0)
        extents = rasters.select("site_id", *[v.alias(k) for k, v in pixel_box_to_world(gt, zero, zero, F.col("width"), F.col("height")).items()])
        cut = clip_to(tiles, extents, site).join(side, site)
    cut = stage(cut, "cut")
    full = pixel_grid(pixel_areas(total_bounds(cut, site), rasters, patch), patch)
    sized = full.join(side, site)
    near = polygon_semi_join(sized, cut, "_side", place, site, touch=True) if polygon else box_semi_join(sized, cut, "_side", site, place)
    near = stage(near.select(full.columns), "near")
    kept = near
    if pixels is not None:
        seen = window_coverage(near, pixels, block, site, ["row", "col"]).where(F.col("coverage") >= least)
        kept = stage(near.join(seen.select(*place), place, "left_semi"), "kept")
    return with_cell_ids(kept), grid_info(kept, grid_counters(full, near, kept), rasters, patch)


def run_sites(
    tiles: DataFrame,
    rasters: DataFrame,
    out: str,
    patch: int,
    cell_pixels: Callable[[DataFrame], DataFrame],
    make_embedder: Callable[[], Embedder | TokenEmbedder],
    pixels: DataFrame | None = None,
    model: str = "",
    resume: bool = True,
    least: float = 0.02,
    with_patches: bool = False,
    settings: dict[str, object] | None = None,
) -> DataFrame:
    """Grid, embed and store the cells of all sites of ``tiles``, with their patches and metadata; one status row a site.

    ``cell_pixels`` adds each cell's ``pixels``.  Sites are rows of one plan, spread over the cluster by cell.  The embedder runs
    once a cell: the grid and what the embedder gives are staged in the store, then cells are written, then (``with_patches``,
    where the embedder gives class and patch vectors) patches, each under the cell's number that its ``patch_ref`` names, and
    metadata last.  A site is done when it has all of these, so one that a stopped run has left without is made anew; with
    ``resume`` sites that are done are skipped.  A site without a raster, or of whose cells none is left, has failed, and says
    why.  Before the work the run is recorded, with ``settings``.
    """
    spark, run_id = tiles.sparkSession, uuid.uuid4().hex
    every = tiles.select("site_id").distinct()
    needed = ("has_cells", "has_patches", "has_meta") if with_patches else ("has_cells", "has_meta")
    done = done_sites(spark, out).where(" and ".join(needed)).select("site_id")
    done = spark.createDataFrame(done.collect(), done.schema)  # a row a site; said before the store changes
    mine = tiles.join(done, "site_id", "left_anti") if resume else tiles
    told = {"patch": patch, "model": model, "least": least, "resume": resume, "with_patches": with_patches}
    record_run(mine, told | (settings or {}), f"{out}/runs", run_id)
    staging = f"{out}/_staging/{run_id}"
    stage = lambda step, name: staged(step, f"{staging}/{name}")
    grid, info = site_grid(mine, rasters, patch, pixels, least, stage=stage)
    grid = stage(grid, "grid")
    ready = (embed_tokens if with_patches else embed)(cell_pixels(grid), "pixels", make_embedder).drop("pixels")
    if with_patches:
        ready = staged(ready, f"{staging}/embedded")
    ref = patch_ref(F.concat("site_id", F.lit("/patches")), F.col("cell_id")) if with_patches else F.lit(None).cast("string")
    cells = ready.drop("tokens").withColumn("patch_ref", ref)
    write_cells(cells, f"{out}/cells")
    sites = grid.select("site_id").distinct()
    stored = read_cells(spark, f"{out}/cells", cells.schema).join(sites, "site_id", "left_semi")
    counted = stored.groupBy("site_id").agg(F.count("*").alias("stored"), F.max(F.size("cls")).alias("embed_dim"))
    if with_patches:
        patches = patch_rows(ready, "tokens", ["site_id", "cell_id"])
        write_patches(patches, f"{out}/patches")
        shapes = patch_shapes(read_cells(spark, f"{out}/patches", patches.schema).join(sites, "site_id", "left_semi"))
        counted = counted.join(shapes.select("site_id", F.array("rows", "cols").alias("patch_grid")), "site_id", "left")
    else:
        counted = counted.withColumn("patch_grid", F.lit(None).cast("array<int>"))
    counted = staged(counted, f"{staging}/counted")
    write_site_meta(info.join(counted.drop("stored"), "site_id").withColumn("model", F.lit(model)).withColumn("run_id", F.lit(run_id)), f"{out}/meta")
    status = site_status(every, done if resume else None, rasters, counted)
    status = spark.createDataFrame(status.collect(), status.schema)  # a row a site
    remove(spark, staging)
    return status


def site_status(every: DataFrame, done: DataFrame | None, rasters: DataFrame, told: DataFrame) -> DataFrame:
    """(site_id, status, n_cells, problem), one row a site."""
    skipped = (every.limit(0) if done is None else done).withColumn("_done", F.lit(True))
    known = rasters.select("site_id").distinct().withColumn("_raster", F.lit(True))
    joined = every.join(skipped, "site_id", "left").join(known, "site_id", "left").join(told.select("site_id", "stored"), "site_id", "left")
    status = F.when(F.col("_done"), SKIPPED).when(F.col("stored") > 0, OK).otherwise(FAILED)
    why = F.when(F.col("_raster").isNull(), "no raster").otherwise("no cell with data")
    return joined.select("site_id", status.alias("status"), F.col("stored").alias("n_cells"), F.when(status == FAILED, why).alias("problem"))
