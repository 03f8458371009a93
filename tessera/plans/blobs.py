"""Blob runs: mosaics of tiles, windows over them, patch vectors blended where windows overlap, and what is told of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators.embedding import Embedder, embed_boxes
from tessera.operators.spatial import window_pixels
from tessera.operators.tiling import blob_extents, canvas, nodata_boxes, overlap_windows
from tessera.session import work_path
from tessera.sources.store import flattened, staged


def discovered(files: DataFrame) -> DataFrame:
    """(site, uuid, x, y, path, geo_transform) of tile files (site, path, geo_transform), grouped into blobs by their names.

    Other names are skipped; of files at one place the last path counts; a blob's geotransform is that of its first path.
    """
    name = F.substring_index("path", "/", -1)
    parsed = files.withColumn("uuid", names.tile_key(name)).withColumn("x", names.tile_col(name)).withColumn("y", names.tile_row(name)).where("uuid is not null")
    last = parsed.groupBy("site", "uuid", "x", "y").agg(F.max("path").alias("path"))
    first = parsed.groupBy("site", "uuid").agg(F.min_by("geo_transform", "path").alias("geo_transform"))
    return last.join(first, ["site", "uuid"])


def prepared(pixels: DataFrame, cells: DataFrame, tile: int = 512, overlap: int = 128, cell: int = 8) -> tuple[DataFrame, DataFrame]:
    """(mosaic pixels, windows) of blobs: ``pixels`` of tiles (uuid, x, y, seq, row, col, r, g, b), ``cells`` (uuid, x, y, w, h)."""
    value = F.struct("r", "g", "b").alias("value")
    mosaic = canvas(pixels.select("uuid", "x", "y", "seq", "row", "col", value), "uuid").select("uuid", "row", "col", "value.*")
    return mosaic, overlap_windows(blob_extents(cells, ["uuid"]), tile, overlap, cell)


def run_blobs(pixels: DataFrame, cells: DataFrame, make_embedder: Callable[[], Embedder], tile: int = 512, overlap: int = 128, cell: int = 8, most_black: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """(patches, metadata): blended patch vectors of all blobs and one row of metadata a blob.

    Windows that are black are not embedded.  A window's pixels are one row of ``tile`` x ``tile`` at most: their places and
    values as lists, which the embedding task lays out, so the work goes with the pixels.
    """
    mosaic, windows = prepared(pixels, cells, tile, overlap, cell)
    place = ["uuid", "row_px", "col_px"]
    seen = window_pixels(windows, mosaic, tile, ["uuid"], ["row_px", "col_px"])
    lit = nodata_boxes(seen, place, most_black).select(*place)
    kept = windows.join(lit, place, "left_semi")
    at = F.col("row").cast("int") * F.col("w_px") + F.col("col").cast("int")
    value = lambda c: F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")).alias(c)
    rows = seen.join(kept, place).select(*place, "w_px", "h_px", at.alias("at"), *map(value, "rgb"))
    packed = rows.groupBy(*place, "w_px", "h_px").agg(*[F.collect_list(c).alias(c) for c in ("at", *"rgb")])  # a window's pixels
    patches = staged(embed_boxes(packed, make_embedder, cell), work_path(pixels.sparkSession, "patches"))  # embedded once
    return patches, blob_metadata(cells, windows, patches, kept)


def blob_metadata(cells: DataFrame, windows: DataFrame, patches: DataFrame, embedded: DataFrame) -> DataFrame:
    """(uuid, size, patch_grid, boxes): nested, one row a blob; ``patch_grid`` is null where nothing was embedded."""
    extents = blob_extents(cells, ["uuid"])
    grid = patches.groupBy("uuid").agg((F.max("prow") + 1).alias("rows"), (F.max("pcol") + 1).alias("cols"), F.count("*").alias("patches"), F.max(F.size("vec")).alias("dim"))
    count = lambda df, name: df.groupBy("uuid").agg(F.count("*").alias(name))
    joined = extents.join(grid, "uuid", "left").join(count(windows, "planned"), "uuid", "left").join(count(embedded, "embedded"), "uuid", "left")
    return joined.select(
        "uuid",
        F.struct("width", "height", "n_tiles").alias("size"),
        F.when(F.col("rows").isNotNull(), F.struct("rows", "cols", "patches", "dim")).alias("patch_grid"),
        F.struct(F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("embedded", F.lit(0)).alias("embedded")).alias("boxes"),
    )


def totals(metadata: DataFrame) -> DataFrame:
    """Sums over all blobs: n_blobs, n_patches, n_boxes, n_embedded (blobs with a patch)."""
    flat = flattened(metadata)
    return flat.agg(
        F.count("*").alias("n_blobs"),
        F.coalesce(F.sum("`patch_grid.patches`"), F.lit(0)).alias("n_patches"),
        F.coalesce(F.sum("`boxes.embedded`"), F.lit(0)).alias("n_boxes"),
        F.count_if(F.col("`patch_grid.patches`") > 0).alias("n_embedded"),
    )


def site_canvas(values: DataFrame, origin: DataFrame, cell_m: float, site: str = "site_id", order: str = "cell_id") -> DataFrame:
    """(site, row, col, value): cells (site, box, value) painted on their site's canvas, from ``origin`` (site, xmin, ymax), by
    rounding half to even; of several at a place the last by ``order``."""
    o = origin.select(site, F.col("xmin").alias("_x"), F.col("ymax").alias("_y"))
    row, col = F.bround((F.col("_y") - F.col("ymax")) / cell_m).cast("int"), F.bround((F.col("xmin") - F.col("_x")) / cell_m).cast("int")
    placed = values.join(o, site).select(site, row.alias("row"), col.alias("col"), F.struct(order, "value").alias("v"))
    return placed.groupBy(site, "row", "col").agg(F.max_by("v.value", F.struct(f"v.{order}", "v.value")).alias("value"))
