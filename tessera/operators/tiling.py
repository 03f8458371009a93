"""Overlapping windows, blending, stitching and padding of rasters kept as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def window_starts(extent: Column, tile: int, stride: int, cell: int) -> Column:
    """Starts of windows over 0..extent: every ``stride``, the last moved back to end at the edge, all cut to ``cell``.

    Cutting may leave a strip of under a cell at the end uncovered.  Raises where ``stride`` isn't positive.
    """
    if stride <= 0:
        raise ValueError("the overlap takes up the whole tile")
    last = F.greatest(extent - tile, F.lit(0))
    regular = F.sequence(F.lit(0), last.cast("int"), F.lit(stride))
    return F.array_sort(F.array_distinct(F.transform(F.array_append(regular, last.cast("int")), lambda s: (F.floor(s / cell) * cell).cast("int"))))


def overlap_windows(blobs: DataFrame, tile: int, overlap: int, cell: int = 8, cover_all: bool = False) -> DataFrame:
    """One row a window of each blob (uuid, width, height): col_px, row_px, w_px, h_px.

    With ``cover_all`` a last window, not cut to the cell, covers the strip at the end.
    """
    stride = tile - overlap

    def starts(extent: str) -> Column:
        found = window_starts(F.col(extent), tile, stride, cell)
        if cover_all:
            found = F.array_distinct(F.array_append(found, F.greatest(F.col(extent) - tile, F.lit(0)).cast("int")))
        return found

    rows = blobs.withColumn("col_px", F.explode(starts("width"))).withColumn("row_px", F.explode(starts("height")))
    return rows.withColumn("w_px", F.least(F.lit(tile), F.col("width") - F.col("col_px"))).withColumn("h_px", F.least(F.lit(tile), F.col("height") - F.col("row_px")))


def overlap_coverage(windows: DataFrame, step: int, key: str = "uuid") -> DataFrame:
    """How many windows cover each block of ``step`` pixels: (key, brow, bcol, n).

    A sweep along each row of blocks: a window adds one where it begins and takes it away after its end, equal places are added
    up before they are shuffled, and only the stretches between places are spread out to blocks.
    """
    first, last = lambda at: F.floor(F.col(at) / step), lambda at, n: F.floor((F.col(at) + F.col(n) - 1) / step)
    ends = F.array(F.struct(first("col_px").alias("bcol"), F.lit(1).alias("d")), F.struct((last("col_px", "w_px") + 1).alias("bcol"), F.lit(-1).alias("d")))
    rows = windows.where("w_px > 0 and h_px > 0").select(key, F.explode(F.sequence(first("row_px"), last("row_px", "h_px"))).alias("brow"), ends.alias("e"))
    places = rows.select(key, "brow", F.explode("e").alias("e")).groupBy(key, "brow", "e.bcol").agg(F.sum("e.d").alias("d"))
    line = W.partitionBy(key, "brow").orderBy("bcol")
    runs = places.withColumn("n", F.sum("d").over(line.rowsBetween(W.unboundedPreceding, 0))).withColumn("next", F.lead("bcol").over(line))
    return runs.where("n > 0").select(key, "brow", F.explode(F.sequence("bcol", F.col("next") - 1)).alias("bcol"), "n")


def mean_blend(values: DataFrame, place: list[str], value: str = "value") -> DataFrame:
    """The mean of all that overlaps at a place; sums are added up where the rows are."""
    return values.groupBy(*place).agg(F.avg(F.col(value).cast("double")).alias(value), F.count("*").alias("n"))


def dense(sparse: DataFrame, extents: DataFrame, key: str, value: str = "value") -> DataFrame:
    """All places of each extent (key, rows, cols); 0 where ``sparse`` has none."""
    grid = extents.select(key, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "cols")
    grid = grid.select(key, "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    return grid.join(sparse, [key, "row", "col"], "left").fillna(0, [value])


def first_writer(values: DataFrame, place: list[str], order: list[str]) -> DataFrame:
    """At each place the row that comes first by ``order`` (which must tell rows apart)."""
    rest = [c for c in values.columns if c not in place]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return values.groupBy(*place).agg(best.alias("_v")).select(*place, "_v.*")


def last_writer(values: DataFrame, place: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in values.columns if c not in place]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return values.groupBy(*place).agg(best.alias("_v")).select(*place, "_v.*")


def trimmed(windows: DataFrame, overlap: int, width: str = "width", height: str = "height") -> DataFrame:
    """Windows without half the overlap at the seams inside: adds c0, r0, c1, r1."""
    half = overlap // 2
    c0 = F.when(F.col("col_px") > 0, F.col("col_px") + half).otherwise(F.col("col_px"))
    r0 = F.when(F.col("row_px") > 0, F.col("row_px") + half).otherwise(F.col("row_px"))
    right, low = F.col("col_px") + F.col("w_px"), F.col("row_px") + F.col("h_px")
    return (
        windows.withColumn("c0", c0)
        .withColumn("r0", r0)
        .withColumn("c1", F.when(right < F.col(width), right - half).otherwise(right))
        .withColumn("r1", F.when(low < F.col(height), low - half).otherwise(low))
    )


def stitched(values: DataFrame, windows: DataFrame, overlap: int, key: str, place: tuple[str, str] = ("row", "col")) -> DataFrame:
    """(key, row, col, value): of windows' values (key, row_px, col_px, row, col, value), places from the blob's corner, those
    inside their window's trimmed part, and where several are left that of the first window from the top left."""
    row, col = place
    cut = trimmed(windows, overlap).select(key, "row_px", "col_px", "r0", "c0", "r1", "c1")
    inside = (F.col(row) >= F.col("r0")) & (F.col(row) < F.col("r1")) & (F.col(col) >= F.col("c0")) & (F.col(col) < F.col("c1"))
    kept = values.join(cut.hint("shuffle_hash"), [key, "row_px", "col_px"]).where(inside)  # windows are too many to send to all tasks
    order = F.col("row_px").cast("long") * (1 << 32) + F.col("col_px")  # one number, which groups are hashed with; a struct is sorted by
    return kept.groupBy(key, row, col).agg(F.min_by("value", order).alias("value"))


def padded_size(height: Column, width: Column, multiple: int, square: bool = False) -> tuple[Column, Column]:
    """Sizes brought up to the next multiple; ``square``: both from the larger."""
    up = lambda n: (F.ceil(n / multiple) * multiple).cast("int")
    both = F.greatest(height, width)
    return (up(both), up(both)) if square else (up(height), up(width))


def pad_by_edge(pixels: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Pixels (key, row, col, value...) over the larger canvas of ``sizes`` (key, h, w, new_h, new_w), the edge repeated.

    Each pixel is joined with its canvas and spread over the places that it fills.  Pixels are never sent to all tasks: Spark
    takes what explodes make for as small as the rows they are made from.
    """
    names = {"h": "_h", "w": "_w", "new_h": "_new_h", "new_w": "_new_w"}
    each = pixels.join(sizes.select(key, *[F.col(c).alias(n) for c, n in names.items()]).hint("shuffle_hash"), key)
    each = each.where("row between 0 and least(_h, _new_h) - 1 and col between 0 and least(_w, _new_w) - 1")
    fills = lambda at, n: F.sequence(F.col(at).cast("int"), F.when(F.col(at) == F.col(f"_{n}") - 1, F.col(f"_new_{n}") - 1).otherwise(F.col(at)).cast("int"))
    other = [c for c in pixels.columns if c not in (key, "row", "col")]
    rows = each.select(key, F.explode(fills("row", "h")).alias("row"), fills("col", "w").alias("_cols"), *other)
    return rows.select(key, "row", F.explode("_cols").alias("col"), *other)


def canvas(tiles: DataFrame, key: str) -> DataFrame:
    """Pixels of tiles (key, x, y, seq, row, col, value) on their canvas; of several at a place the last by ``seq``."""
    placed = tiles.select(key, (F.col("y") + F.col("row")).alias("row"), (F.col("x") + F.col("col")).alias("col"), "seq", "value")
    return last_writer(placed, [key, "row", "col"], ["seq"])


def blob_extents(cells: DataFrame, key: list[str]) -> DataFrame:
    return cells.groupBy(*key).agg(F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height"), F.count("*").alias("n_tiles"))


def super_blocks(cells: DataFrame, key: list[str]) -> DataFrame:
    """2x2 blocks of tiles: (key..., blocks, leftover)."""
    n = cells.groupBy(*key).agg(F.countDistinct("x").alias("nc"), F.countDistinct("y").alias("nr"))
    blocks = F.floor(F.col("nr") / 2) * F.floor(F.col("nc") / 2)
    return n.select(*key, blocks.cast("bigint").alias("blocks"), ((F.col("nr") % 2 != 0) | (F.col("nc") % 2 != 0)).alias("leftover"))


def nodata_boxes(pixels: DataFrame, key: list[str], most: float = 0.98) -> DataFrame:
    """Boxes of whose pixels under the share ``most`` is black: the ones worth embedding."""
    black = F.avg(F.when((F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0), 1.0).otherwise(0.0))
    return pixels.groupBy(*key).agg(black.alias("black")).where(F.col("black") < most)


def chunks(blobs: DataFrame, size: int) -> DataFrame:
    """Squares of ``size`` pixels over each blob (width, height), those at the edge cut to it."""
    last = lambda n: F.greatest(F.ceil(F.col(n) / size) - 1, F.lit(0)).cast("int")
    rows = blobs.withColumn("crow", F.explode(F.sequence(F.lit(0), last("height")))).withColumn("ccol", F.explode(F.sequence(F.lit(0), last("width"))))
    rows = rows.withColumn("col_px", F.col("ccol") * size).withColumn("row_px", F.col("crow") * size)
    return rows.withColumn("w_px", F.least(F.lit(size), F.col("width") - F.col("col_px"))).withColumn("h_px", F.least(F.lit(size), F.col("height") - F.col("row_px")))


def chunk_boxes(cells: DataFrame, granularity: str | int, by: list[str] | None = None) -> DataFrame:
    """(by..., uuid, chunk_id, col_px, row_px, w_px, h_px) of blobs given by their tiles (by..., uuid, x, y, w, h).

    ``granularity`` is ``blob`` (one box a blob), ``tile`` (one a tile) or a number of pixels (squares, cut at the edge).
    """
    key = [*(by or []), "uuid"]
    if granularity == "tile":
        found = cells.select(*key, F.col("x").alias("col_px"), F.col("y").alias("row_px"), F.col("w").alias("w_px"), F.col("h").alias("h_px"))
    elif granularity == "blob":
        found = blob_extents(cells, key).select(*key, F.lit(0).alias("col_px"), F.lit(0).alias("row_px"), F.col("width").alias("w_px"), F.col("height").alias("h_px"))
    else:
        found = chunks(blob_extents(cells, key), int(granularity)).select(*key, "col_px", "row_px", "w_px", "h_px")
    return numbered(found, key, ["row_px", "col_px"]).select(*key, "chunk_id", "col_px", "row_px", "w_px", "h_px")


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "chunk_id") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
