"""Box joins, clipping, grids and study areas.

Spark has no spatial predicates, and a plain box condition plans as a nested loop.  Here each box is put in the square
buckets that it touches, so the join is an equi-join on buckets with the exact test on top.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.geo import BOX, clipped, intersects, pixel_box_to_world, snap_to_patch

HULL_BUCKETS = 256


Size = float | str


def _side(size: Size, alias: str = "") -> Column:
    """The buckets' side: a number, or a column's value (of an aliased table)."""
    return F.col(f"{alias}.{size}" if alias else size) if isinstance(size, str) else F.lit(float(size))


def bucketed(boxes: DataFrame, size: Size) -> DataFrame:
    """One row for each bucket of ``size`` that a box touches: adds ``bx`` and ``by``."""
    side = _side(size)
    span = lambda low, high: F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side))
    return boxes.withColumn("bx", F.explode(span("xmin", "xmax"))).withColumn("by", F.explode(span("ymin", "ymax")))


def box_semi_join(left: DataFrame, right: DataFrame, size: Size, on: list[str] | None = None, key: list[str] | None = None) -> DataFrame:
    """Rows of ``left`` whose box touches or overlaps any of ``right`` (with equal ``on`` columns), once each.

    ``size`` is the buckets' side, about the larger side of a usual box: a number, or the name of a column of both tables that
    holds it (one value for equal ``on`` columns).  ``key`` tells rows of ``left`` apart; without it whole rows do, and all
    their columns are shuffled for it.
    """
    on = on or []
    sized = [size] if isinstance(size, str) else []
    a, b = bucketed(left, size).alias("a"), bucketed(right.select(*on, *BOX, *sized), size).alias("b")
    same = (F.col("a.bx") == F.col("b.bx")) & (F.col("a.by") == F.col("b.by"))
    for c in on:
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    # sorted and merged, as Spark takes buckets' rows for as small as the boxes they are made from, and would send them to all tasks
    found = a.join(b.hint("merge"), same & intersects("a", "b"), "left_semi").drop("bx", "by")
    return found.dropDuplicates(key) if key else found.distinct()


def box_join(left: DataFrame, right: DataFrame, size: Size, on: list[str] | None = None) -> DataFrame:
    """Each touching pair once, as aliases ``a`` and ``b`` with bucket columns dropped from neither side's names.

    A pair meets in every bucket both touch and is kept in the lowest of them.
    """
    on = on or []
    a, b = bucketed(left, size).alias("a"), bucketed(right, size).alias("b")
    same = (F.col("a.bx") == F.col("b.bx")) & (F.col("a.by") == F.col("b.by"))
    for c in on:
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    side = _side(size, "a")
    lowest = (F.col("a.bx") == F.floor(F.greatest("a.xmin", "b.xmin") / side)) & (F.col("a.by") == F.floor(F.greatest("a.ymin", "b.ymin") / side))
    return a.join(b, same & intersects("a", "b") & lowest)


def clip_to(tiles: DataFrame, extents: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Tiles cut to their extent's box; those outside are dropped, those that only touch it too.

    ``extents`` has one row for each value of ``on``, or one in all where ``on`` isn't given; more raise.
    """
    on = on or []
    if extents.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("more than one extent")
    other = [c for c in tiles.columns if c not in BOX]
    same = intersects("a", "b")
    for c in on:
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    b = extents.select(*on, *BOX)
    joined = tiles.alias("a").join((b if on else F.broadcast(b)).alias("b"), same)
    cut = joined.select(*[f"a.{c}" for c in other], *[v.alias(k) for k, v in clipped("a", "b").items()])
    return cut.where("xmax > xmin and ymax > ymin")


def total_bounds(boxes: DataFrame, by: list[str] | None = None) -> DataFrame:
    return boxes.groupBy(*(by or [])).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def one_srid(tiles: DataFrame) -> int:
    """The tiles' SRID; a mix raises."""
    found = [r[0] for r in tiles.select("srid").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"tiles have {len(found) or 'no'} SRIDs")
    return found[0]


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise (monotone chain)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def chain(order: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in order:
            while len(out) > 1 and turn(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hull_points(boxes: DataFrame, by: list[str]) -> DataFrame:
    """(by..., strip, x, low, high): for each x of a corner the lowest and highest y, in one of HULL_BUCKETS strips of x.

    Only those can be corners of the hull; a strip is what one task finds a hull of first.
    """
    corners = boxes.select(*by, F.explode(F.array("xmin", "xmax")).alias("x"), "ymin", "ymax")
    exact = corners.groupBy(*by, "x").agg(F.min("ymin").alias("low"), F.max("ymax").alias("high"))
    ends = corners.groupBy(*by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    placed = exact.join(ends, by)
    strip = F.least(F.floor((F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")) * HULL_BUCKETS), F.lit(HULL_BUCKETS - 1))
    return placed.select(*by, F.when(F.col("x1") > F.col("x0"), strip).otherwise(F.lit(0)).cast("int").alias("strip"), "x", "low", "high")


def study_area(boxes: DataFrame, by: list[str]) -> DataFrame:
    """(by..., area_km2, perim_km, fill_ratio): the hull's area and outline and the share of it that boxes cover.

    Coordinates are metres.  Hulls are found in two steps, strips first, so a site's rows never meet in one task whole;
    the union's area is a sweep over x in strips likewise.
    """

    def strip_hull(part: pd.DataFrame) -> pd.DataFrame:
        points = np.concatenate([part[["x", "low"]].to_numpy(), part[["x", "high"]].to_numpy()])
        h = hull(points)
        out = pd.DataFrame({"x": h[:, 0], "y": h[:, 1]})
        for c in by:
            out[c] = part[c].iloc[0]
        return out[[*by, "x", "y"]]

    def whole_hull(part: pd.DataFrame) -> pd.DataFrame:
        h = hull(part[["x", "y"]].to_numpy())
        x, y = h[:, 0], h[:, 1]
        area = abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2
        outline = float(np.hypot(x - np.roll(x, -1), y - np.roll(y, -1)).sum())
        return pd.DataFrame([[*[part[c].iloc[0] for c in by], area, outline]], columns=[*by, "hull_m2", "outline_m"])

    kinds = dict(boxes.dtypes)
    keys = "".join(f"`{c}` {kinds[c]}, " for c in by)
    corners = hull_points(boxes, by).groupBy(*by, "strip").applyInPandas(strip_hull, f"{keys}x double, y double")
    hulls = corners.groupBy(*by).applyInPandas(whole_hull, f"{keys}hull_m2 double, outline_m double")
    return hulls.join(union_area(boxes, by), by).select(
        *by,
        (F.col("hull_m2") / 1e6).alias("area_km2"),
        (F.col("outline_m") / 1e3).alias("perim_km"),
        F.when(F.col("hull_m2") > 0, F.col("union_m2") / F.col("hull_m2")).otherwise(F.lit(0.0)).alias("fill_ratio"),
    )


def union_area(boxes: DataFrame, by: list[str], size: float = 1000.0) -> DataFrame:
    """(by..., union_m2): boxes are cut at square buckets and each bucket's part is summed by coordinate compression."""

    def covered(part: pd.DataFrame) -> pd.DataFrame:
        b = part[["xmin", "ymin", "xmax", "ymax"]].to_numpy()
        xs = np.unique(b[:, [0, 2]])
        total = 0.0
        for x0, x1 in zip(xs, xs[1:], strict=False):
            some = b[(b[:, 0] <= x0) & (b[:, 2] >= x1)]
            some, end, length = some[np.argsort(some[:, 1])], -np.inf, 0.0
            for y0, y1 in some[:, [1, 3]]:
                length += max(0.0, y1 - max(y0, end))
                end = max(end, y1)
            total += length * (x1 - x0)
        return pd.DataFrame([[*[part[c].iloc[0] for c in by], total]], columns=[*by, "m2"])

    kinds = dict(boxes.dtypes)
    keys = "".join(f"`{c}` {kinds[c]}, " for c in by)
    cut = bucketed(boxes.select(*by, *BOX), size).select(
        *by,
        "bx",
        "by",
        F.greatest("xmin", F.col("bx") * size).alias("xmin"),
        F.greatest("ymin", F.col("by") * size).alias("ymin"),
        F.least("xmax", (F.col("bx") + 1) * size).alias("xmax"),
        F.least("ymax", (F.col("by") + 1) * size).alias("ymax"),
    )
    parts = cut.distinct().groupBy(*by, "bx", "by").applyInPandas(covered, f"{keys}m2 double")
    return parts.groupBy(*by).agg(F.sum("m2").alias("union_m2"))


def grid_cells(areas: DataFrame, cell: str, site: str = "site_id") -> DataFrame:
    """All square cells of side ``cell`` over each area's box, from its upper left corner: (site, row, col, box)."""
    side = F.col(cell)
    rows = F.greatest(F.ceil((F.col("ymax") - F.col("ymin")) / side), F.lit(1)).cast("int")
    cols = F.greatest(F.ceil((F.col("xmax") - F.col("xmin")) / side), F.lit(1)).cast("int")
    cells = areas.withColumn("row", F.explode(F.sequence(F.lit(0), rows - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), cols - 1)))
    x, y = F.col("xmin") + F.col("col") * side, F.col("ymax") - F.col("row") * side
    return cells.select(site, "row", "col", x.alias("x0"), (y - side).alias("y0"), (x + side).alias("x1"), y.alias("y1")).select(
        site, "row", "col", F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), F.col("x1").alias("xmax"), F.col("y1").alias("ymax")
    )


def with_cell_ids(cells: DataFrame, site: str = "site_id") -> DataFrame:
    """Adds ``cell_id``: 0, 1, ... within the site in row-major order, rows from the top.

    Cells are numbered within a row of the grid and moved up by the counts of the rows before, so a site of any number of
    cells isn't one task.
    """
    above = W.partitionBy(site).orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    rows = cells.groupBy(site, "row").agg(F.count("*").alias("_n")).select(site, "row", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    within = F.row_number().over(W.partitionBy(site, "row").orderBy("col")) - 1
    return cells.withColumn("_within", within).join(rows, [site, "row"]).withColumn("cell_id", (F.col("_above") + F.col("_within")).cast("bigint")).drop("_within", "_above")


def without_void(cells: DataFrame, samples: DataFrame, key: list[str], least: float = 0.02) -> DataFrame:
    """Cells of whose samples (rows with r, g, b) at least the share ``least`` isn't 0, 0, 0."""
    seen = F.avg(F.when((F.col("r") != 0) | (F.col("g") != 0) | (F.col("b") != 0), 1.0).otherwise(0.0))
    good = samples.groupBy(*key).agg(seen.alias("coverage")).where(F.col("coverage") >= least)
    return cells.join(good.select(*key), key, "left_semi")


def data_runs(blocks: DataFrame, rasters: DataFrame, site: str, max_side: int) -> tuple[DataFrame, DataFrame]:
    """(rasters with ``_scale``, runs): pixels with data, thinned until no side is over ``max_side``, as (site, row, col0, col1)
    runs of thinned pixels."""
    scale = F.greatest(F.floor(F.greatest("width", "height") / max_side), F.lit(1)).cast("int")
    sized = rasters.select(site, "geo_transform", "width", "height", scale.alias("_scale"))
    lit = blocks.where("r != 0 or g != 0 or b != 0").join(F.broadcast(sized.select(site, "_scale")), site)  # a row a raster
    thin = lit.where((F.col("row") % F.col("_scale") == 0) & (F.col("col") % F.col("_scale") == 0))
    thin = thin.select(site, F.floor(F.col("row") / F.col("_scale")).cast("int").alias("row"), F.floor(F.col("col") / F.col("_scale")).cast("int").alias("col"))
    line = W.partitionBy(site, "row").orderBy("col")
    runs = thin.withColumn("run", F.col("col") - F.dense_rank().over(line)).groupBy(site, "row", "run").agg(F.min("col").alias("col0"), F.max("col").alias("col1")).drop("run")
    return sized, runs


def footprint(blocks: DataFrame, rasters: DataFrame, site: str = "site_id", max_side: int = 2000, least_pixels: int = 64) -> DataFrame:
    """Where rasters have data, as boxes: (site, region, xmin, ymin, xmax, ymax), a box a run of pixels in a row.

    ``blocks`` are pixels (site, row, col, r, g, b), ``rasters`` have (site, width, height, geo_transform).  Pixels are thinned
    until no side is over ``max_side``; regions that touch by sides and have fewer thinned pixels than ``least_pixels`` are
    speckle and dropped; a raster without a region left gets its whole extent.  A site's thinned mask is what one task
    holds, ``max_side`` squared at most.
    """
    sized, runs = data_runs(blocks, rasters, site, max_side)
    kind = dict(blocks.dtypes)[site]

    def regions(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["row", "col0"]).reset_index(drop=True)
        part["region"] = joined_runs(part["row"].to_numpy(), part["col0"].to_numpy(), part["col1"].to_numpy())
        size = (part["col1"] - part["col0"] + 1).groupby(part["region"]).transform("sum")
        return part[size >= least_pixels][[site, "region", "row", "col0", "col1"]]

    found = runs.groupBy(site).applyInPandas(regions, f"`{site}` {kind}, region int, row int, col0 int, col1 int")
    each = sized.join(found, site, "left")
    or_whole = lambda extent, found: F.when(F.col("region").isNull(), extent).otherwise(found)
    x, y = F.col("col0") * F.col("_scale"), F.col("row") * F.col("_scale")
    box = pixel_box_to_world(
        F.col("geo_transform"),
        or_whole(F.lit(0), x),
        or_whole(F.lit(0), y),
        or_whole(F.col("width"), F.least((F.col("col1") - F.col("col0") + 1) * F.col("_scale"), F.col("width") - x)),
        or_whole(F.col("height"), F.least(F.col("_scale"), F.col("height") - y)),
    )
    return each.select(site, "region", *[v.alias(k) for k, v in box.items()])


def joined_runs(row: np.ndarray, col0: np.ndarray, col1: np.ndarray) -> np.ndarray:
    """Region numbers of runs sorted by (row, col0): runs of neighbouring rows that share a column are joined."""
    parent = np.arange(len(row))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    starts = {r: i for i, r in reversed(list(enumerate(row.tolist())))}
    above = 0
    for i in range(len(row)):
        if i == 0 or row[i] != row[i - 1]:
            above = starts.get(int(row[i]) - 1, len(row))
        while above < len(row) and row[above] == row[i] - 1 and col1[above] < col0[i]:
            above += 1
        k = above
        while k < len(row) and row[k] == row[i] - 1 and col0[k] <= col1[i]:
            parent[find(i)] = find(k)
            k += 1
    return np.array([find(i) for i in range(len(row))], np.int32)


def clip_to_footprint(tiles: DataFrame, foot: DataFrame, size: Size, key: list[str], site: str = "site_id") -> DataFrame:
    """Tiles cut to the box around what their site's footprint boxes leave of them; those that it leaves nothing are dropped.

    ``key`` tells tiles apart; ``size`` is the side of the join's buckets.
    """
    pairs = box_join(tiles, foot.select(site, *BOX), size, [site])
    cut = pairs.select("a.*", F.struct(*[v.alias(k) for k, v in clipped("a", "b").items()]).alias("_cut")).where("_cut.xmax > _cut.xmin and _cut.ymax > _cut.ymin")
    other = [c for c in tiles.columns if c not in BOX and c not in key]
    low = [F.min(f"_cut.{c}").alias(c) for c in ("xmin", "ymin")] + [F.max(f"_cut.{c}").alias(c) for c in ("xmax", "ymax")]
    return cut.groupBy(*key).agg(*[F.first(c).alias(c) for c in other], *low).select(tiles.columns)


def pixel_areas(areas: DataFrame, rasters: DataFrame, patch: int, site: str = "site_id") -> DataFrame:
    """Each area's box snapped outward to its raster's pixels and to whole patches: (site, geo_transform, col0, row0, w_px, h_px)."""
    joined = areas.join(rasters.select(site, "geo_transform"), site)
    window = snap_to_patch(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), F.col("geo_transform"), F.lit(patch))
    return joined.select(site, "geo_transform", *[v.alias(k) for k, v in window.items()])


def pixel_grid(snapped: DataFrame, patch: int, site: str = "site_id") -> DataFrame:
    """All cells of ``patch`` pixels over snapped areas, none cut: (site, row, col, col_px, row_px, w_px, h_px, box)."""
    last = lambda n: (F.col(n) / patch - 1).cast("int")
    cells = snapped.withColumn("row", F.explode(F.sequence(F.lit(0), last("h_px")))).withColumn("col", F.explode(F.sequence(F.lit(0), last("w_px"))))
    x, y = F.col("col0") + F.col("col") * patch, F.col("row0") + F.col("row") * patch
    box = pixel_box_to_world(F.col("geo_transform"), x, y, F.lit(patch), F.lit(patch))
    return cells.select(site, "row", "col", x.alias("col_px"), y.alias("row_px"), F.lit(patch).alias("w_px"), F.lit(patch).alias("h_px"), *[v.alias(k) for k, v in box.items()])


def window_pixels(windows: DataFrame, blocks: DataFrame, block: int, by: list[str], key: list[str]) -> DataFrame:
    """(key..., row, col, r, g, b): the pixels that raster blocks have in each window, from its corner on.

    ``blocks`` are pixels (by..., row, col, r, g, b), ``windows`` (by..., key..., col_px, row_px, w_px, h_px).  They meet by
    squares of ``block`` pixels.  Pixels outside a raster have no row; they count as 0, 0, 0.
    """
    span = lambda at, n: F.sequence(F.floor(F.col(at) / block), F.floor((F.col(at) + F.col(n) - 1) / block))
    told = list(dict.fromkeys([*by, *key]))
    place = list(dict.fromkeys([*told, "col_px", "row_px", "w_px", "h_px"]))
    w = windows.select(*place, F.explode(span("row_px", "h_px")).alias("_by")).withColumn("_bx", F.explode(span("col_px", "w_px")))
    p = blocks.select(*by, "row", "col", "r", "g", "b", F.floor(F.col("row") / block).alias("_by"), F.floor(F.col("col") / block).alias("_bx"))
    p = p.withColumnsRenamed({"row": "_row", "col": "_col"})
    inside = (F.col("_row") >= F.col("row_px")) & (F.col("_row") < F.col("row_px") + F.col("h_px")) & (F.col("_col") >= F.col("col_px")) & (F.col("_col") < F.col("col_px") + F.col("w_px"))
    return w.join(p, [*by, "_by", "_bx"]).where(inside).select(*[F.col(c).alias(f"cell_{c}" if c in ("row", "col") else c) for c in told], (F.col("_row") - F.col("row_px")).alias("row"), (F.col("_col") - F.col("col_px")).alias("col"), "r", "g", "b")


def window_coverage(windows: DataFrame, blocks: DataFrame, block: int, by: list[str], key: list[str], n: int = 16) -> DataFrame:
    """(key..., coverage): the share of n x n evenly spaced pixels of each window that isn't black; all windows have a row."""
    told = list(dict.fromkeys([*by, *key]))
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    at = lambda corner, side, i: F.col(corner) + F.floor((i + 0.5) * F.col(side) / n)
    points = windows.select(*told, F.explode(F.transform(steps, lambda i: at("row_px", "h_px", i))).alias("_row"), F.transform(steps, lambda i: at("col_px", "w_px", i)).alias("_cols"))
    points = points.select(*told, "_row", F.explode("_cols").alias("_col"))
    seen = blocks.where("r != 0 or g != 0 or b != 0").select(*by, F.col("row").alias("_row"), F.col("col").alias("_col"))
    hit = points.join(seen.distinct().withColumn("_seen", F.lit(1.0)), [*by, "_row", "_col"], "left")
    return hit.groupBy(*told).agg(F.avg(F.coalesce("_seen", F.lit(0.0))).alias("coverage"))


def build_tile_grid(tiles: DataFrame, cell_m: float, site: str = "site_id", samples: DataFrame | None = None, least: float = 0.02) -> DataFrame:
    """The cells over each site's tiles that touch a tile and aren't void, numbered; see the parts above."""
    areas = total_bounds(tiles, [site]).withColumn("_cell", F.lit(float(cell_m)))
    near = box_semi_join(grid_cells(areas, "_cell", site), tiles, cell_m, [site])
    kept = near if samples is None else without_void(near, samples, [site, "row", "col"], least)
    return with_cell_ids(kept, site)


def grid_counters(full: DataFrame, near: DataFrame, kept: DataFrame, site: str = "site_id") -> DataFrame:
    """n_cells_full, after_tile_filter, n_cells and dropped_void by site."""
    count = lambda df, name: df.groupBy(site).agg(F.count("*").alias(name))
    out = count(full, "n_cells_full").join(count(near, "after_tile_filter"), site, "left").join(count(kept, "n_cells"), site, "left")
    return out.fillna(0).withColumn("dropped_void", F.col("after_tile_filter") - F.col("n_cells"))


def grid_info(cells: DataFrame, counters: DataFrame, rasters: DataFrame, patch: int, site: str = "site_id") -> DataFrame:
    """What a run tells of its grid by site: resolution, patch and cell sizes (rounded half to even) and the counters."""
    res = F.abs(F.col("geo_transform")[0])
    side = F.bround((F.col("xmax") - F.col("xmin")) / F.col("_res")).cast("int")
    sized = rasters.select(site, res.alias("_res"))
    sizes = cells.join(sized, site).groupBy(site).agg(F.sort_array(F.collect_set(side)).alias("cell_sizes_px"))  # a few sizes a site
    told = sized.select(site, F.bround("_res", 4).alias("native_res_m"), F.lit(patch).alias("patch_px"), F.bround(F.col("_res") * patch, 1).alias("cell_ground_m"))
    return told.join(counters, site).join(sizes, site, "left")
