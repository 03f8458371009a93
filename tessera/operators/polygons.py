"""Polygons of raster footprints: traced from masks, simplified, cut into trapezoids and joined with boxes.

A polygon is a row with ``rings``, closed lines of corners by the even-odd rule (so holes are rings like others).  What joins
look at are its trapezoids: pieces between two of its edges and two heights.  A trapezoid is a small row that is bucketed like
a box, and what it shares with a box is found exactly by column expressions, so a polygon of any size never meets all boxes in
one task, and areas and bounds are sums, least and largest values over pieces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geo import BOX
from tessera.operators.spatial import Size, box_join, data_runs, joined_runs

RINGS = "array<struct<xs: array<double>, ys: array<double>>>"
EDGES = ("y0", "y1", "xl0", "xl1", "xr0", "xr1")
Ring = tuple[np.ndarray, np.ndarray]


# --- rings of a mask -----------------------------------------------------------------------------


def straight_edges(mask: np.ndarray) -> np.ndarray:
    """(x0, y0, x1, y1) of the outline's longest straight edges, each with the mask on its right (y goes down)."""
    m = np.pad(mask.astype(bool), 1)
    out = []
    for inside, turned in ((m, False), (m.T, True)):
        for step in (1, -1):  # the side towards lower and towards higher rows
            edge = inside & ~np.roll(inside, step, axis=0)
            flat = np.diff(np.pad(edge, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, start = np.nonzero(flat == 1)
            _, end = np.nonzero(flat == -1)
            line = row + (step == -1)
            a, b = (start, end) if (step == 1) != turned else (end, start)
            out.append(np.column_stack([line, a, line, b] if turned else [a, line, b, line]))
    return np.concatenate(out) - 1


def rings_of(mask: np.ndarray) -> list[Ring]:
    """The closed outlines of a mask's regions and holes, in corners of pixels.

    Where two pixels touch by a corner only, the outline turns right, so that regions are what is joined by sides.
    """
    if mask.size and mask.all():  # a block, the outline of most small regions
        h, w = mask.shape
        return [(np.array([0, w, w, 0], float), np.array([0, 0, h, h], float))]
    edges = straight_edges(mask).tolist()
    leaving: dict[tuple, list[tuple]] = {}
    for x0, y0, x1, y1 in edges:
        leaving.setdefault((x0, y0), []).append((x1, y1))
    rings = []
    while leaving:
        start = at = next(iter(leaving))
        before, xs, ys = None, [], []
        while True:
            ways = leaving[at]
            k = 0
            if len(ways) == 2 and before is not None:
                dx, dy = at[0] - before[0], at[1] - before[1]
                k = next(i for i, w in enumerate(ways) if dx * (w[1] - at[1]) - dy * (w[0] - at[0]) > 0)
            there = ways.pop(k)
            if not ways:
                del leaving[at]
            xs.append(at[0])
            ys.append(at[1])
            before, at = at, there
            if at == start and (at not in leaving or _turns_into(before, at, xs, ys)):
                break
        rings.append((np.array(xs, float), np.array(ys, float)))
    return rings


def _turns_into(before: tuple, at: tuple, xs: list, ys: list) -> bool:
    """Whether the ring's first edge is the right turn from the edge ``before`` to ``at``."""
    dx, dy = at[0] - before[0], at[1] - before[1]
    return dx * (ys[1] - at[1]) - dy * (xs[1] - at[0]) > 0


def simplified(ring: Ring, tolerance: float) -> Ring:
    """The ring with the corners only that it needs to stay within ``tolerance`` of all others (the farthest corner is kept,
    again and again); as it is where nothing with an area would be left."""
    x, y = ring
    n = len(x)
    if n < 5 or tolerance <= 0:
        return ring
    far = int(((x - x[0]) ** 2 + (y - y[0]) ** 2).argmax())
    px, py = np.r_[x, x[0]], np.r_[y, y[0]]
    keep, todo = {0, far}, [(0, far), (far, n)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = px[b] - px[a], py[b] - py[a]
        qx, qy = px[a + 1 : b] - px[a], py[a + 1 : b] - py[a]
        t = np.clip((qx * dx + qy * dy) / max(dx * dx + dy * dy, 1e-300), 0, 1)
        d = (qx - t * dx) ** 2 + (qy - t * dy) ** 2
        k = int(d.argmax())
        if d[k] > tolerance * tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    at = sorted(keep)
    return (x[at], y[at]) if len(at) > 2 and abs(_area(x[at], y[at])) > 0 else ring


def _area(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def simplified_together(rings: list[Ring], tolerance: float) -> list[Ring]:
    """All rings of a region simplified, with half the tolerance again and again while any of their edges cross."""
    while tolerance > 1e-3:
        found = [simplified(r, tolerance) for r in rings]
        if all(a is b for a, b in zip(found, rings, strict=True)) or trapezoids_of(found) is not None:
            return found
        tolerance /= 2
    return rings


# --- trapezoids ----------------------------------------------------------------------------------


def trapezoids_of(rings: list[Ring]) -> np.ndarray | None:
    """(y0, y1, xl0, xl1, xr0, xr1) rows: the area of the rings by the even-odd rule; None where edges cross.

    A sweep over the corners' heights; a piece goes on as long as the same two edges bound it.
    """
    ends = [np.column_stack([x, y, np.roll(x, -1), np.roll(y, -1)]) for x, y in rings if len(x) > 2]
    if not ends:
        return np.zeros((0, 6))
    e = np.concatenate(ends)
    e = np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)
    e = e[e[:, 1] < e[:, 3]]
    heights = np.unique(e[:, [1, 3]])
    first, last = np.searchsorted(heights, e[:, 1]), np.searchsorted(heights, e[:, 3])
    starts = np.split(np.argsort(first, kind="stable"), np.cumsum(np.bincount(first, minlength=len(heights)))[:-1])
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    at = lambda k, y: np.where(y >= e[k, 3], e[k, 2], e[k, 0] + slope[k] * (y - e[k, 1]))
    near = 1e-9 * max(1.0, float(np.abs(e[:, [0, 2]]).max(initial=0)))
    active, open_, out = np.zeros(0, int), {}, []

    def closed(pair: tuple[int, int], y0: float, y1: float) -> None:
        k = np.array(pair)
        (a, b), (c, d) = at(k, y0), at(k, y1)
        out.append((y0, y1, a, c, b, d))

    for i in range(len(heights) - 1):
        y0, y1 = heights[i], heights[i + 1]
        active = np.concatenate([active[last[active] > i], starts[i]])
        low, high = at(active, y0), at(active, y1)
        order = np.lexsort((high + low,))
        if (np.diff(low[order]) < -near).any() or (np.diff(high[order]) < -near).any():
            return None
        k = active[order]
        pairs = set(zip(k[::2].tolist(), k[1::2].tolist(), strict=True))
        for p in [p for p in open_ if p not in pairs]:
            closed(p, open_.pop(p), y0)
        for p in pairs:
            open_.setdefault(p, y0)
    for p, y0 in open_.items():
        closed(p, y0, heights[-1])
    found = np.array(out).reshape(-1, 6)
    return found[(found[:, 4] > found[:, 2]) | (found[:, 5] > found[:, 3])]


def trapezoids(polygons: DataFrame, by: list[str], rings: str = "rings") -> DataFrame:
    """(by..., y0, y1, xl0, xl1, xr0, xr1, box) rows of polygons; raises where a polygon's edges cross."""
    kinds = dict(polygons.dtypes)

    def cut(batches):
        for b in batches:
            parts = []
            for r in b.to_dict("records"):
                found = trapezoids_of([(np.asarray(x["xs"], float), np.asarray(x["ys"], float)) for x in r[rings]])
                if found is None:
                    raise ValueError(f"edges of a polygon cross: {[r[c] for c in by]}")
                parts.append(found)
            whole = pd.DataFrame(np.concatenate([np.zeros((0, len(EDGES))), *parts]), columns=EDGES)
            told = b[by].iloc[np.repeat(np.arange(len(b)), [len(p) for p in parts])].reset_index(drop=True)
            yield pd.concat([told, whole], axis=1)

    rows = polygons.select(*by, rings).mapInPandas(cut, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], *[f"{c} double" for c in EDGES]]))
    return with_boxes(rows)


def areas(pieces: DataFrame, by: list[str]) -> DataFrame:
    """(by..., area) of polygons from their trapezoids."""
    one = (F.col("xr0") - F.col("xl0") + F.col("xr1") - F.col("xl1")) / 2 * (F.col("y1") - F.col("y0"))
    return pieces.groupBy(*by).agg(F.sum(one).alias("area"))


# --- footprints ----------------------------------------------------------------------------------


def footprint_polygons(blocks: DataFrame, rasters: DataFrame, site: str = "site_id", max_side: int = 2000, least_pixels: int = 64, tolerance: float = 1.0) -> DataFrame:
    """(site, region, rings): where rasters have data, a polygon a region, simplified to ``tolerance`` thinned pixels.

    Thinning, speckle and rasters without a region are as in :func:`tessera.operators.spatial.footprint`.  Runs of a site's
    thinned mask, ``max_side`` squared at most, are numbered by region in one task; regions are then dealt out and each is traced
    by itself.
    """
    sized, runs = data_runs(blocks, rasters, site, max_side)
    kind = dict(blocks.dtypes)[site]
    none = F.lit(None).cast("int")

    def numbered(part: pd.DataFrame) -> pd.DataFrame:
        name = part[site].iloc[0]
        part = part[part["row"].notna()].astype({"row": int, "col0": int, "col1": int}).sort_values(["row", "col0"]).reset_index(drop=True)
        part["region"] = joined_runs(part["row"].to_numpy(), part["col0"].to_numpy(), part["col1"].to_numpy())
        size = (part["col1"] - part["col0"] + 1).groupby(part["region"]).transform("sum")
        kept = part[size >= least_pixels][[site, "region", "row", "col0", "col1"]]
        return kept if len(kept) else pd.DataFrame([[name, *[None] * 4]], columns=kept.columns)

    def traced(batches):
        for b in batches:
            out = []
            for found in b["runs"]:
                if not len(found):
                    out.append(None)
                    continue
                row, col0, col1 = (np.array([r[c] for r in found]) for c in ("row", "col0", "col1"))
                top, left = row.min(), col0.min()
                mask = np.zeros((row.max() - top + 1, col1.max() - left + 1), bool)
                for r, first, last in zip(row - top, col0 - left, col1 - left, strict=True):
                    mask[r, first : last + 1] = True
                rings = simplified_together(rings_of(mask), tolerance)
                out.append([{"xs": (x + left).tolist(), "ys": (y + top).tolist()} for x, y in rings])
            yield b[[site, "region"]].assign(rings=out)

    # each raster has a row without a run, so that one without a region is told too
    every = runs.select(site, "row", "col0", "col1").unionByName(sized.select(site, none.alias("row"), none.alias("col0"), none.alias("col1")))
    labelled = every.groupBy(site).applyInPandas(numbered, f"`{site}` {kind}, region int, row int, col0 int, col1 int")
    spark = blocks.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # kept: bytes don't tell what tracing takes
    one = F.when(F.col("row").isNotNull(), F.struct("row", "col0", "col1"))
    regions = labelled.repartition(tasks, site, "region").groupBy(site, "region").agg(F.collect_list(one).alias("runs"))
    polygons = regions.mapInPandas(traced, f"`{site}` {kind}, region int, rings {RINGS}").withColumnRenamed(site, "_site")
    found = polygons.join(F.broadcast(sized), F.col("_site").eqNullSafe(F.col(site))).drop("_site")  # a row a raster
    w, h, s, gt = F.col("width").cast("double"), F.col("height").cast("double"), F.col("_scale").cast("double"), F.col("geo_transform")
    zero = F.lit(0.0)
    whole = F.array(F.struct(F.array(zero, w, w, zero).alias("xs"), F.array(zero, zero, h, h).alias("ys")))
    # the last thinned pixels of a side may stand for less than a whole one
    inside = F.transform("rings", lambda r: F.struct(F.transform(r["xs"], lambda x: F.least(x * s, w)).alias("xs"), F.transform(r["ys"], lambda y: F.least(y * s, h)).alias("ys")))
    pixels = F.when(F.col("region").isNull(), whole).otherwise(inside)
    world = lambda a, b, c: lambda r: F.zip_with(r["xs"], r["ys"], lambda x, y: a * x + b * y + c)
    xs, ys = world(gt[0], gt[1], gt[2]), world(gt[3], gt[4], gt[5])
    return found.select(site, "region", F.transform(pixels, lambda r: F.struct(xs(r).alias("xs"), ys(r).alias("ys"))).alias("rings"))


# --- boxes and polygons --------------------------------------------------------------------------


def _cuts(box: str, piece: str) -> Column:
    """(y, l, r) at the heights where an edge of a trapezoid meets a side of a box (two aliased tables) and at the ends of what
    both reach: the left and right end of what they share there, r under l where that is nothing.  Between the heights both ends
    change evenly.  Null where the heights of the two don't meet."""
    c = lambda t, n: F.col(f"{t}.{n}")
    y0, y1, low, high = c(piece, "y0"), c(piece, "y1"), F.greatest(c(box, "ymin"), c(piece, "y0")), F.least(c(box, "ymax"), c(piece, "y1"))

    def met(side: str, edge: str) -> Column:
        a, b, v = c(piece, f"{edge}0"), c(piece, f"{edge}1"), c(box, side)
        return F.when(a == b, low).otherwise(F.least(F.greatest(y0 + (v - a) / (b - a) * (y1 - y0), low), high))

    heights = F.array_sort(F.array_distinct(F.array(low, high, *[met(s, e) for s in ("xmin", "xmax") for e in ("xl", "xr")])))
    on = lambda edge, y: c(piece, f"{edge}0") + (c(piece, f"{edge}1") - c(piece, f"{edge}0")) * ((y - y0) / (y1 - y0))
    left, right = lambda y: F.greatest(on("xl", y), c(box, "xmin")), lambda y: F.least(on("xr", y), c(box, "xmax"))
    return F.when(low <= high, F.transform(heights, lambda y: F.struct(y.alias("y"), left(y).alias("l"), right(y).alias("r"))))


def touching(box: str, piece: str) -> Column:
    """Whether a box and a trapezoid of two aliased tables share a point at least."""
    return F.coalesce(F.exists(_cuts(box, piece), lambda p: p["r"] >= p["l"]), F.lit(False))


def shared_slices(box: str, piece: str) -> Column:
    """What a box and a trapezoid of two aliased tables share, as trapezoids again (see ``EDGES``) with their areas."""
    cuts = _cuts(box, piece)
    pairs = F.arrays_zip(F.slice(cuts, F.lit(1), F.size(cuts) - 1).alias("a"), F.slice(cuts, F.lit(2), F.size(cuts) - 1).alias("b"))
    end = lambda p: F.greatest(p["r"], p["l"])
    parts = F.transform(
        pairs,
        lambda s: F.struct(
            ((end(s["a"]) - s["a"]["l"] + end(s["b"]) - s["b"]["l"]) / 2 * (s["b"]["y"] - s["a"]["y"])).alias("area"),
            *[v.alias(n) for n, v in zip(EDGES, (s["a"]["y"], s["b"]["y"], s["a"]["l"], s["b"]["l"], end(s["a"]), end(s["b"])), strict=True)],
        ),
    )
    least = 1e-12 * (F.col(f"{box}.xmax") - F.col(f"{box}.xmin")) * (F.col(f"{box}.ymax") - F.col(f"{box}.ymin"))  # what rounding may leave of a touch
    return F.filter(F.when(F.size(cuts) > 1, parts), lambda p: p["area"] > least)


def with_boxes(pieces: DataFrame) -> DataFrame:
    """Trapezoids with the bounds that joins look at."""
    return pieces.withColumns({"xmin": F.least("xl0", "xl1"), "ymin": F.col("y0"), "xmax": F.greatest("xr0", "xr1"), "ymax": F.col("y1")})


def _sized(pieces: DataFrame, size: Size, on: list[str]) -> DataFrame:
    return pieces.select(*on, *EDGES, *BOX, *([size] if isinstance(size, str) else []))


def cut_pieces(tiles: DataFrame, pieces: DataFrame, size: Size, on: list[str]) -> DataFrame:
    """What polygons (equal ``on`` columns), given as trapezoids, leave of tiles: the tiles' columns, with a trapezoid a row (see
    ``EDGES``), its box and its area.  Tiles that share no area with a polygon, also where only its box touches them, have none."""
    joined = box_join(tiles, _sized(pieces, size, on), size, on)
    other = [c for c in tiles.columns if c not in BOX]
    each = joined.select(*[f"a.{c}" for c in other], F.explode(shared_slices("a", "b")).alias("_cut"))
    return with_boxes(each.select(*other, *[F.col(f"_cut.{c}").alias(c) for c in (*EDGES, "area")]))


def clip_to_polygons(tiles: DataFrame, pieces: DataFrame, size: Size, key: list[str], on: list[str]) -> DataFrame:
    """Tiles cut to their polygons: each with the bounds and the ``area`` of what :func:`cut_pieces` leaves.

    ``key`` tells tiles apart; ``size`` is the side of the join's buckets.
    """
    cut = cut_pieces(tiles, pieces, size, on)
    other = [c for c in tiles.columns if c not in BOX and c not in key]
    bounds = [F.min(c).alias(c) for c in BOX[:2]] + [F.max(c).alias(c) for c in BOX[2:]]
    found = cut.groupBy(*key).agg(*[F.first(c).alias(c) for c in other], *bounds, F.sum("area").alias("area"))
    return found.select(*tiles.columns, "area")


def polygon_semi_join(boxes: DataFrame, pieces: DataFrame, size: Size, key: list[str], on: list[str], touch: bool = False) -> DataFrame:
    """Boxes that share area with a polygon (equal ``on`` columns), or with ``touch`` a point at least, once each; ``key`` tells
    boxes apart."""
    joined = box_join(boxes, _sized(pieces, size, on), size, on)
    met = touching("a", "b") if touch else F.coalesce(F.size(shared_slices("a", "b")) > 0, F.lit(False))
    return joined.where(met).select("a.*").drop("bx", "by").dropDuplicates(key)
