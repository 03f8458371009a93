"""Polygons against pixel counts, projections against round trips and known places."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import projections as p
from tessera.operators import polygons
from tests.test_sites import raster_rows, regions

BOX = "xmin double, ymin double, xmax double, ymax double"


def painted(traps, shape, k=2):
    """How often the trapezoids cover the middle of each k-th of a pixel."""
    ys, xs = (np.arange(shape[0] * k) + 0.5) / k, (np.arange(shape[1] * k) + 0.5) / k
    out = np.zeros((len(ys), len(xs)), int)
    for y0, y1, l0, l1, r0, r1 in traps:
        for i in np.flatnonzero((ys > y0) & (ys < y1)):
            t = (ys[i] - y0) / (y1 - y0)
            out[i] += (xs > l0 + (l1 - l0) * t) & (xs < r0 + (r1 - r0) * t)
    return out


def area(x, y):
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def test_rings_are_the_outline_of_any_mask():
    rng = np.random.default_rng(0)
    for _ in range(150):
        mask = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < rng.choice([0.3, 0.5, 0.7, 0.95])
        rings = polygons.rings_of(mask)
        assert (painted(polygons.trapezoids_of(rings), mask.shape) == np.kron(mask, np.ones((2, 2), int))).all()
        assert math.isclose(sum(area(*r) for r in rings), mask.sum())
        assert sum(area(*r) > 0 for r in rings) == len(regions(mask))  # holes turn the other way


def test_simplified_rings_stay_within_the_tolerance():
    yy, xx = np.mgrid[:300, :400]
    mask = (((xx - 200) / 180) ** 2 + ((yy - 150) / 130) ** 2 < 1) & ((xx - 180) ** 2 + (yy - 150) ** 2 > 900)
    rings = polygons.rings_of(mask)
    found = polygons.simplified_together(rings, 1.0)
    assert sum(len(x) for x, _ in found) < 0.3 * sum(len(x) for x, _ in rings)
    for (x, y), (u, v) in zip(rings, found, strict=True):
        a, b = np.stack([u, v], 1), np.stack([np.roll(u, -1), np.roll(v, -1)], 1)
        for q in np.stack([x, y], 1):
            d = b - a
            t = np.clip(((q - a) * d).sum(1) / (d * d).sum(1), 0, 1)
            assert np.sqrt((((a + t[:, None] * d) - q) ** 2).sum(1)).min() <= 1 + 1e-9
    assert abs(sum(area(*r) for r in found) - mask.sum()) < 0.01 * mask.sum()


def test_thin_and_crossing_rings_stay_whole():
    line = np.zeros((3, 40), bool)
    line[1] = True
    assert math.isclose(area(*polygons.simplified_together(polygons.rings_of(line), 1.0)[0]), 40)
    bow = [(np.array([0.0, 4, 0, 4]), np.array([0.0, 4, 4, 0]))]
    assert polygons.trapezoids_of(bow) is None
    assert polygons.trapezoids_of([]).shape == (0, 6)


@pytest.mark.parametrize("seed", range(2))
def test_footprint_polygons_equal_the_pixels(spark, seed):
    mask = np.random.default_rng(seed).random((24, 30)) < 0.6
    pixels, rasters = raster_rows(spark, mask)
    found = polygons.footprint_polygons(pixels, rasters, least_pixels=12, tolerance=0)
    large = [r for r in regions(mask) if len(r) >= 12]
    assert found.count() == len(large)
    want = {round(len(r) * 0.25, 6) for r in large}
    pieces = polygons.trapezoids(found, ["site_id", "region"])
    assert {round(r["area"], 6) for r in polygons.areas(pieces, ["site_id", "region"]).collect()} == want
    rows = [((2000 - r["y1"]) / 0.5, (2000 - r["y0"]) / 0.5, *((r[c] - 1000) / 0.5 for c in ("xl1", "xl0", "xr1", "xr0"))) for r in pieces.collect()]
    truth = np.zeros(mask.shape, int)
    for r in large:
        truth[tuple(np.array(sorted(r)).T)] = 1
    assert (painted(rows, mask.shape) == np.kron(truth, np.ones((2, 2), int))).all()


def test_thinned_footprint_and_the_extent_where_nothing_is_left(spark):
    mask = np.zeros((45, 61), int)
    mask[4:, 10:] = 1
    pixels, rasters = raster_rows(spark, mask)
    one = polygons.footprint_polygons(pixels, rasters, max_side=20, least_pixels=4)
    got = polygons.areas(polygons.trapezoids(one, ["site_id"]), ["site_id"]).first()["area"]
    # every third row and column that is in: rows 6 to 44, columns 12 to 60, the last column cut at the edge
    assert math.isclose(got, (45 - 6) * (61 - 12) * 0.25)
    none = polygons.footprint_polygons(pixels.where("row = 30 and col = 30"), rasters)
    assert math.isclose(polygons.areas(polygons.trapezoids(none, ["site_id"]), ["site_id"]).first()["area"], 45 * 61 * 0.25)


def rings_rows(spark, rows):
    return spark.createDataFrame(rows, f"site_id string, rings {polygons.RINGS}")


def test_boxes_are_cut_to_polygons(spark):
    """Against counts of small squares: a star with a hole, and boxes anywhere."""
    turn = np.arange(10) * np.pi / 5
    r = np.where(np.arange(10) % 2, 18, 40)
    star = {"xs": (50 + r * np.sin(turn)).tolist(), "ys": (50 + r * np.cos(turn)).tolist()}
    hole = {"xs": [45.0, 55.0, 50.0], "ys": [45.0, 45.0, 57.0]}
    pieces = polygons.trapezoids(rings_rows(spark, [("s", [star, hole])]), ["site_id"])
    rng = np.random.default_rng(3)
    corner = rng.uniform(0, 90, (40, 2))
    far = corner + rng.uniform(1, 25, (40, 2))
    tiles = [("s", i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(corner, far, strict=True))]
    df = spark.createDataFrame(tiles, f"site_id string, tile int, {BOX}")
    got = {x["tile"]: x for x in polygons.clip_to_polygons(df, pieces, 7.0, ["site_id", "tile"], ["site_id"]).collect()}
    k = 20
    fine = painted([[x[c] for c in polygons.EDGES] for x in pieces.collect()], (100, 100), k) > 0
    ys, xs = np.nonzero(fine)
    ys, xs = (ys + 0.5) / k, (xs + 0.5) / k
    for _, i, x0, y0, x1, y1 in tiles:
        inside = (xs > x0) & (xs < x1) & (ys > y0) & (ys < y1)
        assert abs((got[i]["area"] if i in got else 0) - inside.sum() / k**2) < 0.05 * ((x1 - x0) + (y1 - y0))
        if inside.sum() > 5:
            ends = (xs[inside].min(), ys[inside].min(), xs[inside].max(), ys[inside].max())
            assert np.allclose([got[i][c] for c in ("xmin", "ymin", "xmax", "ymax")], ends, atol=0.3)
    semi = polygons.polygon_semi_join(df, pieces, 7.0, ["site_id", "tile"], ["site_id"])
    assert sorted(x["tile"] for x in semi.collect()) == sorted(got)


def test_what_only_the_polygons_box_touches_goes(spark):
    triangle = {"xs": [0.0, 10.0, 0.0], "ys": [0.0, 0.0, 10.0]}
    pieces = polygons.trapezoids(rings_rows(spark, [("s", [triangle])]), ["site_id"])
    tiles = [("s", "in the corner", 8.0, 8.0, 9.0, 9.0), ("s", "by its edge", 10.0, 0.0, 12.0, 1.0), ("s", "at a point", 5.0, 5.0, 6.0, 6.0), ("s", "over", 4.0, 4.0, 6.0, 6.0), ("t", "elsewhere", 0.0, 0.0, 5.0, 5.0)]
    got = polygons.clip_to_polygons(spark.createDataFrame(tiles, f"site_id string, tile string, {BOX}"), pieces, 3.0, ["site_id", "tile"], ["site_id"]).collect()
    assert [(r["tile"], r["xmin"], r["ymin"], r["xmax"], r["ymax"], r["area"]) for r in got] == [("over", 4.0, 4.0, 6.0, 6.0, 2.0)]


# --- projections ---------------------------------------------------------------------------------


def test_places_come_back_within_a_millimetre(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), float(y)) for x, y in zip(rng.uniform(-180, 180, 300), rng.uniform(-80, 84, 300), strict=True)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("zone", p.zone_of(F.col("lon"), F.col("lat")))
    for target in (F.col("zone"), F.lit(3857)):
        there = df.withColumn("a", p.reprojected(F.col("lon"), F.col("lat"), F.lit(4326), target))
        back = there.withColumn("b", p.reprojected(F.col("a.x"), F.col("a.y"), target, F.lit(4326)))
        off = back.select(F.max(F.greatest(F.abs(F.col("b.x") - F.col("lon")), F.abs(F.col("b.y") - F.col("lat"))))).first()[0]
        assert off * 111_320 < 1e-3
    across = df.withColumn("a", p.reprojected(F.col("lon"), F.col("lat"), F.lit(4326), F.col("zone"))).withColumn("w", p.reprojected(F.col("a.x"), F.col("a.y"), F.col("zone"), F.lit(3857)))
    plain = across.withColumn("v", p.reprojected(F.col("lon"), F.col("lat"), F.lit(4326), F.lit(3857)))
    assert plain.select(F.max(F.abs(F.col("w.y") - F.col("v.y")))).first()[0] < 0.01


def test_zones_agree_with_distances_along_the_meridian(spark):
    """On a zone's middle meridian the northing is the arc from the equator, by its integral, times the scale."""
    rows = [(3.0, float(x), 32631) for x in (0, 10, 45, 60, 84)]
    got = spark.createDataFrame(rows, "lon double, lat double, srid int").select("lat", p.to_zone(F.col("lon"), F.col("lat"), F.col("srid")).alias("z")).collect()
    e2 = p.E**2
    for r in got:
        phi = np.linspace(0, math.radians(r["lat"]), 20_001)
        f = p.A * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
        arc = float(((f[1:] + f[:-1]) / 2 * np.diff(phi)).sum())
        assert abs(r["z"]["x"] - 500_000) < 1e-6 and abs(r["z"]["y"] - 0.9996 * arc) < 1e-2


def test_boxes_hold_all_their_edges(spark):
    rows = [(i, 114.0 + i, -40.0 + 3 * i, 116.5 + i, -37.0 + 3 * i) for i in range(6)]
    df = spark.createDataFrame(rows, f"k int, {BOX}")
    got = {r["k"]: r for r in p.reprojected_boxes(df, F.lit(4326), F.lit(32750)).collect()}
    steps = np.linspace(0, 1, 43)
    points = [(k, float(x0 + (x1 - x0) * t), y) for k, x0, y0, x1, y1 in rows for t in steps for y in (y0, y1)] + [(k, x, float(y0 + (y1 - y0) * t)) for k, x0, y0, x1, y1 in rows for t in steps for x in (x0, x1)]
    edge = spark.createDataFrame(points, "k int, lon double, lat double").select("k", p.reprojected(F.col("lon"), F.col("lat"), F.lit(4326), F.lit(32750)).alias("z")).collect()
    corners = 0
    for r in edge:
        b = got[r["k"]]
        assert b["xmin"] - 30 <= r["z"]["x"] <= b["xmax"] + 30 and b["ymin"] - 30 <= r["z"]["y"] <= b["ymax"] + 30
        corners += r["z"]["y"] <= b["ymin"]
    assert corners  # and aren't larger than they have to be
    unknown = p.reprojected_boxes(df, F.lit(1234), F.lit(32750)).first()
    assert unknown["xmin"] is None and p.reprojected_boxes(df, F.lit(1234), F.lit(1234)).first()["xmin"] == 114.0
