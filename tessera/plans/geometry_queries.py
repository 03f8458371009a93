"""Polygons and map projections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import projections as p
from tessera.operators import polygons
from tessera.plans.queries import _BOXES, boxes, query, r6, read
from tessera.plans.site_queries import rasters

# --- projections ---------------------------------------------------------------------------------


def _zone_sql(rows: str, keep: str) -> str:
    """``rows`` with lon, lat and srid, and their x and y in the zone: each series written out."""
    sinh, cosh = (lambda v: f"((exp({v}) - exp(-({v}))) / 2)"), (lambda v: f"((exp({v}) + exp(-({v}))) / 2)")
    atanh, asinh = (lambda v: f"(0.5 * ln((1 + {v}) / (1 - {v})))"), (lambda v: f"(sign({v}) * ln(abs({v}) + sqrt(({v}) * ({v}) + 1)))")
    s = "sin(radians(lat))"
    x = " + ".join(["eta", *[f"{a!r} * cos({2 * k} * xi) * {sinh(f'{2 * k} * eta')}" for k, a in enumerate(p.ALPHA, 1)]])
    y = " + ".join(["xi", *[f"{a!r} * sin({2 * k} * xi) * {cosh(f'{2 * k} * eta')}" for k, a in enumerate(p.ALPHA, 1)]])
    r = p.SCALE * p.RADIUS
    return f"""SELECT {keep}, 500000 + {r!r} * ({x}) AS x, {r!r} * ({y}) + CASE WHEN srid >= 32700 THEN 10000000 ELSE 0 END AS y FROM
 (SELECT *, atan2(t, cos(d)) AS xi, {asinh("(sin(d) / sqrt(t * t + cos(d) * cos(d)))")} AS eta FROM
 (SELECT *, {sinh(f"({atanh(s)} - {p.E!r} * {atanh(f'({p.E!r} * {s})')})")} AS t, radians(lon) - radians(srid % 100 * 6 - 183.0) AS d FROM ({rows})))"""


_PLACES = "SELECT c_custkey, -180 + (c_custkey * 7919 % 35993) * 0.01::DOUBLE AS lon, -80 + (c_custkey * 104729 % 15991) * 0.01::DOUBLE AS lat FROM customer"
_ZONED = f"SELECT *, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1 AS INTEGER) AS srid FROM ({_PLACES})"


def places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    found = read(spark, sf, "customer").select(k, (-180 + k * 7919 % 35993 * 0.01).alias("lon"), (-80 + k * 104729 % 15991 * 0.01).alias("lat"))
    return found.withColumn("srid", p.zone_of(F.col("lon"), F.col("lat")))


@query(
    f"""SELECT c_custkey, srid, round(x, 3) AS x, round(y, 3) AS y, round(6378137.0 * radians(lon), 3) AS web_x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS web_y,
 round(lon, 6) AS back_lon, round(lat, 6) AS back_lat FROM ({_zone_sql(_ZONED, "c_custkey, srid, lon, lat")})"""
)
def reprojected_points(spark: SparkSession, sf: str) -> DataFrame:
    """Places in degrees brought to their zone and to web Mercator, and back from the zone."""
    at, degrees = places(spark, sf), F.lit(4326)
    moved = at.withColumn("z", p.reprojected(F.col("lon"), F.col("lat"), degrees, F.col("srid"))).withColumn("w", p.reprojected(F.col("lon"), F.col("lat"), degrees, F.lit(3857)))
    moved = moved.withColumn("b", p.reprojected(F.col("z.x"), F.col("z.y"), F.col("srid"), degrees))
    m = lambda c: F.round(c, 3)
    return moved.select("c_custkey", "srid", m("z.x").alias("x"), m("z.y").alias("y"), m("w.x").alias("web_x"), m("w.y").alias("web_y"), r6(F.col("b.x")).alias("back_lon"), r6(F.col("b.y")).alias("back_lat"))


_EDGE = "SELECT s_suppkey, srid, x0, y0, x1, y1, i, side FROM (SELECT s_suppkey, 32750 AS srid, 114.5 + s_suppkey % 40 * 0.1::DOUBLE AS x0, -35 + s_suppkey % 30 * 0.2::DOUBLE AS y0, 115.5 + s_suppkey % 40 * 0.1::DOUBLE AS x1, -34 + s_suppkey % 30 * 0.2::DOUBLE AS y1 FROM supplier), range(0, 22) r(i), range(0, 4) e(side)"
_OUTLINE = f"SELECT s_suppkey, srid, CASE side WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x0 + (x1 - x0) * (i / 21.0::DOUBLE) END AS lon, CASE side WHEN 2 THEN y0 WHEN 3 THEN y1 ELSE y0 + (y1 - y0) * (i / 21.0::DOUBLE) END AS lat FROM ({_EDGE})"


@query(f"SELECT s_suppkey, round(min(x), 3) AS xmin, round(min(y), 3) AS ymin, round(max(x), 3) AS xmax, round(max(y), 3) AS ymax FROM ({_zone_sql(_OUTLINE, 's_suppkey')}) GROUP BY 1")
def reprojected_extents(spark: SparkSession, sf: str) -> DataFrame:
    """Extents in degrees as boxes of a zone, their edges cut finely."""
    k = F.col("s_suppkey")
    x, y = k % 40 * 0.1, k % 30 * 0.2
    boxes = read(spark, sf, "supplier").select(k, (114.5 + x).alias("xmin"), (-35 + y).alias("ymin"), (115.5 + x).alias("xmax"), (-34 + y).alias("ymax"))
    return p.reprojected_boxes(boxes, F.lit(4326), F.lit(32750)).select(k, *[F.round(c, 3).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


# --- polygons ------------------------------------------------------------------------------------

# An L with a hole, a little apart for each site: all of a box, less its upper right corner and a square inside.
_PARTS = ((50, 60, 500, 400, 1), (300, 250, 500, 400, -1), (100, 100, 200, 200, -1))
_SHARED = " + ".join(
    f"{sign} * greatest(0, least(b.xmax, {x1} + o) - greatest(b.xmin, {x0} + o)) * greatest(0, least(b.ymax, {y1}.0) - greatest(b.ymin, {y0}.0))" for x0, y0, x1, y1, sign in _PARTS
)


def site_polygons(spark: SparkSession, sf: str) -> DataFrame:
    off = F.length("site_id").cast("double")
    ring = lambda xs, ys: F.struct(F.array(*[off + x for x in xs]).alias("xs"), F.array(*[F.lit(float(y)) for y in ys]).alias("ys"))
    outline = ring((50, 500, 500, 300, 300, 50), (60, 60, 250, 250, 400, 400))
    return rasters(spark, sf).select("site_id", F.array(outline, ring((100, 100, 200, 200), (100, 200, 200, 100))).alias("rings"))


@query(
    f"""SELECT p_partkey, round({_SHARED}, 6) AS area FROM {_BOXES} b JOIN (SELECT DISTINCT p_brand AS site_id, length(p_brand) AS o FROM part) USING (site_id) WHERE {_SHARED} > 0"""
)
def polygon_clip(spark: SparkSession, sf: str) -> DataFrame:
    """The area of each box that its site's polygon leaves."""
    pieces = polygons.trapezoids(site_polygons(spark, sf), ["site_id"])
    cut = polygons.clip_to_polygons(boxes(spark, sf), pieces, 30.0, ["p_partkey"], ["site_id"])
    return cut.select("p_partkey", r6(F.col("area")).alias("area"))


@query(
    f"""SELECT site_id, round(sum(CASE WHEN d1 <= 0 THEN 0 ELSE d1 * d1 / 2 - greatest(0, d1 - w) * greatest(0, d1 - w) / 2 - greatest(0, d1 - h) * greatest(0, d1 - h) / 2 + greatest(0, d1 - w - h) * greatest(0, d1 - w - h) / 2 END), 4) AS area,
 count(*) FILTER (d1 > 0) AS n_boxes FROM (SELECT site_id, xmax - xmin AS w, ymax - ymin AS h, 700.0::DOUBLE - xmin - ymin AS d1 FROM {_BOXES}) GROUP BY 1 HAVING count(*) FILTER (d1 > 0) > 0"""
)
def polygon_corner(spark: SparkSession, sf: str) -> DataFrame:
    """How many boxes of a site share area with a triangle, and how much: what lies under x + y = 700."""
    ring = F.struct(F.array(*map(F.lit, (0.0, 700.0, 0.0))).alias("xs"), F.array(*map(F.lit, (0.0, 0.0, 700.0))).alias("ys"))
    pieces = polygons.trapezoids(rasters(spark, sf).select("site_id", F.array(ring).alias("rings")), ["site_id"])
    cut = polygons.clip_to_polygons(boxes(spark, sf), pieces, 30.0, ["p_partkey"], ["site_id"])
    return cut.groupBy("site_id").agg(F.round(F.sum("area"), 4).alias("area"), F.count("*").alias("n_boxes"))
