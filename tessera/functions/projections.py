"""Map projections on the WGS 84 ellipsoid as column expressions: transverse Mercator zones, web Mercator, plain degrees.

Reference systems are told by SRID columns, so tables may mix them: 4326 (degrees), 3857 (web Mercator), 326zz and 327zz
(zone zz of the transverse Mercator, north and south).  Others give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geo import BOX

# The ellipsoid's half axis and flattening, the zones' scale and false origin.
A = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
EAST, SOUTH = 500_000.0, 10_000_000.0

N = FLATTENING / (2 - FLATTENING)
E = (FLATTENING * (2 - FLATTENING)) ** 0.5
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
# The series in the third flattening n, from the ellipsoid's conformal sphere to the map (ALPHA), back (BETA), and
# from conformal to geodetic latitude (DELTA); terms of n^5 and more are under a micrometre here.
ALPHA = (
    N / 2 - 2 / 3 * N**2 + 5 / 16 * N**3 + 41 / 180 * N**4,
    13 / 48 * N**2 - 3 / 5 * N**3 + 557 / 1440 * N**4,
    61 / 240 * N**3 - 103 / 140 * N**4,
    49561 / 161280 * N**4,
)
BETA = (
    N / 2 - 2 / 3 * N**2 + 37 / 96 * N**3 - 1 / 360 * N**4,
    1 / 48 * N**2 + 1 / 15 * N**3 - 437 / 1440 * N**4,
    17 / 480 * N**3 - 37 / 840 * N**4,
    4397 / 161280 * N**4,
)
DELTA = (
    2 * N - 2 / 3 * N**2 - 2 * N**3 + 116 / 45 * N**4,
    7 / 3 * N**2 - 8 / 5 * N**3 - 227 / 45 * N**4,
    56 / 15 * N**3 - 136 / 35 * N**4,
    4279 / 630 * N**4,
)


def _bound(value: Column, make) -> Column:
    """``make(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), make), 1)


def zone_meridian(srid: Column) -> Column:
    """The middle meridian of a zone, in radians; null where the SRID isn't a zone's."""
    zone = srid % 100
    return F.when(F.floor(srid / 100).isin(326, 327) & zone.between(1, 60), F.radians(zone * 6 - 183.0))


def zone_of(lon: Column, lat: Column) -> Column:
    """The SRID of the zone of a place in degrees."""
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def to_zone(lon: Column, lat: Column, srid: Column) -> Column:
    """(x, y) in metres of a place in degrees."""

    def sphere(phi: Column) -> Column:
        sine = F.sin(phi)
        return F.sinh(F.atanh(sine) - E * F.atanh(E * sine))

    def plane(p: Column) -> Column:
        t, d = p["t"], p["d"]
        xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) ** 2))
        return _bound(F.struct(xi.alias("xi"), eta.alias("eta")), mapped)

    def mapped(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        x = sum((a * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(ALPHA, 1)), eta)
        y = sum((a * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(ALPHA, 1)), xi)
        return F.struct((EAST + SCALE * RADIUS * x).alias("x"), (SCALE * RADIUS * y + F.when(srid >= 32700, SOUTH).otherwise(0.0)).alias("y"))

    off = F.radians(lon) - zone_meridian(srid)
    return F.when(off.isNotNull(), _bound(F.struct(sphere(F.radians(lat)).alias("t"), off.alias("d")), plane))


def from_zone(x: Column, y: Column, srid: Column) -> Column:
    """(x, y) in degrees of a place in a zone's metres."""

    def sphere(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        a = xi - sum((b * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, b in enumerate(BETA, 1)), F.lit(0.0))
        b_ = eta - sum((b * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, b in enumerate(BETA, 1)), F.lit(0.0))
        return _bound(F.struct(F.asin(F.sin(a) / F.cosh(b_)).alias("chi"), F.atan2(F.sinh(b_), F.cos(a)).alias("d")), place)

    def place(p: Column) -> Column:
        chi = p["chi"]
        phi = sum((c * F.sin(2 * k * chi) for k, c in enumerate(DELTA, 1)), chi)
        return F.struct(F.degrees(p["d"] + zone_meridian(srid)).alias("x"), F.degrees(phi).alias("y"))

    xi = (y - F.when(srid >= 32700, SOUTH).otherwise(0.0)) / (SCALE * RADIUS)
    p = F.struct(xi.alias("xi"), ((x - EAST) / (SCALE * RADIUS)).alias("eta"))
    return F.when(zone_meridian(srid).isNotNull(), _bound(p, sphere))


def to_web(lon: Column, lat: Column) -> Column:
    return F.struct((A * F.radians(lon)).alias("x"), (A * F.asinh(F.tan(F.radians(lat)))).alias("y"))


def from_web(x: Column, y: Column) -> Column:
    return F.struct(F.degrees(x / A).alias("x"), F.degrees(F.atan(F.sinh(y / A))).alias("y"))


def reprojected(x: Column, y: Column, source: Column, target: Column) -> Column:
    """(x, y) of a place given in ``source`` in the system ``target``; as it is where both are the same, null where one isn't
    known."""
    x, y = x.cast("double"), y.cast("double")
    degrees = F.when(source == 4326, F.struct(x.alias("x"), y.alias("y"))).when(source == 3857, from_web(x, y)).otherwise(from_zone(x, y, source))
    onto = lambda p: F.when(target == 4326, p).when(target == 3857, to_web(p["x"], p["y"])).otherwise(to_zone(p["x"], p["y"], target))
    return F.when(source == target, F.struct(x.alias("x"), y.alias("y"))).otherwise(_bound(degrees, onto))


def reprojected_boxes(boxes: DataFrame, source: Column, target: Column, steps: int = 21) -> DataFrame:
    """Boxes (columns xmin to ymax) in another system: the bounds of their outline, each edge cut into ``steps`` parts, as edges
    bend and may reach beyond their ends.  Boxes stay as they are where both systems are the same."""
    xmin, ymin, xmax, ymax = (F.col(c).cast("double") for c in BOX)
    parts = F.sequence(F.lit(0), F.lit(steps))
    along = lambda low, high, i: low + (high - low) * (i / steps)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    flat = lambda y: F.transform(parts, lambda i: point(along(xmin, xmax, i), y))
    upright = lambda x: F.transform(parts, lambda i: point(x, along(ymin, ymax, i)))
    outline = F.concat(flat(ymin), flat(ymax), upright(xmin), upright(xmax))
    moved = F.transform(outline, lambda p: reprojected(p["x"], p["y"], F.col("_source"), F.col("_target")))
    ready = boxes.withColumns({"_source": source, "_target": target}).withColumn("_moved", F.when(F.col("_source") != F.col("_target"), moved))
    m = F.col("_moved")
    ends = {"xmin": F.array_min(m["x"]), "ymin": F.array_min(m["y"]), "xmax": F.array_max(m["x"]), "ymax": F.array_max(m["y"])}
    same = F.col("_source") == F.col("_target")
    return ready.withColumns({c: F.when(same, F.col(c).cast("double")).otherwise(v) for c, v in ends.items()}).drop("_source", "_target", "_moved")
