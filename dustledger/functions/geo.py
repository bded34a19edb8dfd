"""Planar and spherical geometry as Column expressions; rings are ARRAY<STRUCT<x, y>>, open."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from dustledger import constants as K

RING = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


# ---- sphere ------------------------------------------------------------------------------------------
def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    s = (F.pow(F.sin((a2 - a1) / 2.0), F.lit(2.0))
         + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), F.lit(2.0)))
    return 2.0 * K.EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, degrees clockwise from north in [0, 360)."""
    a1, a2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(a2)
    x = F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def grid_snap(value: Column, step: float) -> Column:
    """Nearest multiple of ``step``, halves to even."""
    return F.rint(value / step) * step


# ---- boxes --------------------------------------------------------------------------------------------
def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """IoU of boxes (x1, y1, x2, y2); 0 when the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h

    def area(c):
        return F.greatest(F.lit(0.0), c[2] - c[0]) * F.greatest(F.lit(0.0), c[3] - c[1])

    union = area(a) + area(b) - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(inter / union)


def box_gap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Edge-to-edge distance of two boxes; 0 when they touch or overlap."""
    dx = F.greatest(F.lit(0.0), F.greatest(a[0], b[0]) - F.least(a[2], b[2]))
    dy = F.greatest(F.lit(0.0), F.greatest(a[1], b[1]) - F.least(a[3], b[3]))
    return F.sqrt(dx * dx + dy * dy)


# ---- rings -----------------------------------------------------------------------------------------------
def _edges(ring: Column) -> Column:
    """Array of (x0, y0, x1, y1), the closing edge included."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda p, q: F.struct(
        p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")))


def _total(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + term(e))


def signed_area(ring: Column) -> Column:
    return _total(_edges(ring), lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]) / 2.0


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_perimeter(ring: Column) -> Column:
    return _total(_edges(ring), lambda e: F.sqrt(
        (e["x1"] - e["x0"]) * (e["x1"] - e["x0"]) + (e["y1"] - e["y0"]) * (e["y1"] - e["y0"])))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    edges, six = _edges(ring), 6.0 * signed_area(ring)
    den = F.when(six != 0, six)
    cross = lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]
    return (_total(edges, lambda e: (e["x0"] + e["x1"]) * cross(e)) / den,
            _total(edges, lambda e: (e["y0"] + e["y1"]) * cross(e)) / den)


def ring_bbox(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def compactness(area: Column, perimeter: Column) -> Column:
    return 4.0 * math.pi * area / F.when(perimeter > 0, perimeter * perimeter)


def aspect_ratio(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    w, h = maxx - minx, maxy - miny
    short = F.least(w, h)
    return F.greatest(w, h) / F.when(short > 0, short)


def principal_axis_deg(ring: Column) -> Column:
    """Direction of largest vertex spread in [0, 180), closing vertex counted twice; null if none."""
    pts = F.concat(ring, F.slice(ring, 1, 1))
    n = F.size(pts)
    mx = F.aggregate(pts, F.lit(0.0), lambda a, p: a + p["x"]) / n
    my = F.aggregate(pts, F.lit(0.0), lambda a, p: a + p["y"]) / n
    sums = F.aggregate(pts, F.struct(F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"), F.lit(0.0).alias("xy")),
                       lambda a, p: F.struct(
                           (a["xx"] + (p["x"] - mx) * (p["x"] - mx)).alias("xx"),
                           (a["yy"] + (p["y"] - my) * (p["y"] - my)).alias("yy"),
                           (a["xy"] + (p["x"] - mx) * (p["y"] - my)).alias("xy")))
    angle = F.degrees(0.5 * F.atan2(2.0 * sums["xy"], sums["xx"] - sums["yy"]))
    return F.when(sums["xx"] + sums["yy"] > 0, F.pmod(angle + 180.0, F.lit(180.0)))


def valid_ring(ring: Column, min_area: float = 0.0) -> Column:
    """At least three vertices and a positive area."""
    return F.coalesce((F.size(ring) >= 3) & (ring_area(ring) > min_area), F.lit(False))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray-cast parity test (boundary points count by the half-open rule)."""
    crossings = F.aggregate(_edges(ring), F.lit(0), lambda acc, e: acc + F.when(
        ((e["y0"] > y) != (e["y1"] > y))
        & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0)) + e["x0"]), 1).otherwise(0))
    return crossings % 2 == 1


def interior_point(ring: Column) -> tuple[Column, Column]:
    """A point inside the ring, also for concave shapes: middle of the widest inner run at mid-height."""
    _, miny, _, maxy = ring_bbox(ring)
    y = (miny + maxy) / 2.0
    hits = F.filter(_edges(ring), lambda e: (e["y0"] > y) != (e["y1"] > y))
    xs = F.array_sort(F.transform(hits, lambda e: e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])))
    odd = F.filter(xs, lambda _, i: i % 2 == 0)
    even = F.filter(xs, lambda _, i: i % 2 == 1)
    runs = F.zip_with(odd, even, lambda a, b: F.struct((b - a).alias("w"), ((a + b) / 2.0).alias("m")))
    return F.array_max(runs)["m"], F.when(F.size(xs) > 0, y)


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = x1 - x0, y1 - y0
    len2 = dx * dx + dy * dy
    s = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / len2))).otherwise(F.lit(0.0))
    ex, ey = px - (x0 + s * dx), py - (y0 + s * dy)
    return F.sqrt(ex * ex + ey * ey)


def round_ring(ring: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.transform(ring, lambda p: F.struct(
        (F.rint(p["x"] * scale) / scale).alias("x"), (F.rint(p["y"] * scale) / scale).alias("y")))


def transform_ring(ring: Column, fn) -> Column:
    """Apply a point function (x, y) -> (x, y) to every vertex."""
    def point(p):
        x, y = fn(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, point)


# ---- hull: a per-row helper in Arrow batches -----------------------------------------------------------------
def _hull(points) -> list[tuple[float, float]]:
    pts = sorted({(p["x"], p["y"]) for p in points})
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) >= 2 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                     - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(reversed(pts))


@F.pandas_udf(RING)
def convex_hull(rings: pd.Series) -> pd.Series:
    return rings.map(lambda r: None if r is None else [{"x": float(x), "y": float(y)} for x, y in _hull(r)])


# ---- coordinate systems ---------------------------------------------------------------------------------------
def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return (F.radians(lon) * K.WEB_MERCATOR_RADIUS_M,
            F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2.0)) * K.WEB_MERCATOR_RADIUS_M)


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return (F.degrees(x / K.WEB_MERCATOR_RADIUS_M),
            F.degrees(2.0 * F.atan(F.exp(y / K.WEB_MERCATOR_RADIUS_M)) - math.pi / 2))


# GRS80 / WGS84 ellipsoid and the California Albers and UTM 10N definitions.
_A, _F = 6378137.0, 1 / 298.257222101
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)
ALBERS_CA = {"lat1": 34.0, "lat2": 40.5, "lat0": 0.0, "lon0": -120.0, "x0": 0.0, "y0": -4000000.0}
UTM10N = {"lon0": -123.0, "k0": 0.9996, "x0": 500000.0}


def _q(sin_phi):
    """Snyder's authalic q for a number or a Column."""
    if isinstance(sin_phi, Column):
        return (1 - _E2) * (sin_phi / (1 - _E2 * sin_phi * sin_phi)
                            - F.log((1 - _E * sin_phi) / (1 + _E * sin_phi)) / (2 * _E))
    return (1 - _E2) * (sin_phi / (1 - _E2 * sin_phi**2)
                        - math.log((1 - _E * sin_phi) / (1 + _E * sin_phi)) / (2 * _E))


def to_albers_california(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Ellipsoidal Albers equal-area (Snyder 1987, eqs. 14-1 to 14-6)."""
    p = ALBERS_CA
    s1, s2 = math.sin(math.radians(p["lat1"])), math.sin(math.radians(p["lat2"]))
    m1 = math.cos(math.radians(p["lat1"])) / math.sqrt(1 - _E2 * s1 * s1)
    m2 = math.cos(math.radians(p["lat2"])) / math.sqrt(1 - _E2 * s2 * s2)
    n = (m1 * m1 - m2 * m2) / (_q(s2) - _q(s1))
    c = m1 * m1 + n * _q(s1)
    rho0 = _A * math.sqrt(c - n * _q(math.sin(math.radians(p["lat0"])))) / n
    rho = _A * F.sqrt(c - n * _q(F.sin(F.radians(lat)))) / n
    theta = n * F.radians(lon - p["lon0"])
    return rho * F.sin(theta) + p["x0"], rho0 - rho * F.cos(theta) + p["y0"]


def to_utm10n(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Ellipsoidal transverse Mercator, zone 10 north (Snyder 1987, eqs. 8-9 to 8-15)."""
    phi = F.radians(lat)
    ep2 = _E2 / (1 - _E2)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    nn = _A / F.sqrt(1 - _E2 * sin * sin)
    t, c = tan * tan, ep2 * cos * cos
    a = F.radians(lon - UTM10N["lon0"]) * cos
    m = _A * ((1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256) * phi
              - (3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024) * F.sin(2 * phi)
              + (15 * _E2**2 / 256 + 45 * _E2**3 / 1024) * F.sin(4 * phi) - (35 * _E2**3 / 3072) * F.sin(6 * phi))
    a2 = a * a
    x = UTM10N["k0"] * nn * (a + (1 - t + c) * a2 * a / 6
                             + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a2 * a2 * a / 120) + UTM10N["x0"]
    y = UTM10N["k0"] * (m + nn * tan * (a2 / 2 + (5 - t + 9 * c + 4 * c * c) * a2 * a2 / 24
                                        + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a2 * a2 * a2 / 720))
    return x, y


# ---- tile affines ------------------------------------------------------------------------------------------------
def affine_order(t: Column, stated: Column | None = None) -> Column:
    """'affine', 'gdal', or null when the six numbers do not tell (callers must reject null)."""
    g = lambda i: F.abs(F.element_at(t, i))
    affine = (g(1) < g(3)) & (g(5) < g(6))
    gdal = (g(2) < g(1)) & (g(6) < g(4))
    guess = F.when(F.size(t) == 6, F.when(affine & ~gdal, "affine").when(gdal & ~affine, "gdal"))
    if stated is None:
        return guess
    return F.when(stated.isin("affine", "gdal"), stated).when(stated.isNull(), guess)


def affine_terms(t: Column, order: Column) -> tuple[Column, ...]:
    """(a, b, c, d, e, f) with x = a*col + b*row + c and y = d*col + e*row + f."""
    pick = {"affine": (1, 2, 3, 4, 5, 6), "gdal": (2, 3, 1, 5, 6, 4)}
    return tuple(F.when(order == "affine", F.element_at(t, pick["affine"][i]))
                 .when(order == "gdal", F.element_at(t, pick["gdal"][i])) for i in range(6))


def pixel_to_world(col: Column, row: Column, terms: tuple[Column, ...]) -> tuple[Column, Column]:
    a, b, c, d, e, f = terms
    return a * col + b * row + c, d * col + e * row + f


def ground_gsd_m(pixel: Column, crs: Column, center_y: Column) -> Column:
    """Ground metres per pixel; Mercator is deflated by cos(lat), degrees need the latitude."""
    lat = from_web_mercator(F.lit(0.0), center_y)[1]
    return (F.when(crs.isin("EPSG:3857", "EPSG:900913", "EPSG:102100"), F.abs(pixel) * F.cos(F.radians(lat)))
            .when(crs == "EPSG:4326", F.abs(pixel) * 111320.0 * F.cos(F.radians(center_y)))
            .when(crs == "EPSG:2227", F.abs(pixel) * 0.3048006096012192)
            .when(crs.isNotNull(), F.abs(pixel)))
