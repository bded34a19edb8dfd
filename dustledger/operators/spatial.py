"""Spatial joins as equi joins on grid cells.

Both sides are exploded over the cells they touch and joined on the cell key, so Spark shuffles or
broadcasts by its own size estimates and splits a crowded cell as a skewed join partition. A pair
that shares several cells is kept only in the cell of one reference point, so no distinct is needed.
Rows with the same geometry are collapsed first where the result allows it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dustledger.functions import geo
from dustledger.session import durable, shuffled

BOX = ("minx", "miny", "maxx", "maxy")


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def with_cells(df: DataFrame, size: float, margin: float = 0.0, box: Sequence[str] = BOX) -> DataFrame:
    """One row per grid cell that the (expanded) box touches, as columns cx, cy."""
    x1, y1, x2, y2 = (F.col(c) for c in box)
    return (df.withColumn("cx", F.explode(F.sequence(_cell(x1 - margin, size), _cell(x2 + margin, size))))
            .withColumn("cy", F.explode(F.sequence(_cell(y1 - margin, size), _cell(y2 + margin, size)))))


def box_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: float,
              margin: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, left id as ``l``, right id as ``r``, both boxes) of boxes closer than ``margin`` per axis.

    Each pair appears exactly once. ``keys`` (say a tile) further restrict the join.
    """
    a = left.select(*keys, F.col(left_id).alias("l"), *[F.col(c).alias(f"l_{c}") for c in BOX])
    b = right.select(*keys, F.col(right_id).alias("r"), *[F.col(c).alias(f"r_{c}") for c in BOX])
    a = with_cells(a, size, 0.0, [f"l_{c}" for c in BOX])
    b = with_cells(b, size, margin, [f"r_{c}" for c in BOX])
    ref_x = F.greatest(F.col("l_minx"), F.col("r_minx") - margin)
    ref_y = F.greatest(F.col("l_miny"), F.col("r_miny") - margin)
    near = ((F.col("l_minx") <= F.col("r_maxx") + margin) & (F.col("r_minx") - margin <= F.col("l_maxx"))
            & (F.col("l_miny") <= F.col("r_maxy") + margin) & (F.col("r_miny") - margin <= F.col("l_maxy")))
    return (a.join(shuffled(b), [*keys, "cx", "cy"])
            .filter(near & (_cell(ref_x, size) == F.col("cx")) & (_cell(ref_y, size) == F.col("cy")))
            .drop("cx", "cy"))


def left_box() -> tuple[Column, ...]:
    return tuple(F.col(f"l_{c}") for c in BOX)


def right_box() -> tuple[Column, ...]:
    return tuple(F.col(f"r_{c}") for c in BOX)


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str,
                       size: float, x: str = "x", y: str = "y", ring: str | None = "ring") -> DataFrame:
    """Every point with the smallest polygon id that holds it, or null.

    ``polygons`` carry their box columns; ``ring`` None means the box is the polygon (half-open).
    """
    cols = [c for c in (polygon_id, ring, *BOX) if c]
    poly = with_cells(polygons.select(*cols), size)
    pts = points.select(point_id, x, y).withColumns({"cx": _cell(F.col(x), size), "cy": _cell(F.col(y), size)})
    inside = ((F.col(x) >= F.col("minx")) & (F.col(x) <= F.col("maxx"))
              & (F.col(y) >= F.col("miny")) & (F.col(y) <= F.col("maxy")))
    if ring:
        inside = inside & geo.point_in_ring(F.col(x), F.col(y), F.col(ring))
    else:
        inside = inside & (F.col(x) < F.col("maxx")) & (F.col(y) < F.col("maxy"))
    hit = (pts.join(shuffled(poly), ["cx", "cy"]).filter(inside)
           .groupBy(point_id).agg(F.min(polygon_id).alias(polygon_id)))
    return points.join(shuffled(hit), point_id, "left")


def nearest_segment_distance(points: DataFrame, segments: DataFrame, point_id: str, radius: float,
                             x: str = "x", y: str = "y") -> DataFrame:
    """(point_id, distance) to the nearest segment within ``radius``, else ``radius``.

    Segments (x0, y0, x1, y1) are listed in every cell within reach; a point looks only into its own.
    """
    seg = segments.select("x0", "y0", "x1", "y1").distinct().withColumns({
        "minx": F.least("x0", "x1"), "maxx": F.greatest("x0", "x1"), "miny": F.least("y0", "y1"), "maxy": F.greatest("y0", "y1")})
    seg = with_cells(seg, radius, radius).select("cx", "cy", "x0", "y0", "x1", "y1")
    pts = points.select(point_id, x, y).withColumns({"cx": _cell(F.col(x), radius), "cy": _cell(F.col(y), radius)})
    d = geo.segment_distance(F.col(x), F.col(y), *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    near = pts.join(seg, ["cx", "cy"]).groupBy(point_id).agg(F.min(d).alias("d"))
    return points.select(point_id).join(near, point_id, "left").select(
        point_id, F.least(F.coalesce("d", F.lit(radius)), F.lit(radius)).alias("distance"))


def nearest_box_distance(points: DataFrame, boxes: DataFrame, point_id: str, start: float,
                         x: str = "x", y: str = "y", growth: float = 4.0) -> DataFrame:
    """(point_id, distance) to the nearest box, however far; 0 inside, null only without coordinates or boxes.

    Rounds widen the search ring for the points that found nothing within it, until every point has its
    answer. In a round the boxes are first summarised by the fine cells they touch (an eighth of the ring): a
    point's answer lies in a cell whose near edge is no farther than the nearest far corner of all its cells, so
    it is compared with the boxes of those few cells only, also when the ring spans a state.
    """
    distinct = boxes.select(*BOX).dropna().distinct()
    left = points.select(point_id, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    known = not distinct.isEmpty()
    done = left.select(point_id, F.lit(None).cast("double").alias("distance")).limit(0)
    radius = start
    while known and left.take(1):
        fine = radius / 8.0
        touched = with_cells(distinct, fine).select(F.col("cx").alias("fx"), F.col("cy").alias("fy"), *BOX)
        cell = touched.select("fx", "fy").distinct().select(
            "fx", "fy", (F.col("fx") * fine).alias("minx"), (F.col("fy") * fine).alias("miny"),
            ((F.col("fx") + 1) * fine).alias("maxx"), ((F.col("fy") + 1) * fine).alias("maxy"))
        px, py = F.col(x), F.col(y)
        near = geo.box_gap((px, py, px, py), tuple(F.col(c) for c in BOX))
        far = F.hypot(F.greatest(F.abs(px - F.col("minx")), F.abs(px - F.col("maxx"))), F.greatest(F.abs(py - F.col("miny")), F.abs(py - F.col("maxy"))))
        pts = left.withColumns({"cx": _cell(px, radius), "cy": _cell(py, radius)})
        seen = pts.join(shuffled(with_cells(cell, radius, radius)), ["cx", "cy"]).select(point_id, x, y, "fx", "fy", near.alias("near"), far.alias("far"))
        reach = seen.groupBy(point_id).agg(F.min("far").alias("reach"))
        # joined to its cells again, so that the many cells of a point are not shuffled and sorted by point
        known_reach = pts.join(shuffled(reach), point_id)
        some = known_reach.join(shuffled(with_cells(cell, radius, radius)), ["cx", "cy"]).filter(
            (near <= F.col("reach")) & (near <= radius)).select(point_id, x, y, "fx", "fy")
        found = durable(some.join(shuffled(touched), ["fx", "fy"]).groupBy(point_id).agg(F.min(near).alias("distance"))
                        .filter(F.col("distance") <= radius))
        done = done.unionByName(found)
        left = durable(left.join(found, point_id, "left_anti"))
        radius *= growth
    return points.select(point_id).join(done, point_id, "left")


def neighbour_features(boxes: DataFrame, id_col: str, area: str = "area_m2",
                       near: float = 50.0, far: float = 100.0) -> DataFrame:
    """Per box: neighbours within near/far (edge to edge, self excluded), nearest gap, mean area.

    Equal boxes are collapsed with their count before pairing, and each box sees the collapsed list.
    """
    shape = boxes.groupBy(*BOX, F.col(area).alias("a")).agg(F.count(F.lit(1)).alias("m"), F.min(id_col).alias("sid"))
    pairs = box_pairs(shape, shape, "sid", "sid", far, far)
    pairs = pairs.withColumn("gap", geo.box_gap(left_box(), right_box())).filter(F.col("gap") <= far)
    pairs = pairs.join(shuffled(shape.select(F.col("sid").alias("r"), "m", "a")), "r")
    m = F.when(F.col("l") == F.col("r"), F.col("m") - 1).otherwise(F.col("m"))
    pairs = pairs.withColumn("w", m).filter("w > 0")
    agg = pairs.groupBy("l").agg(
        F.sum(F.when(F.col("gap") <= near, F.col("w")).otherwise(0)).alias("n_near"), F.sum("w").alias("n_far"),
        F.min("gap").alias("nearest_m"), (F.sum(F.col("a") * F.col("w")) / F.sum("w")).alias("mean_area_far"))
    mine = boxes.select(id_col, *BOX, F.col(area).alias("a")).join(
        shuffled(shape.select(*BOX, "a", F.col("sid").alias("l"))), [*BOX, "a"]).select(id_col, "l")
    return mine.join(shuffled(agg), "l", "left").select(
        id_col, F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("n_far", F.lit(0)).alias("n_far"),
        "nearest_m", "mean_area_far")


def nearest_station(systems: DataFrame, stations: DataFrame, system_id: str, station_id: str,
                    within_km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Inner pairs (system, nearest station, km) within ``within_km``; ties by station id.

    Of stations at one place the smallest id counts. Rounds widen the radius from the mean spacing of the stations on, for the
    systems that found none yet, so a system is compared with a few stations only, however dense they are.
    """
    places = durable(stations.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(lat, lon).agg(F.min(station_id).alias(station_id)))
    left = systems.select(system_id, lat, lon)
    found = None
    for km in _radii(_spacing(places, lat, lon) * 110.0, within_km):
        near = durable(_stations_within(left, places, system_id, station_id, km, lat, lon))
        found = near if found is None else found.unionByName(near)
        left = durable(left.join(shuffled(near.select(system_id)), system_id, "left_anti"))
    return found


def _spacing(places: DataFrame, lat: str, lon: str) -> float:
    """Mean spacing in degrees of places over the box around them; 0 for none or for a single one."""
    at = places.agg(F.count(F.lit(1)), F.max(lat) - F.min(lat), F.max(lon) - F.min(lon)).first()
    return math.sqrt(max(at[1], 1e-6) * max(at[2], 1e-6) / at[0]) if at[0] > 1 else 0.0


def _radii(start: float, limit: float, growth: float = 2.0) -> list[float]:
    """Growing search radii, the last one ``limit``; at most about 20 of them."""
    radii = [limit]
    while start > 0 and radii[-1] / growth >= start and len(radii) < 20:
        radii.append(radii[-1] / growth)
    return radii[::-1]


def _stations_within(systems: DataFrame, stations: DataFrame, system_id: str, station_id: str,
                     within_km: float, lat: str, lon: str) -> DataFrame:
    """(system, nearest station, km) of the systems with a station within ``within_km``; ties by station id.

    Cells are latitude bands of the search radius and longitude cells widened by 1/cos(lat), with
    the stations listed in all neighbouring cells. Stations near the antimeridian are listed on both sides of it,
    those near a pole at all longitudes.
    """
    deg = within_km / 110.0
    lat_s = F.col("s_lat")
    wide = deg / F.greatest(F.lit(0.05), F.cos(F.radians(F.least(F.lit(89.0), F.abs(lat_s) + deg))))
    wide = F.when(F.abs(lat_s) + deg > 86.0, F.lit(361.0)).otherwise(wide)
    st = stations.select(F.col(station_id), F.col(lat).alias("s_lat"), F.col(lon).alias("_lon"))
    # the same place a turn further east or west, where that reaches into -180..180
    turns = F.filter(F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0)), lambda turn: (turn == 0) | (F.abs(F.col("_lon") + turn) <= 180.0 + F.least(wide, F.lit(180.0))))
    st = st.withColumn("_turn", F.explode(F.when(wide > 360.0, F.array(F.lit(0.0))).otherwise(turns)))
    st = st.withColumn("s_lon", F.col("_lon") + F.col("_turn")).drop("_lon", "_turn")
    st = (st.withColumn("cy", F.explode(F.sequence(_cell(lat_s - deg, deg), _cell(lat_s + deg, deg))))
          .withColumn("cx", F.explode(F.sequence(_cell(F.col("s_lon") - wide, deg), _cell(F.col("s_lon") + wide, deg)))))
    sy = systems.withColumns({"cy": _cell(F.col(lat), deg), "cx": _cell(F.col(lon), deg)})
    km = geo.haversine_m(F.col(lat), F.col(lon), F.col("s_lat"), F.col("s_lon")) / 1000.0
    j = sy.join(shuffled(st), ["cx", "cy"]).withColumn("km", km).filter(F.col("km") <= within_km)
    best = j.groupBy(system_id).agg(F.min(F.struct("km", station_id)).alias("b"))
    return best.select(system_id, F.col(f"b.{station_id}").alias(station_id), F.col("b.km").alias("km"))


def nearest_key(queries: DataFrame, keys: DataFrame, query_id: str, key_id: str, tol: float,
                match: Sequence[str] = (), lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Left lookup of the nearest key by squared degrees below tol^2, equal on ``match`` columns; ties by key id.

    Of keys at one place the smallest id counts. Rounds widen the search from the mean spacing of the keys on, for the queries that
    found none yet, so a query is compared with a few keys only, however dense they are.
    """
    places = durable(keys.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(*match, lat, lon).agg(F.min(key_id).alias(key_id)))
    left = queries.select(query_id, *match, lat, lon)
    found = None
    for reach in _radii(_spacing(places, lat, lon), tol):
        k = places.select(F.col(key_id), *match, F.col(lat).alias("k_lat"), F.col(lon).alias("k_lon"))
        k = (k.withColumn("cy", F.explode(F.sequence(_cell(F.col("k_lat") - reach, reach), _cell(F.col("k_lat") + reach, reach))))
             .withColumn("cx", F.explode(F.sequence(_cell(F.col("k_lon") - reach, reach), _cell(F.col("k_lon") + reach, reach)))))
        q = left.withColumns({"cy": _cell(F.col(lat), reach), "cx": _cell(F.col(lon), reach)})
        d2 = (F.col(lat) - F.col("k_lat")) * (F.col(lat) - F.col("k_lat")) + (F.col(lon) - F.col("k_lon")) * (F.col(lon) - F.col("k_lon"))
        near = durable(q.join(shuffled(k), [*match, "cx", "cy"]).withColumn("d2", d2).filter(F.col("d2") < reach * reach)
                       .groupBy(query_id).agg(F.min(F.struct("d2", key_id)).alias("b")))
        found = near if found is None else found.unionByName(near)
        left = durable(left.join(shuffled(near.select(query_id)), query_id, "left_anti"))
    return queries.join(shuffled(found), query_id, "left").withColumn(key_id, F.col(f"b.{key_id}")).drop("b")
