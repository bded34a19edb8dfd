"""Queries of the spatial, matching and dataset operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dustledger import constants as K
from dustledger.functions import geo, overlay
from dustledger.functions.numeric import micro, wilson_interval
from dustledger.operators import components as CC, matching as MA, spatial as SP
from dustledger.operators.ranks import attach_row
from dustledger.plans.registry import query
from dustledger.plans.views import ctes, m6

BOX = SP.BOX


def _round(df, *cols):
    return df.withColumns({c: micro(F.col(c)) for c in cols})


def _iou_sql(a: str, b: str) -> str:
    inter = (f"(greatest(0e0, least({a}.maxx, {b}.maxx) - greatest({a}.minx, {b}.minx)) * "
             f"greatest(0e0, least({a}.maxy, {b}.maxy) - greatest({a}.miny, {b}.miny)))")
    union = (f"(({a}.maxx - {a}.minx) * ({a}.maxy - {a}.miny) + ({b}.maxx - {b}.minx) * ({b}.maxy - {b}.miny) - {inter})")
    return f"(case when {union} <= 0 then 0e0 else {inter} / {union} end)"


def _gap_sql(a: str, b: str) -> str:
    return (f"sqrt(power(greatest(0e0, greatest({a}.minx, {b}.minx) - least({a}.maxx, {b}.maxx)), 2) + "
            f"power(greatest(0e0, greatest({a}.miny, {b}.miny) - least({a}.maxy, {b}.maxy)), 2))")


# ---- B: geometry scalars -----------------------------------------------------------------------------------
_LL = "ll as (select l_orderkey as id, l_linenumber as ln, 30e0 + l_quantity / 5e0 as lat1, -120e0 + l_discount * 50 as lon1, 31e0 + l_tax * 80 as lat2, -119e0 - l_linenumber as lon2 from lineitem)"


def _ll(t):
    return t.read("lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), (30.0 + F.col("l_quantity") / 5.0).alias("lat1"),
        (-120.0 + F.col("l_discount") * 50).alias("lon1"), (31.0 + F.col("l_tax") * 80).alias("lat2"), (-119.0 - F.col("l_linenumber")).alias("lon2"))


_HAV = "2e0 * 6371000e0 * asin(least(1e0, sqrt(power(sin((radians(lat2) - radians(lat1)) / 2e0), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2e0), 2))))"


@query("b6_haversine_b7_bearing", f"with {_LL} select id, ln, {m6(_HAV)} as metres, "
       + m6("(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360e0) % 360e0") + " as bearing from ll")
def _(t):
    c = [F.col(x) for x in ("lat1", "lon1", "lat2", "lon2")]
    return _ll(t).select("id", "ln", micro(geo.haversine_m(*c)).alias("metres"), micro(geo.bearing_deg(*c)).alias("bearing"))


@query("b8_grid_snap", f"with {_LL} select " + ", ".join(
    f"{m6(f'round_even(lat2 / {g}e0, 0) * {g}e0')} as lat_{n}, {m6(f'round_even(lon1 / {g}e0, 0) * {g}e0')} as lon_{n}" for g, n in ((0.05, "c"), (0.5, "b"), (0.001, "f")))
    + ", count(*) as n from ll group by all")
def _(t):
    cols = {}
    for g, n in ((0.05, "c"), (0.5, "b"), (0.001, "f")):
        cols[f"lat_{n}"], cols[f"lon_{n}"] = micro(geo.grid_snap(F.col("lat2"), g)), micro(geo.grid_snap(F.col("lon1"), g))
    return _ll(t).select(*[c.alias(k) for k, c in cols.items()]).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query("b11_crs_round_trip", f"with {_LL} select id, ln, {m6('radians(lon1) * 6378137e0')} as merc_x, {m6('ln(tan(0.7853981633974483e0 + radians(lat2) / 2e0)) * 6378137e0')} as merc_y, {m6('lat2')} as lat_back, {m6('lon1')} as lon_back from ll")
def _(t):
    x, y = geo.to_web_mercator(F.col("lon1"), F.col("lat2"))
    d = _ll(t).withColumns({"x": x, "y": y})
    lon, lat = geo.from_web_mercator(F.col("x"), F.col("y"))
    return d.select("id", "ln", micro(F.col("x")).alias("merc_x"), micro(F.col("y")).alias("merc_y"), micro(lat).alias("lat_back"), micro(lon).alias("lon_back"))


_AFF = """tl as (select o_orderkey as tile_id, 0.2e0 + o_custkey % 5 / 100e0 as px, 1000e0 + o_orderkey as ox, 500000e0 + o_custkey as oy, o_orderkey % 3 as kind from orders)"""


@query("b9_affine_pixel_to_world", f"with {_AFF} select tile_id, case kind when 0 then 'affine' when 1 then 'gdal' end as transform_order, "
       + f"case when kind < 2 then {m6('px * 10e0 + ox')} end as wx, case when kind < 2 then {m6('-px * 20e0 + oy')} end as wy from tl")
def _(t):
    """Tiles in both orders, and ambiguous ones, which get null instead of a guess."""
    o = t.read("orders").select(F.col("o_orderkey").alias("tile_id"), (0.2 + F.col("o_custkey") % 5 / 100.0).alias("px"),
                                (1000.0 + F.col("o_orderkey")).alias("ox"), (500000.0 + F.col("o_custkey")).alias("oy"), (F.col("o_orderkey") % 3).alias("kind"))
    px, ox, oy, z = F.col("px"), F.col("ox"), F.col("oy"), F.lit(0.0)
    tr = (F.when(F.col("kind") == 0, F.array(px, z, ox, z, -px, oy)).when(F.col("kind") == 1, F.array(ox, px, z, oy, z, -px))
          .otherwise(F.array(px, px, px, px, px, px)))
    o = o.withColumn("t", tr).withColumn("transform_order", geo.affine_order(F.col("t")))
    wx, wy = geo.pixel_to_world(F.lit(10.0), F.lit(20.0), geo.affine_terms(F.col("t"), F.col("transform_order")))
    return o.select("tile_id", "transform_order", micro(wx).alias("wx"), micro(wy).alias("wy"))


@query("b10_ground_gsd", f"with {_AFF} select tile_id, " + m6(
    "case kind when 0 then px * cos(2e0 * atan(exp(oy / 6378137e0)) - 1.5707963267948966e0) when 1 then px * 0.3048006096012192e0 else px end") + " as gsd_m from tl")
def _(t):
    o = t.read("orders").select(F.col("o_orderkey").alias("tile_id"), (0.2 + F.col("o_custkey") % 5 / 100.0).alias("px"),
                                (500000.0 + F.col("o_custkey")).alias("oy"), (F.col("o_orderkey") % 3).alias("kind"))
    crs = F.when(F.col("kind") == 0, "EPSG:3857").when(F.col("kind") == 1, "EPSG:2227").otherwise("EPSG:32610")
    return o.select("tile_id", micro(geo.ground_gsd_m(F.col("px"), crs, F.col("oy"))).alias("gsd_m"))


RING_SQL = ("[{'x': minx, 'y': miny}, {'x': maxx, 'y': miny}, {'x': maxx, 'y': maxy}, {'x': (minx + maxx) / 2e0, 'y': maxy}, {'x': minx, 'y': (miny + maxy) / 2e0}]")


def with_ring(df):
    """A pentagon inside the box: one corner cut off."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b, c, d = (F.col(n) for n in BOX)
    return df.withColumn("ring", F.array(p(a, b), p(c, b), p(c, d), p((a + c) / 2.0, d), p(a, (b + d) / 2.0)))


_W, _H = "(maxx - minx)", "(maxy - miny)"
_PER = f"({_W} * 1.5e0 + {_H} * 1.5e0 + sqrt({_W} * {_W} + {_H} * {_H}) / 2e0)"
_PTS = "[minx, maxx, maxx, (minx + maxx) / 2e0, minx, minx]", "[miny, miny, maxy, maxy, (miny + maxy) / 2e0, miny]"


@query("b12_polygon_scalars", ctes("arrays", extra=f"""r as (select *, {_PTS[0]} as xs, {_PTS[1]} as ys from arrays),
 u as (select array_id, unnest(xs) as x, unnest(ys) as y from r),
 pc as (select array_id, var_pop(x) * 6 as xx, var_pop(y) * 6 as yy, covar_pop(x, y) * 6 as xy from u group by 1)""")
       + f"""select r.array_id, {m6(f'{_W} * {_H} * 0.875e0')} as area, {m6(_PER)} as perimeter, {m6(f'4e0 * 3.141592653589793e0 * ({_W} * {_H} * 0.875e0) / power({_PER}, 2)')} as compactness,
 {m6(f'greatest({_W}, {_H}) / least({_W}, {_H})')} as aspect, 1e0 as hull_ratio, {m6('(degrees(0.5e0 * atan2(2e0 * xy, xx - yy)) + 180e0) % 180e0')} as orientation_deg from r join pc on r.array_id = pc.array_id""")
def _(t):
    a = with_ring(t.sql("arrays"))
    ring = F.col("ring")
    a = a.withColumns({"area": geo.ring_area(ring), "perimeter": geo.ring_perimeter(ring), "hull": geo.convex_hull(ring)})
    return a.select("array_id", micro(F.col("area")).alias("area"), micro(F.col("perimeter")).alias("perimeter"),
                    micro(geo.compactness(F.col("area"), F.col("perimeter"))).alias("compactness"),
                    micro(geo.aspect_ratio(*[F.col(c) for c in BOX])).alias("aspect"),
                    micro(F.col("area") / geo.ring_area(F.col("hull"))).alias("hull_ratio"),
                    micro(geo.principal_axis_deg(F.col("hull"))).alias("orientation_deg"))


@query("b14_interior_point", ctes("arrays") + f"select array_id, {m6('(minx + maxx) / 2e0')} as px, {m6('(miny + maxy) / 2e0')} as py, true as inside from arrays")
def _(t):
    """Scanline point of each ring; at mid-height the cut corner starts exactly at the left edge."""
    a = with_ring(t.sql("arrays"))
    x, y = geo.interior_point(F.col("ring"))
    a = a.withColumns({"px": x, "py": y})
    return a.select("array_id", micro(F.col("px")).alias("px"), micro(F.col("py")).alias("py"),
                    geo.point_in_ring(F.col("px"), F.col("py"), F.col("ring")).alias("inside"))


@query("b30_coordinate_rounding", ctes("arrays") + f"select array_id, round_even((minx + 0.123456e0) * 1e3, 0) / 1e3 as x0, round_even((maxy + 0.654321e0) * 1e3, 0) / 1e3 as y2 from arrays")
def _(t):
    a = with_ring(t.sql("arrays")).withColumn("ring", geo.transform_ring(F.col("ring"), lambda x, y: (x + 0.123456, y + 0.654321)))
    a = a.withColumn("ring", geo.round_ring(F.col("ring"), 3))
    return a.select("array_id", F.col("ring")[0]["x"].alias("x0"), F.col("ring")[2]["y"].alias("y2"))


@query("b31_stable_ids", ctes("arrays", extra="""k as (select array_id, area_m2, cast(round_even((minx + maxx) / 2e0, 0) as bigint) as qx, cast(round_even((miny + maxy) / 2e0, 0) as bigint) as qy from arrays),
 h as (select *, substr(sha256('site|' || qx::varchar || '|' || qy::varchar), 1, 12) as base from k),
 r as (select *, row_number() over (partition by base order by area_m2 desc, array_id) - 1 as rk from h)""")
       + "select array_id, case when rk = 0 then base else substr(sha256(base || '|' || rk::varchar), 1, 12) end as stable_id from r")
def _(t):
    from dustledger.operators.identity import stable_ids

    a = t.sql("arrays").withColumns({"cx": (F.col("minx") + F.col("maxx")) / 2.0, "cy": (F.col("miny") + F.col("maxy")) / 2.0})
    return stable_ids(a, "array_id", "cx", "cy", "area_m2", "site").select("array_id", "stable_id")


# ---- C: joins ---------------------------------------------------------------------------------------------------
_PIP = "hit as (select a.array_id, min(p.parcel_no) as parcel_no from arrays a join parcels p on (a.minx + a.maxx) / 2e0 >= p.minx and (a.minx + a.maxx) / 2e0 < p.maxx and (a.miny + a.maxy) / 2e0 >= p.miny and (a.miny + a.maxy) / 2e0 < p.maxy group by 1)"


@query("c3_point_in_polygon", ctes("arrays", "parcels", extra=_PIP) + "select a.array_id, h.parcel_no from arrays a left join hit h on a.array_id = h.array_id")
def _(t):
    a = t.sql("arrays").withColumns({"x": (F.col("minx") + F.col("maxx")) / 2.0, "y": (F.col("miny") + F.col("maxy")) / 2.0})
    return SP.points_in_polygons(a, t.sql("parcels"), "array_id", "parcel_no", 50.0, ring=None).select("array_id", "parcel_no")


@query("c4_intersecting_pairs_iou", ctes("arrays", "parcels") + f"select a.array_id, p.parcel_no, {m6(_iou_sql('a', 'p'))} as iou from arrays a join parcels p on a.minx <= p.maxx and p.minx <= a.maxx and a.miny <= p.maxy and p.miny <= a.maxy")
def _(t):
    pairs = SP.box_pairs(t.sql("arrays"), t.sql("parcels"), "array_id", "parcel_no", 50.0)
    return pairs.select(F.col("l").alias("array_id"), F.col("r").alias("parcel_no"), micro(geo.box_iou(SP.left_box(), SP.right_box())).alias("iou"))


# the upper edge of a pentagon rises from the middle of its left side to the middle of its top, so the overlap of two is an
# integral over x of a function that is linear between these abscissae
_UPPER = "least({0}.maxy, ({0}.miny + {0}.maxy) / 2e0 + (x - {0}.minx) * ({0}.maxy - {0}.miny) / ({0}.maxx - {0}.minx))"
_BENDS = ", ".join(f"greatest(lo, least(hi, {e}))" for e in (
    "(a.minx + a.maxx) / 2e0", "(b.minx + b.maxx) / 2e0", "case when sa <> sb then (ob - oa) / (sa - sb) end", "(b.maxy - oa) / sa", "(a.maxy - ob) / sb", "(low - oa) / sa", "(low - ob) / sb"))


@query("b16_polygon_iou", ctes("arrays", extra=f"""c as (select a, b, greatest(a.minx, b.minx) as lo, least(a.maxx, b.maxx) as hi, greatest(a.miny, b.miny) as low,
   (a.maxy - a.miny) / (a.maxx - a.minx) as sa, (b.maxy - b.miny) / (b.maxx - b.minx) as sb,
   (a.miny + a.maxy) / 2e0 - a.minx * (a.maxy - a.miny) / (a.maxx - a.minx) as oa, (b.miny + b.maxy) / 2e0 - b.minx * (b.maxy - b.miny) / (b.maxx - b.minx) as ob
   from arrays a join arrays b on a.array_id < b.array_id and a.minx <= b.maxx and b.minx <= a.maxx and a.miny <= b.maxy and b.miny <= a.maxy),
 x as (select *, list_sort(list_distinct([lo, hi, {_BENDS}])) as xs from c),
 f as (select *, list_transform(xs, lambda x: greatest(0e0, least({_UPPER.format('a')}, {_UPPER.format('b')}) - low)) as fs from x),
 i as (select a, b, coalesce(list_sum(list_transform(range(1, len(xs)), lambda k: (xs[k + 1] - xs[k]) * (fs[k] + fs[k + 1]) / 2e0)), 0e0) as area from f),
 u as (select *, 0.875e0 * (a.maxx - a.minx) * (a.maxy - a.miny) + 0.875e0 * (b.maxx - b.minx) * (b.maxy - b.miny) - area as whole from i)""")
       + f"select a.array_id as a_id, b.array_id as b_id, {m6('area / whole')} as iou from u")
def _(t):
    """IoU of overlapping pentagons; the candidates come from the grid join."""
    a = with_ring(t.sql("arrays"))
    pairs = SP.box_pairs(a, a, "array_id", "array_id", 50.0).filter("l < r").select("l", "r")
    rings = a.select("array_id", "ring")
    j = (pairs.join(rings.withColumnsRenamed({"array_id": "l", "ring": "ring_a"}), "l")
         .join(rings.withColumnsRenamed({"array_id": "r", "ring": "ring_b"}), "r"))
    return j.select(F.col("l").alias("a_id"), F.col("r").alias("b_id"), micro(overlay.polygon_iou(F.col("ring_a"), F.col("ring_b"))).alias("iou"))


_SEG = "seg as (select s_suppkey as sid, (s_suppkey * 131) % 1500 + 0e0 as x0, (s_suppkey * 173) % 700 + 0e0 as y0, (s_suppkey * 131) % 1500 + s_nationkey * 4e0 as x1, (s_suppkey * 173) % 700 + 60e0 as y1 from supplier)"


def _segments(t):
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    return t.read("supplier").select((s * 131 % 1500).cast("double").alias("x0"), (s * 173 % 700).cast("double").alias("y0"),
                                     (s * 131 % 1500 + n * 4.0).alias("x1"), (s * 173 % 700 + 60.0).alias("y1"))


@query("c5_nearest_feature_capped", ctes("arrays", extra=_SEG + """, d as (select a.array_id, s.*, (a.minx + a.maxx) / 2e0 as px, (a.miny + a.maxy) / 2e0 as py from arrays a left join seg s on true),
 e as (select *, greatest(0e0, least(1e0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) as s from d)""")
       + f"select array_id, {m6('least(120e0, min(sqrt(power(px - (x0 + s * (x1 - x0)), 2) + power(py - (y0 + s * (y1 - y0)), 2))))')} as distance from e group by 1")
def _(t):
    a = t.sql("arrays").withColumns({"x": (F.col("minx") + F.col("maxx")) / 2.0, "y": (F.col("miny") + F.col("maxy")) / 2.0})
    return _round(SP.nearest_segment_distance(a, _segments(t), "array_id", 120.0), "distance")


_PT = "pt as (select c_custkey as pid, cast(floor(c_custkey / 750e0) as bigint) * 800 + (c_custkey * 311) % 750 + 0.5e0 as x, (c_custkey * 577) % 740 + 0.5e0 as y, 2015 + c_custkey % 10 as yr from customer)"


def permit_points(t):
    c = F.col("c_custkey")
    return t.read("customer").select(c.alias("pid"), (F.floor(c / 750.0) * 800 + c * 311 % 750 + 0.5).alias("x"), (c * 577 % 740 + 0.5).alias("y"),
                                     (F.lit(2015) + c % 10).alias("yr"))


_NEAR = "nd as (select pid, x, y, yr, min(sqrt(power(greatest(0e0, a.minx - x, x - a.maxx), 2) + power(greatest(0e0, a.miny - y, y - a.maxy), 2))) as distance from pt join arrays a on true group by all)"


@query("c6_nearest_uncapped", ctes("arrays", extra=_PT + ", " + _NEAR) + f"select pid, {m6('distance')} as distance from nd")
def _(t):
    return _round(SP.nearest_box_distance(permit_points(t), t.sql("arrays"), "pid", 30.0), "distance")


@query("c6_tolerance_sweep", ctes("arrays", extra=_PT + ", " + _NEAR) + "select tol, count(*) as n, cast(sum(case when distance <= tol then 1 else 0 end) as bigint) as n_within from nd, (values (10), (15), (20), (25), (30)) v(tol) group by 1")
def _(t):
    d = SP.nearest_box_distance(permit_points(t), t.sql("arrays"), "pid", 30.0)
    d = d.withColumn("tol", F.explode(F.array(*[F.lit(x) for x in (10, 15, 20, 25, 30)])))
    return d.groupBy("tol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("distance") <= F.col("tol"), 1).otherwise(0)).alias("n_within"))


@query("c7_neighbour_features", ctes("arrays", extra=f"p as (select a.array_id, b.area_m2, {_gap_sql('a', 'b')} as gap from arrays a join arrays b on a.array_id <> b.array_id and b.minx <= a.maxx + 100 and a.minx <= b.maxx + 100 and b.miny <= a.maxy + 100 and a.miny <= b.maxy + 100), g as (select array_id, count(case when gap <= 50 then 1 end) as n_near, count(*) as n_far, min(gap) as nearest_m, avg(area_m2) as mean_area_far from p where gap <= 100 group by 1)")
       + f"select a.array_id, coalesce(n_near, 0) as n_near, coalesce(n_far, 0) as n_far, {m6('nearest_m')} as nearest_m, {m6('mean_area_far')} as mean_area_far from arrays a left join g on a.array_id = g.array_id")
def _(t):
    return _round(SP.neighbour_features(t.sql("arrays"), "array_id"), "nearest_m", "mean_area_far")


_CC = """ed as (select a.array_id as u, b.array_id as v from {src} a join {src} b on a.array_id <> b.array_id and b.minx <= a.maxx + 2.5 and a.minx <= b.maxx + 2.5 and b.miny <= a.maxy + 2.5 and a.miny <= b.maxy + 2.5 where """ + _gap_sql("a", "b") + """ <= 2.5),
 cc(node, reach) as (select array_id, array_id from {src} union select c.node, e.v from cc c join ed e on e.u = c.reach),
 comp as (select node, min(reach) as component from cc group by 1)"""


def _recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


@query("c8_proximity_clusters", _recursive(ctes("arrays", extra=_CC.format(src="arrays")) + "select node as array_id, component from comp"))
def _(t):
    return CC.proximity_clusters(t.sql("arrays"), "array_id")


_SITES = _PIP + ", off as (select * from arrays where array_id not in (select array_id from hit)), " + _CC.format(src="off") + """,
 st as (select array_id, 'apn:' || parcel_no::varchar as site_id, 'parcel' as site_source from hit union all select node, 'prox:' || component::varchar, 'proximity' from comp)"""


def site_assignment(t):
    return CC.assign_sites(t.sql("arrays"), t.sql("parcels"), "array_id", "parcel_no")


@query("c9_site_assignment", _recursive(ctes("arrays", "parcels", extra=_SITES) + "select * from st"))
def _(t):
    return site_assignment(t)


@query("d3_cluster_diagnostics", _recursive(ctes("arrays", "parcels", extra=_SITES + ", g as (select site_id, any_value(site_source) as src, count(*) as n from st group by 1)")
       + f"select count(*) as n_sites, cast(sum(n) as bigint) as n_polygons, {m6('avg(n)')} as mean_per_site, {m6('quantile_cont(n, 0.5)')} as median_per_site, max(n) as max_per_site, {m6('100e0 * avg(case when n > 1 then 1e0 else 0e0 end)')} as pct_multi, {m6('sum(n) * 1e0 / count(*)')} as fragmentation, count(case when src = 'parcel' then 1 end) as n_parcel, count(case when src = 'proximity' then 1 end) as n_proximity from g"))
def _(t):
    from dustledger.operators.rollup import cluster_diagnostics

    return _round(cluster_diagnostics(site_assignment(t)), "mean_per_site", "median_per_site", "pct_multi", "fragmentation")


@query("d22_dissolved_area", _recursive(ctes("arrays", extra=_CC.format(src="arrays") + """, m as (select a.*, c.component from arrays a join comp c on a.array_id = c.node),
 xs as (select distinct component, unnest([minx, maxx]) as x from m), sx as (select *, lead(x) over (partition by component order by x) as x2 from xs),
 ys as (select distinct component, unnest([miny, maxy]) as y from m), sy as (select *, lead(y) over (partition by component order by y) as y2 from ys),
 cells as (select sx.component, x, x2, y, y2 from sx join sy on sx.component = sy.component where x2 is not null and y2 is not null)""")
       + f"select component, {m6('sum((x2 - x) * (y2 - y))')} as union_area from cells c where exists (select 1 from m where m.component = c.component and m.minx <= c.x and m.maxx >= c.x2 and m.miny <= c.y and m.maxy >= c.y2) group by 1"))
def _(t):
    a = t.sql("arrays")
    m = a.join(CC.proximity_clusters(a, "array_id"), "array_id")
    return _round(CC.dissolved_area(m, "component"), "union_area")


_SIDE = "(b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)"


@query("d23_cluster_hulls", _recursive(ctes("arrays", extra=_CC.format(src="arrays") + f""", m as (select a.*, c.component from arrays a join comp c on a.array_id = c.node),
 pt as (select distinct component, p.x as x, p.y as y from (select component, unnest({RING_SQL}) as p from m)),
 he as (select a.component, a.x as ax, a.y as ay, b.x as bx, b.y as byy from pt a join pt b on a.component = b.component and (a.x <> b.x or a.y <> b.y) join pt c on c.component = a.component
   group by all having count(case when {_SIDE} < 0 or ({_SIDE} = 0 and ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 or (c.x - b.x) * (a.x - b.x) + (c.y - b.y) * (a.y - b.y) < 0)) then 1 end) = 0)"""))
       + f"select component, cast(count(*) as int) as n_vertices, {m6('abs(sum(ax * byy - bx * ay)) / 2e0')} as hull_area from he group by 1")
def _(t):
    a = with_ring(t.sql("arrays"))
    h = CC.component_hulls(a.join(CC.proximity_clusters(a, "array_id"), "array_id"), "component")
    return h.select("component", F.size("ring").alias("n_vertices"), micro(geo.ring_area(F.col("ring"))).alias("hull_area"))


@query("c10_identity_carry_over", _recursive(ctes("arrays", extra=f"""cur as (select array_id + 1000000000 as id, minx + array_id % 7 * 0.6e0 as minx, miny, maxx + array_id % 7 * 0.6e0 as maxx, maxy from arrays where array_id % 10 <> 0),
 cand as (select c.id as l, a.array_id as r, {_iou_sql('c', 'a')} as iou, a.array_id // 1000 as blk from cur c join arrays a on c.minx <= a.maxx and a.minx <= c.maxx and c.miny <= a.maxy and a.miny <= c.maxy where {_iou_sql('c', 'a')} >= 0.3),
 rk as (select *, row_number() over (partition by blk order by iou desc, l, r) as k from cand),
 st(blk, k, ul, ur, l, r, taken) as (select distinct blk, 0::bigint, []::bigint[], []::bigint[], null::bigint, null::bigint, false from cand
   union all select s.blk, s.k + 1, case when f then list_append(s.ul, r.l) else s.ul end, case when f then list_append(s.ur, r.r) else s.ur end, r.l, r.r, f
   from (select s.*, not list_contains(s.ul, r.l) and not list_contains(s.ur, r.r) as f from st s join rk r on r.blk = s.blk and r.k = s.k + 1) s join rk r on r.blk = s.blk and r.k = s.k + 1),
 settled as (select l, r from st where taken),
 lp as (select id as l, (minx + maxx) / 2e0 as x, (miny + maxy) / 2e0 as y from cur where id not in (select l from settled)),
 nr as (select lp.l, a.array_id as r, sqrt(power(abs(lp.x - (a.minx + a.maxx) / 2e0), 2) + power(abs(lp.y - (a.miny + a.maxy) / 2e0), 2)) as d from lp join arrays a on abs(lp.x - (a.minx + a.maxx) / 2e0) <= 5 and abs(lp.y - (a.miny + a.maxy) / 2e0) <= 5),
 one as (select *, row_number() over (partition by l order by d, r) as rn from nr where d <= 5),
 two as (select *, row_number() over (partition by r order by d, l) as rm from one where rn = 1 and r not in (select r from settled)),
 pr as (select * from settled union all select l, r from two where rm = 1)""")) + """select cur.id as curr_id, pr.r as prev_id, case when pr.r is not null then 'matched' else 'new' end as status from cur left join pr on pr.l = cur.id
 union all select null, array_id, 'dropped' from arrays where array_id not in (select r from pr)""")
def _(t):
    """Two detection runs: the second is shifted by up to 3.6 m and misses every tenth array."""
    prev = t.sql("arrays").select("array_id", *BOX)
    dx = F.col("array_id") % 7 * 0.6
    curr = prev.filter("array_id % 10 <> 0").select((F.col("array_id") + 1000000000).alias("new_id"), (F.col("minx") + dx).alias("minx"), "miny",
                                                    (F.col("maxx") + dx).alias("maxx"), "maxy")
    return MA.carry_identity(prev, curr, "array_id", "new_id", 50.0)


_STN = "stn as (select s_suppkey as station, 33e0 + (s_suppkey * 37 % 900) / 100e0 as lat, -124e0 + (s_suppkey * 53 % 1000) / 100e0 as lon, s_acctbal as loss from supplier), sysm as (select c_custkey as sys, 33e0 + (c_custkey * 71 % 900) / 100e0 as lat, -124e0 + (c_custkey * 89 % 1000) / 100e0 as lon from customer)"


def _stations(t):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    stn = t.read("supplier").select(s.alias("station"), (33.0 + s * 37 % 900 / 100.0).alias("lat"), (-124.0 + s * 53 % 1000 / 100.0).alias("lon"), F.col("s_acctbal").alias("loss"))
    sysm = t.read("customer").select(c.alias("sys"), (33.0 + c * 71 % 900 / 100.0).alias("lat"), (-124.0 + c * 89 % 1000 / 100.0).alias("lon"))
    return stn, sysm


@query("c12_system_station_pairs", f"""with {_STN}, p as (select sys, station, stn.loss, 2e0 * 6371000e0 * asin(least(1e0, sqrt(power(sin((radians(stn.lat) - radians(sysm.lat)) / 2e0), 2)
  + cos(radians(sysm.lat)) * cos(radians(stn.lat)) * power(sin(radians(stn.lon - sysm.lon) / 2e0), 2)))) / 1000e0 as km from sysm join stn on abs(sysm.lat - stn.lat) < 1),
 r as (select *, row_number() over (partition by sys order by km, station) as rn from p where km <= 20) select sys, station, {m6('km')} as km, loss from r where rn = 1""")
def _(t):
    stn, sysm = _stations(t)
    return _round(SP.nearest_station(sysm, stn, "sys", "station", 20.0), "km").join(stn.select("station", "loss"), "station").select("sys", "station", "km", "loss")


@query("c11_nearest_key_with_tolerance", f"""with {_STN}, p as (select sys, station, power(sysm.lat - stn.lat, 2) + power(sysm.lon - stn.lon, 2) as d2 from sysm join stn on abs(sysm.lat - stn.lat) <= 0.2),
 r as (select *, row_number() over (partition by sys order by d2, station) as rn from p where d2 < 0.2e0 * 0.2e0) select sysm.sys, r.station from sysm left join (select * from r where rn = 1) r on r.sys = sysm.sys""")
def _(t):
    stn, sysm = _stations(t)
    return SP.nearest_key(sysm, stn.select("station", "lat", "lon"), "sys", "station", 0.2).select("sys", "station")


_AUDIT = _PT + ", " + _NEAR + """, fp as (select * from nd where y <= 700), dt as (select *, distance <= 15 as detected from fp),
 da as (select distinct parcel_no from hit where parcel_no is not null)"""


@query("d21_recall_audit", ctes("arrays", "parcels", extra=_PIP + ", " + _AUDIT + """, x as (select *, exists (select 1 from da where da.parcel_no = dt.pid) as apn_detected from dt),
 s as (select count(*) as n, count(case when detected then 1 end) as found, count(case when yr <= 2022 then 1 end) as n_era, count(case when yr <= 2022 and detected then 1 end) as found_era,
   count(case when not detected and yr <= 2022 then 1 end) as real_miss, count(case when not detected and yr > 2022 then 1 end) as post_imagery, count(case when apn_detected then 1 end) as found_apn from x)""")
       + f"select *, {m6('found * 1e0 / n')} as recall, {m6('found_era * 1e0 / n_era')} as recall_era from s")
def _(t):
    from dustledger.operators.rollup import recall_audit

    pts = permit_points(t).filter("y <= 700")
    dist = SP.nearest_box_distance(pts, t.sql("arrays"), "pid", 30.0)
    a = t.sql("arrays").withColumns({"x": (F.col("minx") + F.col("maxx")) / 2.0, "y": (F.col("miny") + F.col("maxy")) / 2.0})
    parcels = SP.points_in_polygons(a, t.sql("parcels"), "array_id", "parcel_no", 50.0, ring=None).select(F.col("parcel_no").alias("pid")).filter("pid IS NOT NULL").distinct()
    audited = pts.join(dist, "pid").join(parcels.withColumn("apn_detected", F.lit(True)), "pid", "left").withColumn("apn_detected", F.coalesce("apn_detected", F.lit(False)))
    return _round(recall_audit(audited), "recall", "recall_era")


@query("d21_miss_queue", ctes("arrays", "parcels", extra=_PIP + ", " + _AUDIT)
       + f"select pid, yr, exists (select 1 from da where da.parcel_no = dt.pid) as apn_detected, {m6('distance')} as distance from dt where not detected and yr <= 2022")
def _(t):
    pts = permit_points(t).filter("y <= 700")
    dist = SP.nearest_box_distance(pts, t.sql("arrays"), "pid", 30.0).filter("distance > 15")
    a = t.sql("arrays").withColumns({"x": (F.col("minx") + F.col("maxx")) / 2.0, "y": (F.col("miny") + F.col("maxy")) / 2.0})
    parcels = SP.points_in_polygons(a, t.sql("parcels"), "array_id", "parcel_no", 50.0, ring=None).select(F.col("parcel_no").alias("pid"), F.lit(True).alias("hit")).filter("pid IS NOT NULL").distinct()
    q = pts.filter("yr <= 2022").join(dist, "pid").join(parcels, "pid", "left")
    return q.select("pid", "yr", F.coalesce("hit", F.lit(False)).alias("apn_detected"), micro(F.col("distance")).alias("distance"))


# ---- G: matching ---------------------------------------------------------------------------------------------------
_CAND = f"cand as (select p.det_id, t.gt_id, {_iou_sql('p', 't')} as iou from preds p join truths t on p.tile_id = t.tile_id where {_iou_sql('p', 't')} >= 0.5)"
_GREEDY = _CAND + """, rk as (select tile_id, det_id, row_number() over (partition by tile_id order by score desc, det_id) as k from preds),
 st(tile_id, k, used, det_id, gt_id) as (select distinct tile_id, 0::bigint, []::bigint[], null::bigint, null::bigint from preds
   union all select s.tile_id, s.k + 1, case when b.gt is null then s.used else list_append(s.used, b.gt) end, r.det_id, b.gt
   from st s join rk r on r.tile_id = s.tile_id and r.k = s.k + 1
   left join lateral (select arg_min(c.gt_id, {'k': -c.iou, 'g': c.gt_id}) as gt from cand c where c.det_id = r.det_id and not list_contains(s.used, c.gt_id)) b on true)"""


@query("g1_greedy_detection_matching", _recursive(ctes("preds", "truths", extra=_GREEDY) + f"""select p.tile_id, case when s.gt_id is not null then 'tp' else 'fp' end as class, p.det_id, s.gt_id, {m6('c.iou')} as iou
 from preds p join st s on s.det_id = p.det_id left join cand c on c.det_id = s.det_id and c.gt_id = s.gt_id
 union all select tile_id, 'fn', null, gt_id, null from truths where gt_id not in (select gt_id from st where gt_id is not null)"""))
def _(t):
    return _round(MA.match_detections(t.sql("preds"), t.sql("truths")), "iou").drop("score")


@query("d6_confusion_totals", _recursive(ctes("preds", "truths", extra=_GREEDY + """, m as (select t.split, count(s.gt_id) as tp, count(*) - count(s.gt_id) as fn from truths t left join (select gt_id from st where gt_id is not null) s on s.gt_id = t.gt_id group by 1),
 f as (select case when tile_id % 3 = 0 then 'val' else 'test' end as split, count(*) as fp from st where det_id is not null and gt_id is null group by 1)""")
       + f"select m.split, tp, fp, fn, {m6('tp * 1e0 / (tp + fp)')} as precision, {m6('tp * 1e0 / (tp + fn)')} as recall, {m6('2e0 * tp / (2 * tp + fp + fn)')} as f1 from m join f on m.split = f.split"))
def _(t):
    m = MA.match_detections(t.sql("preds"), t.sql("truths")).withColumn("split", F.when(F.col("tile_id") % 3 == 0, "val").otherwise("test"))
    return _round(MA.confusion(m, ("split",)), "precision", "recall", "f1")


@query("g2_non_maximum_suppression", _recursive(ctes("preds", extra=f"""ov as (select p.det_id as worse, q.det_id as better from preds p join preds q on p.tile_id = q.tile_id and p.det_id <> q.det_id and (q.score > p.score or (q.score = p.score and q.det_id < p.det_id)) where {_iou_sql('p', 'q')} >= 0.3),
 rk as (select tile_id, det_id, row_number() over (partition by tile_id order by score desc, det_id) as k from preds),
 st(tile_id, k, kept) as (select distinct tile_id, 0::bigint, []::bigint[] from preds
   union all select s.tile_id, s.k + 1, case when b.n > 0 then s.kept else list_append(s.kept, r.det_id) end from st s join rk r on r.tile_id = s.tile_id and r.k = s.k + 1
   left join lateral (select count(*) as n from ov where ov.worse = r.det_id and list_contains(s.kept, ov.better)) b on true),
 fin as (select tile_id, arg_max(kept, k) as kept from st group by 1)""") + "select tile_id, unnest(kept) as det_id from fin"))
def _(t):
    return MA.suppress_overlaps(t.sql("preds"), 0.3)


@query("g4_tile_disagreement", ctes("preds", "truths", extra=f"""pr as (select p.tile_id, p.det_id, t.gt_id, {_iou_sql('p', 't')} as iou, (least(p.maxx, t.maxx) - greatest(p.minx, t.minx)) * (least(p.maxy, t.maxy) - greatest(p.miny, t.miny)) as inter
   from preds p join truths t on p.tile_id = t.tile_id and p.minx < t.maxx and t.minx < p.maxx and p.miny < t.maxy and t.miny < p.maxy),
 a as (select tile_id, count(*) as n_pred, sum((maxx - minx) * (maxy - miny)) as pa, count(case when score >= 0.5 and det_id not in (select det_id from pr) then 1 end) as confident_fps from preds group by 1),
 b as (select t.tile_id, count(*) as n_label, sum((maxx - minx) * (maxy - miny)) as ta, count(case when coalesce(best, 0) < 0.3 then 1 end) as uncovered from truths t left join (select gt_id, max(iou) as best from pr group by 1) x on x.gt_id = t.gt_id group by 1),
 c as (select coalesce(a.tile_id, b.tile_id) as tile_id, coalesce(n_pred, 0) as n_pred, coalesce(n_label, 0) as n_label, coalesce(confident_fps, 0) as confident_fps, coalesce(uncovered, 0) as uncovered, coalesce(pa, 0) as pa, coalesce(ta, 0) as ta from a full join b on a.tile_id = b.tile_id),
 d as (select c.*, coalesce(i, 0) / (pa + ta - coalesce(i, 0)) as overall_iou from c left join (select tile_id, sum(inter) as i from pr group by 1) y on y.tile_id = c.tile_id)""")
       + f"""select tile_id, n_pred, n_label, confident_fps, uncovered, {m6('overall_iou')} as overall_iou, confident_fps + uncovered as disagreement_score,
 case when overall_iou >= 0.5 and confident_fps = 0 and uncovered = 0 then 'agree' when confident_fps > 0 and uncovered = 0 and n_label = 0 then 'confident_FP' when uncovered > 0 and confident_fps = 0 then 'confident_FN'
  when confident_fps > 0 and uncovered > 0 then 'both_directions' when confident_fps > 0 and n_label > 0 then 'confident_FP' else 'noisy' end as bucket from d""")
def _(t):
    return _round(MA.tile_disagreement(t.sql("preds"), t.sql("truths")), "overall_iou")


# ---- D6-D8, B4, B5 on per-detection rows -----------------------------------------------------------------------------
_DIMS = {"size": "case when coalesce(gt_area_px, pred_area_px) < 800 then 'small_lt800' when coalesce(gt_area_px, pred_area_px) < 4000 then 'medium_800_4000' when coalesce(gt_area_px, pred_area_px) is not null then 'large_ge4000' else 'unknown' end",
         "edge": "case when distance_to_image_edge_px < 40 then 'near_lt40' when distance_to_image_edge_px < 120 then 'mid_40_120' when distance_to_image_edge_px is not null then 'far_ge120' else 'unknown' end",
         "density": "case when num_other_panels_in_tile = 0 then 'alone' when num_other_panels_in_tile < 4 then 'few_1_3' when num_other_panels_in_tile is not null then 'crowded_ge4' else 'unknown' end", "overall": "'all'"}
_CNT = "count(case when class = 'tp' then 1 end) as tp, count(case when class = 'fp' then 1 end) as fp, count(case when class = 'fn' then 1 end) as fn"


@query("d7_failure_buckets", ctes("labelled", extra="u as (" + " union all ".join(f"select '{d}' as dim, {e} as bucket, {_CNT} from labelled group by 2" for d, e in _DIMS.items()) + ")")
       + f"select dim, bucket, tp, fp, fn, {m6('fn * 1e0 / nullif(tp + fn, 0)')} as fn_rate, {m6('tp * 1e0 / nullif(tp + fp, 0)')} as precision from u")
def _(t):
    return _round(MA.failure_buckets(t.sql("labelled")), "fn_rate", "precision")


@query("d8_worst_tiles", ctes("labelled", extra=f"g as (select tile_id, {_CNT}, avg(case when class = 'tp' then iou end) as mi from labelled group by 1)")
       + f"select tile_id, tp, fp, fn, {m6('mi')} as mean_iou, fp + fn as errors from g order by fp + fn desc, tile_id limit 10")
def _(t):
    return _round(MA.worst_tiles(t.sql("labelled")), "mean_iou")


@query("b4_row_predicate", ctes("labelled") + "select det_id, class, score, gt_area_px from labelled where class = 'fn' and gt_area_px < 4000 and score >= 0.5")
def _(t):
    from dustledger.functions.text import row_predicate

    return t.sql("labelled").filter(row_predicate("class=fn AND gt_area_px<4000 AND score>=0.5")).select("det_id", "class", "score", "gt_area_px")


@query("b5_bucket_presets", ctes("labelled", extra="u as (" + " union all ".join(
    f"select * from (select '{n}' as preset, det_id, tile_id, {c} as rank_value from labelled where {w} order by {c} {'desc' if d else 'asc'} nulls last, det_id, tile_id, score limit 20) x{i}" for i, (n, (w, c, d)) in enumerate(MA.BUCKETS.items())) + ")") + f"select preset, det_id, tile_id, {m6('rank_value')} as rank_value from u")
def _(t):
    out = None
    for name, (_, col, _d) in MA.BUCKETS.items():
        b = MA.bucket_rows(t.sql("labelled"), name, 20, "det_id", "tile_id", "score").select(
            F.lit(name).alias("preset"), "det_id", "tile_id", micro(F.col(col)).alias("rank_value"))
        out = b if out is None else out.unionByName(b)
    return out


# ---- tiles and chips ---------------------------------------------------------------------------------------------------
@query("g3_chip_grid", """with t as (select p_partkey as tile_id, 500 + p_size * 20 as w, 480 + p_size * 17 as h from part),
 x as (select tile_id, h, unnest(list_distinct([0, greatest(0, w - 640)])) as ox from t), y as (select tile_id, ox, unnest(list_distinct([0, greatest(0, h - 640)])) as oy from x)
select tile_id, cast(ox as int) as ox, cast(oy as int) as oy from y""")
def _(t):
    from dustledger.operators.tiles import chip_origins

    tl = t.read("part").select(F.col("p_partkey").alias("tile_id"), (500 + F.col("p_size") * 20).alias("w"), (480 + F.col("p_size") * 17).alias("h"))
    return chip_origins(tl, "w", "h", 640).select("tile_id", "ox", "oy")


@query("g10_polygons_to_chips_clamped", ctes("arrays", "parcels") + f"""select a.array_id, p.parcel_no as chip_id, {m6('greatest(0e0, least(1e0, (a.minx - p.minx) / 25e0))')} as x0, {m6('greatest(0e0, least(1e0, (a.miny - p.miny) / 25e0))')} as y0,
 {m6('greatest(0e0, least(1e0, (a.maxx - p.minx) / 25e0))')} as x2 from arrays a join parcels p on a.minx <= p.maxx and p.minx <= a.maxx and a.miny <= p.maxy and p.miny <= a.maxy
where (greatest(0e0, least(1e0, (a.maxx - p.minx) / 25e0)) - greatest(0e0, least(1e0, (a.minx - p.minx) / 25e0))) * (greatest(0e0, least(1e0, (a.maxy - p.miny) / 25e0)) - greatest(0e0, least(1e0, (a.miny - p.miny) / 25e0))) > 0""")
def _(t):
    from dustledger.operators.tiles import clamp_to_chips

    c = clamp_to_chips(with_ring(t.sql("arrays")), t.sql("parcels"), "array_id", "parcel_no", 25.0)
    return c.select("array_id", F.col("parcel_no").alias("chip_id"), micro(F.col("ring")[0]["x"]).alias("x0"), micro(F.col("ring")[0]["y"]).alias("y0"), micro(F.col("ring")[1]["x"]).alias("x2"))


@query("g13_permit_seed_boxes", ctes("parcels", extra=_PT + """, h as (select pt.*, p.parcel_no as tile_id, p.minx, p.maxy, case when pid %% 4 <> 0 then (pid %% 90) / 10e0 end as kw from pt join parcels p on x >= p.minx and x < p.maxx and y >= p.miny and y < p.maxy),
 s as (select *, greatest(5e0, sqrt(case when kw > 0 then kw * %re0 else 28e0 end)) as side from h)""" % K.M2_PER_KW)
       + f"""select pid, tile_id, {m6('side')} as side_m, {m6('greatest(0e0, least(1e0, (x - side / 2e0 - minx) / 25e0))')} as nx1, {m6('greatest(0e0, least(1e0, (maxy - (y + side / 2e0)) / 25e0))')} as ny1,
 {m6('greatest(0e0, least(1e0, (x + side / 2e0 - minx) / 25e0))')} as nx2, {m6('greatest(0e0, least(1e0, (maxy - (y - side / 2e0)) / 25e0))')} as ny2, tile_id % 10 = 0 as in_eval_split from s""")
def _(t):
    from dustledger.operators.tiles import seed_boxes

    tiles = t.sql("parcels").withColumn("split", F.when(F.col("parcel_no") % 10 == 0, "val").otherwise("train"))
    pts = permit_points(t).withColumn("kw", F.when(F.col("pid") % 4 != 0, F.col("pid") % 90 / 10.0))
    s = seed_boxes(pts, tiles, "pid", "parcel_no", 50.0).withColumnRenamed("parcel_no", "tile_id")
    return _round(s.select("pid", "tile_id", "side_m", "nx1", "ny1", "nx2", "ny2", "in_eval_split"), "side_m", "nx1", "ny1", "nx2", "ny2")


# ---- rings, coverage and intervals -------------------------------------------------------------------------------
_CUT = "(p.minx - (p.minx + p.maxx) / 2e0) * (a.y - p.maxy) / ((p.miny + p.maxy) / 2e0 - p.maxy) + (p.minx + p.maxx) / 2e0"


@query("c3_point_in_ring", ctes("arrays", "parcels", extra=f"""c as (select array_id, (minx + maxx) / 2e0 as x, (miny + maxy) / 2e0 as y from arrays),
 hit as (select a.array_id, min(p.parcel_no) as parcel_no from c a join parcels p on a.x >= p.minx and a.x < p.maxx and a.y >= p.miny and a.y < p.maxy
   and (a.y < (p.miny + p.maxy) / 2e0 or a.x >= {_CUT}) group by 1)""") + "select c.array_id, h.parcel_no from c left join hit h on c.array_id = h.array_id")
def _(t):
    """Array centres in parcels that are true polygons (a corner is cut off)."""
    a = t.sql("arrays").withColumns({"x": (F.col("minx") + F.col("maxx")) / 2.0, "y": (F.col("miny") + F.col("maxy")) / 2.0})
    return SP.points_in_polygons(a, with_ring(t.sql("parcels")), "array_id", "parcel_no", 50.0, ring="ring").select("array_id", "parcel_no")


@query("b13_valid_geometry", ctes("arrays") + "select array_id, array_id % 4 = 0 as whole from arrays where array_id % 4 in (0, 3)")
def _(t):
    """Rings of no area, of two vertices and missing ones go; a thin but true one stays."""
    k = F.col("array_id") % 4
    a = with_ring(t.sql("arrays"))
    flat = F.transform("ring", lambda p: F.struct(p["x"].alias("x"), F.lit(1.0).alias("y")))
    ring = F.when(k == 0, F.col("ring")).when(k == 1, flat).when(k == 2, F.when(F.col("array_id") % 8 == 2, F.slice("ring", 1, 2))).otherwise(F.slice("ring", 1, 3))
    return a.withColumn("ring", ring).filter(geo.valid_ring(F.col("ring"))).select("array_id", (k == 0).alias("whole"))


@query("g3_covering_offsets", """with t as (select p_partkey as tile_id, 500 + p_size * 90 as w, 480 + p_size * 17 as h from part),
 x as (select tile_id, h, unnest(list_distinct(list_append(range(0, greatest(0, w - 640) + 1, 640), greatest(0, w - 640)))) as ox from t),
 y as (select tile_id, ox, unnest(list_distinct(list_append(range(0, greatest(0, h - 640) + 1, 640), greatest(0, h - 640)))) as oy from x)
select tile_id, cast(ox as int) as ox, cast(oy as int) as oy from y""")
def _(t):
    from dustledger.operators.tiles import covering_offsets

    tl = t.read("part").select(F.col("p_partkey").alias("tile_id"), (500 + F.col("p_size") * 90).alias("w"), (480 + F.col("p_size") * 17).alias("h"))
    return covering_offsets(tl, "w", "h", 640).select("tile_id", F.col("ox").cast("int").alias("ox"), F.col("oy").cast("int").alias("oy"))


@query("c15_unmatched_feedback", "select count(*) as n_unmatched from events where not exists (select 1 from part where p_partkey = user_id)")
def _(t):
    from dustledger.operators.lookup import unmatched_feedback

    return unmatched_feedback(t.read("events").withColumn("array_id", F.col("user_id")), t.read("part").select(F.col("p_partkey").alias("array_id")), "array_id")


@query("d21_recall_interval", ctes("arrays", extra=_PT + ", " + _NEAR + """, s as (select yr, count(*) as n, count(case when distance <= 15 then 1 end) as found from nd group by 1), p as (select *, found * 1e0 / n as p from s)""")
       + f"""select yr, n, found, {m6('greatest(0e0, (p + 1.96e0 * 1.96e0 / (2e0 * n)) / (1e0 + 1.96e0 * 1.96e0 / n) - 1.96e0 * sqrt(p * (1e0 - p) / n + 1.96e0 * 1.96e0 / (4e0 * n * n)) / (1e0 + 1.96e0 * 1.96e0 / n))')} as ci_lo,
 {m6('least(1e0, (p + 1.96e0 * 1.96e0 / (2e0 * n)) / (1e0 + 1.96e0 * 1.96e0 / n) + 1.96e0 * sqrt(p * (1e0 - p) / n + 1.96e0 * 1.96e0 / (4e0 * n * n)) / (1e0 + 1.96e0 * 1.96e0 / n))')} as ci_hi from p""")
def _(t):
    """Recall by permit year with its Wilson interval."""
    from dustledger.operators.rollup import recall_interval

    pts = permit_points(t)
    near = pts.join(SP.nearest_box_distance(pts, t.sql("arrays"), "pid", 30.0), "pid")
    per = near.groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("distance") <= 15).cast("long")).alias("found"))
    return _round(recall_interval(per), "ci_lo", "ci_hi").select("yr", "n", "found", "ci_lo", "ci_hi")


@query("d25_drop_sparse", "select c_custkey as site_id, c_acctbal as dense, case when c_custkey % 2 = 0 then c_nationkey end as half from customer")
def _(t):
    """Columns below the coverage floor go: one in ten rows is not enough, one in two is."""
    from dustledger.operators.rollup import drop_sparse

    k = F.col("c_custkey")
    f = t.read("customer").select(k.alias("site_id"), F.col("c_acctbal").alias("dense"), F.when(k % 2 == 0, F.col("c_nationkey")).alias("half"), F.when(k % 10 == 0, k).alias("rare"))
    return drop_sparse(f, 0.3)[0]
