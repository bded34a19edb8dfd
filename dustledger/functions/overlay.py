"""Distance, intersection and clipping of rings as column expressions, for concave rings too.

Rings are simple (no self-crossing), in any direction. Everything is built from higher-order functions, so it runs inside
the JVM next to the join that made the pair. Work is the product of the two rings' edges.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dustledger.functions import geo

EDGE = ("x0", "y0", "x1", "y1")


def edges(ring: Column) -> Column:
    """Array of (x0, y0, x1, y1), the closing edge included."""
    return geo._edges(ring)


def _with(values: dict[str, Column], body) -> Column:
    """``body`` of a struct of values, each of which is computed once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def _side(e: Column, x: Column, y: Column) -> Column:
    return (e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (x - e["x0"])


def segments_cross(e: Column, f: Column) -> Column:
    """Whether two segments cross inside both (touching ends have distance 0 anyway)."""
    return ((_side(e, f["x0"], f["y0"]) * _side(e, f["x1"], f["y1"]) < 0)
            & (_side(f, e["x0"], e["y0"]) * _side(f, e["x1"], e["y1"]) < 0))


def segment_gap(e: Column, f: Column) -> Column:
    """Distance of two segments."""
    ends = [geo.segment_distance(p[x], p[y], *[q[c] for c in EDGE]) for p, q in ((e, f), (f, e)) for x, y in (("x0", "y0"), ("x1", "y1"))]
    return F.when(segments_cross(e, f), F.lit(0.0)).otherwise(F.least(*ends))


def ring_gap(a: Column, b: Column) -> Column:
    """Distance of two polygons: 0 where they share a point, also where one lies inside the other."""
    nearest = _with({"a": edges(a), "b": edges(b)}, lambda t: F.array_min(F.transform(t["a"], lambda e: F.array_min(F.transform(t["b"], lambda f: segment_gap(e, f))))))
    inside = geo.point_in_ring(a[0]["x"], a[0]["y"], b) | geo.point_in_ring(b[0]["x"], b[0]["y"], a)
    return F.when(inside, F.lit(0.0)).otherwise(nearest)


def _runs(sides: Column, x: Column) -> Column:
    """Inner runs (lo, hi) of a ring on the vertical line at ``x``, which passes through no vertex."""
    hits = F.filter(sides, lambda e: (e["x0"] <= x) != (e["x1"] <= x))
    ys = F.array_sort(F.transform(hits, lambda e: e["y0"] + (x - e["x0"]) * (e["y1"] - e["y0"]) / (e["x1"] - e["x0"])))
    return F.zip_with(F.filter(ys, lambda _, i: i % 2 == 0), F.filter(ys, lambda _, i: i % 2 == 1), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))


def _crossing_x(e: Column, f: Column) -> Column:
    """x of the point where the lines of two crossing segments meet, else null."""
    p, q = _side(f, e["x0"], e["y0"]), _side(f, e["x1"], e["y1"])
    return F.when(segments_cross(e, f), e["x0"] + (e["x1"] - e["x0"]) * p / (p - q))


def intersection_area(a: Column, b: Column) -> Column:
    """Area shared by two rings, by trapezoids.

    Vertical lines through all vertices and crossings cut both rings into slabs in which no edges cross. There the shared
    length is linear, so its value in the middle times the width is the exact share of the slab.
    """
    def of(t: Column) -> Column:
        crossings = F.flatten(F.transform(t["a"], lambda e: F.filter(F.transform(t["b"], lambda f: _crossing_x(e, f)), lambda x: x.isNotNull())))
        xs = F.array_sort(F.array_distinct(F.concat(F.transform(t["a"], lambda e: e["x0"]), F.transform(t["b"], lambda e: e["x0"]), crossings)))
        slabs = F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.size(xs)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

        def share(slab: Column) -> Column:
            middle = (slab["x"] + slab["y"]) / 2.0
            length = _with({"p": _runs(t["a"], middle), "q": _runs(t["b"], middle)}, lambda r: F.aggregate(
                r["p"], F.lit(0.0), lambda acc, p: acc + F.aggregate(
                    r["q"], F.lit(0.0), lambda inner, q: inner + F.greatest(F.lit(0.0), F.least(p["hi"], q["hi"]) - F.greatest(p["lo"], q["lo"])))))
            return length * (slab["y"] - slab["x"])

        return F.aggregate(slabs, F.lit(0.0), lambda acc, slab: acc + share(slab))

    box_a, box_b = geo.ring_bbox(a), geo.ring_bbox(b)
    apart = (box_a[0] >= box_b[2]) | (box_b[0] >= box_a[2]) | (box_a[1] >= box_b[3]) | (box_b[1] >= box_a[3])
    whole = _with({"a": edges(a), "b": edges(b)}, of)
    return F.when((F.size(a) < 3) | (F.size(b) < 3) | apart, F.lit(0.0)).otherwise(whole)


def polygon_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two rings; 0 for rings without area."""
    def of(t: Column) -> Column:
        union = t["areas"] - t["shared"]
        return F.when(union > 0, t["shared"] / union).otherwise(F.lit(0.0))

    return _with({"shared": intersection_area(a, b), "areas": geo.ring_area(a) + geo.ring_area(b)}, of)


def _cut(ring: Column, axis: str, bound: Column, upper: bool) -> Column:
    """The part of a ring on one side of an axis-parallel line; parts of a concave ring stay joined along the line."""
    other = "y" if axis == "x" else "x"

    def kept(e: Column) -> Column:
        a, b = e[f"{axis}0"], e[f"{axis}1"]
        inside = lambda v: (v <= bound) if upper else (v >= bound)
        at = e[f"{other}0"] + (bound - a) * (e[f"{other}1"] - e[f"{other}0"]) / (b - a)
        crossing = {axis: bound, other: at}
        point = F.struct(crossing["x"].alias("x"), crossing["y"].alias("y"))
        end = F.struct(e["x1"].alias("x"), e["y1"].alias("y"))
        none = F.slice(F.array(end), 1, 0)
        enter = F.when((inside(a) != inside(b)) & (a != bound) & (b != bound), F.array(point)).otherwise(none)
        return F.concat(enter, F.when(inside(b), F.array(end)).otherwise(none))

    return F.flatten(F.transform(edges(ring), kept))


def clip_to_box(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Intersection of a ring with a rectangle, as one ring (empty where they are apart).

    A concave ring that falls into several parts keeps them joined by edges of no width along the rectangle's sides; the
    area is that of the parts.
    """
    for axis, bound, upper in (("x", minx, False), ("x", maxx, True), ("y", miny, False), ("y", maxy, True)):
        ring = _with({"r": ring}, lambda t: _cut(t["r"], axis, bound, upper))  # noqa: B023
    return _with({"r": ring}, lambda t: F.when(geo.ring_area(t["r"]) > 0, t["r"]).otherwise(F.slice(t["r"], 1, 0)))
