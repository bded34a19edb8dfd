"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dustledger.functions import geo
from dustledger.operators.spatial import BOX, box_pairs, left_box, right_box, points_in_polygons
from dustledger.session import durable, shuffled, skew_join


def _neighbours(e: DataFrame) -> DataFrame:
    """(u, m, ups, downs) per node: its smallest neighbour or itself, and how many neighbours are larger and smaller."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("ups"),
                                 F.count_if(F.col("v") < F.col("u")).alias("downs"))


def _large_star(e: DataFrame, low: DataFrame) -> DataFrame:
    """Every node's larger neighbours point at its smallest one. Repeated edges stay; the small star's aggregates ignore them."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("v > u")
    return skew_join(both, low.filter("ups > 0").select("u", "m"), ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and the node itself point at the smallest of them. ``e`` has u > v."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    links = skew_join(e, low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on an edge; the component is its smallest node.

    Each round is materialised in the checkpoint folder. The loop ends when the edges form stars: no node has two smaller
    neighbours, or a smaller and a larger one. That is read off the aggregate with which a round begins, so the test costs no
    exchange of its own. Each round shortens the paths; there is no limit on the rounds.
    """
    e = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    while True:
        low = durable(_neighbours(e))
        if low.filter("downs > 1 or (downs > 0 and ups > 0)").isEmpty():
            return low.select(F.col("u").alias("node"), F.col("m").alias("component"))
        e = durable(_small_star(_large_star(e, low)))


def proximity_clusters(boxes: DataFrame, id_col: str, gap_m: float = 2.5, cell: float = 50.0) -> DataFrame:
    """(id, component): boxes linked by chains of edge gaps up to ``gap_m``; alone = own component.

    Equal boxes are one node, so a pile of copies adds no pairs.
    """
    shape = boxes.groupBy(*BOX).agg(F.min(id_col).alias("sid"))
    pairs = box_pairs(shape, shape, "sid", "sid", cell, gap_m).filter("l < r")
    edges = pairs.filter(geo.box_gap(left_box(), right_box()) <= gap_m).select(F.col("l").alias("u"), F.col("r").alias("v"))
    comp = connected_components(edges)
    member = boxes.select(id_col, *BOX).join(shuffled(shape), list(BOX)).select(id_col, "sid")
    return member.join(shuffled(comp), member["sid"] == comp["node"], "left").select(
        id_col, F.coalesce("component", "sid").alias("component"))


def assign_sites(boxes: DataFrame, parcels: DataFrame, id_col: str, parcel_id: str, cell: float = 50.0,
                 gap_m: float = 2.5) -> DataFrame:
    """(id, site_id, site_source): the parcel that holds the box centre, else a proximity cluster."""
    centred = boxes.withColumns({"x": (F.col("minx") + F.col("maxx")) / 2.0, "y": (F.col("miny") + F.col("maxy")) / 2.0})
    hit = points_in_polygons(centred, parcels, id_col, parcel_id, cell, ring=None)
    on = hit.filter(F.col(parcel_id).isNotNull()).select(
        id_col, F.concat(F.lit("apn:"), F.col(parcel_id)).alias("site_id"), F.lit("parcel").alias("site_source"))
    off = boxes.join(shuffled(on), id_col, "left_anti")
    prox = proximity_clusters(off, id_col, gap_m, cell).select(
        id_col, F.concat(F.lit("prox:"), F.col("component")).alias("site_id"), F.lit("proximity").alias("site_source"))
    return on.unionByName(prox)


def dissolved_area(boxes: DataFrame, group: str) -> DataFrame:
    """(group, union area) of axis-aligned boxes: sweep over the group's distinct x strips.

    A strip between neighbouring x edges holds the y intervals of the boxes that span it; merged
    interval lengths times the strip width give the exact union.
    """
    from pyspark.sql import Window as W

    xs = boxes.select(group, F.explode(F.array("minx", "maxx")).alias("x")).distinct()
    strips = (xs.withColumn("x2", F.lead("x").over(W.partitionBy(group).orderBy("x")))
              .filter("x2 IS NOT NULL"))
    span = strips.join(boxes.select(group, *BOX), group).filter("minx <= x AND maxx >= x2")
    w = W.partitionBy(group, "x").orderBy("miny", "maxy")
    reach = F.max("maxy").over(w.rowsBetween(W.unboundedPreceding, -1))
    span = span.withColumn("_r", reach)
    fresh = F.greatest(F.lit(0.0), F.col("maxy") - F.greatest(F.col("miny"), F.coalesce("_r", F.col("miny"))))
    return span.groupBy(group).agg(F.sum(fresh * (F.col("x2") - F.col("x"))).alias("union_area"))


def component_hulls(members: DataFrame, group: str, ring: str = "ring", per_slice: int = 1024) -> DataFrame:
    """(group, ring): convex hull of all vertices of a group.

    Equal rings count once. Hulls are taken per (group, slice of about ``per_slice`` rings) first and then
    merged, so that no task needs all the vertices of a large group, only the hulls of its slices.
    """
    once = members.select(group, ring).distinct()
    slices = once.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / per_slice).alias("_n"))
    rows = once.join(slices, group).select(group, ring, F.pmod(F.xxhash64(ring), F.col("_n")).alias("_s"))
    part = rows.groupBy(group, "_s").agg(F.flatten(F.collect_list(ring)).alias("pts"))
    hulls = part.select(group, geo.convex_hull("pts").alias("pts"))
    whole = hulls.groupBy(group).agg(F.flatten(F.collect_list("pts")).alias("pts"))
    return whole.select(group, geo.convex_hull("pts").alias(ring))
