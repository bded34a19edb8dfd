"""Polygon label lines ('class x1 y1 ... [conf]') to world polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dustledger.functions import geo


def parse_polygon_lines(lines: DataFrame, tiles: DataFrame, tile_id: str = "tile_id", text: str = "line", min_area: float = 1.0) -> DataFrame:
    """(tile, class_id, confidence, ring, area) in world units.

    An even number of fields means a trailing confidence, else 1.0. Normalised vertices become
    pixels by the tile size and world units by the tile's affine; tiny polygons are dropped.
    """
    f = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    d = lines.withColumn("f", F.transform(f, lambda x: x.try_cast("double"))).filter(F.size("f") >= 7)
    even = F.size("f") % 2 == 0
    d = d.withColumn("confidence", F.when(even, F.element_at("f", -1)).otherwise(F.lit(1.0)))
    coords = F.slice("f", 2, F.when(even, F.size("f") - 2).otherwise(F.size("f") - 1))
    d = d.withColumn("c", coords)
    xs = F.filter("c", lambda _, i: i % 2 == 0)
    ys = F.filter("c", lambda _, i: i % 2 == 1)
    d = d.withColumn("norm", F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    t = tiles.withColumn("_order", geo.affine_order(F.col("transform"))).select(tile_id, "transform", "width", "height", "_order")
    d = d.join(t, tile_id).filter("_order IS NOT NULL")
    terms = geo.affine_terms(F.col("transform"), F.col("_order"))
    ring = geo.transform_ring(F.col("norm"), lambda x, y: geo.pixel_to_world(x * F.col("width"), y * F.col("height"), terms))
    d = d.withColumn("ring", ring).withColumn("area", geo.ring_area(F.col("ring")))
    return d.filter(F.col("area") > min_area).select(tile_id, F.element_at("f", 1).cast("int").alias("class_id"), "confidence", "ring", "area")
