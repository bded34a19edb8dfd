"""Jobs on image tiles and chips as tables: origins, clipping, seeds, splits, cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dustledger import constants as K
from dustledger.functions import geo, overlay
from dustledger.operators.spatial import BOX, box_pairs, points_in_polygons
from dustledger.session import deal, shuffled


def chip_origins(tiles: DataFrame, width: str, height: str, chip: int) -> DataFrame:
    """Flush-corner chip origins (ox, oy); a tile no larger than a chip has one."""
    def ends(size: str):
        return F.array_distinct(F.array(F.lit(0), F.greatest(F.lit(0), F.col(size) - chip)))

    return tiles.withColumn("ox", F.explode(ends(width))).withColumn("oy", F.explode(ends(height)))


def covering_offsets(tiles: DataFrame, width: str, height: str, chip: int) -> DataFrame:
    """Evenly stepped chip offsets with the last row and column snapped to the edge."""
    def steps(size: str):
        last = F.greatest(F.lit(0), F.col(size) - chip)
        return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(chip)), F.array(last))))

    return tiles.withColumn("ox", F.explode(steps(width))).withColumn("oy", F.explode(steps(height)))


def _pairs(polygons: DataFrame, chips: DataFrame, poly_id: str, chip_id: str, cell: float) -> DataFrame:
    pairs = box_pairs(polygons, chips, poly_id, chip_id, cell)
    keep = pairs.select(F.col("l").alias(poly_id), F.col("r").alias(chip_id), *[F.col(f"r_{c}").alias(f"chip_{c}") for c in BOX])
    return keep.join(shuffled(polygons.select(poly_id, "ring")), poly_id)


def clamp_to_chips(polygons: DataFrame, chips: DataFrame, poly_id: str, chip_id: str, cell: float,
                   min_area: float = 1e-6) -> DataFrame:
    """Rings in chip-normalised coordinates with vertices clamped to [0, 1]; slivers dropped."""
    j = _pairs(polygons, chips, poly_id, chip_id, cell)
    w, h = F.col("chip_maxx") - F.col("chip_minx"), F.col("chip_maxy") - F.col("chip_miny")

    def unit(v):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    ring = geo.transform_ring(F.col("ring"), lambda x, y: (unit((x - F.col("chip_minx")) / w), unit((y - F.col("chip_miny")) / h)))
    j = j.withColumn("ring", ring)
    return j.filter(geo.ring_area(F.col("ring")) >= min_area).drop(*[f"chip_{c}" for c in BOX])


def clip_to_chips(polygons: DataFrame, chips: DataFrame, poly_id: str, chip_id: str, min_keep: float,
                  min_m2: float, cell: float = 50.0) -> DataFrame:
    """True intersections with the chip rectangle that keep enough of the polygon."""
    j = deal(_pairs(polygons, chips, poly_id, chip_id, cell), poly_id, chip_id)
    # generated columns, so that the filter below does not compute them again
    j = j.withColumn("clipped", F.explode(F.array(overlay.clip_to_box(F.col("ring"), *[F.col(f"chip_{c}") for c in BOX]))))
    area = F.when(F.size("clipped") >= 3, geo.ring_area(F.col("clipped"))).otherwise(F.lit(0.0))
    j = j.withColumn("_m", F.explode(F.array(F.struct(area.alias("clip"), geo.ring_area(F.col("ring")).alias("whole")))))
    j = j.withColumns({"clip_area": F.col("_m.clip"), "kept_frac": F.col("_m.clip") / F.col("_m.whole")}).drop("_m")
    return j.filter((F.col("kept_frac") >= min_keep) & (F.col("clip_area") >= min_m2)).drop(*[f"chip_{c}" for c in BOX])


def seed_boxes(points: DataFrame, tiles: DataFrame, point_id: str, tile_id: str, cell: float,
               default_m2: float = 28.0, min_side_m: float = 5.0) -> DataFrame:
    """Weak box per point inside its tile: side from kW, corners normalised with y downwards.

    Points outside every tile are dropped; ``in_eval_split`` marks val and test tiles.
    """
    hit = points_in_polygons(points, tiles, point_id, tile_id, cell, ring=None).filter(F.col(tile_id).isNotNull())
    j = hit.join(tiles.select(tile_id, "split", *BOX), tile_id)
    area = F.when(F.col("kw") > 0, F.col("kw") * K.M2_PER_KW).otherwise(F.lit(default_m2))
    j = j.withColumn("side_m", F.greatest(F.sqrt(area), F.lit(min_side_m)))
    half, w, h = F.col("side_m") / 2.0, F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")

    def unit(v):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    return j.withColumns({
        "nx1": unit((F.col("x") - half - F.col("minx")) / w), "nx2": unit((F.col("x") + half - F.col("minx")) / w),
        "ny1": unit((F.col("maxy") - (F.col("y") + half)) / h), "ny2": unit((F.col("maxy") - (F.col("y") - half)) / h),
        "in_eval_split": F.col("split").isin("val", "test")})


def hash_split(df: DataFrame, id_col: str, ratios: dict[str, float], seed: int) -> DataFrame:
    """Add split: a fixed function of (id, seed), so re-runs and new rows never reshuffle it."""
    from dustledger.functions.numeric import draw_key, uniform_fine

    u = uniform_fine(draw_key(F.col(id_col), seed))
    out, edge = None, 0.0
    for name, share in ratios.items():
        edge += share
        cond = u < edge if edge < 1.0 - 1e-12 else F.lit(True)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return df.withColumn("split", out)


def cap_empty(df: DataFrame, empty: str, id_col: str, max_ratio: float, seed: int) -> DataFrame:
    """Keep all annotated rows and at most ratio/(1-ratio) as many empty ones, by hash order.

    Which empty rows stay is decided by a distributed rank of their draws.
    """
    from dustledger.functions.numeric import draw_key, uniform_fine
    from dustledger.operators.ranks import attach_row, row_numbers

    quota = df.agg(F.sum(F.when(F.col(empty), 0).otherwise(1)).alias("_full")).select(
        F.col("_full"), F.floor(F.col("_full") * (max_ratio / max(1e-9, 1 - max_ratio))).alias("_cap"))
    rows = attach_row(df, quota)
    full = rows.filter(~F.col(empty))
    blank = rows.filter(F.col(empty)).withColumn("_u", uniform_fine(draw_key(F.col(id_col), seed)))
    ranked = row_numbers(blank, "_u", id_col, "_rk", descending=False)
    kept = ranked.filter((F.col("_full") == 0) | (F.col("_rk") <= F.col("_cap")))
    return full.select(*df.columns).unionByName(kept.select(*df.columns))


def oversample(df: DataFrame, times: str) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(times))))


def cleaning_reasons(tiles: DataFrame, min_brightness: float) -> DataFrame:
    """Add reason (kept / dark / no_label / all_tiny) and pruned; the first failing test wins."""
    reason = (F.when(F.col("brightness") < min_brightness, "dark").when(F.coalesce("n_labels", F.lit(0)) == 0, "no_label")
              .when(F.col("n_large") == 0, "all_tiny").otherwise("kept"))
    return tiles.withColumns({"reason": reason, "pruned": (reason == "kept") & (F.col("n_large") < F.col("n_labels"))})


def balanced_owners(tiles: DataFrame, split: str, order: str, id_col: str, owners: Sequence[str] = ("a", "b")) -> DataFrame:
    """Two owners per split, each a contiguous west-to-east half; the larger half alternates over odd splits."""
    from pyspark.sql import Window as W

    from dustledger.operators.ranks import rank_in_groups

    sizes = tiles.groupBy(split).agg(F.count(F.lit(1)).alias("_n"))
    # one row per split
    flips = F.coalesce(F.sum(F.col("_n") % 2).over(W.orderBy(split).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_first", flips % 2)
    r = rank_in_groups(tiles, [split], order, id_col, "_rk", descending=False).join(sizes, split)
    head = F.col("_rk") <= F.floor((F.col("_n") + 1) / 2)
    pick = F.when(head, F.col("_first")).otherwise(1 - F.col("_first"))
    return r.withColumn("owner", F.when(pick == 0, owners[0]).otherwise(owners[1])).drop("_rk", "_n", "_first")
