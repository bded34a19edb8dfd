"""Roof planes, standoff and canopy from lidar points, by grouped moments instead of per-roof loops.

Every round aggregates centred moments per polygon (map-side combine) and joins the fitted planes
to the points of the source, so one dense polygon never has to fit into one task and no point is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dustledger.operators.ranks import exact_quantiles

MIN_POINTS, MAX_RMS_M, MIN_INLIERS = 12, 0.25, 0.60
SURFACE_CLASSES, VEGETATION, GROUND = (1, 6), (3, 4, 5), (2,)


MOMENTS = ("n", "mx", "my", "mz", "vx", "vy", "vz", "cxy", "cxz", "cyz")
FIT = ("a", "b", "c", "s")


def _moments(when: Column) -> list[Column]:
    """Count, means and centred second moments of the points that meet a condition."""
    x, y, z = (F.when(when, F.col(v)) for v in ("x", "y", "z"))
    values = (F.count(x), F.avg(x), F.avg(y), F.avg(z), F.var_pop(x), F.var_pop(y), F.var_pop(z), F.covar_pop(x, y), F.covar_pop(x, z), F.covar_pop(y, z))
    return [v.alias(name) for name, v in zip(MOMENTS, values)]


def _plane(m: DataFrame, live: Column | None = None) -> DataFrame:
    """``m`` with the least-squares plane of its moments as a, b, c, s; where ``live`` is false the old ones stay."""
    det = F.col("vx") * F.col("vy") - F.col("cxy") * F.col("cxy")
    det = F.when(F.abs(det) > 1e-12, det)
    a = (F.col("cxz") * F.col("vy") - F.col("cyz") * F.col("cxy")) / det
    b = (F.col("cyz") * F.col("vx") - F.col("cxz") * F.col("cxy")) / det
    m = m.withColumns({"_a": a, "_b": b})
    m = m.withColumns({"_c": F.col("mz") - F.col("_a") * F.col("mx") - F.col("_b") * F.col("my"),
                       "_s": F.sqrt(F.greatest(F.lit(0.0), F.col("vz") - F.col("_a") * F.col("cxz") - F.col("_b") * F.col("cyz")))})
    return m.withColumns({c: F.col(f"_{c}") if live is None else F.when(live, F.col(f"_{c}")).otherwise(F.col(c)) for c in FIT}).drop("_a", "_b", "_c", "_s")


def _off(a: str, b: str, c: str) -> Column:
    return F.col("z") - (F.col(a) * F.col("x") + F.col(b) * F.col("y") + F.col(c))


def trimmed_planes(points: DataFrame, key: str, rounds: int = 3, sigma: float = 2.5) -> DataFrame:
    """(key, n_points, n_inliers, a, b, c, rms): plane z = ax + by + c with residual trimming.

    ``points`` (key, x, y, z) in true metres. A round refits, then keeps the points within
    ``sigma`` population deviations, unless too few would remain or nothing changes.

    Whether a point is kept follows from the plane that trimmed it, so a round carries only planes: per polygon the plane by
    which points are kept now and the one fitted to them. One pass over the points counts those that the new plane would
    keep and takes their moments for the next fit. Points are never written; a round writes one row per polygon.
    """
    from dustledger.session import durable

    p = points.select(key, "x", "y", "z")
    # keep planes ka.. are null while all points are kept
    state = _plane(p.groupBy(key).agg(F.count(F.lit(1)).alias("n_points"), *_moments(F.lit(True)))).select(
        key, "n_points", *FIT, *[F.lit(None).cast("double").alias(f"k{c}") for c in FIT], F.lit(True).alias("live"), F.lit(True).alias("all"))
    state = durable(state)
    for last in range(rounds):
        j = p.join(state, key).withColumns({"resid": _off("a", "b", "c")})
        new = F.coalesce((F.abs("resid") <= sigma * F.col("s")) & (F.col("s") > 0), F.lit(False))
        keep = F.col("all") | F.coalesce((F.abs(_off("ka", "kb", "kc")) <= sigma * F.col("ks")) & (F.col("ks") > 0), F.lit(False))
        j = j.withColumns({"new": new, "keep": keep, "sq": F.col("resid") * F.col("resid")})
        agg = j.groupBy(key).agg(
            *[F.first(c).alias(c) for c in ("n_points", *FIT, *(f"k{c}" for c in FIT), "live", "all")], *_moments(F.col("new")),
            F.count_if(F.col("new") != F.col("keep")).alias("n_diff"), F.count_if("keep").alias("n_keep"),
            F.avg(F.when(F.col("keep"), F.col("sq"))).alias("sq_keep"), F.avg(F.when(F.col("new"), F.col("sq"))).alias("sq_new"))
        go = F.col("live") & (F.col("n") >= MIN_POINTS) & (F.col("n_diff") > 0) & (F.coalesce("s", F.lit(0.0)) > 0)
        agg = durable(agg.withColumn("go", go))
        if last == rounds - 1:
            break
        kept = agg.withColumns({**{f"k{c}": F.when(F.col("go"), F.col(c)).otherwise(F.col(f"k{c}")) for c in FIT}, "all": F.col("all") & ~F.col("go")})
        state = _plane(kept, F.col("go")).withColumn("live", F.col("go")).select(*state.columns)
    return agg.select(key, "n_points", F.when(F.col("go"), F.col("n")).otherwise(F.col("n_keep")).alias("n_inliers"), "a", "b", "c",
                      F.sqrt(F.when(F.col("go"), F.col("sq_new")).otherwise(F.col("sq_keep"))).alias("rms"))


def tilt_azimuth(a: Column, b: Column) -> tuple[Column, Column]:
    """Tilt from horizontal and downslope bearing clockwise from north, in degrees."""
    return F.degrees(F.atan(F.sqrt(a * a + b * b))), F.pmod(F.degrees(F.atan2(-a, -b)) + 360.0, F.lit(360.0))


def roof_planes(points: DataFrame, key: str, rounds: int = 3, sigma: float = 2.5) -> DataFrame:
    """Tilt, azimuth, quality and a reason per polygon; surface-class first returns only."""
    p = points.filter(F.col("cls").isin(*SURFACE_CLASSES) & (F.col("ret") == 1))
    f = trimmed_planes(p, key, rounds, sigma)
    tilt, az = tilt_azimuth(F.col("a"), F.col("b"))
    frac = F.col("n_inliers") / F.col("n_points")
    few, rough, thin = F.col("n_inliers") < MIN_POINTS, F.col("rms") > MAX_RMS_M, frac < MIN_INLIERS
    enough = F.col("n_points") >= MIN_POINTS
    reason = F.when(~enough, F.concat(F.lit("only "), F.col("n_points"), F.lit(" points"))).otherwise(F.concat_ws(
        "; ", F.when(few, F.lit("few inliers")), F.when(rough, F.lit("rough")), F.when(thin, F.lit("thin"))))
    return f.select(key, "n_points", F.when(enough, tilt).alias("tilt_deg"), F.when(enough, az).alias("azimuth_deg"),
                    F.when(enough, frac).alias("inlier_frac"), F.when(enough, F.col("rms")).alias("rms_m"),
                    F.coalesce(enough & ~few & ~rough & ~thin, F.lit(False)).alias("fit_ok"), reason.alias("fit_reason"))


def standoff(inside: DataFrame, ring: DataFrame, key: str, min_points: int = MIN_POINTS, max_ring_rms: float = 0.25) -> DataFrame:
    """Median height of panel returns above the plane of the surrounding ring, with tilt and azimuth gaps."""
    plane = trimmed_planes(ring, key, rounds=6, sigma=2.0).filter(
        (F.col("n_points") >= min_points) & (F.col("rms") <= max_ring_rms)).select(
        key, F.col("n_points").alias("n_ring"), "a", "b", "c", F.col("rms").alias("ring_rms_m"))
    up = inside.join(plane, key).withColumn("h", F.col("z") - (F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c")))
    q = exact_quantiles(up, [key], "h", {"standoff_m": 0.5}).withColumnRenamed("n", "n_interior").filter(F.col("n_interior") >= min_points)
    mine = trimmed_planes(inside, key).select(key, F.col("a").alias("pa"), F.col("b").alias("pb"))
    j = q.join(plane, key).join(mine, key)
    rt, ra = tilt_azimuth(F.col("a"), F.col("b"))
    at, aa = tilt_azimuth(F.col("pa"), F.col("pb"))
    d = F.pmod(F.abs(ra - aa), F.lit(360.0))
    return j.select(key, "n_interior", "n_ring", "standoff_m", "ring_rms_m", rt.alias("roof_tilt_deg"), at.alias("array_tilt_deg"),
                    F.least(d, 360.0 - d).alias("d_azimuth_deg"))


def canopy_exposure(points: DataFrame, key: str, min_height: float = 2.5, cell_m: float = 1.0, per_cell: int = 3, cells: int = 3) -> DataFrame:
    """(key, canopy_frac, canopy_p98_height_m, nearest_canopy_m) from returns around each array.

    ``points`` (key, x, y, above, distance_m, cls, nret): a candidate is high above the plane and
    either classified vegetation or a multi-return hit off the ground; it counts only in a supported
    cell, and only if the array has enough of those.
    """
    veg = F.col("cls").isin(*VEGETATION) | (~F.col("cls").isin(*GROUND) & (F.col("nret") > 1))
    p = points.withColumns({"cand": (F.col("above") > min_height) & veg, "gx": F.floor(F.col("x") / cell_m), "gy": F.floor(F.col("y") / cell_m)})
    cell = p.filter("cand").groupBy(key, "gx", "gy").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= per_cell)
    enough = cell.groupBy(key).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= cells).select(key)
    good = cell.join(enough, key, "left_semi").select(key, "gx", "gy")
    hit = p.filter("cand").join(good, [key, "gx", "gy"], "left_semi")
    h = exact_quantiles(hit, [key], "above", {"canopy_p98_height_m": 0.98}).withColumnRenamed("n", "n_canopy")
    near = hit.groupBy(key).agg(F.min("distance_m").alias("nearest_canopy_m"))
    n = points.groupBy(key).agg(F.count(F.lit(1)).alias("n_points"))
    j = n.join(h, key, "left").join(near, key, "left")
    return j.select(key, "n_points", (F.coalesce("n_canopy", F.lit(0)) / F.col("n_points")).alias("canopy_frac"),
                    F.coalesce("canopy_p98_height_m", F.lit(0.0)).alias("canopy_p98_height_m"), "nearest_canopy_m")


def persistent_screen(planes: DataFrame, canopy: DataFrame, key: str, fraction: float = 0.10) -> DataFrame:
    """Low-tilt and canopy screen with rank, top-fraction flag and the policy that made it."""
    from dustledger import constants as K
    from dustledger.functions import pv
    from dustledger.operators.ranks import flag_top_fraction
    from dustledger.session import durable

    j = planes.filter("fit_ok").join(canopy, key)
    tilt, frac, near = F.col("tilt_deg"), F.col("canopy_frac"), F.col("nearest_canopy_m")
    s = j.withColumns({
        "low_tilt_score": pv.low_tilt_score(tilt), "canopy_exposure_score": pv.canopy_score(frac, near),
        "persistent_soiling_score": F.rint(pv.persistent_score(tilt, frac, near) * 1e9) / 1e9,
        "tilt_weight": F.lit(K.TILT_WEIGHT), "canopy_weight": F.lit(K.CANOPY_WEIGHT),
        "canopy_radius_m": F.lit(K.CANOPY_RADIUS_M), "inspection_fraction": F.lit(fraction)})
    # the ranking reads its input several times; the planes behind it are costly
    return flag_top_fraction(durable(s), "persistent_soiling_score", key, fraction).withColumnsRenamed(
        {"rank": "persistent_soiling_rank", "top_fraction": "persistent_soiling_top_decile"})
