"""Roll-ups and audits: sites, parcels, datasets, coverage, medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dustledger.functions.numeric import safe_div, wilson_interval
from dustledger.operators.ranks import attach_row, exact_quantiles


def weighted_mean(value: Column, weight: Column, total: Column) -> Column:
    """Mean of the non-null values by weight; equal weights where the group's total weight is 0."""
    w = F.when(value.isNotNull(), weight)
    plain = F.avg(value)
    return F.when(total > 0, F.sum(value * w) / F.nullif(F.sum(w), F.lit(0.0))).otherwise(plain)


def site_rollup(arrays: DataFrame, site: str, area: str = "area_m2", averaged: Sequence[str] = (),
                permit: str | None = None, risk: str | None = None, id_col: str = "array_id") -> DataFrame:
    """One row per site: area, polygon count, area-weighted means, permit kW, risk, largest polygon.

    Only sums and min/max structs are kept per site, so a site of any size combines map-side.
    """
    a = F.coalesce(F.col(area), F.lit(0.0))
    total = F.sum(a)
    aggs = [total.alias("site_area_m2"), F.count(F.lit(1)).alias("n_polygons"),
            F.max_by(id_col, F.struct(a, -F.col(id_col))).alias("primary_id")]
    aggs += [weighted_mean(F.col(c), a, total).alias(c) for c in averaged]
    if permit:
        aggs.append(F.max(permit).alias(permit))
    if risk:
        aggs.append(F.avg(risk).alias(risk))
    return arrays.groupBy(site).agg(*aggs)


def primary_flags(arrays: DataFrame, site: str, area: str = "area_m2", id_col: str = "array_id") -> DataFrame:
    """Add site_primary: true on the largest polygon of each site (smallest id on ties), once."""
    a = F.coalesce(F.col(area), F.lit(0.0))
    best = arrays.groupBy(site).agg(F.max_by(id_col, F.struct(a, -F.col(id_col))).alias(id_col))
    flagged = best.select(id_col, F.lit(True).alias("site_primary"))
    return arrays.join(flagged, id_col, "left").withColumn("site_primary", F.coalesce("site_primary", F.lit(False)))


def cluster_diagnostics(assigned: DataFrame) -> DataFrame:
    """Polygons per site: mean, median, max, share with several, fragmentation, sources."""
    g = assigned.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.min("site_source").alias("src"))
    med = exact_quantiles(g, [], "n", {"median_per_site": 0.5}).drop("n")
    s = g.agg(F.count(F.lit(1)).alias("n_sites"), F.sum("n").alias("n_polygons"), F.avg("n").alias("mean_per_site"),
              F.max("n").alias("max_per_site"), (100.0 * F.avg((F.col("n") > 1).cast("double"))).alias("pct_multi"),
              (F.sum("n") / F.count(F.lit(1))).alias("fragmentation"),
              F.sum(F.when(F.col("src") == "parcel", 1).otherwise(0)).alias("n_parcel"),
              F.sum(F.when(F.col("src") == "proximity", 1).otherwise(0)).alias("n_proximity"))
    return attach_row(s, med)


def last_known(df: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str], first: bool = False) -> DataFrame:
    """Per key and column the last (or first) NON-NULL value in the given order."""
    pick = F.min_by if first else F.max_by
    return df.groupBy(key).agg(*[pick(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def whole_row(df: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str], first: bool = False) -> DataFrame:
    """Per key the one row that is last (or first) in the given order, nulls included."""
    pick = F.min_by if first else F.max_by
    best = df.groupBy(key).agg(pick(F.struct(*columns), F.struct(*order)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in columns])


def permit_history(permits: DataFrame, key: str, date: str) -> DataFrame:
    return permits.groupBy(key).agg(F.min(date).alias("first_issued"), F.max(date).alias("last_issued"),
                                    F.count(F.lit(1)).alias("n_permits"))


def recall_audit(points: DataFrame, tolerance_m: float = 15.0, imaged_year: int = 2022) -> DataFrame:
    """Recall of permits within the footprint, plain and for the imaged era, with miss classes."""
    hit, era = F.coalesce(F.col("distance") <= tolerance_m, F.lit(False)), F.col("yr") <= imaged_year

    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    s = points.agg(F.count(F.lit(1)).alias("n"), n(hit).alias("found"), n(era).alias("n_era"), n(era & hit).alias("found_era"),
                   n(~hit & era).alias("real_miss"), n(~hit & ~era).alias("post_imagery"), n(F.col("apn_detected")).alias("found_apn"))
    return s.withColumns({"recall": safe_div(F.col("found"), F.col("n")), "recall_era": safe_div(F.col("found_era"), F.col("n_era"))})


def recall_interval(audit: DataFrame) -> DataFrame:
    lo, hi = wilson_interval(F.col("found"), F.col("n"))
    return audit.withColumns({"ci_lo": lo, "ci_hi": hi})


# ---- datasets ---------------------------------------------------------------------------------------------
def dataset_audit(images: DataFrame, labels: DataFrame, stem: str, split: str, large: float = 0.85) -> DataFrame:
    """Per split: images, labels, objects, empty and orphan labels, missing labels, bad coordinates, large objects.

    ``labels`` has one row per object (null class = an empty label file) with x, y, extent in [0, 1].
    """
    bad = (F.col("x") < 0) | (F.col("x") > 1) | (F.col("y") < 0) | (F.col("y") > 1)
    per = labels.groupBy(split, stem).agg(
        F.count("class").alias("objects"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("extent") > large, 1).otherwise(0)).alias("large"))
    i = images.select(split, stem).distinct().withColumn("_img", F.lit(1))
    j = i.join(per.withColumn("_lab", F.lit(1)), [split, stem], "full")

    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    has_i, has_l = F.col("_img").isNotNull(), F.col("_lab").isNotNull()
    return j.groupBy(split).agg(
        n(has_i).alias("images"), n(has_l).alias("labels"), F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"),
        n(has_l & (F.col("objects") == 0)).alias("empty_labels"), n(has_i & ~has_l).alias("missing_labels"),
        n(has_l & ~has_i).alias("orphan_labels"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_coords"),
        F.coalesce(F.sum("large"), F.lit(0)).alias("large_objects"))


def censoring_by_span(stations: DataFrame) -> DataFrame:
    """Censored stations and how long they were observed."""
    c = F.col("censored")

    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    return stations.filter("months IS NOT NULL").agg(
        F.count(F.lit(1)).alias("n_stations"), n(c).alias("n_censored"), n(c & (F.col("months") >= 24)).alias("ge_2y"),
        n(c & (F.col("months") >= 36)).alias("ge_3y"), n(c & (F.col("months") >= 60)).alias("ge_5y"))


def sawtooth_interval(stations: DataFrame, station: str, iwsr: str, rates: str) -> DataFrame:
    """Implied days between full recoveries, 2 * loss / mean absolute monthly rate, per station."""
    kept = F.filter(F.col(rates), lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + F.abs(x))
    rate = total / F.nullif(F.size(kept), F.lit(0))
    d = stations.filter(F.col(iwsr).isNotNull()).withColumn("rate", rate).filter("rate > 0")
    return d.select(station, (F.col("rate") * 100.0).alias("rate_pct_per_day"), ((1.0 - F.col(iwsr)) * 100.0).alias("loss_pct"),
                    (2.0 * (1.0 - F.col(iwsr)) / F.col("rate")).alias("implied_days"))


def cell_spans(systems: DataFrame, cell: Sequence[str], start: str, end: str, era: tuple[str, str]) -> DataFrame:
    """Union span per cell clamped to the era; ``usable`` is false where clamping inverts it."""
    s = systems.dropna(subset=[start, end]).groupBy(*cell).agg(F.min(start).alias("a"), F.max(end).alias("b"), F.count(F.lit(1)).alias("n_systems"))
    a = F.greatest(F.col("a"), F.to_date(F.lit(era[0])))
    b = F.least(F.col("b"), F.to_date(F.lit(era[1])))
    return s.select(*cell, a.alias("span_start"), b.alias("span_end"), "n_systems", (a < b).alias("usable"))


# ---- feature tables ------------------------------------------------------------------------------------------
META_COLUMNS = ("station_id", "label", "iwsr", "iwsr_lower", "iwsr_upper", "as_of", "year", "is_feedback", "is_summary", "months_in_data_set")


def feature_coverage(features: DataFrame, keys: Sequence[str] = (), exempt: Sequence[str] = META_COLUMNS) -> DataFrame:
    """(keys, feature, coverage): non-null share of every feature in one pass."""
    cols = [c for c in features.columns if c not in exempt and c not in keys]
    one = features.groupBy(*keys).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols])
    return one.unpivot(list(keys), cols, "feature", "coverage")


def drop_sparse(features: DataFrame, min_fraction: float, exempt: Sequence[str] = META_COLUMNS) -> tuple[DataFrame, list[str]]:
    """Drop features below the coverage floor; one aggregate row decides."""
    cols = [c for c in features.columns if c not in exempt]
    row = features.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols]).first()
    sparse = [c for c in cols if (row[c] or 0.0) < min_fraction]
    return features.drop(*sparse), sparse


def drop_near_constant(df: DataFrame, columns: Sequence[str], min_distinct: int = 10) -> tuple[DataFrame, list[str]]:
    """Drop columns with fewer than ``min_distinct`` distinct values (counted from distinct pairs)."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("p"))
    counts = pairs.filter("p.v IS NOT NULL").select("p.c", "p.v").distinct().groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    seen = {r["c"]: r["n"] for r in counts.collect()}  # one row per column name
    flat = [c for c in columns if seen.get(c, 0) < min_distinct]
    return df.drop(*flat), flat


def feature_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median) over the given rows; an all-null feature gets 0."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    med = exact_quantiles(long.filter("value IS NOT NULL"), ["feature"], "value", {"median": 0.5}).drop("n")
    names = train.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(med, "feature", "left").select("feature", F.coalesce("median", F.lit(0.0)).alias("median"))


def impute(df: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the medians; a column the table lacks is created from its median."""
    wide = medians.groupBy().pivot("feature", list(columns)).agg(F.first("median"))
    wide = wide.select(*[F.col(c).alias(f"_m_{c}") for c in columns])
    out = attach_row(df, wide)
    for c in columns:
        have = F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
        out = out.withColumn(c, F.coalesce(have, F.col(f"_m_{c}")))
    return out.drop(*[f"_m_{c}" for c in columns])


def vegetation_prevalence(pixels: DataFrame, array: str, threshold: float = 0.2, min_pixels: int = 6) -> DataFrame:
    """Per array from (array, zone 'panel'/'ring', red, nir): NDVI median and p90, vegetated share, excess over the ring."""
    ok = pixels.filter((F.col("red") + F.col("nir")) > 0).withColumn(
        "ndvi", (F.col("nir") - F.col("red")) / (F.col("nir") + F.col("red")))
    q = exact_quantiles(ok, [array, "zone"], "ndvi", {"p50": 0.5, "p90": 0.9}).filter(F.col("n") >= min_pixels)
    veg = ok.filter("zone = 'panel'").groupBy(array).agg(F.avg((F.col("ndvi") >= threshold).cast("double")).alias("veg_px_frac"))
    panel = q.filter("zone = 'panel'").select(array, F.col("n").alias("n_px"), F.col("p50").alias("ndvi_p50"), F.col("p90").alias("ndvi_p90"))
    ring = q.filter("zone = 'ring'").select(array, F.col("p50").alias("roof_ndvi_p50"))
    return (panel.join(veg, array).join(ring, array, "left")
            .withColumn("ndvi_excess", F.col("ndvi_p50") - F.col("roof_ndvi_p50")))


def run_table(metrics: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """One row per training run from its metrics record, with the holdout interval where there is one."""
    out = metrics
    if intervals is not None:
        out = out.join(intervals, "run", "left")
    return out


def halt_check(runs: DataFrame, metric: str, baseline: float, halt_delta: float) -> DataFrame:
    """Add delta and halt; a missing metric never halts."""
    delta = F.lit(baseline) - F.nanvl(F.col(metric), F.lit(None).cast("double"))
    return runs.withColumns({"delta": delta, "halt": F.coalesce(delta > halt_delta, F.lit(False))})
