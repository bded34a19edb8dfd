"""Soiling trajectories as window expressions, with no loop over days.

Equivalent days follow ``eq[n] = f[n] * (eq[n-1] + 1)`` and f = 0 on a heavy-rain day, so a series
splits into segments at heavy rain. Inside a segment, with ``S[n] = sum(ln f)``,

    eq[n] = exp(S[n]) * sum_{j<=n} exp(-S[j-1])

where every term is positive. To stay inside double range for any history, a segment is cut into
blocks whenever the running minimum of S has fallen by another 300; a row then needs its own block
and the last value of the previous one (older terms are below exp(-300) of the result).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dustledger import constants as K
from dustledger.functions import pv
from dustledger.functions.numeric import half_even
from dustledger.session import series as whole_series

BLOCK = 300.0


def _filled(daily: DataFrame, keys: Sequence[str], column: str, if_all_missing: float) -> Column:
    if column not in daily.columns:
        return F.lit(if_all_missing)
    return F.coalesce(column, F.median(column).over(W.partitionBy(*keys)), F.lit(if_all_missing))


def decay_factor(params: dict | None = None, tilt: Column | None = None) -> Column:
    """Daily factor f from columns ``_p`` (rain) and ``_pm`` (PM10); tilt scales rain thresholds."""
    p = {**K.SOILING, **(params or {})}
    factor = F.lit(1.0) if tilt is None else pv.tilt_soiling_factor(tilt)
    heavy, light = F.lit(p["heavy_rain_mm"]) * factor, F.lit(p["rain_min_mm"]) * factor
    rain, pm = F.col("_p"), F.col("_pm")
    return (F.when(rain >= heavy, F.lit(0.0))
            .when(rain >= light, 1.0 - (rain - light) / (heavy - light))
            .when(pm > p["pm10_dust_threshold"],
                  1.0 + p["pm10_dust_scale"] * (pm - p["pm10_dust_threshold"]))
            .otherwise(F.lit(1.0)))


def equivalent_days(daily: DataFrame, keys: Sequence[str] = ("cell_id",), day: str = "day",
                    params: dict | None = None, tilt: str | None = None) -> DataFrame:
    """Add seg, s_log, eq_days and soiling_loss to a daily series.

    ``keys`` name one series (a cell, or a cell and tilt class); the series is bounded by the
    calendar. All windows share the hash partitioning of ``keys``: one shuffle.
    """
    p = {**K.SOILING, **(params or {})}
    keys = list(keys)
    tilt_col = F.col(tilt) if tilt else None
    daily = whole_series(daily, *keys)
    by_day = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    s = daily.withColumns({"_p": F.coalesce("precipitation_sum", F.lit(0.0)),
                           "_pm": _filled(daily, keys, "pm10", 0.0)})
    s = s.withColumn("_f", decay_factor(p, tilt_col))
    s = s.withColumn("seg", F.sum(F.when(F.col("_f") <= 0, 1).otherwise(0)).over(by_day))
    in_seg = W.partitionBy(*keys, "seg").orderBy(day)
    upto = in_seg.rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("_ln", F.when(F.col("_f") > 0, F.log("_f")).otherwise(F.lit(0.0)))
    s = s.withColumn("s_log", F.sum("_ln").over(upto))
    s = s.withColumn("_blk", F.floor(F.greatest(F.lit(0.0), -F.min("s_log").over(upto)) / BLOCK).cast("int"))
    in_blk = W.partitionBy(*keys, "seg", "_blk").orderBy(day)
    upto_blk = in_blk.rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("_sb", F.sum("_ln").over(upto_blk))
    # the first row of a block already carries its own ln f, so its predecessor sits at 0
    term = F.when(F.col("_f") > 0, F.exp(F.col("_ln") - F.col("_sb"))).otherwise(F.lit(0.0))
    s = s.withColumn("_own", F.exp("_sb") * F.sum(term).over(upto_blk))
    s = s.withColumn("_lag", F.lag("_own").over(in_seg))
    s = s.withColumn("_carry", F.coalesce(F.first("_lag").over(upto_blk), F.lit(0.0)))
    s = s.withColumn("eq_days", F.when(F.col("_f") <= 0, F.lit(0.0)).otherwise(
        F.col("_own") + F.when(F.col("_blk") > 0, F.col("_carry") * F.exp("_sb")).otherwise(F.lit(0.0))))
    sat = F.lit(p["sl_sat"])
    if tilt_col is not None:
        sat = sat * pv.tilt_soiling_factor(tilt_col)
    s = s.withColumn("soiling_loss", sat * (1.0 - F.exp(-F.col("eq_days") / p["k"])))
    return s.drop("_p", "_pm", "_f", "_ln", "_blk", "_sb", "_own", "_lag", "_carry")


def kimber_ratio(daily: DataFrame, keys: Sequence[str] = ("cell_id",), day: str = "day",
                 deposition: float = K.KIMBER_DEPOSITION_PER_PM25,
                 rain_clean_mm: float = K.KIMBER_RAIN_CLEAN_MM) -> DataFrame:
    """Add kimber_ratio: 1 on a rain day, else 1 minus the deposit since the last rain, floored at 0."""
    keys = list(keys)
    daily = whole_series(daily, *keys)
    by_day = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    wet = F.coalesce("precipitation_sum", F.lit(0.0)) >= rain_clean_mm
    s = daily.withColumns({
        "_wet": wet, "_pm": _filled(daily, keys, "pm2_5", K.KIMBER_PM25_IF_ALL_MISSING)})
    s = s.withColumn("_dry", F.sum(F.when(F.col("_wet"), 1).otherwise(0)).over(by_day))
    in_dry = W.partitionBy(*keys, "_dry").orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    deposit = F.sum(F.when(F.col("_wet"), F.lit(0.0)).otherwise(F.col("_pm"))).over(in_dry)
    return (s.withColumn("kimber_ratio", F.greatest(F.lit(0.0), 1.0 - deposition * deposit))
            .drop("_wet", "_pm", "_dry"))


def soiling_labels(series: DataFrame, key: str = "cell_id", day: str = "day",
                   threshold: float = 0.944) -> DataFrame:
    """Terminal-loss labels and risk score from an ``equivalent_days`` series.

    The equivalent-day label uses the LAST day of the window; risk = min(1, SL / SL_sat).
    """
    heavy = F.coalesce("precipitation_sum", F.lit(0.0)) >= K.SOILING["heavy_rain_mm"]
    agg = series.groupBy(key).agg(
        F.max_by("soiling_loss", day).alias("sl"), F.max_by("eq_days", day).alias("eq"),
        F.avg("soiling_loss").alias("mean_sl"), F.max(day).alias("as_of"),
        F.max(F.when(heavy, F.col(day))).alias("last_heavy_rain"))
    return agg.select(
        key, "as_of", (1.0 - F.col("sl")).alias("iwsr"),
        (1.0 - F.col("sl") < threshold).cast("int").alias("label"),
        half_even(F.least(F.lit(1.0), F.col("sl") / K.SOILING["sl_sat"]), 3).alias("risk_score"),
        half_even(F.col("sl") * 100.0, 3).alias("loss_pct"),
        half_even(F.col("mean_sl") * 100.0, 3).alias("mean_loss_pct"),
        half_even(F.col("eq"), 1).alias("eq_days"), "last_heavy_rain")


def kimber_labels(series: DataFrame, key: str = "cell_id", threshold: float = 0.97) -> DataFrame:
    """Mean-ratio labels from a ``kimber_ratio`` series."""
    agg = series.groupBy(key).agg(F.avg("kimber_ratio").alias("iwsr"))
    return agg.withColumn("label", (F.col("iwsr") < threshold).cast("int"))


# ---- recovery of one clean -----------------------------------------------------------------------
def recovery_of_clean(series: DataFrame, keys: Sequence[str], clean_day: str, day: str = "day",
                      efficacy: float = 1.0, weight: str | None = None,
                      params: dict | None = None) -> DataFrame:
    """Share of a series' soiling loss that one clean returns; one clean per series.

    ``series`` comes from ``equivalent_days`` and carries the column ``clean_day``. The gap between
    the dirty and the cleaned trajectory is ``efficacy * eq_c * exp(S - S_c)`` inside the clean's
    segment and 0 elsewhere, so one pass over the series suffices.
    """
    p = {**K.SOILING, **(params or {})}
    keys = list(keys)
    whole = W.partitionBy(*keys)
    at = F.col(day) == F.col(clean_day)
    s = series.withColumns({
        "_w": F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0),
        "_cs": F.max(F.when(at, F.col("s_log"))).over(whole),
        "_ce": F.max(F.when(at, F.col("eq_days"))).over(whole),
        "_cg": F.max(F.when(at, F.col("seg"))).over(whole)})
    inside = (F.col("seg") == F.col("_cg")) & (F.col(day) >= F.col(clean_day))
    gap = efficacy * F.col("_ce") * F.exp(F.col("s_log") - F.col("_cs"))
    s = s.withColumn("_saved", F.when(inside, p["sl_sat"] * (
        F.exp(-(F.col("eq_days") - gap) / p["k"]) - F.exp(-F.col("eq_days") / p["k"]))).otherwise(F.lit(0.0)))
    after = F.col(day) >= F.col(clean_day)
    rank = F.sum(F.when(after, 1).otherwise(0)).over(
        W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, 0)) - 1
    heavy = F.coalesce("precipitation_sum", F.lit(0.0)) >= p["heavy_rain_mm"]
    s = s.withColumn("_r", rank)
    agg = s.groupBy(*keys).agg(
        F.first(clean_day).alias("clean_day"),
        F.sum(F.col("soiling_loss") * F.col("_w")).alias("_den"),
        F.sum(F.col("_saved") * F.col("_w")).alias("_num"),
        F.min(F.when(after & (F.col("_saved") <= 1e-9), F.col("_r"))).alias("_end"),
        F.max("_r").alias("_last"),
        F.min(F.when(after & heavy, F.col("_r"))).alias("days_to_next_heavy_rain"),
        (F.avg("soiling_loss") * 100.0).alias("mean_sl_pct"),
        (F.max(F.when(at, F.col("soiling_loss"))) * 100.0).alias("sl_at_clean_pct"))
    frac = F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(F.lit(0.0))
    return agg.select(
        *keys, "clean_day", F.greatest(F.lit(0.0), F.least(F.lit(1.0), frac)).alias("recovery_frac"),
        F.coalesce("_end", "_last").alias("benefit_days"), "days_to_next_heavy_rain",
        "mean_sl_pct", "sl_at_clean_pct")


def recovery_calendar(series: DataFrame, keys: Sequence[str], day: str = "day", stride: int = 7,
                      efficacy: float = 1.0, weight: str | None = None,
                      params: dict | None = None) -> DataFrame:
    """Recovery share for every ``stride``-th day of each (at most one-year) series.

    Every row receives the candidate cleans of its own segment so far: at most 366/stride of them,
    whatever the data volume. The exploded pairs stay in the task and collapse in the partial
    aggregate; only one row per candidate is shuffled.
    """
    p = {**K.SOILING, **(params or {})}
    keys = list(keys)
    in_series = W.partitionBy(*keys).orderBy(day)
    s = series.withColumns({
        "_i": F.row_number().over(in_series) - 1,
        "_n": F.count(F.lit(1)).over(W.partitionBy(*keys)),
        "_w": F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0),
        "_den": F.sum(F.col("soiling_loss") * (
            F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0))).over(W.partitionBy(*keys))})
    cand = F.when(F.col("_i") % stride == 0, F.struct(
        F.col(day).alias("clean_day"), F.col("_i").alias("ci"), F.col("eq_days").alias("ce"),
        F.col("s_log").alias("cs"), F.col("_den").alias("den"), F.col("_n").alias("n")))
    seg = W.partitionBy(*keys, "seg").orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("_cands", F.collect_list(cand).over(seg))
    pairs = s.select(*keys, "_i", "_w", "eq_days", "s_log", F.explode("_cands").alias("c"))
    gap = efficacy * F.col("c.ce") * F.exp(F.col("s_log") - F.col("c.cs"))
    saved = p["sl_sat"] * (F.exp(-(F.col("eq_days") - gap) / p["k"]) - F.exp(-F.col("eq_days") / p["k"]))
    pairs = pairs.withColumn("_saved", saved)
    agg = pairs.groupBy(*keys, "c.clean_day").agg(
        F.sum(F.col("_saved") * F.col("_w")).alias("_num"), F.first("c.den").alias("_den"),
        (F.coalesce(F.min(F.when(F.col("_saved") <= 1e-9, F.col("_i"))),
                    F.least(F.max("_i") + 1, F.first("c.n") - 1)) - F.first("c.ci")).alias("benefit_days"))
    frac = F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(F.lit(0.0))
    return agg.select(*keys, "clean_day",
                      F.greatest(F.lit(0.0), F.least(F.lit(1.0), frac)).alias("recovery_frac"),
                      "benefit_days")


def best_clean_day(calendar: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best candidate per series (first on ties) with the spread of the curve."""
    day_no = F.datediff("clean_day", F.to_date(F.lit("1970-01-01")))
    best = F.max_by(F.struct("clean_day", "recovery_frac", "benefit_days"),
                    F.struct(F.col("recovery_frac"), -day_no))
    agg = calendar.groupBy(*keys).agg(
        best.alias("b"), F.min("recovery_frac").alias("worst_recovery_frac"),
        F.avg("recovery_frac").alias("mean_recovery_frac"), F.count(F.lit(1)).alias("n_candidates"))
    return agg.select(*keys, F.col("b.clean_day").alias("best_day"),
                      F.col("b.recovery_frac").alias("best_recovery_frac"),
                      F.col("b.benefit_days").alias("best_benefit_days"),
                      "worst_recovery_frac", "mean_recovery_frac", "n_candidates")


# ---- band and biological channels ------------------------------------------------------------------
def band_load(daily: DataFrame, keys: Sequence[str], day: str = "day", tilt: str | None = None,
              heavy_mm: float = K.SOILING["heavy_rain_mm"]) -> DataFrame:
    """Add seg and load: light rain loads the band, heavy rain flushes it."""
    keys = list(keys)
    factor = pv.tilt_soiling_factor(F.col(tilt)) if tilt else F.lit(1.0)
    rain = F.coalesce("precipitation_sum", F.lit(0.0))
    step = (F.when(rain >= heavy_mm, F.lit(0.0))
            .when(rain >= K.BAND_TRACE_MM,
                  factor * (rain - K.BAND_TRACE_MM) / (heavy_mm - K.BAND_TRACE_MM))
            .otherwise(factor * K.BAND_DRY_LOAD))
    by_day = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    s = daily.withColumn("seg", F.sum(F.when(rain >= heavy_mm, 1).otherwise(0)).over(by_day))
    in_seg = W.partitionBy(*keys, "seg").orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    return s.withColumn("load", F.sum(step).over(in_seg))


def bio_load(daily: DataFrame, keys: Sequence[str], wet_hours: str, shade: str,
             day: str = "day") -> DataFrame:
    """Add seg (always 0: rain never resets it) and load: shade-weighted wet hours so far."""
    by_day = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    return (daily.withColumn("seg", F.lit(0).cast("long"))
            .withColumn("load", F.sum(F.col(shade) * F.coalesce(F.col(wet_hours), F.lit(0.0))).over(by_day)))


def coverage(load: Column, k: float = K.BAND_K, f_sat: float | Column = K.BAND_F_SAT) -> Column:
    return f_sat * (1.0 - F.exp(-load / k))


def wash_recovery(loaded: DataFrame, keys: Sequence[str], clean_day: str, day: str = "day",
                  efficacy: float = 1.0, k: float = K.BAND_K, f_sat: float | Column = K.BAND_F_SAT,
                  case: str = "portrait_full_string", n_modules: int = 4,
                  horizon_days: int = 365) -> DataFrame:
    """Share of the loss in the ``horizon_days`` rows from the clean on that one wash returns."""
    keys = list(keys)
    at = F.col(day) == F.col(clean_day)
    whole = W.partitionBy(*keys)
    s = loaded.withColumns({"_cl": F.max(F.when(at, F.col("load"))).over(whole),
                            "_cg": F.max(F.when(at, F.col("seg"))).over(whole)})
    s = s.filter(F.col(day) >= F.col(clean_day)).withColumn(
        "_i", F.row_number().over(W.partitionBy(*keys).orderBy(day)) - 1)
    s = s.filter(F.col("_i") < horizon_days)
    left = F.when(F.col("seg") == F.col("_cg"), F.col("load") - efficacy * F.col("_cl")).otherwise(F.col("load"))
    dirty, washed = coverage(F.col("load"), k, f_sat), coverage(left, k, f_sat)
    s = s.withColumns({"_d": pv.band_loss_pct(dirty, case, n_modules),
                       "_c": pv.band_loss_pct(washed, case, n_modules), "_fd": dirty})
    agg = s.groupBy(*keys).agg(
        F.sum("_d").alias("_den"), F.sum(F.col("_d") - F.col("_c")).alias("_num"),
        F.avg("_d").alias("mean_loss_pct_no_clean"), F.avg("_c").alias("mean_loss_pct_cleaned"),
        F.max_by("_fd", day).alias("f_final_no_clean"), F.count(F.lit(1)).alias("days"))
    return agg.select(*keys, F.when(F.col("_den") > 0, F.col("_num") / F.col("_den"))
                      .otherwise(F.lit(0.0)).alias("recovery_frac"),
                      "mean_loss_pct_no_clean", "mean_loss_pct_cleaned", "f_final_no_clean", "days")


def wetness_per_year(hourly: DataFrame, key: str) -> DataFrame:
    """Wet, dew and growth-weighted hours per year of hourly weather (t, rh, dew point)."""
    t, rh, dp = F.col("temperature_2m"), F.col("relative_humidity_2m"), F.col("dew_point_2m")
    iso = (rh >= K.RH_WET_PCT) & (t > 0.0)
    dew = (t - dp) < K.DEW_DEPRESSION_C
    growth = F.when(t >= K.GROWTH_FLOOR_C, F.pow(F.lit(2.0), (t - K.GROWTH_REF_C) / 10.0)).otherwise(F.lit(0.0))

    def hours(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    rows = hourly.dropna(subset=["temperature_2m", "relative_humidity_2m", "dew_point_2m"])
    agg = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_hours"), hours(iso).alias("iso"), hours(dew).alias("dew"),
        hours(iso | dew).alias("wet"), F.sum(F.when(iso | dew, growth)).alias("growth"))
    years = F.col("n_hours") / 8766.0
    return agg.select(key, "n_hours", (F.col("iso") / years).alias("iso_hours_per_year"),
                      (F.col("dew") / years).alias("dew_hours_per_year"),
                      (F.col("wet") / years).alias("wet_hours_per_year"),
                      (100.0 * F.col("wet") / F.col("n_hours")).alias("wet_pct"),
                      (F.coalesce("growth", F.lit(0.0)) / years).alias("growth_hours_per_year"))


def growth_hours_daily(hourly: DataFrame, key: str, ts: str) -> DataFrame:
    """Growth-weighted wet hours per (key, day); input of the biological channel."""
    t, rh, dp = F.col("temperature_2m"), F.col("relative_humidity_2m"), F.col("dew_point_2m")
    wet = ((rh >= K.RH_WET_PCT) & (t > 0.0)) | ((t - dp) < K.DEW_DEPRESSION_C)
    growth = F.when(wet & (t >= K.GROWTH_FLOOR_C), F.pow(F.lit(2.0), (t - K.GROWTH_REF_C) / 10.0)).otherwise(F.lit(0.0))
    return hourly.groupBy(key, F.to_date(ts).alias("day")).agg(F.sum(growth).alias("wet_hours"))
