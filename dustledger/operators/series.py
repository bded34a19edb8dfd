"""Daily-series features per grid cell: trailing windows, streaks, densifying, resampling.

A cell holds at most one row per calendar day, so its windows are bounded by the calendar and not
by the volume of raw records, which are combined per (cell, day) before any window runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dustledger import constants as K
from dustledger.session import series as whole_series

CELL, DAY = "cell_id", "day"


def day_number(day: str | Column = DAY) -> Column:
    return F.datediff(F.col(day) if isinstance(day, str) else day, F.to_date(F.lit("1970-01-01")))


def trailing(days: int, key: str = CELL):
    """Frame over the last ``days`` calendar days, the current one included."""
    return W.partitionBy(key).orderBy("day_no").rangeBetween(-(days - 1), 0)


def _mean_columns() -> tuple[str, ...]:
    return ("wind_speed_10m_max", "relative_humidity_2m_mean", "temperature_2m_max", "pm2_5", "pm10")


def trailing_features(daily: DataFrame, windows: Sequence[int] = K.FEATURE_WINDOWS) -> DataFrame:
    """Trailing sums and means per cell-day; a window without a value gives null."""
    out = daily.withColumn("day_no", day_number())
    cols = {}
    for d in windows:
        w = trailing(d)
        cols[f"precip_{d}d_mm"] = F.sum("precipitation_sum").over(w)
        for name in _mean_columns():
            if name in daily.columns:
                cols[f"{name}_{d}d_mean"] = F.avg(name).over(w)
    return out.withColumns(cols)


def humidity_features(daily: DataFrame, windows: Sequence[int] = K.FEATURE_WINDOWS) -> DataFrame:
    """Humid days, and humid-but-dry days (dew without rain), per trailing window."""
    humid = F.coalesce(F.col("relative_humidity_2m_mean") >= K.DEW_HUMIDITY_PCT, F.lit(False))
    dry = F.coalesce(F.col("precipitation_sum"), F.lit(0.0)) < 1.0
    out = daily.withColumn("day_no", day_number())
    cols = {}
    for d in windows:
        w = trailing(d)
        cols[f"humid_days_{d}d"] = F.sum(humid.cast("long")).over(w)
        cols[f"dew_no_rain_days_{d}d"] = F.sum((humid & dry).cast("long")).over(w)
    return out.withColumns(cols)


def rain_streaks(daily: DataFrame, dry_mm: float = 1.0, rain_mm: float = 5.0) -> DataFrame:
    """Dry-day streak and rows since significant rain; days without a reading do not count.

    A day without a reading carries the values of the last day that has one.
    """
    by_day = W.partitionBy(CELL).orderBy(DAY).rowsBetween(W.unboundedPreceding, 0)
    p = F.col("precipitation_sum")
    out = daily.withColumn("_n", F.count(p).over(by_day))
    for name, hit in (("dry_day_streak", p >= dry_mm), ("days_since_rain", p >= rain_mm)):
        last = F.max(F.when(hit, F.col("_n"))).over(by_day)
        out = out.withColumn(name, F.col("_n") - F.coalesce(last, F.lit(0)))
    return out.drop("_n")


def densify(daily: DataFrame, key: str = CELL, day: str = DAY) -> DataFrame:
    """Every calendar day between a series' first and last; gaps become null rows.

    Each row is followed by the days up to the next one, so the series is clustered once and no grid is joined to it. Rows without
    a day go; rows without a key are one series of null rows.
    """
    after = F.coalesce(F.date_sub(F.lead(day).over(W.partitionBy(key).orderBy(day)), 1), F.col(day))
    until, known = F.col("_until"), F.col(key).isNotNull()
    # of several rows of one day the last one is followed by the gap
    days = F.when(known | (until >= F.col(day)), F.sequence(F.col(day), F.greatest(F.col(day), until)))
    rows = daily.filter(F.col(day).isNotNull()).withColumn("_until", after).withColumn("_day", F.explode(days))
    return rows.select(key, F.col("_day").alias(day), *[F.when(known & (F.col("_day") == F.col(day)), F.col(c)).alias(c) for c in daily.columns if c not in (key, day)])


def hourly_to_daily(readings: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Mean per hour first, then per day the mean, the sum of hourly means and the hour count.

    Two stages make the result independent of the sampling cadence.
    """
    hourly = (readings.groupBy(*keys, F.date_trunc("hour", ts).alias("hour"))
              .agg(F.avg(value).alias("hour_mean")))
    return (hourly.groupBy(*keys, F.to_date("hour").alias("day"))
            .agg(F.avg("hour_mean").alias("day_mean"), F.sum("hour_mean").alias("day_sum"),
                 F.count("hour_mean").alias("n_hours")))


def quarter_hour_means(readings: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    return (readings.groupBy(*keys, F.window(ts, "15 minutes").alias("w"))
            .agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))
            .select(*keys, F.col("w.start").alias("slot"), "mean_value", "n"))


def rain_regime(daily: DataFrame, key: str = CELL, light_mm: float = 0.2,
                heavy_mm: float = K.SOILING["heavy_rain_mm"]) -> DataFrame:
    """Light, heavy and dry days per 365.25 observed days, and light/heavy (null if no heavy)."""
    p = F.coalesce("precipitation_sum", F.lit(0.0))

    def days(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    agg = daily.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_days"), days((p >= light_mm) & (p < heavy_mm)).alias("light"),
        days(p >= heavy_mm).alias("heavy"), days(p < light_mm).alias("dry"))
    years = F.col("n_days") / 365.25
    return agg.select(
        key, "n_days", (F.col("light") / years).alias("light_per_year"),
        (F.col("heavy") / years).alias("heavy_per_year"), (F.col("dry") / years).alias("dry_per_year"),
        (F.col("light") / F.when(F.col("heavy") > 0, F.col("heavy"))).alias("light_heavy_ratio"))


def longest_dry_stretch(forecast: DataFrame, key: str, threshold_mm: float | Column) -> DataFrame:
    """(key, dry_len, dry_end): last offset of the longest run below the threshold, first wins.

    A forecast has a handful of days per area, so one window per area is bounded.
    """
    w = W.partitionBy(key).orderBy("day_offset").rowsBetween(W.unboundedPreceding, 0)
    dry = F.col("rain_mm") < threshold_mm
    runs = (forecast.withColumn("_wet", F.sum(F.when(dry, 0).otherwise(1)).over(w))
            .filter(dry).groupBy(key, "_wet")
            .agg(F.count(F.lit(1)).alias("_len"), F.max("day_offset").alias("_end")))
    best = runs.groupBy(key).agg(F.max(F.struct(F.col("_len"), -F.col("_end"))).alias("b"))
    return best.select(key, F.col("b._len").alias("dry_len"), (-F.col("b.col2")).alias("dry_end"))


def median_interval_seconds(readings: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Median seconds between neighbouring readings, per day-sized slice of each series.

    Neighbours are found inside (series, month) slices, so no series is sorted as a whole; the
    gap that crosses a month is closed with the previous month's last stamp.
    """
    month = F.date_trunc("month", ts)
    part = W.partitionBy(*keys, "_m").orderBy(ts)
    rows = readings.filter(F.col(ts).isNotNull()).withColumn("_m", month)
    last = (rows.groupBy(*keys, "_m").agg(F.max(ts).alias("_last"))
            .withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy("_m")))
            .select(*keys, "_m", "_carry"))
    gaps = (rows.withColumn("_prev", F.lag(ts).over(part)).join(last, [*keys, "_m"])
            .withColumn("gap_s", (F.unix_micros(F.col(ts).cast("timestamp"))
                                  - F.unix_micros(F.coalesce("_prev", "_carry").cast("timestamp"))) / 1e6))
    return gaps.filter("gap_s IS NOT NULL")


def feature_matrix(entities: DataFrame, daily: DataFrame, entity_id: str, as_of: str = "as_of",
                   windows: Sequence[int] = K.FEATURE_WINDOWS) -> DataFrame:
    """All cell features for every (entity, as_of), each cell series computed once.

    ``entities`` (id, cell_id, as_of, ...static). As-of days without a reading are added to the
    series as empty rows, so calendar windows end exactly on them; physics series are computed on
    the readings alone. ``somosclean_sl_proxy`` is the last loss up to the day, ``kimber_iwsr_proxy`` the mean ratio up to it.
    """
    from dustledger.operators.soiling import equivalent_days, kimber_ratio

    asked = entities.select(CELL, F.col(as_of).alias(DAY)).distinct().withColumn("_asked", F.lit(True))
    base = kimber_ratio(equivalent_days(daily)).drop("seg", "s_log").withColumn("_real", F.lit(True))
    full = whole_series(base.join(asked, [CELL, DAY], "full"), CELL).withColumn("day_no", day_number())
    full = trailing_features(full, windows)
    humid = F.coalesce(F.col("relative_humidity_2m_mean") >= K.DEW_HUMIDITY_PCT, F.lit(False))
    dew = humid & (F.coalesce(F.col("precipitation_sum"), F.lit(0.0)) < 1.0)
    cols = {}
    for d in windows:
        w = trailing(d)
        cols[f"humid_days_{d}d"] = F.sum(F.when(F.col("_real"), humid.cast("long"))).over(w)
        cols[f"dew_no_rain_days_{d}d"] = F.sum(F.when(F.col("_real"), dew.cast("long"))).over(w)
        cols[f"kimber_iwsr_{d}d_mean"] = F.avg("kimber_ratio").over(w)
    for d in (7, 30):
        cols[f"somosclean_sl_{d}d_mean"] = F.avg("soiling_loss").over(trailing(d))
    sofar = W.partitionBy(CELL).orderBy(DAY).rowsBetween(W.unboundedPreceding, 0)
    cols["somosclean_sl_proxy"] = F.last("soiling_loss", ignorenulls=True).over(sofar)
    cols["kimber_iwsr_proxy"] = F.avg("kimber_ratio").over(sofar)
    full = rain_streaks(full.withColumns(cols)).filter("_asked")
    drop = ["_asked", "_real", "day_no", "eq_days", "soiling_loss", "kimber_ratio", "precipitation_sum", "pm10", "pm2_5",
            "wind_speed_10m_max", "relative_humidity_2m_mean", "temperature_2m_max"]
    feats = full.drop(*drop).withColumnRenamed(DAY, as_of)
    return entities.join(feats, [CELL, as_of]).withColumn("month_of_year", F.month(as_of))
