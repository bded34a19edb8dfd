"""Production telemetry: modelled energy, performance index, soiling fits, degradation, scatter.

A system has at most one row per calendar day here, so per-system windows are bounded by the
calendar. Raw sub-daily readings are combined per day before any of them runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dustledger.functions import solar
from dustledger.functions.digests import uniform_pairs
from dustledger.functions.numeric import draw_key, uniform_fine
from dustledger.operators.ranks import exact_quantiles
from dustledger.operators.series import day_number, densify
from dustledger.session import deal, durable, spread

# Open-rack cell temperature model, ground reflectance, plane temperature coefficient.
CELL_A, CELL_B, CELL_DT = -2.98, -0.0471, 1.0
ALBEDO = 0.2
DEFAULT_GAMMA = -0.0045
Z_SUM = 1.959964 + 0.841621


def modelled_daily(hourly: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """(key, day, e_model_kwh, insolation_kwh_m2) from hourly irradiance and system constants.

    Needs lat, lon, tilt, azimuth, capacity_kw, gamma, dni, dhi, ghi, temperature_c, wind_ms. Beam
    on the plane at mid-hour, isotropic sky, reflected ground light, SAPM cell temperature.
    """
    doy, hour = F.dayofyear(ts), F.hour(ts)
    lat, lon, tilt, az = (F.col(c) for c in ("lat", "lon", "tilt", "azimuth"))
    aoi = F.greatest(F.lit(0.0), solar.cos_incidence(doy, hour, lat, lon, tilt, az))
    beam = F.when(solar.cos_zenith(doy, hour, lat, lon) > 0, aoi * F.col("dni")).otherwise(F.lit(0.0))
    cosb = F.cos(F.radians(tilt))
    poa = F.greatest(F.lit(0.0), beam + F.col("dhi") * (1.0 + cosb) / 2.0 + F.col("ghi") * ALBEDO * (1.0 - cosb) / 2.0)
    d = hourly.withColumn("_poa", F.coalesce(poa, F.lit(0.0)))
    module = F.col("_poa") * F.exp(CELL_A + CELL_B * F.col("wind_ms")) + F.col("temperature_c")
    cell = module + F.col("_poa") / 1000.0 * CELL_DT
    energy = F.greatest(F.lit(0.0), F.col("capacity_kw") * (F.col("_poa") / 1000.0) * (
        1.0 + F.coalesce("gamma", F.lit(DEFAULT_GAMMA)) * (cell - 25.0)))
    return d.groupBy(key, F.to_date(ts).alias("day")).agg(
        F.sum(energy).alias("e_model_kwh"), (F.sum("_poa") / 1000.0).alias("insolation_kwh_m2"))


def performance_index(daily: DataFrame, model: DataFrame, key: str, source: str = "energy") -> DataFrame:
    """(key, day, pi, insolation): tiny model days dropped, outliers masked, gaps filled with null rows."""
    j = daily.join(model, [key, "day"]).filter("e_model_kwh > 0.05 AND insolation_kwh_m2 > 0.1")
    if source == "energy":
        raw = F.col("energy_kwh") / F.col("e_model_kwh")
    else:
        raw = F.col("power_max_kw") / (F.col("e_model_kwh") / F.col("insolation_kwh_m2"))
    j = j.select(key, "day", raw.alias("raw"), F.col("insolation_kwh_m2").alias("insolation"))
    top = F.percentile("raw", F.lit(0.999)).over(W.partitionBy(key))
    j = j.withColumn("_top", top)
    pi = F.when((F.col("raw") > 0) & (F.col("raw") < F.col("_top") * 1.5), F.col("raw"))
    return densify(j.select(key, "day", pi.alias("pi"), "insolation"), key)


# ---- stochastic rate and recovery (Deceglie, Micheli & Muller 2018) ---------------------------------
RUN_TYPES = {"run": "long", "n_days": "int", **dict.fromkeys(("slope", "slope_lo", "slope_hi", "start", "stop"), "double"),
             "d0": "int", "d1": "int", "n_obs": "long", "w": "double", "wt": "double"}
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def _slope_blocks(t: np.ndarray, y: np.ndarray, cells: int = 1 << 20):
    """All pairwise slopes, at most about ``cells`` at a time."""
    n, first = len(t), 0
    while first < n - 1:
        last = min(n - 1, first + max(1, cells // (n - first)))
        gap = t[None, first + 1:] - t[first:last, None]
        rise = y[None, first + 1:] - y[first:last, None]
        later = np.arange(first + 1, n)[None, :] > np.arange(first, last)[:, None]
        yield rise[later] / gap[later]
        first = last


def _slope_at(t: np.ndarray, y: np.ndarray, rank: int, most: int = 1 << 20, bins: int = 4096) -> float:
    """The slope of the given rank (0-based): the range is narrowed by histograms until what is left fits in memory."""
    low, high = -np.inf, np.inf
    while True:
        inside = [s[(s >= low) & (s <= high)] for s in _slope_blocks(t, y)] if not np.isinf(low) or len(t) * (len(t) - 1) // 2 <= most else None
        if inside is not None and sum(map(len, inside)) <= most:
            return float(np.partition(np.concatenate(inside), rank)[rank])
        if np.isinf(low):
            low, high = min(s.min() for s in _slope_blocks(t, y)), max(s.max() for s in _slope_blocks(t, y))
        edges = np.linspace(low, high, bins + 1)
        count = sum(np.histogram(s, edges)[0] for s in _slope_blocks(t, y))
        at = int(np.searchsorted(np.cumsum(count), rank, side="right"))
        if edges[at] == low and edges[at + 1] == high:
            return float(low)
        # both edges stay inside; what equals the lower edge counts from this bin on, as in the histogram
        rank -= int(count[:at].sum())
        low, high = edges[at], edges[at + 1] if at == bins - 1 else np.nextafter(edges[at + 1], -np.inf)


def _slope_ranks(n: int) -> list[int]:
    """Ranks (0-based) of the median slope of n days and of the ends of its 68% interval."""
    total = n * (n - 1) // 2
    half = 0.9945 * np.sqrt(n * (n - 1) * (2 * n + 5) / 18.0) / max(total, 1) / 2.0
    return [min(total - 1, max(0, int(round(q * (total - 1))))) for q in (0.5, max(0.0, 0.5 - half), min(1.0, 0.5 + half))]


def _theil_sen(t: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Exact median slope with a 68% rank interval, in bounded memory for runs of any length."""
    ranks = _slope_ranks(len(t))
    if len(t) * (len(t) - 1) // 2 <= 1 << 20:
        # all slopes fit at once, so the three ranks need one pass
        slopes = np.partition(np.concatenate(list(_slope_blocks(t, y))), ranks)
        return tuple(float(slopes[r]) for r in ranks)
    return tuple(_slope_at(t, y, r) for r in ranks)


def _theil_sen_rows(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``_theil_sen`` of every row of (runs, days): short runs of one length together, a long run by itself."""
    m, n = t.shape
    if m * n * (n - 1) // 2 > 1 << 20:
        return np.array([_theil_sen(*row) for row in zip(t, y)])
    i, j = _pairs(n) if n <= 128 else np.triu_indices(n, 1)
    ranks = _slope_ranks(n)
    return np.partition((y[:, j] - y[:, i]) / (t[:, j] - t[:, i]), ranks, axis=1)[:, ranks]


@lru_cache(maxsize=128)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _share(ordered: np.ndarray, q: float) -> float:
    """The value at a share of sorted values, between its neighbours as Spark's percentile has it; NaN for none."""
    if len(ordered) == 0:
        return np.nan
    at = (len(ordered) - 1) * q
    low, high = int(np.floor(at)), int(np.ceil(at))
    return ordered[low] if ordered[low] == ordered[high] else (high - at) * ordered[low] + (at - low) * ordered[high]


def _run_numbers(pin: np.ndarray, half: int) -> np.ndarray:
    """The number of cleans up to each day of one series; NaN is a day without a value."""
    edge = np.full(half, np.nan)
    frames = np.sort(sliding_window_view(np.concatenate([edge, pin, edge]), 2 * half + 1), axis=1)
    n, rows = np.count_nonzero(~np.isnan(frames), axis=1), np.arange(len(pin))
    level = 0.5 * frames[rows, (n - 1) // 2] + 0.5 * frames[rows, n // 2]
    step = np.diff(level, prepend=np.nan)
    known = ~np.isnan(step)
    size = np.sort(np.abs(step[known]))
    q1, q3 = _share(size, 0.25), _share(size, 0.75)
    peak = sliding_window_view(np.concatenate([edge, step, edge]), 2 * half + 1)
    peak = np.where(np.isnan(peak), -np.inf, peak).max(axis=1)
    return np.cumsum(known & (step > q3 + 1.5 * (q3 - q1)) & (step == peak))


def _fitted_runs(t: np.ndarray, pi: np.ndarray, weight: np.ndarray, half: int) -> dict[str, np.ndarray]:
    """Runs with a value of one series in day order, as columns; NaN is a missing value."""
    base = _share(np.sort(pi[(t < t[0] + 365) & ~np.isnan(pi)]), 0.5)
    pin = pi / (base if base else np.nan)
    run = _run_numbers(pin, half)
    first = np.flatnonzero(np.diff(run, prepend=-1))
    last = np.append(first[1:], len(t)) - 1
    held, weighed = ~np.isnan(pin), ~np.isnan(weight)
    n = np.add.reduceat(held, first, dtype=np.int64)
    some = np.add.reduceat(weighed, first, dtype=np.int64) > 0
    w = np.where(weighed, weight, 0.0)
    out = {"run": run[first], "n_days": n, **{c: np.full(len(first), np.nan) for c in ("slope", "slope_lo", "slope_hi", "start", "stop")},
           "d0": t[first], "d1": t[last], "n_obs": n, "w": np.where(some, np.add.reduceat(w, first), np.nan),
           "wt": np.where(some, np.add.reduceat(w * t, first), np.nan)}
    days, values, begin = t[held].astype(float), pin[held], np.cumsum(n) - n
    for size in np.unique(n[n >= 3]):
        at = np.flatnonzero(n == size)
        cells = begin[at][:, None] + np.arange(size)
        x, y = days[cells], values[cells]
        fit = _theil_sen_rows(x, y)
        level = np.median(y - fit[:, :1] * (x - x[:, :1]), axis=1)
        for name, column in zip(("slope", "slope_lo", "slope_hi", "start", "stop"), (*fit.T, level, level + fit[:, 0] * (x[:, -1] - x[:, 0]))):
            out[name][at] = column
    return {c: v[n > 0] for c, v in out.items()}


def soiling_intervals(index: DataFrame, key: str, window: int = 13, min_days: int = 7) -> DataFrame:
    """Runs between detected cleans with their Theil-Sen slope and validity.

    A clean is a jump of the centred rolling median beyond Q3 + 1.5 IQR of the absolute jumps, kept
    only where it is the largest jump of its neighbourhood. The index is first scaled by its
    first-year median. Rows without a day are left out, NaN is a missing value. The days of one series, bounded by the
    calendar, meet in a task; runs leave it.
    """
    days = index.filter("day IS NOT NULL").select(key, day_number().alias("dn"), F.col("pi").cast("double").alias("pi"), F.col("insolation").cast("double").alias("insolation"))

    def fit(series: pa.Table) -> pa.Table:
        columns = [series.column(c).to_numpy() for c in ("dn", "pi", "insolation")]
        order = np.argsort(columns[0], kind="stable")
        runs = _fitted_runs(*(c[order] for c in columns), window // 2)
        keys = series.column(key).combine_chunks().take(pa.array(np.zeros(len(runs["run"]), np.int64)))
        return pa.table({key: keys, **{c: pa.array(v, ARROW[RUN_TYPES[c]], from_pandas=True) for c, v in runs.items()}})

    j = days.groupBy(key).applyInArrow(fit, ", ".join([f"`{key}` {dict(index.dtypes)[key]}", *[f"{c} {t}" for c, t in RUN_TYPES.items()]]))
    err = F.abs((F.col("slope_hi") - F.col("slope_lo")) / F.nullif(F.col("slope"), F.lit(0.0)))
    prev_stop = F.lag("stop").over(W.partitionBy(key).orderBy("run"))
    return j.withColumn("recovery", F.greatest(F.lit(0.0), F.coalesce(F.col("start") - prev_stop, F.lit(0.0)))).withColumn(
        "valid", F.coalesce((F.col("slope") < 0) & (F.col("n_days") >= min_days) & (err <= 5.0), F.lit(False)))


def _ratio_draws(head: str, runs: dict[str, np.ndarray], seed: int, reps: int, method: str, block: int = 24_000) -> np.ndarray:
    """The sorted ratios of one system's draws; its valid runs are walked in order, all draws at a time."""
    num, den, stop = np.zeros(reps), 0.0, np.ones(reps)
    per = max(1, block // reps)
    for i, run in enumerate(runs["run"]):
        if i % per == 0:
            u = uniform_pairs(head, reps, [f"|{r}|{seed}" for r in runs["run"][i:i + per]])
        radius, angle = np.sqrt(-2.0 * np.log(u[i % per, :, 0])), 6.283185307179586 * u[i % per, :, 1]
        slope = np.minimum(0.0, runs["slope"][i] + radius * np.cos(angle) * runs["se"][i])
        if method == "perfect_clean":
            start = 1.0
        else:
            reach = np.clip(stop + runs["recovery"][i], 0.0, 1.0)
            start = np.minimum(1.0, np.abs(radius * np.sin(angle) * (1.0 - reach) / 3.0) + reach)
        num = num + start * runs["w"][i] + slope * runs["wt"][i]
        den = den + runs["w"][i]
        stop = start + slope * runs["len"][i]
    return np.sort(num / den) if den else np.full(reps, np.nan)


def soiling_ratio(intervals: DataFrame, key: str, method: str = "half_norm_clean", reps: int = 1000, seed: int = 1234) -> DataFrame:
    """Insolation-weighted soiling ratio with a 95% Monte Carlo interval per system.

    Draws walk the valid runs of a system in order, inside one row (at most one array
    element per week of history): the draws of a system are arrays in the task and its quantiles leave it. ``perfect_clean`` starts
    each run at 1; ``half_norm_clean`` starts between the level the run recovers to and 1. A draw of a run is a function of
    (system, draw, run, seed), see ``numeric.uniform``. A system without a key has no ratio.
    """
    columns, kept = ("run", "slope", "se", "w", "wt", "len", "recovery"), (key, "n_intervals", "n_valid")
    run = F.struct("run", "slope", ((F.col("slope_hi") - F.col("slope_lo")) / 2.0).alias("se"), "w",
                   (F.col("wt") - F.col("d0") * F.col("w")).alias("wt"), (F.col("d1") - F.col("d0")).cast("double").alias("len"), "recovery")
    # one row per system with its counts, so that the runs are made once
    per = intervals.groupBy(key).agg(F.count(F.lit(1)).alias("n_intervals"), F.sum(F.col("valid").cast("int")).alias("n_valid"),
                                     F.array_sort(F.collect_list(F.when(F.col("valid"), run))).alias("runs"))
    rows = deal(per, key).select(key, "n_intervals", "n_valid", F.concat(F.col(key).cast("string"), F.lit("|")).alias("_head"),
                                 *[F.col(f"runs.{c}").alias(f"_{c}") for c in columns])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quantiles = []
            for i, head in enumerate(batch.column("_head").to_pylist()):
                runs = {c: batch.column(f"_{c}")[i].values.to_numpy(zero_copy_only=False) for c in columns}
                ratios = _ratio_draws(head, runs, seed, reps, method) if head else np.empty(0)
                quantiles.append([_share(ratios, q) for q in (0.5, 0.025, 0.975)])
            values = np.array(quantiles, float).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(v, pa.float64(), from_pandas=True) for v in values]],
                                             [*kept, "soiling_ratio", "ci_lo", "ci_hi"])

    drawn = rows.mapInArrow(draw, f"`{key}` {dict(intervals.dtypes)[key]}, n_intervals long, n_valid long, soiling_ratio double, ci_lo double, ci_hi double")
    return drawn.withColumns({
        "loss_pct": 100.0 * (1.0 - F.col("soiling_ratio")),
        "degenerate": F.coalesce((F.col("n_valid") < 5) | (F.col("soiling_ratio") >= 0.99995), F.lit(True))})


def interval_starts(intervals: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Start levels of valid runs: per-system median, then the median over systems (the unit).

    The rows of the systems are written once, since both results start from them.
    """
    per = durable(intervals.filter("valid").groupBy(key).agg(F.percentile("start", F.lit(0.5)).alias("median_start"), F.count(F.lit(1)).alias("n_runs")))
    return per, exact_quantiles(per, [], "median_start", {"median_of_medians": 0.5})


# ---- degradation and scatter ---------------------------------------------------------------------------
def year_on_year(index: DataFrame, key: str, min_days: int = 730) -> DataFrame:
    """(key, n_days, n_pairs, rd_pct_per_yr): median of 365-day changes over the first-year median."""
    d = index.filter("pi IS NOT NULL").withColumn("dn", day_number())
    lagged = F.first("pi").over(W.partitionBy(key).orderBy("dn").rangeBetween(-365, -365))
    d = d.withColumns({"_prev": lagged, "_first": F.min("dn").over(W.partitionBy(key)), "_n": F.count(F.lit(1)).over(W.partitionBy(key))})
    agg = d.filter(F.col("_n") >= min_days).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_days"), F.count("_prev").alias("n_pairs"),
        F.percentile(F.when(F.col("dn") < F.col("_first") + 365, F.col("pi")), F.lit(0.5)).alias("_base"),
        F.percentile(F.col("pi") - F.col("_prev"), F.lit(0.5)).alias("_step"))
    return agg.select(key, "n_days", "n_pairs", (100.0 * F.col("_step") / F.col("_base")).alias("rd_pct_per_yr"))


def year_on_year_interval(index: DataFrame, key: str, min_days: int = 730, draws: int = 1000, level: float = 0.682, seed: int = 42) -> DataFrame:
    """(key, n_days, n_pairs, rd_pct_per_yr, rd_lo, rd_hi, block_days): ``year_on_year`` with a resampling interval.

    The 365-day changes of a system are put in day order on a circle. A draw takes blocks of sqrt(n) neighbouring changes, from
    starts that are functions of (system, draw, block, seed), until it has n of them, and notes their median; blocks keep the
    dependence between neighbouring days. The interval holds the middle ``level`` of the medians. A system without pairs has
    a null interval. The changes of one system, bounded by the calendar, are one array; draws are rows.
    """
    d = index.filter("pi IS NOT NULL").withColumn("dn", day_number())
    d = d.withColumn("_prev", F.first("pi").over(W.partitionBy(key).orderBy("dn").rangeBetween(-365, -365)))
    steps = d.filter("_prev IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dn", (F.col("pi") - F.col("_prev")).alias("v")))).alias("_s"))
    s = steps.select(key, F.transform("_s", lambda x: x["v"]).alias("_s"), F.size("_s").alias("_n")).withColumn("block_days", F.ceil(F.sqrt(F.col("_n"))).cast("int"))
    point = year_on_year(index, key, min_days)
    base = d.withColumn("_first", F.min("dn").over(W.partitionBy(key))).groupBy(key).agg(
        F.percentile(F.when(F.col("dn") < F.col("_first") + 365, F.col("pi")), F.lit(0.5)).alias("_base"))
    rows = spread(s.join(point.select(key), key), key).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))

    def start(k: Column) -> Column:
        return F.floor(uniform_fine(draw_key(F.col(key), F.col("draw"), k, seed)) * F.col("_n")).cast("int")

    def block(k: Column) -> Column:
        return F.transform(F.array(start(k)), lambda at: F.transform(F.sequence(F.lit(0), F.col("block_days") - 1), lambda j: F.get("_s", (at + j) % F.col("_n"))))[0]

    blocks = F.sequence(F.lit(0), F.ceil(F.col("_n") / F.col("block_days")).cast("int") - 1)
    drawn = rows.withColumn("_d", F.sort_array(F.slice(F.flatten(F.transform(blocks, block)), F.lit(1), F.col("_n"))))
    low, high = F.floor((F.col("_n") - 1) / 2).cast("int"), F.ceil((F.col("_n") - 1) / 2).cast("int")
    medians = drawn.select(key, "block_days", ((F.get("_d", low) + F.get("_d", high)) / 2.0).alias("_m"))
    band = medians.groupBy(key).agg(F.first("block_days").alias("block_days"), F.percentile("_m", F.lit((1 - level) / 2)).alias("_lo"),
                                    F.percentile("_m", F.lit((1 + level) / 2)).alias("_hi"))
    return point.join(base, key).join(band, key, "left").select(
        key, "n_days", "n_pairs", "rd_pct_per_yr", (100.0 * F.col("_lo") / F.col("_base")).alias("rd_lo"), (100.0 * F.col("_hi") / F.col("_base")).alias("rd_hi"), "block_days")


def residual_scatter(index: DataFrame, key: str, window: int = 15, per_side: int = 30) -> DataFrame:
    """(key, n_days, sigma, lag1, mde): log scatter around a centred rolling median and the smallest step it lets one see."""
    by_day = W.partitionBy(key).orderBy("day")
    frame = by_day.rowsBetween(-(window // 2), window // 2)
    need = max(3, window // 3)
    d = index.withColumns({"_m": F.percentile("pi", F.lit(0.5)).over(frame), "_c": F.count("pi").over(frame)})
    d = d.withColumn("r", F.when((F.col("_c") >= need) & (F.col("pi") > 0), F.log(F.col("pi") / F.col("_m")))).filter("r IS NOT NULL")
    d = d.withColumn("_p", F.lag("r").over(by_day))
    agg = d.groupBy(key).agg(F.count(F.lit(1)).alias("n_days"), F.stddev_samp("r").alias("sigma"),
                             F.corr(F.when(F.col("_p").isNotNull(), F.col("r")), F.col("_p")).alias("_rho"))
    rho = F.when(F.col("n_days") > 5, F.nanvl(F.col("_rho"), F.lit(None).cast("double")))
    agg = agg.withColumn("lag1", rho)
    used = F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.coalesce("lag1", F.lit(0.0))))
    n_eff = per_side * (1.0 - used) / (1.0 + used)
    return agg.select(key, "n_days", "sigma", "lag1", (Z_SUM * F.col("sigma") * F.sqrt(2.0 / F.greatest(n_eff, F.lit(1.0)))).alias("mde"))


def fahrenheit_to_celsius(readings: DataFrame, source: str, value: str) -> DataFrame:
    """Per source: values are Fahrenheit when their exact 99th percentile is above 50; converted and noted."""
    q = exact_quantiles(readings, [source], value, {"p99": 0.99}).select(source, "p99")
    f = F.col("p99") > 50
    return readings.join(q, source).withColumns({
        "celsius": F.when(f, (F.col(value) - 32.0) * 5.0 / 9.0).otherwise(F.col(value)),
        "unit_note": F.when(f, "fahrenheit_converted").otherwise("celsius")}).drop("p99")


def coverage_by_year(daily: DataFrame, keys: Sequence[str], value: str, min_obs: int = 60) -> DataFrame:
    """Observations, maximum and 95th percentile per year; years with few observations are left out."""
    g = daily.withColumn("year", F.year("day")).filter(F.col(value).isNotNull())
    q = exact_quantiles(g, [*keys, "year"], value, {"p95": 0.95})
    m = g.groupBy(*keys, "year").agg(F.max(value).alias("max_value"))
    return q.filter(F.col("n") >= min_obs).join(m, [*keys, "year"])


def flatten_fits(nested: DataFrame, key: str, fits: str = "fits", min_valid: int = 5) -> DataFrame:
    """MAP<source, MAP<method, fit>> to rows with a skip reason (null = kept)."""
    a = nested.select(key, F.explode(fits).alias("source", "m")).select(key, "source", F.explode("m").alias("method", "f"))
    reason = (F.when(F.col("f.loss_pct").isNull(), "no_fit").when(F.coalesce(F.col("f.degenerate"), F.lit(False)), "degenerate")
              .when(F.col("f.n_valid_intervals") < min_valid, "low_n_valid"))
    return a.select(key, "source", "method", F.col("f.loss_pct").alias("loss_pct"), F.col("f.n_valid_intervals").alias("n_valid"), reason.alias("skip_reason"))
