"""Queries of the hourly, telemetry, solar-table, lidar and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dustledger import constants as K
from dustledger.functions import pv
from dustledger.functions.numeric import half_even, micro
from dustledger.operators import lidar as LI, series as S, soiling as SO, solar_tables as SOL, telemetry as TE
from dustledger.operators.ranks import attach_row, exact_quantiles
from dustledger.plans.q_series import KIMBER, eq_sql
from dustledger.plans.q_decision import LOW_TILT
from dustledger.plans.registry import query
from dustledger.plans.views import ctes, m6, sql_draw_fine, view


def _round(df, *cols):
    return df.withColumns({c: micro(F.col(c)) for c in cols})


view("hourly", ("events",), """
select user_id as cell, ts, 3e0 + event_id % 25 as temperature_2m, 60e0 + event_id % 40 as relative_humidity_2m, 3e0 + event_id % 25 - event_id % 7 as dew_point_2m
from {events}""")
view("indexed", ("lineitem",), """
select l_suppkey % 10 as system_id, cast(l_shipdate as date) as day, sum(l_quantity) / (count(*) * 25e0) as pi, sum(l_quantity) as energy_kwh, max(l_quantity) as power_max_kw,
  count(*) * 25e0 as e_model_kwh, count(*) * 1e0 as insolation_kwh_m2 from {lineitem} group by 1, 2""")

# ---- features ---------------------------------------------------------------------------------------------
_ENT = "ent as (select o_orderkey as id, o_custkey % (select count(*) from supplier) as cell_id, cast(o_orderdate as date) as as_of from orders)"


_MEANS = ("wind_speed_10m_max", "relative_humidity_2m_mean", "temperature_2m_max", "pm2_5", "pm10")
_WINDOWS = (7, 30, 90)
_DEW = "relative_humidity_2m_mean >= 85 and coalesce(precipitation_sum, 0) < 1"
_BY_WINDOW = ", ".join(f"""w{d} as (select u.cell_id, u.as_of, sum(precipitation_sum) as precip_{d}d_mm, {', '.join(f'avg({c}) as {c}_{d}d_mean' for c in _MEANS)},
   count(case when relative_humidity_2m_mean >= 85 then 1 end) as humid_days_{d}d, count(case when {_DEW} then 1 end) as dew_no_rain_days_{d}d
   from u join weather w on w.cell_id = u.cell_id and w.day between u.as_of - {d - 1} and u.as_of group by 1, 2),
 k{d} as (select u.cell_id, u.as_of, avg(kimber_ratio) as kimber_iwsr_{d}d_mean from u join kim w on w.cell_id = u.cell_id and w.day between u.as_of - {d - 1} and u.as_of group by 1, 2),
 l{d} as (select u.cell_id, u.as_of, avg(soiling_loss) as somosclean_sl_{d}d_mean from u join eqd w on w.cell_id = u.cell_id and w.day between u.as_of - {d - 1} and u.as_of group by 1, 2)""" for d in _WINDOWS)
_ROUNDED = ([f"precip_{d}d_mm" for d in _WINDOWS] + [f"{c}_{d}d_mean" for c in _MEANS for d in _WINDOWS]
            + ["somosclean_sl_7d_mean", "somosclean_sl_30d_mean", "somosclean_sl_proxy"])
_FINE = [f"kimber_iwsr_{d}d_mean" for d in _WINDOWS] + ["kimber_iwsr_proxy"]
_COUNTS = [f"{c}_{d}d" for c in ("humid_days", "dew_no_rain_days") for d in _WINDOWS]


@query("e5_feature_matrix", ctes("weather", extra=_ENT + ", " + eq_sql("cell_id", "weather") + ", " + KIMBER + f""",
 u as (select distinct cell_id, as_of from ent), {_BY_WINDOW},
 l as (select u.cell_id, u.as_of, arg_max(soiling_loss, day) as somosclean_sl_proxy from u join eqd w on w.cell_id = u.cell_id and w.day <= u.as_of group by 1, 2),
 kp as (select u.cell_id, u.as_of, avg(kimber_ratio) as kimber_iwsr_proxy from u join kim w on w.cell_id = u.cell_id and w.day <= u.as_of group by 1, 2),
 n as (select *, count(precipitation_sum) over (partition by cell_id order by day rows unbounded preceding) as n from weather),
 s as (select u.cell_id, u.as_of, count(n.precipitation_sum) - coalesce(max(case when n.precipitation_sum >= 1 then n.n end), 0) as dry_day_streak from u left join n on n.cell_id = u.cell_id and n.day <= u.as_of group by 1, 2)""")
       + f"""select e.id, e.cell_id, e.as_of, {', '.join(f'{m6(c)} as {c}' for c in _ROUNDED)}, {', '.join(f'round_even(({c} + 3.3e-8) * 1e7, 0) / 1e7 as {c}' for c in _FINE)},
 {', '.join(_COUNTS)}, dry_day_streak, cast(month(e.as_of) as int) as month_of_year
from ent e {' '.join(f'left join {c}{d} using (cell_id, as_of)' for d in _WINDOWS for c in 'wkl')} left join l using (cell_id, as_of) left join kp using (cell_id, as_of) left join s using (cell_id, as_of)""")
def _(t):
    n = t.read("supplier").agg(F.count(F.lit(1)).alias("_n"))
    e = attach_row(t.read("orders"), n).select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % F.col("_n")).alias("cell_id"), F.to_date("o_orderdate").alias("as_of"))
    m = S.feature_matrix(e, t.weather, "id")
    out = _round(m, *_ROUNDED).withColumns({c: half_even(F.col(c) + 3.3e-8, 7) for c in _FINE})
    return out.select("id", "cell_id", "as_of", *_ROUNDED, *_FINE, *_COUNTS, "dry_day_streak", "month_of_year")


# ---- solar tables ---------------------------------------------------------------------------------------------
def poa_sql(doy: str, hour: str, lat: str, lon: str, tilt: str, az: str) -> str:
    b = f"radians(360e0 * ({doy} - 81) / 364e0)"
    eot = f"(9.87e0 * sin(2 * {b}) - 7.53e0 * cos({b}) - 1.5e0 * sin({b}))"
    om = f"radians(15e0 * (({hour} + 0.5e0 + (4e0 * ({lon} + 120e0) + {eot}) / 60e0) - 12e0))"
    dec = f"radians(23.45e0 * sin(radians(360e0 * ({doy} + 284) / 365e0)))"
    phi, be, ga = f"radians({lat})", f"radians({tilt})", f"radians({az} - 180e0)"
    cz = f"(sin({phi}) * sin({dec}) + cos({phi}) * cos({dec}) * cos({om}))"
    aoi = (f"(sin({dec}) * (sin({phi}) * cos({be}) - cos({phi}) * sin({be}) * cos({ga})) + cos({dec}) * cos({om}) * (cos({phi}) * cos({be}) + sin({phi}) * sin({be}) * cos({ga}))"
           f" + cos({dec}) * sin({om}) * sin({be}) * sin({ga}))")
    return f"(case when {cz} > 0.02e0 and {aoi} > 0 then {aoi} * 1353e0 * power(0.7e0, power(least(20e0, greatest(1e0, 1e0 / {cz})), 0.678e0)) else 0e0 end)"


@query("e12_production_shares", f"""with s as (select s_suppkey as k, 33e0 + s_suppkey % 8 as lat, -122e0 + s_suppkey % 5 as lon, 10e0 + s_suppkey % 20 as tilt, 150e0 + s_suppkey % 60 as az from supplier),
 h as (select s.*, doy, hour, month(date '2023-01-01' + cast(doy - 1 as int)) as mo from s, range(1, 366) d(doy), range(0, 24) q(hour)),
 p as (select k, mo between 6 and 9 as su, hour between 16 and 20 as pk, {poa_sql('doy', 'hour', 'lat', 'lon', 'tilt', 'az')} as poa from h),
 a as (select k, sum(poa) as t, sum(case when su and pk then poa end) as sp, sum(case when su and not pk then poa end) as so, sum(case when not su and pk then poa end) as wp, sum(case when not su and not pk then poa end) as wo from p group by 1)
select k, {m6('sp / t')} as summer_peak, {m6('so / t')} as summer_offpeak, {m6('wp / t')} as winter_peak, {m6('wo / t')} as winter_offpeak, {m6('(sp * 0.60554e0 + so * 0.4732e0 + wp * 0.47087e0 + wo * 0.4386e0) / t')} as retail_usd_per_kwh from a""")
def _(t):
    k = F.col("s_suppkey")
    p = t.read("supplier").select(k.alias("k"), (33.0 + k % 8).alias("lat"), (-122.0 + k % 5).alias("lon"), (10.0 + k % 20).alias("tilt"), (150.0 + k % 60).alias("az"))
    return _round(SOL.production_shares(p, "k", "lat", "lon", "tilt", "az"), "summer_peak", "summer_offpeak", "winter_peak", "winter_offpeak", "retail_usd_per_kwh")


@query("e12_orientation_lookup", ctes("arrays", extra=f"""g as (select ti, ai, sum({poa_sql('doy', 'hour', '36.97e0', '-122.03e0', 'ti * 2.5e0', 'ai * 10e0')}) as poa from range(0, 25) a(ti), range(0, 37) b(ai), range(1, 366) d(doy), range(0, 24) h(hour) group by 1, 2),
 rf as (select sum({poa_sql('doy', 'hour', '36.97e0', '-122.03e0', '20e0', '180e0')}) as r from range(1, 366) d(doy), range(0, 24) h(hour)),
 gr as (select ti, ai, poa / r as v from g, rf),
 q as (select array_id, tilt_deg as tt, azimuth_deg as aa, case when tilt_deg is not null then 1 end as known, greatest(0, least(23, cast(ceil(tilt_deg / 2.5e0) as int) - 1)) as i, greatest(0, least(35, cast(ceil(azimuth_deg / 10e0) as int) - 1)) as j from arrays)""")
       + f"""select q.array_id, {m6('a.v * (1 - (tt / 2.5e0 - i)) * (1 - (aa / 10e0 - j)) + b.v * (tt / 2.5e0 - i) * (1 - (aa / 10e0 - j)) + c.v * (1 - (tt / 2.5e0 - i)) * (aa / 10e0 - j) + d.v * (tt / 2.5e0 - i) * (aa / 10e0 - j)')} as poa_rel
from q left join gr a on a.ti = i and a.ai = j left join gr b on b.ti = i + 1 and b.ai = j left join gr c on c.ti = i and c.ai = j + 1 left join gr d on d.ti = i + 1 and d.ai = j + 1""")
def _(t):
    grid = SOL.orientation_grid(t.spark, K.SITE_LAT, K.SITE_LON, 2.5, 10.0)
    a = t.sql("arrays").select("array_id", "tilt_deg", "azimuth_deg")
    return _round(SOL.lookup_orientation(a, grid, "tilt_deg", "azimuth_deg", 2.5, 10.0), "poa_rel").select("array_id", "poa_rel")


@query("b26_clearsky_irradiance", f"select o_orderkey, {m6(poa_sql('dayofyear(o_orderdate)', '(o_orderkey % 24)', '(30e0 + o_custkey % 15)', '(-122e0 + o_custkey % 7)', '(o_orderkey % 45)', '(o_custkey % 360)'))} as poa from orders")
def _(t):
    from dustledger.functions.solar import clearsky_poa

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.read("orders").select("o_orderkey", micro(clearsky_poa(F.dayofyear("o_orderdate"), k % 24, 30.0 + c % 15, -122.0 + c % 7, (k % 45).cast("double"), (c % 360).cast("double"))).alias("poa"))


@query("e12_daily_weight", "with d as (select distinct cast(l_shipdate as date) as day from lineitem) select l.l_suppkey as cell_id, l.day, " + m6("w") + " as clearsky_weight from (select distinct l_suppkey, cast(l_shipdate as date) as day from lineitem) l join (select day, sum("
       + poa_sql("dayofyear(day)", "hour", "36.97e0", "-122.03e0", "20e0", "180e0") + ") as w from d, range(0, 24) h(hour) group by 1) x on x.day = l.day")
def _(t):
    d = t.weather.select("cell_id", "day")
    return _round(SOL.daily_weight(d, "day", K.SITE_LAT, K.SITE_LON), "clearsky_weight")


# ---- hourly -----------------------------------------------------------------------------------------------------
_GROW = "case when temperature_2m >= 5 then power(2e0, (temperature_2m - 20e0) / 10e0) else 0e0 end"


@query("e15_wetness_per_year", ctes("hourly", extra=f"h as (select *, relative_humidity_2m >= 80 and temperature_2m > 0 as iso, temperature_2m - dew_point_2m < 2 as dew, {_GROW} as g from hourly), a as (select cell, count(*) as n_hours, count(case when iso then 1 end) as i, count(case when dew then 1 end) as d, count(case when iso or dew then 1 end) as w, sum(case when iso or dew then g end) as gr from h group by 1)")
       + f"select cell, n_hours, {m6('i / (n_hours / 8766e0)')} as iso_hours_per_year, {m6('d / (n_hours / 8766e0)')} as dew_hours_per_year, {m6('w / (n_hours / 8766e0)')} as wet_hours_per_year, {m6('100e0 * w / n_hours')} as wet_pct, {m6('coalesce(gr, 0) / (n_hours / 8766e0)')} as growth_hours_per_year from a")
def _(t):
    w = SO.wetness_per_year(t.sql("hourly"), "cell")
    return _round(w, "iso_hours_per_year", "dew_hours_per_year", "wet_hours_per_year", "wet_pct", "growth_hours_per_year")


_INTERP4 = ("case when {f} <= 0.1e0 then {f} / 0.1e0 * 1.85e0 when {f} <= 0.2e0 then 1.85e0 + ({f} - 0.1e0) / (0.2e0 - 0.1e0) * (9.1e0 - 1.85e0) else 9.1e0 + ({f} - 0.2e0) / (0.3e0 - 0.2e0) * (18.39e0 - 9.1e0) end")


@query("e14_biological_coverage_and_wash", ctes("hourly", extra=f"""d as (select cell, cast(ts as date) as day, sum(case when (relative_humidity_2m >= 80 and temperature_2m > 0) or temperature_2m - dew_point_2m < 2 then {_GROW} else 0e0 end) as wet_hours from hourly group by 1, 2),
 l as (select *, sum(1.3e0 * wet_hours) over (partition by cell order by day rows unbounded preceding) as load, min(case when day >= date '2024-01-10' then day end) over (partition by cell) as cd from d),
 z as (select *, max(case when day = cd then load end) over (partition by cell) as cl from l where cd is not null),
 y as (select cell, day, (0.3e0 * (1e0 - exp(-2.5e0 * (1.3e0 - 1.05e0)))) * (1e0 - exp(-load / 60e0)) as fd, (0.3e0 * (1e0 - exp(-2.5e0 * (1.3e0 - 1.05e0)))) * (1e0 - exp(-(load - cl) / 60e0)) as fc from z where day >= cd),
 x as (select *, {_INTERP4.format(f='fd')} as dd, {_INTERP4.format(f='fc')} as dc from y)""")
       + f"select cell, {m6('case when sum(dd) > 0 then sum(dd - dc) / sum(dd) else 0e0 end')} as recovery_frac, {m6('avg(dd)')} as mean_loss_pct_no_clean, {m6('avg(dc)')} as mean_loss_pct_cleaned, {m6('max_by(fd, day)')} as f_final_no_clean, count(*) as days from x group by 1")
def _(t):
    from pyspark.sql import Window as W

    d = SO.growth_hours_daily(t.sql("hourly"), "cell", "ts").withColumn("shade", F.lit(1.3))
    first = F.min(F.when(F.col("day") >= F.to_date(F.lit("2024-01-10")), F.col("day"))).over(W.partitionBy("cell"))
    loaded = SO.bio_load(d, ("cell",), "wet_hours", "shade").withColumn("clean_day", first).filter("clean_day IS NOT NULL")
    out = SO.wash_recovery(loaded, ("cell",), "clean_day", k=60.0, f_sat=pv.roof_equilibrium(F.lit(1.3)))
    return _round(out, "recovery_frac", "mean_loss_pct_no_clean", "mean_loss_pct_cleaned", "f_final_no_clean")


@query("e16_rain_regime", ctes("weather", extra="a as (select cell_id, count(*) as n, count(case when p >= 0.2 and p < 10 then 1 end) as l, count(case when p >= 10 then 1 end) as h, count(case when p < 0.2 then 1 end) as d from (select cell_id, coalesce(precipitation_sum, 0) as p from weather) group by 1)")
       + f"select cell_id, n as n_days, {m6('l / (n / 365.25e0)')} as light_per_year, {m6('h / (n / 365.25e0)')} as heavy_per_year, {m6('d / (n / 365.25e0)')} as dry_per_year, {m6('l * 1e0 / nullif(h, 0)')} as light_heavy_ratio from a")
def _(t):
    return _round(S.rain_regime(t.weather), "light_per_year", "heavy_per_year", "dry_per_year", "light_heavy_ratio")


@query("e17_hourly_to_daily", f"with h as (select user_id, event_type, date_trunc('hour', ts) as hr, avg(value) as m from events group by all) select user_id, event_type, cast(hr as date) as day, {m6('avg(m)')} as day_mean, {m6('sum(m)')} as day_sum, count(m) as n_hours from h group by all")
def _(t):
    return _round(S.hourly_to_daily(t.read("events"), ["user_id", "event_type"], "ts", "value"), "day_mean", "day_sum")


@query("e17_quarter_hour_means", f"select user_id, event_type, time_bucket(interval '15 minutes', ts) as slot, {m6('avg(value)')} as mean_value, count(value) as n from events group by all")
def _(t):
    return _round(S.quarter_hour_means(t.read("events"), ["user_id", "event_type"], "ts", "value"), "mean_value")


@query("e18_calendar_densify", ctes("weather", extra="s as (select cell_id, min(day) as a, max(day) as b from weather group by 1), g as (select cell_id, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from s)")
       + "select g.cell_id, g.day, w.precipitation_sum from g left join weather w on w.cell_id = g.cell_id and w.day = g.day")
def _(t):
    return S.densify(t.weather).select("cell_id", "day", "precipitation_sum")


# ---- telemetry ------------------------------------------------------------------------------------------------------
_B19 = "radians(360e0 * (doy - 81) / 364e0)"
_OM19 = f"radians(15e0 * ((hr + 0.5e0 + (4e0 * (lon + 120e0) + (9.87e0 * sin(2 * {_B19}) - 7.53e0 * cos({_B19}) - 1.5e0 * sin({_B19}))) / 60e0) - 12e0))"


@query("e19_modelled_daily_energy", f"""with h as (select user_id as k, date_trunc('hour', ts) as t, 34e0 + user_id % 5 as lat, -121e0 + user_id % 4 as lon, radians(10e0 + user_id % 25) as be, radians(150e0 + user_id % 60 - 180e0) as ga, 2e0 + user_id % 7 as kw,
   least(900e0, value * 4) as dni, least(200e0, value) as dhi, least(800e0, value * 3) as ghi, 8e0 + event_id % 20 as tc from events),
 a as (select *, dayofyear(t) as doy, hour(t) as hr, radians(lat) as phi from h), b as (select *, {_OM19} as om, radians(23.45e0 * sin(radians(360e0 * (doy + 284) / 365e0))) as de from a),
 c as (select *, sin(phi) * sin(de) + cos(phi) * cos(de) * cos(om) as cz, sin(de) * (sin(phi) * cos(be) - cos(phi) * sin(be) * cos(ga)) + cos(de) * cos(om) * (cos(phi) * cos(be) + sin(phi) * sin(be) * cos(ga)) + cos(de) * sin(om) * sin(be) * sin(ga) as ai from b),
 d as (select *, greatest(0e0, case when cz > 0 then greatest(0e0, ai) * dni else 0e0 end + dhi * (1e0 + cos(be)) / 2e0 + ghi * 0.2e0 * (1e0 - cos(be)) / 2e0) as poa from c),
 e as (select *, poa * exp(-2.98e0 - 0.0471e0 * 2.5e0) + tc + poa / 1000e0 as cell from d)
select k as system_id, cast(t as date) as day, {m6('sum(greatest(0e0, kw * (poa / 1000e0) * (1e0 - 0.004e0 * (cell - 25e0))))')} as e_model_kwh, {m6('sum(poa) / 1000e0')} as insolation_kwh_m2 from e group by 1, 2""")
def _(t):
    """Irradiance readings per user and hour drive the modelled energy of that user's system."""
    e, k = t.read("events"), F.col("user_id")
    h = e.select(k.alias("system_id"), F.date_trunc("hour", "ts").alias("ts"), (34.0 + k % 5).alias("lat"), (-121.0 + k % 4).alias("lon"), (10.0 + k % 25).alias("tilt"),
                 (150.0 + k % 60).alias("azimuth"), (2.0 + k % 7).alias("capacity_kw"), F.lit(-0.004).alias("gamma"), F.least(F.lit(900.0), F.col("value") * 4).alias("dni"),
                 F.least(F.lit(200.0), F.col("value")).alias("dhi"), F.least(F.lit(800.0), F.col("value") * 3).alias("ghi"), (8.0 + F.col("event_id") % 20).alias("temperature_c"), F.lit(2.5).alias("wind_ms"))
    return _round(TE.modelled_daily(h, "system_id"), "e_model_kwh", "insolation_kwh_m2")


@query("e20_performance_index", ctes("indexed", extra="""j as (select system_id, day, energy_kwh / e_model_kwh as raw from indexed where e_model_kwh > 0.05 and insolation_kwh_m2 > 0.1),
 q as (select *, quantile_cont(raw, 0.999) over (partition by system_id) as top from j), s as (select system_id, min(day) as a, max(day) as b from j group by 1),
 g as (select system_id, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from s)""")
       + f"select g.system_id, g.day, {m6('case when raw > 0 and raw < top * 1.5e0 then raw end')} as pi from g left join q on q.system_id = g.system_id and q.day = g.day")
def _(t):
    i = t.sql("indexed")
    pi = TE.performance_index(i.select("system_id", "day", "energy_kwh", "power_max_kw"), i.select("system_id", "day", "e_model_kwh", "insolation_kwh_m2"), "system_id")
    return _round(pi, "pi").select("system_id", "day", "pi")


def soiled_index(t):
    """Index of a soiling system per cell: one minus the modelled loss, with a little scatter."""
    eq = SO.equivalent_days(t.weather)
    pi = (1.0 - F.col("soiling_loss")) * (1.0 + (F.col("wind_speed_10m_max") - 5.0) / 2000.0)
    d = eq.select(F.col("cell_id").alias("system_id"), "day", pi.alias("pi"), (4.0 + F.month("day") % 6).alias("insolation"))
    return S.densify(d, "system_id")


@query("e21_soiling_ratio", None)
def _(t):
    iv = TE.soiling_intervals(soiled_index(t), "system_id")
    out = TE.soiling_ratio(iv, "system_id", reps=1000)
    return _round(out, "soiling_ratio", "ci_lo", "ci_hi", "loss_pct")


@query("e23_interval_start_levels", None)
def _(t):
    per, total = TE.interval_starts(TE.soiling_intervals(soiled_index(t), "system_id"), "system_id")
    return _round(attach_row(per, total.drop("n")), "median_start", "median_of_medians")


@query("e22_year_on_year", ctes("indexed", extra="""n as (select *, count(*) over (partition by system_id) as n, min(day) over (partition by system_id) as d0 from indexed),
 p as (select a.*, b.pi as prev from n a left join n b on b.system_id = a.system_id and b.day = a.day - 365 where a.n >= 730)""")
       + f"select system_id, count(*) as n_days, count(prev) as n_pairs, {m6('100e0 * quantile_cont(pi - prev, 0.5) / quantile_cont(case when day < d0 + 365 then pi end, 0.5)')} as rd_pct_per_yr from p group by 1")
def _(t):
    return _round(TE.year_on_year(t.sql("indexed"), "system_id"), "rd_pct_per_yr")


@query("e22_year_on_year_interval", ctes("indexed", extra=f"""n as (select *, count(*) over (partition by system_id) as n, min(day) over (partition by system_id) as d0 from indexed),
 p as (select a.*, b.pi as prev from n a left join n b on b.system_id = a.system_id and b.day = a.day - 365 where a.n >= 730),
 sy as (select system_id, count(*) as n_days, count(prev) as n_pairs, quantile_cont(pi - prev, 0.5) as step, quantile_cont(case when day < d0 + 365 then pi end, 0.5) as base,
   list(pi - prev order by day) filter (where prev is not null) as s, cast(ceil(sqrt(count(prev))) as bigint) as b from p group by 1),
 bl as (select system_id, n_pairs, s, b, draw, k, cast(floor({sql_draw_fine("md5(concat_ws('|', system_id::varchar, draw::varchar, k::varchar, '42'))")} * n_pairs) as bigint) as a0
   from (select *, unnest(range(0, cast(ceil(n_pairs / b) as bigint))) as k from (select *, unnest(range(1, 1001)) as draw from sy where n_pairs > 0) x) y),
 el as (select system_id, draw, k * b + j as place, n_pairs, s[(a0 + j) % n_pairs + 1] as v from (select *, unnest(range(0, b)) as j from bl) z),
 md as (select system_id, draw, quantile_cont(v, 0.5) as m from el where place < n_pairs group by 1, 2),
 bd as (select system_id, quantile_cont(m, 0.159) as lo, quantile_cont(m, 0.841) as hi from md group by 1)""")
       + f"""select sy.system_id, n_days, n_pairs, {m6('100e0 * step / base')} as rd_pct_per_yr, {m6('100e0 * lo / base')} as rd_lo, {m6('100e0 * hi / base')} as rd_hi, cast(case when n_pairs > 0 then b end as int) as block_days
from sy left join bd on bd.system_id = sy.system_id""")
def _(t):
    """Degradation with the middle 68.2 % of 1,000 circular block draws."""
    return _round(TE.year_on_year_interval(t.sql("indexed"), "system_id"), "rd_pct_per_yr", "rd_lo", "rd_hi")


@query("e24_residual_scatter", ctes("indexed", extra="""m as (select *, quantile_cont(pi, 0.5) over w as med, count(pi) over w as c from indexed window w as (partition by system_id order by day rows between 7 preceding and 7 following)),
 r as (select system_id, day, ln(pi / med) as r from m where c >= 5 and pi > 0), l as (select *, lag(r) over (partition by system_id order by day) as p from r),
 a as (select system_id, count(*) as n_days, stddev_samp(r) as sigma, corr(case when p is not null then r end, p) as lag1 from l group by 1),
 b as (select *, greatest(0e0, least(0.95e0, lag1)) as u from a)""")
       + f"select system_id, n_days, {m6('sigma')} as sigma, {m6('lag1')} as lag1, {m6('2.801585e0 * sigma * sqrt(2e0 / greatest(30 * (1e0 - u) / (1e0 + u), 1e0))')} as mde from b")
def _(t):
    return _round(TE.residual_scatter(t.sql("indexed"), "system_id"), "sigma", "lag1", "mde")


@query("e25_longest_dry_stretch", """with f as (select l_suppkey as area, cast(l_linenumber - 1 as int) as d, greatest(0e0, max(l_quantity) - 49.2e0) + l_suppkey % 3 * 0.3e0 + l_linenumber % 3 * 0.2e0 as rain from lineitem group by 1, 2, l_suppkey, l_linenumber),
 g as (select *, sum(case when rain < 0.75 then 0 else 1 end) over (partition by area order by d rows unbounded preceding) as w from f), r as (select area, w, count(*) as len, max(d) as e from g where rain < 0.75 group by 1, 2),
 k as (select *, row_number() over (partition by area order by len desc, e) as rn from r) select area, len as dry_len, e as dry_end from k where rn = 1""")
def _(t):
    f = t.read("lineitem").groupBy(F.col("l_suppkey").alias("area"), F.col("l_linenumber").alias("ln")).agg(F.max("l_quantity").alias("q"))
    f = f.select("area", (F.col("ln") - 1).alias("day_offset"), (F.greatest(F.lit(0.0), F.col("q") - 49.2) + F.col("area") % 3 * 0.3 + F.col("ln") % 3 * 0.2).alias("rain_mm"))
    return S.longest_dry_stretch(f, "area", 0.75)


@query("e26_unit_inference", f"""with v as (select l_suppkey as src, l_orderkey, l_linenumber, l_quantity * (case when l_suppkey % 2 = 0 then 2e0 else 0.8e0 end) as v from lineitem), q as (select src, quantile_cont(v, 0.99) as p from v group by 1)
select v.src, case when p > 50 then 'fahrenheit_converted' else 'celsius' end as unit_note, count(*) as n, {m6('sum(case when p > 50 then (v - 32e0) * 5e0 / 9e0 else v end)')} as total_c from v join q on q.src = v.src group by 1, 2""")
def _(t):
    v = t.read("lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_quantity") * F.when(F.col("l_suppkey") % 2 == 0, 2.0).otherwise(0.8)).alias("v"))
    return TE.fahrenheit_to_celsius(v, "src", "v").groupBy("src", "unit_note").agg(F.count(F.lit(1)).alias("n"), micro(F.sum("celsius")).alias("total_c"))


@query("e27_median_interval", f"with g as (select user_id, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts)) / 1e6 as gap from events) select user_id, count(gap) as n, round_even(quantile_cont(gap, 0.5) * 1e7, 0) / 1e7 as median_gap_s from g where gap is not null group by 1")
def _(t):
    g = S.median_interval_seconds(t.read("events"), ["user_id"], "ts")
    q = exact_quantiles(g, ["user_id"], "gap_s", {"median_gap_s": 0.5})
    return q.withColumn("median_gap_s", half_even(F.col("median_gap_s"), 7))


@query("e28_coverage_by_year", ctes("indexed") + f"select system_id, cast(year(day) as int) as year, count(pi) as n, {m6('quantile_cont(pi, 0.95)')} as p95, {m6('max(pi)')} as max_value from indexed group by 1, 2 having count(pi) >= 60")
def _(t):
    return _round(TE.coverage_by_year(t.sql("indexed"), ["system_id"], "pi"), "p95", "max_value")


@query("e9_nested_fit_flatten", """with f as (select l_suppkey as system_id, case when l_returnflag = 'A' then 'cell' else 'site' end as source, case when l_linestatus = 'F' then 'perfect' else 'half_norm' end as method, avg(l_quantity) as q, count(*) as n from lineitem group by all)
select system_id, source, method, case when n % 7 <> 0 then """ + m6("q") + """ end as loss_pct, n % 12 as n_valid, case when n % 7 = 0 then 'no_fit' when n % 5 = 0 then 'degenerate' when n % 12 < 5 then 'low_n_valid' end as skip_reason from f""")
def _(t):
    """Fits nested as map of maps per system, then flattened with their skip reasons."""
    f = t.read("lineitem").groupBy(F.col("l_suppkey").alias("system_id"), F.when(F.col("l_returnflag") == "A", "cell").otherwise("site").alias("source"),
                                   F.when(F.col("l_linestatus") == "F", "perfect").otherwise("half_norm").alias("method")).agg(F.avg("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    fit = F.struct(F.when(n % 7 != 0, F.col("q")).alias("loss_pct"), (n % 12).alias("n_valid_intervals"), (n % 5 == 0).alias("degenerate"))
    m = f.groupBy("system_id", "source").agg(F.map_from_entries(F.collect_list(F.struct("method", fit))).alias("m"))
    nested = m.groupBy("system_id").agg(F.map_from_entries(F.collect_list(F.struct("source", "m"))).alias("fits"))
    return _round(TE.flatten_fits(nested, "system_id"), "loss_pct")


# ---- lidar ------------------------------------------------------------------------------------------------------------
def lidar_points(t, shift: float = 0.0):
    """Returns over each part's roof: a tilted plane, centimetre scatter and a few stray hits."""
    l, k = t.read("lineitem"), F.col("l_partkey")
    x, y = F.col("l_quantity") / 5.0, F.col("l_orderkey") % 97 / 10.0
    z = 0.3 * x - (k % 5) / 20.0 * y + (F.col("l_discount") - 0.05) + F.when(F.col("l_tax") == 0.08, 3.0).otherwise(0.0) + shift
    return l.select(k.alias("array_id"), x.alias("x"), y.alias("y"), z.alias("z"), F.when(F.col("l_linenumber") == 7, 2).otherwise(6).alias("cls"),
                    F.when(F.col("l_returnflag") == "N", 1).otherwise(1).alias("ret"), F.when(F.col("l_returnflag") == "A", 3).otherwise(1).alias("nret"), F.col("l_orderkey").alias("o"))


_CLOUD = """cloud as (select l_partkey as array_id, l_quantity / 5e0 as x, l_orderkey % 97 / 10e0 as y,
   0.3e0 * (l_quantity / 5e0) - (l_partkey % 5) / 20e0 * (l_orderkey % 97 / 10e0) + (l_discount - 0.05e0) + case when l_tax = 0.08 then 3e0 else 0e0 end as z,
   case when l_linenumber = 7 then 2 else 6 end as cls, l_orderkey as o from lineitem)"""


def _trim_sql(name: str, source: str, rounds: int, sigma: float) -> str:
    """CTEs of the trimming loop over ``source`` (array_id, x, y, z): every point carries whether it is kept, round by round."""
    parts = [f"{name}0 as (select *, true as keep, true as live from {source})"]
    for k in range(1, rounds + 1):
        parts.append(f"""{name}m{k} as (select array_id, avg(x) as mx, avg(y) as my, avg(z) as mz, var_pop(x) as vx, var_pop(y) as vy, var_pop(z) as vz,
   covar_pop(x, y) as cxy, covar_pop(x, z) as cxz, covar_pop(y, z) as cyz from {name}{k - 1} where keep group by 1)""")
        parts.append(f"{name}s{k} as (select *, case when abs(vx * vy - cxy * cxy) > 1e-12 then (cxz * vy - cyz * cxy) / (vx * vy - cxy * cxy) end as a, case when abs(vx * vy - cxy * cxy) > 1e-12 then (cyz * vx - cxz * cxy) / (vx * vy - cxy * cxy) end as b from {name}m{k})")
        parts.append(f"{name}f{k} as (select array_id, a, b, mz - a * mx - b * my as c, sqrt(greatest(0e0, vz - a * cxz - b * cyz)) as s from {name}s{k})")
        parts.append(f"{name}r{k} as (select p.array_id, p.x, p.y, p.z, p.keep, p.live, f.s, z - (a * x + b * y + c) as resid, coalesce(abs(z - (a * x + b * y + c)) <= {sigma}e0 * s and s > 0, false) as new from {name}{k - 1} p join {name}f{k} f on f.array_id = p.array_id)")
        parts.append(f"{name}g{k} as (select array_id, count(case when new then 1 end) >= {LI.MIN_POINTS} and count(case when new <> keep then 1 end) > 0 and coalesce(max(s), 0) > 0 as go from {name}r{k} group by 1)")
        parts.append(f"{name}{k} as (select r.array_id, x, y, z, resid, case when live and go then new else keep end as keep, live and go as live from {name}r{k} r join {name}g{k} g on g.array_id = r.array_id)")
    parts.append(f"""{name} as (select q.array_id, count(*) as n_points, count(case when keep then 1 end) as n_inliers, any_value(a) as a, any_value(b) as b, any_value(c) as c,
   sqrt(avg(case when keep then resid * resid end)) as rms from {name}{rounds} q join {name}f{rounds} f on f.array_id = q.array_id group by 1)""")
    return ", ".join(parts)


def _tilt_sql(a: str, b: str) -> tuple[str, str]:
    return f"degrees(atan(sqrt({a} * {a} + {b} * {b})))", f"((degrees(atan2(-{a}, -{b})) + 360e0) % 360e0)"


_TILT, _FACE = _tilt_sql("a", "b")
_SURFACE = "surf as (select * from cloud where cls in (1, 6))"
_FITS = f"""pl as (select array_id, n_points, case when n_points >= {LI.MIN_POINTS} then {_TILT} end as tilt, case when n_points >= {LI.MIN_POINTS} then {_FACE} end as face,
   case when n_points >= {LI.MIN_POINTS} then n_inliers * 1e0 / n_points end as frac, case when n_points >= {LI.MIN_POINTS} then rms end as rms,
   coalesce(n_points >= {LI.MIN_POINTS} and n_inliers >= {LI.MIN_POINTS} and rms <= {LI.MAX_RMS_M}e0 and n_inliers * 1e0 / n_points >= {LI.MIN_INLIERS}e0, false) as ok,
   case when n_points < {LI.MIN_POINTS} then 'only ' || n_points || ' points' else concat_ws('; ', case when n_inliers < {LI.MIN_POINTS} then 'few inliers' end,
     case when rms > {LI.MAX_RMS_M}e0 then 'rough' end, case when n_inliers * 1e0 / n_points < {LI.MIN_INLIERS}e0 then 'thin' end) end as reason from t)"""


@query("g5_roof_planes", f"with {_CLOUD}, {_SURFACE}, {_trim_sql('t', 'surf', 3, 2.5)}, {_FITS} "
       + f"select array_id, n_points, {m6('tilt')} as tilt_deg, {m6('face')} as azimuth_deg, {m6('frac')} as inlier_frac, {m6('rms')} as rms_m, ok as fit_ok, reason as fit_reason from pl")
def _(t):
    return _round(LI.roof_planes(lidar_points(t), "array_id"), "tilt_deg", "azimuth_deg", "inlier_frac", "rms_m")


_RT, _RA = _tilt_sql("r.a", "r.b")
_AT, _AA = _tilt_sql("t.a", "t.b")


@query("g6_panel_standoff", f"""with {_CLOUD}, ins as (select array_id, x, y, z + 0.12e0 as z from cloud where o % 2 = 0), rin as (select array_id, x, y, z from cloud where o % 2 = 1),
 {_trim_sql('t', 'ins', 3, 2.5)}, {_trim_sql('r', 'rin', 6, 2.0)},
 ro as (select * from r where n_points >= {LI.MIN_POINTS} and rms <= {LI.MAX_RMS_M}e0),
 up as (select i.array_id, count(*) as n_interior, quantile_cont(z - (a * x + b * y + c), 0.5) as standoff from ins i join ro on ro.array_id = i.array_id group by 1 having count(*) >= {LI.MIN_POINTS})
select up.array_id, n_interior, r.n_points as n_ring, {m6('standoff')} as standoff_m, {m6('r.rms')} as ring_rms_m, {m6(_RT)} as roof_tilt_deg, {m6(_AT)} as array_tilt_deg,
 {m6(f'least(abs({_RA} - {_AA}), 360e0 - abs({_RA} - {_AA}))')} as d_azimuth_deg from up join ro r on r.array_id = up.array_id join t on t.array_id = up.array_id""")
def _(t):
    p = lidar_points(t)
    inside, ring = p.filter("o % 2 = 0").withColumn("z", F.col("z") + 0.12), p.filter("o % 2 = 1")
    return _round(LI.standoff(inside, ring, "array_id"), "standoff_m", "ring_rms_m", "roof_tilt_deg", "array_tilt_deg", "d_azimuth_deg")


def canopy_points(t):
    p = lidar_points(t)
    return p.select("array_id", "x", "y", (F.col("z") - 0.3 * F.col("x") + 1.5).alias("above"), (F.col("x") + F.col("y")).alias("distance_m"), "cls", "nret")


@query("g7_canopy_exposure", "with " + ("""p as (select l_partkey as array_id, l_quantity / 5e0 as x, l_orderkey % 97 / 10e0 as y, case when l_linenumber = 7 then 2 else 6 end as cls, case when l_returnflag = 'A' then 3 else 1 end as nret,
   0.3e0 * (l_quantity / 5e0) - (l_partkey % 5) / 20e0 * (l_orderkey % 97 / 10e0) + (l_discount - 0.05e0) + case when l_tax = 0.08 then 3e0 else 0e0 end + 0e0 - 0.3e0 * (l_quantity / 5e0) + 1.5e0 as above from lineitem),
 c as (select *, cast(floor(x / 4e0) as bigint) as gx, cast(floor(y / 4e0) as bigint) as gy from p where above > 2.5 and cls <> 2 and nret > 1),
 g as (select array_id, gx, gy from c group by all having count(*) >= 1), e as (select array_id from g group by 1 having count(*) >= 2),
 h as (select array_id, count(*) as n, quantile_cont(above, 0.98) as p98, min(x + y) as near from c where array_id in (select array_id from e) group by 1)
""")
       + f"select n.array_id, n.n as n_points, {m6('coalesce(h.n, 0) * 1e0 / n.n')} as canopy_frac, {m6('coalesce(p98, 0)')} as canopy_p98_height_m, {m6('near')} as nearest_canopy_m from (select array_id, count(*) as n from p group by 1) n left join h on h.array_id = n.array_id")
def _(t):
    return _round(LI.canopy_exposure(canopy_points(t), "array_id", cell_m=4.0, per_cell=1, cells=2), "canopy_frac", "canopy_p98_height_m", "nearest_canopy_m")


_CANOPY = """pt as (select l_partkey as array_id, l_quantity / 5e0 as x, l_orderkey % 97 / 10e0 as y, case when l_linenumber = 7 then 2 else 6 end as cls, case when l_returnflag = 'A' then 3 else 1 end as nret,
   0.3e0 * (l_quantity / 5e0) - (l_partkey % 5) / 20e0 * (l_orderkey % 97 / 10e0) + (l_discount - 0.05e0) + case when l_tax = 0.08 then 3e0 else 0e0 end + 0e0 - 0.3e0 * (l_quantity / 5e0) + 1.5e0 as above from lineitem),
 ca as (select *, cast(floor(x / 4e0) as bigint) as gx, cast(floor(y / 4e0) as bigint) as gy from pt where above > 2.5 and cls <> 2 and nret > 1),
 en as (select array_id from (select array_id, gx, gy from ca group by all having count(*) >= 1) g group by 1 having count(*) >= 2),
 ex as (select array_id, count(*) as n, min(x + y) as near from ca where array_id in (select array_id from en) group by 1),
 cf as (select n.array_id, coalesce(ex.n, 0) * 1e0 / n.n as frac, near from (select array_id, count(*) as n from pt group by 1) n left join ex on ex.array_id = n.array_id)"""


@query("g8_persistent_screen", f"""with {_CLOUD}, {_SURFACE}, {_trim_sql('t', 'surf', 3, 2.5)}, {_FITS}, {_CANOPY},
 lt as (select pl.array_id, {LOW_TILT.format(t='tilt')} as low, greatest(coalesce(cf.frac, 0e0), coalesce(greatest(0e0, 1e0 - near / 9e0), 0e0)) as can from pl join cf on cf.array_id = pl.array_id where ok),
 sc as (select *, round_even((0.7e0 * low + 0.3e0 * can) * 1e9, 0) / 1e9 as score from lt), rk as (select *, row_number() over (order by score desc, array_id) as rk, count(*) over () as n from sc)
select array_id, {m6('score')} as persistent_soiling_score, {m6('low')} as low_tilt_score, {m6('can')} as canopy_exposure_score, rk as persistent_soiling_rank, rk <= ceil(0.1e0 * n) as persistent_soiling_top_decile, 0.1e0 as inspection_fraction from rk""")
def _(t):
    s = LI.persistent_screen(LI.roof_planes(lidar_points(t), "array_id"), LI.canopy_exposure(canopy_points(t), "array_id", cell_m=4.0, per_cell=1, cells=2).drop("n_points"), "array_id")
    return _round(s, "persistent_soiling_score", "low_tilt_score", "canopy_exposure_score").select(
        "array_id", "persistent_soiling_score", "low_tilt_score", "canopy_exposure_score", "persistent_soiling_rank", "persistent_soiling_top_decile", "inspection_fraction")


@query("g9_module_gamma_tiers", None)
def _(t):
    """Modules named after parts against a catalogue made of the same parts."""
    from dustledger.operators.lookup import resolve_gamma

    p, k = t.read("part"), F.col("p_partkey")
    cat = p.filter("p_partkey % 3 = 0").select(
        F.concat(F.when(k % 2 == 0, F.lit("TRINASOLARTSM")).otherwise(F.lit("SHARPND")), (1000 + k).cast("string"), F.lit("PA05")).alias("key_norm"),
        F.when(k % 2 == 0, "Mono-c-Si").otherwise("Multi-c-Si").alias("technology"), (-0.003 - k % 20 / 10000.0).alias("gamma_pdc"), (200.0 + k % 200).alias("stc_w"))
    m = p.select(k.alias("module_id"), F.when(k % 4 == 0, "Trina").when(k % 4 == 1, "Sharp").when(k % 4 == 2, "Acme").alias("manufacturer"),
                 F.when(k % 5 < 3, F.concat(F.when(k % 2 == 0, F.lit("TSM-")).otherwise(F.lit("ND-")), (1000 + k).cast("string"), F.lit("PA05"))).otherwise(F.lit("unknown")).alias("model"),
                 F.when(k % 6 == 0, "multi-si").when(k % 6 == 1, "perc").alias("type"), (200.0 + k % 200).alias("watts"))
    return _round(resolve_gamma(m, cat, "module_id"), "gamma")


# ---- streams ------------------------------------------------------------------------------------------------------------
def _run_stream(spark, df, name: str):
    """Run a stream over the files present now and read back what it wrote."""
    import os
    import uuid

    from dustledger.session import work_folder
    from dustledger.streaming.jobs import append_to

    base = os.path.join(work_folder(spark), f"stream-{name}-{uuid.uuid4().hex[:8]}")
    q = append_to(df, f"{base}/out", f"{base}/state")
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query("s1_feedback_stream", "with f as (select user_id, cast(ts as date) as day, round_even((value - (1 + event_id % 90)) / (1 + event_id % 90) * 100 * 1e2, 0) / 1e2 as rec from events where event_type = 'purchase') select user_id as array_id, count(distinct day) as n_kept from f group by 1")
def _(t):
    """Purchases as feedback records: one per array and day survives the dedupe."""
    from dustledger.streaming.jobs import feedback_stream

    schema = t.read("events").schema
    ev = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/event*.parquet").filter("event_type = 'purchase'")
    fb = ev.select(F.col("user_id").alias("array_id"), F.lit("p").alias("partner_id"), F.to_date("ts").alias("cleaned_at"), (1.0 + F.col("event_id") % 90).alias("pre_clean_kwh_7d"),
                   F.col("value").alias("post_clean_kwh_7d"), F.col("ts").cast("timestamp").alias("submitted_at"))
    out = _run_stream(t.spark, feedback_stream(fb, "40 days"), "feedback")
    return out.groupBy("array_id").agg(F.count(F.lit(1)).alias("n_kept"))


@query("s2_streaming_quarter_hours", f"select user_id as system_id, event_type as channel, time_bucket(interval '15 minutes', ts) as slot, {m6('avg(value)')} as mean_value, count(value) as n from events where time_bucket(interval '15 minutes', ts) + interval '15 minutes' <= (select max(ts) from events) - interval '1 hour' group by all")
def _(t):
    """Windows the watermark has passed; equal to the batch means."""
    from dustledger.streaming.jobs import telemetry_means

    ev = t.spark.readStream.schema(t.read("events").schema).parquet(f"{t.sf_dir}/event*.parquet")
    r = ev.select(F.col("user_id").alias("system_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), "value")
    return _round(_run_stream(t.spark, telemetry_means(r), "means"), "mean_value")
