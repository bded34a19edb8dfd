"""Queries of the daily-series, soiling and recovery operators."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from dustledger.functions.numeric import micro
from dustledger.operators import series as S, soiling as SO
from dustledger.plans.registry import query
from dustledger.plans.views import ctes, m6

_DAYNO = "datediff('day', date '1970-01-01', day)"


def _round(df, *cols):
    return df.withColumns({c: micro(F.col(c)) for c in cols})


def _trail(expr: str, d: int) -> str:
    return f"{expr} over (partition by cell_id order by day_no range between {d - 1} preceding and current row)"


_MEANS = ("wind_speed_10m_max", "relative_humidity_2m_mean", "temperature_2m_max", "pm2_5", "pm10")
_E1_COLS = [f"precip_{d}d_mm" for d in (7, 30, 90)] + [f"{c}_{d}d_mean" for c in _MEANS for d in (7, 30, 90)]


@query("e1_trailing_windows", ctes("weather", extra=f"w as (select *, {_DAYNO} as day_no from weather)")
       + "select cell_id, day, " + ", ".join(
           [m6(_trail("sum(precipitation_sum)", d)) + f" as precip_{d}d_mm" for d in (7, 30, 90)]
           + [m6(_trail(f"avg({c})", d)) + f" as {c}_{d}d_mean" for c in _MEANS for d in (7, 30, 90)]) + " from w")
def _(t):
    return _round(S.trailing_features(t.weather), *_E1_COLS).select("cell_id", "day", *_E1_COLS)


_STREAK = """select cell_id, day,
  n - coalesce(max(case when precipitation_sum >= 1 then n end) over w, 0) as dry_day_streak,
  n - coalesce(max(case when precipitation_sum >= 5 then n end) over w, 0) as days_since_rain
from (select *, count(precipitation_sum) over (partition by cell_id order by day rows unbounded preceding) as n from weather)
window w as (partition by cell_id order by day rows unbounded preceding)"""


@query("e2_dry_day_streak", ctes("weather") + _STREAK.replace(
    "dry_day_streak,\n", "dry_day_streak\n").replace(
    "  n - coalesce(max(case when precipitation_sum >= 5 then n end) over w, 0) as days_since_rain\n", ""))
def _(t):
    return S.rain_streaks(t.weather).select("cell_id", "day", "dry_day_streak")


@query("e3_days_since_rain", ctes("weather") + "select cell_id, day, days_since_rain from (" + _STREAK + ")")
def _(t):
    return S.rain_streaks(t.weather).select("cell_id", "day", "days_since_rain")


_E4_COLS = [f"{n}_{d}d" for n in ("humid_days", "dew_no_rain_days") for d in (7, 30, 90)]


@query("e4_humid_and_dew_days", ctes("weather", extra=f"w as (select *, {_DAYNO} as day_no, "
       "case when relative_humidity_2m_mean >= 85 then 1 else 0 end as humid, "
       "case when relative_humidity_2m_mean >= 85 and coalesce(precipitation_sum, 0) < 1 then 1 else 0 end as dew from weather)")
       + "select cell_id, day, " + ", ".join(
           [f"cast({_trail('sum(' + c + ')', d)} as bigint) as {n}_{d}d"
            for n, c in (("humid_days", "humid"), ("dew_no_rain_days", "dew")) for d in (7, 30, 90)]) + " from w")
def _(t):
    return S.humidity_features(t.weather).select("cell_id", "day", *_E4_COLS)


KIMBER = """kim as (select *, greatest(0e0, 1e0 - 0.0006e0 * sum(case when wet then 0e0 else pm end)
    over (partition by cell_id, dry order by day rows unbounded preceding)) as kimber_ratio
  from (select *, sum(case when wet then 1 else 0 end) over (partition by cell_id order by day rows unbounded preceding) as dry
    from (select *, coalesce(precipitation_sum, 0) >= 1 as wet,
      coalesce(pm2_5, median(pm2_5) over (partition by cell_id), 10e0) as pm from weather)))"""


@query("e6_kimber_ratio", ctes("weather", extra=KIMBER) + f"select cell_id, day, {m6('kimber_ratio')} as kimber_ratio from kim")
def _(t):
    return _round(SO.kimber_ratio(t.weather), "kimber_ratio").select("cell_id", "day", "kimber_ratio")


def eq_sql(keys: str, source: str, name: str = "eqd", tilt: str = "1e0") -> str:
    """CTE with seg, s_log, eq_days, soiling_loss of the equivalent-day model."""
    return f"""{name} as (select *, {tilt} * 0.08e0 * (1e0 - exp(-eq_days / 15e0)) as soiling_loss from (
  select *, case when f <= 0 then 0e0 else exp(s_log) * sum(case when f > 0 then exp(lnf - s_log) else 0e0 end)
      over (partition by {keys}, seg order by day rows unbounded preceding) end as eq_days
  from (select *, sum(lnf) over (partition by {keys}, seg order by day rows unbounded preceding) as s_log
    from (select *, case when f > 0 then ln(f) else 0e0 end as lnf,
        sum(case when f <= 0 then 1 else 0 end) over (partition by {keys} order by day rows unbounded preceding) as seg
      from (select *, case when p >= 10e0 * {tilt} then 0e0
            when p >= 1e0 * {tilt} then 1e0 - (p - 1e0 * {tilt}) / (10e0 * {tilt} - 1e0 * {tilt})
            when pm > 50 then 1e0 + 0.02e0 * (pm - 50e0) else 1e0 end as f
        from (select *, coalesce(precipitation_sum, 0e0) as p,
            coalesce(pm10, median(pm10) over (partition by {keys}), 0e0) as pm from {source}))))))"""


@query("e7_equivalent_days", ctes("weather", extra=eq_sql("cell_id", "weather"))
       + f"select cell_id, day, {m6('eq_days')} as eq_days, {m6('soiling_loss')} as soiling_loss from eqd")
def _(t):
    return _round(SO.equivalent_days(t.weather), "eq_days", "soiling_loss").select(
        "cell_id", "day", "eq_days", "soiling_loss")


_TILTED = "tilted as (select *, cast((cell_id % 5) * 10 as double) as tilt_deg from weather)"
_TF = "((0.4425e0 + 0.5575e0 * exp(-tilt_deg / 11.641e0)) / (0.4425e0 + 0.5575e0 * exp(-20e0 / 11.641e0)))"


@query("e7_equivalent_days_by_tilt", ctes("weather", extra=_TILTED + ", " + eq_sql("cell_id", "tilted", tilt=_TF))
       + f"select cell_id, day, tilt_deg, {m6('soiling_loss')} as soiling_loss from eqd")
def _(t):
    tilted = t.weather.withColumn("tilt_deg", (F.col("cell_id") % 5 * 10).cast("double"))
    return _round(SO.equivalent_days(tilted, tilt="tilt_deg"), "soiling_loss").select(
        "cell_id", "day", "tilt_deg", "soiling_loss")


@query("e8_soiling_labels", ctes("weather", extra=eq_sql("cell_id", "weather") + ", " + KIMBER + """,
 a as (select cell_id, max_by(soiling_loss, day) as sl, max_by(eq_days, day) as eq, avg(soiling_loss) as msl, max(day) as as_of,
   max(case when coalesce(precipitation_sum,0) >= 10 then day end) as last_heavy_rain from eqd group by 1),
 b as (select cell_id, avg(kimber_ratio) as kimber_iwsr from kim group by 1)""")
       + f"""select a.cell_id, as_of, {m6('1e0 - sl')} as iwsr, cast(1e0 - sl < 0.944 as int) as label,
  round_even(least(1e0, sl / 0.08e0) * 1e3, 0) / 1e3 as risk_score, round_even(sl * 100e0 * 1e3, 0) / 1e3 as loss_pct,
  round_even(msl * 100e0 * 1e3, 0) / 1e3 as mean_loss_pct, round_even(eq * 1e1, 0) / 1e1 as eq_days, last_heavy_rain,
  {m6('kimber_iwsr')} as kimber_iwsr, cast(kimber_iwsr < 0.97 as int) as kimber_label
from a join b on a.cell_id = b.cell_id""")
def _(t):
    eq = SO.soiling_labels(SO.equivalent_days(t.weather))
    kim = SO.kimber_labels(SO.kimber_ratio(t.weather)).withColumnsRenamed(
        {"iwsr": "kimber_iwsr", "label": "kimber_label"})
    return _round(eq.join(kim, "cell_id"), "iwsr", "kimber_iwsr")


_YEARLY = "wy as (select *, cast(year(day) as int) as yr from weather)"
_CLEANED = """cl as (select *, min(case when month(day) >= 4 then day end) over (partition by cell_id, yr) as clean_day from eqd),
 z as (select *, max(case when day = clean_day then s_log end) over k as cs, max(case when day = clean_day then eq_days end) over k as ce,
   max(case when day = clean_day then seg end) over k as cg,
   sum(case when day >= clean_day then 1 else 0 end) over (partition by cell_id, yr order by day rows unbounded preceding) - 1 as rk
   from cl where clean_day is not null window k as (partition by cell_id, yr)),
 sv as (select *, case when seg = cg and day >= clean_day then 0.08e0 * (exp(-(eq_days - ce * exp(s_log - cs)) / 15e0) - exp(-eq_days / 15e0)) else 0e0 end as saved from z)"""


@query("e10_recovery_of_one_clean", ctes("weather", extra=_YEARLY + ", " + eq_sql("cell_id, yr", "wy") + ", " + _CLEANED)
       + f"""select cell_id, yr, min(clean_day) as clean_day,
  {m6('greatest(0e0, least(1e0, case when sum(soiling_loss) > 0 then sum(saved) / sum(soiling_loss) else 0e0 end))')} as recovery_frac,
  cast(coalesce(min(case when day >= clean_day and saved <= 1e-9 then rk end), max(rk)) as bigint) as benefit_days,
  cast(min(case when day >= clean_day and coalesce(precipitation_sum, 0) >= 10 then rk end) as bigint) as days_to_next_heavy_rain,
  {m6('avg(soiling_loss) * 100e0')} as mean_sl_pct
from sv group by 1, 2""")
def _(t):
    """The first observed day from April on is the clean; each cell-year is one series."""
    yearly = SO.equivalent_days(t.weather.withColumn("yr", F.year("day")), keys=("cell_id", "yr"))
    first = F.min(F.when(F.month("day") >= 4, F.col("day"))).over(W.partitionBy("cell_id", "yr"))
    cleaned = yearly.withColumn("clean_day", first).filter("clean_day IS NOT NULL")
    out = SO.recovery_of_clean(cleaned, ("cell_id", "yr"), "clean_day")
    return _round(out, "recovery_frac", "mean_sl_pct").select(
        "cell_id", "yr", "clean_day", "recovery_frac", F.col("benefit_days").cast("long").alias("benefit_days"),
        F.col("days_to_next_heavy_rain").cast("long").alias("days_to_next_heavy_rain"), "mean_sl_pct")


_CAL = _YEARLY + ", " + eq_sql("cell_id, yr", "wy") + """,
 n as (select *, row_number() over (partition by cell_id, yr order by day) - 1 as i, count(*) over (partition by cell_id, yr) as cnt,
   sum(soiling_loss) over (partition by cell_id, yr) as den from eqd),
 pr as (select d.cell_id, d.yr, c.day as clean_day, c.i as ci, c.den, c.cnt, d.i,
   0.08e0 * (exp(-(d.eq_days - c.eq_days * exp(d.s_log - c.s_log)) / 15e0) - exp(-d.eq_days / 15e0)) as saved
   from n c join n d on c.cell_id = d.cell_id and c.yr = d.yr and c.seg = d.seg and d.day >= c.day where c.i % 7 = 0),
 cal as (select cell_id, yr, clean_day, greatest(0e0, least(1e0, case when any_value(den) > 0 then sum(saved) / any_value(den) else 0e0 end)) as recovery_frac,
   cast(coalesce(min(case when saved <= 1e-9 then i end), least(max(i) + 1, any_value(cnt) - 1)) - any_value(ci) as bigint) as benefit_days
   from pr group by 1, 2, 3)"""


@query("e11_recovery_calendar", ctes("weather", extra=_CAL)
       + f"select cell_id, yr, clean_day, {m6('recovery_frac')} as recovery_frac, benefit_days from cal")
def _(t):
    yearly = SO.equivalent_days(t.weather.withColumn("yr", F.year("day")), keys=("cell_id", "yr"))
    out = SO.recovery_calendar(yearly, ("cell_id", "yr"))
    return _round(out, "recovery_frac").withColumn("benefit_days", F.col("benefit_days").cast("long"))


@query("e11_best_clean_date", ctes("weather", extra=_CAL + """,
 b as (select *, row_number() over (partition by cell_id, yr order by recovery_frac desc, clean_day) as rn from cal)""")
       + f"""select cell_id, yr, max(case when rn = 1 then clean_day end) as best_day, {m6('max(recovery_frac)')} as best_recovery_frac,
 {m6('min(recovery_frac)')} as worst_recovery_frac, {m6('avg(recovery_frac)')} as mean_recovery_frac, count(*) as n_candidates from b group by 1, 2""")
def _(t):
    yearly = SO.equivalent_days(t.weather.withColumn("yr", F.year("day")), keys=("cell_id", "yr"))
    best = SO.best_clean_day(SO.recovery_calendar(yearly, ("cell_id", "yr")), ("cell_id", "yr"))
    return _round(best, "best_recovery_frac", "worst_recovery_frac", "mean_recovery_frac").drop("best_benefit_days")


_BAND = """bl as (select *, sum(step) over (partition by cell_id, yr, seg order by day rows unbounded preceding) as load from (
   select *, sum(case when p >= 10 then 1 else 0 end) over (partition by cell_id, yr order by day rows unbounded preceding) as seg,
     case when p >= 10 then 0e0 when p >= 0.2e0 then tf * (p - 0.2e0) / (10e0 - 0.2e0) else tf * 0.15e0 end as step
   from (select *, cast(year(day) as int) as yr, coalesce(precipitation_sum, 0e0) as p, cast((cell_id %% 5) * 10 as double) as tilt_deg,
     %s as tf from weather)))""" % _TF
_INTERP = ("case when {f} <= 0.1e0 then {f} / 0.1e0 * 1.85e0 when {f} <= 0.2e0 then 1.85e0 + ({f} - 0.1e0) / (0.2e0 - 0.1e0) * (9.1e0 - 1.85e0) "
           "else 9.1e0 + ({f} - 0.2e0) / (0.3e0 - 0.2e0) * (18.39e0 - 9.1e0) end")


@query("e13_band_coverage_and_wash", ctes("weather", extra=_BAND + """,
 c as (select *, min(case when month(day) >= 4 then day end) over (partition by cell_id, yr) as clean_day from bl),
 z as (select *, max(case when day = clean_day then load end) over k as cl, max(case when day = clean_day then seg end) over k as cg
   from c where clean_day is not null window k as (partition by cell_id, yr)),
 y as (select *, 0.3e0 * (1e0 - exp(-load / 25e0)) as fd, 0.3e0 * (1e0 - exp(-(case when seg = cg then load - cl else load end) / 25e0)) as fc from z where day >= clean_day),
 x as (select *, %s as dd, %s as dc from y)""" % (_INTERP.format(f="fd"), _INTERP.format(f="fc")))
       + f"""select cell_id, yr, {m6('case when sum(dd) > 0 then sum(dd - dc) / sum(dd) else 0e0 end')} as recovery_frac,
 {m6('avg(dd)')} as mean_loss_pct_no_clean, {m6('avg(dc)')} as mean_loss_pct_cleaned, {m6('max_by(fd, day)')} as f_final_no_clean, count(*) as days
from x group by 1, 2""")
def _(t):
    w = t.weather.withColumns({"yr": F.year("day"), "tilt_deg": (F.col("cell_id") % 5 * 10).cast("double")})
    first = F.min(F.when(F.month("day") >= 4, F.col("day"))).over(W.partitionBy("cell_id", "yr"))
    loaded = SO.band_load(w, ("cell_id", "yr"), tilt="tilt_deg").withColumn("clean_day", first)
    out = SO.wash_recovery(loaded.filter("clean_day IS NOT NULL"), ("cell_id", "yr"), "clean_day")
    return _round(out, "recovery_frac", "mean_loss_pct_no_clean", "mean_loss_pct_cleaned", "f_final_no_clean")
