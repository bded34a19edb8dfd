"""Queries of the decision, recommendation, publishing and model-evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dustledger import constants as K
from dustledger.functions import pv
from dustledger.functions.numeric import half_even, micro
from dustledger.operators import decision as DE, learn as LE, matching as MA, recommend as RE, soiling as SO
from dustledger.operators.ranks import attach_row, flag_top_fraction
from dustledger.plans.q_economics import MIX, NBT, NEM2, mc_sql, priced_sql
from dustledger.plans.q_series import eq_sql
from dustledger.plans.q_spatial import _GREEDY, _recursive
from dustledger.plans.registry import query
from dustledger.plans.views import ctes, m6, r, sql_draw_fine, view


def _round(df, *cols):
    return df.withColumns({c: micro(F.col(c)) for c in cols})


# ---- H4, H5 -------------------------------------------------------------------------------------------------
view("requests", ("orders",), """
select o_orderkey as request_id,
  case when o_orderkey % 3 <> 0 then 1e0 + floor(o_totalprice / 1000e0) / 20e0 end as system_kw,
  case when o_orderkey % 3 = 0 and o_orderkey % 21 <> 0 or o_orderkey % 50 = 1 then 10e0 + o_custkey % 80 end as area_m2,
  case when o_orderkey % 4 <> 0 then (o_orderkey % 90) / 10e0 - case when o_orderkey % 91 = 5 then 9e0 else 0e0 end end as loss_pct,
  case when o_orderkey % 5 = 0 then 0.1e0 end as loss_pct_p10,
  case when o_orderkey % 5 = 0 and o_orderkey % 35 <> 0 then 12e0 end as loss_pct_p90,
  case when o_orderkey % 6 <> 0 then 4e0 + o_custkey % 30 / 10e0 end as sun_hours,
  case when o_orderkey % 7 = 0 then 0.2e0 + o_custkey % 20 / 100e0 end as elec_rate,
  case when o_orderkey % 7 = 1 then 'nem2_legacy' when o_orderkey % 7 = 2 then 'nbt_battery' when o_orderkey % 77 = 3 then 'flat' end as regime,
  case when o_orderkey % 7 = 4 then cast(o_orderdate as date) + 8000 when o_orderkey % 49 = 7 then cast(o_orderdate as date) end as install_date,
  case when o_orderkey % 8 = 0 then 'seasonal_planning' end as recovery_basis,
  case when o_orderkey % 9 = 0 then 0.01e0 + o_custkey % 50 / 100e0 end as recovery_frac
from {orders}""")

_BAT = pv.regime_rate("nbt_battery")
_RES = f"""rq as (select *, coalesce(recovery_basis, 'measured') as r_basis, coalesce(loss_pct, 2.8e0) as r_loss, coalesce(sun_hours, 5.5e0) as r_sun, coalesce(system_kw, case when area_m2 > 0 then area_m2 / {K.M2_PER_KW!r}e0 end) as r_kw,
   case when elec_rate is not null then null when install_date is not null then case when install_date >= date '2023-04-15' then 'nbt_no_battery' else 'nem2_legacy' end else coalesce(regime, 'nbt_no_battery') end as r_regime from requests),
 rs as (select *, case when system_kw is not null and area_m2 is not null then 'system_kw and area_m2 exclude each other' when system_kw <= 0 then 'system_kw must be > 0' when area_m2 <= 0 then 'area_m2 must be > 0'
   when system_kw is null and area_m2 is null then 'system_kw or area_m2 is required' when elec_rate is not null and (regime is not null or install_date is not null) then 'elec_rate excludes regime and install_date' when elec_rate <= 0 then 'elec_rate must be > 0'
   when elec_rate is null and install_date is null and regime not in ('nem2_legacy', 'nbt_no_battery', 'nbt_battery') then 'unknown regime' when loss_pct < 0 then 'loss_pct must be >= 0'
   when (loss_pct_p10 is null) <> (loss_pct_p90 is null) then 'loss_pct_p10 and loss_pct_p90 come together' when loss_pct_p10 is not null and not (loss_pct_p10 <= r_loss and r_loss <= loss_pct_p90) then 'need loss_pct_p10 <= loss_pct <= loss_pct_p90'
   when sun_hours <= 0 then 'sun_hours must be > 0' when recovery_frac <= 0 or recovery_frac > 1 then 'recovery_frac must be in (0, 1]' end as error_reason,
   case when elec_rate is not null then elec_rate when r_regime = 'nem2_legacy' then {NEM2!r}e0 when r_regime = 'nbt_no_battery' then {NBT!r}e0 when r_regime = 'nbt_battery' then {_BAT!r}e0 end as r_rate,
   coalesce(recovery_frac, case r_basis when 'measured' then 0.045e0 else {K.RECOVERY['seasonal_planning']['professional']!r}e0 end) as rec_pro,
   coalesce(recovery_frac * {K.RINSE_OVER_PRO_EFFICACY!r}e0, case r_basis when 'measured' then 0.032e0 else {K.RECOVERY['seasonal_planning']['rinse_service']!r}e0 end) as rec_rinse from rq)"""


@query("h4_resolve_inputs", ctes("requests", extra=_RES) + f"select request_id, error_reason, {m6('r_kw')} as r_kw, {m6('r_rate')} as r_rate, r_loss, r_sun, r_regime, {m6('rec_pro')} as rec_pro, {m6('rec_rinse')} as rec_rinse, case when loss_pct is null then 'default' else 'caller' end as loss_source from rs")
def _(t):
    d = DE.resolve_requests(t.sql("requests"))
    return _round(d.select("request_id", "error_reason", "r_kw", "r_rate", "r_loss", "r_sun", "r_regime", "rec_pro", "rec_rinse", "loss_source"), "r_kw", "r_rate", "rec_pro", "rec_rinse")


def _band(i: int) -> str:
    return "case r_regime when 'nem2_legacy' then %re0 when 'nbt_battery' then %re0 else %re0 end" % tuple(pv.regime_rate(n, i) for n in ("nem2_legacy", "nbt_battery", "nbt_no_battery"))


@query("h5_batch_decision", ctes("requests", extra=_RES + ", okr as (select request_id, r_kw as system_kw, r_loss as loss_pct, r_sun as sun_hours, r_rate as usd_per_kwh, r_regime, rec_pro, rec_rinse, loss_pct_p10, loss_pct_p90 from rs where error_reason is null), "
       + priced_sql("okr", rinse="rec_rinse", pro="rec_pro") + f""", mi as (select *, loss_pct as loss_p50, coalesce(loss_pct_p10, loss_pct * {K.LOSS_P10_OVER_P50!r}e0) as loss_p10, coalesce(loss_pct_p90, loss_pct * {K.LOSS_P90_OVER_P50!r}e0) as loss_p90,
   {_band(1)} as rate_lo, {_band(2)} as rate_hi from pz), """ + mc_sql("mi", "request_id"))
       + f"""select rs.request_id, rs.error_reason, pz.recommended_action as verdict, pz.worth_cleaning, pz.annual_loss_usd, case when pz.request_id is null then null when rinse_net_usd >= pro_net_usd then 'rinse_service' else 'professional' end as best_action,
 case when pz.request_id is not null then greatest(rinse_net_usd, pro_net_usd) end as best_action_net_usd, mc.prob_net_positive, mc.expected_net_usd_p50, mc.decision_robust from rs left join pz on pz.request_id = rs.request_id left join mc on mc.request_id = rs.request_id""")
def _(t):
    d = DE.decide(t.sql("requests"), "request_id", n_samples=2000)
    return d.select("request_id", "error_reason", "verdict", "worth_cleaning", "annual_loss_usd", "best_action", "best_action_net_usd",
                    F.col("uncertainty.prob_net_positive").alias("prob_net_positive"), F.col("uncertainty.expected_net_usd_p50").alias("expected_net_usd_p50"), F.col("uncertainty.decision_robust").alias("decision_robust"))


# ---- H6, H12-H17 ----------------------------------------------------------------------------------------------
def sited(t):
    n = t.read("part").agg(F.floor(F.count(F.lit(1)) / 3).alias("_n"))
    return attach_row(t.sql("arrays"), n).withColumn("site_id", F.col("array_id") * 7919 % F.col("_n")).drop("_n").withColumn("block", F.floor(F.col("array_id") / 1000.0))


def installs(t):
    return t.read("supplier").select(F.col("s_suppkey").alias("site_id"), F.expr("date_add(date'2010-01-01', cast(s_suppkey * 53 % 5400 as int))").alias("install_date"))


_SITED = "sa as (select *, (array_id * 7919) % (select count(*) // 3 from part) as site_id, cast(floor(array_id / 1000e0) as bigint) as block from arrays)"
_SIN = f"""ins as (select s_suppkey as site_id, date '2010-01-01' + cast(s_suppkey * 53 % 5400 as int) as install_date from supplier),
 ro as (select site_id, sum(area_m2) as area, max(permit_kw) as permit, sum(loss_pct_p50 * area_m2) / sum(case when loss_pct_p50 is not null then area_m2 end) as p50, sum(poa_rel * area_m2) / sum(case when poa_rel is not null then area_m2 end) as poa,
   sum(loss_pct_p10 * area_m2) / sum(case when loss_pct_p10 is not null then area_m2 end) as p10, sum(loss_pct_p90 * area_m2) / sum(case when loss_pct_p90 is not null then area_m2 end) as p90 from sa group by 1),
 si as (select ro.*, i.install_date, coalesce(case when permit > 0 then permit end, area / {K.M2_PER_KW!r}e0) as system_kw, coalesce(p50, 2.8e0) as loss_pct, case when p50 is not null then 'regression_head' else 'base_rate_fallback' end as loss_source,
   (case when poa > 0 then 5.5e0 * 1.1507e0 * poa else 5.5e0 end) * (case when i.install_date is null then 1e0 else power(0.995e0, greatest(0e0, datediff('day', i.install_date, date '2026-01-01') / 365.25e0)) end) as sun_hours,
   case when i.install_date >= date '2023-04-15' then {NBT!r}e0 when i.install_date is not null then {NEM2!r}e0 else {MIX!r}e0 end as usd_per_kwh from ro left join ins i on i.site_id = ro.site_id)"""


_LO, _HI = (f(pv.regime_rate(K.DEFAULT_REGIME, 1), pv.regime_rate(K.DEFAULT_REGIME, 2)) for f in (min, max))
_SPREAD = f"""mi as (select *, loss_pct as loss_p50, case when p50 is not null and p10 is not null and p90 is not null then p10 else loss_pct * {K.LOSS_P10_OVER_P50!r}e0 end as loss_p10,
   case when p50 is not null and p10 is not null and p90 is not null then p90 else loss_pct * {K.LOSS_P90_OVER_P50!r}e0 end as loss_p90,
   {_LO!r}e0 as rate_lo, {_HI!r}e0 as rate_hi, 0.032e0 as rec_rinse, 0.045e0 as rec_pro from pz where system_kw > 0), """ + mc_sql("mi", "site_id")
#: What the draws of a site add to its decision.
SPREAD = ("expected_net_usd_p10", "expected_net_usd_p90", "prob_net_positive", "decision_robust")


@query("h6_site_economics", ctes("arrays", extra=_SITED + ", " + _SIN + ", " + priced_sql("si") + ", " + _SPREAD)
       + f"select pz.site_id, {', '.join(SPREAD)}, {m6('system_kw')} as system_kw, {m6('loss_pct')} as loss_pct, loss_source, {m6('sun_hours')} as sun_hours, {m6('usd_per_kwh')} as usd_per_kwh, recommended_action, expected_net_usd, pro_net_usd from pz left join mc on mc.site_id = pz.site_id")
def _(t):
    s = RE.site_economics(sited(t), "site_id", installs(t))
    return _round(s.select("site_id", "system_kw", "loss_pct", "loss_source", "sun_hours", "usd_per_kwh", "recommended_action", "expected_net_usd", "pro_net_usd", *SPREAD), "system_kw", "loss_pct", "sun_hours", "usd_per_kwh")


@query("h6_site_values_on_arrays", ctes("arrays", extra=_SITED + ", " + _SIN + ", " + priced_sql("si") + ", " + _SPREAD)
       + f"select sa.array_id, sa.area_m2, row_number() over (partition by sa.site_id order by sa.area_m2 desc, array_id) = 1 as site_primary, pz.expected_net_usd, {', '.join(SPREAD)} from sa join pz on pz.site_id = sa.site_id left join mc on mc.site_id = pz.site_id")
def _(t):
    a = sited(t)
    s = RE.site_economics(a, "site_id", installs(t))
    return RE.attach_site_economics(a, s, "site_id", ["expected_net_usd", *SPREAD]).select("array_id", "area_m2", "site_primary", "expected_net_usd", *SPREAD)


def area_rule(t):
    a = sited(t)
    f = t.read("part").groupBy(F.floor(F.col("p_partkey") / 1000.0).alias("block"), (F.col("p_partkey") % 7).cast("int").alias("day_offset")).agg(F.max("p_size").alias("m"))
    f = f.select("block", "day_offset", F.when((F.col("block") + F.col("day_offset")) % 4 == 0, F.col("m") / 40.0).otherwise(0.1).alias("rain_mm"))
    c = a.select("block").distinct().withColumn("last_cleaned", F.expr("date_add(date'2025-12-01', cast(-(block * 97 % 400) as int))"))
    return a, RE.recommend_area(a, f, c, "block", "2026-01-01")


_AREA = """rk as (select block, max(case when i = least(n - 1, cast(floor(n * 0.9e0) as bigint)) then risk_score end) as area_risk, max(n) as n_arrays from (select block, risk_score, row_number() over (partition by block order by risk_score) - 1 as i, count(*) over (partition by block) as n from sa) group by 1),
 fc as (select block, d, case when (block + d) % 4 = 0 then m / 40e0 else 0.1e0 end as rain from (select cast(floor(p_partkey / 1000e0) as bigint) as block, cast(p_partkey % 7 as int) as d, max(p_size) as m from part group by 1, 2)),
 tr as (select block, sum(rain) as total from fc group by 1), dw as (select *, sum(case when rain < 5e0 / 7 then 0 else 1 end) over (partition by block order by d rows unbounded preceding) as w from fc),
 dr as (select block, w, count(*) as len, max(d) as e from dw where rain < 5e0 / 7 group by 1, 2), db as (select block, e from (select *, row_number() over (partition by block order by len desc, e) as rn from dr) where rn = 1),
 ar as (select rk.*, tr.total, db.e, datediff('day', date '2025-12-01' - cast(rk.block * 97 % 400 as int), date '2026-01-01') as since from rk join tr on tr.block = rk.block left join db on db.block = rk.block),
 al as (select *, case when area_risk < 0.6 then 'below_risk_threshold' when since < 150 then 'below_age_threshold' when total >= 5 then 'deferred_due_to_rain' else 'weather_window_open' end as rule_fired from ar)"""


@query("h12_area_recommendation", ctes("arrays", extra=_SITED + ", " + _AREA)
       + f"""select block, n_arrays, area_risk, cast(since as int) as days_since_clean, {m6('total')} as total_rain_mm, rule_fired, case when rule_fired = 'weather_window_open' then date '2026-01-02' end as window_start,
 case when rule_fired = 'weather_window_open' then case when e > 1 then date '2026-01-01' + cast(e as int) else date '2026-01-08' end end as window_end, case when area_risk < 0.5 then 'low' when area_risk < 0.75 then 'medium' else 'high' end as confidence from al""")
def _(t):
    return _round(area_rule(t)[1], "total_rain_mm").drop("recovery_lo", "recovery_hi")


def array_inputs(t):
    a, rule = area_rule(t)
    s = RE.site_economics(a, "site_id", installs(t))
    return a.join(s.select("site_id", "system_kw", "expected_net_usd", *SPREAD, "worth_cleaning", "sun_hours", "usd_per_kwh", F.col("recommended_action").alias("economic_action")), "site_id", "left"), rule


@query("h13_array_recommendations", ctes("arrays", extra=_SITED + ", " + _AREA + ", " + _SIN + ", " + priced_sql("si") + ", " + _SPREAD + """,
 j as (select sa.*, mc.* exclude (site_id), pz.system_kw as kw, pz.worth_cleaning as worth, al.rule_fired = 'weather_window_open' as op from sa left join pz on pz.site_id = sa.site_id left join mc on mc.site_id = sa.site_id left join al on al.block = sa.block))""".replace("sa.block))", "sa.block)"))
       + f"""select array_id, case when op and risk_score >= 0.6 and worth then 'clean' else 'monitor' end as action, case when not (op and risk_score >= 0.6) then case when risk_score < 0.5 then 'low' else 'medium' end when not worth then 'low' when risk_score >= 0.75 then 'high' else 'medium' end as priority,
 case when not op then 'weather window closed' when risk_score < 0.6 then 'risk below threshold' when not worth then 'no strategy clears $0' else 'window open, risk above threshold, net positive' end as action_reason,
 case when tilt_deg <= 5 or distance_to_agriculture_m < 500 or distance_to_highway_m < 200 or kw >= 8 or risk_score >= 0.75 then 'professional' else 'diy' end as cleaning_method, {', '.join(SPREAD)} from j""")
def _(t):
    a, rule = array_inputs(t)
    return RE.recommend_arrays(a, rule, "block").select("array_id", "action", "priority", "action_reason", "cleaning_method", *SPREAD)


def screen(t):
    a = t.sql("arrays").filter("array_id % 11 <> 0")
    s = a.select("array_id", (F.rint(pv.persistent_score(F.col("tilt_deg"), F.col("canopy_frac"), F.col("nearest_canopy_m")) * 1e9) / 1e9).alias("persistent_soiling_score"))
    return flag_top_fraction(s, "persistent_soiling_score", "array_id").withColumnsRenamed({"rank": "persistent_soiling_rank", "top_fraction": "persistent_soiling_top_decile"})


_CANO = "(0.4425e0 + 0.5575e0 * exp(-greatest(0e0, least(60e0, {t})) / 11.641e0))"
LOW_TILT = f"greatest(0e0, least(1e0, ({_CANO} - {_CANO.format(t='35e0')}) / ({_CANO.format(t='0e0')} - {_CANO.format(t='35e0')})))"
_LT = f"greatest(0e0, least(1e0, ({_CANO.format(t='tilt_deg')} - {_CANO.format(t='35e0')}) / ({_CANO.format(t='0e0')} - {_CANO.format(t='35e0')})))"
_SCREEN = f"""sc0 as (select array_id, round_even((0.7e0 * (case when tilt_deg is null then 0e0 else {_LT} end) + 0.3e0 * greatest(coalesce(canopy_frac, 0e0), coalesce(greatest(0e0, 1e0 - nearest_canopy_m / 9e0), 0e0))) * 1e9, 0) / 1e9 as score from arrays where array_id % 11 <> 0),
 sc as (select *, row_number() over (order by score desc, array_id) <= ceil(0.1e0 * count(*) over ()) as top from sc0)"""


@query("h14_persistent_fields", ctes("arrays", extra=_SCREEN)
       + f"""select a.array_id, case when sc.array_id is null then 'not_assessed' when top then 'inspection_candidate' else 'not_flagged' end as persistent_status, case when top then 'inspect' else 'none' end as persistent_action,
 case when top then {r(f'area_m2 / {K.M2_PER_KW!r}e0 * 5.5e0 * 365e0 * 0.84e0 * 0.03e0 * {MIX!r}e0', 2)} end as persistent_usd_at_risk from arrays a left join sc on sc.array_id = a.array_id""")
def _(t):
    a = t.sql("arrays").withColumns({"sun_hours": F.lit(5.5), "usd_per_kwh": F.lit(None).cast("double")})
    return RE.persistent_fields(a, screen(t), "array_id").select("array_id", "persistent_status", "persistent_action", "persistent_usd_at_risk")


@query("h15_level_calibration", ctes("arrays", extra=_SITED) + f"select array_id, {m6('loss_pct_p50 * f')} as loss_pct_p50, {m6('loss_pct_p90 * f')} as loss_pct_p90, case when block % 3 = 0 then 'measured' when block = 1 then 'scoped_constant' else 'none' end as level_source from (select *, case when block % 3 = 0 then 1e0 / (1e0 + block / 10e0) when block = 1 then 0.5e0 else 1e0 end as f from sa)")
def _(t):
    a = sited(t)
    cal = a.filter("block % 3 = 0").select("block", (1.0 + F.col("block") / 10.0).alias("model_over_measured")).distinct()
    return _round(RE.level_calibration(a, "block", cal, scope="1").select("array_id", "loss_pct_p50", "loss_pct_p90", "level_source"), "loss_pct_p50", "loss_pct_p90")


@query("h16_feedback_recovery", f"select event_id, {r('(value - (1 + event_id % 90)) / (1 + event_id % 90) * 100e0', 2)} as recovery_pct from events where event_type = 'purchase'")
def _(t):
    return t.read("events").filter("event_type = 'purchase'").select("event_id", RE.recovery_pct(F.col("value"), 1.0 + F.col("event_id") % 90).alias("recovery_pct"))


@query("h17_publish_layer", None)
def _(t):
    a, _rule = array_inputs(t)
    s = screen(t)
    rec = a.filter("array_id % 2 = 0").select("array_id", "system_kw", "expected_net_usd", "economic_action", F.lit(0.5).alias("persistent_soiling_score"))
    base = a.withColumns({"site_id": F.concat(F.lit("apn:"), F.lpad(F.col("site_id").cast("string"), 8, "0"))})
    return RE.publish_layer(base, rec, s, "array_id", "salt")


@query("h17_redacted_points", ctes("arrays") + "select 'permit-' || array_id as array_id, round_even(risk_score * 1e4, 0) / 1e4 as score, round_even(area_m2 / 10e0 * 1e2, 0) / 1e2 as system_kw, round_even((-122e0 + minx / 90000e0) * 1e6, 0) / 1e6 as lon, round_even((37e0 + miny / 111000e0) * 1e6, 0) / 1e6 as lat from arrays where risk_score is not null")
def _(t):
    a = t.sql("arrays").withColumns({"system_kw": F.col("area_m2") / 10.0, "lon": -122.0 + F.col("minx") / 90000.0, "lat": 37.0 + F.col("miny") / 111000.0})
    return RE.redacted_points(a, "array_id")


@query("a18_h17_grouping_drift", ctes("arrays", extra=_SITED) + "select array_id, site_id as frozen_site, case when array_id % 50 = 0 then null when array_id % 40 = 0 then site_id + 1 else site_id end as current_site from sa where array_id % 50 = 0 or array_id % 40 = 0")
def _(t):
    frozen = sited(t).select("array_id", "site_id")
    now = frozen.filter("array_id % 50 <> 0").withColumn("site_id", F.when(F.col("array_id") % 40 == 0, F.col("site_id") + 1).otherwise(F.col("site_id")))
    return RE.grouping_drift(frozen, now, "array_id", "site_id")


@query("f2_select_targets", ctes("arrays", extra=_SITED + ", " + _SIN + ", " + priced_sql("si") + ", " + _SPREAD)
       + f"select array_id, prob_net_positive, pro_net_usd as expected_net_usd, {r('0.6e0 * risk_score + 0.4e0 * 0.5e0', 4)} as outreach_score from sa join (select pz.site_id, system_kw, pro_net_usd, prob_net_positive from pz left join mc on mc.site_id = pz.site_id) p on p.site_id = sa.site_id where system_kw >= 2 and system_kw <= 15 and risk_score >= 0.5 order by 3 desc, 4 desc, 1 limit 50")
def _(t):
    a = sited(t)
    s = RE.site_economics(a, "site_id", installs(t)).select("site_id", "system_kw", "prob_net_positive", F.col("pro_net_usd").alias("expected_net_usd"))
    j = a.join(s, "site_id").withColumns({"action": F.lit("monitor"), "confidence": F.lit(None).cast("double")})
    return RE.select_targets(j, 50, 2, 15).select("array_id", "prob_net_positive", "expected_net_usd", "outreach_score")


@query("f3_stratified_sample", ctes("scored", extra=f"q as (select quantile_cont(y, 0.25) as a, quantile_cont(y, 0.5) as b, quantile_cont(y, 0.75) as c from scored), d as (select row_id, case when y > c then 3 when y > b then 2 when y > a then 1 else 0 end as bin, {sql_draw_fine('''md5(cast(row_id as varchar) || '|26')''')} as u from scored, q), k as (select *, row_number() over (partition by bin order by u) as rn from d)")
       + "select row_id, cast(bin as int) as bin from k where rn <= 40")
def _(t):
    s = LE.stratified_sample(t.sql("scored"), "y", "row_id", 4, 40, 26)
    return s.select("row_id", F.col("bin").cast("int").alias("bin"))


@query("f3_evenly_spaced_sample", "with k as (select s_suppkey, row_number() over (order by s_acctbal, s_suppkey) as rk, count(*) over () as n from supplier) select s_suppkey from k where rk in (select cast(round_even(i * (n - 1) / 19e0, 0) as bigint) + 1 from range(0, 20) g(i), (select max(n) as n from k))")
def _(t):
    return LE.evenly_spaced(t.read("supplier"), "s_acctbal", "s_suppkey", 20).select("s_suppkey")


# ---- F11-F15, F19-F23 ------------------------------------------------------------------------------------------
_GEO = "ge as (select c_custkey as id, 33e0 + (c_custkey * 71 % 900) / 100e0 as lat, -124e0 + (c_custkey * 89 % 1000) / 100e0 as lon from customer)"


def _geo(t):
    c = F.col("c_custkey")
    return t.read("customer").select(c.alias("id"), (33.0 + c * 71 % 900 / 100.0).alias("lat"), (-124.0 + c * 89 % 1000 / 100.0).alias("lon"))


@query("f11_spatial_clusters", f"with {_GEO}, m as (select avg(lat) as m from ge) select id, cast(floor(lat / (30e0 / 111e0)) as bigint) as lat_bin, cast(floor(lon / (30e0 / (111e0 * greatest(0.1e0, cos(radians(m)))))) as bigint) as lon_bin from ge, m")
def _(t):
    return LE.spatial_clusters(_geo(t), "lat", "lon", 30.0).select("id", "lat_bin", "lon_bin")


@query("f11_kmeans_regions", None)
def _(t):
    return LE.kmeans_regions(_geo(t), "lat", "lon", 8).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("f12_grouped_folds", ctes("scored", extra="g as (select station_id, count(*) as n_rows from scored group by 1), k as (select *, (row_number() over (order by n_rows desc, station_id) - 1) % 10 as p from g)")
       + "select station_id, n_rows, cast(case when p < 5 then p else 9 - p end as int) as fold from k")
def _(t):
    return LE.grouped_folds(t.sql("scored"), "station_id", 5)


@query("f12_joint_fold_sizes", ctes("scored") + "select a.station_id, a.yr, count(*) as n_test, (select count(*) from scored) - max(s.n) - max(y.n) + count(*) as n_train from scored a join (select station_id, count(*) as n from scored group by 1) s on s.station_id = a.station_id join (select yr, count(*) as n from scored group by 1) y on y.yr = a.yr group by 1, 2")
def _(t):
    return LE.joint_fold_sizes(t.sql("scored"), "station_id", "yr")


@query("f12_fold_leakage", ctes("scored") + "select county, count(distinct yr) as n_folds from scored group by 1 having count(distinct yr) > 1")
def _(t):
    return LE.leakage(t.sql("scored"), "county", "yr")


def _matrix(t):
    s = t.sql("scored").withColumns({"x1": F.col("score"), "x2": F.when(F.col("row_id") % 10 != 0, F.col("y")), "x3": (F.col("row_id") % 17).cast("double")})
    return s.withColumn("fold", (F.col("station_id") % 2).cast("int"))


@query("f13_f14_out_of_fold_and_isotonic", None)
def _(t):
    oof = LE.out_of_fold(_matrix(t), ["x1", "x2", "x3"], "label", "fold", [0, 1], max_iter=3, max_depth=3)
    cal = LE.isotonic_calibration(oof.select("row_id", "fold", "label", "oof_score"), "oof_score", "label")
    return cal.select("row_id", "fold", micro(F.col("oof_score")).alias("oof_score"), micro(F.col("calibrated")).alias("calibrated"))


@query("f15_quantile_forest", None)
def _(t):
    m = _matrix(t).fillna(0.0, ["x2"])
    q = LE.quantile_forest(m.filter("fold = 0"), m.filter("fold = 1"), ["x1", "x3"], "y", "row_id", {"loss_p10": 0.1, "loss_p50": 0.5, "loss_p90": 0.9})
    return _round(q, "loss_p10", "loss_p50", "loss_p90")


@query("f19_ablation", None)
def _(t):
    out = LE.ablation(_matrix(t), {"all": ["x1", "x2", "x3"], "score_only": ["x1"]}, "label", "fold", [0, 1], [1], max_iter=2)
    return _round(out, "mean_auc").drop("sd_auc")


_TERM = "tm as (select cell_id, arg_max(eq_days, day) as eq from eqd group by 1), gr as (select tm.*, 1e0 - 0.05e0 - (cell_id % 30) / 1000e0 as iwsr, k, sat from tm, (values (10e0), (15e0), (30e0)) a(k), (values (0.05e0), (0.08e0), (0.12e0)) b(sat)), er as (select *, 1e0 - sat * (1e0 - exp(-eq / k)) - iwsr as e from gr)"


def _terminal(t):
    s = SO.equivalent_days(t.weather).groupBy("cell_id").agg(F.max_by("eq_days", "day").alias("eq"))
    return s.withColumn("iwsr", 1.0 - 0.05 - F.col("cell_id") % 30 / 1000.0)


@query("f20_physics_grid", ctes("weather", extra=eq_sql("cell_id", "weather") + ", " + _TERM) + f"select k, sat as sl_sat, {m6('sqrt(avg(e * e))')} as rmse, {m6('avg(abs(e))')} as mae, {m6('avg(e)')} as bias, count(*) as n from er group by 1, 2")
def _(t):
    return _round(LE.physics_grid(_terminal(t), "eq", "iwsr", (10, 15, 30), (0.05, 0.08, 0.12)), "rmse", "mae", "bias")


@query("f20_best_physics_by_zone", ctes("weather", extra=eq_sql("cell_id", "weather") + ", " + _TERM + ", g as (select cell_id % 3 as zone, k, sat, avg(abs(e)) as mae from er group by 1, 2, 3), b as (select *, row_number() over (partition by zone order by round_even(mae * 1e9, 0), k, sat) as rn from g)")
       + f"select zone, k, sat as sl_sat, {m6('mae')} as mae from b where rn = 1")
def _(t):
    d = _terminal(t).withColumn("zone", F.col("cell_id") % 3)
    return _round(LE.best_physics(LE.physics_grid(d, "eq", "iwsr", (10, 15, 30), (0.05, 0.08, 0.12), ["zone"]), ["zone"]), "mae")


def _sweep(t):
    m = MA.match_detections(t.sql("preds"), t.sql("truths")).withColumn("split", F.when(F.col("tile_id") % 3 == 0, "val").otherwise("test"))
    n = t.sql("truths").groupBy("split").agg(F.count(F.lit(1)).alias("n_truth"))
    return LE.threshold_sweep(m, "split", n, [0.1, 0.3, 0.5, 0.7, 0.9])


_SWEEP = _GREEDY + """, g as (select * from (values (0.1e0), (0.3e0), (0.5e0), (0.7e0), (0.9e0)) v(conf)),
 m as (select case when p.tile_id % 3 = 0 then 'val' else 'test' end as split, p.score, s.gt_id from preds p join st s on s.det_id = p.det_id),
 c as (select split, conf, count(gt_id) as tp, count(*) - count(gt_id) as fp from m join g on m.score >= g.conf group by 1, 2),
 n as (select split, count(*) as n from truths group by 1), w as (select n.split, g.conf, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, n.n - coalesce(tp, 0) as fn from n join g on true left join c on c.split = n.split and c.conf = g.conf)"""


@query("f21_threshold_sweep", _recursive(ctes("preds", "truths", extra=_SWEEP) + f"select split, conf, tp, fp, fn, {m6('case when tp + fp > 0 then tp * 1e0 / (tp + fp) else 0e0 end')} as precision, {m6('tp * 1e0 / (tp + fn)')} as recall, {m6('2e0 * tp / (2 * tp + fp + fn)')} as f1 from w"))
def _(t):
    return _round(_sweep(t), "precision", "recall", "f1")


@query("f21_tune_and_report", _recursive(ctes("preds", "truths", extra=_SWEEP + """, f as (select *, 2e0 * tp / (2 * tp + fp + fn) as f1 from w), b as (select conf, f1 from f where split = 'val' order by round_even(f1 * 1e12, 0) desc, conf limit 1)""")
       + f"select f.conf, {m6('b.f1')} as tuned_f1, {m6('tp * 1e0 / (tp + fp)')} as report_precision, {m6('tp * 1e0 / (tp + fn)')} as report_recall, {m6('f.f1')} as report_f1, {m6('(select max(f1) from f where split = ' + chr(39) + 'test' + chr(39) + ') - f.f1')} as tuning_penalty from f join b on b.conf = f.conf where split = 'test'"))
def _(t):
    out = LE.tune_and_report(_sweep(t), "split", "val", "test")
    return _round(out, "tuned_f1", "report_precision", "report_recall", "report_f1", "tuning_penalty")


@query("f23_fold_diagnostics", ctes("scored", extra="""s as (select station_id % 5 as fold, station_id, label, 33e0 + station_id / 30e0 as lat, -122e0 + station_id / 40e0 as lon from scored),
 p as (select fold, station_id, count(*) as n, sum(label) as pos, min(lat) as a, min(lon) as b from s group by 1, 2), k as (select *, row_number() over (partition by fold order by n desc, station_id) as rk from p)""")
       + f"select fold, cast(sum(n) as bigint) as n_rows, count(*) as n_stations, {m6('sum(pos) * 1e0 / sum(n)')} as pos_rate, {m6('min(a)')} as lat_min, {m6('max(a)')} as lat_max, string_agg(station_id || ':' || n, ',' order by rk) filter (where rk <= 8) as top_stations from k group by 1")
def _(t):
    s = t.sql("scored").withColumns({"fold": F.col("station_id") % 5, "lat": 33.0 + F.col("station_id") / 30.0, "lon": -122.0 + F.col("station_id") / 40.0})
    d = LE.fold_diagnostics(s, "fold", "station_id", "label", "lat", "lon")
    return _round(d, "pos_rate", "lat_min", "lat_max").drop("lon_min", "lon_max")
