"""Queries of the economics operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dustledger import constants as K
from dustledger.functions import pv
from dustledger.functions.numeric import cents, half_even, micro
from dustledger.operators import economics as EC, soiling as SO
from dustledger.plans.q_series import eq_sql
from dustledger.plans.registry import query
from dustledger.plans.views import ctes, m6, r, sql_draw, sql_piecewise

RETAIL = pv.RETAIL_USD_PER_KWH
NBT, NEM2, MIX = pv.regime_rate("nbt_no_battery"), pv.regime_rate("nem2_legacy"), pv.blended_rate()


def pro_cost_sql(kw: str) -> str:
    ladder = sql_piecewise(kw, K.LADDER_KW, K.LADDER_USD)
    return f"greatest(greatest(1e0, round_even({kw} / 0.44e0, 0)) * ({ladder}), 150e0)"


def rinse_cost_sql(kw: str) -> str:
    return f"greatest(0.5e0 * {pro_cost_sql(kw)}, 90e0)"


RATE_SQL = (f"case when install_date >= date '{K.NBT_START_DATE}' then {NBT!r}e0 "
            f"when install_date is not null then {NEM2!r}e0 else {MIX!r}e0 end")


def priced_sql(source: str, kw="system_kw", hours="sun_hours", loss="loss_pct", rate="usd_per_kwh",
               rinse="0.032e0", pro="0.045e0", name="pz") -> str:
    """CTE chain with the dollars of every strategy and the chosen one."""
    return f"""{name}0 as (select *, {kw} * {hours} * 365e0 * 0.84e0 * ({loss} / 100e0) * {rate} as loss_,
   {rinse_cost_sql(kw)} as cr_, {pro_cost_sql(kw)} as cp_ from {source}),
 {name}1 as (select *, {r(f'loss_ * {rinse}', 2)} as rinse_recovered_usd, {r('cr_', 2)} as rinse_cost_usd, {r(f'loss_ * {rinse} - cr_', 2)} as rinse_net_usd,
   {r(f'loss_ * {pro}', 2)} as pro_recovered_usd, {r('cp_', 2)} as pro_cost_usd, {r(f'loss_ * {pro} - cp_', 2)} as pro_net_usd,
   {r('loss_', 2)} as annual_loss_usd from {name}0),
 {name}2 as (select *, case when rinse_net_usd > 0 and rinse_net_usd >= pro_net_usd then 'rinse_service' when pro_net_usd > 0 then 'professional' else 'no_clean' end as recommended_action from {name}1),
 {name} as (select *, recommended_action <> 'no_clean' as worth_cleaning,
   case recommended_action when 'rinse_service' then rinse_net_usd when 'professional' then pro_net_usd else 0e0 end as expected_net_usd,
   case recommended_action when 'rinse_service' then {r('rinse_net_usd / rinse_cost_usd', 2)} when 'professional' then {r('pro_net_usd / pro_cost_usd', 2)} end as roi,
   case recommended_action when 'rinse_service' then {r('rinse_cost_usd / rinse_recovered_usd', 2)} when 'professional' then {r('pro_cost_usd / pro_recovered_usd', 2)} end as payback_years from {name}2)"""


def priced_sites(t):
    rate, _ = pv.site_rate(F.col("install_date"))
    return t.sql("sites").withColumn("usd_per_kwh", rate)


_PS = f"ps as (select *, {RATE_SQL} as usd_per_kwh from sites)"
_H1_COLS = ("site_id, annual_loss_usd, rinse_recovered_usd, rinse_cost_usd, rinse_net_usd, pro_recovered_usd, pro_cost_usd, "
            "pro_net_usd, recommended_action, worth_cleaning, expected_net_usd, roi, payback_years")


@query("h1_best_strategy", ctes("sites", extra=_PS + ", " + priced_sql("ps")) + f"select {_H1_COLS} from pz")
def _(t):
    return EC.best_strategy(priced_sites(t)).select(*_H1_COLS.split(", "))


@query("flagship_soiling_to_dollars", ctes("weather", "sites", extra=eq_sql("cell_id", "weather") + f""",
 loss as (select cell_id, round_even(avg(soiling_loss) * 100e0 * 1e3, 0) / 1e3 as loss_pct from eqd group by 1),
 js as (select s.site_id, s.system_kw, s.sun_hours, s.install_date, l.cell_id, l.loss_pct, {RATE_SQL} as usd_per_kwh
   from sites s join loss l on s.owner_id % (select count(*) from supplier) = l.cell_id)""" + ", " + priced_sql("js"))
       + """select site_id, cell_id, loss_pct, annual_loss_usd, recommended_action, expected_net_usd, pro_net_usd from pz
order by expected_net_usd desc, pro_net_usd desc, site_id limit 20""")
def flagship(t):
    """Soiling series per cell -> mean loss -> join to sites -> best strategy -> top 20."""
    cells = t.read("supplier").agg(F.count(F.lit(1)).alias("_n"))
    from dustledger.operators.ranks import attach_row

    loss = SO.soiling_labels(SO.equivalent_days(t.weather)).select("cell_id", F.col("mean_loss_pct").alias("loss_pct"))
    sites = attach_row(priced_sites(t).drop("loss_pct"), cells).withColumn("cell_id", F.col("owner_id") % F.col("_n"))
    out = EC.best_strategy(sites.join(loss, "cell_id"))
    return (out.orderBy(F.desc("expected_net_usd"), F.desc("pro_net_usd"), "site_id").limit(20)
            .select("site_id", "cell_id", "loss_pct", "annual_loss_usd", "recommended_action", "expected_net_usd", "pro_net_usd"))


N_MC = 2000
_SIG = math.sqrt(math.log(1.0 + K.AREA_SCALE_1SIGMA**2))


def mc_sql(source: str, key: str, n: int = N_MC, name: str = "mc", cols: str = "", seed: int = 42) -> str:
    """CTEs: draws and the per-site summary. Source has the columns of ``net_draws``."""
    return f"""{name}k as (select s.*, i, md5(cast({key} as varchar) || '|{seed}') as k from {source} s, range(1, {n + 1}) g(i)),
 {name}s as (select *, {", ".join(f"{sql_draw('k', i)} + i * {EC.STRIDES[i]!r}e0 as w{i}" for i in range(5))} from {name}k),
 {name}u as (select *, {", ".join(f"greatest(w{i} - floor(w{i}), 1e-9) as u{i}" for i in range(5))} from {name}s),
 {name}z as (select *, sqrt(-2e0 * ln(u1)) * cos(6.283185307179586e0 * u2) as z1, sqrt(-2e0 * ln(u1)) * sin(6.283185307179586e0 * u2) as z2,
   greatest(1e-9, (loss_p50 - least(loss_p10, loss_p50)) / {K.Z90}e0) as slo, greatest(1e-9, (greatest(loss_p90, loss_p50) - loss_p50) / {K.Z90}e0) as shi from {name}u),
 {name}d as (select *, greatest(0e0, case when u0 < slo / (slo + shi) then loss_p50 - abs(z1 * slo) else loss_p50 + abs(z1 * shi) end) as dl,
   greatest(1e-6, system_kw * exp({-0.5 * _SIG**2!r}e0 + {_SIG!r}e0 * z2)) as dkw, rate_lo + (rate_hi - rate_lo) * u3 as dr,
   rec_rinse + (rec_pro - rec_rinse) * u4 as dsh from {name}z),
 {name}n as (select *, dkw * sun_hours * 365e0 * 0.84e0 * (dl / 100e0) * dr * dsh as rec from {name}d),
 {name}p as (select *, rec * (rec_rinse / rec_pro) - {rinse_cost_sql('dkw')} as net_rinse, rec - {pro_cost_sql('dkw')} as net_pro from {name}n),
 {name}a as (select {key}, any_value(recommended_action) as act, list_sort(list(net_rinse)) as lr, list_sort(list(net_pro)) as lp, avg(net_rinse) as mr, avg(net_pro) as mp,
   avg(case when net_rinse > 0 then 1e0 else 0e0 end) as pr, avg(case when net_pro > 0 then 1e0 else 0e0 end) as pp,
   avg(case when greatest(net_rinse, net_pro) > 0 then 1e0 else 0e0 end) as pany from {name}p group by {key}),
 {name}b as (select *, act = 'rinse_service' or (act = 'no_clean' and mr >= mp) as is_r from {name}a),
 {name} as (select {key}, {", ".join(r(f"case when is_r then lr[{EC.nearest_rank(n, q) + 1}] else lp[{EC.nearest_rank(n, q) + 1}] end", 2) + f" as expected_net_usd_p{int(q * 100)}" for q in (0.1, 0.5, 0.9))},
   {r('case when is_r then mr else mp end', 2)} as expected_net_usd_mean, {r('case when is_r then pr else pp end', 4)} as prob_net_positive,
   {r('pany', 4)} as prob_any_action_positive, (case when is_r then pr else pp end) >= 0.8e0 or (case when is_r then pr else pp end) <= 0.2e0 as decision_robust from {name}b)"""


_LO, _HI = pv.regime_rate("nbt_no_battery", 1), pv.regime_rate("nbt_no_battery", 2)
_MCIN = f"""mi as (select *, loss_pct as loss_p50, loss_pct * {K.LOSS_P10_OVER_P50!r}e0 as loss_p10, loss_pct * {K.LOSS_P90_OVER_P50!r}e0 as loss_p90,
   {_LO!r}e0 as rate_lo, {_HI!r}e0 as rate_hi, 0.032e0 as rec_rinse, 0.045e0 as rec_pro from pz)"""


@query("h2_monte_carlo_net", ctes("sites", extra=_PS + ", " + priced_sql("ps") + ", " + _MCIN + ", " + mc_sql("mi", "site_id")) + "select * from mc")
def _(t):
    s = EC.best_strategy(priced_sites(t)).withColumns(
        {"loss_p50": F.col("loss_pct"), "loss_p10": F.lit(None).cast("double"), "loss_p90": F.lit(None).cast("double")})
    return EC.monte_carlo(EC.with_default_interval(s), "site_id", N_MC)


@query("h3_breakeven_size_loss_tariff", ctes("sites", extra=_PS + f""",
 g as (select i, case when i <= 300 then i / 10e0 else 30e0 + (i - 300) end as kw from range(1, 5271) q(i)),
 gc as (select i, kw, {pro_cost_sql('kw')} / kw as need from g),
 low as (select * from (select *, min(need) over (order by i rows between unbounded preceding and 1 preceding) as prev from gc) where prev is null or need < prev),
 c as (select *, 1e0 * sun_hours * 365e0 * 0.84e0 * (loss_pct / 100e0) * usd_per_kwh * 0.045e0 as c,
   system_kw * sun_hours * 365e0 * 0.84e0 * 0.01e0 * usd_per_kwh * 0.045e0 as per_point, {pro_cost_sql('system_kw')} as cost from ps)""")
       + f"""select c.site_id, low.kw as breakeven_kw,
  case when floor(cost / per_point * 10e0) + 1 <= 300 then greatest(1, floor(cost / per_point * 10e0) + 1) / 10e0 end as breakeven_loss_pct,
  {r('usd_per_kwh * cost / (system_kw * sun_hours * 365e0 * 0.84e0 * (loss_pct / 100e0) * usd_per_kwh * 0.045e0)', 4)} as breakeven_tariff
from c left join low on c.c > low.need and c.c <= coalesce(low.prev, 'infinity'::double)""")
def _(t):
    s = priced_sites(t)
    _, pro = EC.recovery_pair()
    kw = EC.breakeven_system_kw(s, "site_id", "professional", pro)
    args = [F.col(c) for c in ("system_kw", "sun_hours", "usd_per_kwh")]
    s = s.select("site_id", EC.breakeven_loss_pct(*args, pro, "professional").alias("breakeven_loss_pct"),
                 EC.breakeven_tariff(args[0], args[1], F.col("loss_pct"), args[2], pro, "professional").alias("breakeven_tariff"))
    return kw.join(s, "site_id").select("site_id", "breakeven_kw", "breakeven_loss_pct", "breakeven_tariff")


_GRID_RATES = (0.15, 0.25, 0.35)


@query("h7_strategy_grid", ctes("sites", extra="g as (select s.* , rate as usd_per_kwh from sites s, (values (0.15e0), (0.25e0), (0.35e0)) v(rate)), " + priced_sql("g") + """,
 e as (select site_id, usd_per_kwh, annual_loss_usd, loss_, cr_, cp_, unnest([0, 1, 2]) as pos from pz),
 f as (select *, case pos when 0 then 0e0 when 1 then loss_ * 0.032e0 else loss_ * 0.045e0 end as rec, case pos when 0 then 0e0 when 1 then cr_ else cp_ end as cost from e),
 h as (select *, row_number() over (partition by site_id, usd_per_kwh order by rec - cost desc, pos) as rn from f)""")
       + f"""select site_id, usd_per_kwh, case pos when 0 then 'no_clean' when 1 then 'rinse_service' else 'professional' end as scenario, annual_loss_usd,
 {r('rec', 2)} as recovered_usd, {r('cost', 2)} as cost_usd, {r('rec - cost', 2)} as net_benefit_usd, rn = 1 as is_best from h""")
def _(t):
    grid = EC.strategy_grid(EC.sweep(t.sql("sites"), "usd_per_kwh", _GRID_RATES))
    return grid.select("site_id", "usd_per_kwh", "scenario", "annual_loss_usd", "recovered_usd", "cost_usd", "net_benefit_usd", "is_best")


_RATES = [round(0.05 * i, 2) for i in range(1, 29)]
_RATE_VALUES = ", ".join(f"({v}e0)" for v in _RATES)
_CURVE = f"g as (select s.*, rate as usd_per_kwh from sites s, (values {_RATE_VALUES}) v(rate)), " + priced_sql("g") + """,
 cv as (select usd_per_kwh, count(*) as n_sites, cast(sum(case when worth_cleaning then 1 else 0 end) as bigint) as n_clean,
   sum(cast(round_even(expected_net_usd * 100, 0) as bigint)) as ct from pz group by 1)"""


@query("h8_rate_sensitivity", ctes("sites", extra=_CURVE) + f"""select usd_per_kwh, n_sites, n_clean, {m6('100e0 * n_clean / n_sites')} as pct_clean,
 cast(ct as double) / 100e0 as total_net_usd, {m6('cast(ct as double) / 100e0 / n_sites')} as mean_net_usd from cv""")
def _(t):
    out = EC.rate_sensitivity(t.sql("sites"), _RATES)
    return out.withColumns({c: micro(F.col(c)) for c in ("pct_clean", "mean_net_usd")})


@query("h8_flip_rates", ctes("sites", extra=_CURVE) + """select min(case when n_clean > 0 then usd_per_kwh end) as flip_any,
 min(case when 100e0 * n_clean / n_sites >= 50 then usd_per_kwh end) as flip_half from cv""")
def _(t):
    return EC.flip_rates(EC.rate_sensitivity(t.sql("sites"), _RATES))


@query("h8_regime_summary", ctes("sites", extra=f"g as (select s.*, regime, rate as usd_per_kwh from sites s, (values "
       + ", ".join(f"('{k}', {pv.regime_rate(k)!r}e0)" for k in K.REGIMES) + ") v(regime, rate)), " + priced_sql("g"))
       + f"select regime, any_value(usd_per_kwh) as usd_per_kwh, count(*) as n_sites, {m6('100e0 * sum(case when worth_cleaning then 1 else 0 end) / count(*)')} as pct_clean from pz group by 1")
def _(t):
    regimes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(pv.regime_rate(k)).alias("v")) for k in K.REGIMES])
    s = t.sql("sites").withColumn("_r", F.explode(regimes)).withColumns(
        {"regime": F.col("_r.k"), "usd_per_kwh": F.col("_r.v")})
    return EC.best_strategy(s).groupBy("regime").agg(
        F.first("usd_per_kwh").alias("usd_per_kwh"), F.count(F.lit(1)).alias("n_sites"),
        micro(100.0 * F.sum(F.when(F.col("worth_cleaning"), 1).otherwise(0)) / F.count(F.lit(1))).alias("pct_clean"))


_BASE = """base as (select parcel_no, max(kw) as system_kw, 5.5e0 as sun_hours, 4.7e0 as loss_pct, %re0 as usd_per_kwh from permits where kw > 0 group by 1)""" % NEM2


@query("h9_market_concentration", ctes("permits", extra=_BASE + ", " + priced_sql("base") + """,
 rk as (select *, rank() over (order by expected_net_usd) + (count(*) over (partition by expected_net_usd) - 1) / 2e0 as rnk, count(*) over () as n from pz)""")
       + f"""select count(*) as n_sites, {r('sum(expected_net_usd)', 2)} as total_usd, {m6('sum((2e0 * rnk - n - 1e0) * expected_net_usd) / (max(n) * sum(expected_net_usd))')} as gini,
 (select {r('sum(expected_net_usd)', 2)} from (select expected_net_usd from pz order by expected_net_usd desc, parcel_no limit 10)) as top_usd from rk""")
def _(t):
    base = (t.sql("permits").filter("kw > 0").groupBy("parcel_no").agg(F.max("kw").alias("system_kw"))
            .withColumns({"sun_hours": F.lit(5.5), "loss_pct": F.lit(4.7), "usd_per_kwh": F.lit(NEM2)}))
    out = EC.value_concentration(EC.best_strategy(base), "parcel_no", "expected_net_usd")
    return out.withColumns({"gini": micro(F.col("gini")), "total_usd": cents(F.col("total_usd")), "top_usd": cents(F.col("top_usd"))})


_SEG = "case when system_kw < 10 then 'residential' when system_kw < 20 then 'small_commercial' else 'large' end"


@query("h9_installed_base_segments", ctes("permits", extra=_BASE)
       + f"select {_SEG} as segment, count(*) as n_parcels, {m6('quantile_cont(system_kw, 0.5)')} as median_kw, {r('sum(system_kw)', 2)} as total_kw from base group by 1")
def _(t):
    from dustledger.operators.ranks import exact_quantiles

    base = t.sql("permits").filter("kw > 0").groupBy("parcel_no").agg(F.max("kw").alias("system_kw"))
    base = base.withColumn("segment", F.when(F.col("system_kw") < 10, "residential")
                           .when(F.col("system_kw") < 20, "small_commercial").otherwise("large"))
    q = exact_quantiles(base, ["segment"], "system_kw", {"median_kw": 0.5})
    total = base.groupBy("segment").agg(cents(F.sum("system_kw")).alias("total_kw"))
    return q.join(total, "segment").select("segment", F.col("n").alias("n_parcels"), micro(F.col("median_kw")).alias("median_kw"), "total_kw")


_FILTERS = {
    "all": "true", "pv_text": "(lower(description) like '%photovolta%' or description like '%PV%')", "mount": "mount is not null",
    "mount_or_pv": "(mount is not null or lower(description) like '%photovolta%' or description like '%PV%')", "roof_only": "coalesce(mount, '') like 'roof%'"}


@query("h9_era_segments_by_filter", ctes("permits", extra="u as (" + " union all ".join(
    f"select '{k}' as pv_filter, parcel_no, min(issued) as first_issued, count(*) as n from permits where issued is not null and {v} group by 2" for k, v in _FILTERS.items()) + ")")
       + f"""select pv_filter, case when first_issued >= date '{K.NBT_START_DATE}' then 'nbt' when year(first_issued) >= 2019 then 'nem2_half_cut' else 'full_cell' end as era,
 count(*) as parcels, cast(sum(n) as bigint) as permit_rows from u group by 1, 2""")
def _(t):
    """One scan: each permit is kept once per filter it passes, then earliest date per parcel."""
    tags = F.array_compact(F.array(*[F.when(F.expr(v), F.lit(k)) for k, v in _FILTERS.items()]))
    p = t.sql("permits").filter("issued IS NOT NULL").withColumn("pv_filter", F.explode(tags))
    first = p.groupBy("pv_filter", "parcel_no").agg(F.min("issued").alias("d"), F.count(F.lit(1)).alias("n"))
    era = (F.when(F.col("d") >= F.to_date(F.lit(K.NBT_START_DATE)), "nbt")
           .when(F.year("d") >= 2019, "nem2_half_cut").otherwise("full_cell"))
    return first.groupBy("pv_filter", era.alias("era")).agg(F.count(F.lit(1)).alias("parcels"), F.sum("n").alias("permit_rows"))


_CASES = tuple(K.BAND_LOSS_PCT)
_ARCH = f"""sh as (select *, area_m2 / {K.M2_PER_KW!r}e0 as system_kw, case when tilt_deg is not null then 1e0 + 0.6e0 * least(1e0, greatest(0e0, coalesce(canopy_frac, 0e0))) + 0.25e0 * least(1e0, greatest(0e0, (35e0 - tilt_deg) / 35e0))
   + 0.15e0 * least(1e0, greatest(0e0, abs(azimuth_deg - 180e0) / 180e0)) end as shade from arrays),
 fs as (select sh.*, f_sat, case when shade <= 1.05e0 then 0e0 else f_sat * (1e0 - exp(-2.5e0 * (shade - 1.05e0))) end as f from sh, (values (0.1e0), (0.3e0), (0.5e0)) v(f_sat))"""


@query("h10_threshold_counts", ctes("arrays", extra=_ARCH + ", ca as (" + " union all ".join(
    f"select array_id, f_sat, system_kw, '{c}' as panel_case, case when f is not null then least({100.0 * 4 / 20 if 'mlpe' in c else 100.0}e0, {sql_piecewise('f', K.BAND_LOSS_F, K.BAND_LOSS_PCT[c])}) end as loss from fs" for c in _CASES) + f"""),
 ra as (select ca.*, tariff, system_kw * 5.5e0 * 365e0 * 0.84e0 * (loss / 100e0) * rate * 0.39e0 - {pro_cost_sql('system_kw')} as net from ca, (values ('nbt', {NBT!r}e0), ('nem2', {NEM2!r}e0)) v(tariff, rate))""")
       + f"select panel_case, tariff, f_sat, count(*) as n, cast(sum(case when net > 0 then 1 else 0 end) as bigint) as n_clear, {m6('100e0 * sum(case when net > 0 then 1 else 0 end) / count(*)')} as pct_clear, {r('max(net)', 2)} as best_net from ra group by 1, 2, 3")
def _(t):
    """Arrays clearing $0 by panel case, tariff and coverage ceiling; all options exploded in-row."""
    a = t.sql("arrays")
    a = a.select(pv.kw_from_area(F.col("area_m2")).alias("kw"), pv.shade_factor(
        F.coalesce("canopy_frac", F.lit(0.0)), F.col("tilt_deg"), F.col("azimuth_deg")).alias("shade"))
    a = EC.sweep(a, "f_sat", (0.1, 0.3, 0.5)).withColumn("f", pv.roof_equilibrium(F.col("shade"), F.col("f_sat")))
    cases = F.array(*[F.struct(F.lit(c).alias("panel_case"), pv.band_loss_pct(F.col("f"), c).alias("loss")) for c in _CASES])
    rates = F.array(*[F.struct(F.lit(k).alias("tariff"), F.lit(v).alias("rate")) for k, v in (("nbt", NBT), ("nem2", NEM2))])
    a = a.withColumn("c", F.explode(cases)).withColumn("t", F.explode(rates))
    net = pv.annual_loss_usd(F.col("kw"), F.lit(5.5), F.col("c.loss") / 100.0, F.col("t.rate")) * 0.39 - pv.professional_cost(F.col("kw"))
    return (a.withColumn("net", net).groupBy("c.panel_case", "t.tariff", "f_sat")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("net") > 0, 1).otherwise(0)).alias("n_clear"), cents(F.max("net")).alias("best_net"))
            .withColumn("pct_clear", micro(100.0 * F.col("n_clear") / F.col("n"))))


_RECS = (0.045, 0.10, 0.125, 0.20, 0.35, 0.50, 0.90)


@query("h11_required_loss_by_recovery", ctes("sites", extra=_PS + f""",
 x as (select site_id, recovery, {pro_cost_sql('system_kw')} / (system_kw * sun_hours * 365e0 * 0.84e0 * 0.01e0 * usd_per_kwh * recovery) as q from ps, (values {", ".join(f"({v}e0)" for v in _RECS)}) v(recovery))""")
       + "select site_id, recovery, case when floor(q * 10e0) + 1 <= 2000 then (floor(q * 10e0) + 1) / 10e0 end as required_loss_pct from x")
def _(t):
    s = EC.sweep(priced_sites(t), "recovery", _RECS)
    need = EC.breakeven_loss_pct(F.col("system_kw"), F.col("sun_hours"), F.col("usd_per_kwh"), F.col("recovery"), "professional", 200.0)
    return s.select("site_id", "recovery", need.alias("required_loss_pct"))


@query("h18_opportunity_scenarios", """with s as (select c_mktsegment, count(*) as homes from customer group by 1)
select c_mktsegment as segment, share, take, homes * share as target_homes, homes * share * 90e0 * 2 as serviceable_usd, homes * share * 90e0 * 2 * take as revenue_usd
from s, (values (0.05e0), (0.1e0), (0.2e0)) a(share), (values (0.1e0), (0.2e0)) b(take)""")
def _(t):
    s = t.read("customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("homes"))
    s = EC.sweep(EC.sweep(s, "share", (0.05, 0.1, 0.2)), "take", (0.1, 0.2))
    targets = F.col("homes") * F.col("share")
    spend = targets * F.lit(K.MIN_RINSE_USD) * 2
    return s.select("segment", "share", "take", targets.alias("target_homes"), spend.alias("serviceable_usd"), (spend * F.col("take")).alias("revenue_usd"))


@query("h19_scenario_surface", ctes("sites", extra=_PS + ", " + priced_sql("ps"))
       + "select cast(floor(loss_pct) as int) as loss_band, " + ", ".join(
           f"{m6(f'avg(case when owner_id % 3 = {i} then pro_net_usd end)')} as net_{i}" for i in range(3)) + " from pz group by 1")
def _(t):
    p = EC.best_strategy(priced_sites(t)).select(F.floor("loss_pct").cast("int").alias("loss_band"),
                                                 F.concat(F.lit("net_"), F.col("owner_id") % 3).alias("g"), "pro_net_usd")
    return p.groupBy("loss_band").pivot("g", ["net_0", "net_1", "net_2"]).agg(micro(F.avg("pro_net_usd")))


@query("h20_shortfall_ecdf", ctes("sites", extra=_PS + ", " + priced_sql("ps") + """,
 b as (select site_id, pro_cost_usd / pro_recovered_usd as shortfall from pz where pro_recovered_usd > 0)""")
       + f"select site_id, {m6('shortfall')} as shortfall, {m6('100e0 * cume_dist() over (order by shortfall)')} as ecdf_pct from b")
def _(t):
    from dustledger.operators.ranks import cumulative, value_table

    p = EC.best_strategy(priced_sites(t)).filter("pro_recovered_usd > 0").select(
        "site_id", (F.col("pro_cost_usd") / F.col("pro_recovered_usd")).alias("v"))
    c = cumulative(value_table(p, [], "v"), [])
    c = c.select("v", (100.0 * (F.col("n_below") + F.col("n")) / F.col("n_total")).alias("ecdf"))
    return p.join(c, "v").select("site_id", micro(F.col("v")).alias("shortfall"), micro(F.col("ecdf")).alias("ecdf_pct"))


@query("h20_best_site", ctes("sites", extra=_PS + ", " + priced_sql("ps"))
       + f"select site_id as best_site, {m6('pro_cost_usd / pro_recovered_usd')} as shortfall, system_kw from pz where pro_recovered_usd > 0 order by pro_cost_usd / pro_recovered_usd, site_id limit 1")
def _(t):
    p = EC.best_strategy(priced_sites(t)).filter("pro_recovered_usd > 0").withColumn("s", F.col("pro_cost_usd") / F.col("pro_recovered_usd"))
    best = p.agg(F.min_by(F.struct("site_id", "s", "system_kw"), F.struct("s", "site_id")).alias("b"))
    return best.select(F.col("b.site_id").alias("best_site"), micro(F.col("b.s")).alias("shortfall"), F.col("b.system_kw").alias("system_kw"))


@query("h21_coverage_needed", ctes("sites", extra=_PS + f""",
 nd as (select site_id, 100e0 * {pro_cost_sql('system_kw')} / (system_kw * sun_hours * 365e0 * 0.84e0 * usd_per_kwh * 0.5e0) as need from ps),
 g as (select i, 0.01e0 + i * (0.99e0 / 399e0) as f from range(0, 400) q(i)),
 gl as (select i, f, {sql_piecewise('f', K.BAND_LOSS_F, K.BAND_LOSS_PCT['portrait_full_string'])} as loss from g)""")
       + f"select nd.site_id, {m6('min(gl.f)')} as coverage_needed from nd left join gl on gl.loss >= nd.need group by 1")
def _(t):
    s = priced_sites(t)
    need = EC.coverage_needed(F.col("system_kw"), F.col("sun_hours"), F.col("usd_per_kwh"), F.lit(0.5), "portrait_full_string")
    return s.select("site_id", micro(need).alias("coverage_needed"))
