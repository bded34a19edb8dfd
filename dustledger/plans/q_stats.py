"""Queries of the statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dustledger.functions.numeric import micro, wilson_interval
from dustledger.operators import ranks as R, stats as ST
from dustledger.plans.registry import query
from dustledger.plans.views import ctes, m6, sql_draw_fine


def _round(df, *cols):
    return df.withColumns({c: micro(F.col(c)) for c in cols})


_AUC = """v as (select {k}score, count(*) as n, sum(label) as pos from scored group by all),
 c as (select *, sum(n) over w - n as nb, sum(pos) over w - pos as pb from v window w as ({p}order by score rows unbounded preceding)),
 a as (select {k}sum(pos) as n_pos, sum(n) - sum(pos) as n_neg, sum(pos * (nb - pb + (n - pos) / 2e0)) as wins from c group by all)"""


@query("f5_auc_by_group", ctes("scored", extra=_AUC.format(k="county, ", p="partition by county "))
       + f"select county, cast(n_pos as bigint) as n_pos, cast(n_neg as bigint) as n_neg, {m6('wins / (n_pos * n_neg)')} as auc from a")
def _(t):
    return _round(ST.auc(t.sql("scored"), "score", "label", ["county"]), "auc")


@query("f5_average_precision", ctes("scored", extra="""v as (select score, count(*) as n, sum(label) as pos from scored group by 1),
 c as (select *, sum(n) over w as na, sum(pos) over w as pa from v window w as (order by score desc rows unbounded preceding))""")
       + f"select {m6('sum(pos * pa / na) / sum(pos)')} as average_precision from c")
def _(t):
    return _round(ST.average_precision(t.sql("scored"), "score", "label"), "average_precision")


@query("f6_hanley_mcneil_se", ctes("scored", extra=_AUC.format(k="", p="") + """,
 b as (select n_pos * 1e0 as np, n_neg * 1e0 as nn, wins / (n_pos * n_neg) as a from a)""")
       + f"select {m6('a')} as auc, {m6('sqrt((a * (1 - a) + (np - 1) * (a / (2 - a) - a * a) + (nn - 1) * (2 * a * a / (1 + a) - a * a)) / (np * nn))')} as se from b")
def _(t):
    a = ST.auc(t.sql("scored"), "score", "label")
    se = ST.hanley_mcneil_se(F.col("auc"), F.col("n_pos"), F.col("n_neg"))
    return a.select(micro(F.col("auc")).alias("auc"), micro(se).alias("se"))


def _rank(col: str, p: str = "") -> str:
    return f"rank() over ({p}order by {col}) + (count(*) over (partition by {'county, ' if p else ''}{col}) - 1) / 2e0"


@query("f7_spearman_by_group", ctes("scored", extra=f"k as (select county, {_rank('score', 'partition by county ')} as rx, {_rank('y', 'partition by county ')} as ry from scored)")
       + f"select county, count(*) as n, {m6('corr(rx, ry)')} as spearman from k group by 1 having count(*) >= 3")
def _(t):
    return _round(ST.spearman(t.sql("scored"), "score", "y", ["county"]), "spearman")


@query("f7_spearman_overall", ctes("scored", extra=f"k as (select {_rank('p50')} as rx, {_rank('y')} as ry from scored)")
       + f"select count(*) as n, {m6('corr(rx, ry)')} as spearman from k")
def _(t):
    return _round(ST.spearman(t.sql("scored"), "p50", "y"), "spearman")


_REL = "rel as (select cast(least(floor(score * 10), 9) as int) as bin, count(*) as n, avg(score) as mean_pred, avg(label * 1e0) as obs_freq, sum((score - label) * (score - label)) as sq, sum(label) as pos from scored group by 1)"


@query("f8_reliability_table", ctes("scored", extra=_REL) + f"select bin, n, {m6('mean_pred')} as mean_pred, {m6('obs_freq')} as obs_freq from rel")
def _(t):
    return _round(ST.reliability(t.sql("scored"), "score", "label"), "mean_pred", "obs_freq").drop("_sq", "_pos")


@query("f8_calibration", ctes("scored", extra=_REL + ", s as (select sum(n) as n, sum(pos) * 1e0 / sum(n) as base_rate, sum(sq) / sum(n) as brier, sum(n * abs(obs_freq - mean_pred)) / sum(n) as ece, max(abs(obs_freq - mean_pred)) as mce from rel)")
       + f"select cast(n as bigint) as n, {m6('base_rate')} as base_rate, {m6('brier')} as brier, {m6('base_rate * (1 - base_rate)')} as brier_baserate, {m6('ece')} as ece, {m6('mce')} as mce from s")
def _(t):
    return _round(ST.calibration(t.sql("scored"), "score", "label"), "base_rate", "brier", "brier_baserate", "ece", "mce")


@query("f9_ks_two_sample", ctes("scored", extra="""c as (select score, sum(case when instrument = 'A' then 1 else 0 end) as a, sum(case when instrument = 'A' then 0 else 1 end) as b from scored group by 1),
 d as (select *, sum(a) over w as ca, sum(b) over w as cb, sum(a) over () as na, sum(b) over () as nb from c window w as (order by score rows unbounded preceding)),
 k as (select max(na) as n_a, max(nb) as n_b, max(abs(ca * 1e0 / na - cb * 1e0 / nb)) as ks from d),
 l as (select *, sqrt(n_a * 1e0 * n_b / (n_a + n_b)) as en from k),
 p as (select *, power((en + 0.12e0 + 0.11e0 / en) * ks, 2) as l2 from l)""")
       + f"select cast(n_a as bigint) as n_a, cast(n_b as bigint) as n_b, {m6('ks')} as ks, {m6('greatest(0e0, least(1e0, (select 2e0 * sum(case when j % 2 = 1 then 1e0 else -1e0 end * exp(-2e0 * j * j * l2)) from range(1, 101) r(j))))')} as p_value from p")
def _(t):
    return _round(ST.ks_two_sample(t.sql("scored"), "score", F.col("instrument") == "A"), "ks", "p_value")


@query("f10_wilcoxon_signed_rank", ctes("scored", extra="""d as (select abs(p50 - y) as a, p50 - y > 0 as up from scored where p50 <> y),
 k as (select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2e0 as rk, count(*) over (partition by a) as tie from d),
 s as (select count(*) as n, sum(case when up then rk else 0e0 end) as w_plus, sum(case when up then 0e0 else rk end) as w_minus, sum(tie * 1e0 * tie - 1) as ties from k),
 z as (select *, (least(w_plus, w_minus) - n * (n + 1) / 4e0) / sqrt(n * 1e0 * (n + 1) * (2 * n + 1) / 24e0 - ties / 48e0) as z from s)""")
       + f"select n, w_plus, w_minus, {m6('z')} as z from z")
def _(t):
    return _round(ST.wilcoxon(t.sql("scored").withColumn("d", F.col("p50") - F.col("y")), "d"), "z").drop("p_value")


_B = 4000
_TP = "sum(case when label = 1 and score >= 0.5 then 1 else 0 end) as tp, sum(case when label = 0 and score >= 0.5 then 1 else 0 end) as fp, sum(case when label = 1 and score < 0.5 then 1 else 0 end) as fn"


@query("f4_cluster_bootstrap_f1", ctes("scored", extra=f"""cl as (select station_id, {_TP} from scored group by 1),
 ix as (select *, row_number() over (order by station_id) - 1 as idx, count(*) over () as g from cl),
 pk as (select b, cast(floor({sql_draw_fine("md5(cast(b as varchar) || '|' || cast(idx as varchar) || '|42')")} * g) as bigint) as p from ix, range(0, {_B}) r(b)),
 dr as (select b, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from pk join ix on ix.idx = pk.p group by 1),
 mt as (select 2e0 * tp / (2 * tp + fp + fn) as m from dr where 2 * tp + fp + fn > 0)""")
       + f"select (select {m6('2e0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))')} from cl) as estimate, {m6('quantile_cont(m, 0.025)')} as ci_lo, {m6('quantile_cont(m, 0.975)')} as ci_hi, {m6('avg(case when m >= 0.5 then 1e0 else 0e0 end)')} as p_gate, count(*) as n_valid from mt")
def _(t):
    """F1 interval by resampling stations; counts per station are summed before any draw."""
    hit, pred = F.col("label") == 1, F.col("score") >= 0.5
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    cl = t.sql("scored").groupBy("station_id").agg(one(hit & pred).alias("tp"), one(~hit & pred).alias("fp"), one(hit & ~pred).alias("fn"))
    f1 = lambda tp, fp, fn: 2.0 * tp / F.when(2 * tp + fp + fn > 0, 2 * tp + fp + fn)
    return _round(ST.cluster_bootstrap(cl, "station_id", ["tp", "fp", "fn"], f1, _B, 42, 0.5), "estimate", "ci_lo", "ci_hi", "p_gate")


@query("f4_split_tree_bootstrap", None)
def _(t):
    """F1 interval by resampling station years, with weights drawn where the clusters are."""
    hit, pred = F.col("label") == 1, F.col("score") >= 0.5
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    cl = t.sql("scored").groupBy((F.col("station_id") * 10000 + F.col("yr")).alias("station_year")).agg(
        one(hit & pred).alias("tp"), one(~hit & pred).alias("fp"), one(hit & ~pred).alias("fn"))
    f1 = lambda tp, fp, fn: 2.0 * tp / F.when(2 * tp + fp + fn > 0, 2 * tp + fp + fn)
    return _round(ST.split_bootstrap(cl, "station_year", ["tp", "fp", "fn"], f1, 4000, 42, 0.5), "estimate", "ci_lo", "ci_hi", "p_gate")


@query("f4_paired_difference_bootstrap", ctes("scored", extra=f"""cl as (select station_id, count(*) as n, sum(abs(p50 - y)) as ea, sum(abs(p10 - y)) as eb from scored group by 1),
 ix as (select *, row_number() over (order by station_id) - 1 as idx, count(*) over () as g from cl),
 pk as (select b, cast(floor({sql_draw_fine("md5(cast(b as varchar) || '|' || cast(idx as varchar) || '|7')")} * g) as bigint) as p from ix, range(0, {_B}) r(b)),
 mt as (select (sum(ea) - sum(eb)) / sum(n) as m from pk join ix on ix.idx = pk.p group by b)""")
       + f"select (select {m6('(sum(ea) - sum(eb)) / sum(n)')} from cl) as estimate, {m6('quantile_cont(m, 0.025)')} as ci_lo, {m6('quantile_cont(m, 0.975)')} as ci_hi, {m6('avg(case when m >= 0 then 1e0 else 0e0 end)')} as p_gate, count(*) as n_valid from mt")
def _(t):
    """Same station draw on both arms: difference of mean absolute errors."""
    cl = t.sql("scored").groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("p50") - F.col("y"))).alias("ea"), F.sum(F.abs(F.col("p10") - F.col("y"))).alias("eb"))
    return _round(ST.cluster_bootstrap(cl, "station_id", ["ea", "eb", "n"], lambda a, b, n: (a - b) / n, _B, 7, 0.0), "estimate", "ci_lo", "ci_hi", "p_gate")


@query("f16_conformal_offset", ctes("scored", extra="""e as (select greatest(p10 - y, y - p90) as e from scored),
 k as (select e, row_number() over (order by e) - 1 as i, count(*) over () as n from e)""")
       + f"select max(n) as n, {m6('max(case when i = ceil(least(1e0, ceil((n + 1) * (1e0 - 0.2e0)) / n) * (n - 1) - 1e-9) then e end)')} as \"offset\" from k")
def _(t):
    return _round(ST.conformal_offset(t.sql("scored"), "y", "p10", "p90"), "offset")


_SPREAD_COLS = ("measured_sd pred_sd pi_coverage pi_width_mean mae rmse bias measured_p10 measured_p50 measured_p90 pred_p10 pred_p50 pred_p90 "
                "pi_width_median spearman spread_ratio sd_ratio").split()
_SPREAD_EXPR = dict(
    measured_sd="stddev_samp(y)", pred_sd="stddev_samp(p50)", pi_coverage="avg(case when y >= p10 and y <= p90 then 1e0 else 0e0 end)",
    pi_width_mean="avg(p90 - p10)", mae="avg(abs(p50 - y))", rmse="sqrt(avg((p50 - y) * (p50 - y)))", bias="avg(p50 - y)",
    measured_p10="quantile_cont(y, 0.1)", measured_p50="quantile_cont(y, 0.5)", measured_p90="quantile_cont(y, 0.9)",
    pred_p10="quantile_cont(p50, 0.1)", pred_p50="quantile_cont(p50, 0.5)", pred_p90="quantile_cont(p50, 0.9)",
    pi_width_median="quantile_cont(p90 - p10, 0.5)", spearman="corr(ry, rp)",
    spread_ratio="(quantile_cont(p50, 0.9) - quantile_cont(p50, 0.1)) / (quantile_cont(y, 0.9) - quantile_cont(y, 0.1))",
    sd_ratio="stddev_samp(p50) / stddev_samp(y)")


@query("f17_spread_evaluation", ctes("scored", extra=f"k as (select *, {_rank('y')} as ry, {_rank('p50')} as rp from scored)")
       + "select count(*) as n, " + ", ".join(f"{m6(_SPREAD_EXPR[c])} as {c}" for c in _SPREAD_COLS) + " from k")
def _(t):
    return _round(ST.spread_evaluation(t.sql("scored"), "y", "p10", "p50", "p90"), *_SPREAD_COLS)


@query("f18_interval_weights", ctes("scored", extra="""w as (select row_id, yr, case when row_id % 13 = 0 then -1e0 else p90 - p10 + score end as wd from scored),
 m as (select *, case when wd > 0 then wd else (select quantile_cont(wd, 0.5) from w where wd > 0) end as w2 from w),
 x as (select *, 1e0 / greatest(w2, 1e-3) as w3 from m), q as (select quantile_cont(w3, 0.05) as lo, quantile_cont(w3, 0.95) as hi from x)""")
       + f"select row_id, {m6('least(greatest(w3, lo), hi) * case when yr = 1995 then 0.5e0 else 1e0 end * case when row_id % 50 = 0 then 3e0 else 1e0 end')} as weight from x, q")
def _(t):
    s = t.sql("scored").select("row_id", F.lit(0.0).alias("lower"), F.when(F.col("row_id") % 13 == 0, -1.0).otherwise(
        F.col("p90") - F.col("p10") + F.col("score")).alias("upper"), (F.col("yr") == 1995).alias("is_summary"), (F.col("row_id") % 50 == 0).alias("is_feedback"))
    w = ST.interval_weights(s, "lower", "upper", factors={"is_summary": 0.5, "is_feedback": 3.0})
    return w.select("row_id", micro(F.col("weight")).alias("weight"))


# ---- D: distributions and panels -----------------------------------------------------------------------
@query("d11_distribution_summary", "select l_returnflag as flag, count(*) as n, " + ", ".join(
    f"{m6(f'quantile_cont(l_extendedprice, {p / 100})')} as p{p}" for p in (5, 25, 50, 75, 95))
    + f", {m6('avg(l_extendedprice)')} as mean, {m6('stddev_samp(l_extendedprice)')} as sd, min(l_extendedprice) as min, max(l_extendedprice) as max from lineitem group by 1")
def _(t):
    s = ST.distribution_summary(t.read("lineitem").withColumnRenamed("l_returnflag", "flag"), "l_extendedprice", ["flag"])
    return _round(s, "p5", "p25", "p50", "p75", "p95", "mean", "sd")


@query("d12_area_risk_p90", ctes("arrays") + """select block, max(case when i = least(n - 1, cast(floor(n * 0.9e0) as bigint)) then risk_score end) as risk_p90, max(n) as n
from (select *, row_number() over (partition by block order by risk_score) - 1 as i, count(*) over (partition by block) as n from (select *, cast(floor(array_id / 1000e0) as bigint) as block from arrays)) group by 1""")
def _(t):
    a = t.sql("arrays").withColumn("block", F.floor(F.col("array_id") / 1000.0))
    return R.exact_quantiles(a, ["block"], "risk_score", {"risk_p90": 0.9}, method="ceiling_rank")


@query("d13_gini", "with v as (select greatest(0e0, c_acctbal) as v from customer), k as (select v, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2e0 as rk, count(*) over () as n from v) "
       + f"select {m6('sum((2 * rk - n - 1) * v) / (max(n) * sum(v))')} as gini from k")
def _(t):
    from dustledger.operators.economics import value_concentration

    return value_concentration(t.read("customer"), "c_custkey", "c_acctbal").select(micro(F.col("gini")).alias("gini"))


_KM = "scored_km as (select *, (row_id * 7 % 1200) + 0e0 as km from scored)"
_EDGES = (0, 25, 50, 100, 200, 400)


@query("d14_distance_bands", ctes("scored", extra=_KM + ", e(lo_km, hi_km) as (values " + ", ".join(f"({a}e0, {b}e0)" for a, b in zip(_EDGES[:-1], _EDGES[1:])) + ")")
       + f"select lo_km, hi_km, count(*) as n, {m6('avg(y)')} as mean, {m6('quantile_cont(y, 0.1)')} as p10, {m6('quantile_cont(y, 0.5)')} as median, {m6('quantile_cont(y, 0.9)')} as p90, {m6('5.53e0 / quantile_cont(y, 0.5)')} as reference_over_median from scored_km join e on km >= lo_km and km < hi_km group by 1, 2")
def _(t):
    s = t.sql("scored").withColumn("km", (F.col("row_id") * 7 % 1200).cast("double"))
    return _round(ST.band_summary(s, "km", "y", _EDGES, 5.53), "mean", "p10", "median", "p90", "reference_over_median")


@query("d14_radius_summary", ctes("scored", extra=_KM + ", e(radius_km) as (values (100e0), (150e0), (200e0), (300e0), (500e0), (1000e0))")
       + f"select radius_km, count(*) as n, count(distinct station_id) as n_stations, {m6('quantile_cont(y, 0.5)')} as p50 from scored_km join e on km <= radius_km group by 1")
def _(t):
    s = t.sql("scored").withColumn("km", (F.col("row_id") * 7 % 1200).cast("double"))
    return _round(ST.radius_summary(s, "km", "y", "station_id", (100, 150, 200, 300, 500, 1000)), "p50")


_MR = "m as (select cty, quantile_cont(case when instrument = 'A' then y end, 0.5) as p50_a, quantile_cont(case when instrument = 'B' then y end, 0.5) as p50_b from (select *, (station_id * 7) % 39 as cty from scored) group by 1)"


@query("d15_matched_group_ratio", ctes("scored", extra=_MR) + f"select cty, {m6('p50_a')} as p50_a, {m6('p50_b')} as p50_b, {m6('p50_a / p50_b')} as ratio from m where p50_a is not null and p50_b is not null")
def _(t):
    s = t.sql("scored").withColumn("cty", F.col("station_id") * 7 % 39)
    return _round(ST.matched_ratio(s, "cty", "instrument", "A", "B", "y"), "p50_a", "p50_b", "ratio")


@query("d15_median_of_ratios", ctes("scored", extra=_MR) + f"select count(*) as n_groups, {m6('quantile_cont(p50_a / p50_b, 0.5)')} as median_ratio, cast(sum(case when p50_a < p50_b then 1 else 0 end) as bigint) as n_below from m where p50_a is not null and p50_b is not null")
def _(t):
    s = t.sql("scored").withColumn("cty", F.col("station_id") * 7 % 39)
    m = ST.matched_ratio(s, "cty", "instrument", "A", "B", "y")
    q = R.exact_quantiles(m, [], "ratio", {"median_ratio": 0.5}).withColumnRenamed("n", "n_groups")
    below = m.agg(F.sum(F.when(F.col("ratio") < 1, 1).otherwise(0)).alias("n_below"))
    return _round(R.attach_row(q, below), "median_ratio")


@query("d16_within_group_spread", ctes("scored") + f"""select station_id, count(*) as n, {m6('stddev_samp(y)')} as value_sd, min(y) as value_min, max(y) as value_max,
 {m6('quantile_cont(y, 0.5)')} as value_p50, {m6('quantile_cont(p90 - p10 + score, 0.5)')} as width_p50, {m6('stddev_samp(y) / quantile_cont(p90 - p10 + score, 0.5)')} as spread_to_noise from scored group by 1 having count(*) >= 3""")
def _(t):
    s = t.sql("scored").withColumn("w", F.col("p90") - F.col("p10") + F.col("score"))
    return _round(ST.group_spread(s, "station_id", "y", "w"), "value_sd", "value_p50", "width_p50", "spread_to_noise")


@query("d16_variance_split", ctes("scored", extra="g as (select y, y - avg(y) over (partition by station_id) as d from scored)")
       + f"select count(*) as n, {m6('var_samp(y)')} as total_var, {m6('var_samp(d)')} as within_var, {m6('var_samp(d) / var_samp(y)')} as within_share from g")
def _(t):
    return _round(ST.variance_split(t.sql("scored"), "station_id", "y"), "total_var", "within_var", "within_share")


_ARMS = ("a0b0", "a0b1", "a1b0", "a1b1")
_ARM_SQL = "case row_id % 5 when 0 then 'a0b0' when 1 then 'a0b1' when 2 then 'a1b0' when 3 then 'a1b1' end"


@query("d17_paired_arm_contrasts", ctes("scored", extra="w as (select station_id, yr, " + ", ".join(
    f"max(case when arm = '{a}' then y end) as v{i}" for i, a in enumerate(_ARMS)) + f""" from (select *, {_ARM_SQL} as arm from scored) group by 1, 2),
 c as (select *, v0 - v2 as a, v0 - v1 as b, v0 - v3 as d1, v1 - v2 as d2, (v0 + v1 + v2 + v3) / 4e0 as m from w where v0 is not null and v1 is not null and v2 is not null and v3 is not null)""")
       + "select count(*) as n_units, " + ", ".join(f"{m6(f'avg({c})')} as mean_{n}, {m6(f'stddev_samp({c})')} as sd_{n}" for n, c in (("a", "a"), ("b", "b"), ("1", "d1"), ("2", "d2")))
       + f", {m6('sqrt(avg((power(v0 - m, 2) + power(v1 - m, 2) + power(v2 - m, 2) + power(v3 - m, 2)) / 3e0))')} as per_label_sigma, {m6('sqrt((var_samp(d1) + var_samp(d2)) / 2e0)')} as sd_total from c")
def _(t):
    s = t.sql("scored").withColumns({"arm": F.expr(_ARM_SQL), "unit": F.col("station_id") * 10000 + F.col("yr")})
    out = ST.arm_contrasts(s, "unit", "arm", "y", _ARMS)
    return _round(out, *[c for c in out.columns if c != "n_units"])


@query("d18_group_slopes", ctes("scored") + f"select station_id, count(*) as n, {m6('regr_slope(y, yr)')} as slope from scored group by 1 having count(distinct yr) >= 3")
def _(t):
    return _round(ST.group_slopes(t.sql("scored"), "station_id", "yr", "y"), "slope")


@query("d18_fixed_effects_slope", ctes("scored", extra="""d as (select station_id, yr - avg(yr) over (partition by station_id) as x, y - avg(y) over (partition by station_id) as v from scored),
 b as (select sum(x * v) / sum(x * x) as beta, sum(x * x) as xx, count(*) as n, count(distinct station_id) as k from d),
 s as (select any_value(n) as n, any_value(k) as k, any_value(beta) as beta, sqrt(sum(power(v - beta * x, 2)) / greatest(1, any_value(n) - any_value(k) - 1) / any_value(xx)) as se from d, b)""")
       + f"select n, k as n_groups, {m6('beta')} as slope, {m6('se')} as se, {m6('beta - 1.96e0 * se')} as ci_lo, {m6('beta + 1.96e0 * se')} as ci_hi from s")
def _(t):
    return _round(ST.fixed_effects_slope(t.sql("scored"), "station_id", "yr", "y"), "slope", "se", "ci_lo", "ci_hi")


@query("b28_wilson_interval", ctes("scored", extra="k as (select county, count(*) as n, sum(label) as k from scored group by 1), p as (select *, k * 1e0 / n as p from k)")
       + f"""select county, n, cast(k as bigint) as k, {m6('greatest(0e0, (p + 3.8416e0 / (2e0 * n)) / (1e0 + 3.8416e0 / n) - 1.96e0 * sqrt(p * (1e0 - p) / n + 3.8416e0 / (4e0 * n * n)) / (1e0 + 3.8416e0 / n))')} as lo,
 {m6('least(1e0, (p + 3.8416e0 / (2e0 * n)) / (1e0 + 3.8416e0 / n) + 1.96e0 * sqrt(p * (1e0 - p) / n + 3.8416e0 / (4e0 * n * n)) / (1e0 + 3.8416e0 / n))')} as hi from p""")
def _(t):
    g = t.sql("scored").groupBy("county").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("k"))
    lo, hi = wilson_interval(F.col("k"), F.col("n"))
    return g.select("county", "n", "k", micro(lo).alias("lo"), micro(hi).alias("hi"))


@query("f1_top_fraction_flag", ctes("arrays") + """select array_id, row_number() over (order by risk_score desc, array_id) as rank,
 row_number() over (order by risk_score desc, array_id) <= ceil(0.1e0 * count(*) over ()) as top_fraction from arrays""")
def _(t):
    return R.flag_top_fraction(t.sql("arrays"), "risk_score", "array_id").select("array_id", "rank", "top_fraction")
