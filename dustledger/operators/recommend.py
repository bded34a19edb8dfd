"""Area and per-array recommendations, site economics, persistent screen fields, target lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dustledger import constants as K
from dustledger.functions import pv
from dustledger.functions.numeric import cents, half_even
from dustledger.operators import economics as EC
from dustledger.operators.ranks import attach_row, exact_quantiles
from dustledger.operators.rollup import primary_flags, site_rollup
from dustledger.operators.series import longest_dry_stretch


# ---- site economics -----------------------------------------------------------------------------------
def level_calibration(arrays: DataFrame, area: str, calibration: DataFrame, scope: str = "", scoped_factor: float = 0.5) -> DataFrame:
    """Multiply the three loss quantiles by the measured area factor, else the scoped constant, else 1.

    ``calibration`` (area, model_over_measured). Only predicted losses are scaled, never a fallback.
    """
    cal = calibration.filter("model_over_measured > 0").select(F.col(area), (1.0 / F.col("model_over_measured")).alias("_f"))
    j = arrays.join(cal, area, "left")
    factor = F.coalesce("_f", F.when(F.col(area).cast("string") == scope, F.lit(scoped_factor)), F.lit(1.0))
    j = j.withColumns({"level_factor": factor, "level_source": F.when(F.col("_f").isNotNull(), "measured").when(
        F.col(area).cast("string") == scope, "scoped_constant").otherwise("none")})
    return j.withColumns({c: F.col(c) * F.col("level_factor") for c in ("loss_pct_p10", "loss_pct_p50", "loss_pct_p90") if c in arrays.columns}).drop("_f")


def site_inputs(arrays: DataFrame, site: str, installs: DataFrame | None = None, as_of: str = "2026-01-01",
                base_sun: float = K.BASE_SUN_HOURS, rate: float | None = None) -> DataFrame:
    """One row per site with size, loss, sun hours and price, each with its source.

    Permit kW first, else area; predicted loss, else physics loss, else the base rate. With an
    install table, age degrades the sun hours and the date sets the tariff.
    """
    cols = [c for c in ("loss_pct_p10", "loss_pct_p50", "loss_pct_p90", "soiling_loss_annual_pct", "poa_rel") if c in arrays.columns]
    s = site_rollup(arrays, site, averaged=cols, permit="permit_kw" if "permit_kw" in arrays.columns else None)
    for c in ("loss_pct_p10", "loss_pct_p50", "loss_pct_p90", "soiling_loss_annual_pct", "poa_rel", "permit_kw"):
        if c not in s.columns:
            s = s.withColumn(c, F.lit(None).cast("double"))
    permit = F.when(F.col("permit_kw") > 0, F.col("permit_kw"))
    head, physics = F.col("loss_pct_p50"), F.col("soiling_loss_annual_pct")
    s = s.withColumns({
        "system_kw": F.coalesce(permit, pv.kw_from_area(F.col("site_area_m2"))),
        "system_kw_source": F.when(permit.isNotNull(), "permit").when(F.col("site_area_m2") > 0, "area_estimate"),
        "loss_pct": F.coalesce(head, physics, F.lit(K.BASE_SOILING_PCT)),
        "loss_source": F.when(head.isNotNull(), "regression_head").when(physics.isNotNull(), "physics").otherwise("base_rate_fallback"),
        "sun_hours": pv.sun_hours(F.col("poa_rel"), base_sun),
        "sun_source": F.when(F.col("poa_rel").isNotNull(), "orientation").otherwise("flat")})
    if installs is not None:
        s = s.join(installs, site, "left")
        age = pv.age_years(F.col("install_date"), F.to_date(F.lit(as_of)))
        price, source = pv.site_rate(F.col("install_date"))
        s = s.withColumns({"age_years": age, "degradation": pv.production_factor(age), "usd_per_kwh": price, "rate_source": source})
        s = s.withColumn("sun_hours", F.col("sun_hours") * F.col("degradation"))
    else:
        s = s.withColumn("usd_per_kwh", F.lit(pv.regime_rate(K.DEFAULT_REGIME) if rate is None else rate))
    return s.withColumns({"loss_p10": F.when(head.isNotNull(), F.col("loss_pct_p10")), "loss_p50": F.col("loss_pct"),
                          "loss_p90": F.when(head.isNotNull(), F.col("loss_pct_p90"))})


def site_economics(arrays: DataFrame, site: str, installs: DataFrame | None = None, n_samples: int = 2000, seed: int = 42,
                   monte_carlo: bool = True) -> DataFrame:
    """Sites with their point decision and, if asked, its Monte Carlo spread."""
    s = EC.best_strategy(site_inputs(arrays, site, installs))
    if not monte_carlo:
        return s
    return s.join(EC.monte_carlo(EC.with_default_interval(s.filter("system_kw > 0")), site, n_samples, seed), site, "left")


def attach_site_economics(arrays: DataFrame, sites: DataFrame, site: str, columns: list[str]) -> DataFrame:
    """Site values on every array and site_primary on one; an array's own area is never overwritten."""
    keep = [c for c in columns if c != "area_m2"]
    return primary_flags(arrays, site).join(sites.select(site, *keep), site, "left")


# ---- area rule ------------------------------------------------------------------------------------------
def recovery_bucket(risk: Column) -> Column:
    """Struct(name, lo, hi) of the expected recovery for a risk score."""
    out = None
    for upper, name, lo, hi in K.RECOVERY_BUCKETS:
        s = F.struct(F.lit(name).alias("name"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        if out is None:
            out = F.when(risk < upper, s)
        else:
            out = out.when(risk < upper, s) if upper is not None else out.otherwise(s)
    return out


def recommend_area(arrays: DataFrame, forecast: DataFrame, cleaned: DataFrame, area: str, today: str,
                   min_days: int = K.MIN_DAYS_SINCE_CLEAN, days: int = K.FORECAST_DAYS) -> DataFrame:
    """Per area: risk p90, the rule that fired, and the cleaning window if one is open.

    ``forecast`` (area, day_offset, rain_mm), ``cleaned`` (area, last_cleaned).
    """
    risk = exact_quantiles(arrays, [area], "risk_score", {"area_risk": 0.9}, method="ceiling_rank").withColumnRenamed("n", "n_arrays")
    rain = forecast.groupBy(area).agg(F.sum("rain_mm").alias("total_rain_mm"))
    dry = longest_dry_stretch(forecast, area, K.RAIN_MM_THRESHOLD / max(days, 1))
    j = risk.join(cleaned, area).join(rain, area).join(dry, area, "left")
    now = F.to_date(F.lit(today))
    since = F.datediff(now, F.col("last_cleaned"))
    rule = (F.when(F.col("area_risk") < K.RISK_THRESHOLD, "below_risk_threshold").when(since < min_days, "below_age_threshold")
            .when(F.col("total_rain_mm") >= K.RAIN_MM_THRESHOLD, "deferred_due_to_rain").otherwise("weather_window_open"))
    opens = F.col("rule_fired") == "weather_window_open"
    j = j.withColumns({"days_since_clean": since, "rule_fired": rule})
    end = F.when(F.col("dry_end") > 1, F.date_add(now, F.col("dry_end").cast("int"))).otherwise(F.date_add(now, days))
    b = recovery_bucket(F.col("area_risk"))
    return j.select(area, "n_arrays", "area_risk", "days_since_clean", "total_rain_mm", "rule_fired",
                    F.when(opens, F.date_add(now, 1)).alias("window_start"), F.when(opens, end).alias("window_end"),
                    b["name"].alias("confidence"), b["lo"].alias("recovery_lo"), b["hi"].alias("recovery_hi"))


# ---- per array ---------------------------------------------------------------------------------------------
def cleaning_method(risk: Column, tilt: Column, agriculture: Column, highway: Column, kw: Column) -> tuple[Column, Column]:
    """('diy'/'professional', reasons joined by '; ' in fixed order)."""
    one_dp = F.format_string("%.1f", half_even(kw, 1))
    why = F.concat_ws(
        "; ", F.when(tilt <= K.LOW_TILT_DEG, F.lit("low tilt")), F.when(agriculture < K.NEAR_AGRICULTURE_M, F.lit("near agricultural fields")),
        F.when(highway < K.NEAR_HIGHWAY_M, F.lit("near highway")),
        F.when(kw >= K.LARGE_SYSTEM_KW, F.concat(F.lit("large system ("), one_dp, F.lit(" kW)"))),
        F.when(risk >= 0.75, F.lit("high soiling risk score")))
    return F.when(why != "", "professional").otherwise("diy"), F.when(why != "", why).otherwise("typical residential")


def persistent_fields(arrays: DataFrame, screen: DataFrame, key: str) -> DataFrame:
    """Screen status and conditional dollars of each array's own group; missing is never 'low'."""
    cols = ["persistent_soiling_score", "persistent_soiling_rank", "persistent_soiling_top_decile"]
    j = arrays.join(screen.select(key, *cols), key, "left")
    seen, top = F.col("persistent_soiling_score").isNotNull(), F.coalesce("persistent_soiling_top_decile", F.lit(False))
    kw = pv.kw_from_area(F.col("area_m2"))
    hours = F.coalesce(F.when(F.col("sun_hours") > 0, F.col("sun_hours")), F.lit(K.BASE_SUN_HOURS))
    price = F.coalesce(F.when(F.col("usd_per_kwh") > 0, F.col("usd_per_kwh")), F.lit(pv.blended_rate()))
    year = cents(pv.annual_loss_usd(kw, hours, F.lit(K.PERSISTENT_LOSS_PCT / 100.0), price))
    show = top & kw.isNotNull()
    return j.withColumns({
        "persistent_status": F.when(~seen, "not_assessed").when(top, "inspection_candidate").otherwise("not_flagged"),
        "persistent_action": F.when(seen & top, "inspect").otherwise("none"),
        "persistent_group_kw": F.when(show, half_even(kw, 2)), "persistent_usd_at_risk": F.when(show, year),
        "persistent_usd_at_risk_2y": F.when(show, cents(year * K.PERSISTENT_HORIZON_YEARS))})


def recommend_arrays(arrays: DataFrame, area_rule: DataFrame, area: str, risk_threshold: float = K.RISK_THRESHOLD) -> DataFrame:
    """Action, priority, method and reasons per array.

    Clean only with an open window, enough risk, and economics that do not say no. ``arrays`` carry
    their site's system_kw, expected_net_usd and worth_cleaning.
    """
    j = arrays.join(area_rule.select(area, "rule_fired", "window_start", "window_end"), area, "left")
    score = F.coalesce("risk_score", F.lit(0.0))
    opened = F.coalesce((F.col("rule_fired") == "weather_window_open") & F.col("window_start").isNotNull(), F.lit(False))
    due = opened & (score >= risk_threshold)
    blocked = F.coalesce(~F.col("worth_cleaning"), F.lit(False))
    method, why = cleaning_method(score, F.col("tilt_deg"), F.col("distance_to_agriculture_m"), F.col("distance_to_highway_m"),
                                  F.coalesce("system_kw", pv.kw_from_area(F.col("area_m2"))))
    b = recovery_bucket(score)
    reason = (F.when(~opened, "weather window closed").when(~due, "risk below threshold").when(blocked, "no strategy clears $0")
              .otherwise("window open, risk above threshold, net positive"))
    clean = due & ~blocked
    return j.withColumns({
        "action": F.when(clean, "clean").otherwise("monitor"), "action_reason": reason,
        "action_source": F.when(clean, "risk_rule+economics").when(due, "economics").otherwise("risk_rule"),
        "priority": F.when(~due, F.when(score < 0.5, "low").otherwise("medium")).when(blocked, "low").when(score >= 0.75, "high").otherwise("medium"),
        "cleaning_window": F.when(clean, F.concat_ws(" to ", F.col("window_start").cast("string"), F.col("window_end").cast("string"))),
        "cleaning_method": method, "method_reasons": why, "recovery_lo": F.when(clean, b["lo"]), "recovery_hi": F.when(clean, b["hi"]),
        "risk_rounded": half_even(score, 3)})


# ---- target lists --------------------------------------------------------------------------------------------
def select_targets(arrays: DataFrame, top: int, min_kw: float | None = None, max_kw: float | None = None, id_col: str = "array_id") -> DataFrame:
    """Top-N by net dollars then score among actionable arrays; all arrays when too few are actionable."""
    d = arrays
    if min_kw is not None:
        d = d.filter(F.coalesce("system_kw", F.lit(0.0)) >= min_kw)
    if max_kw is not None:
        d = d.filter(F.coalesce("system_kw", F.lit(1e9)) <= max_kw)
    score = half_even(0.6 * F.col("risk_score") + 0.4 * F.coalesce("confidence", F.lit(0.5)), 4)
    d = d.withColumns({"outreach_score": score, "actionable": F.coalesce((F.col("action") == "clean") | (F.col("risk_score") >= 0.5), F.lit(False))})
    n = d.agg(F.sum(F.col("actionable").cast("int")).alias("_n"))
    d = attach_row(d, n).filter((F.coalesce("_n", F.lit(0)) < top) | F.col("actionable")).drop("_n")
    return d.orderBy(F.desc("expected_net_usd"), F.desc("outreach_score"), id_col).limit(top)


# ---- publishing ------------------------------------------------------------------------------------------------
def publish_layer(arrays: DataFrame, recommendations: DataFrame, screen: DataFrame, key: str, salt: str) -> DataFrame:
    """(key, site_key, properties JSON without nulls): fresh screen over recommendation, recommendation over older values."""
    from dustledger.functions.text import site_key

    older = ("system_kw", "expected_net_usd", "economic_action")
    r = recommendations.select(key, *[F.col(c).alias(f"_r_{c}") for c in (*older, "persistent_soiling_score")])
    s = screen.select(key, F.col("persistent_soiling_score").alias("_s_score"), F.col("persistent_soiling_top_decile").alias("_s_top"))
    j = arrays.join(r, key, "left").join(s, key, "left")
    counts = arrays.groupBy("site_id").agg(F.count(F.lit(1)).alias("site_array_count"))
    j = j.join(counts, "site_id", "left").withColumn("site_key", site_key(F.col("site_id"), salt))
    first = lambda c: F.coalesce(F.col(f"_r_{c}"), F.col(c))
    props = F.to_json(F.struct(
        F.col(key), half_even(F.col("risk_score"), 4).alias("risk_score"), half_even(F.col("area_m2"), 1).alias("area_m2"),
        half_even(first("system_kw"), 4).alias("site_kw"), half_even(first("expected_net_usd"), 4).alias("site_expected_net_usd"),
        first("economic_action").alias("site_economic_action"),
        half_even(F.coalesce("_s_score", "_r_persistent_soiling_score"), 4).alias("persistent_soiling_score"),
        F.when(F.col("_s_top"), "inspect").when(F.col("_s_top").isNotNull(), "none").alias("persistent_soiling_inspection_action"),
        "site_key", F.when(F.col("site_key").isNotNull(), F.col("site_array_count")).alias("site_array_count")))
    return j.select(key, "site_key", props.alias("properties"))


def redacted_points(arrays: DataFrame, key: str) -> DataFrame:
    """Public point layer: prefixed id, score, kW and a 6-decimal point, nothing else."""
    return arrays.filter("risk_score IS NOT NULL").select(
        F.concat(F.lit("permit-"), F.col(key)).alias("array_id"), half_even(F.col("risk_score"), 4).alias("score"),
        half_even(F.col("system_kw"), 2).alias("system_kw"), half_even(F.col("lon"), 6).alias("lon"), half_even(F.col("lat"), 6).alias("lat"))


def grouping_drift(frozen: DataFrame, current: DataFrame, key: str, site: str) -> DataFrame:
    """Arrays whose site changed, appeared or vanished; empty when a rebuild may be published."""
    a, b = frozen.select(key, F.col(site).alias("_a")), current.select(key, F.col(site).alias("_b"))
    return a.join(b, key, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, F.col("_a").alias("frozen_site"), F.col("_b").alias("current_site"))


def recovery_pct(post: Column, pre: Column) -> Column:
    """Measured gain of a clean in percent, two decimals; null without a baseline."""
    return half_even((post - pre) / F.when(pre != 0, pre) * 100.0, 2)
