"""Cleaning decision for a table of requests: resolve inputs with provenance, then decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dustledger import constants as K
from dustledger.functions import pv
from dustledger.functions.numeric import half_even
from dustledger.operators import economics as EC

REQUEST_COLUMNS = ("system_kw", "area_m2", "loss_pct", "loss_pct_p10", "loss_pct_p90", "sun_hours", "elec_rate", "regime",
                   "install_date", "recovery_basis", "recovery_frac")


def resolve_requests(requests: DataFrame) -> DataFrame:
    """Add resolved inputs, where each came from, and error_reason (null = usable).

    The first failing rule names the error. Inputs that exclude each other are errors, defaults are
    marked as such.
    """
    c = {n: F.col(n) for n in REQUEST_COLUMNS}
    both_size = c["system_kw"].isNotNull() & c["area_m2"].isNotNull()
    priced = c["regime"].isNotNull() | c["install_date"].isNotNull()
    basis = F.coalesce(c["recovery_basis"], F.lit("measured"))
    loss = F.coalesce(c["loss_pct"], F.lit(K.BASE_SOILING_PCT))
    lo, hi = c["loss_pct_p10"], c["loss_pct_p90"]
    error = (F.when(both_size, "system_kw and area_m2 exclude each other")
             .when(c["system_kw"] <= 0, "system_kw must be > 0").when(c["area_m2"] <= 0, "area_m2 must be > 0")
             .when(c["system_kw"].isNull() & c["area_m2"].isNull(), "system_kw or area_m2 is required")
             .when(c["elec_rate"].isNotNull() & priced, "elec_rate excludes regime and install_date")
             .when(c["elec_rate"] <= 0, "elec_rate must be > 0")
             .when(c["elec_rate"].isNull() & c["install_date"].isNull() & c["regime"].isNotNull() & ~c["regime"].isin(*K.REGIMES), "unknown regime")
             .when(c["loss_pct"] < 0, "loss_pct must be >= 0")
             .when(lo.isNull() != hi.isNull(), "loss_pct_p10 and loss_pct_p90 come together")
             .when(lo.isNotNull() & ~((lo <= loss) & (loss <= hi)), "need loss_pct_p10 <= loss_pct <= loss_pct_p90")
             .when(c["sun_hours"] <= 0, "sun_hours must be > 0")
             .when(~basis.isin(*K.RECOVERY), "unknown recovery_basis")
             .when((c["recovery_frac"] <= 0) | (c["recovery_frac"] > 1), "recovery_frac must be in (0, 1]"))
    date_rate, date_source = pv.site_rate(c["install_date"])
    by_date = c["install_date"].isNotNull()
    regime = F.when(c["elec_rate"].isNotNull(), F.lit(None).cast("string")).when(by_date, pv.tariff_regime(c["install_date"])).otherwise(
        F.coalesce(c["regime"], F.lit(K.DEFAULT_REGIME)))
    regime_rate = F.lit(None).cast("double")
    for name in K.REGIMES:
        regime_rate = F.when(F.col("r_regime") == name, F.lit(pv.regime_rate(name))).otherwise(regime_rate)
    rinse, pro = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, pair in K.RECOVERY.items():
        rinse = F.when(basis == name, F.lit(pair["rinse_service"])).otherwise(rinse)
        pro = F.when(basis == name, F.lit(pair["professional"])).otherwise(pro)
    own = c["recovery_frac"].isNotNull()
    out = requests.withColumns({"error_reason": error, "r_regime": regime})
    return out.withColumns({
        "r_kw": F.coalesce(c["system_kw"], pv.kw_from_area(c["area_m2"])),
        "kw_source": F.when(c["system_kw"].isNotNull(), "caller").otherwise("area_m2"),
        "r_rate": F.when(c["elec_rate"].isNotNull(), c["elec_rate"]).when(by_date, date_rate).otherwise(regime_rate),
        "rate_source": F.when(c["elec_rate"].isNotNull(), "caller").when(by_date, date_source).otherwise(
            F.concat(F.lit("regime:"), F.col("r_regime"), F.when(c["regime"].isNull(), " (default)").otherwise(""))),
        "r_loss": loss, "loss_source": F.when(c["loss_pct"].isNull(), "default").otherwise("caller"),
        "r_sun": F.coalesce(c["sun_hours"], F.lit(K.BASE_SUN_HOURS)), "sun_source": F.when(c["sun_hours"].isNull(), "default").otherwise("caller"),
        "r_basis": basis, "rec_pro": F.when(own, c["recovery_frac"]).otherwise(pro),
        "rec_rinse": F.when(own, c["recovery_frac"] * K.RINSE_OVER_PRO_EFFICACY).otherwise(rinse),
        "recovery_source": F.when(own, "caller").otherwise(basis)})


def _bands(regime: Column, which: int) -> Column:
    out = F.lit(pv.regime_rate(K.DEFAULT_REGIME, which))
    for name in K.REGIMES:
        out = F.when(regime == name, F.lit(pv.regime_rate(name, which))).otherwise(out)
    return out


def decide(requests: DataFrame, key: str, n_samples: int = 2000, seed: int = 42) -> DataFrame:
    """One payload row per request: verdict, dollars, thresholds, uncertainty and inputs as structs.

    A request with an error keeps its row with the reason and null results.
    """
    r = resolve_requests(requests)
    ok = r.filter("error_reason IS NULL").select(
        key, F.col("r_kw").alias("system_kw"), F.col("r_loss").alias("loss_pct"), F.col("r_sun").alias("sun_hours"),
        F.col("r_rate").alias("usd_per_kwh"), "rec_rinse", "rec_pro", F.col("r_regime").alias("regime_used"), "loss_pct_p10", "loss_pct_p90",
        "kw_source", "rate_source", "loss_source", "sun_source", "recovery_source")
    point = EC.best_strategy(ok, recovery=(F.col("rec_rinse"), F.col("rec_pro")))
    mc_in = point.withColumns({
        "loss_p50": F.col("loss_pct"), "loss_p10": F.coalesce("loss_pct_p10", F.col("loss_pct") * K.LOSS_P10_OVER_P50),
        "loss_p90": F.coalesce("loss_pct_p90", F.col("loss_pct") * K.LOSS_P90_OVER_P50),
        "rate_lo": F.least(_bands(F.col("regime_used"), 1), _bands(F.col("regime_used"), 2)),
        "rate_hi": F.greatest(_bands(F.col("regime_used"), 1), _bands(F.col("regime_used"), 2))})
    mc = EC.monte_carlo(mc_in, key, n_samples, seed)
    kw, sun, loss, rate = (F.col(c) for c in ("system_kw", "sun_hours", "loss_pct", "usd_per_kwh"))
    limits = {}
    for name, rec in (("rinse_service", F.col("rec_rinse")), ("professional", F.col("rec_pro"))):
        limits[f"{name}_tariff"] = EC.breakeven_tariff(kw, sun, loss, rate, rec, name)
        limits[f"{name}_loss_pct"] = EC.breakeven_loss_pct(kw, sun, rate, rec, name)
        size = EC.breakeven_system_kw(point, key, name, rec).withColumnRenamed("breakeven_kw", f"{name}_kw")
        point = point.join(size, key)
    point = point.withColumns(limits).join(mc, key)
    best_first = F.col("rinse_net_usd") >= F.col("pro_net_usd")
    out = point.select(
        key, F.col("recommended_action").alias("verdict"), "worth_cleaning", "annual_loss_usd",
        F.when(best_first, "rinse_service").otherwise("professional").alias("best_action"), F.greatest("rinse_net_usd", "pro_net_usd").alias("best_action_net_usd"),
        F.struct(*[f"{a}_{m}" for a in ("rinse_service", "professional") for m in ("tariff", "kw", "loss_pct")]).alias("thresholds"),
        F.struct("prob_net_positive", "prob_any_action_positive", "decision_robust", "expected_net_usd_p10", "expected_net_usd_p50", "expected_net_usd_p90").alias("uncertainty"),
        F.struct(half_even(kw, 3).alias("system_kw"), "loss_pct", "sun_hours", half_even(rate, 4).alias("usd_per_kwh")).alias("inputs"),
        F.struct("kw_source", "rate_source", "loss_source", "sun_source", "recovery_source").alias("provenance"))
    return r.select(key, "error_reason").join(out, key, "left")
