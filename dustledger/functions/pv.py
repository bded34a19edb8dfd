"""Scalar PV, soiling, tariff and cost expressions (Column in, Column out)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from dustledger import constants as K
from dustledger.functions.numeric import clip, half_even, piecewise_linear

# Fixed value: production-weighted retail rate, the result of operators.solar_tables
# .production_shares at the default site dotted with TOU_USD_PER_KWH (pinned by a test).
RETAIL_USD_PER_KWH = 0.4573372516409828


# ---- age, vintage, architecture -----------------------------------------------------------------
def age_years(install: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), F.datediff(as_of, install) / 365.25) * F.when(install.isNotNull(), 1.0)


def production_factor(age: Column, pct_per_year: float = K.DEGRADATION_PCT_PER_YR) -> Column:
    """Share of nameplate output left; unknown age is never aged."""
    left = F.pow(F.lit(1.0 - pct_per_year / 100.0), F.greatest(F.lit(0.0), age))
    return F.when(age.isNull(), F.lit(1.0)).otherwise(left)


def module_w_per_m2(year: Column) -> Column:
    return piecewise_linear(year.cast("double"), K.VINTAGE_YEARS, K.VINTAGE_W_PER_M2)


def inverter_architecture(year: Column) -> Column:
    return (F.when(year >= 2019, "mlpe").when(year >= 2017, "transitional")
            .when(year.isNotNull(), "mixed_pre2017").otherwise("unknown"))


def tariff_regime(install: Column) -> Column:
    """Tariff in force at the install date; null when unknown."""
    return (F.when(install >= F.to_date(F.lit(K.NBT_START_DATE)), "nbt_no_battery")
            .when(install.isNotNull(), "nem2_legacy"))


def vintage_class(install: Column) -> Column:
    return (F.when(install < F.to_date(F.lit(K.NEM1_CLOSE_DATE)), "nem1")
            .when(install < F.to_date(F.lit(K.NBT_START_DATE)), "nem2")
            .when(install.isNotNull(), "nbt").otherwise("unknown"))


def vintage_ambiguous(install: Column, days: int = 120) -> Column:
    """True within ``days`` of either tariff cliff."""
    gap = F.least(*[F.abs(F.datediff(install, F.to_date(F.lit(d))))
                    for d in (K.NEM1_CLOSE_DATE, K.NBT_START_DATE)])
    return gap < days


def lidar_era(install: Column) -> Column:
    """Install against the lidar flight, which is only known to lie within 2020."""
    return (F.when(install < F.to_date(F.lit("2020-01-01")), "pre_flight")
            .when(install <= F.to_date(F.lit("2021-01-01")), "ambiguous")
            .when(install.isNotNull(), "post_flight").otherwise("unknown"))


def roof_geometry_meaning(install: Column) -> Column:
    era = lidar_era(install)
    return (F.when(era == "pre_flight", "racking_angle").when(era == "post_flight", "roof_pitch")
            .otherwise("indeterminate"))


def shade_factor(canopy: Column, tilt: Column, azimuth: Column) -> Column:
    """1 = average roof; canopy, low tilt and north aspect keep a roof wet longer."""
    return (1.0 + 0.60 * clip(canopy, 0.0, 1.0) + 0.25 * clip((35.0 - tilt) / 35.0, 0.0, 1.0)
            + 0.15 * clip(F.abs(azimuth - 180.0) / 180.0, 0.0, 1.0))


# ---- tilt, canopy, persistent screen ----------------------------------------------------------------
def _cano(tilt: Column) -> Column:
    t = F.greatest(F.lit(K.TILT_CLAMP_DEG[0]), F.least(F.lit(K.TILT_CLAMP_DEG[1]), tilt))
    return K.CANO_ASYMPTOTE + (1.0 - K.CANO_ASYMPTOTE) * F.exp(-t / K.CANO_SCALE_DEG)


def tilt_soiling_factor(tilt: Column) -> Column:
    """Soiling multiplier against a 20-degree roof; unknown tilt gives 1."""
    ratio = _cano(tilt) / _cano(F.lit(K.REFERENCE_TILT_DEG))
    return F.when(tilt.isNull(), F.lit(1.0)).otherwise(ratio)


def low_tilt_score(tilt: Column) -> Column:
    flat, steep = _cano(F.lit(0.0)), _cano(F.lit(K.TILT_ZERO_SCORE_DEG))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_cano(tilt) - steep) / (flat - steep)))
    return F.when(tilt.isNull(), F.lit(0.0)).otherwise(score)


def canopy_score(fraction: Column, nearest_m: Column, radius_m: float = K.CANOPY_RADIUS_M) -> Column:
    share = F.coalesce(clip(fraction, 0.0, 1.0), F.lit(0.0))
    near = F.coalesce(clip(1.0 - nearest_m / radius_m, 0.0, 1.0), F.lit(0.0))
    return F.greatest(share, near)


def persistent_score(tilt: Column, fraction: Column, nearest_m: Column,
                     tilt_weight: float = K.TILT_WEIGHT, canopy_weight: float = K.CANOPY_WEIGHT) -> Column:
    if min(tilt_weight, canopy_weight) < 0 or abs(tilt_weight + canopy_weight - 1.0) > 1e-9:
        raise ValueError("weights must be non-negative and sum to 1")
    return tilt_weight * low_tilt_score(tilt) + canopy_weight * canopy_score(fraction, nearest_m)


# ---- size, yield, money ---------------------------------------------------------------------------------
def kw_from_area(area_m2: Column) -> Column:
    return F.when(area_m2 > 0, area_m2 / K.M2_PER_KW)


def sun_hours(poa_rel: Column, base: float | Column = K.BASE_SUN_HOURS) -> Column:
    base = base if isinstance(base, Column) else F.lit(base)
    return F.when(poa_rel > 0, base * K.POA_REF_OVER_GHI * poa_rel).otherwise(base)


def annual_loss_usd(kw, hours, loss_frac, rate, derate: float = K.SYSTEM_DERATE) -> Column:
    return kw * hours * F.lit(365.0) * F.lit(derate) * loss_frac * rate


def panels(kw: Column) -> Column:
    return F.greatest(F.lit(1.0), half_even(kw / K.PANEL_KW))


def professional_cost(kw: Column) -> Column:
    ladder = piecewise_linear(kw, K.LADDER_KW, K.LADDER_USD)
    return F.greatest(panels(kw) * ladder, F.lit(K.MIN_PROFESSIONAL_USD))


def rinse_cost(kw: Column) -> Column:
    return F.greatest(K.RINSE_COST_FACTOR * professional_cost(kw), F.lit(K.MIN_RINSE_USD))


def annual_loss_of(kw: np.ndarray, hours: np.ndarray, loss_frac: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """``annual_loss_usd`` over arrays, inside a task."""
    return kw * hours * 365.0 * K.SYSTEM_DERATE * loss_frac * rate


def professional_cost_of(kw: np.ndarray) -> np.ndarray:
    """``professional_cost`` over an array, inside a task."""
    return np.fmax(np.fmax(1.0, np.rint(kw / K.PANEL_KW)) * np.interp(kw, K.LADDER_KW, K.LADDER_USD), K.MIN_PROFESSIONAL_USD)


def marginal_value(sigma: Column, retail: float = RETAIL_USD_PER_KWH,
                   export: float = K.EXPORT_USD_PER_KWH) -> Column:
    s = clip(sigma, 0.0, 1.0)
    return s * retail + (1.0 - s) * export


def regime_rate(regime: str, which: int = 0, retail: float = RETAIL_USD_PER_KWH) -> float:
    """Value of one lost kWh in a regime; which = 0 central, 1 low, 2 high."""
    sigma = K.REGIMES[regime][which]
    return sigma * retail + (1.0 - sigma) * K.EXPORT_USD_PER_KWH


def blended_rate() -> float:
    return sum(w * regime_rate(r) for r, w in K.TARIFF_MIX.items())


def site_rate(install: Column) -> tuple[Column, Column]:
    """(value of a lost kWh, provenance); unknown dates get the measured tariff mix."""
    regime = tariff_regime(install)
    rate = F.lit(blended_rate())
    for name in ("nem2_legacy", "nbt_no_battery"):
        rate = F.when(regime == name, F.lit(regime_rate(name))).otherwise(rate)
    source = F.when(regime.isNull(), F.lit("population_mix")).otherwise(
        F.concat(F.lit("install_date:"), regime))
    return rate, source


# ---- band and biological channels -----------------------------------------------------------------------------
def band_loss_pct(cover: Column, case: str, n_modules: int = 4, array_modules: int = 20) -> Column:
    base = piecewise_linear(clip(cover, 0.0, 1.0), K.BAND_LOSS_F, K.BAND_LOSS_PCT[case])
    cap = 100.0 * n_modules / array_modules if "mlpe" in case else 100.0
    return clip(base * (n_modules / 4.0), 0.0, cap)


def roof_equilibrium(shade: Column, f_sat: float = K.BAND_F_SAT) -> Column:
    grown = f_sat * (1.0 - F.exp(-K.BIO_SHADE_RATE * (shade - K.BIO_SHADE_FLOOR)))
    return F.when(shade <= K.BIO_SHADE_FLOOR, F.lit(0.0)).otherwise(grown)


def climate_zone(lat: Column, lon: Column) -> Column:
    return (F.when(lon < -120, "coastal")
            .when((lon > -116) | ((lat < 34.5) & (lon > -117.5)), "desert")
            .when(lat.isNotNull() & lon.isNotNull(), "valley"))
