"""Published physics, tariff and price constants that results must agree on."""

# --- fixed values: equivalent-day soiling model -------------------------------------------
SOILING = {
    "sl_sat": 0.08,
    "k": 15.0,
    "heavy_rain_mm": 10.0,
    "rain_min_mm": 1.0,
    "pm10_dust_threshold": 50.0,
    "pm10_dust_scale": 0.02,
}
KIMBER_DEPOSITION_PER_PM25 = 0.0006
KIMBER_RAIN_CLEAN_MM = 1.0
KIMBER_PM25_IF_ALL_MISSING = 10.0
FEATURE_WINDOWS = (7, 30, 90)
DEW_HUMIDITY_PCT = 85.0

# --- fixed values: tilt response (Cano 2011 fit) and persistent-soiling screen ---------------
CANO_ASYMPTOTE = 0.4425
CANO_SCALE_DEG = 11.641
REFERENCE_TILT_DEG = 20.0
TILT_CLAMP_DEG = (0.0, 60.0)
TILT_ZERO_SCORE_DEG = 35.0
TILT_WEIGHT = 0.70
CANOPY_WEIGHT = 0.30
CANOPY_RADIUS_M = 9.0

# --- fixed values: degradation and module density by vintage ---------------------------------
DEGRADATION_PCT_PER_YR = 0.5
VINTAGE_YEARS = (2008, 2012, 2016, 2020, 2024, 2026)
VINTAGE_W_PER_M2 = (135.0, 150.0, 170.0, 195.0, 215.0, 220.0)

# --- fixed values: sizing, yield and cleaning price ladder ---------------------------------------
PANEL_KW = 0.44
MODULE_W_PER_M2 = 220.0
PACKING_FACTOR = 0.84
M2_PER_KW = 1000.0 / (MODULE_W_PER_M2 * PACKING_FACTOR)
SYSTEM_DERATE = 0.84
BASE_SUN_HOURS = 5.5
POA_REF_OVER_GHI = 1.1507
BASE_SOILING_PCT = 2.80
LADDER_KW = (3, 10, 20, 50, 100, 200, 500, 1000)
LADDER_USD = (8.0, 7.0, 5.5, 4.0, 3.0, 2.5, 2.0, 1.5)
MIN_PROFESSIONAL_USD = 150.0
MIN_RINSE_USD = 90.0
RINSE_COST_FACTOR = 0.50
AREA_SCALE_1SIGMA = 0.26

# --- fixed values: recovery bases (share of loss one wash returns) ---------------------------------
RECOVERY = {
    "measured": {"professional": 0.045, "rinse_service": 0.032},
    "seasonal_planning": {"professional": 0.4944 * 0.90, "rinse_service": 0.4944 * 0.70},
}
RINSE_OVER_PRO_EFFICACY = 0.70 / 0.90
LOSS_P10_OVER_P50 = 1.10 / 4.70
LOSS_P90_OVER_P50 = 9.05 / 4.70
Z90 = 1.2815515655446004

# --- fixed values: tariffs ----------------------------------------------------------------------
TOU_USD_PER_KWH = {
    "summer_peak": 0.60554,
    "summer_offpeak": 0.47320,
    "winter_peak": 0.47087,
    "winter_offpeak": 0.43860,
}
PEAK_HOURS = (16, 17, 18, 19, 20)
SUMMER_MONTHS = (6, 7, 8, 9)
EXPORT_USD_PER_KWH = 0.0392
# regime: (share of midday output used at home, low, high)
REGIMES = {
    "nem2_legacy": (1.00, 1.00, 1.00),
    "nbt_no_battery": (0.30, 0.20, 0.45),
    "nbt_battery": (0.80, 0.65, 0.95),
}
DEFAULT_REGIME = "nbt_no_battery"
TARIFF_MIX = {"nem2_legacy": 0.901, "nbt_no_battery": 0.099}
NEM1_CLOSE_DATE = "2016-12-15"
NBT_START_DATE = "2023-04-15"
SITE_LAT, SITE_LON, TZ_MERIDIAN = 36.97, -122.03, -120.0

# --- fixed values: persistent-soiling dollar scenario ------------------------------------------------
PERSISTENT_LOSS_PCT = 3.0
PERSISTENT_HORIZON_YEARS = 2

# --- fixed values: band-soiling channel ---------------------------------------------------------------
BAND_TRACE_MM = 0.2
BAND_K = 25.0
BAND_F_SAT = 0.30
BAND_DRY_LOAD = 0.15
BAND_LOSS_F = (0.0, 0.1, 0.2, 0.3, 0.5, 1.0)
BAND_LOSS_PCT = {
    "landscape_full_mlpe": (0.0, 0.79, 2.35, 4.23, 7.00, 7.00),
    "landscape_full_string": (0.0, 2.12, 7.00, 7.00, 7.00, 7.00),
    "portrait_full_mlpe": (0.0, 0.63, 2.15, 4.01, 8.20, 8.20),
    "portrait_full_string": (0.0, 1.85, 9.10, 18.39, 21.00, 21.00),
}
BIO_K_HOURS = 6000.0
BIO_SHADE_FLOOR = 1.05
BIO_SHADE_RATE = 2.5

# --- fixed values: wetness index --------------------------------------------------------------------------
RH_WET_PCT = 80.0
DEW_DEPRESSION_C = 2.0
GROWTH_FLOOR_C = 5.0
GROWTH_REF_C = 20.0

# --- fixed values: area and per-array recommendation rule -----------------------------------------------------
RISK_THRESHOLD = 0.6
RAIN_MM_THRESHOLD = 5.0
MIN_DAYS_SINCE_CLEAN = 150
FORECAST_DAYS = 7
RECOVERY_BUCKETS = ((0.50, "low", 1.0, 2.5), (0.75, "medium", 2.0, 4.0), (None, "high", 3.0, 7.0))
NEAR_AGRICULTURE_M = 500.0
NEAR_HIGHWAY_M = 200.0
LOW_TILT_DEG = 5.0
LARGE_SYSTEM_KW = 8.0

# --- fixed values: earth -----------------------------------------------------------------------------------------
EARTH_RADIUS_M = 6371000.0
WEB_MERCATOR_RADIUS_M = 6378137.0
