"""Year tables of clear-sky irradiance: tariff shares, orientation grid and its lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dustledger import constants as K
from dustledger.functions.solar import clearsky_poa
from dustledger.session import spread


def production_shares(places: DataFrame, key: str, lat: str, lon: str, tilt: str, azimuth: str) -> DataFrame:
    """(key, summer_peak, summer_offpeak, winter_peak, winter_offpeak, retail_usd_per_kwh) per place.

    Hours are exploded from literals inside each row's task and summed there.
    """
    d = spread(places, key).withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(365)))).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    d = d.withColumn("month", F.month(F.date_add(F.to_date(F.lit("2023-01-01")), F.col("doy") - 1)))
    d = d.withColumn("poa", clearsky_poa(F.col("doy"), F.col("hour"), F.col(lat), F.col(lon), F.col(tilt), F.col(azimuth)))
    summer, peak = F.col("month").isin(*K.SUMMER_MONTHS), F.col("hour").isin(*K.PEAK_HOURS)
    cond = {"summer_peak": summer & peak, "summer_offpeak": summer & ~peak, "winter_peak": ~summer & peak, "winter_offpeak": ~summer & ~peak}
    agg = d.groupBy(key).agg(F.sum("poa").alias("_t"), *[F.sum(F.when(c, F.col("poa"))).alias(n) for n, c in cond.items()])
    share = {n: F.coalesce(n, F.lit(0.0)) / F.nullif(F.col("_t"), F.lit(0.0)) for n in cond}
    retail = sum((share[n] * K.TOU_USD_PER_KWH[n] for n in cond), F.lit(0.0))
    return agg.select(key, *[c.alias(n) for n, c in share.items()], retail.alias("retail_usd_per_kwh"))


def orientation_grid(spark: SparkSession, lat: float, lon: float, tilt_step: float = 2.5, az_step: float = 10.0) -> DataFrame:
    """(ti, ai, poa_rel): annual clear-sky sums over (0..60, 0..360) degrees relative to 20/180."""
    nt, na = int(60 / tilt_step), int(360 / az_step)
    nodes = spark.range((nt + 1) * (na + 1)).select(
        F.floor(F.col("id") / (na + 1)).cast("int").alias("ti"), (F.col("id") % (na + 1)).cast("int").alias("ai"))
    ref = nodes.limit(1).select(F.lit(-1).alias("ti"), F.lit(-1).alias("ai"))
    all_nodes = nodes.unionByName(ref)
    tilt = F.when(F.col("ti") < 0, F.lit(20.0)).otherwise(F.col("ti") * tilt_step)
    azimuth = F.when(F.col("ai") < 0, F.lit(180.0)).otherwise(F.col("ai") * az_step)
    d = (spread(all_nodes.withColumns({"tilt": tilt, "az": azimuth}), "ti", "ai")
         .withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(365)))).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))))
    s = d.groupBy("ti", "ai").agg(F.sum(clearsky_poa(F.col("doy"), F.col("hour"), lat, lon, F.col("tilt"), F.col("az"))).alias("poa"))
    from dustledger.operators.ranks import attach_row

    one = s.filter("ti < 0").agg(F.max("poa").alias("_ref"))
    return attach_row(s.filter("ti >= 0"), one).select("ti", "ai", (F.col("poa") / F.col("_ref")).alias("poa_rel"))


def lookup_orientation(arrays: DataFrame, grid: DataFrame, tilt: str, azimuth: str, tilt_step: float = 2.5, az_step: float = 10.0) -> DataFrame:
    """Add poa_rel by bilinear interpolation; null without an orientation.

    The grid folds into one row holding a map of its (at most a thousand) nodes, so the lookup is a
    projection of the arrays: no shuffle and no row multiplication.
    """
    from dustledger.operators.ranks import attach_row

    nt, na = int(60 / tilt_step), int(360 / az_step)
    table = grid.agg(F.map_from_entries(F.collect_list(F.struct((F.col("ti") * (na + 1) + F.col("ai")).alias("k"), "poa_rel"))).alias("_grid"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(60.0), F.col(tilt)))
    a = F.pmod(F.col(azimuth), F.lit(360.0))
    # cell index as 'last node strictly below', so a node belongs to the cell on its left
    ti = F.greatest(F.lit(0), F.least(F.lit(nt - 1), F.ceil(t / tilt_step) - 1)).cast("int")
    ai = F.greatest(F.lit(0), F.least(F.lit(na - 1), F.ceil(a / az_step) - 1)).cast("int")
    d = attach_row(arrays, table).withColumns({"_ti": ti, "_ai": ai})
    wt, wa = t / tilt_step - F.col("_ti"), a / az_step - F.col("_ai")
    node = lambda i, j: F.try_element_at("_grid", (F.col("_ti") + i) * (na + 1) + F.col("_ai") + j)
    value = (node(0, 0) * (1 - wt) * (1 - wa) + node(1, 0) * wt * (1 - wa) + node(0, 1) * (1 - wt) * wa + node(1, 1) * wt * wa)
    known = F.col(tilt).isNotNull() & F.col(azimuth).isNotNull()
    return d.withColumn("poa_rel", F.when(known, value)).drop("_grid", "_ti", "_ai")


def daily_weight(days: DataFrame, day: str, lat: float, lon: float, tilt: float = 20.0) -> DataFrame:
    """Add clear-sky production weight of each day (sum over its hours), computed once per distinct day."""
    d = days.select(day).distinct().withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    w = d.groupBy(day).agg(F.sum(clearsky_poa(F.dayofyear(day), F.col("_h"), lat, lon, tilt, 180.0)).alias("clearsky_weight"))
    return days.join(w, day)
