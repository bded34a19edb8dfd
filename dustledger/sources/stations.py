"""Station soiling records: nested JSON to summary and station-year tables, censored values, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

STATION_SCHEMA = (
    "map<string, struct<`IWSR`: string, `IWSR lower`: string, `IWSR upper`: string, `Latitude`: double, "
    "`Longitude`: double, `State`: string, `County`: string, `Measurement type`: string, `Tilt`: string, "
    "`Mounting`: string, `Months in data set`: double, `Annual IWSR`: array<array<string>>, "
    "`Monthly soiling rates`: array<array<string>>>>")


def censored_value(text: Column) -> tuple[Column, Column]:
    """'>0.99' -> (0.995, true); numbers pass; anything else is null. Returns (value, censored)."""
    s = F.trim(text)
    over = s.startswith(">")
    number = s.try_cast("double")
    above = F.regexp_replace(s, "^>", "").try_cast("double")
    return F.when(over, (above + 1.0) / 2.0).otherwise(number), F.coalesce(over, F.lit(False))


def station_records(raw: DataFrame, text: str = "value") -> DataFrame:
    """One row per station of each JSON document."""
    parsed = raw.select(F.from_json(F.col(text), STATION_SCHEMA).alias("m"))
    return parsed.select(F.explode("m").alias("station_id", "r"))


def station_summary(raw: DataFrame, text: str = "value") -> DataFrame:
    s = station_records(raw, text)
    value, censored = censored_value(F.col("r.IWSR"))
    out = s.select(
        "station_id", F.col("r.Latitude").alias("latitude"), F.col("r.Longitude").alias("longitude"), value.alias("iwsr"),
        censored.alias("iwsr_censored"), censored_value(F.col("r.`IWSR lower`"))[0].alias("iwsr_lower"),
        censored_value(F.col("r.`IWSR upper`"))[0].alias("iwsr_upper"), F.col("r.State").alias("state"),
        F.col("r.County").alias("county"), F.col("r.`Measurement type`").alias("measurement_type"),
        F.col("r.`Months in data set`").alias("months_in_data_set"))
    return out.dropna(subset=["latitude", "longitude", "iwsr"])


def station_panel(raw: DataFrame, text: str = "value") -> DataFrame:
    """Station-years from the annual block: header row skipped, short entries and null values dropped."""
    s = station_records(raw, text)
    rows = s.select("station_id", "r", F.posexplode("r.`Annual IWSR`").alias("_at", "e")).filter((F.col("_at") > 0) & (F.size("e") >= 2))
    at = lambda i: F.try_element_at("e", F.lit(i))
    value, censored = censored_value(at(2))
    out = rows.select(
        "station_id", at(1).try_cast("int").alias("year"), F.col("r.Latitude").alias("latitude"),
        F.col("r.Longitude").alias("longitude"), value.alias("iwsr"), censored.alias("iwsr_censored"),
        censored_value(at(3))[0].alias("iwsr_lower"), censored_value(at(4))[0].alias("iwsr_upper"),
        F.col("r.State").alias("state"), F.col("r.County").alias("county"), F.col("r.`Measurement type`").alias("measurement_type"))
    return out.dropna(subset=["latitude", "longitude", "iwsr"])


def merge_labels(panel: DataFrame, summary: DataFrame, threshold: float, as_of: str) -> DataFrame:
    """Uncensored panel rows plus summary-only stations (kept even if censored), flagged is_summary."""
    p = panel.filter(~F.col("iwsr_censored")).withColumns(
        {"is_summary": F.lit(False), "as_of": F.make_date(F.col("year"), F.lit(12), F.lit(31))})
    only = summary.join(p.select("station_id").distinct(), "station_id", "left_anti")
    only = only.withColumns({"is_summary": F.lit(True), "as_of": F.to_date(F.lit(as_of)), "year": F.year(F.to_date(F.lit(as_of)))})
    return p.unionByName(only, allowMissingColumns=True).withColumn("label", (F.col("iwsr") < threshold).cast("int"))


def merge_shards(rows: DataFrame, key: str, file: str, columns: Sequence[str], last: bool = False) -> DataFrame:
    """One whole row per key: from the first (or last) file in name order."""
    pick = F.max_by if last else F.min_by
    best = rows.groupBy(key).agg(pick(F.struct(*columns), F.col(file)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in columns])


def fleet_skips(rows: DataFrame, min_valid: int = 5) -> DataFrame:
    """Why fits were left out: (reason, n); 'kept' counts the rest."""
    reason = (F.when(F.col("loss_pct").isNull(), "no_fit").when(F.col("degenerate"), "degenerate")
              .when(F.col("n_valid") < min_valid, "low_n_valid").otherwise("kept"))
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def first_stamp_wins(rows: DataFrame, key: str, ts: str, file: str, value: str) -> DataFrame:
    """Union of telemetry files with repeated stamps resolved to the first file; null stamps dropped."""
    return rows.filter(F.col(ts).isNotNull()).groupBy(key, ts).agg(F.min_by(value, F.struct(file, value)).alias(value))


def build_queue(labels: DataFrame, done: DataFrame, id_col: str, limit: int | None, threshold: float) -> DataFrame:
    """Systems still to build, east first, with loss % turned into iwsr and label."""
    todo = labels.join(done.select(id_col).distinct(), id_col, "left_anti")
    iwsr = 1.0 - F.col("loss_pct") / 100.0
    todo = todo.withColumns({"iwsr": iwsr, "label": (iwsr < threshold).cast("int")}).orderBy(F.desc("lon"), id_col)
    return todo.limit(limit) if limit else todo
