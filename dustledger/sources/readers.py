"""Readers and writers with stated schemas: CSV, JSON, Parquet, GeoJSON, plain lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dustledger.operators.contracts import ContractError, require_columns

GEOMETRY = "struct<type: string, coordinates: array<array<array<double>>>>"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        options = {"header": "true", **options}
    return reader.options(**options).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    if fmt == "csv":
        df.write.mode(mode).option("header", "true").csv(path)
        return
    writer = df.write.mode(mode).format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """One row per polygon feature: its properties and the open outer ring.

    A FeatureCollection file is one JSON value and so one task; large layers come as one feature
    per line (``write_geojson_lines``) and split freely.
    """
    raw = spark.read.schema(f"features array<struct<properties: struct<{properties}>, geometry: {GEOMETRY}>>").option(
        "multiLine", "true").json(path)
    f = raw.select(F.explode("features").alias("f"))
    return f.select("f.properties.*", open_ring(F.col("f.geometry.coordinates")[0]).alias("ring"))


def read_geojson_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    raw = spark.read.schema(f"properties struct<{properties}>, geometry {GEOMETRY}").json(path)
    return raw.select("properties.*", open_ring(F.col("geometry.coordinates")[0]).alias("ring"))


def open_ring(coords: Column) -> Column:
    """[[x, y], ...] closed -> array of (x, y) structs without the repeated last vertex."""
    pts = F.transform(coords, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    closed = F.element_at(coords, 1) == F.element_at(coords, -1)
    return F.when(closed, F.slice(pts, 1, F.size(pts) - 1)).otherwise(pts)


def feature_json(ring: Column, properties: Sequence[str]) -> Column:
    """One GeoJSON feature per row; null properties are left out."""
    first = F.slice(ring, 1, 1)
    coords = F.transform(F.concat(ring, first), lambda p: F.array(p["x"], p["y"]))
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(coords).alias("coordinates")).alias("geometry")))


def write_geojson_lines(df: DataFrame, path: str, properties: Sequence[str], ring: str = "ring") -> None:
    df.select(feature_json(F.col(ring), properties).alias("value")).write.text(path)


def filtered_load(rows: DataFrame, county_column: str, county: str, columns: Sequence[str], key: str) -> DataFrame:
    """County contains-match (no case), named columns only, one row per application id.

    The filter and the column list reach the scan. Of repeated ids the smallest row is kept, so the
    result does not depend on file order.
    """
    require_columns(rows, [county_column, key, *columns])
    hit = rows.filter(F.lower(F.col(county_column)).contains(county.lower()))
    rest = [c for c in columns if c != key]
    best = hit.groupBy(key).agg(F.min(F.struct(*rest)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in rest])


def in_bbox(df: DataFrame, bbox: tuple[float, float, float, float], lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Inclusive bounding box (minx, miny, maxx, maxy) in degrees; both ranges push to the scan."""
    minx, miny, maxx, maxy = bbox
    if not (-180 <= minx < maxx <= 180 and -90 <= miny < maxy <= 90):
        raise ContractError(f"degenerate or out-of-range bounding box {bbox}")
    return df.filter(F.col(lon).between(minx, maxx) & F.col(lat).between(miny, maxy))


def telemetry_names(columns: Sequence[str]) -> dict[str, str]:
    """Published column name -> energy_kwh / power_max_kw / power_mean_kw; an error if none fits."""
    rules = (("ac_energy", "daily_sum", "energy_kwh"), ("ac_power", "daily_max", "power_max_kw"), ("ac_power", "daily_mean", "power_mean_kw"))
    found = {c: new for c in columns for a, b, new in rules if a in c.lower() and b in c.lower()}
    if not found:
        raise ContractError(f"no recognised AC columns in {list(columns)[:8]}")
    return found


def normalise_telemetry(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    names = telemetry_names(df.columns)
    return df.select(*keep, *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
