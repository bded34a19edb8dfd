"""Text parsing cases, and inputs that once ran into a fixed limit."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dustledger.functions import text as TX
from dustledger.operators.components import connected_components
from dustledger.operators.matching import suppress_overlaps
from dustledger.operators.ranks import cumulative, exact_quantiles, rank_in_groups, row_numbers, value_table
from dustledger.operators.spatial import nearest_box_distance


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("raw, street", (
    ("SMITH 12 OAK   HILL RD $0", "12 Oak Hill Rd"), ("7 o'neil smith-lane way", "7 O'Neil Smith-Lane Way"), ("P.O. BOX 12 MAIN ST", None),
    ("12 MAIN", None), ("100 200 A ST.", "100 200 A St"), ("", None)))
def test_streets(spark, raw, street):
    assert one(spark, TX.clean_street(F.lit(raw))) == street


def test_addresses(spark):
    row = one(spark, TX.parse_us_address(F.lit("12345 Elm St, Bldg 2, Apt 4, Aptos, Nevada, 95003-1234")))
    assert tuple(row) == ("12345 Elm St", "Bldg 2, Apt 4", "Aptos", "NV", "95003")
    assert tuple(one(spark, TX.parse_us_address(F.lit("1 Elm St, Aptos 95003")))) == ("1 Elm St", "", "Aptos", "CA", "95003")
    assert one(spark, TX.parse_us_address(F.lit("1 Elm St 95003"))) is None


def test_source_names(spark):
    for name, want in (("naip_sc_2022_512_42.tif", ("sc", 2022)), ("m_37_ca_10_060_20220601", (None, None)), ("x/naip_ca_2018_640_7", ("ca", 2018))):
        region, year = TX.region_vintage(F.lit(name))
        assert tuple(spark.range(1).select(region, year).first()) == want
    city, code = TX.city_zip(F.lit("lives near Santa  Cruz CA 95060-1111"))
    assert tuple(spark.range(1).select(city, code).first()) == ("Santa Cruz", "95060")


def test_a_long_chain_of_boxes_is_suppressed_to_the_end(spark):
    rows = [("t", k, 1000.0 - k, k * 4.0, 0.0, k * 4.0 + 10.0, 10.0) for k in range(60)]
    boxes = spark.createDataFrame(rows, "tile_id string, det_id long, score double, minx double, miny double, maxx double, maxy double")
    kept, alive = [], []
    for _, k, _, x0, *_ in rows:
        if not any(abs(x0 - a) < 10 and (10 - abs(x0 - a)) / (10 + abs(x0 - a)) >= 0.4 for a in alive):
            kept.append(k)
            alive.append(x0)
    assert sorted(r["det_id"] for r in suppress_overlaps(boxes, 0.4).collect()) == kept


def test_a_long_chain_is_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = connected_components(edges).collect()
    assert len(got) == 201 and {r["component"] for r in got} == {0}


def test_the_nearest_box_may_be_3000_km_away(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 3_000_000.0, 0.0), (3, None, 0.0), (4, 2_999_000.0, 40.0)], "id long, x double, y double")
    boxes = spark.createDataFrame([(2_999_990.0, -5.0, 3_000_010.0, 5.0), (3_000_020.0, -5.0, 3_000_030.0, 5.0)], "minx double, miny double, maxx double, maxy double")
    got = {r["id"]: r["distance"] for r in nearest_box_distance(points, boxes, "id", 30.0).collect()}
    assert got[1] == 2_999_990.0 and got[2] == 0.0 and got[3] is None and got[4] == pytest.approx((990.0**2 + 35.0**2) ** 0.5)
    assert {r["distance"] for r in nearest_box_distance(points, boxes.limit(0), "id", 30.0).collect()} == {None}


def test_an_outlier_does_not_gather_a_group_in_one_slice(spark):
    rows = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x")).union(spark.createDataFrame([("g", 1e12)], "g string, x double"))
    table = cumulative(value_table(rows, ["g"], "x"), ["g"])
    assert table.count() == 20_001 and table.filter("v = 1e12").first()["n_below"] == 20_000
    sizes = [r[0] for r in value_table(rows, ["g"], "x").repartitionByRange(4, "g", "v").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 0.5 * 20_001
    assert exact_quantiles(rows, ["g"], "x", {"m": 0.5}).first()["m"] == 10_000.0


def test_ranks_tell_ids_beyond_double_precision_apart(spark):
    big = 2**53
    rows = spark.createDataFrame([("a", big, 1.0), ("a", big + 1, 1.0), ("a", 5, 2.0), (None, 7, 1.0), ("a", 9, None)], "g string, id long, s double")
    got = {r["id"]: r["rank"] for r in rank_in_groups(rows.filter("s is not null"), ["g"], "s", "id").filter("g = 'a'").collect()}
    assert got == {5: 1, big: 2, big + 1: 3}
    names = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", None)], "id string, s double")
    assert {r["id"]: r["rank"] for r in row_numbers(names, "s", "id").collect()} == {"x": 1, "y": 2, "z": 3}
