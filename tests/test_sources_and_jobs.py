"""Readers and writers, nested records, and the jobs that have no SQL twin, against small loops."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dustledger.functions import geo, overlay
from dustledger.operators import components as CC, learn as LE, lidar as LI, lookup as LO, matching as MA, recommend as RE
from dustledger.operators.contracts import ContractError
from dustledger.sources import readers as RD, stations as SN

BOX = "minx double, miny double, maxx double, maxy double"


def ring_col(*pts):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])


def test_csv_and_parquet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "id long, name string, v double")
    for fmt in ("csv", "parquet"):
        RD.write_table(df, str(tmp_path / fmt), fmt)
        back = RD.read_table(spark, str(tmp_path / fmt), fmt, "id long, name string, v double")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_geojson_collection_and_lines(spark, tmp_path):
    poly = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]]}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 7, "name": None}, "geometry": poly}]}, indent=1))
    a = RD.read_geojson(spark, str(tmp_path / "a.geojson"), "id: bigint, name: string")
    assert a.select("id", F.size("ring").alias("n"), geo.ring_area(F.col("ring")).alias("s")).first() == (7, 4, 2.0)
    RD.write_geojson_lines(a, str(tmp_path / "lines"), ["id", "name"])
    b = RD.read_geojson_lines(spark, str(tmp_path / "lines"), "id: bigint, name: string")
    assert b.select("id", geo.ring_area(F.col("ring")).alias("s")).first() == (7, 2.0)


def test_reader_contracts(spark):
    with pytest.raises(ContractError):
        RD.in_bbox(spark.range(1), (10, 0, 5, 1))
    with pytest.raises(ContractError):
        RD.telemetry_names(["ts", "foo"])


def test_censored_values(spark):
    df = spark.createDataFrame([(">0.99",), ("0.97",), ("n/a",), (None,), (">x",)], "t string")
    v, c = SN.censored_value(F.col("t"))
    got = [tuple(r) for r in df.select(v.alias("v"), c.alias("c")).collect()]
    assert got[0] == (pytest.approx(0.995), True) and got[1] == (0.97, False)
    assert got[2:] == [(None, False), (None, False), (None, True)]


def test_convex_iou_hull_and_clip(spark):
    a, b = ring_col((0, 0), (2, 0), (2, 2), (0, 2)), ring_col((1, 1), (3, 1), (3, 3), (1, 3))
    row = spark.range(1).select(a.alias("a"), b.alias("b")).select(overlay.polygon_iou(F.col("a"), F.col("b")).alias("i")).first()
    assert row.i == pytest.approx(1 / 7)
    star = ring_col((0, 0), (4, 0), (2, 1), (4, 4), (0, 4))
    h = spark.range(1).select(star.alias("r")).select(geo.convex_hull("r").alias("h"), overlay.clip_to_box(F.col("r"), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(4.0)).alias("c")).first()
    assert len(h.h) == 4 and len(h.c) == 4


def test_dissolve_counts_overlap_once(spark):
    df = spark.createDataFrame([(1, 0., 0., 4., 4.), (1, 2., 2., 6., 6.), (1, 1., 1., 3., 3.), (2, 0., 0., 1., 1.)], "g long, " + BOX)
    assert {r.g: r.union_area for r in CC.dissolved_area(df, "g").collect()} == {1: 28.0, 2: 1.0}


def test_identity_carry_over_against_the_loop(spark):
    rnd = random.Random(2)
    prev = [(i, x, y, x + 6, y + 5) for i in range(25) for x, y in [(rnd.uniform(0, 60), rnd.uniform(0, 60))]]
    curr = [(100 + p[0], *(v + rnd.uniform(-1.5, 1.5) for v in p[1:])) for p in prev if p[0] % 6]
    curr = [(c[0], min(c[1], c[3]), min(c[2], c[4]), max(c[1], c[3]), max(c[2], c[4])) for c in curr]

    def iou(a, b):
        w, h = max(0, min(a[3], b[3]) - max(a[1], b[1])), max(0, min(a[4], b[4]) - max(a[2], b[2]))
        return w * h / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - w * h)

    pairs, used_c, used_p, want = sorted((-iou(c, p), c[0], p[0]) for c in curr for p in prev if iou(c, p) >= 0.3), set(), set(), {}
    for _, c, p in pairs:
        if c not in used_c and p not in used_p:
            used_c.add(c), used_p.add(p)
            want[c] = p
    got = MA.carry_identity(spark.createDataFrame(prev, "pid long, " + BOX), spark.createDataFrame(curr, "cid long, " + BOX), "pid", "cid", 20.0, max_shift=0.01)
    rows = got.collect()
    assert {r.curr_id: r.prev_id for r in rows if r.status == "matched"} == want
    assert {r.prev_id for r in rows if r.status == "dropped"} == {p[0] for p in prev} - set(want.values())


def test_standoff_height(spark):
    rnd = random.Random(9)
    plane = lambda x, y: 0.2 * x - 0.1 * y
    pts = [(1, rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(200)]
    inside = spark.createDataFrame([(k, x, y, plane(x, y) + 0.15) for k, x, y in pts[:80]], "id long, x double, y double, z double")
    ring = spark.createDataFrame([(k, x, y, plane(x, y) + rnd.gauss(0, 0.01)) for k, x, y in pts[80:]], "id long, x double, y double, z double")
    row = LI.standoff(inside, ring, "id").first()
    assert row.standoff_m == pytest.approx(0.15, abs=0.01) and row.d_azimuth_deg < 2


def test_gamma_tiers(spark):
    cat = spark.createDataFrame([("TRINASOLARTSM245PA05", "Multi-c-Si", -0.0043, 245.0), ("TRINASOLARTSM250PA05", "Multi-c-Si", -0.0041, 250.0), ("SHARPND200", "Mono-c-Si", -0.0048, 200.0)],
                                "key_norm string, technology string, gamma_pdc double, stc_w double")
    mods = spark.createDataFrame([(1, "Trina", "TSM-245PA05", None, 245.0), (2, "Trina", "unknown", None, None), (3, "Acme", "x", "perc", None), (4, None, None, None, None)],
                                 "id long, manufacturer string, model string, type string, watts double")
    got = {r.id: (r.tier, r.gamma) for r in LO.resolve_gamma(mods, cat, "id").collect()}
    assert got[1] == ("part_number", -0.0043) and got[2][0] == "brand" and got[2][1] == pytest.approx(-0.0042)
    assert got[3] == ("technology", -0.0048) and got[4] == ("fleet_default", -0.0045)


def test_quantile_forest_bands_are_ordered_and_informative(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, float(x), float(5 * x + rnd.normal(0, 0.5))) for i, x in enumerate(rnd.uniform(0, 2, 300))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    q = LE.quantile_forest(df, df, ["x"], "y", "id", {"lo": 0.1, "mid": 0.5, "hi": 0.9}, trees=5).join(df, "id").toPandas()
    assert (q.lo <= q.mid).all() and (q.mid <= q.hi).all()
    assert 0.6 < ((q.y >= q.lo) & (q.y <= q.hi)).mean() <= 1.0 and np.corrcoef(q.mid, q.y)[0, 1] > 0.9


def test_publish_layer_drops_nulls_and_hides_parcels(spark):
    a = spark.createDataFrame([(1, "apn:001-002-03", 0.7, 20.0, 3.0, None, None)], "array_id long, site_id string, risk_score double, area_m2 double, system_kw double, expected_net_usd double, economic_action string")
    rec = spark.createDataFrame([], "array_id long, system_kw double, expected_net_usd double, economic_action string, persistent_soiling_score double")
    scr = spark.createDataFrame([(1, 0.9, True)], "array_id long, persistent_soiling_score double, persistent_soiling_top_decile boolean")
    p = json.loads(RE.publish_layer(a, rec, scr, "array_id", "salt").first().properties)
    assert p["persistent_soiling_inspection_action"] == "inspect" and "site_expected_net_usd" not in p
    assert p["site_key"].startswith("s:") and "00100203" not in json.dumps(p)
