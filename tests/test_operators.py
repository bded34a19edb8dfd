"""Scalar, rank, geometry, matching, economics and telemetry operators on small fixtures."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dustledger import constants as K
from dustledger.functions import geo, pv, text as TX
from dustledger.operators import components as CC, contracts as C, economics as EC, lidar as LI, matching as MA, ranks as R, solar_tables as SOL, stats as ST, telemetry as TE


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_known_scalars(spark):
    f = lambda x: F.lit(float(x))
    assert one(spark, pv.production_factor(f(10))) == pytest.approx(0.9511, abs=5e-5)
    assert one(spark, pv.production_factor(f(20))) == pytest.approx(0.9046, abs=5e-5)
    for tilt, want in ((0, 1.843), (20, 1.0), (40, 0.849)):
        assert one(spark, pv.tilt_soiling_factor(f(tilt))) == pytest.approx(want, abs=5e-4)
    assert one(spark, pv.production_factor(F.lit(None).cast("double"))) == 1.0
    assert one(spark, pv.professional_cost(f(6))) == 150.0
    assert one(spark, pv.professional_cost(f(100))) == pytest.approx(227 * 3.0)
    assert pv.blended_rate() == pytest.approx(0.428, abs=1e-3)


def test_retail_rate_is_the_table_result(spark):
    place = spark.createDataFrame([(1, K.SITE_LAT, K.SITE_LON, 20.0, 180.0)], "k int, lat double, lon double, tilt double, az double")
    row = SOL.production_shares(place, "k", "lat", "lon", "tilt", "az").first()
    assert row.retail_usd_per_kwh == pytest.approx(pv.RETAIL_USD_PER_KWH, abs=1e-6)
    assert row.summer_peak + row.summer_offpeak + row.winter_peak + row.winter_offpeak == pytest.approx(1.0)


def test_exact_quantiles_with_ties_and_a_heavy_tail(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([1.0, 1.0, 2.0, rnd.uniform(0, 5), 10 ** rnd.uniform(0, 9)]) for _ in range(700)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(vals)], "g int, v double").withColumnRenamed("v", "val")
    for levels in (1, 2):
        got = {r.g: r for r in R.exact_quantiles(df, ["g"], "val", {"a": 0.1, "b": 0.5, "c": 0.975}, levels=levels).collect()}
        for g in range(3):
            x = np.array([v for i, v in enumerate(vals) if i % 3 == g])
            for n, p in (("a", 0.1), ("b", 0.5), ("c", 0.975)):
                assert got[g][n] == pytest.approx(np.quantile(x, p), rel=1e-12)


def test_flag_top_fraction_ranks_ties_by_id_and_nulls_last(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.5), (4, None), (5, 0.9)], "id long, s double")
    got = {r.id: (r["rank"], r.top_fraction) for r in R.flag_top_fraction(df, "s", "id", 0.4).collect()}
    assert got == {2: (1, True), 5: (2, True), 1: (3, False), 3: (4, False), 4: (5, False)}


def test_auc_of_a_single_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert ST.auc(df, "s", "y").first().auc is None


def test_contracts(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    with pytest.raises(C.ContractError):
        C.assert_unique(a, ["k"])
    with pytest.raises(C.ContractError):
        C.require_columns(a, ["missing"])
    with pytest.raises(C.ContractError):
        C.assert_same_ids(a, spark.createDataFrame([(1,)], "k int"), ["k"])
    assert C.fingerprint(a).first() == C.fingerprint(a.repartition(5)).first()


def ring(*pts):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])


def test_concave_ring(spark):
    c = ring((0, 0), (10, 0), (10, 2), (2, 2), (2, 8), (10, 8), (10, 10), (0, 10))
    x, y = geo.interior_point(c)
    row = spark.range(1).select(x.alias("x"), y.alias("y"), geo.ring_area(c).alias("a"), geo.point_in_ring(x, y, c).alias("i")).first()
    assert row.i and row.a == pytest.approx(52.0) and 0 < row.x < 2
    assert not one(spark, geo.point_in_ring(F.lit(6.0), F.lit(5.0), c))


def test_projections(spark):
    x, y = geo.to_utm10n(F.lit(-123.0), F.lit(37.0))
    assert one(spark, x) == pytest.approx(500000.0, abs=1e-6)
    # meridian arc 111132.954 * 37 - 16038.5 sin 74 + 16.8 sin 148, times 0.9996
    assert one(spark, y) == pytest.approx(4094872.4, abs=1.0)
    ax, ay = geo.to_albers_california(F.lit(-120.0), F.lit(38.0))
    assert one(spark, ax) == pytest.approx(0.0, abs=1e-6)
    assert -4000000 < one(spark, ay) < 500000


def test_square_blocks_form_sites(spark):
    def sites(origins):
        b = spark.createDataFrame([(i, float(x), 0.0, x + 4.0, 4.0) for i, x in enumerate(origins)], "id long, minx double, miny double, maxx double, maxy double")
        return CC.proximity_clusters(b, "id").select("component").distinct().count()

    assert sites([0, 5]) == 1 and sites([0, 12]) == 2 and sites([0, 5, 10]) == 1


def naive_match(preds, gts, thr):
    def iou(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
        return w * h / u if u > 0 else 0

    used, out = set(), {}
    for pid, _, box in sorted(preds, key=lambda p: (-p[1], p[0])):
        best, who = 0.0, None
        for gid, g in gts:
            if gid not in used and iou(box, g) > best:
                best, who = iou(box, g), gid
        if who is not None and best >= thr:
            used.add(who)
            out[pid] = who
    return out


def test_greedy_matching_against_the_loop(spark):
    rnd = random.Random(11)
    box = lambda: (lambda x, y: (x, y, x + rnd.uniform(8, 14), y + rnd.uniform(8, 14)))(rnd.uniform(0, 40), rnd.uniform(0, 40))
    gts = [(i, box()) for i in range(30)]
    preds = [(100 + i, round(rnd.random(), 1), box()) for i in range(60)]
    p = spark.createDataFrame([(1, i, s, *b) for i, s, b in preds], "tile_id long, det_id long, score double, minx double, miny double, maxx double, maxy double")
    g = spark.createDataFrame([(1, i, *b) for i, b in gts], "tile_id long, gt_id long, minx double, miny double, maxx double, maxy double")
    got = {r.det_id: r.gt_id for r in MA.match_detections(p, g, 0.3, 16.0).filter("class = 'tp'").collect()}
    assert got == naive_match(preds, gts, 0.3) and len(got) > 5


def test_breakeven_size_against_the_grid(spark):
    s = spark.createDataFrame([(1, 5.5, 3.0, 0.4), (2, 6.0, 20.0, 0.45), (3, 5.0, 60.0, 0.5)], "id long, sun_hours double, loss_pct double, usd_per_kwh double")
    got = {r.id: r.breakeven_kw for r in EC.breakeven_system_kw(s, "id", "professional", F.lit(0.045)).collect()}
    grid = [i / 10 for i in range(1, 301)] + [30.0 + i for i in range(1, 4971)]
    cost = {r.kw: r.c for r in spark.createDataFrame([(k,) for k in grid], "kw double").select("kw", pv.professional_cost(F.col("kw")).alias("c")).collect()}
    for r in s.collect():
        per = r.sun_hours * 365 * 0.84 * r.loss_pct / 100 * r.usd_per_kwh * 0.045
        assert got[r.id] == next((k for k in grid if k * per > cost[k]), None)


def test_monte_carlo_is_the_same_on_any_partitioning(spark):
    s = spark.createDataFrame([(i, 3.0 + i, 5.0, 5.5, 0.4) for i in range(8)], "id long, system_kw double, loss_pct double, sun_hours double, usd_per_kwh double")
    d = EC.best_strategy(s).withColumns({"loss_p50": F.col("loss_pct"), "loss_p10": F.lit(None).cast("double"), "loss_p90": F.lit(None).cast("double")})
    d = EC.with_default_interval(d)
    a = sorted(map(tuple, EC.monte_carlo(d, "id", 50).collect()))
    assert a == sorted(map(tuple, EC.monte_carlo(d.repartition(7), "id", 50).collect()))


@pytest.mark.parametrize("tilt,azimuth", [(20, 180), (25, 270), (15, 0.001), (30, 90)])
def test_known_planes(spark, tilt, azimuth):
    rnd = random.Random(tilt)
    g = np.tan(np.radians(tilt))
    a, b = float(-g * np.sin(np.radians(azimuth))), float(-g * np.cos(np.radians(azimuth)))
    pts = [(1, x, y, a * x + b * y + rnd.gauss(0, 0.01) + (3.0 if i % 15 == 0 else 0.0), 6, 1) for i in range(120) for x, y in [(rnd.uniform(0, 8), rnd.uniform(0, 6))]]
    row = LI.roof_planes(spark.createDataFrame(pts, "id long, x double, y double, z double, cls int, ret int"), "id").first()
    assert row.fit_ok and row.tilt_deg == pytest.approx(tilt, abs=0.3)
    assert min(abs(row.azimuth_deg - azimuth), 360 - abs(row.azimuth_deg - azimuth)) < 1.5


def test_too_few_points_fail(spark):
    pts = [(1, float(i), float(i % 3), 0.0, 6, 1) for i in range(8)]
    row = LI.roof_planes(spark.createDataFrame(pts, "id long, x double, y double, z double, cls int, ret int"), "id").first()
    assert not row.fit_ok and row.fit_reason == "only 8 points"


def test_soiling_ratio_of_a_clean_sawtooth(spark):
    """60-day ramps from 1.0 losing 0.1% a day, then a wash: mean loss about 3%."""
    rnd = random.Random(5)
    rows = [(1, dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0 - 0.001 * (i % 60) + rnd.gauss(0, 0.001), 5.0) for i in range(720)]
    iv = TE.soiling_intervals(spark.createDataFrame(rows, "system_id long, day date, pi double, insolation double"), "system_id")
    r = TE.soiling_ratio(iv, "system_id", method="perfect_clean", reps=30).first()
    assert r.n_valid >= 10 and not r.degenerate and r.loss_pct == pytest.approx(2.95, abs=0.5)


def test_address_and_keys(spark):
    row = one(spark, TX.parse_us_address(F.lit("12 Elm St, Apt 4, Aptos, CA 95003-1234")))
    assert (row.line1, row.line2, row.city, row.state, row.zip) == ("12 Elm St", "Apt 4", "Aptos", "CA", "95003")
    assert one(spark, TX.parse_us_address(F.lit("nowhere"))) is None
    assert one(spark, TX.canonical_tile_name(F.lit("tile_000042_png.rf.AbC1.jpg"))) == "tile_000042.png"
    assert one(spark, TX.apn_base(F.lit("109-171-2"))) is None
