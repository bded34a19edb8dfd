"""Daily-series and soiling operators against hand vectors and naive day loops."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from dustledger.constants import SOILING
from dustledger.operators import series as S, soiling as SO

DAY0 = dt.date(2024, 1, 1)


def daily(spark, series):
    """{cell: [(rain, pm10), ...]} -> daily table."""
    rows = [(c, DAY0 + dt.timedelta(days=i), r, p, p) for c, v in series.items() for i, (r, p) in enumerate(v)]
    return spark.createDataFrame(rows, "cell_id long, day date, precipitation_sum double, pm10 double, pm2_5 double").withColumn(
        "relative_humidity_2m_mean", F.lit(90.0)).withColumn("wind_speed_10m_max", F.lit(3.0)).withColumn("temperature_2m_max", F.lit(20.0))


def naive_eq(rows, clean=None, efficacy=1.0):
    eq, out = 0.0, []
    for i, (p, pm) in enumerate(rows):
        p = p or 0.0
        if p >= 10:
            f = 0.0
        elif p >= 1:
            f = 1 - (p - 1) / 9
        elif pm > 50:
            f = 1 + 0.02 * (pm - 50)
        else:
            f = 1.0
        eq = f * (eq + 1)
        if i == clean:
            eq *= 1 - efficacy
        out.append(eq)
    return out


def random_series(seed, n=200, wet=0.2):
    rnd = random.Random(seed)
    return [(rnd.choice([0.0, rnd.uniform(0, 14)]) if rnd.random() < wet * 2 else 0.0, rnd.uniform(10, 80)) for _ in range(n)]


@pytest.mark.parametrize("rain,streak,since", [([5, 0, 0, 0, 0, 0], 5, 5), ([0, 0, 2, 0], 1, 4), ([10, 0, 0, 0, 0], 4, 4)])
def test_rain_streaks(spark, rain, streak, since):
    d = daily(spark, {1: [(float(r), 20.0) for r in rain]})
    last = S.rain_streaks(d).orderBy(F.desc("day")).first()
    assert (last.dry_day_streak, last.days_since_rain) == (streak, since)


def test_trailing_sum_counts_calendar_days(spark):
    d = daily(spark, {1: [(float(i), 20.0) for i in range(10)]}).filter(F.col("day") != DAY0 + dt.timedelta(days=8))
    last = S.trailing_features(d, windows=(3,)).orderBy(F.desc("day")).first()
    assert last.precip_3d_mm == 9 + 7


def test_equivalent_days_match_the_day_loop(spark):
    data = {c: random_series(c) for c in range(6)}
    got = {(r.cell_id, r.day): r for r in SO.equivalent_days(daily(spark, data)).collect()}
    for c, rows in data.items():
        for i, eq in enumerate(naive_eq(rows)):
            r = got[(c, DAY0 + dt.timedelta(days=i))]
            assert r.eq_days == pytest.approx(eq, rel=1e-9, abs=1e-9)
            assert r.soiling_loss == pytest.approx(0.08 * (1 - math.exp(-eq / 15)), abs=1e-12)


def test_equivalent_days_survive_extreme_histories(spark):
    """Thousands of near-complete rains without a reset, and long dust: no overflow, no NaN."""
    data = {1: [(9.9, 20.0)] * 400, 2: [(0.0, 500.0)] * 400, 3: [(9.9, 20.0)] * 200 + [(0.0, 20.0)] * 200}
    got = SO.equivalent_days(daily(spark, data)).orderBy("cell_id", "day").collect()
    for c, rows in data.items():
        mine = [r.soiling_loss for r in got if r.cell_id == c]
        for loss, eq in zip(mine, naive_eq(rows)):
            want = 0.08 * (1 - math.exp(-min(eq, 1e6) / 15))
            assert loss == pytest.approx(want, abs=1e-9)


def test_recovery_matches_two_day_loops(spark):
    data = {c: random_series(50 + c, 150) for c in range(4)}
    clean = DAY0 + dt.timedelta(days=40)
    s = SO.equivalent_days(daily(spark, data)).withColumn("clean_day", F.lit(clean))
    got = {r.cell_id: r for r in SO.recovery_of_clean(s, ("cell_id",), "clean_day", efficacy=0.9).collect()}
    for c, rows in data.items():
        loss = lambda e: 0.08 * (1 - math.exp(-e / 15))
        a, b = [loss(e) for e in naive_eq(rows)], [loss(e) for e in naive_eq(rows, 40, 0.9)]
        assert got[c].recovery_frac == pytest.approx(sum(x - y for x, y in zip(a, b)) / sum(a), abs=1e-9)


def test_calendar_agrees_with_single_cleans(spark):
    data = {1: random_series(7, 120)}
    s = SO.equivalent_days(daily(spark, data))
    cal = {r.clean_day: r for r in SO.recovery_calendar(s, ("cell_id",), stride=20).collect()}
    for day, row in cal.items():
        one = SO.recovery_of_clean(s.withColumn("clean_day", F.lit(day)), ("cell_id",), "clean_day").first()
        assert row.recovery_frac == pytest.approx(one.recovery_frac, abs=1e-12)
        assert row.benefit_days == one.benefit_days


def test_kimber_matches_the_day_loop(spark):
    data = {c: random_series(90 + c) for c in range(3)}
    got = {(r.cell_id, r.day): r.kimber_ratio for r in SO.kimber_ratio(daily(spark, data)).collect()}
    for c, rows in data.items():
        cur = 1.0
        for i, (p, pm) in enumerate(rows):
            cur = 1.0 if p >= 1 else max(0.0, cur - 0.0006 * pm)
            assert got[(c, DAY0 + dt.timedelta(days=i))] == pytest.approx(cur, abs=1e-9)


def test_result_does_not_depend_on_partitioning(spark):
    d = daily(spark, {c: random_series(c, 60) for c in range(5)})
    base = sorted(map(tuple, SO.equivalent_days(d).select("cell_id", "day", "eq_days").collect()))
    for n in (1, 7, 64):
        assert sorted(map(tuple, SO.equivalent_days(d.repartition(n)).select("cell_id", "day", "eq_days").collect())) == base


def test_parameters_are_the_published_ones():
    assert SOILING == {"sl_sat": 0.08, "k": 15.0, "heavy_rain_mm": 10.0, "rain_min_mm": 1.0, "pm10_dust_threshold": 50.0, "pm10_dust_scale": 0.02}
