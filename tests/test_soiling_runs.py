"""Soiling runs and the draws of the soiling ratio against naive loops, and the shape of their plans."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from dustledger.functions.digests import uniform_pairs
from dustledger.functions.numeric import draw_key, uniform
from dustledger.operators import series as S, telemetry as TE

DAY0 = dt.date(2020, 1, 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _sawtooth(spark, systems=(1, 2, 3), days=500):
    """Ramps between washes with scatter and missing days; system 3 has few values."""
    rnd = random.Random(11)
    rows = []
    for s in systems:
        level = 1.0
        for i in range(days):
            level = 1.0 if rnd.random() < 0.03 else level - 0.002
            seen = rnd.random() < (0.02 if s == 3 else 0.6)
            rows.append((s, DAY0 + dt.timedelta(days=i), level + rnd.gauss(0, 0.0005) if seen else None, 4.0 + i % 3 if seen else None))
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "system_id long, day date, pi double, insolation double")


def _quantile(values, q):
    v = sorted(values)
    at = (len(v) - 1) * q
    return v[math.floor(at)] + (at - math.floor(at)) * (v[math.ceil(at)] - v[math.floor(at)])


def _naive_runs(rows, half=6):
    """{run: (days, values, weight)} of one series, day by day."""
    rows = sorted(rows, key=lambda r: r[1])
    base = median([r[2] for r in rows if r[2] is not None and r[1] < rows[0][1] + dt.timedelta(days=365)])
    pin = [None if r[2] is None else r[2] / base for r in rows]
    level = [median(f) if (f := [p for p in pin[max(0, i - half):i + half + 1] if p is not None]) else None for i in range(len(pin))]
    step = [None] + [None if a is None or b is None else b - a for a, b in zip(level, level[1:])]
    size = [abs(s) for s in step if s is not None]
    limit = _quantile(size, 0.75) + 1.5 * (_quantile(size, 0.75) - _quantile(size, 0.25))
    run, out = 0, {}
    for i, r in enumerate(rows):
        around = [s for s in step[max(0, i - half):i + half + 1] if s is not None]
        run += step[i] is not None and step[i] > limit and step[i] == max(around)
        t, y, w = out.setdefault(run, ([], [], []))
        if pin[i] is not None:
            t.append((r[1] - dt.date(1970, 1, 1)).days)
            y.append(pin[i])
            w.append(r[3])
    return {k: v for k, v in out.items() if v[0]}


def test_runs_of_series_by_a_naive_loop(spark):
    rows, index = _sawtooth(spark)
    out = TE.soiling_intervals(index, "system_id")
    # the days of a series meet once; no frame of days is sorted again for every day
    assert "percentile" not in plan_of(out)
    got = {(r["system_id"], r["run"]): r for r in out.collect()}
    want = {(s, k): v for s in (1, 2, 3) for k, v in _naive_runs([r for r in rows if r[0] == s]).items()}
    assert set(got) == set(want) and len(want) > 20
    for key, (t, y, w) in want.items():
        r = got[key]
        assert (r["n_days"], r["n_obs"]) == (len(t), len(t)) and r["d0"] <= t[0] and r["d1"] >= t[-1]
        assert r["w"] == pytest.approx(sum(w)) and r["wt"] == pytest.approx(sum(a * b for a, b in zip(w, t)))
        if len(t) < 3:
            assert r["slope"] is None and r["start"] is None
            continue
        slopes = sorted((y[j] - y[i]) / (t[j] - t[i]) for i in range(len(t)) for j in range(i + 1, len(t)))
        assert r["slope"] == pytest.approx(slopes[round(0.5 * (len(slopes) - 1))], abs=1e-12)
        assert r["start"] == pytest.approx(median(b - r["slope"] * (a - t[0]) for a, b in zip(t, y)), abs=1e-12)
        assert r["slope_lo"] <= r["slope"] <= r["slope_hi"]


def test_runs_fitted_together_equal_runs_fitted_alone():
    rnd = np.random.default_rng(3)
    for n in (3, 4, 17, 128, 130, 1500):
        t, y = np.sort(rnd.choice(4000, (2, n)) + rnd.random((2, n)), axis=1), rnd.normal(size=(2, n))
        assert TE._theil_sen_rows(t, y).tolist() == [list(TE._theil_sen(*row)) for row in zip(t, y)]


def test_series_without_days_values_or_insolation(spark):
    day = [DAY0 + dt.timedelta(days=i) for i in range(30)]
    rows = [(1, d, None, 5.0) for d in day] + [(2, d, 0.0, 5.0) for d in day] + [(3, d, 1.0 - 0.001 * i, None) for i, d in enumerate(day)] + [(3, None, 0.5, 5.0), (4, day[0], 0.9, 5.0)]
    index = spark.createDataFrame(rows, "system_id long, day date, pi double, insolation double")
    got = {r["system_id"]: r for r in TE.soiling_intervals(index, "system_id").collect()}
    # no value, or a first year without a level: no run
    assert set(got) == {3, 4} and got[4]["slope"] is None and not got[4]["valid"]
    assert got[3]["valid"] and got[3]["w"] is None and got[3]["n_days"] == 30
    ratio = {r["system_id"]: r for r in TE.soiling_ratio(TE.soiling_intervals(index, "system_id"), "system_id", reps=20).collect()}
    assert ratio[3]["soiling_ratio"] is None and ratio[3]["n_valid"] == 1 and ratio[4]["n_valid"] == 0 and ratio[4]["degenerate"]


@pytest.mark.parametrize("key", ["7", "é" * 9, "x" * 90])
def test_draws_in_arrays_equal_the_draws_of_columns(spark, key):
    got = uniform_pairs(f"{key}|", 1000, ["|0|1234", "|317|1234"])
    k = [draw_key(F.lit(key), F.col("id") + 1, run, 1234) for run in (0, 317)]
    rows = spark.range(1000).select(*[uniform(x, slot).alias(f"u{i}{slot}") for i, x in enumerate(k) for slot in (0, 1)]).collect()
    assert got.tolist() == [[[r[f"u{i}0"], r[f"u{i}1"]] for r in rows] for i in (0, 1)]


@pytest.mark.parametrize("method", ["half_norm_clean", "perfect_clean"])
def test_ratio_draws_stay_inside_the_task(spark, method):
    reps = 60
    intervals = TE.soiling_intervals(_sawtooth(spark)[1], "system_id")
    out = TE.soiling_ratio(intervals, "system_id", method, reps=reps)
    plan = plan_of(out)
    # a system is one row: its draws are no rows, and its runs are made once
    assert "Generate" not in plan and "Join" not in plan and plan.count("FlatMapGroupsInArrow") == 1
    got = {r["system_id"]: r for r in out.collect()}
    runs = intervals.collect()
    assert set(got) == {r["system_id"] for r in runs}
    for s in got:
        valid = sorted((r for r in runs if r["system_id"] == s and r["valid"]), key=lambda r: r["run"])
        assert (got[s]["n_intervals"], got[s]["n_valid"]) == (sum(r["system_id"] == s for r in runs), len(valid))
        ratios = []
        for rep in range(1, reps + 1):
            num, den, stop = 0.0, 0.0, 1.0
            for r in valid:
                digest = hashlib.md5(f"{s}|{rep}|{r['run']}|1234".encode()).hexdigest()
                u = [(int(digest[6 * k:6 * k + 6], 16) + 0.5) / 2.0**24 for k in (0, 1)]
                z = [math.sqrt(-2 * math.log(u[0])) * f(2 * math.pi * u[1]) for f in (math.cos, math.sin)]
                slope = min(0.0, r["slope"] + z[0] * (r["slope_hi"] - r["slope_lo"]) / 2)
                reach = max(0.0, min(1.0, stop + r["recovery"]))
                start = 1.0 if method == "perfect_clean" else min(1.0, abs(z[1] * (1 - reach) / 3) + reach)
                num, den = num + start * r["w"] + slope * (r["wt"] - r["d0"] * r["w"]), den + r["w"]
                stop = start + slope * (r["d1"] - r["d0"])
            ratios.append(num / den if den else None)
        if valid:
            for name, q in (("soiling_ratio", 0.5), ("ci_lo", 0.025), ("ci_hi", 0.975)):
                assert got[s][name] == pytest.approx(_quantile(ratios, q), abs=1e-9)
        else:
            assert got[s]["soiling_ratio"] is None and got[s]["degenerate"]


def test_start_levels_make_the_runs_once(spark):
    intervals = TE.soiling_intervals(_sawtooth(spark)[1], "system_id")
    per, total = TE.interval_starts(intervals, "system_id")
    assert "FlatMapGroups" not in plan_of(per) and "FlatMapGroups" not in plan_of(total)
    starts = {}
    for r in intervals.filter("valid").collect():
        starts.setdefault(r["system_id"], []).append(r["start"])
    assert {r["system_id"]: r["median_start"] for r in per.collect()} == pytest.approx({s: median(v) for s, v in starts.items()})
    assert total.first()["median_of_medians"] == pytest.approx(median([median(v) for v in starts.values()]))


def test_densify_without_a_grid(spark):
    day = [DAY0 + dt.timedelta(days=i) for i in range(8)]
    rows = [(1, day[5], 1.0), (1, day[0], 2.0), (1, day[2], 3.0), (1, day[2], 4.0), (1, None, 5.0), (2, day[7], None), (None, day[1], 6.0), (None, day[1], 7.0), (None, day[3], 8.0)]
    out = S.densify(spark.createDataFrame(rows, "cell_id long, day date, v double"))
    assert "Join" not in plan_of(out)
    want = [(1, day[0], 2.0), (1, day[1], None), (1, day[2], 3.0), (1, day[2], 4.0), (1, day[3], None), (1, day[4], None), (1, day[5], 1.0), (2, day[7], None),
            (None, day[1], None), (None, day[2], None), (None, day[3], None)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
