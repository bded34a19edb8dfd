"""Dissolved outlines: plans that scale, walks that cross many tiles, and crossings far from the origin."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from test_rings import ell, frame, linked, scatter, sides

from dustledger.functions import planar
from dustledger.operators import rings as R


def union_area(rings) -> float:
    """Area of a union by slabs between all corners and crossings; in a slab all edges are straight and none cross."""
    edges = [s for r in rings for s in sides(r)]
    xs = {a[0] for a, _ in edges}
    for (ax, ay), (bx, by) in edges:
        for (cx, cy), (dx, dy) in edges:
            den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den if den else -1
            if 0 < t < 1:
                xs.add(ax + t * (bx - ax))
    total, xs = 0.0, sorted(xs)
    for lo, hi in zip(xs, xs[1:]):
        x, runs = (lo + hi) / 2, []
        for r in rings:
            ys = sorted(a[1] + (x - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) for a, b in sides(r) if (a[0] <= x) != (b[0] <= x))
            runs += list(zip(ys[::2], ys[1::2]))
        reach = -np.inf
        for a, b in sorted(runs):
            total += max(0.0, b - max(a, reach)) * (hi - lo)
            reach = max(reach, b)
    return total


def test_the_query_has_no_task_per_outline_no_broadcast_and_no_ring_judged_in_the_scan(spark, monkeypatch):
    from __spark_entry__ import queries

    plans, keep = [], R.durable
    for module in ("dustledger.operators.rings", "dustledger.operators.components"):
        monkeypatch.setattr(f"{module}.durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    out = queries()["d22_dissolved_outlines"](spark, "/root/testdata/sf0.001")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6
    for plan in plans:
        # a call of Python per walk costs milliseconds; sides as large as the input are not built in the driver
        assert "FlatMapGroupsInPandas" not in plan and "BroadcastHashJoin" not in plan
        # files of few narrow columns are read by few tasks: rings are judged where they have been dealt
        assert not [line for line in plan.splitlines() if "Filter" in line and "lambdafunction" in line and "CASE WHEN" in line]


def test_crossings_far_from_the_origin_meet(spark):
    """Both edges of a crossing are cut in one point, also where a coordinate has few digits left."""
    rng = random.Random(11)
    rings, want = [], {}
    for g in range(300):
        near = []
        for _ in range(5):
            c = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(3)]
            near.append([(x + 40 * g, y) for x, y in c])
        want[f"g{g}"] = union_area([[(round(x, 6), round(y, 6)) for x, y in r] for r in near])
        rings += [(len(rings) + k, [(x + 4e6, y + 5e6) for x, y in r], f"g{g}") for k, r in enumerate(near)]
    got = defaultdict(float)
    for row in R.dissolve(frame(spark, rings), "g").collect():
        got[row["g"]] += row["area"]
    assert max(abs(got[g] - a) for g, a in want.items()) < 1e-3


@pytest.mark.parametrize("cell", [0.2, 3.0])
def test_outlines_across_many_tiles(spark, cell):
    """Tiles of 3.2 and 48 m: edges, walks and holes that cross many of them give the features of one tile."""
    rng = random.Random(12)
    rings = [(k, ell(rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(3, 12), rng.uniform(3, 12), rng.choice("LCVB")), f"g{k % 3}") for k in range(60)]
    rings += [(100, ell(0, 0, 60, 2, "B"), "h"), (101, ell(0, 58, 60, 2, "B"), "h"), (102, ell(0, 0, 2, 60, "B"), "h"), (103, ell(58, 0, 2, 60, "B"), "h"),
              (104, ell(20, 20, 9, 9, "C"), "h"), (105, ell(20, 20, 9, 9, "C"), "h"), (106, ell(-7, -7, 3, 3, "V"), "h")]

    def features(size):
        return sorted((r["g"], round(r["area"], 5), len(r["ring"]), sorted(map(len, r["holes"]))) for r in R.dissolve(frame(spark, rings), "g", cell=size).collect())

    got = features(cell)
    assert got == features(400.0)
    for g in ("g0", "g1", "g2", "h"):
        assert abs(sum(a for h, a, *_ in got if h == g) - union_area([r for _, r, h in rings if h == g])) < 1e-3
    assert [(a, len(holes)) for g, a, _, holes in got if g == "h" and a > 100] == [(464.0, 1)]


def test_clusters_across_many_tiles_equal_union_find(spark):
    rng = random.Random(13)
    rings = scatter(rng, 120, 110)
    rings += [(200 + k, ell(150 + k * 0.01, 150, 5, 5, "C"), "a") for k in range(40)]  # a heap
    rings += [(300, ell(200, 200, 90, 70, "B"), "a"), (301, ell(230, 230, 3, 3, "L"), "a"), (302, ell(292.5, 200, 3, 3, "B"), "a"), (303, ell(298.1, 200, 3, 3, "B"), "a")]
    want = linked(rings, 2.5)
    assert want[302] == 300 and want[303] == 303
    for cell in (0.7, 25.0):
        assert {r["id"]: r["component"] for r in R.ring_clusters(frame(spark, rings), "id", cell=cell).collect()} == want


def test_places_are_whole_and_results_do_not_hang_on_batches(spark, monkeypatch):
    """Tables of a few rows, pairs a few at a time: the same features."""
    rng = random.Random(14)
    rings = [(k, ell(rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(3, 12), rng.uniform(3, 12), rng.choice("LCVB")), f"g{k % 5}") for k in range(80)]

    def features():
        return sorted((r["g"], round(r["area"], 5), len(r["ring"]), len(r["holes"])) for r in R.dissolve(frame(spark, rings), "g", cell=1.0).collect())

    want, keep = features(), R._in_places
    monkeypatch.setattr(R, "_in_places", lambda df, keys, kernel, schema: keep(df, keys, kernel, schema, rows=3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert features() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # pairs in parts: each edge's marks come whole
    e = np.array([[0.0, 0.0, 4.0, 4.0], [0.0, 4.0, 4.0, 0.0], [1.0, 0.0, 1.0, 4.0], [0.0, 2.5, 4.0, 2.5]]).T
    tile = (np.zeros(4, np.int64), np.zeros(4, np.int64))
    args = (np.zeros(4, np.int64), np.arange(4), e, tile, 20.0, 16, 6)
    whole = [sorted(zip(*(c.tolist() for c in m))) for _, m in planar.cut_marks(*args)]
    monkeypatch.setattr(planar.slices, "__defaults__", (1,))
    parts = [sorted(zip(*(c.tolist() for c in m))) for _, m in planar.cut_marks(*args)]
    assert len(whole) == 1 and len(parts) == 4 and sorted(sum(parts, [])) == whole[0] and len(whole[0]) == 12
