"""Polygons by their rings: distance, overlap, clipping, sites, identity and dissolved features against plain loops."""

from __future__ import annotations

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from dustledger.functions import overlay
from dustledger.operators import rings as R

RING = "array<struct<x:double,y:double>>"


def ell(x, y, w, h, kind):
    """Concave outlines: an L, a C open to the right, a slanted arrow, or a plain box."""
    if kind == "L":
        return [(x, y), (x + w, y), (x + w, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h), (x, y + h)]
    if kind == "C":
        return [(x, y), (x + w, y), (x + w, y + h / 4), (x + w / 4, y + h / 4), (x + w / 4, y + 3 * h / 4), (x + w, y + 3 * h / 4), (x + w, y + h), (x, y + h)]
    if kind == "V":
        return [(x, y), (x + w / 2, y + h / 3), (x + w, y), (x + w / 2, y + h)]
    return [(x, y), (x, y + h), (x + w, y + h), (x + w, y)]


def frame(spark, rings, extra="area_m2"):
    rows = [(i, [{"x": float(a), "y": float(b)} for a, b in r], abs(area(r)), g) for i, r, g in rings]
    return spark.createDataFrame(rows, f"id long, ring {RING}, area_m2 double, g string")


def sides(r):
    return list(zip(r, r[1:] + r[:1]))


def area(r):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in sides(r)) / 2


def inside(x, y, r):
    odd = False
    for (ax, ay), (bx, by) in sides(r):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def point_gap(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def gap(r, s):
    if inside(*r[0], s) or inside(*s[0], r):
        return 0.0
    best = math.inf
    for a, b in sides(r):
        for c, d in sides(s):
            if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                return 0.0
            best = min(best, point_gap(a, c, d), point_gap(b, c, d), point_gap(c, a, b), point_gap(d, a, b))
    return best


def shared(r, s, steps=4000):
    """Overlap by many thin vertical strips."""
    lo, hi = max(min(x for x, _ in r), min(x for x, _ in s)), min(max(x for x, _ in r), max(x for x, _ in s))
    total = 0.0
    for k in range(steps if hi > lo else 0):
        x = lo + (hi - lo) * (k + 0.5) / steps
        runs = []
        for q in (r, s):
            ys = sorted(a[1] + (x - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) for a, b in sides(q) if (a[0] <= x) != (b[0] <= x))
            runs.append(list(zip(ys[::2], ys[1::2])))
        total += sum(max(0, min(p[1], q[1]) - max(p[0], q[0])) for p in runs[0] for q in runs[1]) * (hi - lo) / steps
    return total


def scatter(rng, n, width, kinds="LCVB"):
    return [(k, ell(rng.uniform(0, width), rng.uniform(0, width), rng.uniform(2, 9), rng.uniform(2, 9), rng.choice(kinds)), "a") for k in range(n)]


def linked(rings, within):
    root = {i: i for i, _, _ in rings}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, r, _ in rings:
        for j, s, _ in rings:
            if i < j and gap(r, s) <= within:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _, _ in rings}


def test_gap_and_overlap_equal_loops(spark):
    rng = random.Random(1)
    rings = scatter(rng, 16, 22)
    rings += [(90, ell(0, 0, 20, 20, "B"), "a"), (91, ell(5, 5, 2, 2, "L"), "a"), (92, ell(20, 0, 4, 4, "B"), "a"), (93, ell(7, 6, 10, 4, "B"), "a")]
    a = frame(spark, rings)
    pairs = a.select("id", "ring").join(a.select(F.col("id").alias("j"), F.col("ring").alias("other")), how="cross").filter("id < j")
    got = pairs.select("id", "j", overlay.ring_gap(F.col("ring"), F.col("other")).alias("gap"), overlay.intersection_area(F.col("ring"), F.col("other")).alias("both")).collect()
    shape = {i: r for i, r, _ in rings}
    for row in got:
        r, s = shape[row["id"]], shape[row["j"]]
        assert abs(row["gap"] - gap(r, s)) < 1e-9, (row, r, s)
        assert abs(row["both"] - shared(r, s)) < 2e-2, (row, r, s)
    assert sum(row["both"] > 0 for row in got) > 15


def test_clipped_rings_have_the_area_of_the_overlap(spark):
    rng = random.Random(2)
    rings = scatter(rng, 40, 8)
    box = (3.0, 3.0, 8.0, 7.0)
    rows = frame(spark, rings).select("id", overlay.clip_to_box(F.col("ring"), *[F.lit(v) for v in box]).alias("c")).collect()
    window = [(3, 3), (8, 3), (8, 7), (3, 7)]
    for row in rows:
        cut = [(p["x"], p["y"]) for p in row["c"]]
        assert all(3 - 1e-9 <= x <= 8 + 1e-9 and 3 - 1e-9 <= y <= 7 + 1e-9 for x, y in cut)
        assert abs((abs(area(cut)) if cut else 0.0) - shared(rings[row["id"]][1], window)) < 2e-2


def test_clusters_equal_union_find(spark):
    rng = random.Random(3)
    rings = scatter(rng, 150, 130)
    rings += [(200 + k, ell(300 + k * 0.01, 300, 5, 5, "C"), "a") for k in range(60)]  # a heap
    rings += [(300, ell(400, 400, 80, 80, "B"), "a"), (301, ell(430, 430, 3, 3, "L"), "a"), (302, ell(500, 400, 90, 80, "C"), "a"), (303, ell(540, 430, 5, 5, "B"), "a")]
    rings += [(304, rings[0][1], "a"), (305, ell(600, 600, 4, 4, "B"), "a"), (306, ell(605, 604, 4, 4, "B"), "a"), (307, ell(612, 600, 4, 4, "B"), "a")]
    got = {r["id"]: r["component"] for r in R.ring_clusters(frame(spark, rings), "id").collect()}
    assert got == linked(rings, 2.5)
    assert got[301] == 300 and got[303] == 303  # inside the box; in the opening of the C
    assert R.ring_clusters(frame(spark, []), "id").count() == 0


def test_sites_use_the_point_inside_the_ring(spark):
    c = ell(0, 0, 10, 10, "C")
    rings = frame(spark, [(0, c, "a"), (1, ell(12, 0, 4, 4, "B"), "a"), (2, ell(500, 500, 4, 4, "B"), "a"), (3, ell(505, 500, 4, 4, "B"), "a")])
    lots = frame(spark, [(7, [(-1, -1), (3, -1), (3, 11), (-1, 11)], "a"), (8, [(11, -1), (30, -1), (30, 30), (11, 3)], "a")])
    got = {r["id"]: (r["site_id"], r["site_source"]) for r in R.assign_ring_sites(rings, lots.select(F.col("id").alias("lot"), "ring"), "id", "lot").collect()}
    assert got == {0: ("apn:7", "parcel"), 1: ("apn:8", "parcel"), 2: ("prox:2", "proximity"), 3: ("prox:2", "proximity")}


def test_neighbours_equal_loops(spark):
    rng = random.Random(4)
    rings = scatter(rng, 60, 400)
    rings += [(100, rings[5][1], "a"), (101, rings[5][1], "a"), (102, ell(2000, 2000, 5, 5, "L"), "a"), (103, ell(2080, 2080, 5, 5, "L"), "a")]
    want = {}
    for i, r, _ in rings:
        mine = []
        for j, s, _ in rings:
            box = lambda q: (min(x for x, _ in q), min(y for _, y in q), max(x for x, _ in q), max(y for _, y in q))
            a, b = box(r), box(s)
            if i != j and a[0] <= b[2] + 100 and b[0] <= a[2] + 100 and a[1] <= b[3] + 100 and b[1] <= a[3] + 100:
                mine.append((gap(r, s), abs(area(s))))
        far = [x for g, x in mine if g <= 100]
        want[i] = (sum(g <= 50 for g, _ in mine), len(far), min((g for g, _ in mine), default=None), sum(far) / len(far) if far else None)
    for row in R.ring_neighbours(frame(spark, rings), "id").collect():
        n, m, d, mean = want[row["id"]]
        assert (row["n_near"], row["n_far"]) == (n, m)
        assert (row["nearest_m"] is None) == (d is None) and (d is None or abs(row["nearest_m"] - d) < 1e-9)
        assert (mean is None) == (row["mean_area_far"] is None) and (mean is None or abs(row["mean_area_far"] - mean) < 1e-9)


def test_identity_follows_the_ring_and_not_the_box(spark):
    before = frame(spark, [(1, ell(0, 0, 10, 10, "C"), "a"), (2, ell(50, 0, 10, 10, "L"), "a"), (3, ell(90, 0, 3, 3, "B"), "a")])
    # a small box in the opening of the C: the boxes overlap, the rings do not
    after = frame(spark, [(11, ell(3, 3, 6.9, 4, "B"), "a"), (12, ell(51, 0, 10, 10, "L"), "a"), (13, ell(93.5, 0, 3, 3, "B"), "a")])
    got = {(r["curr_id"], r["prev_id"], r["status"]) for r in R.carry_ring_identity(before.select(F.col("id").alias("p"), "ring"), after.select(F.col("id").alias("c"), "ring"), "p", "c").collect()}
    assert got == {(11, 1, "matched"), (12, 2, "matched"), (13, 3, "matched")}
    centre = R.carry_ring_identity(before.select(F.col("id").alias("p"), "ring"), after.select(F.col("id").alias("c"), "ring"), "p", "c", max_shift=1.0).collect()
    assert {(r["curr_id"], r["prev_id"], r["status"]) for r in centre} == {(11, None, "new"), (12, 2, "matched"), (13, None, "new"), (None, 1, "dropped"), (None, 3, "dropped")}


def squares(cells):
    """4-connected parts of a set of unit squares."""
    left, parts = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in left:
                    left.discard(q)
                    todo.append(q)
        parts.append(part)
    return parts


def test_dissolved_features_equal_filled_squares(spark):
    """Rectilinear outlines on whole numbers: area, shells and holes are counted on the grid."""
    rng = random.Random(5)
    rings, want = [], {}
    for g in range(12):
        filled = set()
        for k in range(rng.randrange(2, 14)):
            x, y, w, h = rng.randrange(14), rng.randrange(14), 4 * rng.randrange(1, 3), 4 * rng.randrange(1, 3)
            outline = ell(x, y, w, h, rng.choice("LCB"))
            filled |= {(a, b) for a in range(x, x + w) for b in range(y, y + h) if inside(a + 0.5, b + 0.5, outline)}
            rings.append((len(rings), outline if rng.random() < 0.5 else outline[::-1], f"g{g}"))
        span = range(-1, 30)
        empty = {(a, b) for a in span for b in span} - filled
        want[f"g{g}"] = (len(filled), sorted(map(len, squares(filled))), len(squares(empty)) - 1)
    got = defaultdict(list)
    for r in R.dissolve(frame(spark, rings), "g", cell=5.0).collect():
        shell = [(p["x"], p["y"]) for p in r["ring"]]
        holes = [[(p["x"], p["y"]) for p in h] for h in r["holes"]]
        assert area(shell) > 0 and all(area(h) < 0 for h in holes)
        assert abs(area(shell) + sum(map(area, holes)) - r["area"]) < 1e-6
        assert len(set(shell)) == len(shell)
        got[r["g"]].append((r["area"], len(holes)))
    for g, (total, parts, holes) in want.items():
        assert abs(sum(a for a, _ in got[g]) - total) < 1e-6, g
        assert sum(n for _, n in got[g]) == holes, g
        assert [round(a) for a, _ in sorted(got[g])] == parts, g


def test_dissolve_slanted_rings_holes_and_empty(spark):
    rng = random.Random(6)
    rings = [(k, ell(rng.uniform(0, 12), rng.uniform(0, 12), rng.uniform(3, 9), rng.uniform(3, 9), "V"), "v") for k in range(12)]
    frame_of = [(0, 0), (30, 0), (30, 30), (0, 30)]
    rings += [(50, [(0, 0), (30, 0), (30, 2), (0, 2)], "h"), (51, [(0, 28), (30, 28), (30, 30), (0, 30)], "h"), (52, [(0, 0), (2, 0), (2, 30), (0, 30)], "h"),
              (53, [(28, 0), (30, 0), (30, 30), (28, 30)], "h"), (54, [(10, 10), (14, 10), (12, 15)], "h"), (55, [(10, 10), (14, 10), (12, 15)], "h")]
    got = R.dissolve(frame(spark, rings), "g").collect()
    held = sorted((round(r["area"], 6), len(r["holes"])) for r in got if r["g"] == "h")
    assert held == [(10.0, 0), (900.0 - 26 * 26, 1)] and area(frame_of) == 900
    lo, hi, total = 0.0, 25.0, 0.0
    for k in range(6000):
        x, runs = lo + (hi - lo) * (k + 0.5) / 6000, []
        for _, r, g in rings:
            ys = sorted(a[1] + (x - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) for a, b in sides(r) if (a[0] <= x) != (b[0] <= x)) if g == "v" else []
            runs += list(zip(ys[::2], ys[1::2]))
        reach = -math.inf
        for a, b in sorted(runs):
            total += max(0.0, b - max(a, reach)) * (hi - lo) / 6000
            reach = max(reach, b)
    assert abs(sum(r["area"] for r in got if r["g"] == "v") - total) < 0.05
    assert R.dissolve(frame(spark, []), "g").count() == 0
