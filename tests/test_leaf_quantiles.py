"""Quantiles by leaf tuples against the plain weighted distribution of every row."""

from __future__ import annotations

import random
from collections import defaultdict

from dustledger.operators import learn as LE


def plain(train, test, quantiles):
    sizes, held = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for y, leaves in train:
        for t, leaf in enumerate(leaves):
            sizes[t, leaf] += 1
            if y is not None:
                held[t, leaf][y] += 1
    out = {}
    for key, leaves in test:
        mass = defaultdict(float)
        for t, leaf in enumerate(leaves):
            for y, m in held[t, leaf].items():
                mass[y] += m / sum(held[t, leaf].values())
        row, upto, whole = {}, 0.0, sum(mass.values())
        for y in sorted(mass):
            upto += mass[y]
            for n, q in quantiles.items():
                if upto >= q * whole - 1e-9:
                    row.setdefault(n, y)
        out[key] = tuple(row[n] for n in quantiles) if row else None
    return out


def test_leaf_quantiles_equal_the_plain_distribution(spark):
    rng = random.Random(3)
    quantiles = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    for n, values in ((400, 4000), (400, 12), (5, 3)):
        train = [(rng.randrange(values) / 8, [rng.randrange(5) for _ in range(3)]) for _ in range(n)] + [(None, [0, 0, 0])]
        test = [(k, [rng.randrange(5) for _ in range(3)]) for k in range(60)]
        tr = spark.createDataFrame(train, "y double, leaves array<int>")
        te = spark.createDataFrame(test, "k long, leaves array<int>")
        got = {r["k"]: tuple(r[n] for n in quantiles) for r in LE.leaf_quantiles(tr, te, "y", "k", "leaves", quantiles).collect()}
        assert got == {k: v for k, v in plain(train, test, quantiles).items() if v is not None}


def test_leaf_quantiles_without_rows(spark):
    tr = spark.createDataFrame([], "y double, leaves array<int>")
    te = spark.createDataFrame([(1, [0, 1])], "k long, leaves array<int>")
    assert LE.leaf_quantiles(tr, te, "y", "k", "leaves", {"p50": 0.5}).count() == 0
