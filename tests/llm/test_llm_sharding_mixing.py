from __future__ import annotations

import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from dustledger.llm import mixing, sharding
from llm_cases import awkward_rows, frame, sentence


def test_longest_first_is_the_greedy_schedule():
    rng = random.Random(1)
    items = [(f"g{k}", rng.randrange(1, 100)) for k in range(200)] + [("tie1", 50), ("tie2", 50)]
    loads, naive = [0] * 7, {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        shard = loads.index(min(loads))
        naive[key] = shard
        loads[shard] += size
    assert dict(sharding.longest_first(items, 7)) == naive


def test_documents_are_dealt_whole_groups_by_bytes(spark):
    rng = random.Random(2)
    texts = [sentence(rng, rng.randrange(1, 80)) for _ in range(600)]
    rows = [(k, rng.choice(texts), "en", "a") for k in range(3000)]
    got = sharding.document_shards(frame(spark, rows), 8).collect()
    assert len(got) == 3000
    load, slots, home = collections.Counter(), collections.defaultdict(list), {}
    text = {r[0]: r[1] for r in rows}
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert home.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8


def test_slots_stay_gapless_over_several_chunks(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("g"), F.lit(7).alias("n"), F.lit(1).alias("slot"))
    got = sharding.assign_shards(rows, F.col("g"), F.col("n"), ["doc_id"], shards=3, rows_per_chunk=100).collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(5000))


def test_sharding_awkward_and_empty(spark):
    rows = awkward_rows()
    got = sharding.document_shards(frame(spark, rows), 4).collect()
    assert len(got) == len(rows)
    assert {r["size"] for r in got if r["doc_id"] in (4, 5)} == {16} and {r["text_crc32"] for r in got if r["doc_id"] in (4, 5)} == {0}
    assert len({r["shard"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert sharding.document_shards(frame(spark, []), 4).count() == 0


def test_exponents():
    assert mixing.repetition_exponent(10, 10, 2.0) == 0.0
    x = mixing.repetition_exponent(10, 1000, 4.0)
    assert (1000 / 10) ** (1 - x) <= 4.0 < (1000 / 10) ** (1 - x + 1e-5)


def test_mix_meets_entropy_and_budget(spark):
    rng = random.Random(5)
    rows = [(k, sentence(rng, rng.randrange(1, 30)), "en", rng.choices("abcd", (70, 20, 7, 3))[0]) for k in range(1200)]
    units = mixing.document_units(frame(spark, rows))
    size = {r["source"]: r["t"] for r in units.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = sum(size.values())
    assert total == sum(len(t.split()) for _, t, _, _ in rows)
    plan = {r["source"]: r for r in mixing.mixing_plan(units, entropy=0.9, budget=total).collect()}
    weights = [r["weight"] for r in plan.values()]
    assert abs(-sum(w * math.log(w) for w in weights) - 0.9 * math.log(4)) < 1e-4 and abs(sum(weights) - 1) < 1e-9
    got = mixing.mixed_order(frame(spark, rows), entropy=0.9, budget="corpus").collect()
    for source, r in plan.items():
        own = sorted((g for g in got if g["source"] == source), key=lambda g: (g["position"], g["tokens"]))
        read = sum(g["tokens"] for g in own)
        assert r["budget"] <= read < r["budget"] + 30
        at = 0
        for g in own:
            assert g["position"] == at
            at += g["tokens"]
        for epoch in range(r["passes"]):
            once = [g["doc_id"] for g in own if g["epoch"] == epoch]
            assert sorted(once) == sorted(k for k, _, _, s in rows if s == source)
        orders = [tuple(g["doc_id"] for g in own if g["epoch"] == e) for e in range(r["passes"])]
        assert len(set(orders)) == len(orders)


def test_cover_mix_keeps_every_document_within_the_limit(spark):
    rng = random.Random(6)
    rows = [(k, sentence(rng, 20), "en", "hot" if k % 3 else f"s{k % 5}") for k in range(900)] + [(900, "", "en", "blank"), (901, None, None, None)]
    docs = frame(spark, rows)
    got = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(docs, repetition=2.0).select("doc_id").collect())
    assert set(got) == {r[0] for r in rows} and max(got.values()) <= 3
    hot = sum(got[r[0]] for r in rows if r[3] == "hot")
    assert hot == sum(r[3] == "hot" for r in rows)
    for source in {f"s{k}" for k in range(5)}:
        own = [r[0] for r in rows if r[3] == source]
        assert sum(got[k] for k in own) <= 2.0 * len(own) + 1
    assert mixing.mixed_documents(docs, repetition=2.0).columns == docs.columns


def test_mixing_awkward_and_empty(spark):
    rows = awkward_rows()
    got = mixing.mixed_documents(frame(spark, rows), repetition=3.0).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got).keys() == {(r[0], r[1]) for r in rows}
    assert sum(r["doc_id"] == 2 for r in got) % 2 == 0
    assert mixing.mixed_order(frame(spark, rows), entropy=0.9, budget="corpus").count() > 0
    assert mixing.mixed_order(frame(spark, []), entropy=0.9, budget="corpus").count() == 0
    assert mixing.mixed_documents(frame(spark, []), repetition=2.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mixing_plan(mixing.document_units(frame(spark, rows)), repetition=1.0, budget=10**9)
