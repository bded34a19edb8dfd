from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from dustledger.llm import merkle, queries
from llm_cases import awkward_rows, frame, sentence


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def grow(level):
    """All levels from the leaves to the one node on top."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k:k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def walk(levels, at):
    """(digit, siblings) of every level below the top."""
    out = []
    for level in levels[:-1]:
        run = level[at - at % 3:at - at % 3 + 3]
        out.append((at % 3, [d for k, d in enumerate(run) if k != at % 3]))
        at //= 3
    return out


def naive(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, text, lang, source, n_chars)."""
    by_source = {}
    for i, text, lang, source, n in rows:
        head = coded(i) + coded(source) + coded(lang) + coded(n)
        other = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        by_source.setdefault(b"-" if source is None else b"=" + source.encode(), []).append((i is not None, i or 0, digest(head, coded(text)), digest(head, coded(other)), i))
    trees = {s: grow([leaf for _, _, leaf, _, _ in sorted(v, key=lambda x: x[:3])]) for s, v in sorted(by_source.items())}
    top = grow([t[-1][0] for t in trees.values()]) if trees else None
    out = []
    for place, (s, tree) in enumerate(trees.items()):
        for at, (_, _, leaf, other, i) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = walk(tree, at) + walk(top, place)
            folded = other
            for digit, siblings in path:
                folded = digest(*siblings[:digit], folded, *siblings[digit:])
            out.append((i, leaf, tree[-1][0], top[-1][0], digest(*[d for _, own in path for d in own]), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def asked(spark, tmp_path, rows, name):
    frame(spark, [r[:4] for r in rows]).repartition(5).write.parquet(str(tmp_path / name / "documents.parquet"))
    return sorted(map(tuple, queries.LLM_QUERIES["op11_content_addressed_descent"](spark, str(tmp_path / name)).collect()), key=str)


def case(rows):
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.mark.parametrize("depth", (1, 2, 4))
def test_proofs_equal_brute_force(spark, tmp_path, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "SPAN", 3**depth)
    rng = random.Random(depth)
    sizes = {"hot": 250 if depth > 1 else 60, "one": 1, "two": 2, "three": 3, "four": 4, "nine": 9, "ten": 10, "ünï": 28, None: 27, "": 5}
    rows = [(rng.randrange(4000), "\n".join(sentence(rng, 4) for _ in range(rng.randrange(3))), "en", s) for s, n in sizes.items() for _ in range(n)]
    rows += [rows[5]] * 100  # repeated rows: equal records
    assert asked(spark, tmp_path, rows, "many") == naive(case(rows))


def test_awkward_single_and_empty_tables(spark, tmp_path):
    assert asked(spark, tmp_path, awkward_rows(), "awkward") == naive(case(awkward_rows()))
    for name, rows in (("single", [(4, "a\nb", "en", "s")]), ("source", [(k, "a\nb", "en", "s") for k in range(5)]), ("sources", [(k, None, None, f"s{k}") for k in range(5)])):
        assert asked(spark, tmp_path, rows, name) == naive(case(rows))
    assert asked(spark, tmp_path, [], "empty") == []


def test_some_requests_and_unknown_ones(spark):
    leaves = merkle.ranked(spark.range(100).select(F.lit("g").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), "id"), "g", ["id"])
    stores, tops = merkle.build(leaves.withColumnRenamed("leaf", "digest"), "g")
    requests = spark.createDataFrame([("g", 0, "a"), ("g", 57, "b"), ("g", 57, "c"), ("g", 99, "d"), ("g", 100, "x"), ("g", -1, "x"), ("h", 0, "x")], "g string, rank long, tag string")
    got = {r["tag"]: r for r in merkle.descend(stores, tops.withColumn("root", F.col("digest")), requests, "g").collect()}
    tree = grow([digest(str(k)) for k in range(100)])
    assert set(got) == {"a", "b", "c", "d"}
    for tag, at in (("a", 0), ("b", 57), ("c", 57), ("d", 99)):
        assert got[tag]["root"] == tree[-1][0]
        assert [(s["digit"], list(s["siblings"])) for s in got[tag]["path"]] == walk(tree, at)
