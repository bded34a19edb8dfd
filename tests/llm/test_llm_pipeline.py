"""The pipeline's stages against what each is to do on its own input."""

from __future__ import annotations

import collections
import os
import random

import pytest

import corpus_pipeline
from dustledger.llm import ngram_join
from llm_cases import SF, awkward_rows, folded_words, frame, sentence
from test_llm_dedup import components, naive_links
from test_llm_filters import naive_hits


def test_stages_are_listed_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "shard"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_every_stage_works_on_all_its_predecessor_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
    first, one_each, clean, mixed, dealt = (d.collect() for d in kept)
    assert all(d.columns == columns for d in kept[:4])
    rows = [(r["doc_id"], r["text"]) for r in first]
    assert len(rows) > 150
    comp = components([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in naive_links(rows)])
    assert sorted(r["doc_id"] for r in one_each) == sorted({comp[i] for i, _ in rows})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = []
    for r in one_each:
        n, hit, _ = naive_hits(r["text"], items)
        if not (hit and 20 * len(hit) >= n):
            expected.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in clean) == sorted(expected)
    times = collections.Counter(r["doc_id"] for r in mixed)
    assert set(times) == set(expected)
    assert sorted(r["doc_id"] for r in dealt) == sorted(times.elements())
    assert all(sorted(r["slot"] for r in dealt if r["shard"] == s) == list(range(sum(r["shard"] == s for r in dealt))) for s in range(40))
    final = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, final.collect()), key=str) == sorted(map(tuple, dealt), key=str)


def test_repeated_and_missing_ids_lose_copies_only(spark):
    rng = random.Random(8)
    a, b, c, d, e = (sentence(rng, 60) for _ in range(5))
    rows = [(1, a, "en", "a"), (1, b, "en", "a"), (2, b + " tail", "en", "a"), (3, c, "en", "a"), (3, c, "en", "a"), (None, c + " tail", "en", "a"),
            (None, d, "en", "a"), (None, d, "en", "a"), (None, d + " tail", "en", "a"), (4, e, "en", "a"), (5, e, "en", "a"), (6, None, "en", "a"), (None, None, "en", "a")]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each_group(spark, frame(spark, rows), "").collect()]
    loose = [text for i, text in got if i is None and text is not None]
    assert len(loose) == 1 and loose[0] in (d, d + " tail")
    named = [x for x in got if x != (None, loose[0])]
    assert sorted(named, key=str) == sorted([(1, a), (2, b + " tail"), (3, c), (4, e), (6, None), (None, None)], key=str)


def test_stages_take_awkward_and_empty_documents(spark, tmp_path):
    spark.createDataFrame([(1, "short")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for label, rows in (("awkward", awkward_rows()), ("empty", [])):
        docs = frame(spark, rows)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(str(tmp_path / label / name))
            docs = spark.read.parquet(str(tmp_path / label / name))
            assert name == "shard" or docs.columns == columns
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids == ({1, None, 4, 5, 6, 8, 11, 12, 2**53 + 1} if rows else set())
        assert corpus_pipeline.keep_known_languages(spark, frame(spark, rows), str(tmp_path)).columns == columns
    assert {r["doc_id"] for r in ngram_join.near_duplicates(frame(spark, awkward_rows())).filter("kept").collect()} >= {1, 4, 5, 6, 8}
