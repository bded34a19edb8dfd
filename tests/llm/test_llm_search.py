from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from dustledger.llm import lexical_search
from llm_cases import awkward_rows, folded_words, frame, sentence


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "item_id long, text string, rank int, part string")


def naive(rows, items, top=50):
    docs = [(i, Counter(folded_words(t))) for i, t in rows if folded_words(t)]
    count, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    asked = defaultdict(set)
    for item, text in items:
        if text is not None:
            asked[item] |= set(folded_words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (minus, _, _, i) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, i, -minus))
    return sorted(out, key=str)


def found(docs, items, **options):
    return sorted(map(tuple, lexical_search.ranked_documents(docs, items, **options).collect()), key=str)


def test_ranking_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(900), sentence(rng, rng.choice((1, 3, 20, 80, 300)), rng.choice((30, 400, 3000))).upper()) for _ in range(700)]
    rows += [(1000 + k, rows[3][1]) for k in range(90)] + [(None, rows[3][1])] * 3  # ties beyond the fiftieth place
    items = [(k, sentence(rng, rng.choice((1, 4, 25, 90)), 400)) for k in range(30)] + [(40, rows[3][1]), (41, "no such word"), (42, None), (43, "?!"), (None, "w1x w2x")]
    items += [(7, "w5x w6x"), (7, "w6x w7x")]
    docs, asked = frame(spark, [(i, t, "en", "a") for i, t in rows]).repartition(7), benchmark(spark, items)
    want = naive(rows, items)
    assert found(docs, asked) == want
    assert found(docs, asked, most_terms=60) == want  # many blocks of items
    assert found(docs, asked, top=3) == naive(rows, items, 3)


def test_small_blocks_of_documents(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", 40)
    rng = random.Random(6)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([30] * 4), pa.array([[0] * 30] * 4), pa.array([[1] * 30] * 4)], ["doc_id", "n", "terms", "tfs"])
    assert [p.num_rows for p in lexical_search._parts(batch, 1)] == [1, 1, 1, 1]
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", 4_000_000)
    monkeypatch.setattr(lexical_search, "BLOCK_FLAGS", 100)
    assert [p.num_rows for p in lexical_search._parts(batch, 50)] == [2, 2]


def test_low_masks_are_not_scored():
    """Few documents hold the rare terms; once the list is full of them, those with the common term alone are skipped."""
    n = 5000
    terms = [[0, 1] if k < 60 else [0] for k in range(n)]
    batch = pa.RecordBatch.from_arrays([
        pa.array(range(n)), pa.array([20] * n), pa.array(terms, pa.list_(pa.int32())), pa.array([[1] * len(t) for t in terms], pa.list_(pa.int64()))],
        ["doc_id", "n", "terms", "tfs"])
    block = lexical_search._Block(batch, np.array([1, 4000], np.int64), n, 20 * n)
    best = lexical_search._Best(50)
    assert lexical_search.search_block(block, np.array([0, 1]), best) == 60
    assert best.ids.tolist() == list(range(50))


def test_awkward_and_empty_tables(spark):
    rows = [(i, t) for i, t, _, _ in awkward_rows()]
    items = [(1, "short"), (1, "short"), (None, "no id here"), (2, rows[11][1][:9000]), (3, ""), (4, "\u6f22\u5b57 na\u00efve 5678")]
    docs = frame(spark, awkward_rows())
    assert found(docs, benchmark(spark, items)) == naive(rows, items)
    assert found(docs, benchmark(spark, [])) == []
    assert found(frame(spark, []), benchmark(spark, items)) == []
