from __future__ import annotations

import collections
import math
import random

import numpy as np

from dustledger.llm import line_dedup, ngram_join, vector_dedup, words
from llm_cases import awkward_rows, folded_words, frame, sentence


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_folded_words_and_hashes():
    for text in ("Ab-cD é9", "", None, "É x y", "a" * 10):
        assert words.folded(text).decode() == " ".join(folded_words(text))
    long_text = words.folded(" ".join(f"w{k}" for k in range(400_000)))
    hashes = words.word_hashes(long_text)
    assert len(np.unique(hashes)) == 400_000
    assert (words.word_hashes(b"w399999 w7") == hashes[[399_999, 7]]).all()
    one, counts = words.shingles([b"a b c d e f", b"", b"a b", b"b c d e f"], 5)
    assert counts.tolist() == [2, 0, 1, 1] and one[1] == one[3]
    huge = words.word_hashes(b"x" * (1 << 21) + b" y")
    assert len(huge) == 2 and huge[1] == words.word_hashes(b"y")[0]


def test_forest_depth_shortens_until_the_recall_is_met():
    assert ngram_join.forest_depth(16, 8, 0.8, 0.999) == 4
    assert ngram_join.forest_depth(16, 8, 0.8, 0.0) == 8
    assert ngram_join.forest_depth(1, 8, 0.1, 0.999) == 1


def naive_links(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = folded_words(text)
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else None)
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1] is None or rows[b][1] is None:
                continue
            same = rows[a][1] == rows[b][1]
            if same or (sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold):
                pairs.append((a, b))
    return pairs


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    base = [sentence(rng, rng.randrange(3, 150)) for _ in range(60)]
    rows = []
    for k in range(500):
        w = base[rng.randrange(60)].split() if rng.random() < 0.7 else sentence(rng, 40).split()
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            w[rng.randrange(len(w))] = "edit"
        rows.append((k * 3, (" ".join(w)).upper() if k % 7 == 0 else ", ".join(w)))
    pairs = naive_links(rows)
    comp = components([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in pairs])
    degree = collections.Counter(rows[x][0] for p in pairs for x in p)
    docs = frame(spark, [(i, t, "en", "a") for i, t in rows])
    for block in (1 << 17, 600):  # whole components, and components cut into many chunks
        got = {r["doc_id"]: r for r in ngram_join.near_duplicates(docs, block=block).collect()}
        assert len(got) == 500
        assert {i: r["n_links"] for i, r in got.items()} == {i: degree[i] for i in got}
        assert {i: r["component_id"] for i, r in got.items()} == comp
        assert all(r["kept"] == (comp[i] == i) for i, r in got.items())


def test_near_duplicates_awkward_and_empty(spark):
    rows = awkward_rows()
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [r["n_links"] for r in by[1]] == [4] and [r["n_links"] for r in by[2]] == [4, 4] and by[3][0]["n_links"] == 4
    assert {r["component_id"] for i in (1, 2, 3) for r in by[i]} == {1} and by[1][0]["kept"] and not by[3][0]["kept"]
    assert by[6][0]["n_links"] == by[7][0]["n_links"] == 1 and by[7][0]["component_id"] == 6
    assert by[4][0]["n_links"] == by[5][0]["n_links"] == 0 and by[4][0]["kept"]
    assert by[9][0]["component_id"] == 8 and by[2**53 + 1][0]["class_id"] == 2**53 + 1
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, near int, node string, chunk int, key int")


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 32))
    rows = []
    for k in range(900):
        v = centres[rng.integers(30)] + rng.normal(size=32) * rng.choice([0.0, 0.05, 0.15, 0.3])
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(2)) if k % 3 else 0))
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    hit = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(hit, False)
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(vectors(spark, [(*r, 0, "n", 0, 0) for r in rows]), block=40).collect()}
    found = np.array([got[k]["n_links"] for k in range(900)])
    assert (found <= hit.sum(1)).all() and found.sum() >= 0.97 * hit.sum()
    comp = components(range(900), zip(*np.nonzero(hit)))
    assert np.mean([got[k]["component_id"] == comp[k] for k in range(900)]) > 0.99


def test_near_vectors_in_a_dense_third_of_the_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x[:1000] = rng.normal(size=64) + rng.normal(size=(1000, 64)) * 0.09
    x[1000:1300] = rng.normal(size=64) + rng.normal(size=(300, 64)) * 0.145
    x = x.astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = unit @ unit.T >= 0.98
    np.fill_diagonal(hit, False)
    assert hit[:1000, :1000].mean() > 0.99 and 0.05 < hit[1000:1300, 1000:1300].mean() < 0.95
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(vectors(spark, [(k, v.tolist(), 1, 0, "n", 0, 0) for k, v in enumerate(x)])).collect()}
    assert [got[k]["n_links"] for k in range(3000)] == hit.sum(1).tolist()
    comp = components(range(3000), zip(*np.nonzero(hit)))
    assert all(got[k]["component_id"] == comp[k] for k in range(3000))


def test_vectors_awkward_and_empty(spark):
    v, far = [1.0, 2.0, 0.5], [-1.0, 0.3, 4.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 2.0], 1), (8, [math.nan, 1.0, 1.0], 1),
            (9, [math.inf, 1.0, 1.0], 1), (10, [], 1), (11, [2.0, 4.0, 1.0], 1), (12, far, 1), (None, v, 1), (13, [1.0, 2.0], 1), (14, [1e-30, 2e-30, 5e-31], 1)]
    got = vector_dedup.near_vectors(vectors(spark, [(*r, 0, "n", 0, 0) for r in rows])).collect()
    assert len(got) == len(rows)
    links = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert links[1] == (5, 1, True) and links[2] == (5, 1, False) and links[11] == (5, 1, False) and links[14][1] == 1
    for alone in (3, 4, 5, 6, 7, 8, 9, 10, 12, 13):
        assert links[alone] == (0, alone, True)
    assert vector_dedup.near_vectors(vectors(spark, [])).count() == 0


def naive_runs(rows, least=50):
    """Lines removed of each (doc_id, text), by comparing whole windows kept in one dictionary."""
    seen, out = {}, {}
    for doc_id, text in rows:
        lines = [(x.strip(), len(x.split())) for x in text.split("\n") if x.split()]
        spans = set()
        for a in range(len(lines)):
            b, w = a, 0
            while b < len(lines) and w < least:
                w, b = w + lines[b][1], b + 1
            if w >= least:
                spans.add((a, b - 1))
            b, w = a, 0
            while b >= 0 and w < least:
                w, b = w + lines[b][1], b - 1
            if w >= least:
                spans.add((b + 1, a))
        gone = set()
        for a, b in sorted(spans):
            first = seen.setdefault(tuple(x for x, _ in lines[a:b + 1]), (doc_id, b))
            if first[0] != doc_id or a > first[1]:
                gone |= set(range(a, b + 1))
        out[doc_id] = [x for k, (x, _) in enumerate(lines) if k not in gone]
    return out


def test_line_runs_equal_brute_force(spark):
    rng = random.Random(8)
    passages = [[sentence(rng, rng.randrange(4, 30)) for _ in range(rng.randrange(2, 9))] for _ in range(12)]
    rows = []
    for k in range(150):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [sentence(rng, rng.randrange(1, 25)) for _ in range(3)]
        if k % 10 == 0:
            lines += ["again and again"] * 60
        rows.append((k, "\n".join(lines)))
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_runs(frame(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    naive = naive_runs(rows)
    text = dict(rows)
    for i, r in got.items():
        assert [x.strip() for x in (r["text"] or "").split("\n") if x.strip()] == naive[i], i
        assert r["n_removed"] == r["n_lines"] - len(naive[i])
        rest, at = "", 0
        for s in r["spans"]:
            rest, at = rest + text[i][at:s["start"]], s["end"]
        assert rest + text[i][at:] == r["text"]
    assert sum(r["n_removed"] for r in got.values()) > 300


def test_a_passage_of_over_fifty_words_goes_once(spark):
    rng = random.Random(9)
    passage = "\n".join(sentence(rng, 13) for _ in range(4))
    rows = [(k, f"{sentence(rng, 20)}\n{passage}\n{sentence(rng, 20)}", "en", "a") for k in (3, 1, 2)]
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_runs(frame(spark, rows)).collect()}
    assert [got[k]["n_removed"] for k in (1, 2, 3)] == [0, 4, 4] and passage in got[1]["text"] and passage not in got[2]["text"]


def test_line_runs_awkward_and_empty(spark):
    rows = awkward_rows()
    got = line_dedup.drop_repeated_runs(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[4][0]["text"] is None and by[5][0]["text"] == "" and by[5][0]["n_lines"] == 0
    assert by[1][0]["n_removed"] == 0 and [r["n_removed"] for r in by[2]] == [1, 1]
    assert by[8][0]["n_removed"] == 0 and by[9][0]["n_removed"] == 1500 and by[9][0]["text"] == ""
    assert line_dedup.drop_repeated_runs(frame(spark, [])).count() == 0
