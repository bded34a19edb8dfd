"""Near-duplicate join on word n-gram Jaccard similarity through a MinHash LSH forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dustledger.llm.words import batches, folded, mix, shingles
from dustledger.operators.components import connected_components
from dustledger.session import durable, skew_join

_RNG = np.random.default_rng(977)


def forest_depth(trees: int, longest: int, threshold: float, recall: float) -> int:
    """Length of the prefixes to match: from ``longest`` down until pairs at ``threshold`` are met often enough.

    A pair of similarity s shares a prefix of length d in one tree with probability s^d, so in at least one of
    the trees with 1 - (1 - s^d)^trees.
    """
    depth = longest
    while depth > 1 and 1.0 - (1.0 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def signatures(norms: list[bytes], n: int, trees: int, depth: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts): of each folded text the prefix of every tree as one 64-bit key, and its number of shingles."""
    rng = np.random.default_rng(4242)
    salt = rng.integers(0, 2**64, trees * depth, dtype=np.uint64)
    odd = rng.integers(0, 2**64, trees * depth, dtype=np.uint64) | np.uint64(1)
    hashes, counts = shingles(norms, n)
    keys = np.zeros((len(norms), trees), np.uint64)
    own = np.flatnonzero(counts)
    if len(own):
        starts = np.concatenate(([0], np.cumsum(counts[own])))[:-1]
        for tree in range(trees):
            prefix = np.full(len(own), tree, np.uint64)
            for k in range(tree * depth, (tree + 1) * depth):
                least = np.minimum.reduceat((hashes ^ salt[k]) * odd[k], starts)
                prefix = mix(prefix * np.uint64(0x9E3779B97F4A7C15) + least)
            keys[own, tree] = prefix
    return keys.view(np.int64), counts


def _signed(docs: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    """(doc_id, digest, weight, keys) of every row; weight 0 and no keys for a text without words."""

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at = 0
            for norms, size in batches(part["text"].tolist()):
                keys, counts = signatures(norms, n, trees, depth, size)
                own = part.iloc[at:at + len(norms)]
                at += len(norms)
                yield pd.DataFrame({"doc_id": own["doc_id"], "digest": own["digest"], "weight": counts,
                                    "keys": [row if count else [] for row, count in zip(keys, counts)]})

    # ids pass through pandas as text: a null would turn a whole batch of longs into doubles
    rows = docs.select(F.col("doc_id").cast("string"), "text", F.md5("text").alias("digest"))
    signed = rows.mapInPandas(sign, "doc_id string, digest string, weight long, keys array<long>")
    return signed.withColumn("doc_id", F.col("doc_id").cast("long"))


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, step: int = 512) -> np.ndarray:
    """Boolean matrix over ``left`` x ``right`` of exact Jaccard similarity >= threshold of sorted hash sets.

    Shared members are counted by products of 0/1 blocks over the hashes that occur in several sets.
    """
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    values, place, times = np.unique(every, return_inverse=True, return_counts=True)
    common = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = times[place] > 1
    place, owner = common[place[keep]], owner[keep]
    shared = np.zeros((len(left), len(right)), np.float32)
    row_of, column_of = np.full(len(sets), -1), np.full(len(sets), -1)
    row_of[left], column_of[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        a, b = np.searchsorted(place, [low, low + step])
        p, o = place[a:b] - low, owner[a:b]
        rows, columns = row_of[o], column_of[o]
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        x[rows[rows >= 0], p[rows >= 0]] = 1
        y[columns[columns >= 0], p[columns >= 0]] = 1
        shared += x @ y.T
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    return shared >= threshold * union - 1e-9


def smallest_reachable(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id reachable by links, for a symmetric boolean matrix."""
    low = ids.copy()
    while True:
        near = np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new = np.minimum(low, near)
        if (new == low).all():
            return low
        low = new


def _verify(n: int, threshold: float):
    """Links inside a block, or between two blocks, as (node, links counted with copies, smallest linked id)."""

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["node", "digest"]).drop_duplicates(["node", "digest"])
        nodes, first = np.unique(part["node"].to_numpy(), return_index=True)
        member = np.searchsorted(nodes, part["node"].to_numpy())
        hashes, counts = shingles([folded(t) for t in part["text"]], n)
        pieces = np.split(hashes, np.cumsum(counts)[:-1])
        sets = [np.unique(x) for x in pieces]
        chunk, copies = part["chunk"].to_numpy(), part["copies"].to_numpy()
        one, two = part["one"].iloc[0], part["two"].iloc[0]
        left, right = np.flatnonzero(chunk == one), np.flatnonzero(chunk == two)
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "low": []})
        hit = similar_pairs(sets, left, right, threshold)
        hit &= part["node"].to_numpy()[left][:, None] != part["node"].to_numpy()[right][None, :]
        square = np.zeros((len(part), len(part)), bool) if one != two else None
        links = np.zeros(len(part), np.int64)
        if one == two:
            square = np.zeros((len(part), len(part)), bool)
            square[np.ix_(left, right)] = hit
            links[left] = hit @ copies[right]
        else:
            square[np.ix_(left, right)] = hit
            square[np.ix_(right, left)] = hit.T
            links[left] += hit @ copies[right]
            links[right] += hit.T @ copies[left]
        low = smallest_reachable(square, part["node"].to_numpy())
        out = pd.DataFrame({"node": nodes[member], "links": links, "low": low})
        return out[out["links"] > 0]

    return verify


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, n: int = 5, trees: int = 16, longest: int = 8, recall: float = 0.999,
    block: int = 1 << 17,
) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, component_id, kept.

    Texts are compared by the Jaccard similarity of their sets of ``n``-word shingles (a text of fewer words
    has one shingle). Rows with equal texts form a class, class_id is its smallest doc_id; n_links counts the
    other rows that are copies or at least ``threshold`` similar; component_id is the smallest doc_id reachable
    over links; kept marks the row whose doc_id is its component_id.

    1. Each text gets one key per tree of the forest: the prefix of its MinHash signature, of the longest length
       that still meets ``recall`` for pairs at the threshold. Rows under one key form a bucket.
    2. Buckets are chained to candidate components by links to each bucket's smallest document (one row per
       document and tree, never pairs). Components are cut into chunks of about ``block`` shingles in trie order
       (by the first tree's prefix; one large bucket is cut further), and two chunks are compared only if a bucket
       spans both. A text travels once per such pair of chunks, not once per bucket.
    3. Every pair inside a pair of chunks is verified exactly on whole texts; a chunk pair returns one row per
       document with its count of links and smallest linked document, so dense groups never become pair rows.

    No bucket, chunk or partner list is capped. Null texts and texts without words have no shingles: null rows
    link with nothing (class of their own doc_id), equal wordless texts are copies. Rows without doc_id take part through a
    negative stand-in id (kept is false unless the whole class has none). Repeated rows are copies. Different texts under one doc_id
    are one node. Further columns are ignored.
    """
    depth = forest_depth(trees, longest, threshold, recall)
    signed = durable(_signed(docs, n, trees, depth))
    stand_in = -F.pmod(F.xxhash64("digest"), F.lit(1 << 62)) - 1
    nodes = durable(signed.filter("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("weight").alias("weight"), F.first("keys").alias("keys")
    ).select("digest", F.coalesce("least", stand_in).alias("node"), "least", "copies", "weight", "keys"))
    members = nodes.filter("weight > 0").select("node", F.explode("keys").alias("key"))
    head = members.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")).filter("head < tail")
    bucketed = durable(skew_join(members, head, ["key"]).select("node", "head", "key").distinct())
    candidate = durable(connected_components(bucketed.select(F.col("node").alias("u"), F.col("head").alias("v"))))
    sized = nodes.select("node", "digest", "least", "copies", (F.col("weight") + 64).alias("weight"), F.get("keys", F.lit(0)).alias("trie")).join(candidate, "node")
    load = sized.groupBy("component").agg(F.ceil(F.sum("weight") / block).alias("parts"))
    twig = sized.groupBy("component", "trie").agg(F.ceil(F.sum("weight") / block).alias("cuts"))
    chunked = skew_join(skew_join(sized, load, ["component"]), twig, ["component", "trie"]).withColumn("chunk", F.pmod(
        F.pmod(F.xxhash64("trie"), F.col("parts")) + F.pmod(F.xxhash64("node"), F.col("cuts")), F.col("parts")).cast("int"))
    chunked = durable(chunked.select("node", "digest", "least", "copies", "component", "chunk", "parts"))
    split = chunked.filter("parts > 1").select("node", "component", "chunk").distinct()
    spans = bucketed.join(split, "node").select("key", "component", "chunk").distinct()
    across = spans.join(spans.withColumnsRenamed({"chunk": "other"}), ["key", "component"]).filter("chunk < other").select(
        "component", F.col("chunk").alias("one"), F.col("other").alias("two")).distinct()
    inside = chunked.select("component", F.col("chunk").alias("one"), F.col("chunk").alias("two")).distinct()
    pairs = inside.union(across)
    visits = pairs.select("*", F.col("one").alias("chunk")).union(
        pairs.filter("one < two").select("*", F.col("two").alias("chunk")))
    # visits hold ids alone; a text joins them once, and travels once more to the chunk pairs that look at it
    places = chunked.select("node", "digest", "least", "copies", "component", "chunk").join(visits, ["component", "chunk"])
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", F.md5("text").alias("_digest"))
    wanted = places.join(texts, places["least"].eqNullSafe(texts["_id"]) & (places["digest"] == texts["_digest"])).select(
        "node", "digest", "copies", "component", "chunk", "one", "two", "text")
    links = wanted.groupBy("component", "one", "two").applyInPandas(_verify(n, threshold), "node long, links long, low long")
    links = durable(links)
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(links.select(F.col("node").alias("u"), F.col("low").alias("v")))
    per_text = nodes.select("digest", "node", "least", "copies").join(degree, "node", "left").join(joined, "node", "left").select(
        F.col("digest").alias("_digest"), F.col("node").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    rows = signed.select("doc_id", "digest").join(per_text, F.col("digest") == F.col("_digest"), "left")
    alone = F.coalesce("doc_id", F.lit(-1))
    return rows.select(
        "doc_id", F.coalesce("class_id", alone).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", alone).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", alone), F.coalesce("component_id", alone) < 0).alias("kept"))
