"""Near-duplicate vectors through a pivot-permutation index: ordered nearest pivots, inverted lists, exact check; cells where vectors are dense."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dustledger.llm.ngram_join import smallest_reachable
from dustledger.operators.components import connected_components
from dustledger.session import durable, skew_join


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    # divided by the largest component first, so that no square overflows or vanishes
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(nodes: DataFrame, count: int, width: int, most: int) -> np.ndarray:
    """Up to 8 sqrt(count) distinct vectors by smallest hash, at most ``most`` and at most 2^24 numbers in all."""
    wanted = int(max(16, min(8 * math.sqrt(count), most, 2**24 // max(width, 1))))
    near = nodes.filter(F.pmod(F.xxhash64("vector"), F.lit(1 << 40)) * F.lit(float(count)) <= float(wanted) * 2 * (1 << 40))
    drawn = near.orderBy(F.xxhash64("vector"), "vector").limit(wanted).select("vector").toPandas()
    return unit_rows(drawn["vector"]).astype(np.float32) if len(drawn) else np.zeros((0, width), np.float32)


def thinned(pivots: np.ndarray, least_angle: float) -> np.ndarray:
    """The numbers of pivots, each at least ``least_angle`` from the chosen ones before it; no pivot is further from all of them."""
    free, bound, out = np.ones(len(pivots), bool), np.cos(min(least_angle, np.pi)), []
    for k in range(len(pivots)):
        if free[k]:
            out.append(k)
            free &= pivots @ pivots[k] < bound
            free[k] = False
    return np.array(out, np.int64)


def permutation(vector: Column, pivots: np.ndarray, leaders: np.ndarray, length: int, spark) -> Column:
    """Struct (near, last, home, away): the numbers of the ``length`` pivots nearest to ``vector``, nearest first (ties by number),
    the angle of the last of them, the number of the nearest leader and its angle."""
    shared = spark.sparkContext.broadcast((pivots, leaders))
    length = min(length, len(pivots))

    def nearest(vectors: pd.Series) -> pd.DataFrame:
        out = {"near": [], "last": [], "home": [], "away": []}
        pivots, leaders = shared.value
        for at in range(0, len(vectors), 256):
            near = unit_rows(vectors.iloc[at:at + 256]).astype(np.float32) @ pivots.T
            top = np.argpartition(-near, length - 1, axis=1)[:, :length]
            order = np.lexsort((top, -np.take_along_axis(near, top, axis=1)), axis=1)
            top = np.take_along_axis(top, order, axis=1)
            out["near"].extend(top.astype(np.int32))
            out["last"].extend(np.arccos(np.clip(near[np.arange(len(top)), top[:, -1]], -1, 1)).astype(float))
            own = near[:, leaders]
            out["home"].extend(own.argmax(axis=1).astype(np.int32))
            out["away"].extend(np.arccos(np.clip(own.max(axis=1), -1, 1)).astype(float))
        return pd.DataFrame(out)

    return F.pandas_udf(nearest, "struct<near:array<int>,last:double,home:int,away:double>")(vector)


def _check(threshold: float, least_shared: int):
    def check(part: pd.DataFrame) -> pd.DataFrame:
        pivot, one, two = part["pivot"].iloc[0], part["one"].iloc[0], part["two"].iloc[0]
        part = part.sort_values("node", kind="stable")
        left, right = np.flatnonzero(part["chunk"] == one), np.flatnonzero(part["chunk"] == two)
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "low": []})
        x, ids, copies = unit_rows(part["vector"]), part["node"].to_numpy(), part["copies"].to_numpy()
        lists, dense = np.array(part["near"].tolist()), part["dense"].to_numpy(bool)
        pivots, place = np.unique(lists, return_inverse=True)
        member = np.zeros((len(part), len(pivots)), np.float32)
        member[np.repeat(np.arange(len(part)), lists.shape[1]), place.ravel()] = 1
        earlier = member[:, pivots < pivot]
        hit = (x[left] @ x[right].T >= threshold) & (member[left] @ member[right].T >= least_shared)
        # a pair meets in every list that it shares; the list of its smallest shared pivot counts it
        hit &= (earlier[left] @ earlier[right].T == 0) & (ids[left][:, None] != ids[right][None, :])
        hit &= ~(dense[left][:, None] & dense[right][None, :])  # compared in their cells
        linked = np.zeros((len(part), len(part)), bool)
        linked[np.ix_(left, right)] = hit
        linked[np.ix_(right, left)] |= hit.T
        links = linked @ copies
        low = smallest_reachable(linked, ids)
        return pd.DataFrame({"node": ids, "links": links, "low": low})[links > 0]

    return check


def _compare(threshold: float):
    """All pairs between two chunks of cells (or inside one), as (node, links counted with copies, smallest linked id)."""

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", kind="stable")
        place = part[["home", "chunk"]].to_numpy()
        left = np.flatnonzero((place == part[["cell", "one"]].to_numpy()[0]).all(axis=1))
        right = np.flatnonzero((place == part[["other", "two"]].to_numpy()[0]).all(axis=1))
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "low": []})
        x, ids, copies = unit_rows(part["vector"]), part["node"].to_numpy(), part["copies"].to_numpy()
        hit = (x[left] @ x[right].T >= threshold) & (ids[left][:, None] != ids[right][None, :])
        links, low = np.zeros(len(part), np.int64), ids.copy()
        links[left] = hit @ copies[right]
        links[right] = hit.T @ copies[left]
        last, most = None, np.iinfo(np.int64).max
        while last is None or (last != low).any():
            last = low.copy()
            low[left] = np.minimum(low[left], np.where(hit, low[right][None, :], most).min(axis=1))
            low[right] = np.minimum(low[right], np.where(hit, low[left][:, None], most).min(axis=0))
        return pd.DataFrame({"node": ids, "links": links, "low": low})[links > 0]

    return compare


def dense_links(dense: DataFrame, leaders: np.ndarray, threshold: float, width: int) -> DataFrame:
    """(node, links, low) of all pairs of ``dense`` with a cosine of at least ``threshold``, exactly.

    Every vector stands in the cell of its nearest leader. Two cells of a label can hold a link only if their leaders are no further
    apart than both radii and the link's angle, so all other pairs of cells are left out. Cells are cut into chunks.
    """
    spark, slack = dense.sparkSession, 2e-3
    block = int(max(64, min(2048, 2**22 // max(width, 1))))
    cells = durable(dense.groupBy("label", "home").agg(F.count(F.lit(1)).alias("size"), F.max("away").alias("radius")).select(
        "label", "home", "radius", F.ceil(F.col("size") / block).cast("int").alias("parts")))
    reach = np.full(len(leaders), -np.inf)
    for row in cells.groupBy("home").agg(F.max("radius").alias("radius")).toLocalIterator():
        reach[row["home"]] = row["radius"]
    shared = spark.sparkContext.broadcast((leaders, reach))
    angle = float(np.arccos(np.clip(threshold, -1, 1)))

    def others(homes: pd.Series) -> pd.Series:
        leaders, reach = shared.value
        out = []
        for home in homes:
            apart = np.arccos(np.clip(leaders @ leaders[home], -1, 1))
            near = apart <= reach[home] + reach + angle + slack
            near[home] = True
            out.append(np.flatnonzero(near[home:]).astype(np.int32) + np.int32(home))
        return pd.Series(out)

    met = cells.select("label", F.col("home").alias("cell"), F.col("parts").alias("cuts"), F.explode(F.pandas_udf(others, "array<int>")("home")).alias("other"))
    met = met.join(cells.select("label", F.col("home").alias("other"), "parts"), ["label", "other"])
    met = met.withColumn("one", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn(
        "two", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("cell < other or one <= two").select("label", "cell", "one", "other", "two")
    met = durable(met)
    visits = met.select("*", F.col("cell").alias("home"), F.col("one").alias("chunk")).union(
        met.filter("cell < other or one < two").select("*", F.col("other").alias("home"), F.col("two").alias("chunk")))
    chunk = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = skew_join(dense, cells.select("label", "home", "parts"), ["label", "home"]).withColumn("chunk", chunk)
    groups = placed.select("label", "home", "chunk", "node", "copies", "vector").join(visits, ["label", "home", "chunk"])
    return groups.groupBy("label", "cell", "one", "other", "two").applyInPandas(_compare(threshold), "node long, links long, low long")


def near_vectors(
    rows: DataFrame, threshold: float = 0.98, length: int = 8, least_shared: int = 2, most_pivots: int = 65536, block: int = 256,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; links join vectors of one label with cosine >= threshold.

    The pivots are a bounded sample of the vectors (at most ``most_pivots``), every vector is indexed: it is described by its
    ``length`` nearest pivots in order and stands in the inverted list of each of them, apart by label and width. Vectors of a
    list that share ``least_shared`` pivots or more are candidates and are verified in double precision; a pair is
    counted in the list of its smallest shared pivot only. A long list is cut into chunks of about ``block`` vectors and every
    pair of chunks is one group, so neither a hot label nor a hot pivot makes one task long. Groups return counts and the
    smallest linked vector, not pairs. No list is capped.

    In a dense group of vectors that are near but not equal the nearest pivots of each are its own, and links would share none. With t
    the angle of a link, a vector whose last listed pivot is within 2 t is crowded and one within 3 t is dense, so everything that links
    with a crowded vector is dense. All pairs of dense vectors are compared in cells (``dense_links``), whatever pivots they
    share; the lists hold the vectors that are not crowded, for the other pairs.

    Equal vectors of a label are one node. Vectors that are null, empty, zero or hold null or non-finite components, and vectors
    without label, link with nothing: component_id is their own id and they are kept. Rows without vec_id take part through a
    negative stand-in id, repeated rows are copies of each other. Further columns are ignored.
    """
    spark = rows.sparkSession
    told = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string"))
    told = told.withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull())
    stand_in = -F.pmod(F.xxhash64("label", "vector"), F.lit(1 << 62)) - 1
    nodes = durable(told.filter("ok").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")).select(
        F.coalesce("least", stand_in).alias("node"), "label", "vector", F.size("vector").alias("width"), "copies"))
    empty = spark.createDataFrame([], "node long, links long, low long")
    found = [empty]
    for width, count in nodes.groupBy("width").count().orderBy("width").collect():
        own = nodes.filter(F.col("width") == width)
        pivots = choose_pivots(own, count, width, most_pivots)
        angle = math.acos(max(-1.0, min(1.0, threshold)))
        # leaders further apart than a dense vector's pivots, so that a dense group has few of them
        leaders = thinned(pivots, 4 * angle)
        told_of = permutation(F.col("vector"), pivots, leaders, length, spark)
        described = durable(own.withColumn("place", told_of).select("*", "place.*").drop("place").withColumns(
            {"crowded": F.col("last") <= 2 * angle, "dense": F.col("last") <= 3 * angle + 2e-3}))
        found.append(dense_links(described.filter("dense"), pivots[leaders].astype(float), threshold, width))
        listed = described.filter(~F.col("crowded")).withColumn("pivot", F.explode("near"))
        sizes = listed.groupBy("label", "pivot").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(
            "label", "pivot", F.ceil(F.col("size") / block).cast("int").alias("parts"))
        chunk = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        dealt = skew_join(listed, sizes, ["label", "pivot"]).withColumn("chunk", chunk).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        groups = dealt.select("label", "pivot", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"),
                              "chunk", "node", "copies", "vector", "near", "dense")
        found.append(groups.groupBy("label", "pivot", "one", "two").applyInPandas(
            _check(threshold, min(least_shared, length, len(pivots))), "node long, links long, low long"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    links = durable(links)
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(links.select(F.col("node").alias("u"), F.col("low").alias("v")))
    known = nodes.select("node", "label", "vector", "copies").join(degree, "node", "left").join(joined, "node", "left").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    keyed = told.withColumn("key", F.when(F.col("ok"), F.col("vector")))
    out = keyed.join(known, (F.col("label") == F.col("_label")) & (F.col("key") == F.col("_vector")), "left")
    alone = F.coalesce("component_id", F.coalesce("vec_id", F.lit(-1)))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"),
                      F.coalesce(F.col("vec_id") == alone, alone < 0).alias("kept"))
