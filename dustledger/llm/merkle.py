"""Merkle manifest of a dataset: a content-addressed store of digest-to-children records, and proofs by descent from the root.

Rows become leaf digests, ranked within their source. Every run of three nodes becomes the node above, up to a subroot per
source; the subroots, in the order of the sources, go up to the root in the same way. A record holds, under the digest of a
node, the levels of children ``DEPTH`` steps down; equal nodes share one record.

A proof request knows the rank of its leaf. It starts at the root and finds the record of the digest at which it stands; the
digits of the rank (base 3) select a child on each level, and the children not selected are collected. What one record
contributes is a segment of the path; at the leaf the segments are reversed. Requests under one node walk together, so the
walk costs about one joined row per leaf, whatever the height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dustledger.session import durable

#: Children of a node, and levels in one record: at most 81 digests on its lowest level.
FANOUT, DEPTH = 3, 4
SPAN = FANOUT**DEPTH
PATH = "array<struct<digit:int,siblings:array<string>>>"


def encoded(value: Column) -> Column:
    """'-' for null, else the UTF-8 byte count, ':' and the value (integers in decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts end to end."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns: list[Column]) -> Column:
    return digest(*[encoded(c) for c in columns])


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, within the group) and ``nodes`` (rows of the group), written to the checkpoint folder.

    Rows are dealt by ranges of (group, order), so one large group spreads over all tasks; only counts per task and group are
    joined back. Nulls come first; rows equal in all of ``order`` are ranked in any order.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = durable(dealt.withColumns({"_place": F.monotonically_increasing_id(), "_task": F.spark_partition_id()}))
    totals = placed.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    # one row per task and group here
    every = W.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(every.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(F.col(group).alias("_group"), F.col("_task").alias("_at"), F.sum("_n").over(every).alias("nodes"), (before - F.col("_first")).alias("_shift"))
    joined = placed.join(offsets, (placed[group] == offsets["_group"]) & (placed["_task"] == offsets["_at"]))
    return joined.select(*[c for c in rows.columns], (F.col("_place") + F.col("_shift")).alias("rank"), "nodes")


def height(nodes: Column) -> Column:
    """Levels above ``nodes`` leaves: the least h with 3^h >= nodes."""
    return F.size(F.filter(F.array(*[F.lit(FANOUT**k) for k in range(39)]), lambda p: p < nodes))


def _level_above(below: Column) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.size(below) / FANOUT).cast("int") - 1)
    return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(below, k * FANOUT + 1, FANOUT), ""), 256))


def build(leaves: DataFrame, group: str) -> tuple[list[DataFrame], DataFrame]:
    """(stores, tops) from ``leaves`` (group, rank, nodes, digest): records by digest, lowest first, and (group, nodes, digest).

    A record is (digest, levels): level 0 has the children ``DEPTH`` steps down (fewer steps below a group's top node), each
    further level the digests above. Every group has at most one incomplete record per store.
    """
    nodes = leaves.select(group, "rank", "digest", height(F.col("nodes")).alias("high"), "nodes")
    tops, stores = nodes.filter("high = 0").select(group, "nodes", "digest"), []
    tallest = leaves.agg(F.max(height(F.col("nodes")))).first()[0] or 0
    for done in range(0, tallest, DEPTH):
        # at most 81 digests of one group meet in a row
        gathered = nodes.filter(F.col("high") > done).groupBy(group, "nodes", "high", F.floor(F.col("rank") / SPAN).alias("rank")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("at"), "digest"))), lambda x: x["digest"]).alias("lowest"))
        steps = F.least(F.col("high") - done, F.lit(DEPTH))
        grown = F.aggregate(F.sequence(F.lit(1), steps), F.array("lowest"), lambda levels, k: F.concat(levels, F.array(_level_above(F.element_at(levels, -1)))))
        records = durable(gathered.withColumn("levels", grown).select(
            group, "rank", "nodes", "high", F.element_at(F.element_at("levels", -1), 1).alias("digest"), F.expr("slice(levels, 1, size(levels) - 1)").alias("levels")))
        stores.append(records.groupBy("digest").agg(F.first("levels").alias("levels")))
        nodes = records.select(group, "rank", "digest", "high", "nodes")
        tops = tops.unionByName(nodes.filter(F.col("high") <= done + DEPTH).select(group, "nodes", "digest"))
    return stores, tops


def _segment(levels: Column, at: Column) -> Column:
    """The children that rank digits leave aside inside a record, from the record's top down to its child number ``at``."""
    def step(level: Column, k: Column) -> Column:
        below = F.floor(at / F.element_at(F.array(*[F.lit(FANOUT**j) for j in range(DEPTH)]), k + 1)).cast("int")
        digit = below % FANOUT
        run = F.slice(level, below - digit + 1, FANOUT)
        return F.struct(digit.alias("digit"), F.filter(run, lambda _, i: i != digit).alias("siblings"))

    return F.reverse(F.transform(levels, step))


def descend(stores: list[DataFrame], tops: DataFrame, requests: DataFrame, group: str) -> DataFrame:
    """``requests`` (group, rank, ...) with ``path`` and the columns of ``tops``: siblings from the leaf up to the group's top.

    ``tops`` has (group, nodes, digest) and columns of its own. Of each level of the path there is the digit of the
    node on the way and its siblings from left to right; a lone node has none. A request whose group or rank is not there is
    not answered. ``requests`` and ``tops`` share no column but the group.
    """
    own = [c for c in tops.columns if c not in (group, "nodes", "digest")]
    wanted = [requests.filter((F.col("rank") >= 0))]
    for _ in stores:
        last = wanted[-1]
        wanted.append(last.select(group, F.floor(F.col("rank") / SPAN).alias("rank")).distinct())
    starts = tops.select(group, *own, "digest", F.lit(0).cast("long").alias("rank"), F.expr(f"cast(array() as array<{PATH}>)").alias("segments"),
                         F.ceil(height(F.col("nodes")) / DEPTH).cast("int").alias("records"))
    standing = starts.filter(F.col("records") >= len(stores))
    for j in range(len(stores) - 1, -1, -1):
        record = standing.join(stores[j], "digest").select(
            F.col(group).alias("_group"), F.col("rank").alias("_up"), *own, "segments", "levels")
        asked = wanted[j].withColumn("_at", F.pmod(F.col("rank"), F.lit(SPAN)).cast("int"))
        met = asked.join(record, (F.col(group) == F.col("_group")) & (F.floor(F.col("rank") / SPAN) == F.col("_up")))
        met = met.filter(F.col("_at") < F.size(F.element_at("levels", 1)))
        stepped = met.withColumns({
            "digest": F.element_at(F.element_at("levels", 1), F.col("_at") + 1),
            "segments": F.concat("segments", F.array(_segment(F.col("levels"), F.col("_at"))))})
        standing = stepped.drop("_group", "_up", "_at", "levels")
        if j:
            standing = standing.withColumn("records", F.lit(j)).unionByName(starts.filter(F.col("records") == j))
        else:
            # a group of one leaf has no record: its request stands at the top at once
            alone = starts.filter(F.col("records") == 0).drop("records").withColumnRenamed("rank", "_up").withColumnRenamed(group, "_group")
            lone = requests.join(alone, (F.col(group) == F.col("_group")) & (F.col("rank") == F.col("_up"))).drop("_group", "_up")
            standing = standing.unionByName(lone)
    if not stores:
        alone = starts.drop("records").withColumnRenamed("rank", "_up").withColumnRenamed(group, "_group")
        standing = requests.join(alone, (F.col(group) == F.col("_group")) & (F.col("rank") == F.col("_up"))).drop("_group", "_up")
    path = F.flatten(F.transform(F.reverse("segments"), F.reverse))
    return standing.withColumn("path", path).drop("segments", "digest")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf digest and its path."""
    def up(below: Column, step: Column) -> Column:
        left = F.array_join(F.slice(step["siblings"], 1, step["digit"]), "")
        right = F.array_join(F.slice(step["siblings"], step["digit"] + 1, FANOUT), "")
        return F.sha2(F.concat(left, below, right), 256)

    return F.aggregate(path, leaf, up)


def path_digest(path: Column) -> Column:
    """sha256 of all siblings of a path, from the leaf's level up to the root's."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["siblings"])), ""), 256)


def manifest_proofs(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, altered_leaf, subroot, root, path) of every row of ``docs``.

    The leaf is the digest of doc_id, source, lang, n_chars and text; ``altered`` is a text to compare (an expression over
    the columns of ``docs``), and altered_leaf the leaf with that text. Leaves of a source ascend by doc_id (null first), then by
    digest; sources ascend by their UTF-8 bytes, null first. ``path`` goes from the leaf to the root.

    Every row is a leaf, repeated ones too (their leaves are equal, their ranks and paths differ). A source of one row is
    its own subroot, one source is its own root; an empty table has no rows. Null and empty texts have different leaves.
    Texts are hashed where they are read and are not moved. Further columns are ignored.
    """
    known = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("origin"),
        leaf_digest([*known, F.col("text")]).alias("leaf"), leaf_digest([*known, F.col("text") if altered is None else altered]).alias("altered_leaf"))
    leaves = ranked(rows, "origin", ["doc_id", "leaf"])
    stores, subroots = build(leaves.withColumnRenamed("leaf", "digest"), "origin")
    listed = ranked(subroots.select(F.lit(0).alias("all"), "origin", F.col("nodes").alias("size"), F.col("digest").alias("subroot")), "all", ["origin"])
    top_stores, roots = build(listed.withColumnRenamed("subroot", "digest"), "all")
    above = descend(top_stores, roots.withColumn("root", F.col("digest")), listed.select("all", "rank", "origin", "size", "subroot"), "all")
    sources = durable(above.select("origin", F.col("size").alias("nodes"), F.col("subroot").alias("digest"), "subroot", "root", F.col("path").alias("above")))
    below = descend(stores, sources, leaves.drop("nodes"), "origin")
    return below.select("doc_id", "leaf", "altered_leaf", "subroot", "root", F.concat("path", "above").alias("path"))
