"""Sharding by longest processing time: whole groups, largest first, go to the least-loaded shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dustledger.session import durable


def longest_first(items: Iterable[tuple[str, int]], shards: int) -> list[tuple[str, int]]:
    """(key, shard) of each (key, size): by falling size, then key, onto the least-loaded shard."""
    heap = [(0, shard) for shard in range(shards)]
    plan = []
    for key, size in sorted(items, key=lambda item: (-item[1], item[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        plan.append((key, shard))
    return plan


def assign_shards(
    rows: DataFrame, group: Column, size: Column, order: Sequence[str], shards: int = 40,
    lots_per_shard: int = 256, rows_per_chunk: int = 65536,
) -> DataFrame:
    """``rows`` with ``shard`` (int, 0 to shards - 1) and ``slot`` (long, gapless from 0 in each shard).

    Groups (equal, null-safe values of ``group``) stay together; loads are the sums of ``size``.
    The heap sees a bounded list: a group above ``1 / lots`` of the whole is an item of its own (there
    are fewer than ``lots = shards * lots_per_shard`` of them); all other groups are dealt by hash
    into ``lots`` lots and a lot is one item. Loads end about one lot apart unless one group alone
    exceeds the mean load. Only this list, at most ``2 * lots`` rows, is collected and broadcast.

    Slots follow ``order`` inside hash chunks of a shard, so no task sorts a whole shard; rows equal in
    ``order`` and group are interchangeable. A null size counts as 0, a null group is one group. Input
    columns named shard or slot are replaced. An empty input gives an empty result.

    ``rows`` is read several times: materialise it first when it is costly, without wide columns.
    """
    lots = shards * lots_per_shard
    rows = rows.drop("shard", "slot")
    keyed = rows.withColumns({
        "_group": F.coalesce(F.concat(F.lit("g"), group.cast("string")), F.lit("null")),
        "_size": F.coalesce(size.cast("long"), F.lit(0)),
    }).withColumn("_lot", F.concat(F.lit("lot"), F.pmod(F.xxhash64("_group"), F.lit(lots)).cast("string")))
    groups = keyed.groupBy("_group", "_lot").agg(F.sum("_size").alias("_size"), F.count(F.lit(1)).alias("_rows"))
    whole = groups.agg(F.sum("_size"), F.sum("_rows")).first()
    total, count = whole[0] or 0, whole[1] or 0
    item = F.when(F.col("_size") * lots > total, F.col("_group")).otherwise(F.col("_lot"))
    listed = groups.groupBy(item.alias("_item")).agg(F.sum("_size").alias("_size")).collect()
    spark = rows.sparkSession
    plan = spark.createDataFrame(longest_first([(r[0], r[1]) for r in listed], shards), "_item string, shard int")
    single = F.broadcast(plan.filter(F.col("_item").startswith("g") | (F.col("_item") == "null")).select(
        F.col("_item").alias("_group"), F.col("shard").alias("_own")))
    lot = F.broadcast(plan.filter(F.col("_item").startswith("lot")).select(F.col("_item").alias("_lot"), "shard"))
    placed = keyed.join(single, "_group", "left").join(lot, "_lot", "left").withColumn(
        "shard", F.coalesce("_own", "shard"))
    chunks = max(1, -(-count // (shards * rows_per_chunk)))
    placed = placed.withColumn("_chunk", F.pmod(F.xxhash64("_group", *order), F.lit(chunks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "_chunk").count().select(
        F.col("shard").alias("_shard"), F.col("_chunk").alias("_part"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_chunk").orderBy(*order, "_group")
    numbered = placed.withColumn("_at", F.row_number().over(inside) - 1)
    joined = numbered.join(offsets, (F.col("shard") == F.col("_shard")) & (F.col("_chunk") == F.col("_part")))
    return joined.select(*rows.columns, "shard", (F.col("_before") + F.col("_at")).alias("slot"))


def document_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): documents dealt by bytes, equal texts together.

    Size is the UTF-8 length plus 16; a null text has no bytes, checksum 0, and forms a group with the
    other null texts, apart from empty ones. Further columns are ignored. Repeated rows each get a slot.
    """
    light = durable(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.sha2("text", 256).alias("digest")))
    dealt = assign_shards(light, F.col("digest"), F.col("size"), ["doc_id"], shards)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
