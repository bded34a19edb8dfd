"""Exact ranks and quantiles for groups of any size and any distribution, without one task per group.

A plain ``Window.partitionBy(key).orderBy(value)`` puts a whole group into one task, and the
builtin exact percentile keeps a group's distinct values in one buffer. Here the values are first
counted (map-side combine, so repeated values cost one row), then range-partitioned by (group, value)
and written to the checkpoint folder once. The split points come from the data, so the slices have about equal
numbers of rows whatever outliers there are. Slice totals give offsets, and only the rows of one slice meet in
one task. The written slices are fixed, so a recomputed task agrees with the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dustledger.session import durable


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a single-row aggregate to every row (the broadcast side is one row)."""
    return (df.withColumn("_k", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_k", F.lit(1))), "_k").drop("_k"))


def value_table(df: DataFrame, keys: Sequence[str], value: str,
                sums: dict[str, Column] | None = None, kind: str | None = "double") -> DataFrame:
    """Distinct non-null values per group as ``v`` with their count ``n`` (and extra sums).

    Values are cast to ``kind``; None keeps their own type (ids beyond 2^53, strings).
    """
    aggs = [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    v = F.col(value) if kind is None else F.col(value).cast(kind)
    return (df.filter(F.col(value).isNotNull())
            .groupBy(*keys, v.alias("v"))
            .agg(F.count(F.lit(1)).alias("n"), *aggs))


def cumulative(table: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("n",), levels: int = 1) -> DataFrame:
    """Add ``<c>_below`` (sum over smaller values of the group) and ``<c>_total`` per column.

    There are ``levels`` slices per shuffle partition.
    """
    group = list(keys) or ["_g"]
    cols = list(columns)
    t = table if keys else table.withColumn("_g", F.lit(0))
    slices = levels * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = durable(t.repartitionByRange(slices, *group, "v").withColumn("_slice", F.spark_partition_id()))
    totals = t.groupBy(*group, "_slice").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    # one row per slice of a group here: at most ``slices`` rows per group
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    offsets = totals.select(
        *group, "_slice",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols],
        *[F.sum(f"_t_{c}").over(whole).alias(f"{c}_total") for c in cols])
    within = W.partitionBy(*group, "_slice").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    same = [t[g].eqNullSafe(offsets[g]) for g in [*group, "_slice"]]
    out = t.join(offsets, same).select(t["*"], *[offsets[c] for c in offsets.columns if c not in (*group, "_slice")])
    for c in cols:
        out = out.withColumn(f"{c}_below", F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return out.drop("_slice", *[f"_o_{c}" for c in cols], *([] if keys else ["_g"]))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    method: str = "linear", levels: int = 1) -> DataFrame:
    """Named exact quantiles per group. Methods: linear, higher, lower, ceiling_rank.

    ``ceiling_rank`` takes the element at index ``int(p * n)``, capped at the last one.
    """
    keys = list(keys)
    ranked = cumulative(value_table(df, keys, value), keys, levels=levels)
    n, below = F.col("n_total"), F.col("n_below")
    last = below + F.col("n") - 1  # highest 0-based position holding this value

    def at(position: Column) -> Column:
        return F.max(F.when((below <= position) & (position <= last), F.col("v")))

    aggs = []
    for name, p in probs.items():
        pos = (n - 1) * F.lit(float(p))
        if method == "ceiling_rank":
            aggs.append(at(F.least(n - 1, F.floor(n * F.lit(float(p))))).alias(name))
        elif method == "higher":
            aggs.append(at(F.ceil(pos)).alias(name))
        elif method == "lower":
            aggs.append(at(F.floor(pos)).alias(name))
        else:
            low, high, frac = at(F.floor(pos)), at(F.ceil(pos)), F.max(pos - F.floor(pos))
            aggs.append((low + (high - low) * frac).alias(name))
    return ranked.groupBy(*keys).agg(F.max("n_total").alias("n"), *aggs)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """(keys..., v, rank, n): the tie-averaged 1-based rank of every distinct value."""
    ranked = cumulative(value_table(df, keys, value), keys)
    return ranked.select(*keys, "v", (F.col("n_below") + (F.col("n") + 1) / 2.0).alias(name),
                         "n", "n_total")


def rank_in_groups(df: DataFrame, keys: Sequence[str], value: str, tie_id: str, name: str = "rank",
                   descending: bool = True) -> DataFrame:
    """Add the 1-based row number inside each group by value, then by a unique id of any ordered type.

    Distinct values are ranked first; rows that share a value are ranked by id among themselves.
    Null values are not expected.
    """
    keys = list(keys)
    sign = -1.0 if descending else 1.0
    rows = df.withColumn("_v", sign * F.col(value).cast("double"))
    by_value = cumulative(value_table(rows, keys, "_v"), keys).select(*keys, F.col("v").alias("_v"), F.col("n_below").alias("_a"), F.col("n").alias("_n"))
    j = rows.join(by_value, [*keys, "_v"])
    tied = j.filter("_n > 1").select(*keys, "_v", F.col(tie_id).alias("_i"))
    inner = cumulative(value_table(tied, [*keys, "_v"], "_i", kind=None), [*keys, "_v"]).select(
        *keys, "_v", F.col("v").alias(tie_id), F.col("n_below").alias("_b"))
    out = j.join(inner, [*keys, "_v", tie_id], "left")
    return out.select(*df.columns, (F.col("_a") + F.coalesce("_b", F.lit(0)) + 1).alias(name))


def row_numbers(df: DataFrame, order_value: str, tie_id: str, name: str = "rank",
                descending: bool = True) -> DataFrame:
    """Global 1-based row number by value then by a unique id of any ordered type, over any number of rows.

    Null values rank last, among themselves by id.
    """
    sign = -1.0 if descending else 1.0
    shifted = df.withColumn("_order", F.coalesce(sign * F.col(order_value).cast("double"), F.lit(float("inf"))))
    return rank_in_groups(shifted, [], "_order", tie_id, name, descending=False).drop("_order")


def flag_top_fraction(df: DataFrame, score: str, tie_id: str, fraction: float = 0.10) -> DataFrame:
    """Rank by score (ties by id) and flag the first ceil(n * fraction) rows."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    total = df.agg(F.ceil(F.count(F.lit(1)) * F.lit(fraction)).alias("_cut"))
    return (attach_row(row_numbers(df, score, tie_id), total)
            .withColumn("top_fraction", F.col("rank") <= F.col("_cut")).drop("_cut"))
