"""Schema and row contracts: required columns, unique keys, set equality, run manifests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dustledger.operators.ranks import attach_row


class ContractError(ValueError):
    """A table does not satisfy the contract an operator relies on."""


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing required column(s): {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = duplicate_keys(df, keys).take(1)
    if bad:
        raise ContractError(f"duplicate key {bad[0].asDict()}")
    return df


def assert_not_empty(df: DataFrame, what: str) -> DataFrame:
    if not df.take(1):
        raise ContractError(f"{what} produced no rows")
    return df


def id_set_drift(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only: (keys..., side) with side 'lost' or 'gained'; empty when equal."""
    old, new = before.select(*keys).distinct(), after.select(*keys).distinct()
    lost = old.join(new, list(keys), "left_anti").withColumn("side", F.lit("lost"))
    gained = new.join(old, list(keys), "left_anti").withColumn("side", F.lit("gained"))
    return lost.unionByName(gained)


def assert_same_ids(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    drift = id_set_drift(before, after, keys).take(1)
    if drift:
        raise ContractError(f"id sets differ, e.g. {drift[0].asDict()}")
    return after


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which neither side repeats a key and no left row is lost."""
    assert_unique(left, keys)
    assert_unique(right, keys)
    if left.join(right, list(keys), "left_anti").take(1):
        raise ContractError("rows of the left side have no partner")
    return left.join(right, list(keys), "inner")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: count and an order-free content hash (a sum of row hashes, then a digest).

    The 32-bit halves of a per-row md5 are summed exactly, so neither row order nor
    partitioning changes the result.
    """
    cols = sorted(columns or df.columns)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in cols])
    row = F.md5(text)

    def half(start: int) -> Column:
        return F.conv(F.substring(row, start, 8), 16, 10).cast("decimal(20,0)")

    sums = df.select(half(1).alias("a"), half(9).alias("b")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.select("n_rows", F.md5(F.concat_ws(
        "|", F.col("n_rows").cast("string"), F.coalesce(F.col("a"), F.lit(0)).cast("string"),
        F.coalesce(F.col("b"), F.lit(0)).cast("string"))).alias("content_hash"))


RESERVED_MANIFEST_KEYS = ("stage", "n_rows", "content_hash")


def run_manifest(df: DataFrame, stage: str, metrics: dict[str, Column]) -> DataFrame:
    """One manifest row per stage; a metric may not reuse a reserved name."""
    clash = sorted(set(metrics) & set(RESERVED_MANIFEST_KEYS))
    if clash:
        raise ContractError(f"metric names are reserved: {clash}")
    out = fingerprint(df).withColumn("stage", F.lit(stage))
    if metrics:
        row = df.agg(*[c.alias(n) for n, c in metrics.items()])
        out = attach_row(out, row)
    return out.select("stage", "n_rows", "content_hash", *metrics)
