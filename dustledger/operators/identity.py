"""Stable ids from quantized centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dustledger.operators.ranks import rank_in_groups


def stable_ids(df: DataFrame, id_col: str, x: str, y: str, area: str, namespace: str, step_m: float = 1.0) -> DataFrame:
    """Add stable_id: 12 hex digits of the namespaced centroid on a ``step_m`` grid.

    Rows that share a quantized centroid are ranked by area (largest first, then id) and the later
    ones get a suffixed id. Only colliding rows take part in that ranking.
    """
    q = lambda c: F.rint(F.col(c) / step_m).cast("long").cast("string")
    base = F.substring(F.sha2(F.concat_ws("|", F.lit(namespace), q(x), q(y)), 256), 1, 12)
    rows = df.withColumn("_base", base)
    crowd = rows.groupBy("_base").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    single = rows.join(crowd, "_base", "left_anti").withColumn("stable_id", F.col("_base"))
    many = rows.join(crowd.select("_base"), "_base")
    ranked = rank_in_groups(many, ["_base"], area, id_col, "_rk").withColumn("_r", (F.col("_rk") - 1).cast("string"))
    suffixed = F.substring(F.sha2(F.concat_ws("|", F.col("_base"), F.col("_r")), 256), 1, 12)
    ranked = ranked.withColumn("stable_id", F.when(F.col("_r") == "0", F.col("_base")).otherwise(suffixed))
    return single.drop("_base").unionByName(ranked.drop("_base", "_rk", "_r"))
