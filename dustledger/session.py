"""Session defaults for local runs, and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks. A cluster brings its own session and settings."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("dustledger")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediate tables.

    It comes from ``spark.checkpoint.dir`` (shared storage, so the data outlives a lost executor).
    Where that is unset a new local folder is made, but only under a local master: on a cluster
    every executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="dustledger-work-")


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's checkpoint folder and cut its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_folder(spark))
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    Spark's estimates come from the files: rings, pieces and pairs made of a few narrow columns are many times larger than
    these, and a checkpoint keeps the estimate. A broadcast of such a side is built in the driver's memory.
    """
    return df.hint("shuffle_merge")


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi join on non-null keys in which adaptive skew handling can split a hot key of ``left``.

    Where ``right`` is an aggregate by the same keys, Spark reuses its partitioning for the join, and then
    all rows of a key stay in one task. Keys packed into a struct make both sides be exchanged for the join alone.
    """
    packed = right.select(F.struct(*on).alias("_join_key"), *[c for c in right.columns if c not in on])
    return left.withColumn("_join_key", F.struct(*on)).join(shuffled(packed), "_join_key", how).drop("_join_key")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` over all shuffle partitions before rows are multiplied in place.

    The count is explicit, so a small input with much work per row is not merged into few tasks, and
    a later aggregation by the same keys needs no further exchange.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def series(df: DataFrame, *keys: str, levels: int = 4) -> DataFrame:
    """Cluster whole series by ``keys`` for a chain of windows, ``levels`` slices per shuffle partition.

    Adaptive execution sizes partitions by their compressed bytes, and a chain of windows holds many times as much in each of its
    sorts; this exchange has a fixed count and is not merged.
    """
    n = levels * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by ``keys`` over all shuffle partitions, for much work per row that needs no clustering.

    Spark drops a ``spread`` by keys for which the rows are clustered already, and adaptive execution may have merged those
    partitions into one. The hash is another expression than the keys, so this exchange stays.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*keys))
