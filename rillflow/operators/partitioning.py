"""How rows go to tasks. None of these changes which rows there are (but for ``broadcast_copies``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def key_by(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """By hash of the keys: all rows of a key come to one task."""
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def shuffle(df: DataFrame, partitions: int, seed: int = 0) -> DataFrame:
    """At random."""
    return df.repartition(partitions, F.rand(seed))


def rebalance(df: DataFrame, partitions: int) -> DataFrame:
    """Round-robin to all."""
    return df.repartition(partitions)


def rescale(df: DataFrame, upstream: int, downstream: int) -> DataFrame:
    """Each upstream partition deals its rows to its own share of the downstream ones; fewer: neighbours merge."""
    if downstream <= upstream:
        return df.coalesce(downstream)
    k = downstream // upstream
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(k)).cast("int")
    target = F.spark_partition_id() * k + turn
    return df.withColumn("_to", target).repartitionById(upstream * k, F.col("_to")).drop("_to")


def broadcast_copies(df: DataFrame, copies: int) -> DataFrame:
    """Every row once for each of ``copies`` consumers (column ``copy``)."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only if the optimizer's size estimate is within ``limit``; else the join shuffles."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def global_partition(df: DataFrame) -> DataFrame:
    """All rows to one task; only for tables known to be small."""
    return df.coalesce(1)


def partition_custom(df: DataFrame, partitions: int, target: Column) -> DataFrame:
    """Row r goes to partition ``target`` (0 .. partitions - 1)."""
    return df.repartitionById(partitions, target.cast("int"))
