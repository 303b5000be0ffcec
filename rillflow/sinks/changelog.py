"""Changelogs: how an updating result differs from its last state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changelog(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``op`` to the updates of a result: +I for a key's first, +U for later ones, and the -U row before each +U."""
    w = W.partitionBy(*keys).orderBy(order)
    values = [c for c in updates.columns if c not in keys and c != order]
    rows = updates.withColumn("_before", F.lag(F.struct(*values)).over(w))
    new = rows.select(*updates.columns, F.when(F.col("_before").isNull(), "+I").otherwise("+U").alias("op"))
    old = rows.where("_before IS NOT NULL").select(*keys, order, *(F.col(f"_before.{v}").alias(v) for v in values), F.lit("-U").alias("op")).select(*updates.columns, "op")
    return new.unionByName(old)


def upsert_view(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last state of each key."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def labelled(df: DataFrame, label: str) -> DataFrame:
    """With a constant column in front, for consoles that several results share."""
    return df.select(F.lit(label).alias("label"), "*")


def kafka_writer(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """A stream writer of text to a topic; needs Spark's Kafka connector."""
    lines = df.select(F.col(df.columns[0]).cast("string").alias("value"))
    return lines.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
