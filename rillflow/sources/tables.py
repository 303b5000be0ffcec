"""Readers of bounded tables; schemas are explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import CLICKS


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")


def csv(spark: SparkSession, path: str, schema: str = CLICKS) -> DataFrame:
    return spark.read.schema(schema).csv(path)


def elements(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(rows, schema)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """An unbounded stream of lines; for trying things out, as a socket can't be replayed."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().withColumnRenamed("value", "text")


def kafka_options(servers: str, topic: str, offsets: str = "latest", **more: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": offsets} | more


def kafka_lines(spark: SparkSession, servers: str, topic: str, offsets: str = "latest", **more: str) -> DataFrame:
    """A topic's values as text; one task for each partition of the topic. Needs Spark's Kafka connector."""
    stream = spark.readStream.format("kafka").options(**kafka_options(servers, topic, offsets, **more)).load()
    return stream.selectExpr("CAST(value AS string) AS text", "timestamp")
