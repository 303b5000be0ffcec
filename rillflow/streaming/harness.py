"""Run a stream over bounded rows: replay them in ordered micro-batches, flush with a sentinel, read the result back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import streaming_settings

#: A time after all others. A row with it moves the watermark past every window and timer.
END = "2100-01-01 00:00:00"


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared folder; only a local session (tests) may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/rillflow/{name}-{uuid.uuid4().hex}"


def replay(df: DataFrame, order: str, batches: int, sentinels: list[DataFrame] | None = None) -> DataFrame:
    """``df`` as a stream of ``batches`` micro-batches in the order of ``order``, then one for each of ``sentinels``."""
    spark = df.sparkSession
    streaming_settings(spark)
    path = work_path(spark, "replay")
    lo, hi = df.agg(F.min(order).cast("double"), F.max(order).cast("double")).first()
    step = ((hi or 0) - (lo or 0)) / batches or 1
    part = F.least(F.floor((F.col(order).cast("double") - F.lit(lo or 0.0)) / step), F.lit(batches - 1))
    for i in range(batches):
        df.where(part == i).coalesce(1).write.mode("append").parquet(path)
    for s in sentinels or []:
        s.select(*df.columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def replay_batches(parts: list[DataFrame]) -> DataFrame:
    """Each of ``parts`` as one micro-batch: an explicit watermark is the end of a batch."""
    spark = parts[0].sparkSession
    streaming_settings(spark)
    path = work_path(spark, "replay")
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def collect(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run a stream to the end of its input; its output rows, with ``_batch``, as a table.

    In update mode all updates are there, later batches replacing earlier ones. Each batch's folder is overwritten if
    the batch is run again.
    """
    spark = stream.sparkSession
    out = out or work_path(spark, "collected")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint or work_path(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*stream.schema.fields]).add("_batch", LongType())
    return spark.read.schema(schema).option("basePath", out).parquet(out)


def split_by_tag(tags: list[str], write: Callable[[str, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: side outputs of one query, by the column ``tag``, each to its own sink."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for t in tags:
            write(t, batch.where(F.col("tag") == t), batch_id)
        batch.unpersist()

    return one


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of an update stream's rows the last of each key."""
    rest = [c for c in updates.columns if c not in keys and c != "_batch"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
