"""What both classifiers share: the labelled sample, fitting in one task, and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import give_back


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the held-out fold, first by hash of id.

    Rows with a null id or label do not count; of repeated labels the largest counts; of rows that repeat an id the text
    with the least hash counts, alone. The ids are at most ``rows``, so they are broadcast and the documents are read in
    one pass; the rows of an id are reduced before their exchange.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


def fit_in_one_task(features: DataFrame, fit: Callable[[pa.Table], list[pa.Array]], schema: str, names: list[str]) -> dict:
    """Run ``fit`` on all rows of a bounded table in one task; its single row comes back to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(batches)
        table = pa.Table.from_batches(kept) if kept else None
        yield pa.record_batch(fit(table), names)

    row = features.repartition(1).mapInArrow(run, schema).first()
    return row.asDict() if row else {}


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], threshold: float) -> DataFrame:
    """``docs`` with score (double) and predicted (int) added. Only texts go to Python, and only scores come back."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in texts:
                yield pa.array(score(column))
        finally:
            give_back()

    rows = docs.drop("score", "predicted").withColumn("score", F.arrow_udf(run, "double")("text"))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
