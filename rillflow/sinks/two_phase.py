"""An exactly-once file sink: tasks stage files, the commit of a micro-batch moves them into place by rename.

Final names hold the batch and the partition, so a commit that is repeated after a failure has no further effect.
"""

from __future__ import annotations

import csv
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    path: str
    partition: int


class TwoPhaseWriter(DataSourceStreamWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> Staged:
        """begin, invoke and pre-commit: a file of this attempt's own, flushed to disk."""
        os.makedirs(f"{self.folder}/.staged", exist_ok=True)
        path, partition = f"{self.folder}/.staged/{uuid.uuid4().hex}", TaskContext.get().partitionId()
        with open(path, "w", newline="", encoding="utf-8") as out:
            csv.writer(out, lineterminator="\n").writerows(["" if v is None else v for v in row] for row in rows)
            out.flush()
            os.fsync(out.fileno())
        return Staged(path, partition)

    def commit(self, messages: list[Staged | None], batch_id: int) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.replace(m.path, f"{self.folder}/batch-{batch_id:08d}-{m.partition:05d}.csv")

    def abort(self, messages: list[Staged | None], batch_id: int) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class TwoPhaseSink(DataSource):
    """``df.writeStream.format("two_phase").option("path", folder)``; the folder must be one that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "two_phase"

    def streamWriter(self, schema, overwrite: bool) -> TwoPhaseWriter:
        return TwoPhaseWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TwoPhaseSink)
