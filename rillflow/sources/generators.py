"""Generated streams as Python data sources: seeded, replayable, and split over partitions.

Register with ``register(spark)``, then ``spark.readStream.format("clicks").option("seed", 1).load()``. Offsets are row
numbers, kept in the stream's checkpoint: a restart goes on where the last committed batch ended.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Fixed values.
USERS, URLS = ("Mary", "Bob", "Alice"), ("./home", "./cart", "./buy")


class Span(InputPartition):
    def __init__(self, start: int, end: int, index: int):
        self.start, self.end, self.index = start, end, index


class _Reader(DataSourceStreamReader):
    """``rows`` rows in all, ``batch`` of them a micro-batch, dealt over ``partitions`` tasks."""

    def __init__(self, options: dict, make):
        self.rows, self.batch = int(options.get("rows", 1 << 62)), int(options.get("batch", 10))
        self.tasks, self.seed, self.make = int(options.get("partitions", 1)), int(options.get("seed", 0)), make
        self.at = 0

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.rows, self.at + self.batch)
        return {"row": self.at}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.at = max(self.at, end["row"])
        a, b = start["row"], end["row"]
        cuts = [a + (b - a) * i // self.tasks for i in range(self.tasks + 1)]
        return [Span(x, y, i) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x] or [Span(a, a, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        for n in range(partition.start, partition.end):
            yield self.make(n, random.Random(f"{self.seed}:{n}"), partition.index)

    def commit(self, end: dict) -> None:
        pass


class _Generated(DataSource):
    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options, type(self).row)


class Clicks(_Generated):
    """Random clicks, one a second of event time."""

    @classmethod
    def name(cls) -> str:
        return "clicks"

    def schema(self) -> str:
        return "key string, value string, ts bigint"

    @staticmethod
    def row(n: int, rng: random.Random, index: int) -> tuple:
        return rng.choice(USERS), rng.choice(URLS), n * 1000


class Ints(_Generated):
    """Random integers below 10 000, one every 100 ms of event time."""

    @classmethod
    def name(cls) -> str:
        return "ints"

    def schema(self) -> str:
        return "value bigint, ts bigint"

    @staticmethod
    def row(n: int, rng: random.Random, index: int) -> tuple:
        return rng.randrange(10_000), n * 100


class Sensors(_Generated):
    """Three sensors' gaussian temperatures, one round every 300 ms of event time."""

    @classmethod
    def name(cls) -> str:
        return "sensors"

    def schema(self) -> str:
        return "sensorId string, temperature double, ts bigint"

    @staticmethod
    def row(n: int, rng: random.Random, index: int) -> tuple:
        return f"sensor_{n % 3 + 1}", rng.gauss(0, 1), n // 3 * 300


class Counter(_Generated):
    """0, 1, 2, …: a source that resumes at its offset; ``subtask`` is the partition that read the row."""

    @classmethod
    def name(cls) -> str:
        return "counter"

    def schema(self) -> str:
        return "value bigint, subtask int"

    @staticmethod
    def row(n: int, rng: random.Random, index: int) -> tuple:
        return n, index


def register(spark: SparkSession) -> None:
    for source in (Clicks, Ints, Sensors, Counter):
        spark.dataSource.register(source)
