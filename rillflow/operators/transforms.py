"""Stateless transforms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import tokens


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """One row out for each row in: the named expressions."""
    return df.select(*(c.alias(n) for n, c in columns.items()))


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def flat_map(df: DataFrame, copies: Column) -> DataFrame:
    """Each row ``copies`` times; none for 0 or null."""
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.coalesce(copies, F.lit(0)).cast("int")))).drop("_copy")


def words(df: DataFrame, column: str = "text") -> DataFrame:
    """(word, 1) for each token of a line; trailing empty tokens are dropped."""
    return df.select(F.explode(tokens(F.col(column))).alias("word"), F.lit(1).alias("one"))


def map_with_lifecycle(df: DataFrame, make: Callable[[int], tuple[Callable[[pd.DataFrame], pd.DataFrame], Callable[[], None]]], schema: str) -> DataFrame:
    """``make(partition)`` opens a task's resources and returns (map a batch, close); close runs in any case."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        apply, close = make(TaskContext.get().partitionId())
        try:
            for batch in batches:
                yield apply(batch)
        finally:
            close()

    return df.mapInPandas(run, schema)


def process(df: DataFrame, **tags: Column) -> dict[str, DataFrame]:
    """Side outputs: for each tag the rows that its condition holds for, and "main" with the others."""
    rest = ~F.coalesce(F.greatest(*(F.coalesce(c, F.lit(False)) for c in tags.values())), F.lit(False)) if len(tags) > 1 else ~F.coalesce(next(iter(tags.values())), F.lit(False))
    return {t: df.where(c) for t, c in tags.items()} | {"main": df.where(rest)}
