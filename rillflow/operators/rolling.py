"""Rolling aggregates: the updated value for every row, in a given order within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upto(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def rolling(df: DataFrame, keys: list[str], order: list[str], **aggregates: Column) -> DataFrame:
    """Each row with the named aggregates over the rows of its key up to it."""
    w = upto(keys, order)
    return df.select("*", *(a.over(w).alias(n) for n, a in aggregates.items()))


def statistics(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """min, max, sum, count and avg (integer, truncating) so far."""
    v = F.col(value).cast("bigint")
    out = rolling(df, keys, order, min=F.min(v), max=F.max(v), sum=F.sum(v), count=F.count(v))
    return out.withColumn("avg", F.expr("`sum` div nullif(`count`, 0)"))


def last_per_period(df: DataFrame, keys: list[str], period: Column, order: list[str]) -> DataFrame:
    """Of rolling rows the last of each period: what a periodic emission without reset shows."""
    w = W.partitionBy(*keys, period).orderBy(*(F.col(o).desc() for o in order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def sorted_history(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with the sorted list of its key's values so far. The output is quadratic in a key's rows by nature."""
    return df.withColumn("history", F.array_sort(F.collect_list(value).over(upto(keys, order))))


def final(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Only the last state: partial aggregation before the shuffle, no ordering."""
    return df.groupBy(*keys).agg(*(a.alias(n) for n, a in aggregates.items()))
