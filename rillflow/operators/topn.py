"""Rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import fold
from .windows import hop_in_panes


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "row_num") -> DataFrame:
    """The first ``n`` rows of each group, fewer if there are fewer. Spark prunes to n per group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def hot_items(events: DataFrame, item: str, ts: str = "ts", size_s: int = 3600, slide_s: int = 300, n: int = 3) -> DataFrame:
    """The ``n`` items of each sliding window with most rows; ties go to the smaller item. Rows are counted once, in panes."""
    counts = hop_in_panes(events, ts, size_s, slide_s, [item])
    return top_n(counts, ["window_end"], [F.col("cnt").desc(), F.col(item)], n)


def incremental_top_n(counts: DataFrame, by: list[str], order: list[str], item: str, count: str, n: int) -> DataFrame:
    """The ranking after each arrival, as rows (arrival, row_num, item, count): later rankings replace earlier ones.

    Only the ``n`` best so far are held for a group.
    """
    fields = [counts.schema[c] for c in (*by, *order)]
    schema = T.StructType([*fields, T.StructField("row_num", T.IntegerType()), counts.schema[item], counts.schema[count]])

    class Ranking:
        def __init__(self, key):
            self.key, self.best = key, []

        def row(self, *values):
            *at, i, c = values
            self.best = sorted([*self.best, (-c, i)])[:n]
            return [(*self.key, *at, k, i, -c) for k, (c, i) in enumerate(self.best, 1)]

        def end(self):
            return ()

    return fold(counts, by, order, [*order, item, count], schema, Ranking)
