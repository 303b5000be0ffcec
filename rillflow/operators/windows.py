"""Group windows over event time, count windows, and what custom triggers emit. Windows are left-closed, right-open
and aligned to the epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(*rest, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"))


def tumble(df: DataFrame, ts: str, size: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """Tumbling windows; no keys: one window for all."""
    return _flat(df.groupBy(*keys, F.window(ts, size)).agg(*(a.alias(n) for n, a in aggregates.items())))


def hop(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """Sliding windows: a row counts in each window that it lies in."""
    return _flat(df.groupBy(*keys, F.window(ts, size, slide)).agg(*(a.alias(n) for n, a in aggregates.items())))


def hop_in_panes(df: DataFrame, ts: str, size_s: int, slide_s: int, keys: list[str], count: str = "cnt") -> DataFrame:
    """Sliding counts from tumbling panes of one slide: rows are counted once, and only panes are copied."""
    if size_s % slide_s:
        raise ValueError(f"a window of {size_s} s is no whole number of slides of {slide_s} s")
    panes = df.groupBy(*keys, F.window(ts, f"{slide_s} seconds").alias("_pane")).agg(F.count(F.lit(1)).alias("_n"))
    shift = F.explode(F.sequence(F.lit(0), F.lit(size_s // slide_s - 1))).alias("_shift")
    spread = panes.select(*keys, "_n", F.col("_pane.end").alias("_end"), shift).withColumn("window_end", F.expr(f"_end + _shift * INTERVAL '{slide_s}' SECOND"))
    out = spread.groupBy(*keys, "window_end").agg(F.sum("_n").alias(count))
    return out.select(*keys, count, F.expr(f"window_end - INTERVAL '{size_s}' SECOND").alias("window_start"), "window_end")


def session(df: DataFrame, ts: str, gap: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """Session windows: start at the first row, end a gap after the last; rows exactly a gap apart merge."""
    grouped = df.groupBy(*keys, F.session_window(ts, gap).alias("window")).agg(*(a.alias(n) for n, a in aggregates.items()))
    return _flat(grouped)


def count_tumble(df: DataFrame, keys: list[str], order: list[str], size: int, **aggregates: Column) -> DataFrame:
    """Full windows of ``size`` rows of a key; a rest that is not full does not fire."""
    w = W.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("window_no", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))
    out = numbered.groupBy(*keys, "window_no").agg(F.count(F.lit(1)).alias("_n"), *(a.alias(n) for n, a in aggregates.items()))
    return out.where(F.col("_n") == size).drop("_n")


def count_slide(df: DataFrame, keys: list[str], order: list[str], size: int, slide: int, **aggregates: Column) -> DataFrame:
    """After each ``slide`` rows of a key, the last ``size`` rows (fewer at first)."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.select("*", F.row_number().over(w).alias("_rn"), *(a.over(w.rowsBetween(-(size - 1), 0)).alias(n) for n, a in aggregates.items()))
    return rows.where(F.col("_rn") % slide == 0).withColumn("window_no", (F.col("_rn") / slide).cast("bigint")).drop("_rn")


def distinct_exact(df: DataFrame, ts: str, size: str, column: str, name: str = "uv") -> DataFrame:
    """Distinct values per window: deduplicated by (window, value) first, so no task holds a window's set."""
    once = df.select(F.window(ts, size).alias("window"), column).distinct()
    return _flat(once.groupBy("window").agg(F.count(column).alias(name)))


def distinct_approx(df: DataFrame, ts: str, size: str, column: str, name: str = "uv", rsd: float = 0.01) -> DataFrame:
    return tumble(df, ts, size, [], **{name: F.approx_count_distinct(column, rsd)})


def fire_on_each(df: DataFrame, ts: str, size: str, keys: list[str], order: list[str]) -> DataFrame:
    """The count in its window so far, for every row: a trigger that fires on each element and purges nothing."""
    windowed = df.withColumn("window", F.window(ts, size))
    w = W.partitionBy(*keys, "window").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return _flat(windowed.withColumn("cnt", F.count(F.lit(1)).over(w)))


def fire_periodically(df: DataFrame, ts: str, size: str, every_s: int, keys: list[str], purge: bool = False) -> DataFrame:
    """Counts at each multiple of ``every_s`` after a window's first row up to its last, and at its end.

    ``fire_time`` is the boundary; without ``purge`` the counts are cumulative.
    """
    step = f"INTERVAL '{every_s}' SECOND"
    windowed = df.withColumn("window", F.window(ts, size)).withColumn("pane", F.window(ts, f"{every_s} seconds"))
    panes = windowed.groupBy(*keys, "window", "pane").agg(F.count(F.lit(1)).alias("n"))
    spans = panes.groupBy(*keys, "window").agg(F.min("pane.end").alias("first"), F.max("pane.end").alias("last"))
    spine = spans.select(*keys, "window", F.explode(F.expr(f"sequence(first, last, {step})")).alias("fire_time"))
    counts = panes.select(*keys, "window", F.col("pane.end").alias("fire_time"), "n")
    filled = spine.join(counts, [*keys, "window", "fire_time"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if not purge:
        w = W.partitionBy(*keys, "window").orderBy("fire_time").rowsBetween(W.unboundedPreceding, 0)
        filled = filled.withColumn("n", F.sum("n").over(w))
    return _flat(filled.withColumnRenamed("n", "cnt"))
