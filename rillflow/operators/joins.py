"""Joins and unions of streams' bounded forms."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def union_all(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows of all inputs, duplicates included."""
    for df in more:
        first = first.unionByName(df)
    return first


def co_map(left: DataFrame, right: DataFrame, left_cols: dict[str, Column], right_cols: dict[str, Column]) -> DataFrame:
    """Two inputs of different types, each by its own mapping, into one."""
    return left.select(*(c.alias(n) for n, c in left_cols.items())).unionByName(right.select(*(c.alias(n) for n, c in right_cols.items())))


def regular_join(left: DataFrame, right: DataFrame, on: list[str] | Column) -> DataFrame:
    """Inner equi-join over all history of both sides."""
    return left.join(right, on)


def window_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, size: str) -> DataFrame:
    """Pairs of equal keys in the same tumbling window; right-hand columns other than the keys get the suffix _r."""
    renamed = right.select(*(F.col(c) if c in keys else F.col(c).alias(f"{c}_r") for c in right.columns))
    l, r = left.withColumn("window", F.window(ts, size)), renamed.withColumn("window", F.window(f"{ts}_r", size))
    out = l.join(r, [*keys, "window"])
    return out.select(*left.columns, *(c for c in renamed.columns if c not in keys), F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, lower_s: int, upper_s: int, bucketed: bool = True) -> DataFrame:
    """Pairs of equal keys with right.ts in [left.ts + lower, left.ts + upper], bounds included.

    The time bucket is part of the join key (unless not ``bucketed``, for keys with few rows): left rows are copied to
    the buckets their interval meets, so a hot key is spread over time and no task compares its whole history.
    """
    renamed = right.select(*(F.col(c) if c in keys else F.col(c).alias(f"{c}_r") for c in right.columns))
    low, high = F.col(ts) + F.expr(f"INTERVAL '{lower_s}' SECOND"), F.col(ts) + F.expr(f"INTERVAL '{upper_s}' SECOND")
    inside = (F.col(f"{ts}_r") >= low) & (F.col(f"{ts}_r") <= high)
    if not bucketed:
        return left.join(renamed, keys).where(inside)
    width = max(1, upper_s - lower_s)
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (width * 1_000_000))
    l = left.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    r = renamed.withColumn("_bucket", bucket(F.col(f"{ts}_r")))
    return l.join(r, [*keys, "_bucket"]).where(inside).drop("_bucket")


def filter_by_latest(rows: DataFrame, queries: DataFrame, seq: str, value: str, query: str, span: int = 100_000) -> DataFrame:
    """Rows whose ``value`` equals the latest ``query`` before them in ``seq``; before the first query nothing matches.

    The queries are a control stream, seen by all keys. Each span of ``seq`` finds its own latest query; only the last one
    of each span, a row per span, is carried over the whole. A query at a row's own ``seq`` comes after the row.
    """
    both = rows.withColumn("_q", F.lit(None).cast("string")).unionByName(queries.select(seq, F.col(query).cast("string").alias("_q")), allowMissingColumns=True)
    both = both.withColumn("_r", F.floor(F.col(seq) / span).cast("bigint"))
    last = both.where("_q IS NOT NULL").groupBy("_r").agg(F.max_by("_q", seq).alias("_l"))
    spans = both.select("_r").distinct().join(last, "_r", "left")
    carried = spans.select("_r", F.last("_l", True).over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)).alias("_c"))
    own = F.last("_q", True).over(W.partitionBy("_r").orderBy(seq).rangeBetween(W.unboundedPreceding, -1))
    found = both.withColumn("_o", own).where("_q IS NULL").join(carried, "_r")
    return found.where(F.col(value) == F.coalesce("_o", "_c")).select(*rows.columns)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], ts: str, within_s: int) -> DataFrame:
    """Match the first row of each side of a key within ``within_s`` seconds, else report which side is missing.

    Columns: keys, left_ts, right_ts, status (matched, right-missing, left-missing). A pair farther apart gives two
    reports, one for each side.
    """
    l = left.groupBy(*keys).agg(F.min(ts).alias("left_ts"))
    r = right.groupBy(*keys).agg(F.min(ts).alias("right_ts"))
    both = l.join(r, keys, "full_outer")
    apart = F.abs(F.unix_micros(F.col("left_ts").cast("timestamp")) - F.unix_micros(F.col("right_ts").cast("timestamp"))) > within_s * 1_000_000
    status = (
        F.when(F.col("right_ts").isNull(), F.array(F.lit("right-missing")))
        .when(F.col("left_ts").isNull(), F.array(F.lit("left-missing")))
        .when(apart, F.array(F.lit("right-missing"), F.lit("left-missing")))
        .otherwise(F.array(F.lit("matched")))
    )
    out = both.withColumn("status", F.explode(status))
    return out.withColumn("left_ts", F.when(F.col("status") != "left-missing", F.col("left_ts"))).withColumn("right_ts", F.when(F.col("status") != "right-missing", F.col("right_ts")))


def reconcile_all(left: DataFrame, right: DataFrame, keys: list[str], ts: str, within_s: int, order: list[str]) -> DataFrame:
    """Match every row of both sides of a key one to one within ``within_s`` seconds, else report which side is missing.

    Per key in the order of ``ts``, then ``order``, then left before right: a row that meets a waiting row of the other
    side matches the one that has waited longest, and is used up with it; otherwise it waits. A row that has waited
    ``within_s`` seconds is due before a row of that time, as with the reference's timer. Columns: keys, left_ts,
    right_ts, status; a row per match and per row without one. Rows with a null key or time are compared with nothing.
    """
    names = [f"_{c}" for c in ("side", "us", *(f"o{i}" for i in range(len(order))))]

    def side(df: DataFrame, number: int) -> DataFrame:
        cols = [F.lit(number), F.unix_micros(F.col(ts).cast("timestamp")), *(F.col(c) for c in order)]
        return df.select(*keys, F.col(ts).alias("_ts"), *(c.alias(n) for c, n in zip(cols, names, strict=True)))

    both = side(left, 0).unionByName(side(right, 1))
    ordered = [c for c in names if c != "_side"]
    known = both.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, "_ts"]))
    schema = T.StructType([*(both.schema[k] for k in keys), T.StructField("left_ts", both.schema["_ts"].dataType), T.StructField("right_ts", both.schema["_ts"].dataType), T.StructField("status", T.StringType())])
    arrow = to_arrow_schema(schema)
    within = within_s * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, out = None, deque(), []

        def left_alone(at, us, number):
            return (*at, None if number else us, us if number else None, "left-missing" if number else "right-missing")

        def packed():
            cols = list(zip(*out, strict=True)) if out else [[] for _ in arrow]
            out.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for *own, at, number, us in zip(*(batch.column(c).to_pylist() for c in [*keys, "_ts", "_side", "_us"]), strict=True):
                if own != key:
                    out += [left_alone(key, t, n) for t, n, _ in waiting]
                    waiting.clear()
                    key = own
                while waiting and waiting[0][2] + within <= us:
                    t, n, _ = waiting.popleft()
                    out.append(left_alone(key, t, n))
                if waiting and waiting[0][1] != number:
                    t, n, _ = waiting.popleft()
                    out.append((*key, at if n else t, t if n else at, "matched"))
                else:
                    waiting.append((at, number, us))
                if len(out) >= 20_000:
                    yield packed()
        out += [left_alone(key, t, n) for t, n, _ in waiting]
        yield packed()

    dealt = known.repartition(*keys).sortWithinPartitions(*keys, *ordered, "_side")
    unknown = both.where(" OR ".join(f"`{c}` IS NULL" for c in [*keys, "_ts"]))
    alone = unknown.select(*keys, F.when(F.col("_side") == 0, F.col("_ts")).alias("left_ts"), F.when(F.col("_side") == 1, F.col("_ts")).alias("right_ts"), F.when(F.col("_side") == 0, "right-missing").otherwise("left-missing").alias("status"))
    return dealt.mapInArrow(fold, schema).unionByName(alone)
