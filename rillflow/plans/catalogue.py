"""The engine's registered queries on the driver's tables, each with the SQL of the same result.

``event_type`` view stands for a page view, error for a failure, signup for a success, click for an order's creation
and purchase for its payment; ``user_id`` is the key, and the item where items are ranked. Sums of doubles are taken in
decimals, so that both engines agree in every digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import tokens
from ..operators import cep, joins, lateness, partitioning, rolling, topn, transforms, windows
from ..sources.tables import parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CENTS = "decimal(18,2)"
EPOCH = "TIMESTAMP '1970-01-01'"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "events")


def of_type(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("event_type") == kind)


def long_value() -> F.Column:
    return F.floor("value").cast("bigint")


@query("SELECT event_id, user_id * 2 AS doubled, event_type AS kind FROM events")
def map_project(spark, d):
    return transforms.map_rows(events(spark, d), event_id=F.col("event_id"), doubled=F.col("user_id") * 2, kind=F.col("event_type"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'view'")
def filter_eq(spark, d):
    return transforms.filter_rows(events(spark, d), F.col("event_type") == "view").select("event_id", "user_id", "event_type")


@query("SELECT event_id, event_type FROM events, range(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END)")
def flatmap_repeat(spark, d):
    copies = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(0)
    return transforms.flat_map(events(spark, d).select("event_id", "event_type"), copies)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'view'")
def parse_and_filter(spark, d):
    rows = of_type(events(spark, d), "view")
    return rows.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""
SELECT word, count(*)::BIGINT AS cnt FROM (
  SELECT unnest(string_split(rtrim(coalesce(text, ''), ' '), ' ')) AS word FROM documents WHERE rtrim(coalesce(text, ''), ' ') <> '')
GROUP BY word
""")
def word_count(spark, d):
    return rolling.final(transforms.words(parquet(spark, d, "documents")), ["word"], cnt=F.count(F.lit(1)))


@query("SELECT doc_id, len(string_split(rtrim(coalesce(text, ''), ' '), ' '))::BIGINT * CASE WHEN rtrim(coalesce(text, ''), ' ') = '' THEN 0 ELSE 1 END AS n_tokens FROM documents")
def token_count(spark, d):
    return parquet(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


RUN = "OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT event_id, user_id, CAST(sum(CAST(value AS {CENTS})) {RUN} AS DECIMAL(28,2)) AS total FROM events")
def running_sum(spark, d):
    return rolling.rolling(events(spark, d), ["user_id"], ["event_id"], total=F.sum(F.col("value").cast(CENTS))).select("event_id", "user_id", F.col("total").cast("decimal(28,2)").alias("total"))


@query(f"SELECT event_id, max(value) {RUN} AS hi FROM events")
def running_max(spark, d):
    return rolling.rolling(events(spark, d), ["user_id"], ["event_id"], hi=F.max("value")).select("event_id", "hi")


@query(f"SELECT event_id, min(value) {RUN} AS lo FROM events")
def running_min(spark, d):
    return rolling.rolling(events(spark, d), ["user_id"], ["event_id"], lo=F.min("value")).select("event_id", "lo")


STATS = f"min(v) {RUN} AS min, max(v) {RUN} AS max, CAST(sum(v) {RUN} AS BIGINT) AS sum, count(v) {RUN} AS count"
STATS_FROM = "(SELECT *, CAST(floor(value) AS BIGINT) AS v FROM events)"


@query(f"SELECT event_id, user_id, min, max, sum FROM (SELECT event_id, user_id, {STATS} FROM {STATS_FROM})")
def running_min_max_sum(spark, d):
    return rolling.statistics(events(spark, d).withColumn("v", long_value()), ["user_id"], ["event_id"], "v").select("event_id", "user_id", "min", "max", "sum")


@query(f"SELECT event_id, user_id, sum // count AS avg FROM (SELECT event_id, user_id, {STATS} FROM {STATS_FROM})")
def running_int_avg(spark, d):
    return rolling.statistics(events(spark, d).withColumn("v", long_value()), ["user_id"], ["event_id"], "v").select("event_id", "user_id", "avg")


@query(f"SELECT event_id, user_id, min, max, sum, count, sum // count AS avg FROM (SELECT event_id, user_id, {STATS} FROM {STATS_FROM})")
def keyed_stats(spark, d):
    return rolling.statistics(events(spark, d).withColumn("v", long_value()), ["user_id"], ["event_id"], "v").select("event_id", "user_id", "min", "max", "sum", "count", "avg")


@query(f"""
SELECT user_id, period, sum, count FROM (
  SELECT user_id, period, sum, count, row_number() OVER (PARTITION BY user_id, period ORDER BY event_id DESC) AS rn
  FROM (SELECT event_id, user_id, time_bucket(INTERVAL '1 hour', ts, {EPOCH}) AS period, {STATS} FROM {STATS_FROM})) WHERE rn = 1
""")
def stats_every_hour(spark, d):
    rows = rolling.statistics(events(spark, d).withColumn("v", long_value()).withColumn("period", F.window("ts", "1 hour").start), ["user_id"], ["event_id"], "v")
    return rolling.last_per_period(rows, ["user_id"], F.col("period"), ["event_id"]).select("user_id", "period", "sum", "count")


@query("""
SELECT event_id, CAST(list_aggregate(list_sort(list(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), 'string_agg', ',') AS VARCHAR) AS history
FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM events)
""")
def sorted_history(spark, d):
    rows = rolling.sorted_history(events(spark, d).withColumn("v", long_value()), ["user_id"], ["event_id"], "v")
    return rows.select("event_id", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"))


@query("SELECT user_id, event_type, count(*)::BIGINT AS cnt FROM events GROUP BY ALL")
def url_count_map(spark, d):
    counts = rolling.final(events(spark, d), ["user_id", "event_type"], cnt=F.count(F.lit(1)))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "cnt"))).alias("m"))
    return maps.select("user_id", F.explode("m").alias("event_type", "cnt"))


@query("SELECT user_id % 2 AS parity, count(*)::BIGINT AS cnt, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def parity_sum(spark, d):
    return rolling.final(events(spark, d).withColumn("parity", F.col("user_id") % 2), ["parity"], cnt=F.count(F.lit(1)), total=F.sum("event_id"))


@query("SELECT user_id AS user, count(user_id)::BIGINT AS cnt FROM events GROUP BY user_id")
def group_count_sql(spark, d):
    from .dialect import Dialect

    engine = Dialect(spark)
    engine.view("clicks", events(spark, d).withColumnRenamed("user_id", "user"))
    return engine.query("SELECT user, COUNT(user) AS cnt FROM clicks GROUP BY user")


@query(f"SELECT user_id, count(*)::BIGINT AS cnt, b AS window_start, b + INTERVAL '1 hour' AS window_end FROM (SELECT user_id, time_bucket(INTERVAL '1 hour', ts, {EPOCH}) AS b FROM events) GROUP BY user_id, b")
def tumble_count(spark, d):
    return windows.tumble(events(spark, d), "ts", "1 hour", ["user_id"], cnt=F.count(F.lit(1)))


@query(f"SELECT user_id, lo, hi, total, b AS window_start, b + INTERVAL '1 day' AS window_end FROM (SELECT user_id, time_bucket(INTERVAL '1 day', ts, {EPOCH}) AS b, min(value) AS lo, max(value) AS hi, CAST(sum(CAST(value AS {CENTS})) AS DECIMAL(28,2)) AS total FROM events GROUP BY ALL)")
def tumble_aggregate_day(spark, d):
    return windows.tumble(events(spark, d), "ts", "1 day", ["user_id"], lo=F.min("value"), hi=F.max("value"), total=F.sum(F.col("value").cast(CENTS)))


@query(f"SELECT count(*)::BIGINT AS cnt, b AS window_start, b + INTERVAL '1 hour' AS window_end FROM (SELECT time_bucket(INTERVAL '1 hour', ts, {EPOCH}) AS b FROM events) GROUP BY b")
def window_all_count(spark, d):
    return windows.tumble(events(spark, d), "ts", "1 hour", [], cnt=F.count(F.lit(1)))


@query(f"SELECT user_id, count(*)::BIGINT AS cnt, b + INTERVAL '1 hour' AS end_time FROM (SELECT user_id, time_bucket(INTERVAL '1 hour', ts, {EPOCH}) AS b FROM events) GROUP BY user_id, b")
def tumble_sql(spark, d):
    from .dialect import Dialect

    engine = Dialect(spark)
    engine.view("clicks", events(spark, d))
    return engine.query("SELECT user_id, COUNT(user_id) AS cnt, TUMBLE_END(ts, INTERVAL '1' HOURS) AS end_time FROM clicks GROUP BY user_id, TUMBLE(ts, INTERVAL '1' HOURS)")


HOP = f"""
(SELECT user_id, time_bucket(INTERVAL '5 minutes', ts, {EPOCH}) - k * INTERVAL '5 minutes' AS s FROM events, range(12) t(k){{where}})
"""
HOP_COUNT = "SELECT user_id, count(*)::BIGINT AS cnt, s AS window_start, s + INTERVAL '1 hour' AS window_end FROM " + HOP.format(where="") + " GROUP BY user_id, s"


@query(HOP_COUNT)
def hop_count(spark, d):
    return windows.hop(events(spark, d), "ts", "1 hour", "5 minutes", ["user_id"], cnt=F.count(F.lit(1)))


@query(HOP_COUNT)
def hop_count_panes(spark, d):
    return windows.hop_in_panes(events(spark, d), "ts", 3600, 300, ["user_id"])


@query(HOP_COUNT)
def hop_count_sql(spark, d):
    from .dialect import Dialect

    engine = Dialect(spark)
    engine.view("clicks", events(spark, d))
    return engine.query(
        "SELECT user_id, COUNT(user_id) AS cnt, HOP_START(ts, INTERVAL '5' MINUTES, INTERVAL '1' HOURS) AS window_start, HOP_END(ts, INTERVAL '5' MINUTES, INTERVAL '1' HOURS) AS window_end"
        " FROM clicks GROUP BY user_id, HOP(ts, INTERVAL '5' MINUTES, INTERVAL '1' HOURS)"
    )


TOP3 = """
SELECT user_id, cnt, window_start, window_end, row_num FROM (
  SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY cnt DESC, user_id)::INTEGER AS row_num FROM (
    SELECT user_id, count(*)::BIGINT AS cnt, s AS window_start, s + INTERVAL '1 hour' AS window_end FROM """ + HOP.format(where=" WHERE event_type = 'view'") + """ GROUP BY user_id, s))
WHERE row_num <= 3
"""


@query(TOP3)
def hot_items_top3(spark, d):
    return topn.hot_items(of_type(events(spark, d), "view").select("user_id", "ts"), "user_id")


@query(TOP3)
def hot_items_top3_sql(spark, d):
    from .dialect import Dialect

    engine = Dialect(spark)
    engine.view("views", of_type(events(spark, d), "view"))
    inner = "SELECT user_id, COUNT(user_id) AS cnt, HOP_START(ts, INTERVAL '5' MINUTES, INTERVAL '1' HOURS) AS window_start, HOP_END(ts, INTERVAL '5' MINUTES, INTERVAL '1' HOURS) AS window_end FROM views GROUP BY user_id, HOP(ts, INTERVAL '5' MINUTES, INTERVAL '1' HOURS)"
    return engine.query(f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY window_end ORDER BY cnt DESC, user_id) AS row_num FROM ({inner})) WHERE row_num <= 3")


@query("""
WITH c AS (SELECT event_type, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS b, user_id, count(*)::BIGINT AS cnt FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT b AS day, x.user_id AS arrival, row_number() OVER (PARTITION BY b, x.user_id ORDER BY cnt DESC, item)::INTEGER AS row_num, item AS user_id, cnt FROM (
  SELECT a.b, a.user_id, o.user_id AS item, o.cnt FROM c a JOIN c o ON a.b = o.b AND o.user_id <= a.user_id) x
QUALIFY row_num <= 3
""")
def incremental_top3(spark, d):
    counts = of_type(events(spark, d), "error").groupBy(F.window("ts", "1 day").start.alias("day"), "user_id").agg(F.count(F.lit(1)).alias("cnt"))
    out = topn.incremental_top_n(counts.withColumn("arrival", F.col("user_id")).withColumnRenamed("user_id", "item"), ["day"], ["arrival"], "item", "cnt", 3)
    return out.select("day", "arrival", "row_num", F.col("item").alias("user_id"), "cnt")


@query("""
SELECT user_id, count(*)::BIGINT AS cnt, min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end FROM (
  SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, sid
""")
def session_count(spark, d):
    return windows.session(events(spark, d), "ts", "6 hours", ["user_id"], cnt=F.count(F.lit(1)))


@query("""
SELECT user_id, w AS window_no, CAST(sum(event_id) AS BIGINT) AS total FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS w FROM events)
GROUP BY user_id, w HAVING count(*) = 5
""")
def count_window_tumbling(spark, d):
    return windows.count_tumble(events(spark, d), ["user_id"], ["event_id"], 5, total=F.sum("event_id"))


@query("""
SELECT user_id, event_id, rn // 2 AS window_no, total FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
         CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM events)
WHERE rn % 2 = 0
""")
def count_window_sliding(spark, d):
    return windows.count_slide(events(spark, d), ["user_id"], ["event_id"], 5, 2, total=F.sum("event_id")).select("user_id", "event_id", "window_no", "total")


@query(f"SELECT count(DISTINCT user_id)::BIGINT AS uv, b AS window_start, b + INTERVAL '1 hour' AS window_end FROM (SELECT user_id, time_bucket(INTERVAL '1 hour', ts, {EPOCH}) AS b FROM events WHERE event_type = 'view') GROUP BY b")
def uv_exact_hourly(spark, d):
    return windows.distinct_exact(of_type(events(spark, d), "view"), "ts", "1 hour", "user_id")


@query()
def uv_approx_hourly(spark, d):
    return windows.distinct_approx(of_type(events(spark, d), "view"), "ts", "1 hour", "user_id")


@query()
def uv_bloom_hourly(spark, d):
    from ..functions.sketches import bloom_counts

    views = of_type(events(spark, d), "view").select(F.window("ts", "1 hour").alias("w"), "user_id")
    return bloom_counts(views.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "user_id"), ["window_start", "window_end"], "user_id")


UV_BOUNDS = f"SELECT b AS window_start, true AS close FROM (SELECT DISTINCT time_bucket(INTERVAL '1 hour', ts, {EPOCH}) AS b FROM events WHERE event_type = 'view')"


@query(UV_BOUNDS)
def uv_approx_bounds(spark, d):
    """Each window, with whether the sketch's count is within 5 % of the exact one."""
    both = uv_approx_hourly(spark, d).join(uv_exact_hourly(spark, d).select("window_start", F.col("uv").alias("exact")), "window_start", "full_outer")
    return both.select("window_start", F.coalesce(F.abs(F.col("uv") - F.col("exact")) <= F.greatest(F.lit(1), 0.05 * F.col("exact")), F.lit(False)).alias("close"))


@query(UV_BOUNDS)
def uv_bloom_bounds(spark, d):
    """Each window, with whether the filters' count is at most the exact one, and at most 5 % below it."""
    both = uv_bloom_hourly(spark, d).join(uv_exact_hourly(spark, d).select("window_start", F.col("uv").alias("exact")), "window_start", "full_outer")
    close = (F.col("uv") <= F.col("exact")) & (F.col("uv") >= F.floor(0.95 * F.col("exact")) - 1)
    return both.select("window_start", F.coalesce(close, F.lit(False)).alias("close"))


@query(f"SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id, b ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cnt, b AS window_start, b + INTERVAL '1 day' AS window_end FROM (SELECT *, time_bucket(INTERVAL '1 day', ts, {EPOCH}) AS b FROM events)")
def trigger_each_element(spark, d):
    return windows.fire_on_each(events(spark, d).select("event_id", "user_id", "ts"), "ts", "1 day", ["user_id"], ["event_id"]).drop("ts")


@query(f"""
WITH p AS (SELECT user_id, time_bucket(INTERVAL '1 day', ts, {EPOCH}) AS b, time_bucket(INTERVAL '1 hour', ts, {EPOCH}) + INTERVAL '1 hour' AS f, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT user_id, b, unnest(generate_series(min(f), max(f), INTERVAL '1 hour')) AS f FROM p GROUP BY user_id, b)
SELECT s.user_id, s.f AS fire_time, CAST(sum(coalesce(p.n, 0)) OVER (PARTITION BY s.user_id, s.b ORDER BY s.f ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cnt, s.b AS window_start, s.b + INTERVAL '1 day' AS window_end
FROM s LEFT JOIN p ON p.user_id = s.user_id AND p.b = s.b AND p.f = s.f
""")
def trigger_every_hour(spark, d):
    return windows.fire_periodically(events(spark, d), "ts", "1 day", 3600, ["user_id"])


JITTER = "(SELECT *, event_id * 16 + (event_id * 7919 % 13) * 40 AS seq, epoch_ms(ts) AS ms FROM events)"
LATE = f"(SELECT *, max(ms) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {{bound}} - 1 AS wm FROM {JITTER})"
BOUND, SIZE, LATENESS = 600_000, 3_600_000, 3_600_000


def jittered(spark: SparkSession, d: str) -> DataFrame:
    """Events in an arrival order that differs from that of their times, the same in both engines."""
    return events(spark, d).withColumn("seq", F.col("event_id") * 16 + (F.col("event_id") * 7919 % 13) * 40)


@query(f"SELECT event_id, CASE WHEN ms < wm THEN 'late' ELSE 'main' END AS tag FROM {LATE.format(bound=BOUND)}")
def late_split(spark, d):
    return lateness.late_split(jittered(spark, d), "seq", "ts", BOUND).select("event_id", "tag")


@query(f"SELECT event_id, (ms // {SIZE}) * {SIZE} + {SIZE} AS end_ms FROM {LATE.format(bound=BOUND)} WHERE wm >= (ms // {SIZE}) * {SIZE} + {SIZE} - 1")
def window_late_side_output(spark, d):
    return lateness.window_late_split(jittered(spark, d), "seq", "ts", BOUND, SIZE).where("tag = 'late'").select("event_id", "end_ms")


@query(f"""
WITH r AS (
  SELECT user_id, end_ms, seq, coalesce(wm < end_ms - 1, true) AS on_time, count(*) OVER (PARTITION BY user_id, end_ms ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cnt
  FROM (SELECT *, (ms // {SIZE}) * {SIZE} + {SIZE} AS end_ms FROM {LATE.format(bound=BOUND)}) WHERE coalesce(wm < end_ms - 1 + {LATENESS}, true)),
f AS (SELECT user_id, end_ms, max(cnt) AS cnt FROM r WHERE on_time GROUP BY ALL UNION ALL SELECT user_id, end_ms, cnt FROM r WHERE NOT on_time)
SELECT user_id, end_ms, cnt, row_number() OVER (PARTITION BY user_id, end_ms ORDER BY cnt) AS firing FROM f
""")
def allowed_lateness(spark, d):
    return lateness.allowed_lateness(jittered(spark, d), "seq", "ts", ["user_id"], BOUND, SIZE, LATENESS)


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, user_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, user_id FROM events WHERE user_id < 10")
def union_all(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type")
    return joins.union_all(of_type(e, "view"), of_type(e, "click"), e.where("user_id < 10")).select("event_id", "user_id")


@query("SELECT 'order' AS kind, o_orderkey AS id, o_orderstatus AS detail FROM orders UNION ALL SELECT 'customer', c_custkey, c_mktsegment FROM customer")
def connect_map(spark, d):
    o, c = parquet(spark, d, "orders"), parquet(spark, d, "customer")
    return joins.co_map(o, c, {"kind": F.lit("order"), "id": F.col("o_orderkey"), "detail": F.col("o_orderstatus")}, {"kind": F.lit("customer"), "id": F.col("c_custkey"), "detail": F.col("c_mktsegment")})


@query("""
SELECT e.event_id, e.event_type FROM events e JOIN (
  SELECT event_id AS f, lead(event_id) OVER (ORDER BY event_id) AS t, CASE event_id // 97 % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'error' END AS q FROM events WHERE event_id % 97 = 0) c
ON e.event_id > c.f AND (c.t IS NULL OR e.event_id < c.t) AND e.event_type = c.q WHERE e.event_id % 97 <> 0
""")
def broadcast_filter(spark, d):
    e = events(spark, d)
    kind = (F.col("event_id") / 97).cast("bigint") % 3
    queries = e.where("event_id % 97 = 0").select("event_id", F.when(kind == 0, "view").when(kind == 1, "click").otherwise("error").alias("query"))
    rows = e.where("event_id % 97 <> 0").select("event_id", "event_type")
    return joins.filter_by_latest(rows, queries, "event_id", "event_type", "query")


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def regular_join(spark, d):
    o, l = parquet(spark, d, "orders"), parquet(spark, d, "lineitem")
    return joins.regular_join(o, l, o.o_orderkey == l.l_orderkey).select("o_orderkey", "o_custkey", "l_linenumber", "l_extendedprice")


@query(f"""
SELECT l.user_id, l.event_id, r.event_id AS event_id_r, l.b AS window_start, l.b + INTERVAL '1 day' AS window_end
FROM (SELECT *, time_bucket(INTERVAL '1 day', ts, {EPOCH}) AS b FROM events WHERE event_type = 'click') l JOIN (SELECT *, time_bucket(INTERVAL '1 day', ts, {EPOCH}) AS b FROM events WHERE event_type = 'purchase') r
ON l.user_id = r.user_id AND l.b = r.b
""")
def window_join(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ts", "event_type")
    out = joins.window_join(of_type(e, "click"), of_type(e, "purchase"), ["user_id"], "ts", "1 day")
    return out.select("user_id", "event_id", "event_id_r", "window_start", "window_end")


INTERVAL_SQL = """
SELECT l.user_id, l.event_id, r.event_id AS event_id_r FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL '5 minutes' AND l.ts + INTERVAL '15 minutes'
WHERE l.event_type = 'click' AND r.event_type = 'view'
"""


@query(INTERVAL_SQL)
def interval_join(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ts", "event_type")
    return joins.interval_join(of_type(e, "click"), of_type(e, "view"), ["user_id"], "ts", -300, 900).select("user_id", "event_id", "event_id_r")


@query(INTERVAL_SQL)
def interval_join_bucketed(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ts", "event_type")
    return joins.interval_join(of_type(e, "click"), of_type(e, "view"), ["user_id"], "ts", -300, 900, bucketed=True).select("user_id", "event_id", "event_id_r")


@query("""
WITH b AS (SELECT coalesce(l.user_id, r.user_id) AS user_id, l.ts AS lt, r.ts AS rt FROM (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY 1) l
           FULL JOIN (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY 1) r ON l.user_id = r.user_id),
m AS (SELECT *, lt IS NOT NULL AND rt IS NOT NULL AND abs(epoch_ms(lt) - epoch_ms(rt)) <= 21600000 AS ok FROM b)
SELECT user_id, lt AS left_ts, rt AS right_ts, 'matched' AS status FROM m WHERE ok
UNION ALL SELECT user_id, lt, NULL, 'right-missing' FROM m WHERE NOT ok AND lt IS NOT NULL
UNION ALL SELECT user_id, NULL, rt, 'left-missing' FROM m WHERE NOT ok AND rt IS NOT NULL
""")
def reconcile(spark, d):
    e = events(spark, d)
    return joins.reconcile(of_type(e, "click"), of_type(e, "purchase"), ["user_id"], "ts", 21_600).select("user_id", "left_ts", "right_ts", "status")


@query()
def reconcile_all(spark, d):
    e = events(spark, d)
    return joins.reconcile_all(of_type(e, "click"), of_type(e, "purchase"), ["user_id"], "ts", 21_600, ["event_id"])


CEP3 = """
SELECT user_id, t1 AS fail_1_ts, t2 AS fail_2_ts, ts AS fail_3_ts FROM (
  SELECT user_id, ts, event_type AS e3, lag(event_type, 1) OVER w AS e2, lag(event_type, 2) OVER w AS e1, lag(ts, 1) OVER w AS t2, lag(ts, 2) OVER w AS t1
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE e1 = 'error' AND e2 = 'error' AND e3 = 'error'
"""


@query(CEP3)
def cep_three_fails(spark, d):
    pattern = cep.Pattern.begin("fail").where(F.col("event_type") == "error").times(3).consecutive()
    return cep.match(events(spark, d), pattern, ["user_id"], "ts", ["ts", "event_id"])


@query("""
SELECT user_id, ts AS create_ts, CASE WHEN status = 'matched' THEN nt END AS pay_ts, status FROM (
  SELECT *, CASE WHEN nt IS NULL OR nt - ts >= INTERVAL '6 hours' THEN 'timeout' WHEN ne = 'purchase' THEN 'matched' END AS status FROM (
    SELECT user_id, ts, event_type, lead(event_type) OVER w AS ne, lead(ts) OVER w AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'click')
WHERE status IS NOT NULL
""")
def cep_next_within_timeout(spark, d):
    pattern = cep.Pattern.begin("create").where(F.col("event_type") == "click").next("pay").where(F.col("event_type") == "purchase").within(6 * 3600)
    return cep.match_or_timeout(events(spark, d), pattern, ["user_id"], "ts", ["ts", "event_id"])


@query("""
SELECT user_id, ts, CASE WHEN event_type = 'signup' THEN 'success' ELSE 'fail' END AS output FROM (
  SELECT *, CASE WHEN event_type = 'error' THEN row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - CASE WHEN run > 0 THEN 1 ELSE 0 END END AS nth FROM (
    SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events WHERE event_type IN ('error', 'signup')))
WHERE event_type = 'signup' OR nth >= 3
""")
def state_machine(spark, d):
    table = {("s0", "error"): "s1", ("s1", "error"): "s2", ("s2", "error"): "bad", ("s0", "signup"): "ok", ("s1", "signup"): "ok", ("s2", "signup"): "ok"}
    rows = events(spark, d).where("event_type IN ('error', 'signup')")
    return cep.state_machine(rows, table, "s0", {"bad": ("fail", "s2"), "ok": ("success", "s0")}, ["user_id"], "event_type", "ts", ["ts", "event_id"])


RISING = """
WITH RECURSIVE e AS (
  SELECT user_id, epoch_us(ts) // 1000 AS ms, value > lag(value) OVER w AS rise, sum(CASE WHEN fall THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fall FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
u AS (SELECT user_id, run, lead(min(ms)) OVER (PARTITION BY user_id ORDER BY run) AS until FROM e GROUP BY user_id, run),
a(user_id, run, alert_ms) AS (
  SELECT user_id, run, min(ms) + 3600000 FROM e WHERE rise GROUP BY user_id, run
  UNION ALL SELECT a.user_id, a.run, min(e.ms) + 3600000 FROM a JOIN e ON e.user_id = a.user_id AND e.run = a.run AND e.rise AND e.ms >= a.alert_ms GROUP BY a.user_id, a.run)
SELECT a.user_id, alert_ms FROM a JOIN u ON u.user_id = a.user_id AND u.run = a.run WHERE until IS NULL OR alert_ms <= until
"""


@query(RISING)
def rising_value_alert(spark, d):
    return cep.rising_alerts(events(spark, d), ["user_id"], "ts", ["ts", "event_id"], "value", 3_600_000)


@query("SELECT event_id, event_id % 3 AS partition_id FROM events")
def custom_partition(spark, d):
    rows = partitioning.partition_custom(events(spark, d).select("event_id"), 4, F.col("event_id") % 3)
    return rows.select("event_id", F.spark_partition_id().cast("bigint").alias("partition_id"))


@query("SELECT event_id, copy FROM events, range(3) t(copy)")
def broadcast_copies(spark, d):
    return partitioning.broadcast_copies(events(spark, d).select("event_id"), 3).select("event_id", F.col("copy").cast("bigint").alias("copy"))


@query("SELECT n_name, count(*)::BIGINT AS cnt FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def broadcast_join(spark, d):
    c, n = parquet(spark, d, "customer"), parquet(spark, d, "nation")
    return c.join(partitioning.broadcast_if_small(n), c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT count(*)::BIGINT AS cnt, CAST(sum(event_id) AS BIGINT) AS total FROM events")
def exchange_conserves(spark, d):
    rows = events(spark, d).select("event_id")
    for step in (lambda r: partitioning.shuffle(r, 4), lambda r: partitioning.rebalance(r, 2), lambda r: partitioning.rescale(r, 2, 4), lambda r: partitioning.key_by(r, "event_id")):
        rows = step(rows)
    return rows.agg(F.count(F.lit(1)).alias("cnt"), F.sum("event_id").alias("total"))


@query(f"SELECT event_id, CASE WHEN ms < max(CASE WHEN event_type = 'signup' THEN ms END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 THEN 'late' ELSE 'main' END AS tag FROM {JITTER}")
def late_split_punctuated(spark, d):
    """Only sign-ups move the watermark."""
    return lateness.late_split(jittered(spark, d), "seq", "ts", 0, emits=F.col("event_type") == "signup").select("event_id", "tag")


@query(f"""
SELECT event_id, CASE WHEN ms < wm THEN 'late' ELSE 'main' END AS tag FROM {JITTER} JOIN (
  SELECT r, max(m) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {{bound}} - 1 AS wm FROM (SELECT seq // 100 AS r, max(ms) AS m FROM {JITTER} GROUP BY 1)) ON r = seq // 100
""".format(bound=1000))
def late_split_periodic(spark, d):
    """The watermark moves every 100 steps of ``seq``; rows without it are left out."""
    return lateness.late_split(jittered(spark, d).where("seq IS NOT NULL"), "seq", "ts", 1000, every=100).select("event_id", "tag")


@query(CEP3.replace("FROM events WINDOW", "FROM events WHERE event_type = 'error' WINDOW"))
def cep_three_fails_relaxed(spark, d):
    pattern = cep.Pattern.begin("fail").where(F.col("event_type") == "error").times(3)
    return cep.match(events(spark, d), pattern, ["user_id"], "ts", ["ts", "event_id"])


@query("""
SELECT user_id, t1 AS login_ts, t2 AS order_ts, ts AS pay_ts FROM (
  SELECT user_id, ts, event_type AS e3, lag(event_type, 1) OVER w AS e2, lag(event_type, 2) OVER w AS e1, lag(ts, 1) OVER w AS t2, lag(ts, 2) OVER w AS t1
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE e1 = 'signup' AND e2 = 'click' AND e3 = 'purchase'
""")
def cep_login_order_pay(spark, d):
    kind = lambda k: F.col("event_type") == k
    pattern = cep.Pattern.begin("login").where(kind("signup")).next("order").where(kind("click")).next("pay").where(kind("purchase"))
    return cep.match(events(spark, d), pattern, ["user_id"], "ts", ["ts", "event_id"])


@query("""
SELECT user_id, t1 AS small_ts, ts AS large_ts FROM (
  SELECT user_id, ts, value, lag(value) OVER w AS v1, lag(ts) OVER w AS t1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE v1 < 50 AND value > 100 AND epoch_us(ts) - epoch_us(t1) < 86400000000
""")
def cep_fraud(spark, d):
    """A small amount, and the very next one large, within a day."""
    pattern = cep.Pattern.begin("small").where(F.col("value") < 50).next("large").where(F.col("value") > 100).within(86_400)
    return cep.match(events(spark, d), pattern, ["user_id"], "ts", ["ts", "event_id"])


@query("SELECT user_id, CAST(sum(v) AS BIGINT) // count(*) AS avg FROM (SELECT user_id, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY user_id")
def user_accumulator(spark, d):
    """A user's own aggregate (integer average), with its own partial states and merge."""
    from pyspark.sql import types as T

    from ..operators.folds import Accumulator, accumulate

    class Average(Accumulator):
        def create(self):
            return (0, 0)

        def add(self, state, v):
            return (state[0] + v, state[1] + 1)

        def merge(self, a, b):
            return (a[0] + b[0], a[1] + b[1])

        def result(self, state):
            return state[0] // state[1]

    return accumulate(events(spark, d).select("user_id", long_value().alias("v")), ["user_id"], ["v"], Average(), T.StructField("avg", T.LongType()))


@query("SELECT event_id, CASE WHEN value > 100 THEN 'large' WHEN event_type = 'error' THEN 'failed' ELSE 'main' END AS tag FROM events")
def side_outputs(spark, d):
    e = events(spark, d)
    large = F.col("value") > 100
    outputs = transforms.process(e, large=large, failed=~large & (F.col("event_type") == "error"))
    return joins.union_all(*(df.select("event_id", F.lit(t).alias("tag")) for t, df in outputs.items()))


@query("SELECT event_id, event_id * event_id AS square FROM events")
def map_lifecycle(spark, d):
    def make(partition):
        return (lambda batch: batch.assign(square=batch["event_id"] ** 2)), lambda: None

    return transforms.map_with_lifecycle(events(spark, d).select("event_id"), make, "event_id bigint, square bigint")


@query("SELECT event_id, user_id, CAST(CAST(value AS DECIMAL(18, 2)) AS DECIMAL(18, 2)) AS amount FROM events WHERE event_type = 'purchase'")
def ddl_insert(spark, d):
    """CREATE TABLE of a file sink and source, INSERT INTO, and a query of what was written."""
    from ..streaming.harness import work_path
    from .dialect import Dialect

    engine, path = Dialect(spark), work_path(spark, "ddl")
    engine.view("clicks", events(spark, d))
    engine.execute(f"CREATE TABLE result_table (event_id BIGINT, user_id BIGINT, amount DECIMAL(18, 2)) WITH ('connector' = 'filesystem', 'path' = '{path}', 'format' = 'csv')")
    engine.execute("INSERT INTO result_table SELECT event_id, user_id, CAST(value AS DECIMAL(18, 2)) FROM clicks WHERE event_type = 'purchase'")
    return engine.query("SELECT event_id, user_id, amount FROM result_table")


@query("SELECT user_id, count(*)::BIGINT AS cnt FROM events GROUP BY user_id")
def proctime_sql(spark, d):
    """A processing-time column in SQL: whatever the clock says, its windows hold each row once."""
    from .dialect import Dialect

    engine = Dialect(spark)
    engine.view("clicks", events(spark, d), proctime="pt")
    engine.view("windows", engine.query("SELECT user_id, COUNT(user_id) AS cnt, TUMBLE_END(pt, INTERVAL '1' HOURS) AS end_time FROM clicks GROUP BY user_id, TUMBLE(pt, INTERVAL '1' HOURS)"))
    return engine.query("SELECT user_id, SUM(cnt) AS cnt FROM windows GROUP BY user_id")
