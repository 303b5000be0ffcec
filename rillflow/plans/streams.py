"""Registered queries that run as streams: bounded tables are replayed in order, flushed, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lateness import millis
from ..sinks.upsert import write_ahead
from ..streaming import pipelines, processors
from ..streaming.harness import END, collect, latest, replay, work_path
from . import catalogue as c
from .catalogue import events, of_type, query

BATCHES = 4


def timed(df: DataFrame) -> DataFrame:
    """Event times as Spark's streams want them."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def sentinel(df: DataFrame, **values) -> DataFrame:
    """A last row at the end of time; its key is -1 and its other columns null unless given."""
    row = df.sparkSession.range(1)
    fixed = {"ts": F.lit(END).cast("timestamp"), "user_id": F.lit(-1).cast("bigint")} | {k: F.lit(v) for k, v in values.items()}
    return row.select(*(fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields))


def stream(df: DataFrame, order: str = "event_id", batches: int = BATCHES, sentinels: int = 1, **values) -> DataFrame:
    """Replayed, then flushed. One sentinel moves the watermark; what is due comes out with that batch's end."""
    return replay(df, order, batches, [sentinel(df, **values)] * sentinels)


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    for name in columns:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df.drop("_batch")


@query(f"SELECT user_id, cnt, window_start, window_end FROM ({c.SQL['tumble_count']})")
def stream_tumble_append(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(timed(events(spark, d).select("event_id", "user_id", "ts")))
    return ntz(collect(pipelines.tumble_counts(rows, "ts", "1 hour", ["user_id"])).where("user_id >= 0"), "window_start", "window_end")


@query(f"SELECT user_id, cnt, window_start, window_end FROM ({c.SQL['session_count']})")
def stream_session_count(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(timed(events(spark, d).select("event_id", "user_id", "ts")))
    return ntz(collect(pipelines.session_counts(rows, "ts", "6 hours", ["user_id"])).where("user_id >= 0"), "window_start", "window_end")


@query(f"SELECT user_id, cnt, window_end, row_num FROM ({c.SQL['hot_items_top3']})")
def hot_items_top3_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(timed(of_type(events(spark, d), "view").select("event_id", "user_id", "ts")), sentinels=2)
    return ntz(collect(pipelines.hot_items(rows, "user_id", "ts")).where("user_id >= 0"), "window_end")


@query(c.SQL["uv_exact_hourly"])
def stream_uv_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(timed(of_type(events(spark, d), "view").select("event_id", "user_id", "ts")), sentinels=2)
    out = collect(pipelines.distinct_counts(rows, "ts", "1 hour", "user_id"))
    return ntz(out.where(F.col("window_start") < F.lit("2099-01-01").cast("timestamp")), "window_start", "window_end")


@query("SELECT user_id, count(*)::BIGINT AS cnt FROM events GROUP BY user_id")
def stream_running_update(spark: SparkSession, d: str) -> DataFrame:
    rows = replay(events(spark, d).select("event_id", "user_id"), "event_id", BATCHES)
    return latest(collect(pipelines.running_counts(rows, ["user_id"]), "update"), ["user_id"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_upsert_last(spark: SparkSession, d: str) -> DataFrame:
    from ..sinks.upsert import last_per_key

    rows = collect(replay(events(spark, d).select("event_id", "user_id", "event_type"), "event_id", BATCHES))
    return last_per_key(rows.drop("_batch"), "user_id", "event_id").select("user_id", "event_type")


@query(c.SQL["keyed_stats"])
def stream_keyed_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = replay(events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), c.long_value().alias("v")), "seq", BATCHES)
    out = collect(processors.run(rows.groupBy("key"), processors.Statistics()))
    return out.withColumnsRenamed({"key": "user_id", "seq": "event_id"}).drop("_batch")


@query(c.SQL["sorted_history"])
def stream_sorted_history(spark: SparkSession, d: str) -> DataFrame:
    rows = replay(events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), c.long_value().alias("v")), "seq", BATCHES)
    out = collect(processors.run(rows.groupBy("key"), processors.SortedHistory()))
    return out.select(F.col("seq").alias("event_id"), "history")


@query(c.SQL["url_count_map"])
def stream_url_count_map(spark: SparkSession, d: str) -> DataFrame:
    rows = replay(events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value")), "seq", BATCHES)
    out = collect(processors.run(rows.groupBy("key"), processors.CountPerValue()))
    return out.groupBy(F.col("key").alias("user_id"), F.col("value").alias("event_type")).agg(F.max("cnt").alias("cnt"))


@query(c.SQL["count_window_tumbling"])
def stream_count_window(spark: SparkSession, d: str) -> DataFrame:
    rows = replay(events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_id").alias("v")), "seq", BATCHES)
    return collect(processors.run(rows.groupBy("key"), processors.CountWindow(5))).withColumnRenamed("key", "user_id").drop("_batch")


def jittered_ms(spark: SparkSession, d: str) -> DataFrame:
    rows = c.jittered(spark, d).select("event_id", F.col("user_id").alias("k"), "seq", millis("ts").alias("ms"))
    return rows.withColumn("flush", F.lit(False)).withColumn("bucket", F.lit(0))


@query(c.SQL["late_split"])
def stream_late_split(spark: SparkSession, d: str) -> DataFrame:
    rows = jittered_ms(spark, d)
    out = collect(processors.run(replay(rows, "seq", BATCHES).groupBy("bucket"), processors.LateSplitter(c.BOUND)))
    return out.select("seq", "tag").join(rows.select("seq", "event_id"), "seq").select("event_id", "tag")


@query(c.SQL["late_split"])
def stream_late_split_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same by all tasks, with one value carried between micro-batches."""
    rows = timed(c.jittered(spark, d).select("event_id", "seq", "ts"))
    out = work_path(spark, "late")
    split = pipelines.late_split_batches(work_path(spark, "watermarks"), write_ahead(out), "seq", "ts", c.BOUND)
    writer = replay(rows, "seq", BATCHES).writeStream.foreachBatch(split).option("checkpointLocation", work_path(spark, "checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id bigint, tag string").parquet(f"{out}/batch=*")


@query(c.SQL["allowed_lateness"])
def stream_allowed_lateness(spark: SparkSession, d: str) -> DataFrame:
    rows = jittered_ms(spark, d).drop("event_id")
    end = rows.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("k"), F.lit(1 << 60).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("ms"), F.lit(True).alias("flush"), F.lit(0).alias("bucket"))
    out = collect(processors.run(replay(rows, "seq", BATCHES, [end]).groupBy("bucket"), processors.LateWindows(c.SIZE, c.BOUND, c.LATENESS)))
    fired = out.where("tag = 'main'").select(F.col("k").alias("user_id"), "end_ms", "cnt")
    from pyspark.sql import Window as W

    return fired.withColumn("firing", F.row_number().over(W.partitionBy("user_id", "end_ms").orderBy("cnt")).cast("bigint"))


@query(c.SQL["allowed_lateness"])
def stream_allowed_lateness_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same by all tasks, with the open windows carried between micro-batches. Rows without a time fire at the end."""
    rows = timed(c.jittered(spark, d).select("user_id", "seq", "ts"))
    out, held = work_path(spark, "windows"), work_path(spark, "open")
    windows = pipelines.late_windows_batches(held, write_ahead(out), "seq", "ts", ["user_id"], c.BOUND, c.SIZE, c.LATENESS)
    last = F.timestamp_micros(F.lit((1 << 63) - 1))  # END isn't after times beyond 2100
    replayed = replay(rows, "seq", BATCHES, [sentinel(rows, seq=1 << 60, ts=last)])
    replayed.writeStream.foreachBatch(windows).option("checkpointLocation", work_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    fired = spark.read.schema("tag string, user_id bigint, end_ms bigint, firing bigint, cnt bigint").parquet(f"{out}/batch=*")
    fired = fired.where("tag = 'main'").select("user_id", "end_ms", "cnt", "firing")
    endless = pipelines.endless_windows(spark, held, "user_id bigint", ["user_id"])
    return fired.unionByName(endless.select("user_id", F.lit(None).cast("bigint").alias("end_ms"), "cnt", F.lit(1).cast("bigint").alias("firing")))


@query(c.SQL["broadcast_filter"])
def stream_broadcast_filter(spark: SparkSession, d: str) -> DataFrame:
    kind = (F.col("event_id") / 97).cast("bigint") % 3
    buckets = 4
    e = events(spark, d).withColumn("is_query", F.col("event_id") % 97 == 0)
    rows = e.select(F.col("event_id").alias("seq"), "is_query", F.when(~F.col("is_query"), F.col("event_type")).when(kind == 0, "view").when(kind == 1, "click").otherwise("error").alias("value"))
    to = F.when(F.col("is_query"), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array((F.col("seq") % buckets).cast("int")))
    out = collect(processors.run(replay(rows, "seq", BATCHES).withColumn("bucket", F.explode(to)).groupBy("bucket"), processors.LatestQueryFilter()))
    return out.select(F.col("seq").alias("event_id"), F.col("value").alias("event_type"))


@query("SELECT user_id, output, count(*)::BIGINT AS n FROM (" + c.SQL["state_machine"] + ") GROUP BY ALL")
def stream_state_machine(spark: SparkSession, d: str) -> DataFrame:
    table = {("s0", "error"): "s1", ("s1", "error"): "s2", ("s2", "error"): "bad", ("s0", "signup"): "ok", ("s1", "signup"): "ok", ("s2", "signup"): "ok"}
    rows = events(spark, d).where("event_type IN ('error', 'signup')").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"))
    out = collect(processors.run(replay(rows, "seq", BATCHES).groupBy("key"), processors.Machine(table, "s0", {"bad": ("fail", "s2"), "ok": ("success", "s0")})))
    return out.groupBy(F.col("key").cast("bigint").alias("user_id"), "output").agg(F.count(F.lit(1)).alias("n"))


@query(c.SQL["interval_join"])
def stream_interval_join(spark: SparkSession, d: str) -> DataFrame:
    e = timed(events(spark, d).select("event_id", "user_id", "ts", "event_type"))
    left, right = (stream(of_type(e, kind).drop("event_type")) for kind in ("click", "view"))
    joined = pipelines.interval_join(left, right, "user_id", "ts", "'-5' MINUTE", "'15' MINUTE")
    out = collect(joined.select(F.col("l.user_id").alias("user_id"), F.col("l.event_id").alias("event_id"), F.col("r.event_id").alias("event_id_r")))
    return out.where("user_id >= 0").drop("_batch")


@query("SELECT event_id, o_orderkey FROM events JOIN orders ON event_id = o_orderkey")
def stream_static_join(spark: SparkSession, d: str) -> DataFrame:
    rows = replay(events(spark, d).select("event_id"), "event_id", BATCHES)
    orders = c.parquet(spark, d, "orders").select("o_orderkey")
    return collect(rows.join(orders, F.col("event_id") == F.col("o_orderkey"))).drop("_batch")


def keyed_ms(spark: SparkSession, d: str, *more) -> DataFrame:
    """Events as key, seq, ms (and other columns) with their time."""
    e = events(spark, d)
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), *more, F.col("ts").cast("timestamp").alias("ts"))


def event_time(rows: DataFrame, **values) -> DataFrame:
    """Replayed with a watermark, and flushed by a row of key -1 at the end of time."""
    end = {"key": F.lit(-1), "seq": F.lit(1 << 60), "ts": F.lit(END).cast("timestamp"), "ms": F.unix_millis(F.lit(END).cast("timestamp"))} | {k: F.lit(v) for k, v in values.items()}
    last = rows.sparkSession.range(1).select(*(end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields))
    return replay(rows, "seq", BATCHES, [last]).withWatermark("ts", "0 seconds")


def at_ms(name: str) -> F.Column:
    return F.timestamp_millis(F.col(name)).cast("timestamp_ntz")


@query(c.SQL["rising_value_alert"])
def stream_rising_alert(spark: SparkSession, d: str) -> DataFrame:
    rows = event_time(keyed_ms(spark, d, F.col("value").alias("v")).withColumn("key", F.col("key").cast("string")), v=0.0)
    out = collect(processors.run(rows.groupBy("key"), processors.RisingAlert(3_600_000), time="eventtime"))
    return out.select(F.col("key").cast("bigint").alias("user_id"), "alert_ms")


@query("SELECT DISTINCT user_id, epoch_us(ts) // 1000 + 9999 AS fire_ms FROM events")
def stream_event_timers(spark: SparkSession, d: str) -> DataFrame:
    rows = event_time(keyed_ms(spark, d).withColumn("key", F.col("key").cast("string")))
    out = collect(processors.run(rows.groupBy("key"), processors.Timers((9999,)), time="eventtime"))
    return out.where("kind = 'timer' AND key != '-1'").select(F.col("key").cast("bigint").alias("user_id"), F.col("at").alias("fire_ms"))


@query(c.SQL["trigger_each_element"])
def stream_trigger_each_element(spark: SparkSession, d: str) -> DataFrame:
    rows = replay(keyed_ms(spark, d).drop("ts"), "seq", BATCHES)
    out = collect(processors.run(rows.groupBy("key"), processors.EachElement(86_400_000)))
    return out.select(F.col("seq").alias("event_id"), F.col("key").alias("user_id"), "cnt", F.timestamp_millis(F.col("end_ms") - 86_400_000).cast("timestamp_ntz").alias("window_start"), at_ms("end_ms").alias("window_end"))


@query("SELECT event_id, 1::BIGINT AS cnt FROM events")
def stream_trigger_purging(spark: SparkSession, d: str) -> DataFrame:
    rows = replay(keyed_ms(spark, d).drop("ts"), "seq", BATCHES)
    return collect(processors.run(rows.groupBy("key"), processors.EachElement(86_400_000, purge=True))).select(F.col("seq").alias("event_id"), "cnt")


@query(c.SQL["trigger_every_hour"])
def stream_trigger_every_hour(spark: SparkSession, d: str) -> DataFrame:
    out = collect(processors.run(event_time(keyed_ms(spark, d)).groupBy("key"), processors.Periodically(86_400_000, 3_600_000), time="eventtime"))
    return out.where("key >= 0").select(F.col("key").alias("user_id"), at_ms("fire_ms").alias("fire_time"), "cnt", F.timestamp_millis(F.col("end_ms") - 86_400_000).cast("timestamp_ntz").alias("window_start"), at_ms("end_ms").alias("window_end"))


@query(c.SQL["count_window_sliding"])
def stream_count_slide(spark: SparkSession, d: str) -> DataFrame:
    rows = replay(keyed_ms(spark, d, F.col("event_id").alias("v")).drop("ts", "ms"), "seq", BATCHES)
    out = collect(processors.run(rows.groupBy("key"), processors.CountSlide(5, 2)))
    return out.select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "window_no", "total")


@query("SELECT user_id, (epoch_us(ts) // 3600000000 + 1) * 3600000 AS end_ms, CAST(median(event_id) AS BIGINT) AS middle FROM events GROUP BY ALL")
def stream_window_list_buffer(spark: SparkSession, d: str) -> DataFrame:
    """A function of a window's whole list of values: the middle one, or the mean of both middle ones, cut off."""

    def middle(values: list) -> int:
        v = sorted(values)
        return round((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2)

    rows = event_time(keyed_ms(spark, d, F.col("event_id").alias("v")), v=0)
    out = collect(processors.run(rows.groupBy("key"), processors.ListBufferWindow(3_600_000, middle), time="eventtime"))
    return out.where("key >= 0").select(F.col("key").alias("user_id"), "end_ms", F.col("value").alias("middle"))


CEP_MS = {n: f"SELECT user_id, {', '.join(f'epoch_us({x}) // 1000 AS {x}' for x in cols)}{more} FROM ({c.SQL[n]})" for n, cols, more in (
    ("cep_three_fails", ("fail_1_ts", "fail_2_ts", "fail_3_ts"), ""), ("cep_next_within_timeout", ("create_ts", "pay_ts"), ", status"))}


@query(CEP_MS["cep_three_fails"])
def stream_cep_three_fails(spark: SparkSession, d: str) -> DataFrame:
    fail = F.col("event_type") == "error"
    rows = replay(keyed_ms(spark, d, F.array(fail, fail, fail).alias("hits")).drop("ts"), "seq", BATCHES)
    out = collect(processors.run(rows.groupBy("key"), processors.Contiguous(3)))
    return out.select(F.col("key").alias("user_id"), *(F.col("at")[i].alias(f"fail_{i + 1}_ts") for i in range(3)))


@query(CEP_MS["cep_next_within_timeout"])
def stream_cep_next_within_timeout(spark: SparkSession, d: str) -> DataFrame:
    rows = event_time(keyed_ms(spark, d, (F.col("event_type") == "click").alias("begins"), (F.col("event_type") == "purchase").alias("completes")), begins=False, completes=False)
    out = collect(processors.run(rows.groupBy("key"), processors.NextWithin(6 * 3_600_000), time="eventtime"))
    return out.select(F.col("key").alias("user_id"), F.col("first_ms").alias("create_ts"), F.col("second_ms").alias("pay_ts"), "status")


@query(c.SQL["incremental_top3"])
def stream_incremental_top3(spark: SparkSession, d: str) -> DataFrame:
    counts = of_type(events(spark, d), "error").groupBy(F.window("ts", "1 day").start.alias("key"), F.col("user_id").alias("item")).agg(F.count(F.lit(1)).alias("cnt")).withColumn("seq", F.col("item"))
    out = collect(processors.run(replay(counts.select("key", "seq", "item", "cnt"), "seq", BATCHES).groupBy("key"), processors.TopN(3)))
    return out.select(F.col("key").alias("day"), F.col("seq").alias("arrival"), "row_num", F.col("item").alias("user_id"), "cnt")


@query(c.SQL["late_split_punctuated"])
def stream_late_split_punctuated(spark: SparkSession, d: str) -> DataFrame:
    rows = c.jittered(spark, d).select("event_id", "seq", millis("ts").alias("ms"), (F.col("event_type") == "signup").alias("mark"), F.lit(False).alias("flush"), F.lit(0).alias("bucket"))
    out = collect(processors.run(replay(rows, "seq", BATCHES).groupBy("bucket"), processors.LateSplitter(processors.Punctuated("mark"))))
    return out.select("seq", "tag").join(rows.select("seq", "event_id"), "seq").select("event_id", "tag")


@query("SELECT user_id, count(*)::BIGINT AS cnt FROM events GROUP BY user_id")
def stream_proctime_tumble(spark: SparkSession, d: str) -> DataFrame:
    """Windows by processing time; whatever the clock says, they hold each row once."""
    out = collect(pipelines.proctime_counts(replay(events(spark, d).select("event_id", "user_id"), "event_id", BATCHES), "1 hour", ["user_id"]), "update")
    return latest(out, ["user_id", "window_start", "window_end"]).groupBy("user_id").agg(F.sum("cnt").alias("cnt"))


@query(f"""
WITH s AS (SELECT min(event_id) AS lo, (max(event_id) - min(event_id)) / {BATCHES} AS step FROM events),
p AS (SELECT user_id, least(CAST(floor((event_id - lo) / step) AS BIGINT), {BATCHES - 1}) AS batch, count(*) AS n FROM events, s GROUP BY ALL),
r AS (SELECT user_id, batch, CAST(sum(n) OVER w AS BIGINT) AS cnt, CAST(sum(n) OVER w AS BIGINT) - n AS before FROM p WINDOW w AS (PARTITION BY user_id ORDER BY batch ROWS UNBOUNDED PRECEDING))
SELECT user_id, batch, cnt, CASE WHEN before = 0 THEN '+I' ELSE '+U' END AS op FROM r UNION ALL SELECT user_id, batch, before, '-U' FROM r WHERE before > 0
""")
def stream_changelog(spark: SparkSession, d: str) -> DataFrame:
    """The changelog of a running count, batch by batch."""
    from ..sinks.changelog import changelog

    updates = collect(pipelines.running_counts(replay(events(spark, d).select("event_id", "user_id"), "event_id", BATCHES), ["user_id"]), "update")
    return changelog(updates.withColumnRenamed("_batch", "batch"), ["user_id"], "batch")


def generated(spark: SparkSession, name: str, **options: str) -> DataFrame:
    from ..sources import generators

    generators.register(spark)
    return collect(spark.readStream.format(name).options(rows="100", batch="100", seed="7", **options).load()).drop("_batch")


@query("SELECT range AS value FROM range(100)")
def source_counter(spark: SparkSession, d: str) -> DataFrame:
    return generated(spark, "counter", partitions="2").select("value")


@query("SELECT 'sensor_' || (range % 3 + 1) AS sensorId, range // 3 * 300 AS ts FROM range(100)")
def source_sensors(spark: SparkSession, d: str) -> DataFrame:
    return generated(spark, "sensors").select("sensorId", "ts")


@query("SELECT range * 1000 AS ts, true AS known FROM range(100)")
def source_clicks(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.generators import URLS, USERS

    return generated(spark, "clicks").select("ts", (F.col("key").isin(*USERS) & F.col("value").isin(*URLS)).alias("known"))


@query("SELECT range * 100 AS ts, true AS known FROM range(100)")
def source_ints(spark: SparkSession, d: str) -> DataFrame:
    return generated(spark, "ints").select("ts", F.col("value").between(0, 9999).alias("known"))
