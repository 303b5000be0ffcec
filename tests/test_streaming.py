"""Streams: processors, generated sources, sinks and restarts."""

import glob
import sqlite3

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rillflow.sinks import two_phase, upsert
from rillflow.sources import generators
from rillflow.streaming import pipelines, processors
from rillflow.streaming.harness import collect, replay_batches, split_by_tag


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def batches(spark, parts, schema):
    return replay_batches([spark.createDataFrame(p, schema) for p in parts])


LATE = "bucket int, seq long, ms long, k long, flush boolean"


def test_late_split(spark):
    s = batches(spark, [[(0, 1, 1000, 0, False)], [(0, 2, 2000, 0, False)], [(0, 3, 1500, 0, False)]], LATE)
    out = collect(processors.run(s.groupBy("bucket"), processors.LateSplitter(0)))
    assert rows(out, "seq", "tag", "wm_before") == [(1, "main", None), (2, "main", 999), (3, "late", 1999)]


def test_allowed_lateness(spark):
    parts = [[(0, i, t, 7, False)] for i, t in enumerate((1000, 10_000, 2000, 16_000, 3000))] + [[(0, 99, 0, 7, True)]]
    out = collect(processors.run(batches(spark, parts, LATE).groupBy("bucket"), processors.LateWindows(5000, 5000, 5000)))
    assert rows(out.where("end_ms = 5000"), "tag", "cnt", "seq") == [("late", 0, 4), ("main", 1, 1), ("main", 2, 2)]
    assert rows(out.where("end_ms > 5000"), "end_ms", "cnt") == [(15000, 1), (20000, 1)]


def test_many_open_windows_cost_no_time_per_row():
    import time

    class Value:
        kept = None
        exists, get = (lambda self: self.kept is not None), (lambda self: self.kept)

        def update(self, v):
            self.kept = v

    class Map(dict):
        keys, iterator, getValue, updateValue, removeKey = (lambda self: iter(list(self))), dict.items, dict.get, dict.__setitem__, dict.pop

    class Handle:
        getValueState, getMapState = (lambda self, *a: Value()), (lambda self, *a: Map())

    windows = processors.LateWindows(1000, 0, 500)
    windows.init(Handle())
    got, begin = [], time.perf_counter()
    for batch in range(2):
        new = [Row(seq=i, ms=i // 15_000 * 1000, k=i % 5000, flush=False) for i in range(batch * 15_000, batch * 15_000 + 15_000)]
        got += windows.handleInputRows((0,), iter(new), None)
        assert len(windows.windows) == 5000 * (batch + 1)
    got += windows.handleInputRows((0,), iter([Row(seq=99_999, ms=0, k=0, flush=True)]), None)
    assert time.perf_counter() - begin < 3
    assert len(got) == 10_000 and {(r.tag, r.cnt) for r in got} == {("main", 3)} and not windows.windows


def test_purging_windows(spark):
    parts = [[(0, i, t, 7, False)] for i, t in enumerate((1000, 10_000, 2000))]
    out = collect(processors.run(batches(spark, parts, LATE).groupBy("bucket"), processors.LateWindows(5000, 5000, 5000, purge=True)))
    assert [r[0] for r in rows(out.where("tag = 'main'"), "cnt")] == [1, 1]


def event_time(stream):
    return stream.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", "0 seconds")


def test_event_time_timers(spark):
    s = event_time(batches(spark, [[("a", 1, 1000)], [("z", 2, 20_000)], [("z", 3, 40_000)]], "key string, seq long, ms long"))
    out = collect(processors.run(s.groupBy("key"), processors.Timers((9999,)), time="eventtime"))
    assert ("a", "timer", 10_999) in rows(out, "key", "kind", "at")


def test_processing_time_timers(spark, tmp_path):
    import time

    s = batches(spark, [[("a", 1, 0)], [("b", 2, 0)]], "key string, seq long, ms long")
    seen = []
    out = processors.run(s.groupBy("key"), processors.Timers((1,), processing=True), time="processingtime")
    q = out.writeStream.foreachBatch(lambda df, i: seen.extend(map(tuple, df.select("key", "kind").collect()))).option("checkpointLocation", f"{tmp_path}/cp").start()
    try:  # processing time goes on for ever, and so does the query
        until = time.time() + 40
        while ("a", "timer") not in seen and time.time() < until:
            time.sleep(0.2)
    finally:
        q.stop()
    assert ("a", "timer") in seen


def test_processing_time_sessions(spark, tmp_path):
    import time

    s = batches(spark, [[("a", 1), ("a", 2)], [("b", 3)], [("c", 4)]], "key string, seq long")
    seen = []
    out = processors.run(s.groupBy("key"), processors.ProcessingSession(1), time="processingtime")
    q = out.writeStream.foreachBatch(lambda df, i: seen.extend(map(tuple, df.select("key", "cnt").collect()))).option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        until = time.time() + 60
        while len(seen) < 3 and time.time() < until:
            time.sleep(0.2)
    finally:
        q.stop()
    assert sorted(seen) == [("a", 2), ("b", 1), ("c", 1)]


def test_punctuated_watermark_to_the_end(spark):
    s = batches(spark, [[(0, 1, 1000, False, False), (0, 2, 500, False, False), (0, 3, 700, True, False), (0, 4, 9000, False, False)]], "bucket int, seq long, ms long, mark boolean, flush boolean")
    out = collect(processors.run(s.groupBy("bucket"), processors.LateSplitter(processors.Punctuated("mark", to_end=True))))
    assert rows(out, "seq", "tag") == [(1, "main"), (2, "main"), (3, "main"), (4, "late")]


def test_periodic_trigger_purges(spark):
    part = [("k", i, t) for i, t in enumerate((100, 200, 1500, 1600, 3100))]
    s = event_time(batches(spark, [[(1, i, t) for _, i, t in part], [(-1, 99, 10**9)]], "key long, seq long, ms long"))
    out = collect(processors.run(s.groupBy("key"), processors.Periodically(10_000, 1000, purge=True), time="eventtime")).where("key = 1")
    assert rows(out, "fire_ms", "cnt") == [(1000, 2), (2000, 2), (3000, 0), (4000, 1)]


def test_reconciler_times_out_before_matching(spark):
    schema = "key string, seq long, side string, ms long"
    parts = [[("k1", 1, "left", 1000), ("k2", 2, "left", 2000)], [("k1", 3, "right", 3000), ("k3", 4, "right", 4000)], [("zz", 5, "left", 7001)], [("k2", 6, "right", 20_000)], [("zz", 7, "right", 90_000)], [("zz", 8, "left", 190_000)]]
    out = collect(processors.run(event_time(batches(spark, parts, schema)).groupBy("key"), processors.Reconciler(5000), time="eventtime"))
    assert rows(out.where("key != 'zz'"), "key", "status") == [("k1", "matched"), ("k2", "left-missing"), ("k2", "right-missing"), ("k3", "left-missing")]


def test_latest_query_filter(spark):
    s = batches(spark, [[(0, 1, False, "a"), (0, 2, True, "a"), (0, 3, False, "a")], [(0, 4, False, "b"), (0, 5, True, "b"), (0, 6, False, "b")]], "bucket int, seq long, is_query boolean, value string")
    assert rows(collect(processors.run(s.groupBy("bucket"), processors.LatestQueryFilter())), "seq") == [(3,), (6,)]


def test_rising_alert(spark):
    values = [(0, 1.0), (300, 2.0), (600, 2.0), (900, 3.0), (1400, 3.5), (1500, 1.0), (1600, 2.0), (1700, 0.5), (9000, 0.5)]
    part = [("s", i, 1000 + t, v) for i, (t, v) in enumerate(values)]  # a row at the first watermark, 0, would be late
    s = event_time(batches(spark, [part], "key string, seq long, ms long, v double"))
    assert rows(collect(processors.run(s.groupBy("key"), processors.RisingAlert(1000), time="eventtime")), "alert_ms") == [(2300,)]


def test_state_machine(spark):
    table = {("s0", "f"): "s1", ("s1", "f"): "s2", ("s2", "f"): "bad"}
    s = batches(spark, [[("u", 1, "f"), ("u", 2, "?"), ("u", 3, "f")], [("u", 4, "f"), ("u", 5, "f")]], "key string, seq long, event string")
    assert rows(collect(processors.run(s.groupBy("key"), processors.Machine(table, "s0", {"bad": ("fail", "s2")}))), "seq") == [(4,), (5,)]


def test_outer_interval_join_reports_missing(spark):
    l = batches(spark, [[("k1", 1000), ("k2", 2000)], [("zz", 60_000)], [("zz", 90_000)]], "k string, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    r = batches(spark, [[("k1", 3000)], [("zz", 60_000)], [("zz", 90_000)]], "k string, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    joined = pipelines.interval_join(l, r, "k", "ts", "'-5' SECOND", "'5' SECOND", how="full_outer").select(F.col("l.k").alias("lk"), F.col("r.k").alias("rk"))
    assert rows(collect(joined).where("lk != 'zz' OR rk != 'zz'"), "lk", "rk") == [("k1", "k1"), ("k2", None)]


def test_min_watermark_of_a_union(spark):
    schema = "k string, ms long"
    a = event_time(batches(spark, [[("a", 1000)], [("a", 50_000)], [("a", 60_000)]], schema))
    b = event_time(batches(spark, [[("b", 1000)], [("b", 2000)], [("b", 3000)]], schema))
    counts = a.union(b).groupBy("k", F.window("ts", "5 seconds")).agg(F.count("*").alias("n"))
    assert collect(counts).count() == 0  # the slower input holds the watermark back


def read_stream(spark, source, **options):
    generators.register(spark)
    return spark.readStream.format(source).options(**options).load()


@pytest.mark.parametrize("source", ["clicks", "ints", "sensors"])
def test_generated_sources_are_seeded(spark, source):
    a = rows(collect(read_stream(spark, source, seed="1", rows="25")), "*")
    b = rows(collect(read_stream(spark, source, seed="1", rows="25", partitions="3")), "*")
    c = rows(collect(read_stream(spark, source, seed="2", rows="25")), "*")
    assert len(a) == len(b) > 0
    drop = lambda x: [r[:-1] for r in x]  # noqa: E731  the batch
    assert drop(a) == drop(b) and drop(a) != drop(c)


def run_query(df, sink, path, checkpoint, **options):
    q = df.writeStream.format(sink).options(path=path, **options).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_counter_resumes_into_the_two_phase_sink(spark, tmp_path):
    two_phase.register(spark)
    for rows_so_far in ("20", "50"):
        run_query(read_stream(spark, "counter", rows=rows_so_far, batch="10", partitions="2"), "two_phase", f"{tmp_path}/out", f"{tmp_path}/cp")
    values = [int(line.split(",")[0]) for f in glob.glob(f"{tmp_path}/out/*.csv") for line in open(f)]
    assert sorted(values) == list(range(len(values))) and len(values) >= 20
    assert not glob.glob(f"{tmp_path}/out/.staged/*")


def writer_rows(writer, rows):
    from unittest import mock

    with mock.patch.object(two_phase, "TaskContext") as context:
        context.get.return_value.partitionId.return_value = 0
        return writer.write(iter(rows))


def test_two_phase_commit_is_idempotent_and_abort_cleans(tmp_path):
    writer = two_phase.TwoPhaseWriter(str(tmp_path))
    (tmp_path / ".staged").mkdir()
    (tmp_path / ".staged/a").write_text("1\n")
    message = two_phase.Staged(f"{tmp_path}/.staged/a", 0)
    writer.commit([message], 3)
    writer.commit([message, None], 3)
    assert (tmp_path / "batch-00000003-00000.csv").read_text() == "1\n"
    (tmp_path / ".staged/b").write_text("2\n")
    message = writer_rows(two_phase.TwoPhaseWriter(str(tmp_path / "quoted")), [(1, 'a,"b"\nc', None)])
    import csv

    with open(message.path, newline="") as f:
        assert list(csv.reader(f)) == [["1", 'a,"b"\nc', ""]]
    writer.abort([two_phase.Staged(f"{tmp_path}/.staged/b", 1)], 4)
    assert not list((tmp_path / ".staged").iterdir())


def test_upserts_and_restart(spark, tmp_path):
    path = f"{tmp_path}/clicks.db"
    write = upsert.upsert_sink("username", "seq", upsert.sqlite_writer(path, "clicks"), ["username", "url"])
    s = batches(spark, [[("Mary", "./home", 1), ("Bob", "./cart", 2)], [("Mary", "./buy", 4), ("Mary", "./cart", 3)]], "username string, url string, seq long")
    for _ in range(2):
        q = s.coalesce(1).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sqlite3.connect(path).execute("SELECT * FROM clicks ORDER BY 1").fetchall() == [("Bob", "./cart"), ("Mary", "./buy")]


def test_upserts_into_any_database(spark, tmp_path):
    import duckdb

    path = f"{tmp_path}/clicks.duckdb"
    with duckdb.connect(path) as db:
        db.execute("CREATE TABLE clicks (username VARCHAR PRIMARY KEY, url VARCHAR)")
    write = upsert.database_writer(lambda: duckdb.connect(path), "clicks", rows=2)
    for _ in range(2):
        write(iter([("Mary", "./home"), ("Bob", "./cart"), ("Eve", None)]), ["username", "url"])
        write(iter([("Mary", "./buy")]), ["username", "url"])
    with duckdb.connect(path) as db:
        assert db.execute("SELECT * FROM clicks ORDER BY 1").fetchall() == [("Bob", "./cart"), ("Eve", None), ("Mary", "./buy")]
    seen = []

    class Connection:
        cursor, commit, close = (lambda self: self), (lambda self: None), (lambda self: None)
        executemany = lambda self, sql, rows: seen.append(sql)

    upsert.database_writer(Connection, "t", "%s", "ON DUPLICATE KEY UPDATE {sets}", "VALUES({0})")([(1, 2)], ["k", "v"])
    assert seen == ["INSERT INTO t (k, v) VALUES (%s, %s) ON DUPLICATE KEY UPDATE v = VALUES(v)"]


def test_late_split_in_batches(spark, tmp_path):
    schema = "seq long, ms long"
    parts = [[(1, 1000)], [(2, 3000), (3, 1500)], [(4, 2500), (5, None)], [(6, 2998), (7, 2999)]]
    s = batches(spark, parts, schema).withColumn("ts", F.timestamp_millis("ms"))
    split = pipelines.late_split_batches(f"{tmp_path}/wm", upsert.write_ahead(f"{tmp_path}/out"), "seq", "ts", 0)
    for _ in range(2):
        s.writeStream.foreachBatch(split).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    split(spark.createDataFrame(parts[1], schema).withColumn("ts", F.timestamp_millis("ms")), 1)  # a batch that is run again
    want = [(1, "main", None), (2, "main", 999), (3, "late", 2999), (4, "late", 2999), (5, "main", 2999), (6, "late", 2999), (7, "main", 2999)]
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "seq", "tag", "wm_before") == want
    with pytest.raises(ValueError, match="as long as the checkpoint"):
        split(spark.createDataFrame(parts[1], schema).withColumn("ts", F.timestamp_millis("ms")), 9)


def test_allowed_lateness_in_batches(spark, tmp_path):
    times = (1000, 10_000, 2000, 16_000, 3000, None, 2500, 60_000)
    want = [("late", 5000, None, None, 4), ("late", 5000, None, None, 6), ("main", 5000, 1, 1, None), ("main", 5000, 2, 2, 2), ("main", 15_000, 1, 1, None), ("main", 20_000, 1, 1, None)]
    for size in (1, 3, 8):
        parts = [[(i, t, None) for i, t in enumerate(times)][at : at + size] for at in range(0, len(times), size)]
        dfs = [spark.createDataFrame(p, "seq long, ms long, k long").withColumn("ts", F.timestamp_millis("ms")) for p in parts]
        out = f"{tmp_path}/{size}"
        one = pipelines.late_windows_batches(f"{out}/held", upsert.write_ahead(f"{out}/rows"), "seq", "ts", ["k"], 5000, 5000, 5000)
        for i, df in enumerate(dfs):
            one(df, i)
            one(df, i)  # a batch that is run again
        assert rows(spark.read.parquet(f"{out}/rows"), "tag", "end_ms", "firing", "cnt", "seq") == sorted(want, key=str)


def test_socket_with_labels(spark, tmp_path):
    import socket
    import threading
    import time

    from rillflow.sinks.changelog import labelled
    from rillflow.sources.tables import socket_lines

    with socket.create_server(("localhost", 0)) as server:
        def serve():
            connection, _ = server.accept()
            with connection:
                connection.sendall("to be or\nnot to be\n".encode())
                time.sleep(15)

        threading.Thread(target=serve, daemon=True).start()
        lines = socket_lines(spark, "localhost", server.getsockname()[1])
        words = lines.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").count()
        q = labelled(words, "words").writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/{i}")).start()
        until = time.time() + 15
        while not (q.lastProgress or {}).get("numInputRows") and not any((p["numInputRows"] for p in q.recentProgress)) and time.time() < until:
            time.sleep(0.2)
        q.stop()
    found = spark.read.parquet(*glob.glob(f"{tmp_path}/[0-9]*"))
    assert rows(found.groupBy("label", "word").agg(F.max("count").alias("n")), "label", "word", "n") == [("words", "be", 2), ("words", "not", 1), ("words", "or", 1), ("words", "to", 2)]


def test_side_outputs_of_one_query(spark, tmp_path):
    s = batches(spark, [[(1, "main"), (2, "late")], [(3, "main")]], "v long, tag string")
    write = split_by_tag(["main", "late"], lambda tag, df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/{tag}/batch={i}"))
    s.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/main").count() == 2 and spark.read.parquet(f"{tmp_path}/late").count() == 1


def test_write_ahead_batches_replace_on_replay(spark, tmp_path):
    write = upsert.write_ahead(str(tmp_path))
    for _ in range(2):
        write(spark.range(3), 0)
    assert spark.read.parquet(str(tmp_path)).count() == 3
