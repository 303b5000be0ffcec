"""Batch operators on small literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from rillflow.functions.scalar import event_time, int_div, key_seconds, tokens
from rillflow.functions.sketches import Bloom
from rillflow.operators import cep, joins, lateness, partitioning, rolling, topn, transforms, windows
from rillflow.plans import catalogue
from rillflow.plans.dialect import Dialect, parse_table, translate
from rillflow.sinks.changelog import changelog, labelled, upsert_view
from rillflow.sources.tables import csv, elements, kafka_options, text_lines


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.fixture
def eight(spark):
    return elements(spark, [(i, 0) for i in range(1, 9)], "v long, k long")


def ms(df, *names):
    for n in names:
        df = df.withColumn(n, event_time(F.col(n)))
    return df


def test_word_count(spark, tmp_path):
    (tmp_path / "words.txt").write_text("hello world\nhello world  \n \n")
    words = transforms.words(text_lines(spark, str(tmp_path / "words.txt")))
    assert rows(rolling.final(words, ["word"], n=F.sum("one")), "word", "n") == [("hello", 2), ("world", 2)]


def test_tokens_drop_trailing_empties_only(spark):
    df = elements(spark, [("a  b ",), (" a",), ("",), (None,), ("   ",)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["a", "", "b"], ["", "a"], [], [], []]


def test_flat_map_and_process(spark):
    df = elements(spark, [("white",), ("black",), ("gray",)], "c string")
    n = F.when(F.col("c") == "white", 1).when(F.col("c") == "black", 2).otherwise(0)
    assert rows(transforms.flat_map(df, n), "c") == [("black",), ("black",), ("white",)]
    parts = transforms.process(df, w=F.col("c") == "white", b=F.col("c") == "black")
    assert {k: rows(v, "c") for k, v in parts.items()} == {"w": [("white",)], "b": [("black",)], "main": [("gray",)]}


def test_rich_map_opens_and_closes(spark, tmp_path):
    log = str(tmp_path)

    def make(partition):
        open(f"{log}/open-{partition}", "w").close()
        return lambda pdf: pdf.assign(v=pdf.v**2), lambda: open(f"{log}/close-{partition}", "w").close()

    out = transforms.map_with_lifecycle(spark.range(1, 5, 1, 2).withColumnRenamed("id", "v"), make, "v long")
    assert rows(out, "v") == [(1,), (16,), (4,), (9,)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["close-0", "close-1", "open-0", "open-1"]


def test_running_aggregates(spark, eight):
    by3 = eight.withColumn("m", F.col("v") % 3)
    out = rolling.rolling(by3, ["m"], ["v"], s=F.sum("v")).orderBy("v").collect()
    assert [[r.s for r in out if r.m == k] for k in range(3)] == [[3, 9], [1, 5, 12], [2, 7, 15]]
    stats = rolling.statistics(eight, ["k"], ["v"], "v").orderBy("v").collect()
    assert [r.sum for r in stats] == [1, 3, 6, 10, 15, 21, 28, 36] and [r.avg for r in stats] == [1, 1, 2, 2, 3, 3, 4, 4]
    assert [(r.min, r.max) for r in stats] == [(1, i) for i in range(1, 9)]
    odd = elements(spark, [(i, i % 2) for i in range(1, 6)], "v long, k long")
    out = rolling.rolling(odd, ["k"], ["v"], s=F.sum("v")).orderBy("v").collect()
    assert [r.s for r in out if r.k] == [1, 4, 9] and [r.s for r in out if not r.k] == [2, 6]


def test_int_div_truncates(spark):
    assert elements(spark, [(-7, 2), (7, 2)], "a int, b int").select(int_div("a", "b")).collect() == [(-3,), (3,)]


def test_partitioning(spark, eight):
    out = partitioning.partition_custom(eight, 4, F.col("v") % 3).select("v", F.spark_partition_id().alias("p")).collect()
    assert all(r.p == r.v % 3 for r in out) and len(out) == 8
    two = eight.repartition(2).withColumn("up", F.spark_partition_id())
    out = partitioning.rescale(two, 2, 4).select("v", "up", F.spark_partition_id().alias("p")).collect()
    assert all(r.p // 2 == r.up for r in out) and len(out) == 8
    assert partitioning.broadcast_copies(eight, 3).count() == 24
    assert partitioning.global_partition(eight).rdd.getNumPartitions() == 1
    big = spark.range(1 << 40)
    assert partitioning.broadcast_if_small(big) is big


LEFT = [("k1", 1000), ("k2", 2000), ("k1", 3000), ("k2", 4000)]


def test_joins(spark):
    left = elements(spark, LEFT, "k string, ts long")
    right = elements(spark, [(k, t + 500) for k, t in LEFT], "k string, ts long")
    assert joins.regular_join(left, right.withColumnRenamed("ts", "ts_r"), ["k"]).count() == 8
    l, r = ms(left, "ts"), ms(right, "ts")
    out = joins.window_join(l, r, ["k"], "ts", "2 seconds").select("k", F.unix_millis("ts"), F.unix_millis("ts_r"))
    assert rows(out, "*") == [("k1", 1000, 1500), ("k1", 3000, 3500), ("k2", 2000, 2500), ("k2", 4000, 4500)]
    one = ms(elements(spark, [("k1", 10_000)], "k string, ts long"), "ts")
    many = ms(elements(spark, [("k1", t * 1000) for t in (5, 6, 13, 18)], "k string, ts long"), "ts")
    for bucketed in (False, True):
        out = joins.interval_join(one, many, ["k"], "ts", -5, 5, bucketed).select(F.unix_millis("ts_r").alias("t"))
        assert rows(out, "t") == [(13000,), (5000,), (6000,)]


def test_reconcile(spark):
    left = ms(elements(spark, [("k1", 1000), ("k2", 2000)], "k string, ts long"), "ts")
    right = ms(elements(spark, [("k1", 3000), ("k3", 4000), ("k2", 20_000)], "k string, ts long"), "ts")
    out = joins.reconcile(left, right, ["k"], "ts", 5)
    assert rows(out, "k", "status") == [("k1", "matched"), ("k2", "left-missing"), ("k2", "right-missing"), ("k3", "left-missing")]


def test_reconcile_takes_every_event(spark):
    rng = random.Random(5)
    events = [(rng.choice("abcd"), rng.randrange(2), rng.randrange(400) * 1000, i) for i in range(300)] + [("e", 0, 0, 900), ("e", 1, 5000, 901), ("e", 0, 5000, 902)]
    want, waiting = [], {}
    for k, side, t, _ in sorted(events, key=lambda e: (e[2], e[3])):
        queue = waiting.setdefault(k, [])
        while queue and queue[0][1] + 5000 <= t:
            s, at = queue.pop(0)
            want.append((k, None if s else at, at if s else None))
        other = next((x for x in queue if x[0] != side), None)
        if other:
            queue.remove(other)
            want.append((k, *((other[1], t) if side else (t, other[1]))))
        else:
            queue.append((side, t))
    want += [(k, None if s else at, at if s else None) for k, queue in waiting.items() for s, at in queue]
    left, right = (ms(elements(spark, [(k, t, i) for k, s, t, i in events if s == side], "k string, ts long, i long"), "ts") for side in (0, 1))
    out = joins.reconcile_all(left, right, ["k"], "ts", 5, ["i"])
    got = out.select("k", F.unix_millis("left_ts"), F.unix_millis("right_ts")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert out.where("status = 'matched'").count() == sum(l is not None and r is not None for _, l, r in want) > 20
    queries = catalogue.QUERIES
    e = catalogue.events(spark, "/root/testdata/sf0.001").where("event_type IN ('click', 'purchase')")
    assert queries["reconcile_all"](spark, "/root/testdata/sf0.001").agg(F.expr("count(left_ts) + count(right_ts)")).first()[0] == e.count()


def test_filter_by_latest(spark):
    r = elements(spark, [(1, "a"), (3, "a"), (5, "b"), (7, "b"), (8, "a")], "seq long, value string")
    q = elements(spark, [(2, "a"), (6, "b")], "seq long, query string")
    assert rows(joins.filter_by_latest(r, q, "seq", "value", "query"), "seq") == [(3,), (7,)]


def test_session_windows(spark):
    df = ms(elements(spark, [("a", 1000), ("a", 3000), ("a", 10_000)], "k string, ts long"), "ts")
    out = windows.session(df, "ts", "5 seconds", ["k"], n=F.count("*")).select(F.unix_millis("window_start"), F.unix_millis("window_end"), "n")
    assert rows(out, "*") == [(1000, 8000, 2), (10000, 15000, 1)]


def test_panes_equal_hops(spark):
    df = ms(elements(spark, [("a", i * 37_000) for i in range(200)], "k string, ts long"), "ts")
    a = windows.hop(df, "ts", "1 hour", "5 minutes", ["k"], cnt=F.count("*"))
    assert rows(a, "k", "cnt", "window_start") == rows(windows.hop_in_panes(df, "ts", 3600, 300, ["k"]), "k", "cnt", "window_start")


def test_periodic_trigger_with_and_without_purge(spark):
    df = ms(elements(spark, [("a", 500), ("a", 600), ("a", 2500)], "k string, ts long"), "ts")
    counts = lambda purge: [r.cnt for r in windows.fire_periodically(df, "ts", "10 seconds", 1, ["k"], purge).orderBy("fire_time").collect()]
    assert counts(False) == [2, 2, 3] and counts(True) == [2, 0, 1]


def test_top_n_takes_fewer(spark):
    df = elements(spark, [("w", "a", 3), ("w", "b", 3), ("x", "c", 1)], "w string, i string, n long")
    assert rows(topn.top_n(df, ["w"], [F.col("n").desc(), F.col("i")], 3), "w", "i", "row_num") == [("w", "a", 1), ("w", "b", 2), ("x", "c", 1)]


FAILS = [("user-1", "fail", 1000), ("user-1", "fail", 2000), ("user-2", "success", 3000), ("user-1", "fail", 4000), ("user-1", "fail", 5000)]


def test_patterns(spark):
    df = ms(elements(spark, FAILS, "u string, e string, ts long"), "ts")
    pattern = cep.Pattern.begin("fail").where(F.col("e") == "fail").times(3).consecutive()
    out = cep.match(df, pattern, ["u"], "ts").select(*(F.unix_millis(f"fail_{i}_ts") for i in (1, 2, 3)))
    assert rows(out, "*") == [(1000, 2000, 4000), (2000, 4000, 5000)]
    short = cep.Pattern.begin("a").where(F.col("e") == "fail").next("b").where(F.col("e") == "fail").within(1.5)
    assert cep.match(df, short, ["u"], "ts").count() == 2
    orders = ms(elements(spark, [("o1", "create", 1000), ("o2", "create", 2000), ("o1", "pay", 3000)], "o string, e string, ts long"), "ts")
    paid = cep.Pattern.begin("create").where(F.col("e") == "create").next("pay").where(F.col("e") == "pay").within(5)
    assert rows(cep.match_or_timeout(orders, paid, ["o"], "ts"), "o", "status") == [("o1", "matched"), ("o2", "timeout")]
    table = {("s0", "fail"): "s1", ("s1", "fail"): "s2", ("s2", "fail"): "bad", ("s0", "success"): "ok", ("s1", "success"): "ok", ("s2", "success"): "ok"}
    machine = cep.state_machine(df.withColumn("o", F.unix_millis("ts")), table, "s0", {"bad": ("fail", "s2"), "ok": ("success", "s0")}, ["u"], "e", "ts", ["o"])
    assert rows(machine.select("u", F.unix_millis("ts").alias("t"), "output"), "*") == [("user-1", 4000, "fail"), ("user-1", 5000, "fail"), ("user-2", 3000, "success")]


def brute_alerts(values, for_ms):
    last, armed, out = None, None, []
    for t, v in values:
        if armed is not None and armed <= t:
            out.append(armed)
            armed = None
        if last is not None and v > last and armed is None:
            armed = t + for_ms
        elif last is not None and v < last:
            armed = None
        last = v
    return out + ([armed] if armed is not None else [])


def test_rising_alerts(spark):
    import random

    rng = random.Random(2)
    values = [(i * 300, rng.choice([1, 2, 3, 4])) for i in range(300)]
    df = ms(elements(spark, [("s", t, float(v)) for t, v in values], "k string, ts long, v double"), "ts")
    got = sorted(r.alert_ms for r in cep.rising_alerts(df, ["k"], "ts", ["ts"], "v", 1000).collect())
    assert got == brute_alerts(values, 1000) and got


def test_lateness(spark):
    df = ms(elements(spark, [(1, 1000), (2, 2000), (3, 1500)], "seq long, ts long"), "ts")
    assert rows(lateness.late_split(df, "seq", "ts", 0), "seq", "tag") == [(1, "main"), (2, "main"), (3, "late")]
    arrivals = ms(elements(spark, [(1, "a", 1000), (2, "a", 10_000), (3, "a", 2000), (4, "a", 16_000), (5, "a", 3000)], "seq long, k string, ts long"), "ts")
    out = lateness.allowed_lateness(arrivals, "seq", "ts", ["k"], 5000, 5000, 5000).where("end_ms = 5000")
    assert rows(out, "firing", "cnt") == [(1, 1), (2, 2)]
    late = lateness.window_late_split(arrivals, "seq", "ts", 5000, 5000, 5000).where("tag = 'late'")
    assert rows(late, "seq") == [(5,)]


def test_bloom_merges():
    a, b = Bloom(1000, 0.01), Bloom(1000, 0.01)
    assert all(a.add(f"a{i}") or True for i in range(500)) and all(b.add(f"b{i}") or True for i in range(500))
    both = Bloom(1000, 0.01, a.to_bytes()).merge(b)
    assert all(f"a{i}" in both and f"b{i}" in both for i in range(500))
    assert sum(f"c{i}" in both for i in range(2000)) < 60


def test_changelog(spark):
    df = elements(spark, [("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], "k string, n long, o long")
    assert rows(changelog(df, ["k"], "o"), "k", "n", "op") == [("a", 1, "+I"), ("a", 1, "-U"), ("a", 2, "+U"), ("b", 1, "+I")]
    assert rows(upsert_view(df, ["k"], "o"), "k", "n") == [("a", 2), ("b", 1)]
    assert labelled(df, "x").columns[0] == "label"


def test_sql_layer(spark, tmp_path):
    assert translate("SELECT HOP_START(ts, INTERVAL '5' MINUTES, INTERVAL '1' HOURS)") == "SELECT window(ts, '1 hours', '5 minutes').start"
    assert translate("GROUP BY TUMBLE(ts, INTERVAL '1' HOUR)") == "GROUP BY window(ts, '1 hours')"
    with pytest.raises(ValueError):
        translate("HOP(ts, INTERVAL '5' MINUTES)")
    (tmp_path / "clicks.csv").write_text("Mary,./home,1970-01-01 00:00:01\nBob,./cart,1970-01-01 00:00:03\n")
    ddl = f"CREATE TABLE clicks (`user` STRING, `url` STRING, ts TIMESTAMP(3), WATERMARK FOR ts AS ts - INTERVAL '3' SECONDS) WITH ('connector' = 'filesystem', 'path' = '{tmp_path}/clicks.csv', 'format' = 'csv')"
    table = parse_table(ddl)
    assert table.schema == "`user` string, `url` string, `ts` timestamp" and table.watermark == ("ts", "3 seconds")
    engine = Dialect(spark)
    engine.execute(ddl)
    out = engine.query("SELECT user, COUNT(user) AS cnt, TUMBLE_END(ts, INTERVAL '1' HOURS) AS end_t FROM clicks GROUP BY user, TUMBLE(ts, INTERVAL '1' HOURS)")
    assert rows(out.select("user", "cnt", F.unix_millis("end_t")), "*") == [("Bob", 1, 3_600_000), ("Mary", 1, 3_600_000)]
    engine.execute(f"CREATE TABLE result (user STRING, cnt BIGINT) WITH ('connector' = 'filesystem', 'path' = '{tmp_path}/out', 'format' = 'csv')")
    engine.execute("INSERT INTO result SELECT user, COUNT(user) FROM clicks GROUP BY user;")
    assert rows(csv(spark, f"{tmp_path}/out", "user string, cnt long"), "user", "cnt") == [("Bob", 1), ("Mary", 1)]


def test_parsing_helpers(spark):
    k, t = key_seconds(F.col("line"))
    assert elements(spark, [("a 3",)], "line string").select(k, t).collect() == [("a", 3000)]
    assert kafka_options("s:1", "t")["startingOffsets"] == "latest"


def test_ddl_types_keep_their_arguments():
    from rillflow.plans.dialect import parse_table

    t = parse_table("CREATE TABLE t (a DECIMAL(18, 2), b VARCHAR(20), c TIMESTAMP(3), d BIGINT, WATERMARK FOR c AS c) WITH ('connector' = 'filesystem')")
    assert t.schema == "`a` decimal(18,2), `b` varchar(20), `c` timestamp, `d` bigint"


def test_query_of_a_table_without_files_says_so(spark, tmp_path):
    from rillflow.plans.dialect import Dialect

    engine = Dialect(spark)
    engine.execute(f"CREATE TABLE nothing_there (a BIGINT) WITH ('connector' = 'filesystem', 'path' = '{tmp_path}/no', 'format' = 'csv')")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        engine.query("SELECT * FROM nothing_there")


def test_times_without_consecutive():
    pattern = cep.Pattern.begin("a").where(F.lit(True)).times(2).next("b").where(F.lit(True))
    with pytest.raises(ValueError, match="one step"):
        cep.match(None, pattern, ["k"], "ts")


def test_windows_that_are_no_multiple_of_the_slide():
    with pytest.raises(ValueError, match="whole number"):
        windows.hop_in_panes(None, "ts", 3600, 700, [])


def test_accumulator_merges_partial_states(spark):
    from pyspark.sql import types as T

    from rillflow.operators.folds import Accumulator, accumulate

    class Longest(Accumulator):
        def create(self):
            return ""

        def add(self, state, v):
            return max(state, v or "", key=lambda x: (len(x), x))

        def merge(self, a, b):
            return self.add(a, b)

        def result(self, state):
            return state

    df = spark.createDataFrame([(i % 3, "x" * (i % 17)) for i in range(200)] + [(None, "y"), (5, None)], "k long, v string").repartition(6)
    out = accumulate(df, ["k"], ["v"], Longest(), T.StructField("v", T.StringType()), held=1)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(0, "x" * 16), (1, "x" * 16), (2, "x" * 16), (None, "y"), (5, "")], key=str)
    assert accumulate(df.limit(0), ["k"], ["v"], Longest(), T.StructField("v", T.StringType())).count() == 0
