"""A small SQL layer: group-window functions, connector tables with watermarks, and INSERT INTO.

``TUMBLE(ts, size)`` and ``HOP(ts, slide, size)`` with their _START and _END become Spark's ``window``; ``CREATE TABLE …
WITH ('connector' = …)`` declares a source or a sink; a query over streaming tables streams.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_INTERVAL = r"INTERVAL\s+'(\d+)'\s+(\w+)"
_WINDOW = re.compile(rf"\b(TUMBLE|HOP)(_START|_END|_ROWTIME)?\s*\(\s*([\w.`]+)\s*,\s*{_INTERVAL}\s*(?:,\s*{_INTERVAL}\s*)?\)", re.I)
_CREATE = re.compile(r"\s*CREATE\s+(?:TEMPORARY\s+)?TABLE\s+`?(\w+)`?\s*\((.*)\)\s*WITH\s*\((.*)\)\s*;?\s*\Z", re.I | re.S)
_INSERT = re.compile(r"\s*INSERT\s+INTO\s+`?(\w+)`?\s+(SELECT.*)\Z", re.I | re.S)
_WATERMARK = re.compile(rf"WATERMARK\s+FOR\s+`?(\w+)`?\s+AS\s+`?\w+`?\s*(?:-\s*{_INTERVAL})?", re.I)
_TYPES = {"STRING": "string", "BIGINT": "bigint", "INT": "int", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}


def duration(n: str, unit: str) -> str:
    return f"{n} {unit.lower().rstrip('s')}s"


def translate(sql: str) -> str:
    """The same query with group-window functions in Spark's words. HOP's arguments are slide, size; window's size, slide."""

    def one(m: re.Match) -> str:
        kind, part, ts = m[1].upper(), (m[2] or "").upper(), m[3]
        first, second = duration(m[4], m[5]), duration(m[6], m[7]) if m[6] else None
        if (kind == "HOP") != (second is not None):
            raise ValueError(f"{kind} takes {'a slide and a size' if kind == 'HOP' else 'one size'}: {m[0]}")
        window = f"window({ts}, '{second}', '{first}')" if second else f"window({ts}, '{first}')"
        if part == "_ROWTIME":
            return f"window_time({window})"
        return window + {"": "", "_START": ".start", "_END": ".end"}[part]

    return _WINDOW.sub(one, sql)


@dataclass
class Table:
    name: str
    schema: str
    watermark: tuple[str, str] | None
    options: dict[str, str]


def _split(columns: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [x.strip() for x in [*out, now] if x.strip()]


def parse_table(ddl: str) -> Table:
    """A CREATE TABLE statement: columns, an optional WATERMARK clause, and the WITH options."""
    m = _CREATE.match(ddl)
    if not m:
        raise ValueError(f"not a connector table: {ddl.strip()[:80]}")
    fields, watermark = [], None
    for item in _split(m[2]):
        if w := _WATERMARK.match(item):
            watermark = (w[1], duration(w[2], w[3]) if w[2] else "0 seconds")
            continue
        name, kind = item.split(None, 1)
        kind, arguments = re.fullmatch(r"\s*(\w+)\s*(\(.*\))?.*", kind, re.S).groups()
        plain = _TYPES.get(kind.upper())  # of TIMESTAMP(3) and the like the argument is dropped, of DECIMAL(18, 2) it stays
        fields.append(f"`{name.strip('`')}` {plain or kind.lower() + (arguments or '').replace(' ', '')}")
    options = dict(re.findall(r"'([^']*)'\s*=\s*'([^']*)'", m[3]))
    return Table(m[1], ", ".join(fields), watermark, options)


class Dialect:
    """A session of the SQL layer. ``streaming`` makes file and Kafka sources unbounded."""

    def __init__(self, spark: SparkSession, streaming: bool = False):
        self.spark, self.streaming, self.tables, self.absent = spark, streaming, {}, {}

    def view(self, name: str, df: DataFrame, rowtime: str | None = None, delay: str = "0 seconds", proctime: str | None = None) -> None:
        """A DataFrame as a table; ``rowtime`` is its event-time column, ``proctime`` a new column of processing time."""
        df = df.withColumn(proctime, F.current_timestamp()) if proctime else df
        (df.withWatermark(rowtime, delay) if rowtime and df.isStreaming else df).createOrReplaceTempView(name)

    def query(self, sql: str) -> DataFrame:
        for name, why in self.absent.items():  # a table that was declared before its files were there
            if re.search(rf"\b{name}\b", sql):
                try:
                    self._source(self.tables[name]).createOrReplaceTempView(name)
                except AnalysisException:
                    raise why from None
        return self.spark.sql(translate(sql))

    def _source(self, t: Table) -> DataFrame:
        kind = t.options.get("connector")
        reader = self.spark.readStream if self.streaming else self.spark.read
        if kind == "filesystem":
            df = reader.schema(t.schema).format(t.options.get("format", "csv")).load(t.options["path"])
        elif kind == "kafka":
            lines = self.spark.readStream.format("kafka").option("kafka.bootstrap.servers", t.options["properties.bootstrap.servers"]).option("subscribe", t.options["topic"]).load()
            df = lines.select(F.from_csv(F.col("value").cast("string"), t.schema).alias("r")).select("r.*")
        else:
            raise ValueError(f"no source for connector {kind!r}")
        return df.withWatermark(*t.watermark) if t.watermark and df.isStreaming else df

    def execute(self, statement: str):
        """CREATE TABLE declares; INSERT INTO … SELECT writes (and returns the running stream, if it is one)."""
        if m := _INSERT.match(statement):
            return self._insert(self.tables[m[1]], self.query(m[2].rstrip().rstrip(";")))
        table = parse_table(statement)
        self.tables[table.name] = table
        if table.options.get("connector") != "print":
            try:
                self._source(table).createOrReplaceTempView(table.name)
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                self.absent[table.name] = e  # a sink's folder need not exist yet; a query that reads it says so
        return table

    def _insert(self, sink: Table, df: DataFrame):
        names = re.findall(r"`([^`]*)`", sink.schema)
        df = df.toDF(*names)
        kind = sink.options.get("connector")
        if not df.isStreaming:
            if kind == "print":
                df.show(truncate=False)
                return df
            df.write.mode("append").format(sink.options.get("format", "csv")).save(sink.options["path"])
            return df
        if kind == "print":
            return df.writeStream.outputMode("update").format("console").start()
        writer = df.writeStream.outputMode("append").format(sink.options.get("format", "csv"))
        return writer.option("checkpointLocation", sink.options["checkpoint"]).start(sink.options["path"])
