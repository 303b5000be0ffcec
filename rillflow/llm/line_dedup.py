"""Line deduplication over overlapping three-line windows, with DataFrame functions only.

Three consecutive lines make a window. Windows are hashed and counted over the whole table; of a window that is found
more than once the first occurrence, by (doc_id, position), stays, and the lines that any later occurrence covers go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _windows(lines: Column, size: int) -> Column:
    """md5 of each run of ``size`` lines, in order; none where the text has fewer lines."""
    n = F.size(lines)
    at = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.unhex(F.md5(F.concat_ws("\n", F.slice(lines, i, size)).cast("binary"))))


def _row_key() -> Column:
    """128 bits of a row's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))).cast("binary")))


def _fresh(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def covered_spans(positions: Column, size: int) -> Column:
    """Merge windows into spans: an array of (first line, line after the last) from sorted window positions."""
    n = F.size(positions)
    starts = F.filter(positions, lambda x, i: (i == 0) | (x - F.get(positions, i - 1) > size))
    ends = F.filter(positions, lambda x, i: (i == n - 1) | (F.get(positions, i + 1) - x > size))
    return F.arrays_zip(starts.alias("first"), F.transform(ends, lambda e: e + size).alias("after"))


def line_dedup(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text and any others) with later copies of repeated windows cut out of ``text``.

    Adds n_lines (lines before; 0 for a null text) and n_removed. A text without removed lines comes back unchanged,
    null and empty ones included; a text whose every line goes becomes empty. Lines are split at \\n alone. A text is
    worked on whole, however long: it is one row of at most its own size in the shuffles. Rows with
    the same doc_id and text are one document: they get the same result. A null doc_id orders before all others.
    Occurrences within one document count like those of different documents. Columns named n_lines or n_removed are
    replaced; all others are kept.
    """
    docs = docs.drop("n_lines", "n_removed")
    key, spans_of = _fresh("_key", docs.columns), _fresh("_spans", docs.columns)
    keyed = docs.withColumn(key, _row_key())
    lines = F.split(F.col("text"), "\n", -1)
    # One row per window: hash, document, position. Where a document holds a window twice, both rows stay.
    windows = (
        docs.where(F.col("text").contains("\n"))
        .select("doc_id", _row_key().alias("_key"), lines.alias("_lines"))
        .select("doc_id", "_key", F.posexplode(_windows(F.col("_lines"), size)).alias("_at", "_hash"))
    )
    place = F.struct(F.col("doc_id"), F.col("_key"), F.col("_at"))
    repeated = windows.groupBy("_hash").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first != _last").select("_hash", "_first")
    later = windows.join(repeated, "_hash").where(place != F.col("_first"))
    spans = later.groupBy("_key").agg(F.array_sort(F.collect_set("_at")).alias("_positions")).select(F.col("_key").alias(key), covered_spans(F.col("_positions"), size).alias(spans_of))
    cut = keyed.join(spans, key, "left").drop(key)
    all_lines = F.split(F.col("text"), "\n", -1)
    after = F.concat(F.array(F.lit(0)), F.col(f"{spans_of}.after"))
    first = F.concat(F.col(f"{spans_of}.first"), F.array(F.size(all_lines)))
    kept = F.flatten(F.zip_with(after, first, lambda a, b: F.slice(all_lines, a + 1, b - a)))
    removed = F.aggregate(spans_of, F.lit(0), lambda n, s: n + s["after"] - s["first"])
    return cut.select(
        *(F.when(F.col(spans_of).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(all_lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


#: The same rows in DuckDB's SQL.
SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, p - 1 AS pos, lines[p] || chr(10) || lines[p + 1] || chr(10) || lines[p + 2] AS win
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS p FROM docs)
),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY md5(win) ORDER BY doc_id, pos) AS rn FROM w),
gone AS (SELECT DISTINCT doc_id, pos + k AS line FROM ranked, range(3) t(k) WHERE rn > 1),
l AS (SELECT doc_id, unnest(range(len(lines))) AS line, unnest(lines) AS s FROM docs),
kept AS (
  SELECT l.doc_id, coalesce(string_agg(l.s, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS text,
         count(*)::BIGINT AS n_lines, count(g.line)::BIGINT AS n_removed
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
)
SELECT doc_id, text, n_lines, n_removed FROM kept
"""
