"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are measured on a bounded sample; the rules then run in the order of rejections per
cost, and a document that one rule rejects is not shown to the next. The verdict does not depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .textstats import CONT, DIGIT, EXCLAIM, LETTER, SYMBOL, UPPER, base_counts
from .wordhash import Text, chunks, same_as_last

SAMPLE_ROWS = 512
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a Text and returns a mask of the documents to reject."""

    name: str
    rejects: Callable[[Text], np.ndarray]


def _n_words(text: Text) -> np.ndarray:
    return np.maximum(np.bincount(text.words()[2], minlength=text.n_docs), 1)


def _chars(text: Text) -> np.ndarray:
    return np.maximum(text.per_doc(~CONT[text.raw]), 1)


def _symbols(text: Text) -> np.ndarray:
    return text.per_doc(SYMBOL[text.raw]) > 0.1 * _n_words(text)


def _shouting(text: Text) -> np.ndarray:
    return text.per_doc(UPPER[text.raw]) > 0.5 * np.maximum(text.per_doc(LETTER[text.raw]), 1)


def _exclaims(text: Text) -> np.ndarray:
    return text.per_doc(EXCLAIM[text.raw]) > 0.5 * _n_words(text)


def _word_length(text: Text) -> np.ndarray:
    starts, ends, doc = text.words()
    chars = np.concatenate([[0], np.cumsum(~CONT[text.raw], dtype=np.int64)])
    mean = np.bincount(doc, weights=chars[ends] - chars[starts], minlength=text.n_docs) / _n_words(text)
    return (mean < 2.5) | (mean > 12)


def _few_letters(text: Text) -> np.ndarray:
    return text.per_doc(LETTER[text.raw]) < 0.5 * _chars(text)


def _digits(text: Text) -> np.ndarray:
    return text.per_doc(DIGIT[text.raw]) > 0.3 * _chars(text)


def _repeated_lines(text: Text) -> np.ndarray:
    start, end, doc = text.lines()
    some = end > start
    start, end, doc = start[some], end[some], doc[some]
    order, same = same_as_last(doc, text.hashes(start, end))
    lines = np.maximum(np.bincount(doc, minlength=text.n_docs), 1)
    return np.bincount(doc[order[same]], minlength=text.n_docs) > 0.4 * lines


def _vocabulary(text: Text) -> np.ndarray:
    doc = text.words()[2]
    order, same = same_as_last(doc, text.word_hashes())
    return np.bincount(doc[order[~same]], minlength=text.n_docs) < 0.08 * _n_words(text)


def _top_word(text: Text) -> np.ndarray:
    doc = text.words()[2]
    order, same = same_as_last(doc, text.word_hashes())
    first = np.flatnonzero(~same)
    top = np.zeros(text.n_docs, np.int64)
    np.maximum.at(top, doc[order[first]], np.diff(np.append(first, len(doc))))
    return top > 0.3 * _n_words(text)


RULES = (
    Rule("symbols", _symbols), Rule("shouting", _shouting), Rule("exclaims", _exclaims),
    Rule("word_length", _word_length), Rule("few_letters", _few_letters), Rule("digits", _digits),
    Rule("repeated_lines", _repeated_lines), Rule("vocabulary", _vocabulary), Rule("top_word", _top_word),
)


def take(raw: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of some of the documents."""
    lens = offsets[rows + 1] - offsets[rows]
    out = np.concatenate([[0], np.cumsum(lens)])
    at = np.repeat(offsets[rows] - out[:-1], lens) + np.arange(out[-1])
    return raw[at], out


def base_failed(base: dict[str, np.ndarray], min_words: int, max_repeat_percent: int) -> np.ndarray:
    return (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat_percent * base["n_words"])


def _measure(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], min_words: int, max_repeat_percent: int) -> Iterator[pa.RecordBatch]:
    cost, rejected, docs = np.zeros(len(rules)), np.zeros(len(rules)), 0
    for batch in batches:
        for _, _, raw, offsets in chunks(batch.column(0)):
            passed = np.flatnonzero(~base_failed(base_counts(Text(raw, offsets)), min_words, max_repeat_percent))
            if not len(passed):
                continue
            raw, offsets = take(raw, offsets, passed)
            for i, rule in enumerate(rules):
                text = Text(raw, offsets)  # a fresh one: no rule profits from what another has computed
                began = time.thread_time()
                rejected[i] += rule.rejects(text).sum()
                cost[i] += time.thread_time() - began
            docs += len(passed)
    names = [r.name for r in rules]
    yield pa.record_batch([pa.array(names), pa.array(cost), pa.array(rejected), pa.array(np.full(len(rules), docs))], ["rule", "cost", "rejects", "docs"])


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected), best order first, from those of at most ``sample_rows`` documents that pass the
    base check, as the rules see no others.

    The sample is the documents first by hash of doc_id. The scan leaves out, by the count of all documents, hashes that
    cannot be among them but with a chance below 1e-9, so only about twice the sample's rows come to the sort.
    """
    n = docs.count()
    share = min(1.0, (2 * sample_rows + 200) / max(n, 1))
    by = F.xxhash64(F.col("doc_id").cast("string"))
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    sample = docs.select("text", by.alias("_by")).where(F.col("_by") <= bound).orderBy("_by").limit(sample_rows).select("text")
    measured = sample.mapInArrow(lambda it: _measure(it, rules, min_words, max_repeat_percent), "rule string, cost double, rejects double, docs long")
    rows = measured.groupBy("rule").agg(F.sum("cost").alias("cost"), (F.sum("rejects") / F.greatest(F.sum("docs"), F.lit(1))).alias("rejects")).collect()
    return sorted(((r.rule, r.cost, r.rejects) for r in rows), key=lambda r: (-(r[2] + 1e-3) / (r[1] + 1e-6), r[0]))


def run_rules(raw: np.ndarray, offsets: np.ndarray, rows: np.ndarray, rules: list[Rule]) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``rows`` every rule lets pass, and by row the position of the rule that rejected it (-1: none)."""
    by = np.full(len(offsets) - 1, -1, np.int64)
    for i, rule in enumerate(rules):
        if not len(rows):
            break
        bad = rule.rejects(Text(*take(raw, offsets, rows)))
        by[rows[bad]] = i
        rows = rows[~bad]
    return rows, by


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the base counts, base_failed, kept and rejected_by.

    A null or empty text has no words, so it fails the base check. Null doc_ids are carried along; repeated rows are
    judged one by one; other columns of ``docs`` are left aside. rejected_by names the first rule of this run's order
    ("base" for the base check, null if kept); the order follows measured times and may change between runs, kept
    never does. An empty table gives no rows.
    """
    order = [name for name, _, _ in plan_cascade(docs, rules, min_words, max_repeat_percent, sample_rows)] or [r.name for r in rules]
    ordered = sorted(rules, key=lambda r: order.index(r.name) if r.name in order else len(order))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([r.name for r in ordered] + ["base", None], dtype=object)
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column(1)):
                base = base_counts(Text(raw, offsets))
                failed = base_failed(base, min_words, max_repeat_percent)
                kept_rows, by = run_rules(raw, offsets, np.flatnonzero(~failed), ordered)
                kept = np.zeros(hi - lo, bool)
                kept[kept_rows] = True
                by[failed], by[kept] = len(ordered), len(ordered) + 1
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(base[k]) for k in BASE), pa.array(failed), pa.array(kept), pa.array(names[by], pa.string())],
                    ["doc_id", *BASE, "base_failed", "kept", "rejected_by"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(judge), "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, kept boolean, rejected_by string")


#: The same rows (built-in rules) in DuckDB's SQL.
SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
word AS (SELECT r, count(*) AS c FROM (SELECT r, unnest(ws) AS w FROM t) GROUP BY r, w),
words AS (SELECT r, count(*) AS n_distinct, max(c) AS top FROM word GROUP BY r),
win AS (SELECT r, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS p FROM t)),
again AS (SELECT r, p FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT p + k) AS n FROM again, range(3) x(k) GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS s FROM t),
lines AS (
  SELECT r, count(*) FILTER (WHERE regexp_matches(s, '[^\x20\x09-\x0D]')) - count(DISTINCT s) FILTER (WHERE regexp_matches(s, '[^\x20\x09-\x0D]')) AS n_dup_lines,
         count(*) FILTER (WHERE s <> '') AS n, count(DISTINCT s) FILTER (WHERE s <> '') AS n_distinct
  FROM line GROUP BY r
),
base AS (
  SELECT t.r, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         lines.n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         greatest(len(ws), 1)::DOUBLE AS n, greatest(length(text), 1)::DOUBLE AS chars,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^A-Za-z\x{C0}-\x{10FFFF}]', '', 'g')) AS letters,
         length(regexp_replace(text, '[^!?]', '', 'g')) AS exclaims, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits,
         lines.n AS n_lines, lines.n_distinct AS lines_distinct, coalesce(words.n_distinct, 0) AS words_distinct, coalesce(words.top, 0) AS top
  FROM t JOIN lines USING (r) LEFT JOIN words USING (r) LEFT JOIN covered USING (r)
),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols > 0.1::DOUBLE * n OR upper > 0.5::DOUBLE * greatest(letters, 1) OR exclaims > 0.5::DOUBLE * n
         OR word_chars / n < 2.5::DOUBLE OR word_chars / n > 12 OR letters < 0.5::DOUBLE * chars OR digits > 0.3::DOUBLE * chars
         OR n_lines - lines_distinct > 0.4::DOUBLE * greatest(n_lines, 1) OR words_distinct < 0.08::DOUBLE * n OR top > 0.3::DOUBLE * n AS rejected
  FROM base
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged
"""
