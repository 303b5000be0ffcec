"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

1. toxicity: documents that score 0.3 or more go.
2. quality: documents that score below 0.5 go.
3. line_dedup: later copies of repeated three-line windows are cut out of the texts.
4. ngram_join: of each group of near duplicates (five words, similarity of 0.8 or more) the smallest doc_id stays.
5. packing: what is left is packed into sequences of 1024 tokens.

Rows with a null doc_id pass every stage but are never near duplicates. Repeated rows of one doc_id leave stage 4 once: the
one whose text, then whole row, has the least hash.
A null text counts as empty and is scored like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.line_dedup import line_dedup
from rillflow.llm.ngram_join import ngram_join
from rillflow.llm.packing import pack
from rillflow.llm.quality_gbdt import score_quality, train_quality
from rillflow.llm.queries import table, tokenizer_file
from rillflow.llm.shared import drop_table, write_table
from rillflow.llm.toxicity import score_toxicity, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 0").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = ngram_join(docs, k=5, percent=80).where("doc_id = component_id").select("doc_id")
    row = F.struct(*docs.columns)
    first = F.min_by(row, F.struct(F.xxhash64("text"), F.xxhash64(F.to_json(row))))
    once = docs.join(kept, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(first.alias("_row")).select("_row.*")
    return once.select(*docs.columns).union(docs.where("doc_id IS NULL"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_file())


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("packing", packing),
]

#: SQL can't express the trained classifiers; tests compare each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, write_table(stage(spark, docs, sf_dir), name)
        drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
