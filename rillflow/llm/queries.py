"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .cascade import SQL as CASCADE_SQL
from .cascade import quality_cascade
from .license_scan import license_scan
from .line_dedup import SQL as LINE_DEDUP_SQL
from .line_dedup import line_dedup
from .media import media_columns
from .ngram_join import SQL as NGRAM_JOIN_SQL
from .ngram_join import ngram_join
from .packing import pack
from .quality_gbdt import quality
from .sp_lattice import segment_samples
from .toxicity import toxicity
from .warc import warc_derivatives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """The file of the 50k byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derivatives(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(table(spark, sf_dir, "documents")).drop("rejected_by")


def op10_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return segment_samples(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_line_dedup, op3_warc, op4_toxicity, op5_ngram_join, op6_media, op7_quality, op8_packing, op9_quality_rules, op10_segmentations)
}

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": LINE_DEDUP_SQL, "op5_ngram_join": NGRAM_JOIN_SQL, "op9_quality_rules": CASCADE_SQL}
