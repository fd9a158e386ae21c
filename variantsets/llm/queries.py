"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, licenses, line_dedup, lm_score, near_dedup, packing, quality, secrets, sentencepiece, sql, substring_dedup
from .common import documents


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir), k=4, percent=80)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = sentencepiece.decode(sentencepiece.encode(documents(spark, sf_dir)))
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.sha2("text", 256).alias("decoded_sha256"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


QUERIES = (
    op1_minhash_near_dedup,
    op2_line_dedup,
    op3_packing,
    op4_secret_scan,
    op5_license_scan,
    op6_sentencepiece,
    op7_lm_score,
    op8_substring_dedup,
    op9_fingerprints,
    op10_quality_rules,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": sql.LINE_DEDUP}
