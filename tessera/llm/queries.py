"""Registered queries of this package and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, divergence, exact_dedup, hard_negatives, langid, licenses, packing, pitman_yor, quality, simhash_dedup, token_output, toxicity, warc


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.annotate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(common.table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.annotate(common.table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.annotate(common.table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "token-files")
    token_output.write(common.table(spark, sf_dir, "documents"), path)
    return token_output.documents(spark, path)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.annotate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.annotate(common.table(spark, sf_dir, "documents"), words=3, radius=2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.annotate(common.table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.annotate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(common.table(spark, sf_dir, "embeddings"), label=moved, anchor=F.col("vec_id") % 100 == 0)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "warc")
    warc.write_pages(common.table(spark, sf_dir, "pages"), path)
    return warc.page_records(spark, path)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_exact_dedup, op3_license_scan, op4_lm_scoring, op5_token_output, op6_quality_classifier, op7_simhash_dedup, op8_language_id, op9_packing, op10_toxicity, op11_source_divergence, op12_hard_negatives, op13_warc)}

ORACLE = {
    "op1_decontamination": decontaminate.ORACLE,
    "op3_license_scan": licenses.oracle(),
    "op11_source_divergence": divergence.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_warc": warc.ORACLE,
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
             g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, d.h AS text_sha256
        FROM d JOIN g USING (h)""",
}
