"""The dealt operators as queries over the whole tables: thin, each by way of its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .clustering import clustered, clusters_sql
from .common import table
from .decontaminate import contamination_report
from .licenses import license_report, report_sql
from .media import media_report
from .neardup import near_duplicates
from .packing import pack_documents
from .personal import personal_report
from .quality import quality_report
from .secrets import secret_report
from .simhash import simhash_groups
from .substrings import repeats_report
from .warc import warc_round_trip
from .whitening import whitened


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op3_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op4_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op5_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


def op6_bootstrapped_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_report(table(spark, sf_dir, "documents"))


def op7_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_report(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(table(spark, sf_dir, "documents"))


def op11_partial_distance_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def op12_exact_scatter_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitened(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", rows["deviation"].cast("long"))


def op13_bk_tree_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_cnn_quality, op2_secret_links, op3_warc_boundary_chain, op4_license_dice, op5_minmax_neardup, op6_bootstrapped_personal_data, op7_difference_cover_dedup, op8_best_fit_packing, op9_fm_index_decontamination, op10_media_columns, op11_partial_distance_clusters, op12_exact_scatter_whitening, op13_bk_tree_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_dice": report_sql(), "op11_partial_distance_clusters": clusters_sql()}
