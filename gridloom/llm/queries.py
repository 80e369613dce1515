"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .bpe import round_trip
from .chat import digest_windows, format_conversations
from .clusters import clustered
from .common import read_table
from .ctw import score_documents
from .decontaminate import build_index, phrase_hits
from .html import extract_pages
from .language import fit, identify, page_rows
from .licenses import scan_licenses
from .near_dup import near_duplicates
from .packing import pack_documents
from .quality import quality_report
from .spelling import variants
from .urls import filter_urls


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return digest_windows(format_conversations(turns.unionByName(extra)))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(read_table(spark, sf_dir, "documents"))
    return identify(page_rows(read_table(spark, sf_dir, "pages")), model, markup=True).withColumnRenamed("id", "page_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_hits(build_index(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read_table(spark, sf_dir, "embeddings"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_windows, op2_url_filter, op3_license_scan, op4_near_duplicates, op5_language_id, op6_html_extraction, op7_lm_scoring, op8_decontamination, op9_quality_rules, op10_best_fit_packing, op11_spelling_variants, op12_centroid_clusters, op13_bpe_round_trip)
}
ORACLES: dict[str, str] = oracles.ORACLES
