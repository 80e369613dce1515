"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, language, near_dup, packing, quality
from gridloom.llm.common import content_key, read_table, stored, without
from gridloom.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    # the verdict is of these values alone, so it goes by them: a doc_id may be null or repeated
    key = content_key("text", "lang", "source")
    judged = language.identify(language.document_rows(docs.withColumn("doc_id", key)), language.fit(docs))
    return without(docs, judged.filter("not kept").select("id"), key)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and with them documents that lose too much."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: one with the least id."""
    return near_dup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    key = content_key("text")
    index = decontaminate.build_index(docs.withColumn("doc_id", key))
    judged = decontaminate.phrase_hits(index, read_table(spark, sf_dir, "benchmark"))
    return without(docs, judged.filter("contaminated").select("doc_id"), key)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The language model, the near-duplicate graph and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
