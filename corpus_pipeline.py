"""The corpus pipeline: language, quality, near copies, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept and returns a DataFrame, which is written as Parquet and read again
as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cachelens.llm import langid, packing, quality_rules, simhash, substring_dedup
from cachelens.llm.common import scope, workspace, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too) or in no learned language; cases are as in ``langid.keep_known``."""
    return langid.keep_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject, null and empty texts among them; cases are as in ``quality_rules.keep_good``."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies; rows without an id stay, cases are as in ``simhash.one_per_group``."""
    return simhash.one_per_group(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that a document of a smaller id has too; every document stays, with what is left of it, null texts as they are."""
    return substring_dedup.dedup_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; a null text is empty and still has its end, an empty table gives no rows."""
    return packing.best_two_fit(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", passage_dedup),
    ("best_fit_packing", pack),
]

#: SQL has no language models, XXH64 fingerprints or tokenizers; the stages are tested one by one instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scope(spark):  # what a stage wrote for itself goes once its result stands
            docs = written(stage(spark, docs, sf_dir), f"{home}/{k}-{name}")
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
