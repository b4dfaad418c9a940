"""The query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data by its name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through an empty digest cache."""
    from cachelens.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts of all documents, cutoffs certified per language."""
    from cachelens.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 50-word passages removed from all documents."""
    from cachelens.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents."""
    from cachelens.llm.simhash import simhash_near_dedup

    return simhash_near_dedup(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    from cachelens.llm.packing import best_two_fit

    return best_two_fit(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    from cachelens.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page urls judged by rules and path templates."""
    from cachelens.llm.url_templates import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded into pieces and decoded again."""
    from cachelens.llm.pieces import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"))


def op9_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and the groups of near copies found by banding."""
    from cachelens.llm.edit_fingerprints import edit_fingerprints, fingerprint_groups

    rows = edit_fingerprints(table(spark, sf_dir, "documents"))  # written, but for the few edge rows
    return rows.join(fingerprint_groups(rows.select("doc_id", "fingerprint")), "fingerprint").select(*rows.columns, "group_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    from cachelens.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_url_templates": op7_url_templates,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_edit_fingerprints": op9_edit_fingerprints,
    "op10_toxicity": op10_toxicity,
}

ORACLE: dict[str, str] = {
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS key FROM s),
f AS (SELECT key, min(doc_id) AS lo FROM k GROUP BY key),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM k JOIN f USING (key) WHERE lo < doc_id),
gone AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)""",
}
