"""The operators over the tables of the driver, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chunkdedup, conversations, decontam, langid, licenses, merkle, secretscan, simhash, tokenfile, toxicity, urlfilter, vecjoin
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model fitted on the labelled rows that are not held out."""
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    return secretscan.digest(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of the token ids of every document, and of what they decode to."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ids=False)


def op5_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, within its label."""
    return vecjoin.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of the ids of every document, from the token files."""
    return tokenfile.token_file_digest(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of every document that others hold too."""
    return chunkdedup.repeated_passages(table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of every document that name a licence."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by prototypes of the documents that are not held out."""
    return langid.judge(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, audit and digest of every damaged conversation as repaired."""
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether the tampered table is proved by them."""
    return merkle.verify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_secrets, op3_decontamination, op4_bpe, op5_vector_join, op6_token_file, op7_simhash, op8_urls, op9_substrings, op10_licences, op11_language, op12_conversations, op13_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op8_urls": urlfilter.judge_sql(), "op12_conversations": conversations.repair_report_sql(), "op13_manifest": merkle.verify_sql()}
