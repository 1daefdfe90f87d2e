"""A corpus pipeline: each stage is written as Parquet and read again by the next one.

Toxic documents go; one document of each group of near-duplicates stays; documents that hold a benchmark item go; secrets
are blanked out; what is left is encoded. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.llm import bpe, decontam, secretscan, simhash, toxicity
from tidemill.llm.common import spill_table, table, unused

#: Learned scores, fingerprints and hashes of tokens have no SQL twin; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a model fitted on the labelled ones scores at 0.5 or more go. Null and empty texts score as texts without words; repeated rows fare alike; no rows give none; columns of any names are carried."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the text of the least id stays, of that id's the one of the least digest; rows without an id stay.

    Rows count as one document if both their ids and their texts are equal (by 128 bits of digest), so a text without a
    near copy stays whatever other rows have its id. Null and empty texts are alike, but not one document. No rows give
    none; columns of any names are carried.
    """
    own = unused(docs, "key")
    keyed = docs.where("doc_id is not null").withColumn(own, F.struct(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.md5("text"), F.lit("-")).alias("digest")))
    kept = simhash.similar_texts(keyed, id_col=own).where(F.col("doc_id") == F.col("component_id")).select(F.col("component_id").alias(own)).distinct()
    return keyed.join(kept, own, "left_semi").dropDuplicates([own]).drop(own).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go. Null, empty and short texts hold none; repeated rows fare alike; no rows, or no items, are fine; columns of any names are carried."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay, with secrets replaced in their texts and ``n_chars`` of what is left.

    Null texts stay null and keep their ``n_chars``; repeated rows fare alike; no rows give none; columns of any names are carried.
    """
    clean = secretscan.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, as ``bpe.encode_documents``; a null text counts as the empty one, repeated rows fare alike, no rows give none; columns of other names are not carried."""
    return bpe.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", blank_secrets), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; what each keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spill_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
