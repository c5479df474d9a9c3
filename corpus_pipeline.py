"""Corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as
Parquet and reads it again for the next one. All stages but the last return the
columns of documents. A document is a row: doc_ids may repeat or be null, and
rows are told apart by a number of their own. Of rows with equal text the dedup
stages keep one, whatever their doc_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import bpe, exact_dedup, language_id, minhash, mixing
from strataq.llm.common import materialize


def _numbered(docs: DataFrame, tag: str) -> DataFrame:
    """_row (unique, in the written order) and doc (a struct of all columns, whatever their names); written, so that every reading has the same numbers."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return materialize(docs.select(F.monotonically_increasing_id().alias("_row"), every.alias("doc")), tag)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go (null text, no letter, or under its calibrated threshold).

    Repeated rows are judged alike; null or repeated doc_ids are no matter.
    """
    out = language_id.identify(docs, language_id.fit_model(docs))
    return out.where(~F.col("rejected")).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal text (white space apart; null counts as empty) the longest, then that of the smallest doc_id (null last), then the first, stays."""
    rows = _numbered(docs, "pipeline-exact-rows")
    kept = exact_dedup.exact_dedup(rows.select("_row", "doc.doc_id", "doc.text"), row="_row").where("kept").select("_row")
    return rows.join(kept, "_row", "left_semi").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id (null last), then the first row, stays.

    Documents without words (null, empty) are linked with nothing and stay.
    """
    rows = _numbered(docs, "pipeline-near-rows")
    keyed = rows.select(F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), "_row").alias("key"), "doc.text")
    kept = minhash.near_dedup(keyed, key="key").where("kept").select("key._row")
    return rows.join(kept, "_row", "left_semi").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words, which no target can count, go."""
    rows = _numbered(docs, "pipeline-mix-rows")
    return mixing.mixed_rows(rows, "doc.doc_id", "doc.text", "doc.source", "_row", "doc").select("doc.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix; null text counts as empty, repeated rows repeat."""
    return bpe.encode_digest(docs).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]
#: SQL cannot express language ID, MinHash and BPE: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
