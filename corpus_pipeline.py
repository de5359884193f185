"""The corpus pipeline: language ID, quality rules, exact dedup, n-gram Jaccard join, packing.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last return the columns of
documents. The language model learns from the labelled rows of the stage's own input that op8 may learn from. What a
stage wrote for itself, and its predecessor's table, are removed once its own table is written.

Defined cases: documents with a null or empty text, or without a letter, go in the first stage. Of equal texts the one
with most code points stays, then the smallest doc_id, null ids last; rows that repeat a text and a doc_id are one.
Near copies without a doc_id have nothing to be linked by and stay. Empty tables pass through; columns beside doc_id,
text and lang are carried along whatever they hold or are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import exact_dedup, jaccard_join, language_id, packing, quality_rules
from threadloom.llm.common import materialize, read_table, scratch, sweep


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language that is known."""
    return language_id.keep_known(docs, language_id.train_on_open_rows(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a rule fails."""
    return quality_rules.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of five-word shingles at 0.8 or more join."""
    return jaccard_join.keep_one(docs, size=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    import public_tokenizers

    return packing.pack_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack_sequences),
]

#: Neither the language model nor the packing plan is expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = ["stage-" + name.lower().replace(" ", "-") for name, _ in STAGES]
    with scratch(spark, labels[-1]):
        for label, (_, stage) in zip(labels, STAGES):
            docs = materialize(stage(spark, docs, sf_dir), label)
            sweep(spark, label)
    return docs
