"""The corpus pipeline: documents to packed sequences, in five stages of the operators of ledgerflow.llm.

Each stage takes any table with doc_id, text and source. Defined cases of all stages: nulls in any column, empty and very long
texts, repeated rows and empty tables are legal, and other columns are handed on as they are (n_chars follows a changed text) up
to the last stage, which returns the pieces alone. Each stage says below what it does with them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm import jaccard, linefreq, packing, quality, secretscan
from ledgerflow.llm._spark import saved, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts with them, as they have fewer than ten words. Repeated rows stay or go together."""
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above their host's boilerplate ratio go; every document stays, one that loses all its lines with an empty text, a null text null. Repeated rows count as pages each; a null source counts as the empty host."""
    return linefreq.with_text(linefreq.drop_boilerplate(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest doc_id (null first), then of the least row hash; of rows equal in id, text and source one. Documents without words all stay."""
    return jaccard.near_dedup(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; every document stays, null texts null. Spans that touch or overlap become one mark."""
    return linefreq.with_text(secretscan.redact(docs), docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null or empty text is the closing token alone, and repeated rows are packed each."""
    return packing.packed(packing.pieces(docs, TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scan", secret_scan),
    ("best-fit packing", packed_sequences),
]

#: Tokens of a byte-level BPE and exact packing are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents one after the other, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
