"""Corpus pipeline: documents through five of the training-data operators, in order.

Every stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm import common, decontamination, minhash, nbest, paragraphs, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the co-trained classifier rejects go.

    Null and empty texts and null metadata are scored as they are; repeated rows fare alike; without labels of both kinds all rows stay."""
    return quality.kept(docs, common.read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 at a similarity of 0.8: of each group one row stays, that with the least doc_id (nulls last) and text hash.

    Rows without words stay, repeated ones too; rows of one doc_id, null or not, go by their own texts."""
    return minhash.without_copies(docs, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each repeated paragraph the first occurrence stays, the others are cut out of their texts.

    Rows that had words and have none left go; null and empty texts stay; repeated rows are cut alike."""
    return paragraphs.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that leak a benchmark item go.

    Null and empty texts leak nothing; repeated rows fare alike; without items all rows stay."""
    return decontamination.without_leaks(docs, common.read(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: piece ids and scores of the N best segmentations, and a check of each round trip.

    A row each row, of whole texts; null and empty texts have no pieces."""
    return nbest.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: SQL can express neither the classifier nor the search for near duplicates; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
