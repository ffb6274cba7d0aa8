"""A corpus pipeline: five stages from raw documents to piece ids.

Each stage works on all that the one before it kept; all but the last give back the
columns of documents. Stages are written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.common import crc_mod, table, written
from chronoweave.llm.language_id import drop_rejected
from chronoweave.llm.mixing import apply_mix
from chronoweave.llm.ngram_join import drop_near_copies
from chronoweave.llm.pieces import encode_pieces
from chronoweave.llm.quality import drop_low_quality


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not among those of the corpus."""
    return drop_rejected(docs, docs.where(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(True))))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled ones, scores below a half."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies, once; rows without an id or a word stay."""
    return drop_near_copies(docs, threshold=75, width=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix holds them."""
    return apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return encode_pieces(docs)


STAGES = [("language", language), ("quality", quality), ("deduplicate", deduplicate), ("mixture", mixture), ("encode", encode)]

#: SQL has no form for the models and the encoder; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
