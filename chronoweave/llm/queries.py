"""The training-data operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.common import crc_mod, fresh_path, table
from chronoweave.llm.language_id import identify_language
from chronoweave.llm.lexical_search import ranked_search
from chronoweave.llm.licenses import license_scan
from chronoweave.llm.mixing import mix
from chronoweave.llm.ngram_join import jaccard_components
from chronoweave.llm.pieces import encode_pieces
from chronoweave.llm.quality import score_quality
from chronoweave.llm.quality_rules import quality_rules
from chronoweave.llm.token_counts import section_token_counts
from chronoweave.llm.token_store import read_token_store, write_token_store
from chronoweave.llm.vector_codes import vector_codes
from chronoweave.llm.vector_dedup import near_duplicates
from chronoweave.llm.vector_topk import top_k


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_token_counts(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's columns that the contract fixes; these have SQL."""
    return op3_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-store")
    write_token_store(table(spark, sf_dir, "documents"), path, end_id=0)
    return read_token_store(spark, path)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), threshold=75, width=5)


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    found = identify_language(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "n_letters", "rejected")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("failed")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_pieces, op3_licenses, op4_token_store, op5_top_k, op6_jaccard, op7_vector_dedup, op8_mixing, op9_quality, op10_language, op11_quality_rules, op12_lexical_search, op13_vector_codes, licenses_base)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from chronoweave.llm.oracles import ORACLES

    return dict(ORACLES)
