"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hashcodes, infilling, jaccard, lexical, lines, mixing, neighbours, quality, sharding, suffixes, tokencount, tokenorder


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, directory, "documents"))


def op2_mixing(spark: SparkSession, directory: str) -> DataFrame:
    sized = _table(spark, directory, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    mixed = mixing.mixture(sized, "size")
    return mixed.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken"))


def op3_quality_classifier(spark: SparkSession, directory: str) -> DataFrame:
    texts = _table(spark, directory, "documents").select("doc_id", "text")
    rated = quality.scored(texts, _table(spark, directory, "labels")).drop("text")
    return rated.select("doc_id", quality.held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_suffix_array_dedup(spark: SparkSession, directory: str) -> DataFrame:
    kept = suffixes.without_repeats(_table(spark, directory, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    kept = lines.deduplicated(_table(spark, directory, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.size("_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, directory: str) -> DataFrame:
    dealt = sharding.sharded(_table(spark, directory, "documents").select("doc_id", "text")).drop("text")
    return dealt.select("doc_id", F.col("_size").alias("size"), F.col("_crc32").alias("text_crc32"), F.lit("key").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_grown_shard").alias("grown_shard"))


def op7_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, directory, "documents"), _table(spark, directory, "benchmark"))


def op8_nearest_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    return neighbours.nearest(_table(spark, directory, "embeddings"))


def op9_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    return tokencount.document_counts(_table(spark, directory, "documents"))


def op10_training_order(spark: SparkSession, directory: str) -> DataFrame:
    return tokenorder.in_training_order(_table(spark, directory, "documents"))


def op11_fill_in_middle(spark: SparkSession, directory: str) -> DataFrame:
    cut = infilling.with_restored(infilling.fill_in_middle(_table(spark, directory, "documents").select("doc_id", "text")).drop("text"))
    digests = (F.sha2(c, 256).alias(f"{c[1:]}_sha256") for c in ("_output", "_restored"))
    return cut.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")), *digests)


def op12_embedding_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    told = hashcodes.near_duplicates(_table(spark, directory, "embeddings").select("vec_id", "embedding", "label"))
    return told.select("vec_id", F.col("_n_links").alias("n_links"), F.col("_component").alias("component_id"), F.col("_kept").alias("kept"))


def op13_lexical_search(spark: SparkSession, directory: str) -> DataFrame:
    return lexical.ranked(_table(spark, directory, "documents"), _table(spark, directory, "benchmark"))


_ALL = (
    op1_ngram_jaccard_join,
    op2_mixing,
    op3_quality_classifier,
    op4_suffix_array_dedup,
    op5_line_dedup,
    op6_sharding,
    op7_decontamination,
    op8_nearest_neighbours,
    op9_token_counts,
    op10_training_order,
    op11_fill_in_middle,
    op12_embedding_near_dedup,
    op13_lexical_search,
)
_SQL = {"op2_mixing": mixing.SQL, "op6_sharding": sharding.sql(), "op11_fill_in_middle": infilling.SQL, "op12_embedding_near_dedup": hashcodes.SQL, "op13_lexical_search": lexical.SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> function of (spark, directory of the Parquet tables)."""
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express."""
    return dict(_SQL)
