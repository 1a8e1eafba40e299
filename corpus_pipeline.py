"""From raw documents to a sharded training corpus: five stages, each one operator of the subpackage llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waxwing.llm import decontamination, jaccard, mixing, quality, sharding
from waxwing.llm.work import folder, private, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operator over ``docs``, whose columns that begin with an underscore have other names meanwhile."""
    ours = [c for c in docs.columns if c.startswith("_")]
    names = dict(zip(ours, private(docs, *(f"kept{c}" for c in ours)), strict=True))
    return operator(docs.withColumnsRenamed(names)).withColumnsRenamed({new: old for old, new in names.items()})


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are predicted to be of quality 1; empty and null texts, which score 0.5, are among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _apart(docs, lambda d: quality.scored(d, labels).filter(F.col("_score") >= quality.THRESHOLD).drop("_score"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; those without words and those with a null id all stay."""
    return jaccard.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; those with a null id stay."""
    return decontamination.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is one of its own, and wordless texts count as size 0."""

    def mixed(d: DataFrame) -> DataFrame:
        (words,) = private(d, "words")
        return mixing.emitted(mixing.mixture(d.withColumn(words, mixing.word_count()), words)).drop(words)

    return _apart(docs, mixed)


def hash_tree_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it, which replace columns of these names; a null id has a shard too."""
    rest = docs.drop(*(c for c in docs.columns if c.lower() in ("shard", "slot")))
    return _apart(rest, lambda d: sharding.sharded(d).select(*d.columns, F.col("_shard").alias("shard"), F.col("_slot").alias("slot")))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", hash_tree_sharding),
]

#: Word-shingle components, a fitted classifier and slot checks have no DuckDB SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents; each but the last is written and read again as the next one's input.

    Rows with nulls in any column pass as their stages say; an empty table gives no rows; other columns are kept.
    """
    path = folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = staged(stage(spark, docs, sf_dir), f"{path}/stage{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
