"""From raw documents to training shards: the stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storystream.llm import decontam, minhash, mixing, sharding, toxicity
from storystream.session import materialize

#: Two sets at a similarity of 0.8 share none of the bands with probability (1 - 0.8**6)**33 < 5e-5
NEAR_BANDS, NEAR_BAND_ROWS = 33, 6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learned from the labelled ones that are not held out."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five words, a similarity of 0.8 or more."""
    return minhash.deduplicate(docs, percent=80, bands=NEAR_BANDS, band_rows=NEAR_BAND_ROWS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage within the edit budget of a benchmark item."""
    return decontam.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budgets of domains, languages and sources pay for, each once."""
    return mixing.mix_documents(docs, epochs=1)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]

# Word lists learned from labels, sets of hashed shingles and edit distances are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
