"""Jobs that repair whole tables. Each returns its result; writing is separate."""

from __future__ import annotations

from functools import reduce

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storystream.functions.text import html_text_full
from storystream.operators.enrich import with_topic

NONE = "(none)"
SAMPLE_SIZE = 20
SAMPLE_SEED = 42


@dataclass
class Merged:
    sources: DataFrame
    articles: DataFrame
    deleted: DataFrame  # id, reason


def changed_topics(classified: DataFrame) -> DataFrame:
    """Rows whose `new_topic` differs from `topic`, NULL being a value."""
    return classified.filter(~F.col("topic").eqNullSafe(F.col("new_topic")))


def topic_before_after(classified: DataFrame) -> DataFrame:
    """Articles per topic before and after, most frequent afterwards first."""
    before = classified.groupBy(F.coalesce("topic", F.lit(NONE)).alias("topic")).agg(F.count("*").alias("before"))
    after = classified.groupBy(F.col("new_topic").alias("topic")).agg(F.count("*").alias("after"))
    counts = before.join(after, "topic", "full").select(
        "topic",
        F.coalesce("before", F.lit(0)).alias("before"),
        F.coalesce("after", F.lit(0)).alias("after"),
    )
    return counts.withColumn("change", F.col("after") - F.col("before")).orderBy(F.col("after").desc(), "topic")


def reclassify(articles: DataFrame) -> DataFrame:
    """Articles with `new_topic` beside the stored `topic`."""
    renamed = articles.withColumnRenamed("topic", "old_topic")
    return with_topic(renamed).withColumnsRenamed({"topic": "new_topic", "old_topic": "topic"})


def update_topic(classified: DataFrame) -> DataFrame:
    return classified.withColumn("topic", F.col("new_topic")).drop("new_topic")


def changed_sample(classified: DataFrame, size: int = SAMPLE_SIZE, seed: int = SAMPLE_SEED) -> DataFrame:
    """A reproducible sample of the changed articles, in id order."""
    drawn = changed_topics(classified).select("id", "title", "topic", "new_topic")
    draw = F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col("id").cast("string")))
    return drawn.orderBy(draw, "id").limit(size).orderBy("id")


def clean_articles(articles: DataFrame, to_text=html_text_full) -> DataFrame:
    """Articles with markup taken out of their content."""
    return articles.withColumn("content", to_text(F.col("content")))


def counts_by_name(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """Source rows and articles per name; sources without articles count.

    Articles are counted per source id before they meet the names.
    """
    per_source = articles.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))
    return (
        sources.join(per_source, "id", "left")
        .groupBy("name")
        .agg(F.count("id").alias("source_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("articles"))
    )


def distinct_names(sources: DataFrame) -> DataFrame:
    return sources.select("name").distinct()


def canonical_sources(sources: DataFrame) -> DataFrame:
    """Every source id with the id its name keeps, the lowest."""
    kept = sources.groupBy("name").agg(F.min("id").alias("keep_id"))
    return sources.select("id", "name").join(kept, "name")


def orphan_sources(sources: DataFrame, articles: DataFrame) -> DataFrame:
    used = articles.filter(F.col("source_id").isNotNull()).select(F.col("source_id").alias("id"))
    return sources.join(used, "id", "left_anti")


def repoint_articles(articles: DataFrame, canonical: DataFrame) -> DataFrame:
    """Articles of a source that is merged away, moved to the one that is kept."""
    moved = canonical.select(F.col("id").alias("source_id"), "keep_id")
    return articles.join(moved, "source_id", "left").withColumn(
        "source_id", F.coalesce("keep_id", "source_id")
    ).drop("keep_id")


def merge_sources(sources: DataFrame, articles: DataFrame, seeds: DataFrame) -> Merged:
    """One source per name, with the seed's url where the name is a seed; empty ones go."""
    canonical = canonical_sources(sources)
    repointed = repoint_articles(articles, canonical)
    feed = seeds.select("name", F.col("url").alias("feed_url"))
    kept = (
        sources.join(canonical.filter("id = keep_id").select("id"), "id", "left_semi")
        .join(feed, "name", "left")
        .withColumn("url", F.coalesce("feed_url", "url"))
        .select(*sources.columns)
    )
    orphans = orphan_sources(kept, repointed).select("id")
    merged = canonical.filter("id <> keep_id").select("id", F.lit("merged").alias("reason"))
    deleted = merged.unionByName(orphans.select("id", F.lit("no articles").alias("reason")))
    return Merged(kept.join(orphans, "id", "left_anti"), repointed, deleted)


def merge_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Source rows and articles per name before and after; a name may be on one side only."""
    def side(counts: DataFrame, suffix: str) -> DataFrame:
        return counts.withColumnsRenamed({c: f"{c}_{suffix}" for c in ("source_rows", "articles")})

    joined = side(before, "before").join(side(after, "after"), "name", "full")
    return joined.fillna(0, [c for c in joined.columns if c != "name"]).orderBy("name")


def repeated_keys(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Violations of a unique constraint."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return (
        df.groupBy(key.alias("value"))
        .agg(F.count("*").alias("rows"))
        .filter("rows > 1")
        .select(F.lit(f"{table} unique {', '.join(columns)}").alias("constraint"), "value", "rows")
    )


def missing_parents(df: DataFrame, table: str, column: str, parents: DataFrame, key: Column | str = "id") -> DataFrame:
    """Violations of a foreign key."""
    parent_keys = parents.select(F.col(key).alias(column)) if isinstance(key, str) else parents.select(key.alias(column))
    return (
        df.filter(F.col(column).isNotNull())
        .join(parent_keys, column, "left_anti")
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("rows"))
        .select(F.lit(f"{table} foreign key {column}").alias("constraint"), "value", "rows")
    )


# The keys of the stored tables, and where foreign keys point
UNIQUE_KEYS = [
    ("sources", ["url"]),
    ("articles", ["url"]),
    ("article_entities", ["article_id", "entity_id"]),
    ("story_articles", ["article_id"]),
]
FOREIGN_KEYS = [
    ("articles", "source_id", "sources"),
    ("articles", "duplicate_of_id", "articles"),
    ("article_entities", "article_id", "articles"),
    ("article_entities", "entity_id", "entities"),
    ("story_articles", "story_id", "stories"),
    ("story_articles", "article_id", "articles"),
]


def constraint_check(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of all keys: constraint, value, number of rows."""
    found = [repeated_keys(tables[table], table, columns) for table, columns in UNIQUE_KEYS]
    found += [missing_parents(tables[table], table, column, tables[parent]) for table, column, parent in FOREIGN_KEYS]
    return reduce(DataFrame.unionByName, found)


def apply(tables: dict[str, DataFrame], folder: str) -> None:
    """Write a job's tables as a new snapshot; leaving this out is the dry run."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
