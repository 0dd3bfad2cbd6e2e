"""Table and message schemas."""

from pyspark.sql import types as T

SOURCES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

ARTICLES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("duplicate_of_id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# What enrichment adds to an article, kept beside it so that articles stay append-only
ENRICHMENTS = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        T.StructField("topic", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
    ]
)

ENTITIES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
    ]
)

ARTICLE_ENTITIES = T.StructType(
    [T.StructField("article_id", T.LongType()), T.StructField("entity_id", T.LongType())]
)

# `newest_at` and `first_at` are derivable from the members; keeping them beside the
# centroid saves a join of all members for every batch
STORIES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("importance_score", T.DoubleType()),
        T.StructField("centroid", T.ArrayType(T.DoubleType())),
        T.StructField("article_count", T.LongType()),
        T.StructField("first_at", T.TimestampType()),
        T.StructField("newest_at", T.TimestampType()),
    ]
)

STORY_ARTICLES = T.StructType(
    [
        T.StructField("story_id", T.LongType()),
        T.StructField("article_id", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)

# What a batch adds to the sums that story pages are made of
SUMMARY_PARTS = T.StructType(
    [
        T.StructField("story_id", T.LongType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("topic", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("lo", T.TimestampType()),
        T.StructField("hi", T.TimestampType()),
    ]
)

RAW_MESSAGE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("source", "source_url", "title", "url", "published_at", "content")
    ]
)

PROCESSED_MESSAGE = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("url", T.StringType())]
)
