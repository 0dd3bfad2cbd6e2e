"""Feed documents in a landing folder, and the messages made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storystream.functions.text import (
    first_nonempty,
    html_text_full,
    is_present,
    is_valid_entry,
    iso_format,
    parse_published,
    strip,
)

# The feeds polled at the start
SEED_SOURCES = [
    ("TechCrunch", "https://techcrunch.com/feed/"),
    ("Ars Technica", "https://feeds.arstechnica.com/arstechnica/index"),
    ("The Verge", "https://www.theverge.com/rss/index.xml"),
    ("Hacker News (Front Page)", "https://hnrss.org/frontpage"),
]

POLL_INTERVAL = "10 minutes"

_TEXT = T.StringType()
_LINK = T.ArrayType(
    T.StructType([T.StructField("_href", _TEXT), T.StructField("_rel", _TEXT), T.StructField("_VALUE", _TEXT)])
)
_MARKED = T.StructType([T.StructField("_type", _TEXT), T.StructField("_VALUE", _TEXT)])
RSS_ITEM = T.StructType(
    [
        T.StructField(name, _TEXT)
        for name in ("title", "link", "description", "encoded", "pubDate", "date")
    ]
    + [T.StructField("guid", T.StructType([T.StructField("_isPermaLink", _TEXT), T.StructField("_VALUE", _TEXT)]))]
)
ATOM_ENTRY = T.StructType(
    [
        T.StructField("title", _MARKED),
        T.StructField("link", _LINK),
        T.StructField("summary", _MARKED),
        T.StructField("content", _MARKED),
        T.StructField("published", _TEXT),
        T.StructField("updated", _TEXT),
    ]
)


def seed_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_SOURCES, "name string, url string")


def _xml(spark: SparkSession, path: str, row: str, schema: T.StructType, stream: bool) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return (
        reader.format("xml")
        .option("rowTag", row)
        .option("ignoreNamespace", "true")
        .option("ignoreSurroundingSpaces", "false")
        .schema(schema)
        .load(path)
    )


def read_rss(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Entries of RSS documents: file, title, link, summary, published, updated.

    `guid` stands in for a missing link unless it says that it is none,
    `content:encoded` for a missing description; `dc:date` is when it was updated.
    """
    link, guid = F.col("link"), F.col("guid")
    permalink = F.lower(F.coalesce(guid["_isPermaLink"], F.lit("true"))) != "false"
    return _xml(spark, path, "item", RSS_ITEM, stream).select(
        F.col("_metadata.file_path").alias("file"),
        "title",
        F.coalesce(F.when(is_present(link), link), F.when(permalink, guid["_VALUE"])).alias("link"),
        F.coalesce("description", "encoded").alias("summary"),
        F.col("pubDate").alias("published"),
        F.col("date").alias("updated"),
    )


def read_atom(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Entries of Atom documents, with the same columns."""
    links = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return _xml(spark, path, "entry", ATOM_ENTRY, stream).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("title._VALUE").alias("title"),
        F.get(links, 0)["_href"].alias("link"),
        F.coalesce("summary._VALUE", "content._VALUE").alias("summary"),
        "published",
        "updated",
    )


def read_feeds(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Entries of all documents in the folder, RSS and Atom alike."""
    return read_rss(spark, path, stream).unionByName(read_atom(spark, path, stream))


def valid_entries(entries: DataFrame) -> DataFrame:
    return entries.filter(is_valid_entry(F.col("title"), F.col("link")))


def entry_messages(entries: DataFrame, source: Column, source_url: Column) -> DataFrame:
    """Raw messages of the valid entries, with the fields of `RAW_MESSAGE`."""
    return valid_entries(entries).select(
        source.alias("source"),
        source_url.alias("source_url"),
        strip(F.col("title")).alias("title"),
        strip(F.col("link")).alias("url"),
        iso_format(parse_published(F.col("published"), F.col("updated"))).alias("published_at"),
        html_text_full(first_nonempty(F.col("summary"))).alias("content"),
    )


def ingest_stats(entries: DataFrame) -> DataFrame:
    """Per source: entries read, messages made, entries left out.

    `skipped_duplicate` is always 0: repeats are found later, by url.
    """
    valid = is_valid_entry(F.col("title"), F.col("link"))
    return entries.groupBy("source").agg(
        F.count("*").alias("fetched"),
        F.count_if(valid).alias("inserted"),
        F.lit(0).cast("long").alias("skipped_duplicate"),
        F.count_if(~valid).alias("skipped_invalid"),
    )
