"""Queries over articles and stories: pages, summaries, details, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storystream.functions.text import article_time
from storystream.functions.topics import UNCATEGORIZED
from storystream.session import materialize

ARTICLE_LIMIT = 50
ARTICLE_LIMIT_MAX = 200
STORY_LIMIT = 20
STORY_LIMIT_MAX = 100


def with_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with their nested source; an article without one is kept."""
    nested = sources.select(F.col("id").alias("source_id"), F.struct("id", "name", "url").alias("source"))
    return articles.join(nested, "source_id", "left").select(
        "id", "title", "url", "published_at", "created_at", "source"
    )


def title_search(articles: DataFrame, q: str | None) -> DataFrame:
    """Titles containing `q` in any case; `%` and `_` in it are wildcards."""
    return articles.filter(F.col("title").ilike(f"%{q}%")) if q else articles


def list_articles(
    articles: DataFrame, sources: DataFrame, q: str | None = None, limit: int = ARTICLE_LIMIT, offset: int = 0
) -> DataFrame:
    """A page of articles, latest first, undated ones last.

    The page is cut before the join, so only its rows look up a source.
    """
    if limit > ARTICLE_LIMIT_MAX:
        raise ValueError(f"limit must be at most {ARTICLE_LIMIT_MAX}")
    page = (
        title_search(articles, q)
        .select("id", "source_id", "title", "url", "published_at", "created_at")
        .orderBy(F.col("published_at").desc_nulls_last(), "id")
        .offset(offset)
        .limit(limit)
    )
    return with_source(page, sources).orderBy(F.col("published_at").desc_nulls_last(), "id")


def article_by_id(articles: DataFrame, sources: DataFrame, article_id: int) -> DataFrame:
    return with_source(articles.filter(F.col("id") == article_id), sources)


def story_members(stories: DataFrame, members: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per member: its story, article and source."""
    a = articles.select(
        F.col("id").alias("article_id"),
        "source_id",
        F.col("title").alias("article_title"),
        "url",
        "published_at",
        "created_at",
        "topic",
        article_time(F.col("published_at"), F.col("created_at")).alias("article_time"),
    )
    s = stories.select(F.col("id").alias("story_id"), F.col("title").alias("story_title"))
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return (
        members.select("story_id", "article_id", "similarity")
        .join(a, "article_id")
        .join(s, "story_id")
        .join(names, "source_id")
    )


def story_summaries(joined: DataFrame) -> DataFrame:
    """One row per story from `story_members`.

    Members are first summed per story, source and topic; the second step sees
    at most sources x topics rows of a story, however many articles it has.
    The topic is the most common one other than Uncategorized, ties to the
    smallest name.
    """
    parts = joined.groupBy("story_id", "story_title", "source_id", "source_name", "topic").agg(
        F.count("*").alias("n"), F.min("article_time").alias("lo"), F.max("article_time").alias("hi")
    )
    return summarise_parts(parts)


def summarise_parts(parts: DataFrame) -> DataFrame:
    """One row per story from sums (n, lo, hi) per story, source and topic; sums of 0 are no vote for their topic."""
    votes = F.when(F.col("topic") != UNCATEGORIZED, F.col("topic"))
    topics = parts.groupBy("story_id", "story_title", votes.alias("vote")).agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.collect_set("source_id").alias("source_ids"),
        F.collect_set("source_name").alias("names"),
    )
    ballot = F.when(F.col("vote").isNotNull() & (F.col("n") > 0), F.struct((-F.col("n")).alias("minus_n"), "vote"))
    return topics.groupBy(F.col("story_id").alias("id"), F.col("story_title").alias("title")).agg(
        F.sum("n").alias("article_count"),
        F.size(F.array_distinct(F.flatten(F.collect_list("source_ids")))).cast("long").alias("source_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("source_names"),
        F.min("lo").alias("first_article_at"),
        F.max("hi").alias("latest_article_at"),
        F.coalesce(F.min(ballot)["vote"], F.lit(UNCATEGORIZED)).alias("topic"),
    )


def story_newest(joined: DataFrame) -> DataFrame:
    return joined.groupBy("story_id").agg(F.max("article_time").alias("newest_at"))


def min_articles(summaries: DataFrame, at_least: int = 1) -> DataFrame:
    return summaries.filter(F.col("article_count") >= at_least)


def list_stories(
    summaries: DataFrame, limit: int = STORY_LIMIT, offset: int = 0, at_least: int = 1
) -> DataFrame:
    """A page of stories, latest first, each row with the total over all pages.

    The page and the total read the same summaries, which are written down so
    that the members are joined and summed once.
    """
    kept = materialize(min_articles(summaries, at_least), "summaries")
    total = kept.select(F.count("*").alias("total"))
    return (
        kept.orderBy(F.col("latest_article_at").desc(), F.col("id").desc())
        .offset(offset)
        .limit(min(limit, STORY_LIMIT_MAX))
        .withColumn("total", total.scalar())
    )


def story_page(summaries: DataFrame, limit: int = STORY_LIMIT, offset: int = 0, at_least: int = 1) -> DataFrame:
    """The page as one row: total, limit, offset, items; past the end, items are empty."""
    kept = materialize(min_articles(summaries, at_least), "summaries")
    limit = min(limit, STORY_LIMIT_MAX)
    total = kept.select(F.count("*").alias("total"))
    page = kept.orderBy(F.col("latest_article_at").desc(), F.col("id").desc()).offset(offset).limit(limit)
    order = F.struct((-F.unix_micros(F.col("latest_article_at").cast("timestamp"))), -F.col("id"))
    items = page.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(order.alias("order"), F.struct(*summaries.columns).alias("item")))),
            lambda x: x["item"],
        ).alias("items")
    )
    return items.select(
        total.scalar().alias("total"), F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), "items"
    )


def story_timeline(joined: DataFrame, story_id: int | None = None) -> DataFrame:
    """Members in time order."""
    rows = joined if story_id is None else joined.filter(F.col("story_id") == story_id)
    return rows.select(
        "story_id",
        F.col("article_id").alias("id"),
        F.col("article_title").alias("title"),
        "url",
        "source_name",
        "published_at",
        "created_at",
        "similarity",
        "article_time",
    ).orderBy("article_time", "id")


def story_detail(joined: DataFrame, story_id: int) -> DataFrame:
    """One story's summary beside each of its members, in time order; no row if there is none.

    Members stay rows: a story may be too large for one nested value.
    """
    one = joined.filter(F.col("story_id") == story_id)
    summary = story_summaries(one).withColumnsRenamed({"id": "story_id", "title": "story_title"})
    return (
        summary.join(story_timeline(one), "story_id")
        .withColumnsRenamed({"id": "article_id", "title": "article_title"})
        .orderBy("article_time", "article_id")
    )


def stories_by_size(members: DataFrame, at_least: int = 2) -> DataFrame:
    """Stories of some size, largest first."""
    return (
        members.groupBy("story_id")
        .agg(F.count("*").alias("size"))
        .filter(F.col("size") >= at_least)
        .orderBy(F.col("size").desc(), "story_id")
    )


def top_stories(members: DataFrame, limit: int, at_least: int = 2) -> DataFrame:
    """The largest stories with their rank; only `limit` rows meet in the ranking task."""
    ranked = Window.partitionBy(F.lit(0)).orderBy(F.col("size").desc(), "story_id")
    return stories_by_size(members, at_least).limit(limit).withColumn("rank", F.row_number().over(ranked))


def story_report(joined: DataFrame, at_least: int = 2) -> DataFrame:
    """Members of every story of some size, largest story first.

    Sizes are counted on the memberships and joined back, so no story is
    gathered in one task.
    """
    sizes = stories_by_size(joined.select("story_id"), at_least)
    return (
        joined.join(sizes, "story_id")
        .select(
            "story_id",
            "size",
            "article_id",
            "similarity",
            F.col("source_name").alias("source"),
            F.col("article_title").alias("title"),
            "article_time",
        )
        .orderBy(F.col("size").desc(), "story_id", "article_time", "article_id")
    )
