"""Story summaries that are kept: sums per story, source and topic, added per batch and merged when read.

A page of stories is cut from a count and a time per story; sources and topics are
looked up for the stories of the page only, and no article is read. An article
that changes its topic adds a row of -1 for the old and of +1 for the new one;
its time still bounds the story, so times need no correction. What moves articles
between sources or out of stories (merging or deleting sources) asks for new
sums, by `summary_parts` of all members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storystream.plans.listings import STORY_LIMIT, STORY_LIMIT_MAX, summarise_parts
from storystream.session import materialize

_KEY = ("story_id", "source_id", "topic")


def summary_parts(members: DataFrame) -> DataFrame:
    """What members (story_id, source_id, topic, article_time) add to their stories."""
    return members.groupBy(*_KEY).agg(
        F.count("*").alias("n"), F.min("article_time").alias("lo"), F.max("article_time").alias("hi")
    )


def topic_corrections(members: DataFrame) -> DataFrame:
    """What members with another topic than before (old_topic) add; the others add nothing."""
    changed = members.filter(~F.col("old_topic").eqNullSafe(F.col("topic")))
    signed = F.explode(
        F.array(
            F.struct(F.col("old_topic").alias("topic"), F.lit(-1).alias("n")),
            F.struct(F.col("topic").alias("topic"), F.lit(1).alias("n")),
        )
    )
    rows = changed.select("story_id", "source_id", "article_time", signed.alias("part"))
    return rows.groupBy("story_id", "source_id", F.col("part.topic").alias("topic")).agg(
        F.sum("part.n").alias("n"), F.min("article_time").alias("lo"), F.max("article_time").alias("hi")
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """One row per story, source and topic; a topic that all articles left stays with n = 0, for its times."""
    return parts.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def kept_summaries(parts: DataFrame, stories: DataFrame, sources: DataFrame) -> DataFrame:
    """The summaries that `story_summaries` makes of all members."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    titles = stories.select(F.col("id").alias("story_id"), F.col("title").alias("story_title"))
    return summarise_parts(merge_parts(parts).join(titles, "story_id").join(names, "source_id"))


def list_kept_stories(
    parts: DataFrame,
    stories: DataFrame,
    sources: DataFrame,
    limit: int = STORY_LIMIT,
    offset: int = 0,
    at_least: int = 1,
) -> DataFrame:
    """The page that `list_stories` cuts from the summaries, with the total over all pages.

    Only a count and a time of each story are summed up and ranked; the page, at
    most STORY_LIMIT_MAX stories, is then summarised by itself.
    """
    sizes = parts.groupBy("story_id").agg(F.sum("n").alias("article_count"), F.max("hi").alias("latest"))
    kept = materialize(sizes.filter(F.col("article_count") >= at_least), "story-sizes")
    total = kept.select(F.count("*").alias("total"))
    page = materialize(
        kept.orderBy(F.col("latest").desc(), F.col("story_id").desc())
        .offset(offset)
        .limit(min(limit, STORY_LIMIT_MAX))
        .select("story_id"),
        "story-page",
    )
    # Both tables meet a page of bounded size, so neither is shuffled
    of_page = parts.join(F.broadcast(page), "story_id", "left_semi")
    titles = stories.join(F.broadcast(page), F.col("id") == page["story_id"], "left_semi")
    return (
        kept_summaries(of_page, titles, sources)
        .withColumn("total", total.scalar())
        .orderBy(F.col("latest_article_at").desc(), F.col("id").desc())
    )
