"""Raw messages to articles: check, source, repeated URL, repeated title."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storystream.functions.text import is_valid_payload, parse_iso, placeholder_url, strip
from storystream.operators.numbering import with_sequence
from storystream.operators.titles import DUPLICATE_THRESHOLD, WINDOW_HOURS, title_duplicates
from storystream.session import materialize


@dataclass
class Ingested:
    """What a set of messages adds; nothing is written."""

    articles: DataFrame
    sources: DataFrame
    quarantine: DataFrame  # arrival, value, reason
    repeated_urls: DataFrame  # arrival, url

    @property
    def processed(self) -> DataFrame:
        """Articles that go on to enrichment: those that are no duplicate."""
        return self.articles.filter("duplicate_of_id IS NULL").select("id", "url")


def split_payloads(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable payloads, and the rest with a reason; `messages` has arrival, value, payload."""
    payload = F.col("payload")
    # A filter moves below the decoding and repeats it for every use of the payload, so each uses it once
    of_payload = lambda test: F.transform(F.array(payload), test)[0]
    complete = lambda p: is_valid_payload(p["source"], p["title"], p["url"])
    valid = messages.filter(of_payload(lambda p: p.isNotNull() & complete(p))).select("arrival", "payload.*")
    rejected = messages.filter(of_payload(lambda p: p.isNull() | ~complete(p))).select(
        "arrival", "value", F.when(payload.isNotNull(), "missing field").otherwise("unreadable").alias("reason")
    )
    return valid, rejected


def split_late(messages: DataFrame, oldest: Column) -> tuple[DataFrame, DataFrame]:
    """Messages in time, and the usable ones from before `oldest`; without a date a message is never late."""
    payload = F.col("payload")
    usable = payload.isNotNull() & is_valid_payload(payload["source"], payload["title"], payload["url"])
    late = F.coalesce(usable & (parse_iso(payload["published_at"]) < oldest), F.lit(False))
    return messages.filter(~late), messages.filter(late).select("arrival", "value", F.lit("late").alias("reason"))


def first_url_wins(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """First arrival of each url that is not known yet.

    The minimum is combined before the shuffle and joined back by arrival, so
    the copies of one url never meet in one task.
    """
    first = rows.groupBy("url").agg(F.min("arrival").alias("arrival"))
    if known is not None:
        # The large table is first cut down to the urls at hand, which is a broadcast of
        # those urls when they are few, and only then subtracted
        repeated = known.select("url").join(first.select("url"), "url", "left_semi")
        first = first.join(repeated, "url", "left_anti")
    return rows.join(first.select("arrival"), "arrival", "left_semi")


def upsert_sources(sources: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sources to add for names not known yet; `incoming` has source, source_url, arrival."""
    first = incoming.groupBy("source").agg(F.min(F.struct("arrival", "source_url")).alias("first"))
    new = first.join(sources, first["source"] == sources["name"], "left_anti")
    next_id = (sources.agg(F.max("id")).first()[0] or 0) + 1
    return with_sequence(
        new.select(
            F.col("source").alias("name"),
            placeholder_url(F.col("first.source_url"), F.col("source")).alias("url"),
            F.col("first.arrival").alias("arrival"),
        ),
        ["arrival", "name"],
        "id",
        next_id,
    ).select("id", "name", "url")


def source_ids(sources: DataFrame) -> DataFrame:
    """The source a name stands for: the one with the lowest id."""
    return sources.groupBy("name").agg(F.min("id").alias("source_id"))


def ingest_articles(
    messages: DataFrame,
    articles: DataFrame,
    sources: DataFrame,
    hours: int = WINDOW_HOURS,
    threshold: float = DUPLICATE_THRESHOLD,
    known_urls: DataFrame | None = None,
) -> Ingested:
    """Articles, sources and rejects from messages in order of arrival.

    `messages` has arrival, value and payload. Title candidates are the
    articles there are and those of these messages that arrived before. Urls
    are looked up in `known_urls`, which is all articles unless given.
    """
    valid, quarantine = split_payloads(messages)
    # What decides is decoded and written once; contents, by far the most of a message, are decoded, shuffled and
    # written only for what becomes an article
    heads = materialize(
        valid.select(
            "arrival", "source", "source_url", "published_at", *[strip(F.col(c)).alias(c) for c in ("url", "title")]
        ),
        "heads",
    )
    fresh = materialize(first_url_wins(heads, articles if known_urls is None else known_urls), "fresh")
    repeated = heads.join(fresh.select("arrival"), "arrival", "left_anti").select("arrival", "url")

    new_sources = upsert_sources(sources, heads)
    ids = source_ids(sources.select("id", "name").unionByName(new_sources.select("id", "name")))
    next_id = (articles.agg(F.max("id")).first()[0] or 0) + 1
    numbered = with_sequence(fresh, ["arrival"], "id", next_id)
    inserted = materialize(
        numbered.join(ids, F.col("source") == ids["name"])
        .join(valid.select("arrival", "content"), "arrival")
        .select(
            "id",
            "source_id",
            "title",
            "content",
            "url",
            parse_iso(F.col("published_at")).alias("published_at"),
            F.current_timestamp().alias("created_at"),
        ),
        "inserted",
    )
    columns = ["id", "title", "published_at"]
    # Only articles whose time can match are read; without a date in the batch there are none
    span = inserted.agg(
        (F.min("published_at") - F.make_dt_interval(hours=F.lit(hours))).alias("lo"),
        (F.max("published_at") + F.make_dt_interval(hours=F.lit(hours))).alias("hi"),
    ).first()
    lo, hi = (F.lit(span[end]).cast("timestamp") for end in ("lo", "hi"))
    candidates = articles.select(*columns).filter(F.col("published_at").between(lo, hi))
    duplicates = title_duplicates(
        candidates.unionByName(inserted.select(*columns)), hours, threshold, F.col("id") >= next_id
    )
    return Ingested(
        inserted.join(duplicates, "id", "left").withColumnRenamed("score", "duplicate_score"),
        new_sources,
        quarantine,
        repeated,
    )
