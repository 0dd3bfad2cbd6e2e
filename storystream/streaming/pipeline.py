"""The jobs as streams: feeds -> raw messages -> articles -> topics, entities, stories.

A batch is written as one partition `batch=<id>` of every table it adds to, and
reads only earlier batches. Running a batch again therefore replaces what the
failed run left behind, and the result does not depend on how the messages
were cut into batches. Nothing is dropped for being late: a late article still
meets the candidates of its own time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from storystream import schema
from storystream.functions.text import article_time, html_text
from storystream.operators import enrich, entities, ingest, stories
from storystream.plans import kept
from storystream.plans.listings import STORY_LIMIT
from storystream.session import materialize
from storystream.sources import feeds, messages

TABLES = {
    "articles": schema.ARTICLES,
    "sources": T.StructType(schema.SOURCES.fields[:3]),
    "enrichments": schema.ENRICHMENTS,
    "entities": schema.ENTITIES,
    "article_entities": schema.ARTICLE_ENTITIES,
    "stories": schema.STORIES,
    "story_articles": schema.STORY_ARTICLES,
    "summary_parts": schema.SUMMARY_PARTS,
    # The newest date of each batch
    "marks": T.StructType([T.StructField("newest", T.TimestampType())]),
}


@dataclass
class Store:
    """Tables below a folder that all executors can reach."""

    spark: SparkSession
    root: str

    def _batches(self, name: str, before: int | None) -> DataFrame:
        columns = T.StructType([*TABLES[name].fields, T.StructField("batch", T.LongType())])
        try:
            rows = self.spark.read.schema(columns).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], columns)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before one."""
        return self._batches(name, before).drop("batch")

    def write(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def articles_by_batch(self) -> DataFrame:
        return self._batches("articles", None)

    def replace_articles(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").partitionBy("batch").parquet(f"{self.root}/articles")

    def enrichments(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """Each article's last enrichment; with `of` (article_id), of those only, chosen before any are grouped."""
        last = self._batches("enrichments", before)
        if of is not None:
            last = last.join(of, "article_id", "left_semi")
        return last.groupBy("article_id").agg(F.max_by(F.struct("topic", "embedding"), "batch").alias("e")).select(
            "article_id", "e.*"
        )

    def stories(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """Each story's last state, or those of `of` (id): a story's count only grows, so the highest is the last."""
        columns = [f.name for f in schema.STORIES.fields if f.name != "id"]
        rows = self.read("stories", before)
        if of is not None:
            rows = rows.join(of, "id", "left_semi")
        last = rows.groupBy("id").agg(F.max_by(F.struct(*columns), "article_count").alias("s"))
        return last.select("id", "s.*")

    def list_stories(self, limit: int = STORY_LIMIT, offset: int = 0, at_least: int = 1) -> DataFrame:
        """A page of stories, from the sums that the batches added; no article is read."""
        return kept.list_kept_stories(
            self.read("summary_parts"), self.stories(), self.read("sources"), limit, offset, at_least
        )


@dataclass
class Models:
    """What enrichment takes from outside; None means the built-in form."""

    make_encoder: Callable | None = None
    embeddings: DataFrame | None = None  # url, embedding: used when there is no encoder
    make_extractor: Callable | None = None
    gazetteer: DataFrame | None = None  # id, name, type: used when there is no extractor
    threshold: float = stories.STORY_THRESHOLD


def ingest_batch(store: Store, batch: DataFrame, number: int, retention_hours: int | None = None) -> DataFrame:
    """Write the batch's articles, sources and rejects; returns its processed messages.

    With `retention_hours`, urls are looked up only among articles of that many
    hours before the newest one of earlier batches, so that a batch does not read
    the urls of all history. Messages from before go into quarantine as late. A
    copy of an older article that bears a new date is then an article of its own.
    """
    decoded = messages.decode_raw(messages.with_arrival(batch))
    articles = store.read("articles", number)
    known, late = None, None
    newest = None
    if retention_hours is not None:
        newest = store.read("marks", number).agg(F.max("newest")).first()[0]
    if newest is not None:
        oldest = F.lit(newest - timedelta(hours=retention_hours))
        decoded, late = ingest.split_late(decoded, oldest)
        undated = F.col("published_at").isNull() & (F.col("created_at") >= oldest)
        known = articles.filter((F.col("published_at") >= oldest) | undated)
    found = ingest.ingest_articles(decoded, articles, store.read("sources", number), known_urls=known)
    quarantine = found.quarantine if late is None else found.quarantine.unionByName(late)
    articles = materialize(found.articles.select(*[f.name for f in schema.ARTICLES.fields]), "articles")
    store.write("articles", articles, number)
    store.write("sources", found.sources, number)
    store.write("marks", articles.agg(F.max("published_at").alias("newest")), number)
    store.write("quarantine", quarantine.select("value", "reason"), number)
    return messages.processed_messages(articles)


def enrich_batch(store: Store, batch: DataFrame, number: int, models: Models | None = None) -> None:
    """Enrich the articles that processed messages name, and write what that adds.

    Topic, entities and stories come from the same articles independently; an
    article without a usable embedding gets no story but keeps the rest.
    """
    models = models or Models()
    named = materialize(messages.decode_processed(batch), "named")
    ids = named.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()

    def in_range(table: str, column: str, before: int | None = None) -> DataFrame:
        """Ids grow from batch to batch, so a range of them reads few files of a table."""
        lo, hi = (F.lit(ids[end]).cast("long") for end in ("lo", "hi"))
        return store.read(table, before).filter(F.col(column).between(lo, hi))

    found, missing = enrich.processed_articles(named, in_range("articles", "id"))
    articles = enrich.with_topic(found)
    if models.make_encoder:
        articles = enrich.embed_articles(articles, models.make_encoder)
    elif models.embeddings is not None:
        articles = articles.join(models.embeddings.select("url", "embedding"), "url", "left")
    else:
        articles = articles.withColumn("embedding", F.lit(None).cast("array<double>"))
    articles = materialize(articles, "enriched")

    # A repeated message enriches its article again; the last row of an article counts
    store.write(
        "enrichments",
        articles.select(F.col("id").alias("article_id"), "topic", F.col("embedding").cast("array<double>").alias("embedding")),
        number,
    )
    mentions = materialize(enrich.mentions(articles, models.make_extractor, models.gazetteer), "mentions")
    links = in_range("article_entities", "article_id", number)
    new, linked = entities.link_entities(mentions, store.read("entities", number), links)
    store.write("entities", new, number)
    store.write("article_entities", linked, number)
    store.write("missing", missing, number)
    _assign(store, articles, number, models)
    _keep_summaries(store, articles, number)


def _keep_summaries(store: Store, articles: DataFrame, number: int) -> None:
    """What the batch adds to the summaries: its new members, and known ones that have another topic now."""
    time = article_time(F.col("published_at"), F.col("created_at"))
    batch = articles.select(F.col("id").alias("article_id"), "source_id", "topic", time.alias("article_time"))
    added = store.read("story_articles", number + 1).join(batch, "article_id")
    known = store.read("story_articles", number).join(batch.select("article_id"), "article_id", "left_semi")
    known = materialize(known.select("article_id", "story_id"), "known-members")
    before = store.enrichments(number, known.select("article_id")).select("article_id", F.col("topic").alias("old_topic"))
    new = kept.summary_parts(added.join(known, "article_id", "left_anti"))
    corrected = kept.topic_corrections(known.join(batch, "article_id").join(before, "article_id"))
    store.write("summary_parts", new.unionByName(corrected).select(*schema.SUMMARY_PARTS.names), number)


def _assign(store: Store, articles: DataFrame, number: int, models: Models) -> None:
    """Link the batch's articles to earlier ones within the window, and add to the stories they join."""
    time = article_time(F.col("published_at"), F.col("created_at"))
    span = articles.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first()
    reach = F.make_dt_interval(hours=F.lit(stories.WINDOW_HOURS))
    lo, hi = (F.lit(span[end]).cast("timestamp") for end in ("lo", "hi"))
    columns = ["id", "published_at", "created_at", "embedding"]
    # The articles of the window first: only their enrichments are grouped, not those of all history
    around = (
        store.read("articles", number)
        .filter(time.between(lo - reach, hi + reach))
        .join(articles.select("id"), "id", "left_anti")
        .select("id", "published_at", "created_at")
    )
    around = materialize(around, "around")
    enriched = store.enrichments(number, around.select(F.col("id").alias("article_id")))
    earlier = around.join(enriched.withColumnRenamed("article_id", "id"), "id").select(*columns)
    members = store.read("story_articles", number)
    window = materialize(earlier.unionByName(articles.select(*columns)), "window")
    known = members.join(window.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    found = stories.assign_stories(window, known, models.threshold)
    added = materialize(found.members.filter("status <> 'existing'"), "members")
    store.write("story_articles", added.select("story_id", "article_id", "similarity"), number)

    old = materialize(store.stories(number, added.select(F.col("story_id").alias("id"))), "known-stories")
    states = stories.story_states(added, articles, old)
    titles = articles.select("id", F.col("title").alias("seed_title"))
    store.write(
        "stories",
        states.join(titles, "id", "left").join(old.select("id", F.col("title").alias("old_title")), "id", "left").select(
            "id",
            F.coalesce("old_title", "seed_title").alias("title"),
            F.lit(None).cast("string").alias("summary"),
            F.lit(None).cast("double").alias("importance_score"),
            "centroid",
            "article_count",
            "first_at",
            "newest_at",
        ),
        number,
    )
    store.write("rejected", stories.rejected_articles(articles), number)


def _start(stream: DataFrame, batch_job, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(batch_job)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def start_feeds(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    format: str = "kafka",
    path: str | None = None,
    trigger: dict | None = None,
    **options: str,
) -> StreamingQuery:
    """Feed documents that land in `landing/source=<name>/` become raw messages."""
    entries = feeds.read_feeds(spark, landing, stream=True)
    name = F.url_decode(F.regexp_extract("file", r"/source=([^/]+)/", 1))
    known = feeds.seed_sources(spark).select(F.col("name").alias("source"), F.col("url").alias("feed_url"))
    sent = entries.withColumn("source", name).join(known, "source", "left")
    raw = messages.raw_messages(feeds.entry_messages(sent, F.col("source"), F.col("feed_url")))

    def write(batch: DataFrame, number: int) -> None:
        messages.write_topic(batch, format, path, number, **options)

    return _start(raw, write, checkpoint, trigger or {"processingTime": feeds.POLL_INTERVAL})


def start_ingest(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    format: str = "kafka",
    path: str | None = None,
    trigger: dict | None = None,
    retention_hours: int | None = None,
    **options: str,
) -> StreamingQuery:
    """Raw messages become articles; those that are no duplicate are sent on. For `retention_hours` see `ingest_batch`."""

    def job(batch: DataFrame, number: int) -> None:
        sent = ingest_batch(Store(batch.sparkSession, root), batch, number, retention_hours)
        messages.write_topic(sent, format, path, number, **options)

    return _start(stream, job, checkpoint, trigger or {"processingTime": "1 minute"})


def start_enrich(
    stream: DataFrame, root: str, checkpoint: str, models: Models | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Processed messages become topics, entities and stories."""

    def job(batch: DataFrame, number: int) -> None:
        enrich_batch(Store(batch.sparkSession, root), batch, number, models)

    return _start(stream, job, checkpoint, trigger or {"processingTime": "1 minute"})


def republish(store: Store, format: str = "kafka", path: str | None = None, **options: str) -> None:
    """Send every article, duplicates included, through enrichment again."""
    messages.write_topic(messages.republished(store.read("articles")), format, path, **options)


def clean_and_republish(store: Store, format: str = "kafka", path: str | None = None, **options: str) -> None:
    """Take the markup out of every article, then send it through enrichment again.

    The articles keep their batches and are replaced, from a copy written before,
    ahead of the first message, so that enrichment meets none that is not cleaned.
    """
    articles = store.articles_by_batch()
    store.replace_articles(materialize(articles.withColumn("content", html_text(F.col("content"))), "cleaned"))
    republish(store, format, path, **options)
