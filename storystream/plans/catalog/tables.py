"""Queries of scans, joins, aggregates and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from storystream.operators.entities import mention_counts
from storystream.operators.enrich import processed_articles
from storystream.operators.ingest import first_url_wins, source_ids
from storystream.operators.nearest import nearest_stories
from storystream.operators.stories import (
    cluster_size_report,
    compared_members,
    status_counts,
    story_centroids,
    threshold_compare,
)
from storystream.plans import fixtures as fx
from storystream.plans import kept, listings, maintenance
from storystream.plans.catalog.registry import query
from storystream.session import materialize
from storystream.sources import messages


@query("table_scan", "SELECT id, source_id, title, url, published_at FROM articles_fx")
def table_scan(spark, sf_dir):
    return fx.articles(spark, sf_dir).select("id", "source_id", "title", "url", "published_at")


@query(
    "embedded_articles_scan",
    """SELECT a.id, a.title, s.name AS source, a.published_at, len(v.v) AS dimensions
       FROM articles_fx a JOIN sources_fx s ON s.id = a.source_id JOIN vectors_fx v ON v.id = a.id
       WHERE a.published_at IS NOT NULL""",
)
def embedded_articles(spark, sf_dir):
    sources = fx.sources(spark, sf_dir).select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return (
        fx.embedded_articles(spark, sf_dir)
        .filter(F.col("published_at").isNotNull() & F.col("embedding").isNotNull())
        .join(sources, "source_id")
        .select("id", "title", "source", "published_at", F.size("embedding").cast("long").alias("dimensions"))
        .orderBy("published_at", "id")
    )


@query(
    "dated_filter",
    "SELECT count(*) AS articles, count(published_at) AS dated, count(v.id) AS embedded FROM articles_fx a LEFT JOIN vectors_fx v ON v.id = a.id",
)
def dated_filter(spark, sf_dir):
    rows = fx.articles(spark, sf_dir).join(fx.vectors(spark, sf_dir), "id", "left")
    return rows.agg(
        F.count("*").alias("articles"),
        F.count("published_at").alias("dated"),
        F.count("embedding").alias("embedded"),
    )


@query(
    "time_window_filter",
    """SELECT id, published_at FROM articles_fx WHERE published_at BETWEEN
       TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 6 HOUR AND TIMESTAMP '2024-01-02 12:00:00' + INTERVAL 6 HOUR""",
)
def time_window_filter(spark, sf_dir):
    moment = F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")
    reach = F.make_dt_interval(hours=F.lit(6))
    return (
        fx.articles(spark, sf_dir)
        .filter(F.col("published_at").between(moment - reach, moment + reach))
        .select("id", "published_at")
    )


@query("title_search", "SELECT id, title FROM articles_fx WHERE title ILIKE '%THE%of_%'")
def title_search(spark, sf_dir):
    return listings.title_search(fx.articles(spark, sf_dir), "THE%of_").select("id", "title")


_LISTED = """SELECT a.id, a.title, a.url, a.published_at, a.created_at, s.id AS source_id,
  s.name AS source_name, s.url AS source_url FROM articles_fx a LEFT JOIN sources_fx s ON s.id = a.source_id"""


def _flat(listed):
    return listed.select(
        "id",
        "title",
        "url",
        "published_at",
        "created_at",
        F.col("source.id").alias("source_id"),
        F.col("source.name").alias("source_name"),
        F.col("source.url").alias("source_url"),
    )


@query("article_by_id", _LISTED + " WHERE a.id = 42")
def article_by_id(spark, sf_dir):
    return _flat(listings.article_by_id(fx.articles(spark, sf_dir), fx.sources(spark, sf_dir), 42))


@query("article_listing_shape", _LISTED)
def article_listing_shape(spark, sf_dir):
    return _flat(listings.with_source(fx.articles(spark, sf_dir), fx.sources(spark, sf_dir)))


@query("article_source_eager", _LISTED.replace("sources_fx s", "(SELECT * FROM sources_fx WHERE id % 3 > 0) s"))
def article_source_eager(spark, sf_dir):
    """Articles whose source row is missing are kept."""
    sources = fx.sources(spark, sf_dir).filter("id % 3 > 0")
    return _flat(listings.with_source(fx.articles(spark, sf_dir), sources))


@query(
    "article_source",
    "SELECT a.id, a.title, s.name AS source FROM articles_fx a JOIN sources_fx s ON s.id = a.source_id",
)
def article_source(spark, sf_dir):
    sources = fx.sources(spark, sf_dir).select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return fx.articles(spark, sf_dir).join(sources, "source_id").select("id", "title", "source")


@query(
    "list_articles",
    _LISTED + " WHERE a.title ILIKE '%an%' ORDER BY a.published_at DESC NULLS LAST, a.id LIMIT 50 OFFSET 20",
)
def list_articles(spark, sf_dir):
    return _flat(
        listings.list_articles(fx.articles(spark, sf_dir), fx.sources(spark, sf_dir), q="an", offset=20)
    )


@query(
    "story_members",
    """SELECT story_id, story_title, article_id, round(similarity, 9) AS similarity, source_id, source_name,
       article_title, url, published_at, created_at, article_time, topic FROM joined_fx""",
)
def story_members(spark, sf_dir):
    return fx.joined_members(spark, sf_dir).withColumn("similarity", F.round("similarity", 9))


def _summaries(spark, sf_dir):
    return listings.story_summaries(fx.joined_members(spark, sf_dir))


def _joined_names(df):
    return df.withColumn("source_names", F.array_join("source_names", ","))


@query("story_summaries", "SELECT * FROM summaries_fx")
def story_summaries(spark, sf_dir):
    return _joined_names(_summaries(spark, sf_dir))


@query("min_articles", "SELECT id, article_count FROM summaries_fx WHERE article_count >= 3")
def min_articles(spark, sf_dir):
    return listings.min_articles(_summaries(spark, sf_dir), 3).select("id", "article_count")


_STORIES = """SELECT *, (SELECT count(*) FROM summaries_fx WHERE article_count >= 2) AS total FROM summaries_fx
       WHERE article_count >= 2 ORDER BY latest_article_at DESC, id DESC LIMIT 20 OFFSET 10"""


@query("list_stories", _STORIES)
def list_stories(spark, sf_dir):
    return _joined_names(listings.list_stories(_summaries(spark, sf_dir), offset=10, at_least=2))


def _kept_parts(spark, sf_dir):
    """Sums added by three batches, whose last corrects topics that were stored otherwise before."""
    rows = fx.joined_members(spark, sf_dir).select("story_id", "source_id", "topic", "article_time", "article_id")
    stored = F.when(F.col("article_id") % 5 == 0, F.lit("Business")).otherwise(F.col("topic"))
    rows = materialize(rows.withColumn("old_topic", stored), "members-to-keep")
    before = rows.withColumn("topic", F.col("old_topic"))
    batches = [kept.summary_parts(before.filter(F.col("article_id") % 2 == b)) for b in (0, 1)]
    return batches[0].unionByName(batches[1]).unionByName(kept.topic_corrections(rows))


@query("kept_summaries", "SELECT * FROM summaries_fx")
def kept_summaries(spark, sf_dir):
    parts = _kept_parts(spark, sf_dir)
    return _joined_names(kept.kept_summaries(parts, fx.stories(spark, sf_dir), fx.sources(spark, sf_dir)))


@query("list_kept_stories", _STORIES)
def list_kept_stories(spark, sf_dir):
    parts = materialize(_kept_parts(spark, sf_dir), "parts")
    page = kept.list_kept_stories(
        parts, fx.stories(spark, sf_dir), fx.sources(spark, sf_dir), offset=10, at_least=2
    )
    return _joined_names(page)


@query(
    "story_page",
    """SELECT (SELECT count(*) FROM summaries_fx) AS total, 20 AS "limit", 0 AS "offset",
         string_agg(id, ',' ORDER BY latest_article_at DESC, id DESC) AS items
       FROM (SELECT * FROM summaries_fx ORDER BY latest_article_at DESC, id DESC LIMIT 20)""",
)
def story_page(spark, sf_dir):
    page = listings.story_page(_summaries(spark, sf_dir))
    return page.withColumn("items", F.array_join(F.transform("items", lambda i: i["id"].cast("string")), ","))


@query(
    "story_page_past_end",
    """SELECT (SELECT count(*) FROM summaries_fx) AS total, 20 AS "limit", 100000 AS "offset", count(*) AS items
       FROM (SELECT id FROM summaries_fx LIMIT 20 OFFSET 100000)""",
)
def story_page_past_end(spark, sf_dir):
    page = listings.story_page(_summaries(spark, sf_dir), offset=100_000)
    return page.withColumn("items", F.size("items"))


@query("story_newest", "SELECT story_id, max(article_time) AS newest_at FROM joined_fx GROUP BY story_id")
def story_newest(spark, sf_dir):
    return listings.story_newest(fx.joined_members(spark, sf_dir))


@query(
    "story_timeline",
    """SELECT story_id, article_id AS id, article_title AS title, url, source_name, published_at, created_at,
       round(similarity, 9) AS similarity, article_time FROM joined_fx""",
)
def story_timeline(spark, sf_dir):
    timeline = listings.story_timeline(fx.joined_members(spark, sf_dir))
    return timeline.withColumn("similarity", F.round("similarity", 9))


@query(
    "story_detail",
    """SELECT s.* EXCLUDE (id, title), s.id AS story_id, s.title AS story_title, j.article_id, j.article_title,
         j.url, j.source_name, j.published_at, j.created_at, round(j.similarity, 9) AS similarity, j.article_time
       FROM summaries_fx s JOIN joined_fx j ON j.story_id = s.id WHERE s.id = 7""",
)
def story_detail(spark, sf_dir):
    detail = _joined_names(listings.story_detail(fx.joined_members(spark, sf_dir), 7))
    return detail.withColumn("similarity", F.round("similarity", 9))


@query("story_by_id", "SELECT * FROM summaries_fx WHERE id = 7")
def story_by_id(spark, sf_dir):
    one = fx.joined_members(spark, sf_dir).filter(F.col("story_id") == 7)
    return _joined_names(listings.story_summaries(one))


_HIGH_SIZES = "SELECT high_story AS story_id, count(*) AS size FROM compare_fx GROUP BY 1"


@query("stories_by_size", f"SELECT * FROM ({_HIGH_SIZES}) WHERE size >= 2")
def stories_by_size(spark, sf_dir):
    members = fx.compared(spark, sf_dir).select(F.col("high_story").alias("story_id"))
    return listings.stories_by_size(members, 2)


@query(
    "story_rank",
    f"""SELECT *, row_number() OVER (ORDER BY size DESC, story_id) AS rank FROM ({_HIGH_SIZES})
        WHERE size >= 2 ORDER BY rank LIMIT 25""",
)
def story_rank(spark, sf_dir):
    members = fx.compared(spark, sf_dir).select(F.col("high_story").alias("story_id"))
    return listings.top_stories(members, 25, 2)


@query(
    "story_report",
    """SELECT story_id, count(*) OVER (PARTITION BY story_id) AS size, article_id,
         round(similarity, 9) AS similarity, source_name AS source, article_title AS title, article_time
       FROM joined_fx QUALIFY size >= 2""",
)
def story_report(spark, sf_dir):
    report = listings.story_report(fx.joined_members(spark, sf_dir))
    return report.withColumn("similarity", F.round("similarity", 9))


@query(
    "high_story_size",
    "SELECT article_id, count(*) OVER (PARTITION BY high_story) AS size FROM compare_fx",
)
def high_story_size(spark, sf_dir):
    """Counted by a combining aggregate and joined back, not gathered in a window."""
    members = fx.compared(spark, sf_dir).select("article_id", "high_story")
    sizes = members.groupBy("high_story").agg(F.count("*").alias("size"))
    return members.join(sizes, "high_story").select("article_id", "size")


@query(
    "cluster_size_report",
    f"""SELECT count(*) AS stories, count(*) FILTER (size = 1) AS size_1,
        count(*) FILTER (size > 1) AS size_2_plus, coalesce(max(size), 0) AS largest FROM ({_HIGH_SIZES})""",
)
def size_report(spark, sf_dir):
    sizes = fx.compared(spark, sf_dir).groupBy("high_story").agg(F.count("*").alias("size"))
    return cluster_size_report(sizes)


def _sides(spark, sf_dir):
    rows = fx.compared(spark, sf_dir)
    return [
        rows.select("article_id", F.col(f"{side}_story").alias("story"), F.lit(None).cast("double").alias("similarity"))
        for side in ("low", "high")
    ]


_COMPARED = """SELECT low_story, CAST(sum(n) AS BIGINT) AS articles, count(*) AS parts,
    CASE WHEN count(*) FILTER (n >= 2) >= 2 THEN 'split' ELSE 'shrunk' END AS kind
  FROM (SELECT low_story, high_story, count(*) AS n FROM compare_fx GROUP BY ALL)
  GROUP BY low_story HAVING sum(n) >= 2 AND count(*) > 1"""


@query("threshold_compare", _COMPARED)
def compare(spark, sf_dir):
    return threshold_compare(*_sides(spark, sf_dir))


@query(
    "compare_assignments",
    f"""SELECT m.low_story, m.article_id, m.high_story, c.kind,
          (SELECT count(*) FROM compare_fx x WHERE x.high_story = m.high_story) AS high_size
        FROM compare_fx m JOIN ({_COMPARED}) c ON c.low_story = m.low_story""",
)
def compare_assignments(spark, sf_dir):
    return compared_members(*_sides(spark, sf_dir)).select(
        "low_story", "article_id", "high_story", "kind", "high_size"
    )


@query(
    "story_centroid",
    """SELECT story_id, dimension, round(avg(x), 9) AS mean
       FROM (SELECT m.story_id, generate_subscripts(u.u, 1) - 1 AS dimension, unnest(u.u) AS x
             FROM members_fx m JOIN units_fx u ON u.id = m.article_id) GROUP BY ALL""",
)
def centroid(spark, sf_dir):
    means = story_centroids(fx.members(spark, sf_dir), fx.vectors(spark, sf_dir))
    return means.withColumns({"mean": F.round("mean", 9), "dimension": F.col("dimension").cast("long")})


@query(
    "nearest_story",
    """WITH active AS (SELECT j.story_id, max(j.article_time) AS newest, any_value(v.v) AS c
         FROM joined_fx j JOIN vectors_fx v ON v.id = j.story_id * 4 GROUP BY 1)
       SELECT a.id AS article_id, arg_max(s.story_id, (round(list_cosine_similarity(v.v, s.c), 9), -s.story_id)) AS story_id,
         round(max(list_cosine_similarity(v.v, s.c)), 9) AS similarity
       FROM articles_fx a JOIN vectors_fx v ON v.id = a.id
       JOIN active s ON s.newest BETWEEN coalesce(a.published_at, a.created_at) - INTERVAL 24 HOUR
         AND coalesce(a.published_at, a.created_at) + INTERVAL 24 HOUR
       GROUP BY a.id""",
)
def nearest(spark, sf_dir):
    """Closest story of every article; here a story's first article gives its centroid."""
    newest = listings.story_newest(fx.joined_members(spark, sf_dir))
    seeds = fx.vectors(spark, sf_dir).filter("id % 4 = 0").select(
        F.floor(F.col("id") / 4).alias("story_id"), F.col("embedding").alias("centroid")
    )
    stories = newest.join(seeds, "story_id").withColumnRenamed("story_id", "id")
    found = nearest_stories(fx.embedded_articles(spark, sf_dir), stories)
    return found.withColumn("similarity", F.round("similarity", 9))


@query(
    "already_assigned",
    "SELECT id FROM articles_fx WHERE id NOT IN (SELECT article_id FROM members_fx WHERE similarity IS NULL)",
)
def already_assigned(spark, sf_dir):
    seeds = fx.members(spark, sf_dir).filter("similarity IS NULL").select(F.col("article_id").alias("id"))
    return fx.articles(spark, sf_dir).select("id").join(seeds, "id", "left_anti")


@query(
    "assignment_status_counts",
    """SELECT CASE WHEN similarity IS NULL THEN 'created' ELSE 'joined' END AS status, count(*) AS articles
       FROM members_fx GROUP BY 1""",
)
def statuses(spark, sf_dir):
    status = F.when(F.col("similarity").isNull(), "created").otherwise("joined")
    return status_counts(fx.members(spark, sf_dir).withColumn("status", status))


@query(
    "first_url_wins",
    "SELECT min(id) AS arrival, url FROM articles_fx GROUP BY url",
)
def first_url(spark, sf_dir):
    rows = fx.articles(spark, sf_dir).select(F.col("id").alias("arrival"), "url")
    return first_url_wins(rows)


@query(
    "article_insert",
    """SELECT min(id) AS arrival, url FROM articles_fx WHERE id % 2 = 1
       AND url NOT IN (SELECT url FROM articles_fx WHERE id % 2 = 0) GROUP BY url""",
)
def article_insert(spark, sf_dir):
    """Odd ids arrive; the even ones are in the table already."""
    rows = fx.articles(spark, sf_dir).select(F.col("id").alias("arrival"), "url")
    return first_url_wins(rows.filter("arrival % 2 = 1"), rows.filter("arrival % 2 = 0"))


@query(
    "processed_topic_scan",
    """SELECT id, url, true AS found FROM articles_fx WHERE id % 3 = 0
       UNION ALL SELECT id + 1000000000, url, false FROM articles_fx WHERE id % 7 = 0""",
)
def processed_topic_scan(spark, sf_dir):
    """Messages joined to their articles; some name an article that does not exist."""
    articles = fx.articles(spark, sf_dir).select("id", "url")
    sent = articles.filter("id % 3 = 0").unionByName(
        articles.filter("id % 7 = 0").withColumn("id", F.col("id") + 1_000_000_000)
    )
    found, missing = processed_articles(messages.decode_processed(messages.republished(sent)), articles)
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


_FIELDS = "source: source, source_url: source_url, title: title, url: url, published_at: published_at, content: content"


@query("raw_topic_sink", f"SELECT url AS key, to_json({{{_FIELDS}}}) AS value FROM raw_fx")
def raw_topic_sink(spark, sf_dir):
    return messages.raw_messages(fx.raw_fields(spark, sf_dir))


@query("republish_all", "SELECT url AS key, to_json({id: id, url: url}) AS value FROM articles_fx")
def republish_all(spark, sf_dir):
    return messages.republished(fx.articles(spark, sf_dir))


@query("entities_per_article", "SELECT article_id, count(*) AS entities FROM mentions_fx GROUP BY 1")
def entities_per_article(spark, sf_dir):
    return mention_counts(fx.mentions(spark, sf_dir))


# ---- sources


@query(
    "counts_by_source_name",
    """SELECT s.name, count(DISTINCT s.id) AS source_rows, count(a.id) AS articles
       FROM dup_sources_fx s LEFT JOIN dup_articles_fx a ON a.source_id = s.id GROUP BY s.name""",
)
def counts_by_source_name(spark, sf_dir):
    return maintenance.counts_by_name(fx.repeated_sources(spark, sf_dir), fx.repeated_source_articles(spark, sf_dir))


@query("distinct_names", "SELECT DISTINCT name FROM dup_sources_fx")
def distinct_names(spark, sf_dir):
    return maintenance.distinct_names(fx.repeated_sources(spark, sf_dir))


@query("canonical_source", "SELECT id, name, keep_id FROM canonical_fx")
def canonical_source(spark, sf_dir):
    return maintenance.canonical_sources(fx.repeated_sources(spark, sf_dir)).select("id", "name", "keep_id")


@query("source_by_name", "SELECT name, min(id) AS source_id FROM dup_sources_fx GROUP BY name")
def source_by_name(spark, sf_dir):
    return source_ids(fx.repeated_sources(spark, sf_dir))


@query(
    "orphan_sources",
    "SELECT id, name, url FROM dup_sources_fx WHERE id NOT IN (SELECT source_id FROM dup_articles_fx)",
)
def orphan_sources(spark, sf_dir):
    return maintenance.orphan_sources(fx.repeated_sources(spark, sf_dir), fx.repeated_source_articles(spark, sf_dir))


@query(
    "repoint_articles",
    "SELECT a.id, a.url, c.keep_id AS source_id FROM dup_articles_fx a JOIN canonical_fx c ON c.id = a.source_id",
)
def repoint_articles(spark, sf_dir):
    canonical = maintenance.canonical_sources(fx.repeated_sources(spark, sf_dir))
    return maintenance.repoint_articles(fx.repeated_source_articles(spark, sf_dir), canonical)


def _audit() -> str:
    """Every key over the tables that break it."""
    tables = {name: f"({sql})" for name, sql in fx.AUDITED.items()}
    found = []
    for table, columns in maintenance.UNIQUE_KEYS:
        value = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)
        found.append(
            f"""SELECT '{table} unique {", ".join(columns)}' AS "constraint", {value} AS value, count(*) AS rows
            FROM {tables[table]} GROUP BY ALL HAVING count(*) > 1"""
        )
    for table, column, parent in maintenance.FOREIGN_KEYS:
        found.append(
            f"""SELECT '{table} foreign key {column}', CAST({column} AS VARCHAR), count(*) FROM {tables[table]}
            WHERE {column} NOT IN (SELECT id FROM {tables[parent]}) GROUP BY {column}"""
        )
    return " UNION ALL ".join(found).replace("FROM repeated_sources", "FROM dup_sources_fx")


@query("constraint_check", _audit())
def constraint_check(spark, sf_dir):
    return maintenance.constraint_check(fx.audited(spark, sf_dir))
