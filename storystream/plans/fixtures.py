"""Articles, sources, vectors and memberships read out of the test tables.

A document stands for an article: its first line is the title and its whole
text the content. Times and sources
follow from the document id, so both engines derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storystream.functions.topics import TOPICS
from storystream.functions.vectors import dot, l2_normalize
from storystream.operators.enrich import with_topic
from storystream.operators.entities import extract_mentions
from storystream.plans.listings import story_members
from storystream.plans.maintenance import reclassify

# Sentences added to the content so that every topic, a tie, plurals, phrases
# and the "hacker news" exception occur
TOPIC_PHRASES = [
    "AI and LLMs meet machine learning",
    "Drones and humanoid robots",
    "NASA rockets reached orbit",
    "The IPO valuation pleased investors",
    "Congress heard the antitrust lawsuit",
    "New games are streaming",
    "Hackers exploited the breach",
    "Google Pixel watch and smart glasses",
    "An AI startup",
    "Posted on Hacker News",
    "He said the plan was fine",
    "Two robotic hacks and one malware breach",
    "A satellite, an astronaut and a drone",
    "machine\nlearning funding",
    "",
    "Hacker  news about a hacked laptop",
]

ARTICLES = """
SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS source_id,
  split_part(text, chr(10), 1) AS title, text AS content,
  concat('https://news.test/', md5(text)) AS url,
  CASE WHEN doc_id % 50 = 0 THEN NULL
       ELSE {ntz} '2024-01-01 00:00:00' + INTERVAL '7' MINUTE * doc_id END AS published_at,
  {ntz} '2024-01-01 00:30:00' + INTERVAL '7' MINUTE * doc_id AS created_at
FROM documents
"""

SOURCES = """
SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, source AS name,
  concat('https://', source, '.test/feed') AS url
FROM documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        ARTICLES.format(ntz="TIMESTAMP_NTZ").replace("FROM documents", "FROM {documents}"),
        documents=table(spark, sf_dir, "documents"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        SOURCES.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents")
    )


def topic_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose content ends with a topic phrase chosen by id."""
    phrases = F.array(*[F.lit(phrase) for phrase in TOPIC_PHRASES])
    phrase = F.element_at(phrases, (F.col("id") % len(TOPIC_PHRASES) + 1).cast("int"))
    return articles(spark, sf_dir).withColumn("content", F.concat("content", F.lit("\n"), phrase))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector per article, blended from two embeddings; four neighbours share one of them."""
    embeddings = table(spark, sf_dir, "embeddings")
    size = embeddings.select(F.count("*").alias("k"))
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    first = embeddings.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    second = embeddings.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return (
        ids.withColumn("k", size.scalar())
        .withColumn("a_id", F.floor(F.col("id") / 4) % F.col("k"))
        .withColumn("b_id", (F.col("id") * 7 + 3) % F.col("k"))
        .join(first, "a_id")
        .join(second, "b_id")
        .select(
            "id",
            F.zip_with(
                "a", "b", lambda x, y: F.lit(0.85) * x.cast("double") + F.lit(0.55) * y.cast("double")
            ).alias("embedding"),
        )
    )


def embedded_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).join(vectors(spark, sf_dir), "id")


# One source row per (source, language), so names repeat; two carry a seed's name; suppliers
# stand for sources without articles
REPEATED_SOURCES = """
SELECT min(doc_id) AS id,
  CASE source WHEN 'src0' THEN 'TechCrunch' WHEN 'src1' THEN 'The Verge' ELSE source END AS name,
  concat('https://', source, '.test/', lang) AS url
FROM documents GROUP BY source, lang
UNION ALL
SELECT 1000000000 + s_suppkey AS id, concat('nation ', CAST(s_nationkey AS VARCHAR(20))) AS name,
  concat('https://supplier.test/', CAST(s_suppkey AS VARCHAR(20))) AS url
FROM supplier
"""

REPEATED_SOURCE_ARTICLES = """
SELECT d.doc_id AS id, s.source_id, concat('https://news.test/', md5(d.text)) AS url
FROM documents d JOIN (SELECT source, lang, min(doc_id) AS source_id FROM documents GROUP BY source, lang) s
  ON s.source = d.source AND s.lang = d.lang
"""

# Tables with rows that break each constraint: copies of rows, and keys that are nowhere
AUDITED = {
    "sources": """SELECT id, url FROM repeated_sources
      UNION ALL SELECT -id AS id, url FROM repeated_sources WHERE id % 3 = 0""",
    "articles": """SELECT id, CASE WHEN id % 25 = 9 THEN -2000000000 - id ELSE source_id END AS source_id, url,
        CASE WHEN id % 50 = 7 THEN -id WHEN id % 5 = 2 THEN id - 1 END AS duplicate_of_id FROM articles_fx""",
    "entities": "SELECT DISTINCT id % 9 AS id FROM articles_fx",
    "article_entities": """SELECT id AS article_id, id % 10 AS entity_id FROM articles_fx
      UNION ALL SELECT id AS article_id, id % 10 AS entity_id FROM articles_fx WHERE id % 20 = 3
      UNION ALL SELECT -id AS article_id, 1 AS entity_id FROM articles_fx WHERE id % 30 = 4""",
    "stories": """SELECT DISTINCT CAST(floor(id / 4) AS BIGINT) AS id FROM articles_fx
      WHERE CAST(floor(id / 4) AS BIGINT) % 7 <> 3""",
    "story_articles": """SELECT CAST(floor(id / 4) AS BIGINT) AS story_id, id AS article_id FROM articles_fx
      UNION ALL SELECT 0 AS story_id, id AS article_id FROM articles_fx WHERE id % 40 = 6
      UNION ALL SELECT 0 AS story_id, -id AS article_id FROM articles_fx WHERE id % 30 = 4""",
}

# When a document's article appeared, as text; the dialects differ in the name of the function
MOMENT = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '7' MINUTE * doc_id"
MOMENT_SPARK = f"""date_format({MOMENT.replace("TIMESTAMP", "TIMESTAMP_NTZ")}, "yyyy-MM-dd'T'HH:mm:ss")"""
MOMENT_DUCKDB = f"strftime({MOMENT}, '%Y-%m-%dT%H:%M:%S')"

# Fields of raw messages, some of them missing or broken
RAW_FIELDS = """
SELECT doc_id AS id, CASE WHEN doc_id % 17 = 5 THEN '' ELSE source END AS source,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('https://', source, '.test/feed') END AS source_url,
  CASE WHEN doc_id % 13 = 3 THEN NULL ELSE concat('  ', split_part(text, chr(10), 1), ' ') END AS title,
  concat(' https://news.test/', md5(text), ' ') AS url,
  CASE WHEN doc_id % 11 = 2 THEN 'yesterday' WHEN doc_id % 11 = 4 THEN NULL
       ELSE concat({moment}, CASE WHEN doc_id % 2 = 0 THEN 'Z' ELSE '+02:00' END) END AS published_at,
  text AS content
FROM documents
"""

# Mentions by two plain patterns, with their position in the article
MENTION_PATTERNS = {"NAME": "[A-Z][a-z]+", "ADVERB": "[a-z]+ly"}
MENTIONS_SQL = """
SELECT id AS article_id, generate_subscripts(m, 1) - 1 AS position, unnest(m).name AS name, unnest(m).type AS type
FROM (SELECT id, list_concat(
    list_transform(regexp_extract_all(content, '[A-Z][a-z]+'), lambda x: {'name': x, 'type': 'NAME'}),
    list_transform(regexp_extract_all(content, '[a-z]+ly'), lambda x: {'name': x, 'type': 'ADVERB'})) AS m
  FROM articles_fx)
"""

# Memberships at a low and a high threshold: of three stories one stays whole, one falls into
# halves and one loses an article
COMPARED = """
SELECT id AS article_id, CAST(floor(id / 6) AS BIGINT) AS low_story,
  CAST(floor(id / 6) AS BIGINT) * 10 +
  CASE CAST(floor(id / 6) AS BIGINT) % 3 WHEN 0 THEN 0 WHEN 1 THEN CAST(floor(id % 6 / 3) AS BIGINT)
       ELSE CASE WHEN id % 6 = 5 THEN 1 ELSE 0 END END AS high_story
FROM articles_fx
"""


def _run(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **tables)


def repeated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(
        spark,
        REPEATED_SOURCES,
        documents=table(spark, sf_dir, "documents"),
        supplier=table(spark, sf_dir, "supplier"),
    )


def repeated_source_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, REPEATED_SOURCE_ARTICLES, documents=table(spark, sf_dir, "documents"))


def audited(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables in which every constraint is broken somewhere."""
    given = {"repeated_sources": repeated_sources(spark, sf_dir), "articles_fx": articles(spark, sf_dir)}
    return {
        name: _run(spark, sql, **{k: v for k, v in given.items() if f"FROM {k}" in sql}) for name, sql in AUDITED.items()
    }


def raw_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, RAW_FIELDS.format(moment=MOMENT_SPARK), documents=table(spark, sf_dir, "documents"))


def stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that are there before messages come in: those of half the documents."""
    rows = articles(spark, sf_dir).filter("id % 2 = 0")
    return rows.select("id", "title", "url", F.col("published_at").cast("timestamp").alias("published_at"))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, COMPARED, articles_fx=articles(spark, sf_dir))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four neighbours make a story; the similarity is that to its first article."""
    units = vectors(spark, sf_dir).select("id", l2_normalize(F.col("embedding")).alias("u"))
    seeds = units.select(F.floor(F.col("id") / 4).alias("story_id"), F.col("u").alias("seed"), "id")
    seeds = seeds.filter("id % 4 = 0").drop("id")
    return (
        units.withColumn("story_id", F.floor(F.col("id") / 4))
        .join(seeds, "story_id")
        .select(
            "story_id",
            F.col("id").alias("article_id"),
            F.when(F.col("id") % 4 != 0, dot(F.col("u"), F.col("seed"))).alias("similarity"),
        )
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).filter("id % 4 = 0").select(F.floor(F.col("id") / 4).alias("id"), "title")


def joined_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = with_topic(topic_articles(spark, sf_dir))
    return story_members(
        stories(spark, sf_dir), members(spark, sf_dir), classified, sources(spark, sf_dir)
    )


def classified_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with the topic stored for them and the one they get now."""
    stored = F.when(
        F.col("id") % 9 < 8,
        F.element_at(F.array(*[F.lit(t) for t in TOPICS]), (F.col("id") % 9 + 1).cast("int")),
    )
    return reclassify(topic_articles(spark, sf_dir).withColumn("topic", stored))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = articles(spark, sf_dir).select("id", F.col("content").alias("text"))
    return extract_mentions(texts, MENTION_PATTERNS)
