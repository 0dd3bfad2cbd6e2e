"""Queries of column functions: text, dates, topics, vectors, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from storystream.functions import text as x
from storystream.functions.fuzzy import token_sort_key
from storystream.functions.topics import TAXONOMY, TOPICS, keyword_forms, keyword_pattern, topic_scores
from storystream.functions.vectors import cosine, l2_normalize, norm
from storystream.plans import fixtures as fx
from storystream.plans.catalog.registry import AFTER, BEFORE, query
from storystream.plans.maintenance import clean_articles


def _pages(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.col("url"), F.col("html").alias("content")
    )


_TAG = r"""</?[a-z](?:[^''">]+|"[^"]*"|''[^'']*'')*>"""
_MARKUP = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<template\b[^>]*>.*?</template\s*>|<[!?][^>]*>|" + _TAG + r"|</?[a-z][^>]*>"
)
_TEXT = f"regexp_replace(html, '{_MARKUP}', '', 'g')"
for _entity, _character in x.COMMON_ENTITIES:
    _TEXT = f"replace({_TEXT}, '{_entity}', chr({ord(_character)}))"


@query("html_text", f"SELECT page_id AS id, {_TEXT} AS text FROM pages")
def html_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("id", x.html_text(F.col("content")).alias("text"))


_ALL = f"replace(replace({_TEXT}, '&copy;', chr(169)), '&middot;', chr(183))"


@query("clean_articles", f"SELECT page_id AS id, url, {_ALL} AS content FROM pages")
def clean(spark, sf_dir):
    return clean_articles(_pages(spark, sf_dir))


_BOILERPLATE = "|".join(x.BOILERPLATE_PREFIXES)


@query(
    "embedding_text",
    rf"""
    SELECT id, CASE WHEN length(body) < 40 THEN title ELSE substr(title || '. ' || body, 1, 1000) END AS text
    FROM (SELECT id, title, regexp_replace(array_to_string(list_filter(
          regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
          lambda l: NOT regexp_matches(l, '^[\s\x1c-\x1f]*(?:{_BOILERPLATE})')), chr(10)),
          '^[\s\x1c-\x1f\p{{Z}}]+|[\s\x1c-\x1f\p{{Z}}]+$', '', 'g') AS body
      FROM (SELECT id, title, CASE id % 3 WHEN 0 THEN 'Points: 7' || chr(10) || title
              WHEN 1 THEN content || chr(10) || ' Comments URL: x' ELSE content END AS content FROM articles_fx))
    """,
)
def embedding_text(spark, sf_dir):
    content = (
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("Points: 7\n"), "title"))
        .when(F.col("id") % 3 == 1, F.concat("content", F.lit("\n Comments URL: x")))
        .otherwise(F.col("content"))
    )
    return fx.articles(spark, sf_dir).select("id", x.embedding_text(F.col("title"), content).alias("text"))


@query(
    "classification_text",
    "SELECT id, title || chr(10) || coalesce(CASE WHEN id % 5 > 0 THEN content END, '') AS text FROM articles_fx",
)
def classification_text(spark, sf_dir):
    content = F.when(F.col("id") % 5 > 0, F.col("content"))
    return fx.articles(spark, sf_dir).select(
        "id", x.classification_text(F.col("title"), content).alias("text")
    )


def _pattern_counts() -> str:
    counts = []
    for keywords in TAXONOMY.values():
        for keyword in keywords:
            forms = "|".join(f.replace(" ", r"\s+") for f in keyword_forms(keyword))
            text = "low"
            if keyword == "hack":
                text = rf"regexp_replace(low, '({BEFORE})(?:{forms})\s+news({AFTER})', '\1 \2', 'g')"
            counts.append(
                f"SELECT '{keyword}' AS keyword, CAST(count(*) AS BIGINT) AS articles FROM lowered"
                f" WHERE regexp_matches({text}, '{BEFORE}(?:{forms}){AFTER}')"
            )
    return " UNION ALL ".join(counts)


@query(
    "keyword_pattern",
    "WITH lowered AS (SELECT lower(title || chr(10) || content) AS low FROM topic_articles_fx) " + _pattern_counts(),
)
def keyword_patterns(spark, sf_dir):
    """Articles per keyword, each tested with its own pattern."""
    lowered = fx.topic_articles(spark, sf_dir).select(
        F.lower(x.classification_text(F.col("title"), F.col("content"))).alias("low")
    )
    keywords = [keyword for words in TAXONOMY.values() for keyword in words]
    counts = lowered.agg(
        *[F.count_if(F.col("low").rlike(keyword_pattern(k))).alias(k) for k in keywords]
    )
    return counts.unpivot([], keywords, "keyword", "articles")


@query(
    "topic_scores",
    "SELECT id, " + ", ".join(f"s{n}" for n in range(len(TOPICS))) + " FROM topic_scores_fx",
)
def scores(spark, sf_dir):
    scored = fx.topic_articles(spark, sf_dir).select(
        "id", topic_scores(x.classification_text(F.col("title"), F.col("content"))).alias("s")
    )
    return scored.select("id", *[F.col("s")[n].alias(f"s{n}") for n in range(len(TOPICS))])


@query("classify_topic", "SELECT id, topic FROM topics_fx")
def classify(spark, sf_dir):
    return fx.with_topic(fx.topic_articles(spark, sf_dir)).select("id", "topic")


_SORTED = r"array_to_string(list_sort(list_filter(regexp_split_to_array({}, '\s+'), lambda t: t <> '')), ' ')"


@query("token_sort_key", f"SELECT id, {_SORTED.format('title')} AS key FROM articles_fx")
def sorted_titles(spark, sf_dir):
    return fx.articles(spark, sf_dir).select("id", token_sort_key(F.col("title")).alias("key"))


@query(
    "parse_published",
    """
    SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN d WHEN 1 THEN d - INTERVAL 2 HOUR WHEN 2 THEN d
      ELSE d + INTERVAL 5 HOUR END AS published_at
    FROM (SELECT doc_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (doc_id * 61 % 2500000) AS d FROM documents)
    """,
)
def published(spark, sf_dir):
    """Dates in the styles feeds use, the last of them only in the second field."""
    moment = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("doc_id") * 61 % 2500000)
    rows = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), moment.alias("d"))
    style = F.col("id") % 5
    rfc = F.date_format("d", "dd MMM yyyy HH:mm:ss")
    first = (
        F.when(style == 0, F.concat(F.date_format("d", "E, "), rfc, F.lit(" GMT")))
        .when(style == 1, F.concat(rfc, F.lit(" +0200")))
        .when(style == 2, F.concat(F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(style == 3, F.lit("sometime"))
    )
    second = F.concat(F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))
    return rows.select("id", x.parse_published(first, second).cast("timestamp_ntz").alias("published_at"))


_PARSED = """CASE WHEN published_at LIKE '%Z' OR published_at LIKE '%+02:00' THEN
  CAST(substr(published_at, 1, 19) AS TIMESTAMP) - CASE WHEN published_at LIKE '%Z' THEN INTERVAL 0 HOUR
  ELSE INTERVAL 2 HOUR END END"""


@query("parse_iso", f"SELECT id, {_PARSED} AS published_at FROM raw_fx")
def iso(spark, sf_dir):
    parsed = x.parse_iso(F.col("published_at")).cast("timestamp_ntz")
    return fx.raw_fields(spark, sf_dir).select("id", parsed.alias("published_at"))


@query(
    "iso_format",
    "SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS text FROM articles_fx",
)
def iso_format(spark, sf_dir):
    return fx.articles(spark, sf_dir).select("id", x.iso_format(F.col("created_at")).alias("text"))


@query("trim_fields", "SELECT id, trim(title) AS title, trim(url) AS url FROM raw_fx")
def trim_fields(spark, sf_dir):
    return fx.raw_fields(spark, sf_dir).select(
        "id", x.strip(F.col("title")).alias("title"), x.strip(F.col("url")).alias("url")
    )


@query(
    "validate_payload",
    """SELECT id, coalesce(length(source), 0) > 0 AND coalesce(length(title), 0) > 0
         AND coalesce(length(url), 0) > 0 AS valid FROM raw_fx""",
)
def validate_payload(spark, sf_dir):
    valid = x.is_valid_payload(F.col("source"), F.col("title"), F.col("url"))
    return fx.raw_fields(spark, sf_dir).select("id", valid.alias("valid"))


@query("validate_entry", "SELECT id FROM raw_fx WHERE title <> '' AND url <> ''")
def validate_entry(spark, sf_dir):
    return fx.raw_fields(spark, sf_dir).filter(x.is_valid_entry(F.col("title"), F.col("url"))).select("id")


@query(
    "placeholder_url",
    "SELECT id, coalesce(source_url, concat('source://', source)) AS url FROM raw_fx",
)
def placeholder(spark, sf_dir):
    return fx.raw_fields(spark, sf_dir).select(
        "id", x.placeholder_url(F.col("source_url"), F.col("source")).alias("url")
    )


@query("first_nonempty", "SELECT id, coalesce(title, '') AS title FROM raw_fx")
def first_nonempty(spark, sf_dir):
    return fx.raw_fields(spark, sf_dir).select("id", x.first_nonempty(F.col("title")).alias("title"))


@query(
    "lower_key",
    "SELECT lower(name) AS key, type, count(DISTINCT name) AS spellings FROM mentions_fx GROUP BY ALL",
)
def lower_key(spark, sf_dir):
    return (
        fx.mentions(spark, sf_dir)
        .groupBy(x.entity_key(F.col("name")).alias("key"), "type")
        .agg(F.countDistinct("name").alias("spellings"))
    )


@query(
    "article_time",
    "SELECT id, coalesce(published_at, created_at) AS article_time FROM articles_fx",
)
def article_time(spark, sf_dir):
    return fx.articles(spark, sf_dir).select(
        "id", x.article_time(F.col("published_at"), F.col("created_at")).alias("article_time")
    )


@query(
    "l2_normalize",
    """SELECT id, generate_subscripts(u, 1) - 1 AS dimension, round(unnest(u), 9) AS x FROM units_fx""",
)
def normalized(spark, sf_dir):
    return (
        fx.vectors(spark, sf_dir)
        .select("id", F.posexplode(l2_normalize(F.col("embedding"))).alias("dimension", "x"))
        .withColumns({"x": F.round("x", 9), "dimension": F.col("dimension").cast("long")})
    )


@query(
    "cosine",
    """SELECT a.id, round(list_dot_product(a.v, b.v) /
         (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS cosine,
         round(sqrt(list_dot_product(a.v, a.v)), 9) AS length
       FROM vectors_fx a JOIN vectors_fx b ON b.id = a.id + 1""",
)
def cosines(spark, sf_dir):
    """Cosine of every vector with the next one."""
    rows = fx.vectors(spark, sf_dir)
    following = rows.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("next"))
    return rows.join(following, "id").select(
        "id",
        F.round(cosine(F.col("embedding"), F.col("next")), 9).alias("cosine"),
        F.round(norm(F.col("embedding")), 9).alias("length"),
    )
