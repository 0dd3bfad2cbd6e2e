"""Registration of queries, and the shared parts of their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storystream.functions.topics import NOT_FOLLOWED_BY, TAXONOMY, TOPICS, UNCATEGORIZED, keyword_forms
from storystream.plans import fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# A word boundary that counts every letter and digit as part of a word
BEFORE, AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _forms(keyword: str) -> str:
    return "|".join(form.replace(" ", r"\s+") for form in keyword_forms(keyword))


def _topic_columns() -> str:
    columns = []
    for number, keywords in enumerate(TAXONOMY.values()):
        tests = []
        for keyword in keywords:
            text = "low"
            if keyword in NOT_FOLLOWED_BY:
                followed = rf"({BEFORE})(?:{_forms(keyword)})\s+news({AFTER})"
                text = rf"regexp_replace(low, '{followed}', '\1 \2', 'g')"
            tests.append(f"CAST(regexp_matches({text}, '{BEFORE}(?:{_forms(keyword)}){AFTER}') AS INT)")
        columns.append(f"{' + '.join(tests)} AS s{number}")
    return ",\n".join(columns)


def _best_topic() -> str:
    scores = [f"s{n}" for n in range(len(TOPICS))]
    top = f"greatest({', '.join(scores)})"
    ties = " + ".join(f"CAST({s} = {top} AS INT)" for s in scores)
    whens = " ".join(f"WHEN {s} = {top} THEN '{topic}'" for s, topic in zip(scores, TOPICS))
    return f"CASE WHEN {top} = 0 OR {ties} > 1 THEN '{UNCATEGORIZED}' {whens} END"


def _phrases() -> str:
    quoted = ("'" + p.replace("\n", "' || chr(10) || '") + "'" for p in fixtures.TOPIC_PHRASES)
    return f"[{', '.join(quoted)}]"


# Tables the SQL builds on; those a query names are put before it
VIEWS = {
    "articles_fx": fixtures.ARTICLES.format(ntz="TIMESTAMP"),
    "sources_fx": fixtures.SOURCES,
    "topic_articles_fx": f"""
        SELECT * REPLACE (content || chr(10) || {_phrases()}[id % {len(fixtures.TOPIC_PHRASES)} + 1] AS content)
        FROM articles_fx""",
    "topic_scores_fx": f"""
        SELECT id, {_topic_columns()}
        FROM (SELECT id, lower(title || chr(10) || content) AS low FROM topic_articles_fx)""",
    "topics_fx": f"SELECT id, {_best_topic()} AS topic FROM topic_scores_fx",
    "vectors_fx": """
        SELECT d.doc_id AS id, list_transform(range(1, len(a.embedding) + 1), lambda i:
            0.85::DOUBLE * a.embedding[i]::DOUBLE + 0.55::DOUBLE * b.embedding[i]::DOUBLE) AS v
        FROM documents d, (SELECT count(*) AS k FROM embeddings) n
        JOIN embeddings a ON a.vec_id = (d.doc_id // 4) % n.k
        JOIN embeddings b ON b.vec_id = (d.doc_id * 7 + 3) % n.k""",
    "units_fx": """
        SELECT id, list_transform(v, lambda x: x / n) AS u
        FROM (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM vectors_fx)""",
    "members_fx": """
        SELECT a.id // 4 AS story_id, a.id AS article_id,
          CASE WHEN a.id % 4 <> 0 THEN list_dot_product(a.u, b.u) END AS similarity
        FROM units_fx a JOIN units_fx b ON b.id = a.id // 4 * 4""",
    "stories_fx": "SELECT id // 4 AS id, title FROM articles_fx WHERE id % 4 = 0",
    "joined_fx": """
        SELECT m.story_id, s.title AS story_title, m.article_id, m.similarity, a.source_id,
          r.name AS source_name, a.title AS article_title, a.url, a.published_at, a.created_at,
          coalesce(a.published_at, a.created_at) AS article_time, t.topic
        FROM members_fx m JOIN stories_fx s ON s.id = m.story_id JOIN articles_fx a ON a.id = m.article_id
        JOIN sources_fx r ON r.id = a.source_id JOIN topics_fx t ON t.id = a.id""",
    "summaries_fx": f"""
        SELECT story_id AS id, story_title AS title, count(*) AS article_count,
          count(DISTINCT source_id) AS source_count,
          array_to_string(list_sort(list(DISTINCT source_name)), ',') AS source_names,
          min(article_time) AS first_article_at, max(article_time) AS latest_article_at,
          coalesce((SELECT topic FROM joined_fx x WHERE x.story_id = j.story_id AND topic <> '{UNCATEGORIZED}'
                    GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 1), '{UNCATEGORIZED}') AS topic
        FROM joined_fx j GROUP BY story_id, story_title""",
    "dup_sources_fx": fixtures.REPEATED_SOURCES,
    "dup_articles_fx": fixtures.REPEATED_SOURCE_ARTICLES,
    "canonical_fx": """
        SELECT id, name, min(id) OVER (PARTITION BY name) AS keep_id FROM dup_sources_fx""",
    "raw_fx": fixtures.RAW_FIELDS.format(moment=fixtures.MOMENT_DUCKDB),
    "mentions_fx": fixtures.MENTIONS_SQL,
    "compare_fx": fixtures.COMPARED,
    "old_topics_fx": f"""
        SELECT id, CASE WHEN id % 9 < 8 THEN {[*TOPICS]}[id % 9 + 1] END AS topic FROM articles_fx""",
    "classified_fx": """
        SELECT t.id, o.topic, t.topic AS new_topic FROM topics_fx t JOIN old_topics_fx o ON o.id = t.id""",
}


def with_views(sql: str) -> str:
    """Put the views a statement names, and those they name, before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in needed)
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.lstrip().startswith(start):
            return f"{start}{views},\n{sql.lstrip()[len(start):]}"
    return f"WITH {views}\n{sql}"


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = with_views(sql)
        return fn

    return register
