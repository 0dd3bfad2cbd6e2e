"""Entity mentions, and their links to articles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storystream.functions.text import entity_key
from storystream.operators.numbering import with_sequence
from storystream.session import materialize

MENTIONS = "article_id long, position int, name string, type string"

# The default rules, a type and the pattern of its mentions
MENTION_PATTERNS = {
    "MONEY": r"\$\d[\d,.]*\d",
    "DATE": r"\b(?:19|20)\d{2}\b",
    "ORG": r"\b[A-Z]{2,}\b",
    "PERSON": r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
}


def extract_mentions(texts: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Mentions by pattern, JVM-side; `texts` has `id` and `text`."""
    found = [_typed(kind, pattern) for kind, pattern in (patterns or MENTION_PATTERNS).items()]
    return texts.select(F.col("id").alias("article_id"), F.posexplode(F.concat(*found))).select(
        "article_id", F.col("pos").alias("position"), "col.name", "col.type"
    )


def _typed(kind: str, pattern: str):
    names = F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)
    return F.transform(names, lambda name: F.struct(name.alias("name"), F.lit(kind).alias("type")))


def extract_mentions_with(
    texts: DataFrame, make_extractor: Callable[[], Callable[[str], list[tuple[str, str]]]]
) -> DataFrame:
    """Mentions by a model; `make_extractor` loads it once per task and returns text -> [(name, type)]."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = make_extractor()
        for batch in batches:
            rows = [
                (article, position, name, kind)
                for article, text in zip(batch["id"], batch["text"])
                for position, (name, kind) in enumerate(extractor(text))
            ]
            yield pd.DataFrame(rows, columns=["article_id", "position", "name", "type"])

    return texts.select("id", "text").mapInPandas(extract, MENTIONS)


def mention_counts(mentions: DataFrame) -> DataFrame:
    """Mentions found per article, repeated ones included."""
    return mentions.groupBy("article_id").agg(F.count("*").alias("entities"))


def link_entities(
    mentions: DataFrame, entities: DataFrame, links: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """New entities and new article links.

    Names that differ only in case are one entity per type and keep the first
    spelling seen. `entities` and `links` are what is known already.
    """
    # One row per article and entity, combined before the shuffle and written down: what
    # follows reads it twice, and taking mentions out of text is the costly part
    pairs = materialize(
        mentions.groupBy("article_id", entity_key(F.col("name")).alias("key"), "type").agg(
            F.min(F.struct("position", "name")).alias("first")
        ),
        "mention-pairs",
    )
    seen = pairs.groupBy("key", "type").agg(
        F.min(F.struct("article_id", "first.position", "first.name")).alias("first")
    )
    known = entities.groupBy(entity_key(F.col("name")).alias("key"), "type").agg(F.min("id").alias("known_id"))
    keyed = seen.join(known, ["key", "type"], "left")
    next_id = (entities.agg(F.max("id")).first()[0] or 0) + 1
    new = with_sequence(
        keyed.filter("known_id IS NULL").select(
            "key", "type", "first.article_id", "first.position", "first.name"
        ),
        ["article_id", "position"],
        "id",
        next_id,
    )
    ids = (
        keyed.filter("known_id IS NOT NULL")
        .select("key", "type", F.col("known_id").alias("entity_id"))
        .unionByName(new.select("key", "type", F.col("id").alias("entity_id")))
    )
    # The skew of a key that most articles mention is split by the adaptive join
    linked = pairs.join(ids, ["key", "type"]).select("article_id", "entity_id")
    if links is not None:
        linked = linked.join(links, ["article_id", "entity_id"], "left_anti")
    return new.select("id", "name", "type"), linked
