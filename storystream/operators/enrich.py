"""Topic, embedding and entities of an article."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storystream.functions.text import classification_text, embedding_text
from storystream.functions.topics import classify_topic
from storystream.operators.entities import extract_mentions, extract_mentions_with
from storystream.operators.gazetteer import gazetteer_mentions

Encoder = Callable[[np.ndarray], np.ndarray]


def with_topic(articles: DataFrame) -> DataFrame:
    return articles.withColumn("topic", classify_topic(classification_text(F.col("title"), F.col("content"))))


def embed_articles(
    articles: DataFrame, make_encoder: Callable[[], Encoder], batch_size: int = 64
) -> DataFrame:
    """Add `embedding`; `make_encoder` loads the model once per Python worker."""
    encode = predict_batch_udf(
        make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return articles.withColumn("embedding", encode(embedding_text(F.col("title"), F.col("content"))))


def with_embeddings(articles: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Add `embedding` from a table of id, embedding; without one it stays NULL."""
    return articles.join(embeddings.select("id", "embedding"), "id", "left")


def mentions(
    articles: DataFrame, make_extractor: Callable | None = None, gazetteer: DataFrame | None = None
) -> DataFrame:
    """Mentions by a model, by a table of names (id, name, type), or by patterns."""
    texts = articles.select("id", classification_text(F.col("title"), F.col("content")).alias("text"))
    if make_extractor:
        return extract_mentions_with(texts, make_extractor)
    if gazetteer is not None:
        return gazetteer_mentions(texts, gazetteer).drop("entity_id")
    return extract_mentions(texts)


def processed_articles(processed: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles that processed messages name, and the messages that name none."""
    found = articles.join(processed.select("id").distinct(), "id", "left_semi")
    missing = processed.join(articles.select("id"), "id", "left_anti")
    return found, missing
