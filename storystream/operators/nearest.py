"""The story an article is closest to, among those active around its time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storystream.functions.text import article_time
from storystream.functions.vectors import is_usable, l2_normalize
from storystream.operators.pairs import BLOCK_ROWS, matrix
from storystream.operators.tiles import MICROS_PER_HOUR, in_tiles, micros, tiled

WINDOW_HOURS = 24
CHUNK_ROWS = 2000


def _closest_in_tile(hours: int):
    width = hours * MICROS_PER_HOUR

    def closest(articles: pd.DataFrame, stories: pd.DataFrame) -> pd.DataFrame:
        stories = stories.sort_values("id")
        ids, t = articles["id"].to_numpy(), articles["t"].to_numpy()
        story_ids, newest = stories["id"].to_numpy(), stories["t"].to_numpy()
        a, b = matrix(articles["unit"]), matrix(stories["unit"])
        found = []
        for at in range(0, len(articles), BLOCK_ROWS):
            part = slice(at, at + BLOCK_ROWS)
            sims = a[part] @ b.T if len(stories) else np.empty((len(ids[part]), 0))
            sims[np.abs(newest[None, :] - t[part, None]) > width] = -np.inf
            if sims.shape[1]:
                best = sims.argmax(axis=1)
                value = sims[np.arange(len(best)), best]
                near = np.isfinite(value)
                found.append(
                    pd.DataFrame(
                        {
                            "article_id": ids[part][near],
                            "story_id": story_ids[best[near]],
                            "similarity": value[near],
                        }
                    )
                )
        empty = pd.DataFrame({"article_id": [], "story_id": [], "similarity": []})
        return pd.concat(found) if found else empty

    return closest


def nearest_stories(articles: DataFrame, stories: DataFrame, hours: int = WINDOW_HOURS) -> DataFrame:
    """Per article its most similar active story, ties to the lowest id.

    `stories` has id, centroid and newest_at. Each tile gives one row per
    article; the best of them is found with a combining aggregate.
    """
    left = articles.filter(is_usable(F.col("embedding"))).select(
        "id",
        micros(article_time(F.col("published_at"), F.col("created_at"))).alias("t"),
        l2_normalize(F.col("embedding")).alias("unit"),
    )
    right = stories.filter(is_usable(F.col("centroid"))).select(
        "id", micros(F.col("newest_at")).alias("t"), l2_normalize(F.col("centroid")).alias("unit")
    )
    tiles = tiled(left, right, hours, [-1, 0, 1], CHUNK_ROWS)
    best = F.max(F.struct("similarity", (-F.col("story_id")).alias("minus_id"))).alias("best")
    return (
        in_tiles(*tiles, _closest_in_tile(hours), "article_id long, story_id long, similarity double")
        .groupBy("article_id")
        .agg(best)
        .select(
            "article_id",
            (-F.col("best.minus_id")).alias("story_id"),
            F.col("best.similarity").alias("similarity"),
        )
    )
