"""Pairs of articles close in time whose embeddings point the same way."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storystream.functions.fuzzy import token_sort_ratio
from storystream.functions.vectors import l2_normalize
from storystream.operators.tiles import MICROS_PER_HOUR, PARTNERS, all_partners, in_tiles, micros, partners, tiled
from storystream.session import materialize

COSINE_THRESHOLD = 0.5
WINDOW_HOURS = 6
CHUNK_ROWS = 2000
DIGITS = 12
# Left rows multiplied with a whole chunk at a time
BLOCK_ROWS = 250


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.empty((0, 0))


def _matches(left: pd.DataFrame, right: pd.DataFrame, width: int, threshold: float):
    """Row numbers and cosines of a tile's matching pairs, a block of left rows at a time."""
    t, times = left["t"].to_numpy(), right["t"].to_numpy()
    ids, others = left["id"].to_numpy(), right["id"].to_numpy()
    a, b = matrix(left["unit"]), matrix(right["unit"])
    for at in range(0, len(left) if len(right) else 0, BLOCK_ROWS):
        part = slice(at, at + BLOCK_ROWS)
        gap = times[None, :] - t[part, None]
        later = (gap > 0) | ((gap == 0) & (others[None, :] > ids[part, None]))
        cosine = a[part] @ b.T
        i, j = np.nonzero(later & (gap <= width) & (cosine >= threshold))
        yield i + at, j, cosine[i, j]


def _partners_in_tile(hours: int, threshold: float):
    width = hours * MICROS_PER_HOUR

    def found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        parts = [partners(ids[:0], others[:0], np.empty(0))]
        for i, j, cosine in _matches(left, right, width, threshold):
            # Rounded, as the order of a sum must not decide between equal vectors
            parts.append(partners(ids[i], others[j], np.round(cosine, DIGITS)))
        return pd.concat(parts)

    return found


def _count_in_tile(hours: int, threshold: float):
    width = hours * MICROS_PER_HOUR

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [sum(len(i) for i, _, _ in _matches(left, right, width, threshold))]})

    return count


def _tiles(articles: DataFrame, hours: int) -> tuple[DataFrame, DataFrame]:
    units = articles.filter(F.col("published_at").isNotNull() & F.col("embedding").isNotNull()).select(
        "id", micros(F.col("published_at")).alias("t"), l2_normalize(F.col("embedding")).alias("unit")
    )
    units = materialize(units, "units")
    return tiled(units, units, hours, [0, 1], CHUNK_ROWS)


def cosine_partners(
    articles: DataFrame, hours: int = WINDOW_HOURS, threshold: float = COSINE_THRESHOLD
) -> DataFrame:
    """Per article that has any: the best of the later ones, at most `hours` on, with at least the threshold's
    cosine, ties to the lowest id, and the number of these partners.

    Only dated articles with an embedding take part. The products of a tile are
    one matrix multiplication; the pairs stay in the tile.
    """
    tiles = _tiles(articles, hours)
    return all_partners(in_tiles(*tiles, _partners_in_tile(hours, threshold), PARTNERS))


def cosine_pair_count(
    articles: DataFrame, hours: int = WINDOW_HOURS, threshold: float = COSINE_THRESHOLD
) -> DataFrame:
    """How many pairs are as near as `cosine_partners` asks, counted inside the tiles."""
    counts = in_tiles(*_tiles(articles, hours), _count_in_tile(hours, threshold), "n long")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


def with_titles(pairs: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles and partners with both sides' title and source name, and the score of the titles."""
    named = articles.join(sources, articles["source_id"] == sources["id"]).select(
        articles["id"], articles["title"], sources["name"].alias("source")
    )
    for key, side in (("id", "a"), ("partner_id", "b")):
        columns = {"id": key, "title": f"title_{side}", "source": f"source_{side}"}
        pairs = pairs.join(named.select([F.col(c).alias(n) for c, n in columns.items()]), key)
    return pairs.withColumn("title_score", token_sort_ratio(F.col("title_a"), F.col("title_b")))
