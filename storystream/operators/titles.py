"""Articles whose titles say the same within a time window."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storystream.functions.fuzzy import Titles, letter_bound, score_bound, scores, token_sort_key
from storystream.operators.tiles import MICROS_PER_HOUR, PARTNERS, all_partners, in_tiles, micros, partners, tiled
from storystream.session import materialize

DUPLICATE_THRESHOLD = 65
PAIR_THRESHOLD = 40
WINDOW_HOURS = 6
# Titles per side of a tile, and pairs compared at a time: they bound a task's memory
CHUNK_ROWS = 2000
PAIR_BATCH = 200_000

SECOND = 1_000_000


# Bands of length that lie between a title and the longest one it can reach the threshold with
BANDS = 4


def _length_band(threshold: float) -> tuple[Column | None, int]:
    """Band of a title's length, and how far apart the bands of titles that reach the threshold can be.

    An LCS is no longer than the shorter title, so a score of s needs lengths
    within a factor of (200 - s) / s. One band more covers rounding.
    """
    if threshold <= 0:
        return None, 0
    step = max(math.log((200 - threshold) / threshold), 0.1) / BANDS if threshold < 200 else 0.1
    length = F.greatest(F.char_length("key"), F.lit(1))
    return F.floor(F.log(length) / F.lit(step)), BANDS + 1


def _keyed(articles: DataFrame, *also: str) -> DataFrame:
    """Dated articles with their token-sorted title."""
    return articles.filter(F.col("published_at").isNotNull()).select(
        "id", micros(F.col("published_at")).alias("t"), token_sort_key(F.col("title")).alias("key"), *also
    )


def _reached_min(data: DataFrame, probes: DataFrame, group: str, backwards: bool) -> DataFrame:
    """Per probe: the smallest id of its `(key, group)` at or after (before) position `pos`.

    Data and probes pass one running window together, so there is no join.
    """
    both = data.select("key", group, "pos", "id").unionByName(
        probes.select("key", group, "pos", "t"), allowMissingColumns=True
    )
    order = F.col("pos").desc() if backwards else F.col("pos").asc()
    reached = Window.partitionBy("key", group).orderBy(order)
    reached = reached.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        both.withColumn("found", F.min("id").over(reached))
        .filter(F.col("t").isNotNull() & F.col("found").isNotNull())
        .select("key", "t", "found")
    )


def first_same_title(keyed: DataFrame, hours: int) -> DataFrame:
    """Per `(key, t)`: smallest id with the same key in [t - hours, t + hours], own id included.

    Buckets are as wide as `hours`, so the bucket of t lies inside the window
    as a whole and the two next to it in part. The partial ones are running
    minima over seconds of a bucket, then over microseconds of the one second
    the window's edge falls into. Ids are first reduced to one per time, so no
    group holds more rows than a bucket has seconds or a second microseconds,
    even when a third of all articles carry one title.
    """
    width = hours * MICROS_PER_HOUR
    repeated = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    fine = (
        keyed.groupBy("key", "t")
        .agg(F.min("id").alias("id"))
        .join(repeated, "key", "left_semi")
        .withColumns({"second": F.floor(F.col("t") / SECOND), "pos": F.col("t")})
    )
    coarse = (
        fine.groupBy("key", "second")
        .agg(F.min("id").alias("id"))
        .withColumns(
            {"bucket": F.floor(F.col("second") * SECOND / F.lit(width)), "pos": F.col("second")}
        )
    )
    whole = coarse.groupBy("key", "bucket").agg(F.min("id").alias("found"))
    found = [fine.withColumn("bucket", F.floor(F.col("t") / F.lit(width))).join(whole, ["key", "bucket"])]
    for sign in (-1, 1):
        backwards = sign < 0
        edge = fine.select("key", "t", (F.col("t") + sign * width).alias("pos")).withColumn(
            "second", F.floor(F.col("pos") / SECOND)
        )
        # Whole seconds of the neighbouring bucket, between it and the edge's own second
        inner = edge.select(
            "key",
            "t",
            (F.floor(F.col("t") / F.lit(width)) + sign).alias("bucket"),
            (F.col("second") - sign).alias("pos"),
        )
        found.append(_reached_min(fine, edge, "second", backwards))
        found.append(_reached_min(coarse, inner, "bucket", backwards))
    every = found[0].select("key", "t", "found")
    for part in found[1:]:
        every = every.unionByName(part)
    return every.groupBy("key", "t").agg(F.min("found").alias("first_id"))


class _TileTitles:
    """Titles of a tile, equal ones encoded and scored once."""

    def __init__(self, left: pd.Series, right: pd.Series):
        self.left_of, left_keys = pd.factorize(left)
        self.right_of, right_keys = pd.factorize(right)
        self.left, self.right = Titles(left_keys), Titles(right_keys)

    def score(self, i: np.ndarray, j: np.ndarray, at_least: float) -> np.ndarray:
        """Scores of the row pairs; 0 where lengths or characters rule out `at_least`."""
        width = len(self.right.lengths)
        distinct, back = np.unique(
            self.left_of[i].astype(np.int64) * width + self.right_of[j], return_inverse=True
        )
        a, b = distinct // width, distinct % width
        keep = np.flatnonzero(score_bound(self.left, self.right, a, b) >= at_least)
        keep = keep[letter_bound(self.left, self.right, a[keep], b[keep]) >= at_least]
        values = np.zeros(len(distinct))
        values[keep] = scores(self.left, self.right, a[keep], b[keep])
        return values[back]


def _window_pairs(left: pd.DataFrame, right: pd.DataFrame, width: int, allowed):
    """Index pairs of a tile inside the time window, a bounded number of left rows at a time."""
    t, times = left["t"].to_numpy(), right["t"].to_numpy()
    rows = max(1, PAIR_BATCH // max(1, len(right)))
    for at in range(0, len(left), rows):
        part = slice(at, at + rows)
        near = np.abs(t[part, None] - times[None, :]) <= width
        i, j = np.nonzero(near & allowed(part))
        if len(i):
            yield i + at, j


def _best_in_tile(hours: int, threshold: float):
    width = hours * MICROS_PER_HOUR

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        titles = _TileTitles(left["key"], right["key"])
        found = []
        for i, j in _window_pairs(left, right, width, lambda p: others[None, :] < ids[p, None]):
            score = titles.score(i, j, threshold)
            kept = score >= threshold
            i, j, score = i[kept], j[kept], score[kept]
            order = np.lexsort((others[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, dtype=int)
            found.append(
                pd.DataFrame({"id": ids[i[first]], "duplicate_of_id": others[j[first]], "score": score[first]})
            )
        empty = pd.DataFrame({"id": [], "duplicate_of_id": [], "score": []})
        return pd.concat(found) if found else empty

    return best


def title_duplicates(
    articles: DataFrame,
    hours: int = WINDOW_HOURS,
    threshold: float = DUPLICATE_THRESHOLD,
    new: Column | None = None,
) -> DataFrame:
    """Per duplicate: the best-scoring article that arrived earlier, ties to the lowest id.

    `articles` needs `id` in arrival order, `title` and `published_at`; undated
    articles neither are duplicates nor have any. With `new`, only those rows
    are checked, against all rows.
    """
    checked = F.lit(True) if new is None else new
    # Both tables are read several times and hold little more than the titles
    keyed = materialize(_keyed(articles.withColumn("checked", checked), "checked"), "titles")
    ours = materialize(
        keyed.filter("checked")
        .join(first_same_title(keyed, hours), ["key", "t"], "left")
        .select("id", "t", "key", F.coalesce("first_id", "id").alias("first_id")),
        "same-titles",
    )
    same = ours.filter("first_id < id").select(
        "id", F.col("first_id").alias("duplicate_of_id"), F.lit(100.0).alias("score")
    )
    # Whatever has an earlier copy is settled; the others can only score below 100
    left, right = tiled(
        ours.filter("first_id = id").select("id", "t", "key"),
        keyed.groupBy("key", "t").agg(F.min("id").alias("id")),
        hours,
        [-1, 0, 1],
        CHUNK_ROWS,
        *_length_band(threshold),
    )
    similar = (
        in_tiles(
            left, right, _best_in_tile(hours, threshold), "id long, duplicate_of_id long, score double"
        )
        .groupBy("id")
        .agg(F.max(F.struct("score", (-F.col("duplicate_of_id")).alias("minus_id"))).alias("best"))
        .select("id", (-F.col("best.minus_id")).alias("duplicate_of_id"), F.col("best.score").alias("score"))
    )
    return same.unionByName(similar)


def _partners_in_tile(hours: int, threshold: float):
    width = hours * MICROS_PER_HOUR

    def found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        t, times = left["t"].to_numpy(), right["t"].to_numpy()
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()

        def later(p):
            gap = times[None, :] - t[p, None]
            return (gap > 0) | ((gap == 0) & (others[None, :] > ids[p, None]))

        titles = _TileTitles(left["key"], right["key"])
        parts = [partners(ids[:0], others[:0], np.empty(0))]
        for i, j in _window_pairs(left, right, width, later):
            score = titles.score(i, j, threshold)
            kept = score > threshold
            parts.append(partners(ids[i[kept]], others[j[kept]], score[kept]))
        return pd.concat(parts)

    return found


def title_partners(
    articles: DataFrame, hours: int = WINDOW_HOURS, threshold: float = PAIR_THRESHOLD
) -> DataFrame:
    """Per article that has any: the best of the later ones, at most `hours` on, whose titles score above the
    threshold, ties to the lowest id, and the number of these partners.

    Every pair is scored, but pairs stay in their tile, so the result grows with
    the articles and not with their pairs.
    """
    keyed = materialize(_keyed(articles), "titles")
    left, right = tiled(keyed, keyed, hours, [0, 1], CHUNK_ROWS, *_length_band(threshold))
    return all_partners(in_tiles(left, right, _partners_in_tile(hours, threshold), PARTNERS))
