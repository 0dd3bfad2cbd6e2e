"""Stories: articles grouped by links to the most similar article that arrived before.

An article is linked to the earlier arrival whose embedding is closest to its own,
among those at most `hours` away in time, if the cosine reaches the threshold;
a story is what links connect, and its id is that of its first article. The rule
looks at pairs only, so it does not depend on an order of processing: a batch, a
stream of batches and a replay give the same stories. The pairs are compared in
tiles that return one row per article, and stories are named by pointer jumping,
whose number of steps is the logarithm of the longest chain of links.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storystream.functions.text import article_time
from storystream.functions.vectors import is_usable, l2_normalize
from storystream.operators.pairs import BLOCK_ROWS, matrix
from storystream.operators.tiles import MICROS_PER_HOUR, in_tiles, micros, tiled
from storystream.session import materialize

STORY_THRESHOLD = 0.6
WINDOW_HOURS = 24
CHUNK_ROWS = 2000
# Cosines are compared to so many digits, so that ties do not hang on the order of a sum
DIGITS = 12


@dataclass
class Assignment:
    """What is known of articles after grouping them; nothing is written."""

    members: DataFrame  # article_id, story_id, similarity, status
    rejected: DataFrame  # id, reason


def timed_units(articles: DataFrame) -> DataFrame:
    """Articles with a usable embedding, as id, t (microseconds) and unit vector."""
    return articles.filter(is_usable(F.col("embedding"))).select(
        "id",
        micros(article_time(F.col("published_at"), F.col("created_at"))).alias("t"),
        l2_normalize(F.col("embedding")).alias("unit"),
    )


def _partner_in_tile(width: int, threshold: float):
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("id")
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        t, times = left["t"].to_numpy(), right["t"].to_numpy()
        a, b = matrix(left["unit"]), matrix(right["unit"])
        found = []
        for at in range(0, len(left) if len(right) else 0, BLOCK_ROWS):
            part = slice(at, at + BLOCK_ROWS)
            cosine = np.round(a[part] @ b.T, DIGITS)
            near = np.abs(times[None, :] - t[part, None]) <= width
            cosine[~near | (others[None, :] >= ids[part, None])] = -np.inf
            first = cosine.argmax(axis=1)
            value = cosine[np.arange(len(first)), first]
            hit = value >= threshold
            found.append(
                pd.DataFrame({"article_id": ids[part][hit], "partner_id": others[first[hit]], "similarity": value[hit]})
            )
        empty = pd.DataFrame({"article_id": [], "partner_id": [], "similarity": []})
        return pd.concat(found) if found else empty

    return best


def best_partners(
    new: DataFrame, units: DataFrame, threshold: float = STORY_THRESHOLD, hours: float = WINDOW_HOURS
) -> DataFrame:
    """Rows (article_id, partner_id, similarity): the closest earlier arrival, ties to the lowest id.

    `new` and `units` are rows of `timed_units`; articles without a partner in
    reach of the threshold have no row.
    """
    tiles = tiled(new, units, max(1, round(hours)), [-1, 0, 1], CHUNK_ROWS)
    best = F.max(F.struct("similarity", (-F.col("partner_id")).alias("minus_id"))).alias("best")
    inside = _partner_in_tile(int(hours * MICROS_PER_HOUR), threshold)
    return (
        in_tiles(*tiles, inside, "article_id long, partner_id long, similarity double")
        .groupBy("article_id")
        .agg(best)
        .select(
            "article_id",
            (-F.col("best.minus_id")).alias("partner_id"),
            F.col("best.similarity").alias("similarity"),
        )
    )


def first_articles(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Links with `first_id`, the article at the end of the chain of partners.

    Every step joins each article with its end so far to the end's own end, so
    the reach doubles; links lead to lower ids, so there are no circles.
    """
    by = by or []
    ends = materialize(links.withColumn("first_id", F.col("partner_id")), "chains")
    while True:
        step = ends.select(*by, F.col("article_id").alias("first_id"), F.col("first_id").alias("next_id"))
        longer = materialize(
            ends.join(step, [*by, "first_id"], "left").select(
                *by, "article_id", "partner_id", "similarity",
                F.coalesce("next_id", "first_id").alias("first_id"),
                F.col("next_id").isNotNull().alias("moved"),
            ),
            "chains",
        )
        ends = longer.drop("moved")
        if longer.filter("moved").isEmpty():
            return ends


def rejected_articles(articles: DataFrame) -> DataFrame:
    reason = F.when(F.col("embedding").isNull(), "no embedding").otherwise("zero embedding")
    return articles.filter(~is_usable(F.col("embedding"))).select("id", reason.alias("reason"))


def assign_stories(
    articles: DataFrame,
    members: DataFrame | None = None,
    threshold: float = STORY_THRESHOLD,
    hours: float = WINDOW_HOURS,
) -> Assignment:
    """Stories of all articles; those in `members` (article_id, story_id, similarity) keep theirs.

    An article without a usable embedding gets no story and is rejected with a reason.
    """
    units = materialize(timed_units(articles), "units")
    new = units
    if members is not None:
        new = units.join(members.select(F.col("article_id").alias("id")), "id", "left_anti")
    chains = first_articles(best_partners(new, units, threshold, hours))
    found = new.select(F.col("id").alias("article_id")).join(
        chains.select("article_id", "first_id", "similarity"), "article_id", "left"
    ).select("article_id", F.coalesce("first_id", "article_id").alias("first_id"), "similarity")
    status = F.when(F.col("similarity").isNull(), "created").otherwise("joined").alias("status")
    rejected = rejected_articles(articles)
    if members is None:
        return Assignment(found.select("article_id", F.col("first_id").alias("story_id"), "similarity", status), rejected)
    known = members.select(F.col("article_id").alias("first_id"), "story_id")
    joined = found.join(known, "first_id", "left").select(
        "article_id", F.coalesce("story_id", "first_id").alias("story_id"), "similarity", status
    )
    kept = members.select("article_id", "story_id", "similarity", F.lit("existing").alias("status"))
    return Assignment(joined.unionByName(kept), rejected)


def threshold_sweep(
    articles: DataFrame, thresholds: list[float], hours: float = WINDOW_HOURS
) -> DataFrame:
    """Memberships of dated articles at several thresholds: threshold, article_id, story_id, similarity.

    The best partner is the same at all thresholds, so the pairs are compared once.
    """
    units = materialize(timed_units(articles.filter(F.col("published_at").isNotNull())), "units")
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    best = best_partners(units, units, min(thresholds), hours)
    links = best.select(levels, "*").filter("similarity >= threshold")
    chains = first_articles(links, ["threshold"]).drop("partner_id")
    return (
        units.select(levels, F.col("id").alias("article_id"))
        .join(chains, ["threshold", "article_id"], "left")
        .select("threshold", "article_id", F.coalesce("first_id", "article_id").alias("story_id"), "similarity")
    )


def story_states(members: DataFrame, articles: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows (id, centroid, article_count, first_at, newest_at) of the stories that `members` belong to.

    `known` are earlier states of those stories, without these members. Vectors
    are summed by story and dimension, so no story is gathered in one place.
    """
    time = article_time(F.col("published_at"), F.col("created_at"))
    rows = members.select(F.col("story_id").alias("id"), "article_id").join(
        articles.select(F.col("id").alias("article_id"), time.alias("t"), l2_normalize(F.col("embedding")).alias("unit")),
        "article_id",
    )
    parts = rows.select("id", F.posexplode("unit").alias("dimension", "x"))
    counts = rows.groupBy("id").agg(
        F.count("*").alias("article_count"), F.min("t").alias("first_at"), F.max("t").alias("newest_at")
    )
    if known is not None:
        touched = known.join(counts.select("id"), "id", "left_semi")
        old = touched.select("id", "article_count", F.posexplode("centroid").alias("dimension", "x"))
        parts = parts.unionByName(old.select("id", "dimension", (F.col("x") * F.col("article_count")).alias("x")))
        counts = (
            counts.unionByName(touched.select("id", "article_count", "first_at", "newest_at"))
            .groupBy("id")
            .agg(
                F.sum("article_count").alias("article_count"),
                F.min("first_at").alias("first_at"),
                F.max("newest_at").alias("newest_at"),
            )
        )
    sums = parts.groupBy("id", "dimension").agg(F.sum("x").alias("x"))
    vectors = sums.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dimension", "x"))).alias("sums"))
    return counts.join(vectors, "id").select(
        "id",
        F.transform("sums", lambda d: d["x"] / F.col("article_count")).alias("centroid"),
        "article_count",
        "first_at",
        "newest_at",
    )


def cluster_size_report(sizes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Stories, those of one article, those of more, and the largest; `sizes` has `size`."""
    return sizes.groupBy(*(by or [])).agg(
        F.count("*").alias("stories"),
        F.count_if(F.col("size") == 1).alias("size_1"),
        F.count_if(F.col("size") > 1).alias("size_2_plus"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest"),
    )


def threshold_compare(low: DataFrame, high: DataFrame) -> DataFrame:
    """Stories of two or more at the low threshold that do not stay whole at the high one.

    Both sides have article_id, story. A story is "split" when at least two of
    its parts have two or more articles, else "shrunk".
    """
    parts = (
        low.select("article_id", F.col("story").alias("low_story"))
        .join(high.select("article_id", F.col("story").alias("high_story")), "article_id")
        .groupBy("low_story", "high_story")
        .agg(F.count("*").alias("part"))
    )
    return (
        parts.groupBy("low_story")
        .agg(
            F.sum("part").alias("articles"),
            F.count("*").alias("parts"),
            F.when(F.count_if(F.col("part") >= 2) >= 2, "split").otherwise("shrunk").alias("kind"),
        )
        .filter("articles >= 2 AND parts > 1")
    )


def compared_members(low: DataFrame, high: DataFrame) -> DataFrame:
    """Members of the stories that change, with both similarities and the high story's size."""
    changed = threshold_compare(low, high).select("low_story", "kind")
    sizes = high.groupBy("story").agg(F.count("*").alias("high_size"))
    high_side = high.join(sizes, "story").select(
        "article_id",
        F.col("story").alias("high_story"),
        F.col("similarity").alias("high_similarity"),
        "high_size",
    )
    low_side = low.select(
        "article_id", F.col("story").alias("low_story"), F.col("similarity").alias("low_similarity")
    )
    return low_side.join(changed, "low_story").join(high_side, "article_id")


def story_centroids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean of the members' unit vectors, one row per story and dimension.

    Positions are aggregated on their own, so a large story is summed in every
    task that holds some of its members.
    """
    return (
        members.join(vectors.select(F.col("id").alias("article_id"), "embedding"), "article_id")
        .select("story_id", F.posexplode(l2_normalize(F.col("embedding"))).alias("dimension", "x"))
        .groupBy("story_id", "dimension")
        .agg(F.avg("x").alias("mean"))
    )


def status_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("status").agg(F.count("*").alias("articles"))
