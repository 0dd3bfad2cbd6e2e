"""Range joins in time as tiles of bounded size.

Catalyst has no range join, so both sides are cut into buckets at least as wide as
the time window; a row only meets rows of its own and the neighbouring buckets.
Where windows hold few rows a bucket covers several, because each tile has a
fixed cost that would exceed its comparisons.
A bucket with many rows is cut further into chunks, by a band that matching rows
must share (such as length) where there is one and by a hash of the id, and every
pair of chunks that can match becomes one tile. A tile therefore holds about
2 * `chunk_rows` rows however many rows fall into one bucket, and the work of a
hot bucket spreads over as many tasks as it has tiles. The comparison itself
happens inside the tile, which returns only the pairs that pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
TILE = ["bucket", "reach", "left_chunk", "right_chunk"]
# A bucket is widened until the bucket of an average row holds about so many
BUCKET_ROWS = 500
PARTNERS = "id long, partner_id long, score double, partners long"


def micros(time: Column) -> Column:
    """Timestamp, with or without zone, as microseconds in UTC."""
    return F.unix_micros(time.cast("timestamp"))


def _chunked(df: DataFrame, width: int, chunk_rows: int, band: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with bucket and chunk number; per bucket and chunk its lowest and highest band.

    The chunks of a bucket follow its bands. A band that fills more than a chunk
    is dealt over its chunks by a hash of the id. Windows run over counts only.
    """
    bucketed = df.withColumns({"bucket": F.floor(F.col("t") / F.lit(width)), "band": band})
    upto = Window.partitionBy("bucket").orderBy("band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = (
        bucketed.groupBy("bucket", "band")
        .agg(F.count("*").alias("n"))
        .withColumn("through", F.sum("n").over(upto))
        .select(
            "bucket",
            "band",
            F.floor((F.col("through") - F.col("n")) / F.lit(chunk_rows)).alias("first"),
            F.floor((F.col("through") - 1) / F.lit(chunk_rows)).alias("last"),
        )
    )
    chunks = (
        counts.select("bucket", "band", F.explode(F.sequence("first", "last")).alias("chunk"))
        .groupBy("bucket", "chunk")
        .agg(F.min("band").alias("low"), F.max("band").alias("high"))
    )
    dealt = F.col("first") + F.pmod(F.xxhash64("id"), F.col("last") - F.col("first") + 1)
    rows = bucketed.join(counts, ["bucket", "band"]).withColumn("chunk", dealt)
    return rows.drop("band", "first", "last"), chunks


def bucket_width(rows: DataFrame, hours: int) -> int:
    """Microseconds of a bucket: the window times a whole number, 1 unless the rows (`t`) lie thinly.

    The mean is over rows, so that a crowded time counts by its rows and keeps
    buckets narrow; rows of one time cost more comparisons in a wide bucket.
    """
    width = hours * MICROS_PER_HOUR
    sizes = rows.groupBy(F.floor(F.col("t") / F.lit(width)).alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    mean = sizes.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
    return width * max(1, int(BUCKET_ROWS / mean)) if mean else width


def tiled(
    left: DataFrame,
    right: DataFrame,
    hours: int,
    reaches: list[int],
    chunk_rows: int,
    band: Column | None = None,
    meets: int = 0,
    widen: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Both sides, each row once for every tile it takes part in.

    `left` and `right` need `id` and `t` (microseconds). `reaches` are the
    distances in buckets from a left row to the right rows it may match. With
    `band`, a whole number, rows may match only if their bands are at most `meets`
    apart: a crowded bucket is cut by band, and chunks too far apart share no tile.
    Buckets are widened where `right` is thin, which takes a count of its rows;
    without `widen` they are `hours` wide.
    """
    width = bucket_width(right, hours) if widen else hours * MICROS_PER_HOUR
    band = F.lit(0) if band is None else band
    # New column identities, so that a table can be tiled against itself
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    left_rows, left_chunks = _chunked(left, width, chunk_rows, band)
    right_rows, right_chunks = _chunked(right, width, chunk_rows, band)
    reach = F.explode(F.array(*[F.lit(r) for r in reaches])).alias("reach")

    theirs = right_chunks.select(
        F.col("bucket").alias("right_bucket"),
        F.col("chunk").alias("right_chunk"),
        F.col("low").alias("right_low"),
        F.col("high").alias("right_high"),
    )
    tiles = (
        left_chunks.select("*", reach)
        .withColumn("right_bucket", F.col("bucket") + F.col("reach"))
        .join(theirs, "right_bucket")
        .filter((F.col("low") <= F.col("right_high") + meets) & (F.col("right_low") <= F.col("high") + meets))
        .select(F.col("chunk").alias("left_chunk"), "bucket", "reach", "right_bucket", "right_chunk")
    )
    left_tiles = left_rows.withColumnRenamed("chunk", "left_chunk").join(
        tiles.drop("right_bucket"), ["bucket", "left_chunk"]
    )
    right_tiles = (
        right_rows.withColumnsRenamed({"bucket": "right_bucket", "chunk": "right_chunk"})
        .join(tiles, ["right_bucket", "right_chunk"])
        .drop("right_bucket")
    )
    # Both sides hold columns of the table of tiles, so one of them gets new ones once more
    return left_tiles, right_tiles.select(*[F.col(c).alias(c) for c in right_tiles.columns])


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partition by the keys into as many partitions as shuffles have.

    A tile's work is the product of its sides, so the adaptive merging of
    partitions that are small in bytes would leave cores idle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_tiles(left: DataFrame, right: DataFrame, fn, schema: str, keys: list[str] = TILE) -> DataFrame:
    """Apply `fn` to both sides of every tile."""
    grouped = spread(left, keys).groupBy(*keys)
    return grouped.cogroup(spread(right, keys).groupBy(*keys)).applyInPandas(fn, schema)


def partners(row: np.ndarray, partner: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    """Per row of some pairs: its best partner, ties to the lowest id, and how many it has."""
    order = np.lexsort((partner, -score, row))
    row, partner, score = row[order], partner[order], score[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, dtype=int)
    return pd.DataFrame(
        {
            "id": row[first],
            "partner_id": partner[first],
            "score": score[first],
            "partners": np.diff(np.r_[first, len(row)]),
        }
    )


def all_partners(found: DataFrame) -> DataFrame:
    """The partners that tiles found, put together: one row per article."""
    best = F.max(F.struct("score", (-F.col("partner_id")).alias("minus_id")))
    return (
        found.groupBy("id")
        .agg(best.alias("best"), F.sum("partners").alias("partners"))
        .select("id", (-F.col("best.minus_id")).alias("partner_id"), F.col("best.score").alias("score"), "partners")
    )
