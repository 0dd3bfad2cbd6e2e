"""Sharding by histogram sort: exact splitters by counting, then one exchange.

Documents are ordered by (hash of the text, id), so equal texts lie together and
a group of copies can still be cut anywhere between two ids. Candidate keys are
drawn, the bytes below each are counted exactly over all partitions, and the
brackets around the wanted splitters are refined with further candidates until
every splitter meets the tolerance or its bracket holds no more keys. The counts
also cut each shard into blocks whose first slot is known, so rows go through one
exchange, by block, and are numbered inside blocks of bounded size.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storystream.session import materialize

SHARDS = 16
#: A shard may miss its equal share by this part of it, where single rows allow
TOLERANCE = 0.001
#: Candidates of a round, at least; more if blocks would hold more than BLOCK_BYTES
PROBES = 2048
BLOCK_BYTES = 64 << 20


def key_of(doc_id, text):
    """32 hexadecimal digits that order by text first and by id then; a null id comes first."""
    part = lambda value: F.lpad(F.hex(value), 16, "0")
    return F.concat(part(F.xxhash64(text)), F.coalesce(part(doc_id.cast("bigint")), F.lit("")))


def size_of(text):
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text).cast("bigint"), F.lit(0).cast("bigint")) + F.lit(1)


def bucket_udf(keys: list[str]):
    """Number of the given sorted keys that are not above a row's key."""
    edges = np.array([k.encode() for k in keys], dtype="S32")

    @F.pandas_udf("int")
    def bucket(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, values.to_numpy().astype("S32"), side="right"))

    return bucket


@dataclass
class Histogram:
    """Exact bytes and rows below known keys."""

    total: tuple[int, int]
    below: dict[str, tuple[int, int]] = field(default_factory=dict)
    keys: list[str] = field(default_factory=list)  # sorted
    sizes: list[int] = field(default_factory=list)  # bytes below each of them

    def add(self, counted: dict[str, tuple[int, int]]) -> None:
        self.below |= counted
        self.keys = sorted(self.below)
        self.sizes = [self.below[k][0] for k in self.keys]

    def bracket(self, target: float) -> tuple[str | None, str | None]:
        """The known keys next to where `target` bytes lie below."""
        at = bisect_right(self.sizes, target)
        return (self.keys[at - 1] if at else None), (self.keys[at] if at < len(self.keys) else None)

    def rows_between(self, low: str | None, high: str | None) -> int:
        """Rows from one known key up to another; None is the end on its side."""
        upper = self.total[1] if high is None else self.below[high][1]
        return upper - (0 if low is None else self.below[low][1])

    def splitter(self, target: float) -> tuple[str | None, float]:
        """The known key whose bytes below are nearest to the target (None: above all), and by how much they miss it."""
        low, high = self.bracket(target)
        ends = [(abs(self.below[k][0] - target), k) for k in (low, high) if k is not None]
        if high is None:
            ends.append((abs(self.total[0] - target), None))
        miss, key = min(ends, key=lambda e: e[0])
        return key, miss


def _count(narrow: DataFrame, keys: list[str]) -> dict[str, tuple[int, int]]:
    """Exact (bytes, rows) below each of the sorted keys: one pass, one sum per bucket."""
    sums = (
        narrow.groupBy(bucket_udf(keys)("key").alias("bucket"))
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .collect()
    )
    size, rows = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
    for r in sums:
        size[r.bucket], rows[r.bucket] = r.bytes, r.rows
    return {k: (int(b), int(n)) for k, b, n in zip(keys, np.cumsum(size), np.cumsum(rows))}


def _draw(narrow: DataFrame, rows: int, count: int, turn: int) -> list[str]:
    """About `count` distinct keys, spread like the `rows` rows; none only if there is none.

    Keys are chosen where they are, by a bound on their hash. Copies of a key are
    chosen together and sent once. Where copies make up most of the rows, so that
    a bound finds nothing, it is raised until it lets every key through.
    """
    share = 1.1 * count / max(rows, 1)
    while True:
        chance = F.shiftrightunsigned(F.xxhash64("key", F.lit(turn)), 11)  # evenly below 2**53
        chosen = narrow.where(chance < int(min(share, 1.0) * 2**53)).select("key").distinct()
        drawn = sorted(r.key for r in chosen.collect())
        if drawn or share >= 1:
            return drawn
        share *= 64


def measure(narrow: DataFrame, shards: int, tolerance: float, probes: int) -> Histogram:
    """Refine candidates until every splitter is within tolerance or its bracket is used up."""
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    probes = max(probes, total[0] // BLOCK_BYTES)
    known = Histogram((int(total[0]), int(total[1])))
    open_rows, rows, turn = narrow, known.total[1], 0
    while True:
        drawn = _draw(open_rows, rows, probes, turn)
        if not drawn:
            return known
        known.add(_count(narrow, drawn))
        brackets = set()
        for s in range(1, shards):
            target = known.total[0] * s / shards
            if known.splitter(target)[1] > tolerance * known.total[0] / shards:
                brackets.add(known.bracket(target))
        if not brackets:
            return known
        inside = F.lit(False)
        for low, high in brackets:
            within = F.lit(True) if low is None else F.col("key") > low
            inside = inside | (within if high is None else within & (F.col("key") < high))
        open_rows, rows = narrow.where(inside), sum(known.rows_between(*b) for b in brackets)
        turn += 1


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    tolerance: float = TOLERANCE,
    probes: int = PROBES,
    names: tuple[str, str] = ("shard", "slot"),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """`docs` with a shard from 0 and a slot without gaps from 0 in it, named by `names`.

    Shards are ranges of keys of nearly equal bytes. Null and empty texts weigh
    one byte; null ids are allowed; rows equal in id and text have one key and
    stay in one shard, in any order. Columns of `docs` that have these names
    already are replaced. An empty table gives an empty result.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    keyed = docs.select(
        F.struct(*kept).alias("doc"),
        key_of(F.col(id_column), F.col(text_column)).alias("key"),
        size_of(F.col(text_column)).alias("size"),
    )
    narrow = materialize(keyed.select("key", "size"), "shard-keys")
    known = measure(narrow, shards, tolerance, probes)
    cuts = [known.splitter(known.total[0] * s / shards)[0] for s in range(1, shards)]
    cuts = sorted(k for k in cuts if k is not None)

    # Every known key may start a block; as many are used as blocks are wanted
    wanted = max(shards * 16, known.total[0] // BLOCK_BYTES)
    thinned = known.keys[:: max(1, len(known.keys) // wanted)]
    starts = sorted({*thinned, *cuts})
    shard_of = [0, *(bisect_right(cuts, k) for k in starts)]
    first = {0: 0} | {s: known.below[cuts[s - 1]][1] for s in range(1, len(cuts) + 1)}
    before = [0, *(known.below[k][1] for k in starts)]
    slots = np.array([b - first[s] for b, s in zip(before, shard_of)], np.int64)
    edges, owners = np.array([k.encode() for k in starts], dtype="S32"), np.array(shard_of, np.int32)

    @F.pandas_udf("block int, shard int, first bigint")
    def place(values: pd.Series) -> pd.DataFrame:
        block = np.searchsorted(edges, values.to_numpy().astype("S32"), side="right")
        return pd.DataFrame({"block": block.astype(np.int32), "shard": owners[block], "first": slots[block]})

    order = Window.partitionBy("place.block").orderBy("key")
    return (
        keyed.withColumn("place", place("key"))
        .withColumn("row", F.row_number().over(order))
        .select(
            "doc.*",
            F.col("place.shard").alias(names[0]),
            (F.col("place.first") + F.col("row") - 1).alias(names[1]),
        )
    )
