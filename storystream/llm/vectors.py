"""Near-duplicate vectors by sorted projection passes.

In a pass every vector of a label is hashed by the signs of random projections,
taken after the label's mean is off, and the vectors are put in the order of
these hashes one after the other. Vectors of a small angle agree in the first
signs and come to stand close; each is compared with at least WINDOW others on
either side. Verified pairs of all passes together make the components.

The number of passes follows the size of a label and the angle that is left at
the threshold once the mean is off, so that a pair is missed by all of them with
a probability of at most MISS. Where passes would compare as much as all pairs do,
as in labels of a few windows, one pass with a window as wide as the label takes
their place: all pairs, in tiles of bounded size. Links are counted inside the
components afterwards, exactly, so a dense group loses none to the window.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from storystream.llm.links import components
from storystream.operators.numbering import with_sequence
from storystream.session import materialize

COSINE = 0.93
#: Rows on either side that a row is compared with, at least, in a pass
WINDOW = 256
#: Probability that a pair at the threshold meets in no pass
MISS = 0.005
#: Signs of a hash, passes that are sorted at once, and rows of a pass that one task compares
BITS = 62
ROUND_PASSES = 4
PASS_ROWS = 8192
SEED = 20_011
#: Rows of a chunk, and numbers in its vectors, where all pairs are compared
CHUNK_ROWS, CHUNK_VALUES = 16384, 1 << 20
#: Rows of a chunk that are multiplied with the other chunk at once
BLOCK_ROWS = 512


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    # Scaled first: the squares of very large or small numbers would not fit
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _near(x: np.ndarray, y: np.ndarray, x_low: np.ndarray, y_low: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y reach the cosine: in single precision, and again in double where that is too close."""
    product = x_low @ y_low.T
    hits = product >= cosine
    # Beyond the rounding of the product and of its factors
    close = np.abs(product - cosine) <= (x.shape[1] + 8) * 2.0**-23
    for i in np.flatnonzero(close.any(axis=1)):
        j = np.flatnonzero(close[i])
        hits[i, j] = y[j] @ x[i] >= cosine
    return hits


def _tile_links(cosine: float):
    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        low, high = tile["part"].iloc[0]
        same = low == high
        left = tile[tile["chunk"] == low]
        right = tile[tile["chunk"] == high]
        if left.empty or right.empty:
            return pd.DataFrame({"rep": [], "other": [], "links": []}, dtype=np.int64)
        x, y = _unit(left["v"]), _unit(right["v"])
        x_low, y_low = x.astype(np.float32), y.astype(np.float32)
        x_rep, y_rep = left["rep"].to_numpy(), right["rep"].to_numpy()
        x_copies, y_copies = left["copies"].to_numpy(), right["copies"].to_numpy()
        x_links = np.zeros(len(x), np.int64)
        y_links = x_links if same else np.zeros(len(y), np.int64)
        shift = 0 if same else len(x)
        group = np.arange(len(x) + (0 if same else len(y)))
        ends = []
        for start in range(0, len(x), BLOCK_ROWS):
            rows = slice(start, start + BLOCK_ROWS)
            # A pair of one chunk is compared once
            first = start if same else 0
            hits = _near(x[rows], y[first:], x_low[rows], y_low[first:], cosine)
            if same:
                hits = np.triu(hits, 1)
            for i in np.flatnonzero(hits.any(axis=1)):
                j = np.flatnonzero(hits[i]) + first
                i += start
                x_links[i] += y_copies[j].sum()
                y_links[j] += x_copies[i]
                others = group[j + shift]
                apart, at = np.unique(others, return_index=True)
                at = j[at[apart != group[i]]]
                if len(at):
                    ends += [(x_rep[i], y_rep[k]) for k in at]
                    group[np.isin(group, apart)] = group[i]
        found = [(x_rep, x_rep, x_links)] + ([] if same else [(y_rep, y_rep, y_links)])
        if ends:
            a, b = np.array(ends, np.int64).T
            found.append((a, b, np.zeros(len(a), np.int64)))
        rep, other, links = (np.concatenate(c) for c in zip(*found))
        some = (links > 0) | (rep != other)
        return pd.DataFrame({"rep": rep[some], "other": other[some], "links": links[some]})

    return compare


def passes_needed(rows: int, mutual: float, cosine: float, window: int, miss: float) -> int | None:
    """How many passes a label needs; None if all pairs cost no more.

    `mutual` is the squared length of the mean of the label's unit vectors. Off
    the mean, the angle between two vectors at the threshold is wider; they agree
    in a sign with probability 1 - angle / pi, and stand within a window if they
    agree in the signs that leave no more than `window` rows.
    """
    apart = (cosine - mutual) / (1 - mutual) if mutual < cosine else 0.0
    if rows <= 2 * window or apart <= 0:
        return None
    agree = 1 - math.acos(min(1.0, apart)) / math.pi
    meet = agree ** math.log2(rows / window)
    passes = 1 if meet >= 1 else math.ceil(math.log(miss) / math.log1p(-meet))
    return passes if 2 * window * passes < rows else None


def _plan(classes: DataFrame, cosine: float, window: int, miss: float) -> DataFrame:
    """Rows (label, dim, members, passes, mean), one per label and dimension; passes 0 stands for all pairs."""
    label = classes.schema["label"].dataType.simpleString()

    def add(batches):
        sums: dict = {}
        for batch in batches:
            frame = batch.to_pandas()
            for (name, dim), some in frame.groupby(["label", "dim"], sort=False):
                n, total = sums.get((name, dim), (0, 0.0))
                sums[name, dim] = n + len(some), total + _unit(some["v"]).sum(axis=0)
            if len(sums) > BLOCK_ROWS:
                yield out(sums)
                sums = {}
        yield out(sums)

    def out(sums: dict) -> pa.RecordBatch:
        frame = pd.DataFrame(
            [(name, dim, n, total.tolist()) for (name, dim), (n, total) in sums.items()],
            columns=["label", "dim", "members", "total"],
        )
        return pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    ddl = f"label {label}, dim int, members bigint, total array<double>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def settle(parts: pd.DataFrame) -> pd.DataFrame:
        members = int(parts["members"].sum())
        mean = np.sum(sorted(map(tuple, parts["total"])), axis=0) / members
        passes = passes_needed(members, float(mean @ mean), cosine, window, miss)
        return pd.DataFrame(
            {"label": parts["label"].iloc[:1], "dim": parts["dim"].iloc[:1], "members": members,
             "passes": passes or 0, "mean": [mean.tolist()]}
        )

    sums = classes.select("label", "dim", "v").mapInArrow(add, ddl)
    done = sums.groupBy("label", "dim").applyInPandas(
        settle, f"label {label}, dim int, members bigint, passes int, mean array<double>"
    )
    return materialize(done.withColumn("part", F.monotonically_increasing_id()), "vector-plan")


def _projections(number: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, number, dim]).standard_normal((dim, BITS))


def _hashes(first: int):
    """Rows (cls, part, pass, key) of the passes from `first` on."""

    def run(batches):
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            frame = batch.to_pandas()
            for (_, dim), some in frame.groupby(["part", "dim"], sort=False):
                centred = _unit(some["v"]) - np.asarray(some["mean"].iloc[0])
                for number in range(first, min(first + ROUND_PASSES, int(some["passes"].iloc[0]))):
                    signs = centred @ _projections(number, int(dim)) > 0
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some["cls"].to_numpy()),
                            pa.array(some["part"].to_numpy()),
                            pa.array(np.full(len(some), number, np.int32)),
                            pa.array(signs @ weights),
                        ],
                        names=["cls", "part", "pass", "key"],
                    )

    return run


def _forest(rep: np.ndarray, x: np.ndarray, cosine: float, window: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows at most `window` apart."""
    low = x.astype(np.float32)
    group, ends = np.arange(len(x)), []
    for start in range(0, len(x), window):
        first = max(0, start - window)
        rows = slice(start, start + window)
        hits = _near(x[rows], x[first : start + window], low[rows], low[first : start + window], cosine)
        # A pair is compared once, by its later row
        hits = np.tril(hits, start - first - 1)
        for i in np.flatnonzero(hits.any(axis=1)):
            j = np.flatnonzero(hits[i]) + first
            i += start
            apart, at = np.unique(group[j], return_index=True)
            at = j[at[apart != group[i]]]
            if len(at):
                ends += [(int(rep[i]), int(rep[k])) for k in at]
                group[np.isin(group, apart)] = group[i]
    return ends


def _window_links(cosine: float, window: int):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number")
        ends = []
        for _, run in rows.groupby(["part", "pass"], sort=False):
            ends += _forest(run["cls"].to_numpy(), _unit(run["v"]), cosine, window)
        return pd.DataFrame(ends, columns=["rep", "other"], dtype=np.int64)

    return compare


def _pass_links(classes: DataFrame, plan: DataFrame, cosine: float, window: int) -> DataFrame | None:
    """Rows (rep, other): verified pairs of all passes, as forests of the windows; None if no label needs a pass."""
    most = plan.agg(F.max("passes")).first()[0] or 0
    found = None
    for first in range(0, most, ROUND_PASSES):
        open_parts = plan.where(F.col("passes") > first).select("label", "dim", "part", "passes", "mean")
        hashed = classes.join(open_parts, ["label", "dim"]).select("cls", "dim", "part", "passes", "mean", "v")
        keys = hashed.mapInArrow(_hashes(first), "cls bigint, part bigint, pass int, key bigint")
        numbered = with_sequence(keys, ["part", "pass", "key", "cls"], "number")
        chunk = F.floor(F.col("number") / PASS_ROWS)
        # The rows before a cut are also compared with those behind it
        late = F.col("number") % PASS_ROWS >= PASS_ROWS - window
        cut = numbered.withColumn("chunk", F.explode(F.when(late, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
        rows = cut.join(classes.select("cls", "v"), "cls").select("chunk", "number", "part", "pass", "cls", "v")
        links = rows.groupBy("chunk").applyInPandas(_window_links(cosine, window), "rep bigint, other bigint")
        links = materialize(links, "pass-links")
        found = links if found is None else found.unionByName(links)
    return found


def _tiled(rows: DataFrame, by: list[str], chunk_rows: int) -> DataFrame:
    """Rows once for every pair of chunks of their group (`by`, of `members` rows) that they are in."""
    most = F.least(F.lit(chunk_rows), F.greatest(F.lit(BLOCK_ROWS), F.expr(f"{CHUNK_VALUES} div dim")))
    return (
        rows.withColumn("chunks", F.ceil(F.col("members") / most).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .withColumn("part", F.array(F.least("chunk", "other"), F.greatest("chunk", "other")))
        .select(*by, "part", "chunk", "rep", "copies", "v")
    )


def _counted(cosine: float):
    """Links of the members of whole components, or of a tile of one."""
    compare = _tile_links(cosine)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        found = [compare(some) for _, some in rows.groupby("root", sort=False)]
        both = pd.concat(found)
        return both[both["rep"] == both["other"]]

    return count


def _component_links(members: DataFrame, cosine: float, chunk_rows: int) -> DataFrame:
    """Rows (rep, other, links) of classes in components; small components share a task."""
    sizes = materialize(members.groupBy("root").agg(F.count("*").alias("members")), "component-sizes")
    small = sizes.where(F.col("members") <= BLOCK_ROWS).agg(F.sum("members")).first()[0] or 0
    lots = int(small // BLOCK_ROWS + 1)
    lot = F.when(F.col("members") <= BLOCK_ROWS, F.pmod(F.xxhash64("root"), F.lit(lots))).otherwise(-1 - F.col("root"))
    rows = members.join(sizes, "root").withColumn("lot", lot)
    tiles = _tiled(rows, ["lot", "root"], chunk_rows)
    return tiles.groupBy("lot", "part").applyInPandas(_counted(cosine), "rep bigint, other bigint, links bigint")


def near_vectors(
    table: DataFrame,
    cosine: float = COSINE,
    chunk_rows: int = CHUNK_ROWS,
    window: int = WINDOW,
    miss: float = MISS,
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of (vec_id, embedding, label).

    Only vectors of equal label and equal dimension are compared. Null, empty and
    zero vectors, those with null or non-finite components, and those of null
    label link with nothing; a row without id neither, and is never kept.
    Repeated rows count as other vectors; different vectors of one id have their
    own links each. Other columns are ignored; an empty table gives an empty
    result.
    """
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    fine = F.expr(
        "vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0 AND exists(v, x -> x <> 0)"
        " AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    )
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    classes = materialize(
        rows.where("fine").groupBy("label", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
        .withColumns({"cls": F.monotonically_increasing_id(), "dim": F.size("v")}),
        "vector-classes",
    )
    plan = _plan(classes, cosine, window, miss)
    whole = classes.withColumnRenamed("cls", "rep").join(
        plan.where("passes = 0 AND members > 1").select("label", "dim", "members"), ["label", "dim"]
    )
    # A row with two ends is a link of the forest, one with equal ends a count of links
    tiles = materialize(
        _tiled(whole, ["label", "dim"], chunk_rows)
        .groupBy("label", "dim", "part")
        .applyInPandas(_tile_links(cosine), "rep bigint, other bigint, links bigint"),
        "vector-links",
    )
    in_passes = _pass_links(classes, plan, cosine, window)
    edges = tiles.select("rep", "other")
    if in_passes is not None:
        edges = edges.unionByName(in_passes)
    roots = components(edges.select(F.col("rep").alias("a"), F.col("other").alias("b")), "vector-components")
    placed = classes.join(roots, F.col("cls") == F.col("node"), "left").select(
        "label", "dim", "v", "cls", "first_id", "copies", F.coalesce("root", "cls").alias("root")
    )
    if in_passes is not None:
        linked = in_passes.select(F.explode(F.array("rep", "other")).alias("rep")).distinct()
        members = placed.withColumnRenamed("cls", "rep").join(linked, "rep", "left_semi")
        counted = materialize(_component_links(members, cosine, chunk_rows), "component-links")
        tiles = tiles.unionByName(counted)
    links = tiles.groupBy("rep").agg(F.sum("links").alias("links"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component"))
    named = placed.join(least, "root").join(links.withColumnRenamed("rep", "cls"), "cls", "left").select(
        "label", "v", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    found = rows.where("fine").join(named, ["label", "v"])
    rest = rows.where("NOT fine").select("*", F.col("vec_id").alias("component"), F.lit(0).alias("links"))
    result = found.select("vec_id", "component", "links").union(rest.select("vec_id", "component", "links"))
    return result.select(
        "vec_id",
        F.col("links").cast("bigint").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"),
    )
