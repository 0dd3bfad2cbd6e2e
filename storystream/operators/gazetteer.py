"""Entity mentions by a table of names: runs of words that are a name, leftmost first, longest first.

The words of a text and of a name are what letters, digits and underscores make
up, in lower case. The runs of words of a text, of every length that names have,
pass a bounded table of bits where they are, so that only those that are a name,
and a few more by chance, go on. Those whose first word starts some name meet
the names in an equality join. Up to a bound the names are sent to the runs;
above it both are shuffled. Of overlapping runs the leftmost counts, of those
that start together the longest: the runs of an article are brought together,
packed as lists, and walked in order.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from storystream.session import materialize

WORD = r"[\p{L}\p{N}_]+"

#: Bits of the table, 8 MB; a name sets two. With very many names it only lets more runs through
BITS = 1 << 26
#: Words whose runs are looked up at once, and runs walked at once, if they are not of one article
SLICE = 1 << 18
#: Names of so many characters in all, about a million, are broadcast
BROADCAST_CHARACTERS = 1 << 24
#: Odd, so that it has an inverse modulo 2**64
_FACTOR = 0x9E3779B97F4A7C15


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


def _names(entities: DataFrame) -> DataFrame:
    """Rows (gram, n, entity, number): the entity of the lowest id for each run of words, written once."""
    words = entities.select("id", "name", "type", words_of(F.col("name")).alias("words")).where("id IS NOT NULL AND size(words) > 0")
    names = words.groupBy(F.array_join("words", " ").alias("gram"), F.size("words").alias("n")).agg(
        F.min(F.struct(F.col("id").alias("entity_id"), "name", "type")).alias("entity")
    )
    return materialize(names.withColumn("number", F.monotonically_increasing_id()), "names")


def _sent(names: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What marks columns of `names` for broadcast, up to the bound."""
    characters = names.agg(F.sum(F.length("gram"))).first()[0] or 0
    return F.broadcast if characters <= BROADCAST_CHARACTERS else lambda columns: columns


def _sums(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the words' hashes times powers of a factor, and the inverse powers.

    Modulo 2**64, (sums[i + n] - sums[i]) * inverse[i] is a hash of the n words from i on, wherever they stand.
    """
    coded = words.dictionary_encode()
    each = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    powers, inverse = (
        np.cumprod(np.append(np.uint64(1), np.full(len(words), factor, np.uint64)))
        for factor in (_FACTOR, pow(_FACTOR, -1, 1 << 64))
    )
    hashes = each[coded.indices.to_numpy()] * powers[:-1] if len(words) else np.zeros(0, np.uint64)
    return np.append(np.uint64(0), np.cumsum(hashes, dtype=np.uint64)), inverse


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hashes % BITS, (hashes >> 32) % BITS


def _slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose `sizes` sum to SLICE at most, or one row."""
    bounds, first = np.append(0, np.cumsum(sizes)), 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _sizes(lists: pa.Array) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def _rows(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _name_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bit): the two bits of each name."""
    for batch in batches:
        words = pc.split_pattern(batch.column(0), " ")
        bounds = words.offsets.to_numpy()
        sums, inverse = _sums(words.flatten())
        hashes = (sums[bounds[1:]] - sums[bounds[:-1]]) * inverse[bounds[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(hashes)).astype(np.int64))], names=["bit"])


def _table(names: DataFrame) -> np.ndarray:
    """The table of the names' bits."""
    at = F.col("bit") + 1
    # Bits go to their bucket one by one: a partial bitmap is as large as a whole one
    buckets = (
        names.select("gram")
        .mapInArrow(_name_bits, "bit bigint")
        .withColumn("bucket", F.bitmap_bucket_number(at))
        .repartition("bucket")
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    )
    table = np.zeros(BITS // 8, np.uint8)
    for row in buckets.collect():
        part = np.frombuffer(bytes(row.bits), np.uint8)
        table[(row.bucket - 1) * len(part) :][: len(part)] = part
    return table


def _sift(lengths: list[int], table: np.ndarray, schema: pa.Schema) -> Callable:
    """Rows (article_id, start, run) of batches (article_id, words): the runs whose bits are set, in order."""
    packed = zlib.compress(table, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(packed), np.uint8)

        def is_set(place: np.ndarray) -> np.ndarray:
            return (table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)

        def found(sums: np.ndarray, inverse: np.ndarray, n: int) -> np.ndarray:
            hashes = (sums[n:] - sums[:-n]) * inverse[: len(sums[n:])]
            first, second = _places(hashes)
            at = np.flatnonzero(is_set(first))
            return at[is_set(second[at])]

        for batch in batches:
            for part in _slices(batch, _sizes(batch.column(1))):
                ids, lists = part.columns
                words, sizes = lists.flatten(), _sizes(lists)
                owner, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
                sums = _sums(words)
                hits = [found(*sums, n) for n in lengths]
                at, n = np.concatenate(hits), np.repeat(lengths, [len(h) for h in hits])
                inside = at + n <= ends[owner[at]]
                at, n = at[inside], n[inside]
                order = np.lexsort((n, at))
                # Runs of so many words at once, whatever their length
                lots = np.flatnonzero(np.diff(np.cumsum(n[order]) // SLICE)) + 1
                for some in np.split(order, lots):
                    first, size = at[some], n[some]
                    bounds = np.append(0, np.cumsum(size))
                    places = np.repeat(first - bounds[:-1], size) + np.arange(bounds[-1])
                    grams = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words.take(pa.array(places)))
                    start = first - (ends - sizes)[owner[first]]
                    yield _rows([ids.take(pa.array(owner[first])), start, pc.binary_join(grams, " ")], schema)

    return run


def runs(texts: DataFrame, entities: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Rows (article_id, start, n, number): every run of words that is a name, overlapping ones included.

    `names` are those of `entities` where they are written already.
    """
    names = _names(entities) if names is None else names
    lengths = sorted(r.n for r in names.select("n").distinct().collect())
    if not lengths:
        return texts.limit(0).select(F.col("id").alias("article_id"), F.lit(0).alias("start")).join(names, F.lit(True)).select(
            "article_id", "start", "n", "number"
        )
    sent = _sent(names)
    firsts = names.select(F.substring_index("gram", " ", 1).alias("first")).distinct()
    words = texts.select(F.col("id").alias("article_id"), words_of(F.col("text")).alias("words"))
    schema = T.StructType(
        [words.schema["article_id"], T.StructField("start", T.IntegerType()), T.StructField("run", T.StringType())]
    )
    starts = words.mapInArrow(_sift(lengths, _table(names), to_arrow_schema(schema)), schema)
    # A run is one string: words hold no blank, and the first one, the key, is read from it
    some = starts.join(sent(firsts), F.substring_index("run", " ", 1) == F.col("first"), "left_semi")
    grams = some.select("article_id", "start", F.size(F.split("run", " ")).alias("n"), F.col("run").alias("gram"))
    return grams.join(sent(names.select("gram", "n", "number")), ["gram", "n"]).select("article_id", "start", "n", "number")


def _pack(schema: pa.Schema) -> Callable:
    """Rows (article_id, starts, sizes, numbers): the runs of one article that follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            changes = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)
            heads = np.append(0, np.flatnonzero(changes) + 1)[: len(ids)]
            bounds = pa.array(np.append(heads, len(ids)).astype(np.int32))
            yield _rows([ids.take(pa.array(heads)), *(pa.ListArray.from_arrays(bounds, c) for c in batch.columns[1:])], schema)

    return run


def _walk(schema: pa.Schema) -> Callable:
    """Rows (article_id, start, n, number) that remain of batches (article_id, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            owner = np.repeat(np.arange(len(lists)), _sizes(lists))
            runs_of = np.bincount(owner, _sizes(lists.flatten().field(0)), len(lists)).astype(np.int64)
            for part in _slices(batch, runs_of):
                ids, lists = part.columns
                columns = lists.flatten().flatten()
                owner = np.repeat(np.repeat(np.arange(len(lists)), _sizes(lists)), _sizes(columns[0]))
                start, n, number = (c.flatten().to_numpy() for c in columns)
                order = np.lexsort((-n, start, owner))
                kept, article, end = [], -1, 0
                for i, (a, s, size) in enumerate(zip(owner[order].tolist(), start[order].tolist(), n[order].tolist())):
                    if a != article or s >= end:
                        kept.append(i)
                        article, end = a, s + size
                rows = order[kept]
                yield _rows([ids.take(pa.array(owner[rows])), start[rows], n[rows], number[rows]], schema)

    return run


def leftmost_longest(found: DataFrame) -> DataFrame:
    """The rows of `runs` that remain when no two of an article may overlap."""
    whole = T.StructType([found.schema[c] for c in ("article_id", "start", "n", "number")])
    lists = T.StructType(
        [whole["article_id"]]
        + [T.StructField(c, T.ArrayType(whole[of].dataType)) for c, of in (("starts", "start"), ("sizes", "n"), ("numbers", "number"))]
    )
    packed = found.select(whole.names).mapInArrow(_pack(to_arrow_schema(lists)), lists)
    parts = packed.groupBy("article_id").agg(F.collect_list(F.struct("starts", "sizes", "numbers")).alias("parts"))
    return parts.mapInArrow(_walk(to_arrow_schema(whole)), whole)


def gazetteer_mentions(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows (article_id, position, name, type, entity_id) of `texts` (id, text) by the names of `entities` (id, name, type).

    `position` counts words from 0. A name without a word is never found; of
    names with the same words the lowest id stands. Null texts hold no mention.
    """
    names = _names(entities)
    kept = leftmost_longest(runs(texts, entities, names))
    return kept.join(_sent(names)(names.select("number", "entity")), "number").select(
        "article_id", F.col("start").alias("position"), "entity.name", "entity.type", "entity.entity_id"
    )
