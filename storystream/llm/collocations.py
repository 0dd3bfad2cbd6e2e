"""Phrase collocations from suffix subtrees, partitioned by prefix to fit memory.

Every word starts a suffix, cut after DEPTH words or at the end of its piece. The
work goes as in ERA (Mansour et al. 2011), with words in place of characters:

- Vertical partitioning. Prefixes of one word are counted; whatever starts more
  suffixes than a group may hold is extended by a word and counted again, until
  every prefix fits. Prefixes are then put together, in the order of a hash, to
  groups of about GROUP_SUFFIXES suffixes.
- Every group's suffixes go to one task as packed blocks, equal suffixes already
  added up where they were read. The task sorts them, which is the depth-truncated
  suffix subtree in the order of its leaves: a node is a run of equal prefixes and
  its count the total of its leaves.

A word below the support ends a suffix early, as no phrase with it can count.
Phrases, their parts and their scores are then joins of the nodes.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storystream.session import materialize

DEPTH = 5
SUPPORT = 100
TOP = 2000
#: Suffixes that a group's task holds at once, and words that a reading task gathers before it sends them
GROUP_SUFFIXES = 1 << 20
BLOCK_WORDS = 1 << 20
#: So many of the most frequent words go as two-byte codes; all others as their hash
CODEBOOK = 49_152
#: The table of words that reach the support: one bit per hash range, 8 MB at every size of the corpus
FILTER_BITS = 26
#: Bytes that are cut into words at once, rows that are joined at once, and words kept with their hash
CHUNK_BYTES = 1 << 20
SLICE_ROWS = 256
VOCABULARY = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Letters A-Z to lower case, tabs to spaces, ends of pieces to line feeds
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n"
)
#: Stands for the end of a piece among words; no byte of UTF-8
_STOP = b"\xff"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def longer_key(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a prefix that has one more word."""
    with np.errstate(over="ignore"):
        return _mix((key ^ _mix(word)) * _STEP + np.uint64(1))


def _root_key(lang: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))], np.uint64)


def pieces_of(data: bytes) -> Iterator[list[bytes]]:
    """Words of `data`, already translated, in bounded lots, with _STOP at the ends of pieces."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].replace(b"\n", b" \xff ").split()
        at = end


class Numbers(dict):
    """Running number of each word met, from 1 on, and its hash; 0 is the end of a piece."""

    def __init__(self, seed: int):
        self.seed = seed
        self.reset()

    def reset(self) -> None:
        self.clear()
        self[_STOP] = 0
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return number


def _texts_by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of a batch, a slice of rows and a language at a time, joined at line feeds."""
    for start in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(start, SLICE_ROWS)
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            yield lang, b"\n".join(some).translate(_TABLE)


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def _count_words(seed: int):
    def flush(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in counts.items():
            words = list(counter)
            hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(words), pa.string()),
                    pa.array([w.decode("utf-8") for w in words], pa.string()),
                    pa.array(_signed(hashes)),
                    pa.array(_signed(longer_key(_root_key(lang), hashes))),
                    pa.array([counter[w] for w in words], pa.int64()),
                ],
                names=["lang", "word", "hash", "key", "f"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, data in _texts_by_lang(batch):
                counter = counts.setdefault(lang, Counter())
                for words in pieces_of(data):
                    counter.update(words)
                    if sum(map(len, counts.values())) > VOCABULARY:
                        for c in counts.values():
                            c.pop(_STOP, None)
                        yield from flush(counts)
                        counter = Counter()
                        counts = {lang: counter}
        for c in counts.values():
            c.pop(_STOP, None)
        yield from flush({lang: c for lang, c in counts.items() if c})

    return run


def vocabulary(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows (lang, word, hash, key, f), and the seed by which no two words share a hash."""
    seed = 0
    while True:
        words = (
            rows.mapInArrow(_count_words(seed), "lang string, word string, hash bigint, key bigint, f bigint")
            .groupBy("lang", "word")
            .agg(F.first("hash").alias("hash"), F.first("key").alias("key"), F.sum("f").alias("f"))
        )
        words = materialize(words, "vocabulary")
        twice = words.groupBy("hash").agg(F.min("word").alias("a"), F.max("word").alias("b"))
        if twice.where("a <> b OR hash = 0").isEmpty():
            return words, seed
        seed += 1


class Partitioning:
    """What tasks know of the prefixes: those to extend, the groups' ranges, and which words can count.

    `hot` holds the keys of prefixes that are extended, at most (DEPTH - 1) times
    the corpus over GROUP_SUFFIXES; `bounds` one key per group.
    """

    def __init__(self, seed: int, live: np.ndarray, codebook: np.ndarray):
        self.seed, self.live, self.codebook = seed, live, codebook
        self.hot = np.empty(0, np.uint64)
        self.bounds = np.empty(0, np.int64)

    def is_hot(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)
        return self.hot[at] == keys

    def is_live(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> np.uint64(64 - FILTER_BITS)
        return (self.live[(place >> np.uint64(6)).astype(np.intp)] >> (place & np.uint64(63))) & np.uint64(1) > 0

    def prefixes(self, root: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Key and length of each suffix's prefix; length 0 if the suffix ends inside an extended prefix."""
        keys = longer_key(root, hashes[0])
        length = np.ones(len(keys), np.int8)
        grow = self.is_hot(keys)
        for depth in range(1, DEPTH):
            ended = grow & (hashes[depth] == 0)
            length[ended] = 0
            at = np.flatnonzero(grow & ~ended)
            keys[at] = longer_key(keys[at], hashes[depth][at])
            length[at] = depth + 1
            grow = np.zeros(len(keys), bool)
            if depth + 1 < DEPTH:
                grow[at] = self.is_hot(keys[at])
        return keys, length


def sort_runs(columns: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns in their order, and the total count of each."""
    if not len(columns[0]):
        return columns, np.empty(0, np.int64)
    if max(int(c.max()) for c in columns) < 1 << 21:
        a, b, c, d, e = (x.astype(np.int64) for x in columns)
        keys = [a << 42 | b << 21 | c, d << 21 | e]
    else:
        keys = columns
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    totals = np.diff(np.r_[starts, len(order)]) if counts is None else np.add.reduceat(counts[order], starts)
    first = order[starts]
    return [c[first] for c in columns], totals.astype(np.int64)


class _Reader:
    """Suffixes of a task's texts, gathered by language to lots of about BLOCK_WORDS words."""

    def __init__(self, parts: Partitioning):
        self.parts = parts
        self.numbers = Numbers(parts.seed)
        self.lots: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def lots_of(self, batches: Iterator[pa.RecordBatch]):
        """(root key, lang, hashes by number, suffix columns, counts) of each lot."""
        for batch in batches:
            for lang, data in _texts_by_lang(batch):
                lot = self.lots.setdefault(lang, [])
                for words in pieces_of(data):
                    lot.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
                    self.size += len(words)
                lot.append(np.zeros(1, np.int32))
                if self.size >= BLOCK_WORDS:
                    yield from self.flush()
        yield from self.flush()

    def flush(self):
        hashes = np.array(self.numbers.hashes, np.uint64)
        for lang, lot in self.lots.items():
            root = _root_key(lang)
            live = self.parts.is_live(longer_key(root, hashes))
            live[0] = False
            words = np.concatenate([*lot, np.zeros(DEPTH, np.int32)])
            words[~live[words]] = 0
            for at in range(0, len(words) - DEPTH, BLOCK_WORDS):
                size = min(BLOCK_WORDS, len(words) - DEPTH - at)
                columns = [words[at : at + size]]
                for depth in range(1, DEPTH):
                    after = words[at + depth : at + depth + size]
                    columns.append(np.where(columns[-1] == 0, 0, after))
                some = np.flatnonzero(columns[1])
                yield root, lang, hashes, *sort_runs([c[some] for c in columns], None)
        self.lots, self.size = {}, 0
        if len(self.numbers) > VOCABULARY:
            self.numbers.reset()


def _count_longer(shared, depth: int):
    """Counts of the prefixes of `depth` words that are extended, by the word that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: Partitioning = shared.value
        kept: list[np.ndarray] = []

        def merged() -> np.ndarray:
            rows = np.concatenate(kept, axis=1)
            order = np.lexsort((rows[1], rows[0]))
            rows = rows[:, order]
            new = np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]
            starts = np.flatnonzero(new)
            return np.stack([rows[0, starts], rows[1, starts], rows[2, starts], np.add.reduceat(rows[3], starts)])

        def batch_of(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(_signed(r)) for r in rows], names=["parent", "next", "key", "f"]
            )

        for root, _, hashes, columns, counts in _Reader(parts).lots_of(batches):
            words = [hashes[c] for c in columns]
            at, keys = np.arange(len(counts)), longer_key(root, words[0])
            for step in range(depth):
                if step:
                    at, keys = at[words[step][at] != 0], keys[words[step][at] != 0]
                    keys = longer_key(keys, words[step][at])
                hot = parts.is_hot(keys)
                at, keys = at[hot], keys[hot]
            further = words[depth][at] != 0
            at, keys = at[further], keys[further]
            if len(at):
                after = words[depth][at]
                kept.append(np.stack([keys, after, longer_key(keys, after), counts[at].astype(np.uint64)]))
                kept = [merged()]
                if kept[0].shape[1] > VOCABULARY:
                    yield batch_of(kept[0])
                    kept = []
        if kept:
            yield batch_of(kept[0])

    return run


def pack(codebook: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Suffixes, as columns of word hashes with 0 for the end, in few bytes."""
    words = np.concatenate(columns)
    codes = np.searchsorted(codebook, words)
    codes[codes == len(codebook)] = 0
    known = codebook[codes] == words
    others, place = np.unique(words[~known], return_inverse=True)
    codes[~known] = place + len(codebook)
    wide = len(codebook) + len(others) > 0xFFFF
    small = len(counts) == 0 or counts.max() <= 0xFF
    data = b"".join(
        [
            struct.pack("<qq??", len(counts), len(others), wide, small),
            others.tobytes(),
            codes.astype(np.uint32 if wide else np.uint16).tobytes(),
            counts.astype(np.uint8 if small else np.int64).tobytes(),
        ]
    )
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(codebook: np.ndarray, block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A row per suffix, a column per word; and the counts."""
    data = zstandard.ZstdDecompressor().decompress(block)
    head = struct.calcsize("<qq??")
    size, others, wide, small = struct.unpack_from("<qq??", data)
    words = np.frombuffer(data, np.uint64, others, head)
    head += words.nbytes
    codes = np.frombuffer(data, np.uint32 if wide else np.uint16, size * DEPTH, head)
    counts = np.frombuffer(data, np.uint8 if small else np.int64, size, head + codes.nbytes)
    return np.concatenate([codebook, words])[codes].reshape(DEPTH, size), counts.astype(np.int64)


def _send(shared):
    """Suffixes as blocks, one for each lot and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: Partitioning = shared.value
        for root, lang, hashes, columns, counts in _Reader(parts).lots_of(batches):
            if not len(counts):
                continue
            keys, length = parts.prefixes(root, [hashes[c] for c in columns])
            group = np.searchsorted(parts.bounds, _signed(keys), side="right")
            group[length == 0] = -1
            order = np.argsort(group, kind="stable")
            order = order[np.searchsorted(group[order], 0) :]
            sorted_groups = group[order]
            starts = np.flatnonzero(np.r_[True, sorted_groups[1:] != sorted_groups[:-1]]) if len(order) else []
            groups, blocks = [], []
            for rows in np.split(order, starts[1:]) if len(order) else []:
                groups.append(int(group[rows[0]]))
                blocks.append(pack(parts.codebook, [hashes[c[rows]] for c in columns], counts[rows]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(groups), pa.string()), pa.array(groups, pa.int64()), pa.array(blocks, pa.binary())],
                names=["lang", "part", "block"],
            )

    return run


def _grow(shared, support: int):
    """The nodes of a group's subtrees that reach the support, read off its sorted suffixes."""

    def run(group: pa.Table) -> pa.Table:
        parts: Partitioning = shared.value
        lang = group["lang"][0].as_py()
        blocks = [unpack(parts.codebook, block.as_py()) for block in group["block"]]
        words = np.concatenate([w for w, _ in blocks], axis=1)
        counts = np.concatenate([c for _, c in blocks])
        del blocks
        names, numbers = np.unique(words, return_inverse=True)
        if names[0] != 0:
            names, numbers = np.r_[np.uint64(0), names], numbers + 1
        del words
        columns, counts = sort_runs(list(numbers.reshape(DEPTH, -1).astype(np.int32)), counts)
        _, length = parts.prefixes(_root_key(lang), [names[c] for c in columns])
        new = np.zeros(len(counts), bool)
        new[0] = True
        new[1:] = columns[0][1:] != columns[0][:-1]
        phrases, totals_of = [], []
        for depth in range(1, DEPTH):
            new[1:] |= columns[depth][1:] != columns[depth][:-1]
            starts = np.flatnonzero(new)
            totals = np.add.reduceat(counts, starts)
            # Shorter than its prefix, a node has leaves in other groups too
            whole = (columns[depth][starts] > 0) & (totals >= support) & (depth + 1 >= length[starts])
            rows = starts[whole]
            phrases += _signed(np.stack([names[c[rows]] for c in columns[: depth + 1]], axis=1)).tolist()
            totals_of += totals[whole].tolist()
        return pa.table(
            {
                "lang": pa.array([lang] * len(phrases), pa.string()),
                "words": pa.array(phrases, pa.list_(pa.int64())),
                "f": pa.array(totals_of, pa.int64()),
            }
        )

    return run


def _live_words(vocabulary: DataFrame) -> np.ndarray:
    place = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    chunks = vocabulary.select(
        F.shiftright(place, 6).alias("chunk"), F.expr("shiftleft(1L, int(shiftrightunsigned(key, {}) & 63))".format(64 - FILTER_BITS)).alias("bit")
    )
    live = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for row in chunks.groupBy("chunk").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        live[row.chunk] = row.bits & 0xFFFFFFFFFFFFFFFF
    return live


def _bounds(loads: DataFrame, group_suffixes: int) -> np.ndarray:
    """First key of each group: prefixes in the order of their keys, as many as a group may hold.

    Running sums start anew in every range of keys, so that no task sees all prefixes.
    """
    total = loads.agg(F.sum("f")).first()[0] or 0
    bits = max(4, (total // group_suffixes).bit_length())
    ranges = loads.withColumn("range", F.shiftright("key", 64 - bits))
    before = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranges.withColumn("n", F.floor(F.coalesce(F.sum("f").over(before), F.lit(0)) / group_suffixes))
    firsts = numbered.groupBy("range", "n").agg(F.min("key").alias("key"))
    return np.array(sorted(r.key for r in firsts.select("key").collect()), np.int64)


def frequent_phrases(
    docs: DataFrame,
    support: int = SUPPORT,
    group_suffixes: int = GROUP_SUFFIXES,
) -> tuple[DataFrame, DataFrame]:
    """Phrases of 2 to DEPTH words with their frequency, and the vocabulary.

    The first are rows (lang, words, f), words by their hashes, of all phrases
    that occur at least `support` times in a language; the second is that of
    `vocabulary`. Null texts count as empty, null languages as `und`.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    words, seed = vocabulary(rows)
    live = materialize(words.where(F.col("f") >= support).select("lang", "hash", "key", "f"), "live-words")
    codebook = live.groupBy("hash").agg(F.sum("f").alias("f")).orderBy(F.desc("f"), "hash").limit(CODEBOOK).collect()
    codes = np.unique(np.array([0, *(r.hash & 0xFFFFFFFFFFFFFFFF for r in codebook)], np.uint64))
    parts = Partitioning(seed, _live_words(live), codes)

    prefixes = live.select("lang", F.array("hash").alias("words"), "key", "f")
    loads, phrases = [], []
    for depth in range(1, DEPTH + 1):
        too_many = F.col("f") > group_suffixes
        hot = prefixes.where(too_many) if depth < DEPTH else prefixes.limit(0)
        keys = [r.key & 0xFFFFFFFFFFFFFFFF for r in hot.select("key").collect()]
        if not keys:
            loads.append(prefixes.select("key", "f"))
            break
        loads.append(prefixes.where(~too_many).select("key", "f"))
        if depth > 1:
            phrases.append(hot.where(F.col("f") >= support).select("lang", "words", "f"))
        parts.hot = np.unique(np.concatenate([parts.hot, np.array(keys, np.uint64)]))
        longer = rows.mapInArrow(
            _count_longer(spark.sparkContext.broadcast(parts), depth), "parent bigint, next bigint, key bigint, f bigint"
        )
        longer = longer.groupBy("parent", "next").agg(F.first("key").alias("key"), F.sum("f").alias("f"))
        parents = hot.select("lang", "words", F.col("key").alias("parent"))
        prefixes = materialize(
            longer.join(parents, "parent").select(
                "lang", F.concat("words", F.array("next")).alias("words"), "key", "f"
            ),
            "prefixes",
        )
    every = loads[0]
    for more in loads[1:]:
        every = every.unionByName(more)
    parts.bounds = _bounds(every, group_suffixes)

    shared = spark.sparkContext.broadcast(parts)
    blocks = rows.mapInArrow(_send(shared), "lang string, part bigint, block binary")
    nodes = blocks.groupBy("lang", "part").applyInArrow(
        _grow(shared, support), "lang string, words array<bigint>, f bigint"
    )
    for more in phrases:
        nodes = nodes.unionByName(more)
    return materialize(nodes, "phrases"), words


def collocations(
    docs: DataFrame,
    support: int = SUPPORT,
    top: int = TOP,
    group_suffixes: int = GROUP_SUFFIXES,
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's `top` phrases.

    A phrase of 2 to 5 words occurs a times, at least `support`, inside pieces
    (what `.,;:!?` and line ends leave), and scores 1000 * a * n / (l * r), rounded
    down, at its worst cut into a first part of frequency l and a rest of
    frequency r; n counts all words of the language. Phrases that only occur
    inside one longer phrase are left out. Letters A-Z are lower-cased. Null and
    empty texts have no words; a null language is `und`; repeated rows count as
    often as they are there; ties in the rank go to the higher a, then to the
    phrase first in byte order. Other columns are ignored; an empty table gives
    no rows.
    """
    found, words = frequent_phrases(docs, support, group_suffixes)
    # Frequencies fall with every word added, so whoever is as frequent as a longer phrase is so with one word more
    size = F.size("words")
    inner = (
        found.where(size > 2)
        .select("lang", "f", F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"))
        .distinct()
    )
    kept = found.join(inner, ["lang", "words", "f"], "left_anti")
    known = found.unionByName(
        words.where(F.col("f") >= support).select("lang", F.array("hash").alias("words"), "f")
    )
    part = lambda side, f: known.select("lang", F.col("words").alias(side), F.col("f").alias(f))
    cuts = (
        kept.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
        .select(
            "lang", "words", "a", "k",
            F.slice("words", F.lit(1), F.col("k")).alias("first"),
            F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"),
        )
        .join(part("first", "l"), ["lang", "first"])
        .join(part("rest", "r"), ["lang", "rest"])
        .join(words.groupBy("lang").agg(F.sum("f").alias("n")), "lang")
    )
    whole = lambda name: F.col(name).cast("decimal(19,0)")
    exact = cuts.withColumns({"_an": whole("a") * whole("n"), "_lr": whole("l") * whole("r")})
    score = F.expr("cast(_an as decimal(34,0)) * cast(1000 as decimal(4,0)) div _lr")
    scored = exact.withColumn("score", score)
    worst = scored.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelled = (
        worst.select("lang", "words", F.posexplode("words").alias("at", "hash"))
        .join(words.select("lang", "hash", "word"), ["lang", "hash"])
        .groupBy("lang", "words")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        worst.join(spelled, ["lang", "words"])
        .select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
        .withColumn("rank", F.row_number().over(best).cast("bigint"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
