"""Near-duplicate texts: SuperMinHash signatures, banding, exact verification, components.

Every text's set of word shingles is hashed once. Texts with equal sets form a
class that stands for its copies, so a group of copies is one row from there on.
Classes that share a band are candidates. Each band bucket first compares its
members with one of them (another one in every band), which settles most groups
in a linear number of comparisons; what is then still apart inside a bucket is
compared in tiles of bounded size, exactly and on full sets, and a tile returns
a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storystream.llm.batches import map_slices
from storystream.llm.links import components
from storystream.llm.sieve import passed, sieve
from storystream.session import materialize

SHINGLE_WORDS = 5
#: Links need 100 * intersection >= PERCENT * union
PERCENT = 85
#: Two sets at the threshold share none of the bands with probability (1 - 0.85**7)**26 < 5e-5
BANDS, BAND_ROWS = 26, 7
TILE_ROWS = 512
WORD_CACHE = 400_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_WORD_MIX = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word met; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, cache: WordHashes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    Bytes lower-case A-Z only and split at space and tab to carriage return
    only, as the definition of a word asks. Fewer words than `width` make one
    shingle; none make an empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    rolled = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        rolled = mix(rolled * _WORD_MIX + hashes[i : len(words) - width + 1 + i])
    return np.unique(rolled)


def super_minhash(elements: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signature (Ertl 2017) of distinct 64-bit elements.

    Each element draws a random permutation of the slots step by step and offers
    r + step to the slot of that step, so the offers of one element are spread
    over all slots without repetition. All elements advance together; once every
    slot is below the next step, no later offer can win and the drawing stops.
    """
    best = np.full(size, np.inf)
    rows = np.arange(len(elements))
    order: np.ndarray | None = None
    for step in range(size):
        draw = mix(elements + np.uint64(int(_GOLDEN) * (step + 1) & 0xFFFFFFFFFFFFFFFF))
        pick = step + ((draw & np.uint64(0xFFFFFF)) % np.uint64(size - step)).astype(np.intp)
        if step == 0:
            slot = pick
        else:
            if order is None:
                order = np.tile(np.arange(size, dtype=np.int32), (len(elements), 1))
                order[rows, first] = 0  # noqa: F821 - the swap of step 0
            slot = order[rows, pick].astype(np.intp)
            order[rows, pick] = order[:, step]
        np.minimum.at(best, slot, (draw >> np.uint64(24)).astype(np.float64) * 2.0**-40 + step)
        if best.max() < step + 1:
            break
        if step == 0:
            first = pick
    return best


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per signature and band; different bands give different keys."""
    parts = signatures.reshape(len(signatures), bands, rows).view(np.uint64)
    keys = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN), (len(signatures), 1))
    for i in range(rows):
        keys = mix(keys * _WORD_MIX + parts[:, :, i])
    return keys


def set_key(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def _sign(bands: int, rows: int, width: int) -> Callable[[], Callable]:
    def make():
        cache = WordHashes()

        def apply(ids, texts, hashes):
            sets = [shingles(text, cache, width) for text in texts]
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if some:
                signatures = np.stack([super_minhash(sets[i], bands * rows) for i in some])
                for i, row in zip(some, band_keys(signatures, bands, rows).view(np.int64)):
                    keys[i] = row.tolist()
            return [
                ids,
                hashes,
                [len(s) for s in sets],
                [set_key(s) if len(s) else None for s in sets],
                keys,
            ]

        return apply

    return make


def _sets(width: int) -> Callable[[], Callable]:
    def make():
        cache = WordHashes()

        def apply(texts):
            sets = [shingles(text, cache, width) for text in texts]
            return [[set_key(s) for s in sets], [s.tobytes() for s in sets]]

        return apply

    return make


def _linked(percent: int) -> Callable[[], Callable]:
    def similar(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    def apply(a, b, set_a, set_b):
        hits = [i for i in range(len(a)) if similar(set_a[i], set_b[i])]
        return [[a[i] for i in hits], [b[i] for i in hits]]

    return lambda: apply


def tile_links(tile: pd.DataFrame, percent: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between members that are in different components so far.

    A pair belongs to the first band that both share, so no other tile repeats
    it. One member is compared with all others in one pass over their elements.
    """
    tile = tile.drop_duplicates("key").reset_index(drop=True)
    sets = [np.frombuffer(x, np.uint64) for x in tile["elements"]]
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bands = np.stack(tile["bands"].to_numpy())
    here = bands == tile["bucket"].iloc[0]
    band = int(np.flatnonzero(here.all(axis=0))[0])
    chunk, part = tile["chunk"].to_numpy(), tile["part"].iloc[0]
    group = pd.factorize(tile["root"])[0]
    marks = np.zeros(codes.max() + 1, bool)
    found = []
    for i in range(len(tile)):
        later = np.arange(i + 1, len(tile))
        apart = (group[later] != group[i]) & (
            100 * np.minimum(sizes[later], sizes[i]) >= percent * np.maximum(sizes[later], sizes[i])
        )
        if part[0] != part[1]:
            apart &= chunk[later] != chunk[i]
        later = later[apart]
        if band and len(later):
            later = later[~(bands[later, :band] == bands[i, :band]).any(axis=1)]
        if not len(later):
            continue
        mine = codes[starts[i] : starts[i + 1]]
        marks[mine] = True
        for j in later:
            both = int(np.count_nonzero(marks[codes[starts[j] : starts[j + 1]]]))
            if group[j] != group[i] and 100 * both >= percent * (sizes[i] + sizes[j] - both):
                found.append((tile["key"][i], tile["key"][j]))
                group[group == group[j]] = group[i]
        marks[mine] = False
    return found


def marked_rows(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = PERCENT,
    width: int = SHINGLE_WORDS,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """Rows (doc_id, text_hash, root, n_shingles, component_id, kept), one per input row.

    `text_hash` is Spark's xxhash64 of the text and tells rows of one id apart;
    `root` names the component, also where two of them have the same smallest id.
    `component_id` is the smallest id that links reach. Null and empty texts and
    texts of white space only have no shingles and link with nothing. A row
    without id is never `kept`; it has the component of its copies that have an
    id, or none. Repeated rows have equal results. Other columns are ignored.
    Empty tables give an empty result.
    """
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_hash")
    )
    signed = materialize(
        map_slices(
            rows, _sign(bands, band_rows, width),
            "doc_id bigint, text_hash bigint, n_shingles bigint, key binary, bands array<bigint>",
        ),
        "signed",
    )
    filled = signed.where("key IS NOT NULL")
    classes = filled.groupBy("key").agg(
        F.min("doc_id").alias("first_id"),
        F.min_by("bands", "doc_id").alias("bands"),
        F.first("n_shingles").alias("n"),
    )
    classes = materialize(classes.where("first_id IS NOT NULL"), "classes")

    # Band rows are narrow: a class goes by 64 bits of its key, and is looked up again where a band is shared.
    # The member whose number is least after a twist by the bucket is the hub, so that every band has another
    number = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("bigint")
    numbered = classes.withColumn("number", number)
    banded = numbered.select("number", F.explode("bands").alias("bucket"))
    buckets = (
        banded.groupBy("bucket")
        .agg(
            F.count("*").alias("members"),
            F.min(F.col("number").bitwiseXOR(F.col("bucket"))).alias("least"),
        )
        .where("members > 1")
        .select("bucket", "members", F.col("least").bitwiseXOR(F.col("bucket")).alias("hub_number"))
    )
    who = numbered.select("number", "key", "n", "first_id")
    hubs = numbered.select(F.col("number").alias("hub_number"), F.col("key").alias("hub"), F.col("n").alias("hub_n"))
    shared = materialize(
        banded.join(buckets, "bucket").join(who, "number").join(hubs, "hub_number").select(
            "bucket", "members", "key", "n", "first_id", "hub", "hub_n"
        ),
        "shared",
    )
    near_size = F.expr(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    pairs = (
        shared.where("key <> hub").where(near_size)
        .select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b"))
        .distinct()
    )
    wanted = shared.groupBy("first_id").agg(F.lit(1).alias("_"))
    # Texts that no band shares are not shuffled
    near, _ = passed(rows, sieve(wanted.select("first_id"), "wanted"), F.col("doc_id").cast("bigint"))
    sets = materialize(
        map_slices(
            near.join(wanted.hint("merge"), F.col("doc_id") == F.col("first_id"), "left_semi").select("text"),
            _sets(width), "key binary, elements binary",
        ).dropDuplicates(["key"]),
        "sets",
    )
    of = lambda side: sets.select(F.col("key").alias(side), F.col("elements").alias(f"set_{side}"))
    links = materialize(
        map_slices(
            pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b"),
            _linked(percent), "a binary, b binary",
        ),
        "links",
    )
    roots = components(links, "hub-components")

    placed = shared.where("key <> hub").join(roots, F.col("key") == F.col("node"), "left").select(
        "bucket", "members", "key", F.coalesce("root", "key").alias("root")
    )
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    rest = placed.join(split.where("low <> high").select("bucket"), "bucket")
    chunks = F.ceil(F.col("members") / TILE_ROWS).cast("int")
    tiled = (
        rest.withColumn("chunks", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .withColumn("part", F.array(F.least("chunk", "other"), F.greatest("chunk", "other")))
        .select("bucket", "part", "chunk", "key", "root")
        .join(sets, "key")
        .join(classes.select("key", "bands"), "key")
    )

    def forest(tile: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(tile_links(tile, percent), columns=["a", "b"])

    more = tiled.groupBy("bucket", "part").applyInPandas(forest, "a binary, b binary")
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    final = components(materialize(known.union(more), "all-links"), "components")

    placed = classes.join(final, F.col("key") == F.col("node"), "left").select(
        "key", "first_id", F.coalesce("root", "key").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(least, "root").select("key", "root", "component_id")
    return signed.join(named, "key", "left").select(
        "doc_id",
        "text_hash",
        "root",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"),
    )


def near_duplicates(docs: DataFrame, *args, **options) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) of `marked_rows`."""
    return marked_rows(docs, *args, **options).drop("text_hash", "root")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay: one document of each group, all columns as they are.

    A row goes if its text's group has a smaller id, or a text of the same id that
    comes first by hash; of rows equal in id and text one stays. Different texts
    under one id are judged each by itself. Rows without id are no member of a
    group and all stay.
    """
    marked = materialize(
        marked_rows(docs, **options).where("doc_id IS NOT NULL").select("doc_id", "text_hash", "root", "kept"), "marked"
    )
    # Two texts of one id and one group have different hashes; the lower one stands for the group
    first = marked.where("kept AND root IS NOT NULL").groupBy("doc_id", "root").agg(
        F.min("text_hash").alias("lead"), F.max("text_hash").alias("last")
    )
    second = marked.join(first.where("lead <> last").select("doc_id", "root", "lead"), ["doc_id", "root"])
    gone = marked.where("NOT kept").select("doc_id", "text_hash").union(
        second.where("text_hash <> lead").select("doc_id", "text_hash")
    )
    # Written first, so that Spark plans the joins by what there is to drop
    gone = materialize(gone.distinct(), "gone")
    repeated = marked.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    repeated = materialize(repeated, "repeated")
    hashed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
        F.col("doc_id").alias("_id"),
        F.xxhash64("text").alias("_hash"),
    )

    def same(rows: DataFrame):
        return (F.col("_id") == rows["doc_id"]) & (F.col("_hash") == rows["text_hash"])

    # Only texts that may go or repeat are shuffled
    other = gone.union(repeated)
    met, kept = passed(hashed, sieve(other, "other"), F.col("_id").cast("bigint"), "_hash")
    once = met.join(other, same(other), "left_anti").select("_row.*").unionByName(kept.select("_row.*"))
    again = (
        met.join(repeated, same(repeated), "left_semi")
        .join(gone, same(gone), "left_anti")
        .groupBy("_id", F.col("_row.text").alias("_text"))
        .agg(F.first("_row").alias("_row"))
        .select("_row.*")
    )
    return once.unionByName(again)
