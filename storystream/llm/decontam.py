"""Benchmark decontamination by pigeonhole edit matching.

With an error budget of k edits, an item cut into k + 1 pieces keeps at least one
piece untouched in every passage within the budget. So the pieces are searched
exactly, all at once, and only around a hit the item is compared with the text
by Myers' bit-parallel edit distance. Texts and items are compared in lower case
with everything but letters and digits reduced to single spaces.

The items are a stated query set: they go to the tasks in blocks of bounded size,
one pass over the texts per block, and driver and tasks hold one block at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storystream.llm.batches import map_slices
from storystream.session import materialize

#: Edits allowed per character of the normalised item
ERROR_RATE = 0.05
#: Normalised items of fewer characters allow no edit and are found as whole words only
SHORT_CHARACTERS = 20
#: Characters of items that one pass over the texts may search for
BLOCK_CHARACTERS = 4_000_000

_WORD = re.compile(r"[^\W_]+")


def normalise(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of `budget` + 1 pieces of nearly equal length that make up the text."""
    cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the end of the first such part.

    Myers (1999), with one integer of as many bits as the pattern has characters.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(zero | plus))
        down = plus & zero
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(zero | up)), up & zero
        if score < best:
            best, end = score, at
    return best, end


@dataclass(frozen=True)
class Item:
    item_id: int
    text: str
    budget: int


class Matcher:
    """Searches one block of items in normalised texts."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items = items
        places: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(items):
            for offset, piece in pieces(item.text, item.budget):
                places.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def search(self, text: str) -> dict[int, tuple[int, int]]:
        """Best (distance, end) per item number that is within its budget somewhere in the text."""
        best: dict[int, tuple[int, int]] = {}
        if self.empty:
            return best
        tried: dict[int, int] = {}
        for last, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                item = self.items[number]
                if best.get(number, (1,))[0] == 0:
                    continue
                if len(item.text) < SHORT_CHARACTERS:
                    if text[last - length : last - length + 1] in ("", " ") and text[last + 1 : last + 2] in ("", " "):
                        best[number] = (0, last + 1)
                    continue
                start = last - length + 1 - offset
                # Hits in order of their place: those of one passage lie on nearly the same diagonal
                if number in tried and abs(start - tried[number]) <= item.budget // 2:
                    continue
                tried[number] = start
                if text.startswith(item.text, max(start, 0)) and start >= 0:
                    best[number] = (0, start + len(item.text))
                    continue
                # Wide enough for every diagonal that is skipped as near to this one
                margin = item.budget + item.budget // 2 + 1
                low = max(0, start - margin)
                high = start + len(item.text) + margin
                distance, end = myers(item.text, text[low:high])
                if distance <= item.budget and distance < best.get(number, (distance + 1,))[0]:
                    best[number] = (distance, low + end)
        return best


def budget_of(text: str, rate: float) -> int:
    return int(len(text) * rate) if len(text) >= SHORT_CHARACTERS else 0


def block_count(benchmark: DataFrame, limit: int = BLOCK_CHARACTERS) -> int:
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    return total // limit + 1


def blocks(benchmark: DataFrame, count: int, rate: float = ERROR_RATE) -> Iterator[list[Item]]:
    """The items in `count` blocks, one after the other; only one is collected at a time.

    Null items and those without a letter or digit hold nothing to search and are
    left out; items of null id too. Of repeated ids every text counts.
    """
    usable = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    for block in range(count):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).collect()
        items = [(r.item_id, normalise(r.text)) for r in sorted(rows)]
        found = [Item(i, t, budget_of(t, rate)) for i, t in items if t]
        if found:
            yield found


def _pass(shared):
    def make():
        matcher = Matcher(shared.value)

        def apply(ids, texts):
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(ids, texts):
                low = normalise(text)
                for number, (distance, end) in matcher.search(low).items():
                    item = matcher.items[number]
                    for column, value in zip(out, (doc_id, item.item_id, distance, item.budget, end)):
                        column.append(value)
            return out

        return apply

    return make


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, limit: int = BLOCK_CHARACTERS
) -> DataFrame:
    """Rows (doc_id, item_id, distance, budget, end): the best passage of each document and item within budget.

    `end` is its end in the normalised text. An item of fewer than
    SHORT_CHARACTERS normalised characters has a budget of 0 and must stand
    between word ends. Null and empty texts hold no item. Repeated rows of
    documents repeat their results; of equal items with different ids each is
    found. Other columns are ignored; an empty table on either side gives no
    rows. Every block but a single one is searched and written by itself.
    """
    schema = "doc_id bigint, item_id bigint, distance int, budget int, end bigint"
    spark: SparkSession = docs.sparkSession
    rows = docs.select("doc_id", "text")
    found = spark.createDataFrame([], schema)
    count = block_count(benchmark, limit)
    for block in blocks(benchmark, count, rate):
        shared = spark.sparkContext.broadcast(block)
        passed = map_slices(rows, _pass(shared), schema)
        if count > 1:
            passed = materialize(passed, "leaks")
            shared.unpersist()
        found = found.union(passed)
    return found


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, limit: int = BLOCK_CHARACTERS
) -> DataFrame:
    """The rows of `docs` that hold no item within budget, all columns as they are.

    Items, short ones too, are those of `find_leaks`. Rows of null or empty text
    hold no item and stay, rows of null id are judged by their text, and repeated
    rows stay or go together. Between blocks the rows that are left are written.
    """
    count = block_count(benchmark, limit)
    for block in blocks(benchmark, count, rate):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.where(~_holds_item(shared)("text"))
        if count > 1:
            docs = materialize(docs, "without-leaks")
            shared.unpersist()
    return docs


def _holds_item(shared):
    built: list[Matcher] = []

    @F.pandas_udf("boolean")
    def holds(texts):
        if not built:
            built.append(Matcher(shared.value))
        return texts.__class__([bool(built[0].search(normalise(t))) for t in texts], dtype=bool)

    return holds
