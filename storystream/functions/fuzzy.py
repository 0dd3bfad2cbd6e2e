"""Token-sort title similarity: 200 * LCS / (length a + length b) on sorted tokens.

The longest common subsequence uses the bit-parallel recurrence of Hyyrö (2004):
one bit per character of the left title, one step per character of the right
one. The left titles of a right one are packed side by side into one long integer,
each with a spare bit that takes its carry, so a step serves all of them at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storystream.functions.text import WHITESPACE

# Bytes packed into one integer: enough to outweigh the interpreter's cost per step
PACK_BYTES = 2048
# Bytes of letter masks kept for titles that come again
MASK_BYTES = 64 << 20
# Key of the mask of all characters; no code point
FULL = -1
# Characters are counted in bins; characters that share one can only raise the bound
BINS = 128
BOUND_ROWS = 16_384


def token_sort_key(title: Column) -> Column:
    """Whitespace tokens in code-point order, joined by one space."""
    tokens = F.split(F.coalesce(title, F.lit("")), rf"(?U){WHITESPACE}+")
    return F.array_join(F.array_sort(F.filter(tokens, lambda token: token != "")), " ")


class Titles:
    """Code points of token-sorted titles."""

    def __init__(self, titles: Sequence[str]):
        self.codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in titles]
        self.lengths = np.array([len(c) for c in self.codes], dtype=np.int64)
        # Bytes a title takes in a pack: a bit per character and at least one to spare
        self.slots = self.lengths // 8 + 1
        self._masks: dict[int, dict[int, bytes]] = {}
        self._held = 0

    def masks(self, title: int) -> dict[int, bytes]:
        """Per letter of a title: the bits of the places where it stands; under `FULL`, the bits of all."""
        if title not in self._masks:
            codes = self.codes[title]
            letters, row = np.unique(codes, return_inverse=True)
            bits = np.zeros((len(letters) + 1, int(self.slots[title])), dtype=np.uint8)
            place = np.arange(len(codes))
            np.bitwise_or.at(bits, (row, place // 8), (1 << place % 8).astype(np.uint8))
            bits[-1] = np.bitwise_or.reduce(bits[:-1], axis=0)
            if self._held > MASK_BYTES:
                self._masks, self._held = {}, 0
            self._held += bits.size
            self._masks[title] = dict(zip([*letters.tolist(), FULL], [line.tobytes() for line in bits]))
        return self._masks[title]

    @cached_property
    def counts(self) -> np.ndarray:
        """How often the characters of each bin occur in each title."""
        bins = np.concatenate([np.empty(0, dtype=np.uint32), *self.codes]) % BINS
        owner = np.repeat(np.arange(len(self.codes)), self.lengths)
        flat = np.bincount(owner * BINS + bins, minlength=len(self.codes) * BINS)
        return flat.reshape(len(self.codes), BINS).astype(np.int32)


def score_bound(left: Titles, right: Titles, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper bound of the score: an LCS is no longer than the shorter title."""
    a, b = left.lengths[i], right.lengths[j]
    return np.where(a + b == 0, 100.0, 200.0 * np.minimum(a, b) / np.maximum(a + b, 1))


def letter_bound(left: Titles, right: Titles, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper bound of the score: an LCS has no character more often than either title."""
    common = np.zeros(len(i), dtype=np.int64)
    for at in range(0, len(i), BOUND_ROWS):
        part = slice(at, at + BOUND_ROWS)
        common[part] = np.minimum(left.counts[i[part]], right.counts[j[part]]).sum(axis=1)
    total = left.lengths[i] + right.lengths[j]
    return np.where(total == 0, 100.0, 200.0 * common / np.maximum(total, 1))


def scores(left: Titles, right: Titles, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs `(i, j)`.

    A right title steps once through a pack of just the left titles it is paired
    with, so that few pairs cost little and many share each step.
    """
    total = left.lengths[i] + right.lengths[j]
    common = np.zeros(len(i), dtype=np.int64)
    by_right = np.argsort(j, kind="stable")
    for run in np.split(by_right, np.flatnonzero(np.diff(j[by_right])) + 1):
        filled = np.cumsum(left.slots[i[run]])
        for pairs in np.split(run, np.flatnonzero(np.diff(filled // PACK_BYTES)) + 1):
            if len(pairs):
                common[pairs] = _common(left, i[pairs], right.codes[j[pairs[0]]])
    return np.where(total == 0, 100.0, 200.0 * common / np.maximum(total, 1))


def _common(left: Titles, members: np.ndarray, right: np.ndarray) -> np.ndarray:
    """LCS length of each left title with the right one; the left ones lie side by side in one integer."""
    slots = left.slots[members]
    titles = [left.masks(title) for title in members.tolist()]
    gaps = [bytes(size) for size in slots.tolist()]
    letters = right.tolist()
    packed = {
        letter: int.from_bytes(b"".join([own.get(letter, gap) for own, gap in zip(titles, gaps)]), "little")
        for letter in set(letters)
    }
    full = int.from_bytes(b"".join([own[FULL] for own in titles]), "little")
    state = full
    for letter in letters:
        match = state & packed[letter]
        if match:
            state = ((state + match) | (state - match)) & full
    cleared = np.frombuffer((state ^ full).to_bytes(int(slots.sum()), "little"), dtype=np.uint8)
    return np.add.reduceat(np.bitwise_count(cleared), np.cumsum(slots) - slots, dtype=np.int64)


def pair_scores(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Scores of titles pairwise by position, both already token-sorted; equal titles are encoded once."""
    (i, a), (j, b) = (pd.factorize(np.asarray(side, dtype=object)) for side in (left, right))
    return scores(Titles(a), Titles(b), i, j)


@F.pandas_udf(T.DoubleType())
def _token_sort_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(pair_scores(left, right))


def token_sort_ratio(title_a: Column, title_b: Column) -> Column:
    """Score in [0, 100]; case-sensitive; equal token sets score 100."""
    return _token_sort_ratio(token_sort_key(title_a), token_sort_key(title_b))
