"""Quality rules as a short-circuit cascade.

Each rule rejects a text by a few statistics of it. On a sample, the cost of every
statistic is timed and the verdict of every rule noted; rules are then put in
order greedily, each time the one that rejects most of what is still there per
second spent, a statistic that an earlier rule has taken being free. Over all
texts the rules run in that order, and a text that one rejects costs nothing more.
The order decides what is spent, never what is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storystream.llm.batches import map_slices

#: Rows that costs and selectivities are estimated on, about
SAMPLE_ROWS = 2000
WINDOW = 5

_LETTER = regex.compile(r"\p{L}")
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def _without(data: bytes, letters: bytes) -> int:
    return len(data) - len(data.translate(None, letters))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more."""
    size = len(words) - WINDOW + 1
    if size < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    # Windows of different hashes differ; only if some are equal, they are told apart exactly
    hashes = np.zeros(size, np.uint64)
    for i in range(WINDOW):
        hashes = (hashes ^ ids[i : i + size].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    names = ids[:size]
    for i in range(1, WINDOW):
        _, names = np.unique(names * len(numbers) + ids[i : i + size], return_inverse=True)
    found = np.bincount(names)[names] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(found), 1)
    np.add.at(covered, np.flatnonzero(found) + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


class Text:
    """Statistics of one text, each taken when first asked for; null is empty."""

    #: Name of a statistic -> how it is taken
    TAKEN: dict[str, Callable[[Text], int]] = {
        "n_words": lambda t: len(t.words),
        "word_chars": lambda t: len(t.text) - sum(t.text.count(c) for c in " \t\n\v\f\r"),
        "n_symbols": lambda t: sum(t.text.count(c) for c in "#*$%&|<>"),
        "n_lines": lambda t: len(t.lines),
        "n_dup_lines": lambda t: len(t.lines) - len(set(t.lines)),
        "n_repeat_words": lambda t: repeated_words(t.words),
        "n_letter_words": lambda t: sum(1 for w in t.words if w.isalpha() or _LETTER.search(w.decode("utf-8"))),
        "n_marks": lambda t: sum(t.text.count(c) for c in ".,;:!?"),
        "n_upper": lambda t: _without(t.data, _UPPER),
        "n_lower": lambda t: _without(t.data, _LOWER),
    }

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode("utf-8")
        self.known: dict[str, int] = {}
        self._words: list[bytes] | None = None
        self._lines: list[bytes] | None = None

    @property
    def words(self) -> list[bytes]:
        """Bytes split at the six characters that separate words, and at no other."""
        if self._words is None:
            self._words = self.data.split()
        return self._words

    @property
    def lines(self) -> list[bytes]:
        """Lines that have a word."""
        if self._lines is None:
            self._lines = [line for line in self.data.split(b"\n") if line.strip()]
        return self._lines

    def __getitem__(self, name: str) -> int:
        value = self.known.get(name)
        if value is None:
            value = self.known[name] = self.TAKEN[name](self)
        return value


@dataclass(frozen=True)
class Rule:
    """Rejects a text for which `rejects`, given the statistics named in `needs`, is true."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., bool]

    def __call__(self, text: Text) -> bool:
        return self.rejects(*(text[name] for name in self.needs))


BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 20 * n),
)
RULES = (
    *BASE,
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: c < 3 * n or c > 10 * n),
    Rule("letters", ("n_letter_words", "n_words"), lambda w, n: 10 * w < 6 * n),
    Rule("capitals", ("n_upper", "n_lower"), lambda u, v: u > v),
    Rule("marks", ("n_marks", "n_words"), lambda m, n: m > n),
)
#: Statistics that the report gives of every text, kept or not
REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Estimate:
    """What the sample says of a rule at its place in the order."""

    rule: Rule
    rejected: int  # sample rows that it rejects and none before it does
    seconds: float  # spent on the rows that reach it


def _observed(rules: tuple[Rule, ...]) -> Callable[[], Callable]:
    names = sorted({name for rule in rules for name in rule.needs})

    def apply(texts):
        seconds, verdicts = [], []
        for text in texts:
            one, spent = Text(text), []
            for name in names:
                start = time.perf_counter()
                one[name]
                spent.append(time.perf_counter() - start)
            seconds.append(spent)
            verdicts.append([rule(one) for rule in rules])
        return [seconds, verdicts]

    return lambda: apply


def estimated(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """The rules in the order in which to apply them, with what the sample says of each.

    The sample are rows whose hashed id lies below a bound, about `sample_rows`;
    only seconds and verdicts leave the tasks. Words and lines are timed with the
    first statistic that needs them. Rules that reject nothing in the sample come
    last, cheap ones first.
    """
    rows = docs.count()
    share = min(1.0, sample_rows / max(rows, 1))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("text")
    seen = map_slices(sample, _observed(rules), "seconds array<double>, verdicts array<boolean>").collect()
    names = sorted({name for rule in rules for name in rule.needs})
    cost = np.array([r.seconds for r in seen]).reshape(len(seen), len(names))
    rejects = np.array([r.verdicts for r in seen], bool).reshape(len(seen), len(rules))
    left = np.ones(len(seen), bool)
    order, taken, open_rules = [], set(), list(range(len(rules)))
    while open_rules:
        def estimate(k: int) -> Estimate:
            new = [i for i, name in enumerate(names) if name in rules[k].needs and name not in taken]
            return Estimate(rules[k], int(rejects[left, k].sum()), float(cost[left][:, new].sum()))

        found = {k: estimate(k) for k in open_rules}
        best = max(
            open_rules,
            key=lambda k: (found[k].rejected / (found[k].seconds + 1e-9) if found[k].rejected else 0.0, -found[k].seconds, -k),
        )
        order.append(found[best])
        taken |= set(rules[best].needs)
        left &= ~rejects[:, best]
        open_rules.remove(best)
    return order


def first_rejection(text: Text, rules: list[Rule]) -> tuple[int, str | None]:
    """How many rules ran on the text, and the one that rejected it."""
    for ran, rule in enumerate(rules, 1):
        if rule(text):
            return ran, rule.name
    return len(rules), None


def judge(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    report: tuple[str, ...] = REPORT,
    base: tuple[Rule, ...] = BASE,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Rows (doc_id, the statistics of `report`, base_failed, kept, rejected_by, rules_run), one per row of `docs`.

    `rejected_by` is the rule that ended the cascade, which depends on the order
    found; `kept` does not: a text is kept if no rule rejects it. Statistics of
    `report` are taken of every text. Null and empty texts have no words and are
    rejected as such; rows of null id are judged too; repeated rows have equal
    results. Other columns are ignored; an empty table gives no rows.
    """
    order = [e.rule for e in estimated(docs, rules, sample_rows)]

    def make():
        def apply(ids, texts):
            out: list[list] = [ids, *([] for _ in report), [], [], [], []]
            for text in texts:
                one = Text(text)
                ran, name = first_rejection(one, order)
                row = [one[r] for r in report]
                row += [any(rule(one) for rule in base), name is None, name, ran]
                for column, value in zip(out[1:], row):
                    column.append(value)
            return out

        return apply

    schema = ", ".join(["doc_id bigint", *(f"{r} bigint" for r in report)])
    schema += ", base_failed boolean, kept boolean, rejected_by string, rules_run int"
    return map_slices(docs.select("doc_id", "text"), make, schema)


def is_clean(order: list[Rule]) -> Callable[[Column], Column]:
    """The cascade as a function of a text column."""

    @F.pandas_udf("boolean")
    def clean(texts):
        return texts.__class__([first_rejection(Text(t), order)[1] is None for t in texts], dtype=bool)

    return clean


def drop_low_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs` that no rule rejects, all columns as they are. Edge cases are those of `judge`."""
    order = [e.rule for e in estimated(docs, rules, sample_rows)]
    return docs.where(is_clean(order)(F.col("text")))
