"""Toxicity by a weighted finite-state grammar over clauses.

A sentence is read as a string of symbols: insult, threat verb, target, copula or
filler, intent, negation, verb of saying, quotation mark and anything else. Small
transducers each follow one thing and are composed into two machines whose tables
are built once: one reads from the left (negation before, speech verb before,
quotation, who is addressed, what is intended), one from the right (negation
after, speech verb at the end, who is addressed after). What both say where an
insult or threat verb stands decides what is matched there:

- an insult is aimed if a target stands at most `BEFORE` symbols before or
  `BEHIND` after it ("you are such an idiot", "idiots like you");
- a threat is aimed if an intent precedes the verb and its target stands between
  them or closely behind ("I will kill you", "werde dich töten"); a verb without
  both ("kill the process") is loose;
- either is negated by a negation at most `NEGATED_FOR` symbols before or directly
  behind it, and reported inside quotation marks, which hold over full stops to
  the end of the line, or by a verb of saying before it or at the sentence's end.

A document's score is a logistic function of its weighted matches. Loose words
weigh nothing by themselves; labelled rows alone can give them a weight.

Symbols come from short word lists of general English, German, French and
Spanish, and insults also from the labelled rows: words and stems that mark toxic
documents there. The weights of the kinds of match are fitted on the same rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storystream.llm.batches import map_slices
from storystream.session import materialize

#: At most so many labelled rows, those of the smallest hashes, are learned from
TRAINING_ROWS = 20_000
THRESHOLD = 0.7
#: A learned word or stem occurs in so many toxic documents at least ...
LEAST_DOCUMENTS = 5
#: ... and its smoothed log-odds of toxic against clean documents reach this
LEAST_LOG_ODDS = 3.0
#: Log-odds at which a learned word weighs as much as a listed one
FULL_LOG_ODDS = 5.0
STEM_LENGTHS = (4, 5, 6)

INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, QUOTE, OTHER = SYMBOLS = tuple("ITGNRWQ_")
#: How far, in symbols, a part of a pattern reaches
BEFORE, BEHIND, NEGATED_FOR, INTENDED_FOR, CLOSING = 4, 2, 4, 6, 3

SEED = {
    INSULT: "idiot moron stupid loser scum worthless pathetic disgusting fool imbecile dumbass bastard "
    "idiota estúpido imbécil crétin abruti salaud trottel blödmann arschloch dummkopf",
    THREAT: "kill murder hurt destroy beat stab strangle shoot umbringen töten matar tuer frapper",
    TARGET: "you your yours they them he she him her u du dich dir ihr euch sie vous tu te toi usted tú",
    NEGATION: "not no never neither nobody isn't aren't don't nicht kein keine niemals ne pas jamais nunca ni",
    REPORT: "said says say called calls claimed wrote quoted told asked sagte schrieb nannte dit écrit dijo escribió",
    INTENT: "will shall gonna going want wants must should i'll we'll they'll he'll she'll werde wird werden wollen "
    "soll sollte vais va allons veux voy vamos quiero quiere",
}

TOKEN = re.compile(r"[\w']+|[\"“”„«»]")
SENTENCE_END = re.compile(r"[.!?;]+")
MARKS = re.compile("[\"“”„«»]")


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine: `step(state, symbol)` gives the next state, and the state is what it says."""

    start: int
    states: tuple[int, ...]
    moves: dict[tuple[int, str], int]

    def step(self, state: int, symbol: str) -> int:
        return self.moves.get((state, symbol), self.moves.get((state, "*"), state))


def _scope(opener: str, length: int) -> Transducer:
    """Holds for `length` symbols after its opener."""
    moves = {(s, "*"): s - 1 for s in range(1, length + 1)} | {(0, "*"): 0}
    moves |= {(s, opener): length for s in range(length + 1)}
    return Transducer(0, tuple(range(length + 1)), moves)


def _flag(opener: str) -> Transducer:
    """Holds from its opener to the end of the sentence."""
    return Transducer(0, (0, 1), {(0, opener): 1})


def _quoted() -> Transducer:
    """Holds inside quotation marks."""
    return Transducer(0, (0, 1), {(0, QUOTE): 1, (1, QUOTE): 0})


def _intended(length: int) -> Transducer:
    """Holds for `length` symbols after an intent: 2 per symbol left, and 1 more once a target was named."""
    moves = {(s, "*"): s - 2 if s > 3 else 0 for s in range(2 * length + 2)}
    moves |= {(s, TARGET): (s - 2) | 1 if s > 3 else 0 for s in range(2 * length + 2)}
    moves |= {(s, INTENT): 2 * length for s in range(2 * length + 2)}
    return Transducer(0, tuple(range(2 * length + 2)), moves)


def _among_first(opener: str, length: int) -> Transducer:
    """Holds for good once its opener is among the first `length` symbols: `length` + 1, while counting up to `length`."""
    moves = {(s, "*"): min(s + 1, length) for s in range(length)} | {(length, "*"): length}
    moves |= {(s, opener): length + 1 for s in range(length)}
    return Transducer(0, tuple(range(length + 2)), moves)


HEADS, MOODS, AIMS = (INSULT, THREAT), ("asserted", "negated", "reported"), ("aimed", "loose")
KINDS = tuple(product(HEADS, MOODS, AIMS))


def compose(*machines: Transducer) -> dict[tuple[tuple[int, ...], str], tuple[int, ...]]:
    """The product of machines that read the same symbols, as one table of the states that can be reached."""
    start = tuple(m.start for m in machines)
    table, todo, seen = {}, [start], {start}
    while todo:
        states = todo.pop()
        for symbol in SYMBOLS:
            after = tuple(m.step(s, symbol) for m, s in zip(machines, states))
            table[states, symbol] = after
            if after not in seen:
                seen.add(after)
                todo.append(after)
    return table


QUOTED = _quoted()
FROM_LEFT = (_scope(NEGATION, NEGATED_FOR), _flag(REPORT), _scope(TARGET, BEFORE), _intended(INTENDED_FOR), QUOTED)
FROM_RIGHT = (_scope(NEGATION, 1), _among_first(REPORT, CLOSING), _scope(TARGET, BEHIND))
LEFT, RIGHT = compose(*FROM_LEFT), compose(*FROM_RIGHT)
LEFT_START, RIGHT_START = tuple(m.start for m in FROM_LEFT), tuple(m.start for m in FROM_RIGHT)


def judge(head: str, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[str, str, str]:
    """The kind of match where a head stands between two states."""
    negated, reported, addressed, intended, quoted = left
    negated_after, said_after, addressed_after = right
    if negated or negated_after:
        mood = "negated"
    else:
        mood = "reported" if reported or quoted or said_after > CLOSING else "asserted"
    if head == INSULT:
        aimed = addressed or addressed_after
    else:
        aimed = intended & 1 or (intended and addressed_after)
    return head, mood, "aimed" if aimed else "loose"


def read_clause(symbols: Iterable[tuple[str, float]], quoted: int = 0) -> dict[tuple[str, str, str], float]:
    """Weight of each kind of match in one sentence of (symbol, weight), which may begin inside a quotation."""
    read, state, lefts = list(symbols), (*LEFT_START[:-1], quoted), {}
    for at, (symbol, _) in enumerate(read):
        if symbol in HEADS:
            lefts[at] = state
        state = LEFT[state, symbol]
    total: dict[tuple[str, str, str], float] = {}
    state = RIGHT_START
    for at in range(len(read) - 1, min(lefts, default=len(read)) - 1, -1):
        symbol, weight = read[at]
        if at in lefts:
            kind = judge(symbol, lefts[at], state)
            total[kind] = total.get(kind, 0.0) + weight
        state = RIGHT[state, symbol]
    return total


@dataclass
class Model:
    """Word and stem weights by symbol, and the weights of the kinds of match."""

    words: dict[str, tuple[str, float]]
    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    weights: tuple[float, ...] = ()

    def symbol(self, word: str) -> tuple[str, float]:
        found = self.words.get(word)
        if found:
            return found
        for length in STEM_LENGTHS:
            weight = self.stems.get(word[:length])
            if weight:
                return INSULT, weight
        return (QUOTE, 0.0) if not word[0].isalnum() and word[0] in "\"“”„«»" else (OTHER, 0.0)

    def heads(self) -> set[str]:
        """The words that can head a match."""
        return {w for w, (symbol, _) in self.words.items() if symbol in HEADS}


def matches(text: str | None, model: Model, known: set[str]) -> list[float]:
    """Weight of the matches of each kind in a whole text; `known` holds the words that head a match."""
    found = dict.fromkeys(KINDS, 0.0)
    low = (text or "").lower()
    words = set(TOKEN.findall(low))
    heads = words & known
    if model.stems:
        stems = model.stems
        heads |= {w for w in words if w[:4] in stems or w[:5] in stems or w[:6] in stems}
    if heads:
        for line in low.split("\n"):
            marks, quoted = MARKS.search(line) is not None, QUOTED.start
            for sentence in SENTENCE_END.split(line):
                tokens = TOKEN.findall(sentence)
                if not heads.isdisjoint(tokens):
                    for kind, weight in read_clause(map(model.symbol, tokens), quoted).items():
                        found[kind] += weight
                if marks and len(MARKS.findall(sentence)) % 2:
                    quoted = QUOTED.step(quoted, QUOTE)
    return [found[kind] for kind in KINDS]


def _seed_words() -> dict[str, tuple[str, float]]:
    return {word: (symbol, 1.0) for symbol, words in SEED.items() for word in words.split()}


#: What is believed of a kind of match before any label is seen; rare kinds stay near it, and loose words say nothing
PRIOR = tuple(
    {"asserted": 4.0, "negated": 0.3, "reported": 0.5}[mood] * (1.5 if aim == "aimed" else 0.0)
    for _, mood, aim in KINDS
)
#: How firmly it is believed: of loose words labels may easily say more
FIRMNESS = (0.5, *(0.5 if aim == "aimed" else 0.05 for _, _, aim in KINDS))


def _fit(rows: list[tuple[list[float], int]]) -> tuple[float, tuple[float, ...]]:
    """Ridge logistic regression around the prior, by Newton steps that are halved until they gain."""
    start = np.array([-3.0, *PRIOR])
    if not rows:
        return start[0], tuple(start[1:])
    x = np.column_stack([np.ones(len(rows)), np.log1p(np.array([r[0] for r in rows]))])
    y = np.array([r[1] for r in rows], float)
    ridge = np.array(FIRMNESS)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (ridge * (w - start) ** 2).sum())

    w = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (p - y) + ridge * (w - start)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        # A whole step may lead far beyond the minimum, where the curve is flat and the next one leads back
        before, descent, share = loss(w), float(gradient @ step), 1.0
        while loss(w - share * step) > before - 1e-4 * share * descent and share > 1e-9:
            share /= 2
        if share <= 1e-9:
            break
        w -= share * step
        if np.abs(share * step).max() < 1e-6:
            break
    return float(w[0]), tuple(map(float, w[1:]))


def _features_of(text: str | None) -> set[str]:
    words = {w for w in TOKEN.findall((text or "").lower()) if len(w) > 2}
    return words | {f"{w[:n]}*" for w in words for n in STEM_LENGTHS if len(w) > n}


def _document_counts(rows: DataFrame, only: set[str] | None) -> DataFrame:
    """Rows (feature, n): in how many texts each word and stem occurs, summed in each task first."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = _features_of(text)
                counts.update(found if only is None else found & only)
        import pyarrow as pa

        names = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[n] for n in names], pa.int64())],
            names=["feature", "n"],
        )

    return rows.select("text").mapInArrow(run, "feature string, n bigint").groupBy("feature").agg(
        F.sum("n").alias("n")
    )


def _learn_insults(train: DataFrame) -> tuple[dict[str, tuple[str, float]], dict[str, float]]:
    toxic, clean = train.where("toxic = 1"), train.where("toxic = 0")
    sizes = dict(train.groupBy("toxic").count().collect())
    seen = _document_counts(toxic, None).where(F.col("n") >= LEAST_DOCUMENTS).collect()
    in_toxic = {r.feature: r.n for r in seen}
    if not in_toxic or not sizes.get(0):
        return {}, {}
    in_clean = {r.feature: r.n for r in _document_counts(clean, set(in_toxic)).collect()}

    def odds(feature: str) -> float:
        p = (in_toxic[feature] + 0.5) / (sizes[1] + 1)
        q = (in_clean.get(feature, 0) + 0.5) / (sizes[0] + 1)
        return math.log(p / q)

    strong = {f for f in in_toxic if odds(f) >= LEAST_LOG_ODDS}
    words = {f for f in strong if not f.endswith("*")}
    stems: set[str] = set()
    for stem in sorted((f[:-1] for f in strong if f.endswith("*")), key=len):
        whole = max((in_toxic[w] for w in words if w.startswith(stem)), default=0)
        shorter = any(stem[:n] in stems for n in STEM_LENGTHS if n < len(stem))
        # A stem says more than its words only if no single word makes up most of it
        if not shorter and whole < 0.8 * in_toxic[f"{stem}*"]:
            stems.add(stem)
    weight = lambda feature: min(1.0, odds(feature) / FULL_LOG_ODDS)
    return {w: (INSULT, weight(w)) for w in words}, {s: weight(f"{s}*") for s in stems}


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """Rows (text, toxic) of at most `limit` labelled documents that are not held out.

    The labels are chosen before any text is read, so the join ships only them,
    and their number is bounded by `limit`. Labels whose hash is too high to be
    among them are left out where they are, so about `limit` rows are sorted.
    """
    usable = (
        labels.select("doc_id", "toxic")
        .where("toxic IN (0, 1) AND doc_id IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
    )
    # Of n evenly spread hashes the smallest `limit` lie below this bound but for a chance of less than 1e-9
    share = (limit + 6 * math.sqrt(limit) + 40) / max(usable.count(), 1)
    if share < 1:
        usable = usable.where(F.xxhash64("doc_id") < -(2**63) + int(share * 2**64))
    usable = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("text", "toxic")


def held_out(doc_id) -> F.Column:
    """True for the rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _matching(model: Model):
    def make():
        known = model.heads()

        def apply(texts, *rest):
            return [[matches(text, model, known) for text in texts], *rest]

        return apply

    return make


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> Model:
    """Fit a model; without labels of both kinds it is the word lists with the prior weights."""
    rows = materialize(training_rows(docs, labels, limit), "toxicity-training")
    words, stems = _learn_insults(rows)
    model = Model(words | _seed_words(), stems)
    seen = map_slices(rows, _matching(model), "found array<double>, toxic int").collect()
    if {r.toxic for r in seen} == {0, 1}:
        model.bias, model.weights = _fit([(r.found, r.toxic) for r in seen])
    else:
        model.bias, model.weights = _fit([])
    return model


def scorer(model: Model):
    """A column function: text to a score from 0 to 1."""
    known = model.heads()
    weights, bias = np.array(model.weights), model.bias

    @F.pandas_udf("double")
    def score(texts):
        found = np.array([matches(t, model, known) for t in texts]).reshape(len(texts), len(KINDS))
        z = np.log1p(found) @ weights + bias
        return texts.__class__(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per document.

    Null and empty texts hold no match and score the bias alone. A null doc_id
    is not held out. Repeated rows score alike; other columns are ignored; an
    empty table gives an empty result.
    """
    score = scorer(train(docs, labels, limit))
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """The rows of `docs` that score below the threshold, all columns as they are."""
    score = scorer(train(docs, labels, limit))
    return docs.where(score("text") < THRESHOLD)
