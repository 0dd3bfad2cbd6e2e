"""Secrets in texts, by lexing assignments.

Source and configuration syntax (`name = "literal"`, `name: literal`,
`"name" => 'literal'`, `name: type = literal`, `table["name"] = literal`, escaped and
triple quotes) is read into name-literal pairs. A literal may be another
name: constants are propagated to where they are used. A literal is scored by how
sensitive the names are that it reaches, times how random it looks; a passphrase may
be made of words. Three plain patterns are reported beside this.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame

from storystream.llm.batches import map_slices

# Fixed patterns; re.ASCII keeps letters of other scripts from folding into them
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

#: How much a part of a name says that its value is secret
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0,
    "auth": 0.6, "key": 0.5, "private": 0.5, "access": 0.4, "api": 0.4, "signature": 0.5, "salt": 0.5,
}
THRESHOLD = 0.5
#: A literal of fewer characters is never a secret
LEAST_LITERAL = 8

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
_OPERATOR = re.compile(r"[:=]")
_VALUE = re.compile(
    r"""[=>]?[ \t]*(?:\"{3}([\s\S]*?)\"{3}|'{3}([\s\S]*?)'{3}"""
    r"""|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z0-9+/_.=~-]+))"""
)
#: Group of a value without quotes
BARE = 5
_ANNOTATION = re.compile(r"[ \t]*[A-Za-z_][A-Za-z0-9_.]*(?:\[[^\]\n]*\])?[ \t]*")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Pair(NamedTuple):
    name: str
    value: str
    start: int
    end: int
    quoted: bool


def pairs(text: str) -> list[Pair]:
    """Name-literal pairs in the order of the text; positions are those of the literal."""
    found = []
    done = 0
    typed: tuple[str, int] | None = None
    for operator in _OPERATOR.finditer(text):
        at = operator.start()
        if at < done or text.startswith("://", at):
            continue
        last = at
        while last > done and text[last - 1] in " \t":
            last -= 1
        if last - 1 > done and text[last - 1] == "]" and text[last - 2] in "\"'":
            last -= 1
        if last > done and text[last - 1] in "\"'":
            last -= 1
        first = last
        while first > done and text[first - 1] in _CHARS:
            first -= 1
        value = _VALUE.match(text, operator.end())
        # `name: type = literal`: the literal goes to the name before the annotation too, the type is none
        target = typed if typed and text[at] == "=" and _ANNOTATION.fullmatch(text, typed[1], at) else None
        typed = None
        if not value or (first == last and not target):
            continue
        group = value.lastindex
        literal = (value[group], value.start(group), value.end(group), group < BARE)
        if target:
            found.pop()
        if first < last:
            found.append(Pair(text[first:last], *literal))
            if text[at] == ":" and group == BARE:
                typed = (text[first:last], operator.end())
        if target:
            found.append(Pair(target[0], *literal))
        # A bare value may itself be a name that another operator follows: only quoted text is closed
        done = value.end() if group < BARE else operator.end()
    return found


def _parts(name: str) -> set[str]:
    """Lower-case parts of a name, and each two neighbours as one."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return {*parts, *(a + b for a, b in zip(parts, parts[1:]))}


def sensitivity(name: str) -> float:
    """How sensitive a target name is, from 0 to 1: its parts add up like independent hints."""
    doubt = 1.0
    for part in _parts(name):
        doubt *= 1 - NAME_WEIGHTS.get(part, 0.0)
    return 1 - doubt


def randomness(literal: str, worded: bool = False) -> float:
    """From 0 (one repeated character, a word) to 1: entropy per character, more for digits mixed in.

    A literal with spaces is text and scores 0, unless it may be made of words.
    """
    if len(literal) < LEAST_LITERAL or (" " in literal and not worded):
        return 0.0
    counts = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    mixed = any(c.isdigit() for c in literal) and any(c.isalpha() for c in literal)
    return min(1.0, entropy / 3.5) * (1.0 if mixed else 0.6)


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name.

    A bare value that is assigned somewhere stands for its literal, so a constant
    gets the sensitivity of every name it is handed to: that of the last assignment
    before it, or without one that of the last after it.
    """
    constants: dict[str, Pair] = {}
    reach: dict[tuple[int, int], float] = {}
    worded: set[tuple[int, int]] = set()
    early: list[Pair] = []

    def hand(origin: Pair, name: str) -> None:
        span = (origin.start, origin.end)
        reach[span] = max(reach.get(span, 0.0), sensitivity(name))
        if origin.quoted and "passphrase" in _parts(name):
            worded.add(span)

    for pair in pairs(text):
        origin = pair
        if not pair.quoted and _IDENTIFIER.match(pair.value):
            origin = constants.get(pair.value, pair)
            if origin is pair:
                early.append(pair)
        constants[pair.name] = origin
        hand(origin, pair.name)
    for pair in early:
        walked: dict[str, None] = {}
        origin = pair
        while not origin.quoted and origin.value in constants and origin.value not in walked:
            walked[origin.value] = None
            origin = constants[origin.value]
        # Later walks of the same chain take one step
        constants.update(dict.fromkeys(walked, origin))
        if origin is not pair:
            hand(origin, pair.name)
    scored = ((a, b, r * randomness(text[a:b], (a, b) in worded)) for (a, b), r in reach.items())
    return sorted((a, b, round(s, 6)) for a, b, s in scored if s >= threshold)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, spans) with spans an array of (kind, start, end, score, text), one row per document.

    Positions are code points, ends exclusive; the plain patterns score 1. A null
    or empty text has no spans. Null ids and repeated rows are kept; other
    columns are ignored; an empty table gives an empty result.
    """

    def make():
        def apply(ids, texts):
            out = []
            for text in texts:
                text = text or ""
                spans = [(start, kind, end, 1.0) for start, kind, end in base_spans(text)]
                spans += [(start, 3, end, s) for start, end, s in literal_spans(text, threshold)]
                out.append(
                    [
                        {"kind": KINDS[k], "start": a, "end": b, "score": s, "secret": text[a:b]}
                        for a, k, b, s in sorted(spans)
                    ]
                )
            return [ids, out]

        return apply

    return map_slices(
        docs.select("doc_id", "text"),
        make,
        "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double,secret:string>>",
    )


def base_digest(text: str | None) -> str:
    """SHA-256 of the plain patterns' spans, for comparison."""
    return hashlib.sha256(_joined(base_spans(text or "")).encode()).hexdigest()
