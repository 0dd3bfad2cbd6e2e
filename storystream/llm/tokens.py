"""Token counts of the sections of a document, from one encoding of the whole.

A byte-level vocabulary loses nothing: the lengths of a document's tokens in
bytes add up to the document, so their running sum gives every token's place.
Tokens are laid over the sections by two sorted searches - an interval join
inside the document - and a token that crosses a boundary is given to a section
by a stated rule. Nothing is shuffled, and no token becomes a row.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storystream.llm.batches import map_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut before its merges; a fixed part of the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "majority")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoding and the byte length of each token id; read once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def spread_tokens(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section; `ends` are the tokens' ends and `bounds` the sections' ends, in bytes.

    start: a token belongs to the section of its first byte; end: to that of its
    last; majority: to the section that holds most of its bytes, the earlier one
    on a tie. Each token is counted once, so the sections add up to the document.
    """
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends - 1, side="right")
    owner = first.copy() if rule == "start" else last.copy()
    if rule == "majority":
        owner = first.copy()
        for i in np.flatnonzero(first != last):
            inner = bounds[first[i] : last[i]]
            pieces = np.diff(np.concatenate([[starts[i]], inner, [ends[i]]]))
            owner[i] = first[i] + int(np.argmax(pieces))
    return np.bincount(owner, minlength=len(bounds))


def sections_of(text: str) -> list[str]:
    """Lines with their line feeds; an empty text is one empty section."""
    lines = text.split("\n")
    return [f"{line}\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] or not text else [])


def token_counts(
    docs: DataFrame,
    fields: tuple[str, ...] = ("text",),
    rule: str = "majority",
    vocabulary: str = VOCABULARY,
    id_column: str = "doc_id",
) -> DataFrame:
    """Rows (doc_id, field, section, start, end, n_tokens, doc_tokens), one per section.

    The fields of a row are joined in the given order and encoded as one text;
    sections are the lines of a field with their line feeds, `start` and `end`
    are code points within the field. A null or empty field has one section of no
    tokens. `doc_tokens` is the length of the whole encoding. Repeated rows give
    repeated results; other columns are ignored; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def make():
        encoding, lengths = encoder(vocabulary)

        def apply(ids, *columns):
            out: list[list] = [[] for _ in range(7)]
            for row, values in enumerate(zip(*columns)):
                parts = [
                    (name, number, section)
                    for name, value in zip(fields, values)
                    for number, section in enumerate(sections_of(value or ""))
                ]
                raw = [s.encode("utf-8", "replace") for _, _, s in parts]
                whole = b"".join(raw)
                ids_of = encoding.encode_ordinary(whole.decode("utf-8"))
                ends = np.cumsum(lengths[np.array(ids_of, np.int64)]) if ids_of else np.empty(0, np.int64)
                # An empty section ends where the one before it does and gets no token
                counts = spread_tokens(ends, np.cumsum([len(r) for r in raw]), rule)
                start = 0
                for (name, number, section), n in zip(parts, counts):
                    start = start if number else 0
                    values_out = (ids[row], name, number, start, start + len(section), int(n), len(ids_of))
                    for column, value in zip(out, values_out):
                        column.append(value)
                    start += len(section)
            return out

        return apply

    return map_slices(
        docs.select(F.col(id_column), *(F.col(f"`{f}`").cast("string") for f in fields)),
        make,
        "doc_id bigint, field string, section int, start bigint, end bigint, "
        "n_tokens bigint, doc_tokens bigint",
    )
