"""Keyword topic classification in one regular-expression pass over the text."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

UNCATEGORIZED = "Uncategorized"

# Topics and their keywords
TAXONOMY = {
    "Artificial Intelligence": [
        "ai", "chatgpt", "llm", "machine learning", "openai", "anthropic", "claude",
    ],
    "Robotics": ["robot", "robotics", "automation", "drone", "humanoid"],
    "Space": ["nasa", "spacex", "satellite", "rocket", "orbit", "astronaut"],
    "Business & Finance": ["funding", "valuation", "ipo", "acquisition", "investor", "startup"],
    "Policy & Regulation": ["regulation", "lawsuit", "congress", "senate", "ftc", "antitrust"],
    "Gaming & Entertainment": ["game", "gaming", "movie", "streaming", "netflix"],
    "Cybersecurity": ["hack", "breach", "vulnerability", "malware", "exploit"],
    "Consumer Tech": [
        "iphone", "ipad", "android", "google pixel", "pixel watch", "noise cancellation",
        "smartphone", "smartwatch", "apple watch", "airpods", "earbud", "headphone", "wearable",
        "laptop", "macbook", "chromebook", "foldable", "fitbit", "smart glasses",
    ],
}

# Further forms of a keyword, beside its plurals in -s and -es
EXTRA_FORMS = {
    "hack": ["hacked", "hacker", "hackers", "hacking"],
    "breach": ["breached"],
    "exploit": ["exploited", "exploiting"],
    "orbit": ["orbital", "orbiting"],
    "robot": ["robotic"],
}

# Words that must not follow a keyword ("Hacker News" is a site name)
NOT_FOLLOWED_BY = {"hack": ["news"]}

TOPICS = list(TAXONOMY)

# Word characters and whitespace as Python's `\b` and `\s` see them. ASCII comes first in the
# class because almost every character is decided there.
WORD = r"[a-z0-9_\p{L}\p{N}]"
STARTS, ENDS = f"(?<!{WORD})", f"(?!{WORD})"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def keyword_forms(keyword: str) -> list[str]:
    """Every spelling that counts as the keyword, words separated by one space."""
    return [keyword + ending for ending in ("", "s", "es")] + EXTRA_FORMS.get(keyword, [])


def _alternatives(keyword: str, skip: int = 0) -> str:
    """The keyword's forms, without their first `skip` characters, as alternatives."""
    return "|".join(re.escape(form[skip:]).replace(r"\ ", SPACE) for form in keyword_forms(keyword))


def _guard(keyword: str) -> str:
    words = "|".join(NOT_FOLLOWED_BY.get(keyword, []))
    return f"(?!{SPACE}(?:{words}){ENDS})" if words else ""


def keyword_pattern(keyword: str) -> str:
    """Regular expression of one keyword as whole words, for `rlike` on lower-cased text.

    The keyword's first word, which all forms start with, stands first as plain letters: the engine searches for it
    as a string, and looks at the character before it only where it is found, not at every character of the text.
    """
    head = keyword.split(" ")[0]
    starts = f"(?<!{WORD}{head})"
    return f"{head}{starts}(?:{_alternatives(keyword, len(head))}){ENDS}{_guard(keyword)}"


def taxonomy_pattern() -> str:
    """One expression for all keywords, whose group 1 is the form found at a word start.

    The form is captured by a lookahead, so phrases that share a word ("google
    pixel watch") are both found. No two keywords have forms that match whole
    at the same place, so the first alternative to match is the only one. The
    alternatives are grouped by first letter: most words fail on one character.
    """
    keywords = sorted(keyword for words in TAXONOMY.values() for keyword in words)
    groups = [
        letter + "(?:" + "|".join(f"(?:{_alternatives(k, 1)}){ENDS}{_guard(k)}" for k in same_letter) + ")"
        for letter, same_letter in groupby(keywords, key=lambda keyword: keyword[0])
    ]
    return f"{STARTS}(?=({'|'.join(groups)}))"


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.transform(F.array(value), body)[0]


def topic_hits(text: Column) -> Column:
    """Distinct `(topic, keyword)` pairs found in the text, each once."""
    entries = ", ".join(
        f"'{form}', named_struct('topic', '{topic}', 'keyword', '{keyword}')"
        for topic, keywords in TAXONOMY.items()
        for keyword in keywords
        for form in keyword_forms(keyword)
    )
    keyword_of = F.expr(f"map({entries})")
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(taxonomy_pattern()), 1))
    return F.array_distinct(
        F.transform(found, lambda form: F.element_at(keyword_of, F.regexp_replace(form, SPACE, " ")))
    )


def _count_of(hits: Column, topic: str) -> Column:
    return F.size(F.filter(hits, lambda hit: hit["topic"] == topic))


def topic_scores(text: Column) -> Column:
    """Number of matching keywords per topic, in the order of `TOPICS`."""
    return _let(
        topic_hits(text),
        lambda hits: F.array(*[_count_of(hits, topic) for topic in TOPICS]),
    )


def best_topic(scores: Column) -> Column:
    """The topic with the highest score; none found or a tie is Uncategorized."""
    topics = F.array(*[F.lit(topic) for topic in TOPICS])
    return _let(
        scores,
        lambda s: F.when(
            (F.array_max(s) > 0) & (F.size(F.filter(s, lambda x: x == F.array_max(s))) == 1),
            F.element_at(topics, F.array_position(s, F.array_max(s)).cast("int")),
        ).otherwise(UNCATEGORIZED),
    )


def classify_topic(text: Column) -> Column:
    return best_topic(topic_scores(text))
