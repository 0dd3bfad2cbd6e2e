"""Column functions on article text, dates and identifiers."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace as Python's str.strip()/split() sees it. `\s` under (?U) lacks
# the four separators 1c-1f.
WHITESPACE = r"[\s\x1c-\x1f]"

# Line ends as Python's str.splitlines() sees them
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Lines an aggregator feed adds around the article text
BOILERPLATE_PREFIXES = [
    "Article URL:",
    "Comments URL:",
    "Points:",
    "# Comments:",
    "Related:",
]
MIN_EMBEDDING_CONTENT = 40
MAX_EMBEDDING_TEXT = 1000

# Markup that carries no text: comments, declarations, elements whose text is code, tags.
# Leftmost-first alternation, so a script's body goes with the script.
HTML_MARKUP = (
    r"(?is)<!--.*?-->"
    r"|<(script|style|template)\b[^>]*>.*?</\1\s*>"
    r"|<[!?][^>]*>"
    r"""|</?[a-z](?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
    r"|</?[a-z][^>]*>"
)

# The entities feeds use most; `&amp;` comes last so that nothing is decoded twice
COMMON_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
]


def first_nonempty(value: Column, default: str = "") -> Column:
    return F.coalesce(value, F.lit(default))


def is_present(value: Column) -> Column:
    """Neither NULL nor empty; blanks count as present."""
    return F.coalesce(F.length(value), F.lit(0)) > 0


def strip(value: Column) -> Column:
    """Drop leading and trailing Unicode whitespace, not only spaces."""
    return F.regexp_replace(value, rf"(?U)\A{WHITESPACE}+|{WHITESPACE}+\z", "")


def is_valid_entry(title: Column, link: Column) -> Column:
    return is_present(title) & is_present(link)


def is_valid_payload(source: Column, title: Column, url: Column) -> Column:
    return is_present(source) & is_present(title) & is_present(url)


def article_time(published_at: Column, created_at: Column) -> Column:
    return F.coalesce(published_at, created_at)


def placeholder_url(url: Column, source_name: Column) -> Column:
    """Feed URL of a source whose message did not carry one."""
    return F.when(is_present(url), url).otherwise(F.concat(F.lit("source://"), source_name))


def entity_key(name: Column) -> Column:
    return F.lower(name)


def strip_markup(value: Column) -> Column:
    return F.regexp_replace(first_nonempty(value), HTML_MARKUP, "")


def html_text(value: Column) -> Column:
    """Visible text of an HTML fragment, JVM-side, with the common entities decoded."""
    text = strip_markup(value)
    for entity, character in COMMON_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_text_full(value: Column) -> Column:
    """As `html_text` with every named and numeric entity; only text with `&` leaves the JVM."""
    text = strip_markup(value)
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def classification_text(title: Column, content: Column) -> Column:
    return F.concat(title, F.lit("\n"), first_nonempty(content))


def embedding_text(title: Column, content: Column) -> Column:
    """Text an article is embedded by: the title alone when little else remains."""
    prefixes = "|".join(BOILERPLATE_PREFIXES)
    boilerplate = rf"(?U)\A{WHITESPACE}*(?:{prefixes})"
    lines = F.split(first_nonempty(content), LINE_END)
    body = strip(F.array_join(F.filter(lines, lambda line: ~line.rlike(boilerplate)), "\n"))
    return F.when(F.length(body) < MIN_EMBEDDING_CONTENT, title).otherwise(
        F.substring(F.concat(title, F.lit(". "), body), 1, MAX_EMBEDDING_TEXT)
    )


def parse_iso(value: Column) -> Column:
    """ISO 8601 text to a timestamp; without an offset it is UTC; anything else is NULL."""
    extended = F.when(
        value.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?"
                    r"(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"),
        F.regexp_replace(F.replace(value, F.lit(","), F.lit(".")),
                         r"^(\S{10}[T ]\d{2})(Z|[+-]|$)", "$1:00$2"),
    )
    extended = F.regexp_replace(extended, r"([+-]\d{2})(\d{2})$", "$1:$2")
    extended = F.regexp_replace(extended, r"(:\S*[+-]\d{2})$", "$1:00")
    return F.coalesce(
        extended.try_cast("timestamp"),
        F.try_to_timestamp(F.when(value.rlike(r"^\d{8}$"), value), F.lit("yyyyMMdd")),
        F.try_to_timestamp(F.when(value.rlike(r"^\d{8}T\d{6}$"), value), F.lit("yyyyMMdd'T'HHmmss")),
        F.try_to_timestamp(
            F.when(value.rlike(r"^\d{8}T\d{6}(?:Z|[+-]\d{4})$"), value),
            F.lit("yyyyMMdd'T'HHmmssXX"),
        ),
    )


# The zone names of RFC 822; any other name counts as UTC
RFC822_ZONES = {
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def parse_rfc822(value: Column) -> Column:
    """`Tue, 03 Sep 2024 10:11:12 GMT` and its variants; without a zone it is UTC."""
    bare = F.regexp_replace(F.trim(value), r"^[A-Za-z]+,?\s+(?=\d)", "")
    bare = F.regexp_replace(bare, r"\s+", " ")
    bare = F.regexp_replace(bare, r"^(\d{1,2} \w{3} \d{4} \d{2}:\d{2})( |$)", "$1:00$2")
    for zone, offset in RFC822_ZONES.items():
        bare = F.regexp_replace(bare, f" {zone}$", f" {offset}")
    bare = F.regexp_replace(bare, r"(:\d{2}:\d{2})(?: [A-Z]{1,5})?$", "$1 +0000")
    return F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss xx"))


def parse_published(*fields: Column) -> Column:
    """First of the entry's date fields that reads as a date, in UTC."""
    return F.coalesce(*[F.coalesce(parse_rfc822(f), parse_iso(f)) for f in fields])


def iso_format(value: Column) -> Column:
    """Timestamp as ISO 8601 in UTC; the fraction is written only where there is one."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(value, "SSSSSS")
    return F.concat(
        whole, F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("+00:00")
    )
