import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from models import lcs, ratio
from storystream.functions import text as x
from storystream.functions.fuzzy import Titles, pair_scores, scores, token_sort_ratio
from storystream.functions.topics import (
    EXTRA_FORMS,
    TAXONOMY,
    UNCATEGORIZED,
    classify_topic,
    keyword_forms,
    ENDS,
    STARTS,
    _alternatives,
    _guard,
    keyword_pattern,
    topic_hits,
)
from storystream.functions.vectors import is_usable, l2_normalize

AI, CYBER, SPACE, TECH = "Artificial Intelligence", "Cybersecurity", "Space", "Consumer Tech"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_topic_rules(spark):
    cases = [
        # a keyword inside a longer word is none
        ("Maintain the shackle of an aircraft", UNCATEGORIZED),
        ("A tripod recipe from the endgame gamer", UNCATEGORIZED),
        ("Pixels and unfoldable maps; watch an apple", UNCATEGORIZED),
        ("àai aié ai_ 2ai", UNCATEGORIZED),
        # whole words in any case, next to punctuation, plurals
        ("Why AI?", AI),
        ("(ai)-driven", AI),
        ("LLMs everywhere", AI),
        ("Three breaches", CYBER),
        # phrases over any run of whitespace
        ("machine\n\t learning", AI),
        ("machine-learning", UNCATEGORIZED),
        ("google pixel watch and a laptop", TECH),
        # further forms
        ("hacked", CYBER),
        ("an orbiting telescope", SPACE),
        # the site's name is no attack, another mention is
        ("seen on Hacker  News today", UNCATEGORIZED),
        ("hacker news about a hacker", CYBER),
        ("hacker newsletter", CYBER),
        # each keyword counts once; the higher score wins, a tie does not
        ("ai ai ai malware breach", CYBER),
        ("ai openai lawsuit", AI),
        ("ai startup", UNCATEGORIZED),
        ("", UNCATEGORIZED),
    ]
    df = spark.createDataFrame(cases, "text string, expected string")
    wrong = df.withColumn("got", classify_topic(F.col("text"))).filter("got <> expected").collect()
    assert wrong == []


def test_every_form_matches_its_topic_alone(spark):
    rows = [(form, topic) for topic, ks in TAXONOMY.items() for k in ks for form in keyword_forms(k)]
    df = spark.createDataFrame(rows, "text string, expected string")
    assert df.filter(classify_topic(F.concat(F.lit("The "), "text", F.lit("."))) != F.col("expected")).count() == 0


def test_keyword_patterns_search_a_word_first_and_match_whole_words_only(spark):
    """A pattern that begins with a lookbehind is tried at every character, one that begins with letters is not."""
    keywords = [k for ks in TAXONOMY.values() for k in ks]
    assert all(keyword_pattern(k).startswith(k.split(" ")[0]) for k in keywords)
    around = ["", " ", "x", "é", "7", "_", "-", "\n", "\U0001d4d0", "s", "hack"]
    rows = [(b + f.replace(" ", "\t ") + a,) for k in keywords for f in keyword_forms(k) for b in around for a in (*around, " news")]
    df = spark.createDataFrame(rows, "text string").cache()
    for keyword in ["ai", "hack", "robot", "google pixel", "machine learning"]:
        slow = f"{STARTS}(?:{_alternatives(keyword)}){ENDS}{_guard(keyword)}"
        counts = df.agg(
            F.count_if(F.col("text").rlike(slow)), F.count_if(F.col("text").rlike(slow) != F.col("text").rlike(keyword_pattern(keyword)))
        ).first()
        assert counts[0] > 0 and counts[1] == 0


def test_combined_pattern_agrees_with_single_patterns(spark):
    words = sorted({w for ks in TAXONOMY.values() for k in ks for w in keyword_forms(k)}) + ["news", "of"]
    rows = [(" ".join(words[(i * 7 + j * j) % len(words)] for j in range(12)),) for i in range(150)]
    df = spark.createDataFrame(rows, "text string")
    for keyword in [*EXTRA_FORMS, "google pixel", "pixel watch", "ai"]:
        single = F.col("text").rlike(keyword_pattern(keyword))
        combined = F.exists(topic_hits(F.col("text")), lambda h: h["keyword"] == keyword)
        assert df.filter(single != combined).count() == 0


@pytest.mark.parametrize(
    "value,expected",
    [
        ("2024-09-03T10:11:12Z", "2024-09-03 10:11:12"),
        ("2024-09-03T10:11:12.5+02:00", "2024-09-03 08:11:12.5"),
        ("2024-09-03 10:11", "2024-09-03 10:11:00"),
        ("2024-09-03", "2024-09-03 00:00:00"),
        ("20240903T101112", "2024-09-03 10:11:12"),
        ("2024", None),
        ("2024-13-01", None),
        ("yesterday", None),
        ("", None),
    ],
)
def test_parse_iso(spark, value, expected):
    got = one(spark, x.parse_iso(F.lit(value)))
    assert got == (dt.datetime.fromisoformat(expected) if expected else None)


@pytest.mark.parametrize(
    "value,expected",
    [
        ("Tue, 03 Sep 2024 10:11:12 GMT", "2024-09-03 10:11:12"),
        ("3 Sep 2024 10:11:12 -0500", "2024-09-03 15:11:12"),
        ("Tue, 3 Sep 2024 10:11 EST", "2024-09-03 15:11:00"),
        ("3 Sep 2024 10:11:12", "2024-09-03 10:11:12"),
        ("2024-09-03T10:11:12Z", "2024-09-03 10:11:12"),
    ],
)
def test_parse_published(spark, value, expected):
    got = one(spark, x.parse_published(F.lit("no date"), F.lit(value)))
    assert got == dt.datetime.fromisoformat(expected)


def test_html_text(spark):
    html = (
        '<!DOCTYPE html><p title="a>b">1 &lt; 2 &amp;lt; 3 < 4</p><script>var t="</p>";</script>'
        "<!-- <b>no</b> --><STYLE>p{}</STYLE><template><i>t</i></template>Caf&eacute;&#8217;s"
    )
    assert one(spark, x.html_text_full(F.lit(html))) == "1 < 2 &lt; 3 < 4Café’s"
    assert one(spark, x.html_text(F.lit(html))) == "1 < 2 &lt; 3 < 4Caf&eacute;&#8217;s"
    assert one(spark, x.html_text_full(F.lit(None).cast("string"))) == ""


def test_strip_and_presence(spark):
    assert one(spark, x.strip(F.lit(" \x1c a b\n "))) == "a b"
    assert one(spark, x.is_present(F.lit(" "))) and not one(spark, x.is_present(F.lit("")))


def test_embedding_text(spark):
    long = "word " * 400
    text = lambda content: one(spark, x.embedding_text(F.lit("Title"), F.lit(content)))
    assert text("Points: 3\r\n  # Comments: 4\n" + "x" * 39) == "Title"
    assert text("Points: 3 " + "x" * 40) == "Title. " + "x" * 40
    assert text(long) == ("Title. " + long)[:1000]


def test_title_scores(spark):
    titles = ["", "a", "b a", "a b", "é" * 7, "é" * 8, "abc " * 30, "abd " * 31, "x" * 300, "日本 語", "c" * 127]
    pairs = [(a, b) for a in titles for b in titles]
    keys = [(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) for a, b in pairs]
    expected = [ratio(a, b) for a, b in pairs]
    assert list(pair_scores(*zip(*keys))) == pytest.approx(expected)
    block = Titles([" ".join(sorted(t.split())) for t in titles])
    n = len(titles)
    i, j = [k // n for k in range(n * n)], [k % n for k in range(n * n)]
    assert list(scores(block, block, np.array(i), np.array(j))) == pytest.approx(expected)
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(token_sort_ratio(F.col("a"), F.col("b"))).collect()] == pytest.approx(expected)
    assert lcs("abcde", "ace") == 3


def test_vectors(spark):
    assert one(spark, l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert not one(spark, is_usable(F.array(F.lit(0.0))))
    assert not one(spark, is_usable(F.lit(None).cast("array<double>")))
