"""Quality statistics, verdicts and the order of the cascade."""

import random
import re

import pytest

from storystream.llm import quality
from storystream.llm.quality import RULES, Rule, Text


def brute_repeated(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)})


def test_repeated_words_against_counting():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh").encode() for _ in range(rng.randrange(0, 30))]
        assert quality.repeated_words(words) == brute_repeated(words)


def test_statistics():
    text = "A b\tc|é\n\n x y \n x y \n\x0b\n x y\nA b \U0001f600 #12 3"
    one = Text(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert one["n_words"] == len(words) == 13
    assert one["word_chars"] == sum(map(len, words))
    assert one["n_symbols"] == 2 and one["n_lines"] == 5 and one["n_dup_lines"] == 1
    assert one["n_letter_words"] == 10
    empty = Text(None)
    assert [empty[n] for n in Text.TAKEN] == [0] * len(Text.TAKEN)


def test_order_is_rejection_per_cost(spark):
    """A dear rule that rejects all comes after a cheap one that rejects nearly all."""
    import time

    def slow(n):
        time.sleep(0.01)
        return n

    taken = dict(Text.TAKEN)
    Text.TAKEN["dear"] = lambda t: slow(t["n_words"])
    try:
        rules = (
            Rule("idle", ("n_marks",), lambda n: False),
            Rule("dear", ("dear",), lambda n: True),
            Rule("cheap", ("n_upper",), lambda n: n > 0),
            Rule("same", ("n_upper", "n_lower"), lambda n, m: n > 0),
        )
        docs = spark.createDataFrame([(i, "A" if i % 10 else "a") for i in range(40)], "doc_id long, text string").coalesce(1)
        # The statistic is known to the workers by name only
        order = _estimated_here(docs, rules)
    finally:
        Text.TAKEN.clear()
        Text.TAKEN.update(taken)
    assert [e.rule.name for e in order][:2] == ["cheap", "dear"]
    assert [e.rejected for e in order] == [36, 4, 0, 0]


def _estimated_here(docs, rules):
    """`estimated` with its sample observed in this process."""
    from unittest import mock

    texts = [r.text for r in docs.collect()]

    class Seen:
        def collect(self):
            from types import SimpleNamespace

            seconds, verdicts = quality._observed(rules)()(texts)
            return [SimpleNamespace(seconds=s, verdicts=v) for s, v in zip(seconds, verdicts)]

    with mock.patch.object(quality, "map_slices", lambda *a: Seen()):
        return quality.estimated(docs, rules)


def test_verdict_is_that_of_all_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = quality.judge(docs, sample_rows=50).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(found) == docs.count()
    for row in found:
        failed = {rule.name for rule in RULES if rule(Text(texts[row.doc_id]))}
        assert row.kept == (not failed) and (row.rejected_by in failed or row.kept)
        assert row.base_failed == bool(failed & {"few_words", "repeated_words"})
    kept = quality.drop_low_quality(docs, sample_rows=50)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.kept}


def test_junk_goes_and_labelled_good_texts_stay(spark):
    path = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    found = quality.judge(docs).join(labels, "doc_id").collect()
    good = [r for r in found if r.quality == 1 and not r.base_failed]
    junk = [r for r in found if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.998 * len(good)
    assert sum(not r.kept for r in junk) >= 0.98 * len(junk)


def test_edges(spark):
    schema = "doc_id bigint, text string, kept int, n_words string"
    assert quality.judge(spark.createDataFrame([], schema)).collect() == []
    assert quality.drop_low_quality(spark.createDataFrame([], schema)).collect() == []
    clean = "The quick brown fox jumps over the lazy dog near a river."
    rows = [(None, clean, 1, "x"), (1, None, 1, "x"), (1, "", 1, "x"), (2, clean, 1, "x"), (2, clean, 1, "x"), (3, "word " * 300000, 1, "x")]
    found = quality.judge(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in found) == [
        (0, 12, True), (1, 0, False), (1, 0, False), (2, 12, True), (2, 12, True), (3, 300000, False),
    ]
    assert quality.drop_low_quality(spark.createDataFrame(rows, schema)).count() == 3


@pytest.mark.parametrize("percent", [19, 21])
def test_base_is_the_contract(percent):
    words = [f"w{i}" for i in range(95 - percent)] + ["r1", "r2", "r3", "r4", "r5"] * 1
    assert not any(r(Text(" ".join(words))) for r in quality.BASE)
