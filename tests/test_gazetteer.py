"""Mentions by a table of names against a walk over the words."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from storystream.operators import gazetteer
from storystream.operators.gazetteer import gazetteer_mentions

WORD = re.compile(r"\w+")


def walk(text, names):
    """Leftmost, then longest; of equal words the lowest id."""
    table = {}
    for i, name, _ in sorted(names):
        table.setdefault(tuple(WORD.findall(name.lower())), i)
    words, at, found = WORD.findall((text or "").lower()), 0, []
    while at < len(words):
        fits = [n for n in range(1, 6) if tuple(words[at : at + n]) in table and at + n <= len(words)]
        if fits:
            found.append((at, table[tuple(words[at : at + max(fits)])]))
            at += max(fits)
        else:
            at += 1
    return found


def test_against_a_walk(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(60)))) for i in range(60)] + [(99, None), (98, "")]
    names = [(i, " ".join(rng.choice("ABcd") for _ in range(rng.choice([2, 2, 3, 4, 5]))), "ORG") for i in range(25)]
    names += [(50, "b", "PERSON"), (51, "--", "ORG")]
    docs = spark.createDataFrame(texts, "id long, text string")
    entities = spark.createDataFrame([*names, (None, "a a", "ORG"), (60, None, "ORG")], "id long, name string, type string")
    found = {}
    for r in gazetteer_mentions(docs, entities).orderBy("position").collect():
        found.setdefault(r.article_id, []).append((r.position, r.entity_id))
    expected = {i: walk(text, names) for i, text in texts}
    assert found == {i: rows for i, rows in expected.items() if rows}
    assert sum(map(len, found.values())) > 200


def test_overlaps_and_spelling(spark):
    docs = spark.createDataFrame([(1, "The New York Times of new-york; YORK times!")], "id long, text string")
    entities = spark.createDataFrame(
        [(1, "New York", "GPE"), (2, "new york times", "ORG"), (3, "Times of New", "ORG"), (4, "York Times", "ORG")],
        "id long, name string, type string",
    )
    found = [(r.position, r.name, r.type) for r in gazetteer_mentions(docs, entities).orderBy("position").collect()]
    assert found == [(1, "new york times", "ORG"), (5, "New York", "GPE"), (7, "York Times", "ORG")]
    assert gazetteer_mentions(docs, entities.limit(0)).collect() == []
    assert gazetteer_mentions(docs.limit(0), entities).collect() == []


def test_enrichment_uses_the_table(spark):
    from storystream.operators.enrich import mentions

    articles = spark.createDataFrame([(1, "On Acme Corp", "no more")], "id long, title string, content string")
    names = spark.createDataFrame([(5, "ACME corp", "ORG")], "id long, name string, type string")
    found = mentions(articles, gazetteer=names).select("article_id", "position", "name", "type")
    assert [tuple(r) for r in found.collect()] == [(1, 1, "ACME corp", "ORG")]
    assert found.where(F.col("name").isNull()).count() == 0


def test_a_word_is_shuffled_as_its_run_in_one_string(spark):
    texts = spark.createDataFrame([(1, "ada lovelace met ada")], "id long, text string")
    entities = spark.createDataFrame([(1, "Ada Lovelace", "NAME"), (2, "Ada", "NAME")], "id long, name string, type string")
    found = gazetteer.runs(texts, entities)
    assert sorted((r.start, r.n) for r in found.collect()) == [(0, 1), (0, 2), (3, 1)]
    todo, types = [found._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join" and node.joinType().toString() == "LeftSemi":
            rows = node.children().apply(0).output()
            types.append(sorted(rows.apply(i).dataType().simpleString() for i in range(rows.size())))
    assert types == [["bigint", "int", "string"]]


def shuffled_rows(df):
    """Rows that a result's exchanges wrote; of its plan as it was run."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif node.nodeName() == "Exchange":
            total += node.metrics().get("shuffleRecordsWritten").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_words_that_are_in_no_name_are_not_shuffled(spark):
    """Nor those that start a name and do not go on as one; an article's runs are one row."""
    docs = spark.createDataFrame([(i, "ada went to see ada lovelace " * 50) for i in range(20)], "id long, text string")
    entities = spark.createDataFrame([(1, "Ada Lovelace", "NAME"), (2, "went home", "NAME")], "id long, name string, type string")
    found = gazetteer_mentions(docs, entities)
    assert shuffled_rows(found) < 100
    assert found.count() == 20 * 50


def test_names_beyond_the_bound_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(gazetteer, "BROADCAST_CHARACTERS", 0)
    test_against_a_walk(spark)
    test_overlaps_and_spelling(spark)


def test_rows_of_one_id_count_together(spark):
    """Also rows of the null id; of two texts the union of their runs is walked."""
    docs = spark.createDataFrame(
        [(1, "a b c"), (1, "a b c"), (2, "x a b"), (2, "c x x"), (None, "b c"), (None, "b c a")], "id long, text string"
    )
    entities = spark.createDataFrame([(1, "a b", "N"), (2, "c", "N"), (3, "b c", "N")], "id long, name string, type string")
    found = gazetteer_mentions(docs, entities).select("article_id", "position", "entity_id").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, 0, 1), (1, 2, 2), (2, 0, 2), (2, 1, 1), (None, 0, 3)], key=str)


def test_an_entity_with_several_names(spark):
    docs = spark.createDataFrame([(1, "ada lovelace, ada king")], "id long, text string")
    entities = spark.createDataFrame(
        [(1, "Ada Lovelace", "NAME"), (1, "Ada King", "ALIAS"), (2, "Ada King", "NAME")], "id long, name string, type string"
    )
    found = [tuple(r) for r in gazetteer_mentions(docs, entities).orderBy("position").collect()]
    assert found == [(1, 0, "Ada Lovelace", "NAME", 1), (1, 2, "Ada King", "ALIAS", 1)]


def test_slices_give_the_same_rows(monkeypatch):
    """However few words or runs are taken at once; with all bits set every run goes on."""
    rng = random.Random(8)
    lists = [[rng.choice("abcdefg") for _ in range(rng.randrange(30))] for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(lists)], names=["article_id", "words"])
    runs = pa.schema([("article_id", pa.int64()), ("start", pa.int32()), ("run", pa.string())])
    expected = [
        (i, at, " ".join(words[at : at + n])) for i, words in enumerate(lists) for at in range(len(words)) for n in (1, 3) if at + n <= len(words)
    ]
    for size in (1 << 18, 7, 1):
        monkeypatch.setattr(gazetteer, "SLICE", size)
        table = np.full(gazetteer.BITS // 8, 255, np.uint8)
        rows = [tuple(r.values()) for part in gazetteer._sift([1, 3], table, runs)(iter([batch.slice(1)])) for r in part.to_pylist()]
        assert rows == [r for r in expected if r[0] > 0]


def test_only_runs_that_may_be_names_pass(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    grams = [" ".join(word() for _ in range(rng.choice([1, 2, 5, 40]))) for _ in range(200)]
    table = gazetteer._table(spark.createDataFrame([(g,) for g in grams], "gram string"))
    assert 390 <= np.unpackbits(table).sum() <= 400
    words = " ".join(f"{word()} {g}" for g in grams).split()
    batch = pa.RecordBatch.from_arrays([pa.array([5], pa.int64()), pa.array([words])], names=["article_id", "words"])
    runs = pa.schema([("article_id", pa.int64()), ("start", pa.int32()), ("run", pa.string())])
    passed = [r for part in gazetteer._sift([1, 2, 5, 40], table, runs)(iter([batch])) for r in part.to_pylist()]
    assert sorted(r["run"] for r in passed) == sorted(grams)
    assert all(" ".join(words[r["start"] :]).startswith(r["run"]) for r in passed)
