"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing columns."""

import os

import pytest

import corpus_pipeline
from storystream.llm import decontam, minhash, mixing, pii, secrets, sharding, tokens, toxicity, urls, vectors
from storystream.llm.queries import QUERIES

CLASH = "key string, score double, shard int, slot int, tokens bigint, _doc string, _row int, spans string, epoch int, doc string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}"
LONG = "lorem ipsum dolor sit amet consectetur " * 8000


@pytest.fixture(scope="module")
def odd(spark):
    extra = ("k", 0.5, 99, 98, 97, "d", 96, "s", 95, "e")
    texts = [None, "", "   \n", "one", LONG, LONG, "w" * 100_000, "plain words here\nand there", "plain words here\nand there"]
    rows = [(i, t, "en" if i % 2 else None, f"src{i}" if i % 3 else None, None, *extra) for i, t in enumerate(texts)]
    rows += [rows[-1], rows[-1], (None, "no id", None, None, None, *extra), (None, None, None, None, None, *extra)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, None, 1), (None, 1, 0), (3, 1, None), (4, 0, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, None), (2, ""), (None, LONG[:300]), (3, LONG[:300]), (3, LONG[:300]), (4, "short")], "item_id bigint, text string"
    )


PER_ROW = {
    "toxicity": lambda d, lab, _: toxicity.score_documents(d, lab),
    "secrets": lambda d, *_: secrets.find_secrets(d),
    "sharding": lambda d, *_: sharding.shard(d),
    "near_duplicates": lambda d, *_: minhash.near_duplicates(d),
    "personal_data": lambda d, *_: pii.find_personal_data(d),
    "sanitise": lambda d, *_: pii.sanitise(d),
}
OTHER = {
    "token_counts": lambda d, *_: tokens.token_counts(d),
    "leaks": lambda d, _, b: decontam.find_leaks(d, b),
    "mix": lambda d, *_: mixing.mix(d),
}
STAGES = {
    "drop_toxic": lambda d, lab, _: toxicity.drop_toxic(d, lab),
    "deduplicate": lambda d, *_: minhash.deduplicate(d),
    "drop_leaks": lambda d, _, b: decontam.drop_leaks(d, b),
    "mix_documents": lambda d, *_: mixing.mix_documents(d, budget=1.0),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_each(name, odd, empty, labels, benchmark):
    assert len(PER_ROW[name](odd, labels, benchmark).collect()) == odd.count()
    assert PER_ROW[name](empty, labels, benchmark).collect() == []
    assert PER_ROW[name](empty, labels.limit(0), benchmark.limit(0)).collect() == []


@pytest.mark.parametrize("name", OTHER)
def test_rows_and_empty_tables(name, odd, empty, labels, benchmark):
    assert OTHER[name](odd, labels, benchmark).collect()
    assert OTHER[name](empty, labels, benchmark).collect() == []
    assert OTHER[name](odd, labels, benchmark.limit(0)).count() >= 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_all_columns(name, odd, empty, labels, benchmark):
    left = STAGES[name](odd, labels, benchmark)
    assert left.columns == odd.columns and left.dtypes == odd.dtypes
    assert 0 < len(left.collect()) <= odd.count()
    assert STAGES[name](empty, labels, benchmark).collect() == []


def test_defined_results(odd, labels, benchmark):
    near = minhash.near_duplicates(odd).collect()
    by = {}
    for r in near:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[0] == [(0, 0, True)] and by[2] == [(0, 2, True)] and by[3] == [(1, 3, True)]
    assert by[5][0][1:] == (4, False) and by[8] == [(1, 7, False)] * 3
    assert sorted(by[None]) == [(0, None, False), (1, None, False)]
    stays = sorted(r.doc_id for r in minhash.deduplicate(odd).collect() if r.doc_id is not None)
    assert stays == [0, 1, 2, 3, 4, 6, 7]
    leaks = {(r.doc_id, r.item_id, r.distance) for r in decontam.find_leaks(odd, benchmark).collect()}
    assert leaks == {(4, 3, 0), (5, 3, 0)}
    sections = {r.doc_id: r.n_tokens for r in tokens.token_counts(odd).collect() if r.section == 0}
    assert sections[0] == sections[1] == 0 < sections[3]


def test_deduplicate_keeps_one_of_rows_equal_in_id_and_text(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z"), (2, "other words here"), (2, "x y z"), (3, "A B C D E F"), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = sorted((str(r.doc_id), r.text) for r in minhash.deduplicate(docs).collect())
    assert left == [("1", "a b c d e f"), ("2", "other words here"), ("2", "x y z"), ("None", "a b c d e f")]


def test_deduplicate_keeps_one_of_near_texts_of_an_id(spark):
    near = " ".join(f"w{i}" for i in range(200))
    rows = [(4, near), (4, near + " more"), (4, ""), (4, None), (4, "and now something else"), (7, near + " else")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = [(r.doc_id, r.text) for r in minhash.deduplicate(docs).collect()]
    assert {d for d, _ in left} == {4} and len(left) == 4
    assert {(4, ""), (4, None), (4, "and now something else")} < set(left)


def test_deduplicate_keeps_the_other_text_of_an_id(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "x y z"), (6, "A b c d e f"), (6, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, minhash.deduplicate(docs).collect())) == [(1, "a b c d e f"), (5, "x y z")]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [nan, 1.0], 1),
        (7, [1.0, None], 1), (8, [inf, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (11, [], 1),
        (12, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0], 1), (13, [3e-30, 0.0], 1),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(table).collect()]
    assert len(found) == len(rows)
    linked = {(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (13, 4, 1, False)}
    alone = {(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)} | {(None, 0, None, False)}
    assert set(found) == linked | alone
    assert vectors.near_vectors(table.limit(0)).collect() == []


def test_odd_urls(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "://"), (3, "x://" + "a" * 100_000)]
    table = spark.createDataFrame(rows, "page_id bigint, url string")
    found = urls.judge(table).collect()
    assert len(found) == 5 and {r.verdict for r in found} <= {"allow", "block"}
    assert urls.judge(table.limit(0)).collect() == []


def test_pipeline_over_odd_tables(spark, tmp_path, odd, empty, labels, benchmark):
    for name, docs in (("odd", odd), ("none", empty)):
        folder = tmp_path / name
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert (len(out) > 0) == (name == "odd")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not found")
def test_pipeline_stages_on_the_test_tables(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < docs.count() <= seen
        seen = docs.count()
    assert sorted(r.slot for r in docs.where("shard = 3").collect()) == list(range(docs.where("shard = 3").count()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not found")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_the_test_tables(spark, name):
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_short_items_are_found_between_word_ends(spark):
    docs = spark.createDataFrame(
        [(1, "He asked: What is 2+2? Nobody knew."), (2, "somewhat is 2 2x"), (3, "what is 2 2"), (4, None), (None, "What is 2 + 2"), (5, "!?")],
        "doc_id bigint, text string",
    )
    items = spark.createDataFrame([(1, "What is 2+2?"), (2, "!!"), (3, ""), (4, None)], "item_id bigint, text string")
    found = sorted(((r.doc_id or 0), r.item_id, r.distance, r.budget) for r in decontam.find_leaks(docs, items).collect())
    assert found == [(0, 1, 0, 0), (1, 1, 0, 0), (3, 1, 0, 0)]
    assert {r.doc_id for r in decontam.drop_leaks(docs, items).collect()} == {2, 4, 5}


def test_items_in_several_blocks(spark):
    texts = [f"item number {i} asks for the {i * 37 % 101}th letter of a long word" for i in range(30)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts[:20])] + [(99, "clean text")], "doc_id bigint, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    one = {tuple(r) for r in decontam.find_leaks(docs, items).collect()}
    many = {tuple(r) for r in decontam.find_leaks(docs, items, limit=300).collect()}
    assert one == many and {(i, i) for i in range(20)} <= {r[:2] for r in many}
    assert [r.doc_id for r in decontam.drop_leaks(docs, items, limit=300).collect()] == [99]


def test_weights_of_zero(spark):
    rows = [(i, "word " * 10, lang, source) for i, (lang, source) in enumerate([("en", "src0"), ("en", "src1"), ("de", "src1"), ("de", "x")] * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    weights = {"domain": {"crawl": 0.0, "curated": 1.0}, "lang": {"de": 0.0}, "source": {}}
    found = mixing.mix(docs, weights, budget=0.25, epochs=1).collect()
    assert {(r.domain, r.lang) for r in found} == {("curated", "en")}
    # The shares of what is left out go to the others: a quarter of 200 tokens is all that is left
    assert sum(r.tokens for r in found) == 50
    nothing = {"domain": {"crawl": 0.0, "curated": 0.0, "other": 0.0}}
    assert mixing.mix(docs, nothing).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, {"lang": {"en": -1.0}})
