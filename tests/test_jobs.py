import numpy as np
from pyspark.sql import functions as F

from storystream.operators import entities, ingest
from storystream.operators.enrich import embed_articles, mentions
from storystream.operators.nearest import nearest_stories
from storystream.operators.numbering import with_sequence
from storystream.operators.pairs import cosine_pair_count, cosine_partners
from storystream.plans import listings, maintenance
from storystream.sources import messages


def test_sequence_over_a_hot_key(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 > 0 THEN 7 ELSE id END AS k", "id")
    numbered = with_sequence(df, ["k", "id"], "n", start=10).collect()
    ordered = sorted(numbered, key=lambda r: (r.k, r.id))
    assert [r.n for r in ordered] == list(range(10, 5010))


def test_first_url_wins_with_a_third_of_one_url(spark):
    rows = spark.range(300).selectExpr("id AS arrival", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('u', id) END AS url")
    known = spark.createDataFrame([("u1",), ("other",)], "url string")
    got = {r.url: r.arrival for r in ingest.first_url_wins(rows, known).collect()}
    assert got["hot"] == 0 and "u1" not in got and len(got) == 200


def test_sources_by_name(spark):
    sources = spark.createDataFrame([(3, "a", "x"), (5, "a", "y"), (9, "b", "z")], "id long, name string, url string")
    incoming = spark.createDataFrame(
        [(1, "c", None), (2, "a", "q"), (3, "d", "https://d"), (4, "c", "late")], "arrival long, source string, source_url string"
    )
    got = {r.name: (r.id, r.url) for r in ingest.upsert_sources(sources, incoming).collect()}
    assert got == {"c": (10, "source://c"), "d": (11, "https://d")}
    assert {r.name: r.source_id for r in ingest.source_ids(sources).collect()} == {"a": 3, "b": 9}


def test_unreadable_messages(spark):
    values = ["{}", "nonsense", "[1]", '{"source": "s", "title": "t", "url": "u"}', '{"source": "s", "title": "", "url": "u"}']
    df = messages.decode_raw(spark.createDataFrame(list(enumerate(values)), "arrival long, value string"))
    valid, rejected = ingest.split_payloads(df)
    assert [r.title for r in valid.collect()] == ["t"]
    reasons = {r.arrival: r.reason for r in rejected.collect()}
    assert reasons == {0: "missing field", 1: "unreadable", 2: "unreadable", 4: "missing field"}


def test_a_filter_decodes_a_message_once(spark):
    sent = spark.range(3).selectExpr("id AS arrival", "concat('{', id) AS value")
    for side in ingest.split_payloads(messages.decode_raw(sent)):
        plan = side._jdf.queryExecution().optimizedPlan().toString().split("\n")
        filters = [line.count("from_json(") for line in plan if "Filter" in line]
        assert filters and max(filters) <= 1


def test_link_entities(spark):
    found = spark.createDataFrame(
        [(1, 0, "NASA", "ORG"), (1, 1, "nasa", "ORG"), (2, 0, "Nasa", "ORG"), (2, 1, "NASA", "GPE"), (3, 0, "Mars", "LOC")],
        entities.MENTIONS,
    )
    known = spark.createDataFrame([(4, "MARS", "LOC"), (6, "mars", "LOC")], "id long, name string, type string")
    links = spark.createDataFrame([(3, 4)], "article_id long, entity_id long")
    new, linked = entities.link_entities(found, known, links)
    assert sorted((r.id, r.name, r.type) for r in new.collect()) == [(7, "NASA", "ORG"), (8, "NASA", "GPE")]
    assert sorted(tuple(r) for r in linked.collect()) == [(1, 7), (2, 7), (2, 8)]


def test_models_are_pluggable(spark):
    articles = spark.createDataFrame([(1, "Title", None), (2, "T", "x" * 50)], "id long, title string, content string")

    def make_encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    got = {r.id: r.embedding for r in embed_articles(articles, make_encoder).collect()}
    assert got == {1: [5.0, 1.0], 2: [53.0, 1.0]}
    rows = mentions(articles, lambda: lambda text: [(text[:1], "FIRST")]).collect()
    assert sorted((r.article_id, r.name, r.type) for r in rows) == [(1, "T", "FIRST"), (2, "T", "FIRST")]


def test_cosine_partners_edges(spark):
    hour = 3_600_000_000
    rows = [(1, 0, [1.0, 0.0]), (2, 6 * hour, [1.0, 3**0.5 - 1e-9]), (3, 6 * hour + 1, [1.0, 0.0]), (4, 0, [0.0, 0.0]), (5, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, t long, embedding array<double>").selectExpr(
        "id", "timestamp_micros(t) AS published_at", "embedding"
    )
    assert sorted((r.id, r.partner_id, r.partners) for r in cosine_partners(df).collect()) == [(1, 2, 1), (2, 3, 1)]
    assert cosine_pair_count(df).first()[0] == 2


def test_nearest_story_tie_and_window(spark):
    day = 24 * 3_600_000_000
    articles = spark.createDataFrame([(1, day, [1.0, 1.0]), (2, 5 * day, [1.0, 0.0])], "id long, t long, embedding array<double>")
    articles = articles.selectExpr("id", "timestamp_micros(t) AS published_at", "timestamp_micros(t) AS created_at", "embedding")
    stories = spark.createDataFrame(
        [(8, [0.0, 2.0], 2 * day), (9, [3.0, 0.0], 0), (7, [1.0, 1.0], 2 * day + 1)], "id long, centroid array<double>, t long"
    ).selectExpr("id", "centroid", "timestamp_micros(t) AS newest_at")
    assert [(r.article_id, r.story_id) for r in nearest_stories(articles, stories).collect()] == [(1, 8)]


def test_summaries_of_a_story_with_most_rows(spark):
    joined = spark.range(900).selectExpr(
        "CASE WHEN id % 3 > 0 THEN 1 ELSE id END AS story_id", "'t' AS story_title", "id % 4 AS source_id",
        "concat('s', id % 4) AS source_name", "timestamp_seconds(id) AS article_time",
        "CASE id % 5 WHEN 0 THEN 'Space' WHEN 1 THEN 'Robotics' WHEN 2 THEN NULL ELSE 'Uncategorized' END AS topic",
    )
    one = listings.story_summaries(joined).filter("id = 1").first()
    assert (one.article_count, one.source_count, one.source_names) == (600, 4, ["s0", "s1", "s2", "s3"])
    assert one.topic == "Robotics"  # as frequent as Space; the smaller name
    page = listings.story_page(listings.story_summaries(joined), limit=500).first()
    assert page.total == 301 and page.limit == 100 and len(page["items"]) == 100 and page["items"][0].id == 1


def test_snapshot_is_written_apart(spark, tmp_path):
    articles = spark.createDataFrame([(1, "<b>x</b> &eacute;")], "id long, content string")
    cleaned = maintenance.clean_articles(articles)
    maintenance.apply({"articles": cleaned}, str(tmp_path / "v1"))
    assert spark.read.parquet(str(tmp_path / "v1" / "articles")).first().content == "x é"
    assert articles.first().content == "<b>x</b> &eacute;"


def test_feed_url_collision_with_seed(spark):
    sources = spark.createDataFrame([(1, "n", "u1"), (2, "n", "seed"), (3, "empty", "u3")], "id long, name string, url string")
    articles = spark.createDataFrame([(10, 2)], "id long, source_id long")
    seeds = spark.createDataFrame([("n", "seed")], "name string, url string")
    merged = maintenance.merge_sources(sources, articles, seeds)
    assert [tuple(r) for r in merged.sources.select("id", "name", "url").collect()] == [(1, "n", "seed")]
    assert merged.articles.first().source_id == 1
    assert {(r.id, r.reason) for r in merged.deleted.collect()} == {(2, "merged"), (3, "no articles")}
    assert merged.sources.filter(F.col("id") == 3).count() == 0
