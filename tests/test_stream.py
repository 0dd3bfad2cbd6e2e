"""Streams: the cut into batches and a repeated batch make no difference."""

import json

import pytest
from pyspark.sql import functions as F

from models import HOUR, check_duplicates, cosine, ratio
from storystream.plans.catalog import jobs
from storystream.plans.listings import list_stories, story_members, story_summaries
from storystream.session import materialize
from storystream.sources import feeds, messages
from storystream.streaming import pipeline
from storystream.streaming.pipeline import (
    Models,
    Store,
    clean_and_republish,
    enrich_batch,
    ingest_batch,
    start_enrich,
    start_feeds,
    start_ingest,
)

START = 1_704_067_200  # 2024-01-01T00:00:00Z


def payloads(n=40):
    rows = []
    for i in range(n):
        rows.append(
            {
                "source": f"s{i % 3}",
                "title": ["Rocket lands on Mars", "Markets fall", "Rockets land on Mars", f"Item {i * i}"][i % 4],
                "url": f" https://x.test/{i % 33} ",
                "published_at": None if i % 9 == 4 else f"2024-01-{1 + i // 12:02d}T{(i * 5) % 24:02d}:00:00Z",
                "content": f"AI text {i}",
            }
        )
    rows.insert(5, {"source": "s1", "title": "", "url": "https://x.test/none"})
    lines = [json.dumps(r) for r in rows]
    lines.insert(9, "not json")
    return lines


def embeddings(spark):
    rows = [(f"https://x.test/{i}", [1.0 + i % 5, 2.0 * (i % 3), 0.5 * i % 4]) for i in range(33)]
    return spark.createDataFrame(rows, "url string, embedding array<double>")


def run(spark, tmp_path, name, cuts, repeat=None):
    """Stream the lines in as many batches as there are cuts; optionally run one of them twice."""
    lines, store = payloads(), Store(spark, str(tmp_path / name))
    models = Models(embeddings=embeddings(spark))
    edges = [0, *cuts, len(lines)]
    for number, (lo, hi) in enumerate(zip(edges, edges[1:])):
        folder = tmp_path / name / "in" / str(number)
        folder.mkdir(parents=True)
        (folder / "part.txt").write_text("\n".join(lines[lo:hi]))
        batch = messages.read_topic(spark, "text", stream=False, path=str(folder))
        for _ in range(2 if number == repeat else 1):
            sent = ingest_batch(store, batch, number)
            enrich_batch(store, sent, number, models)
    return store


def contents(store):
    """All tables but for the times of the run itself."""
    names = ["articles", "sources", "enrichments", "entities", "article_entities"]
    tables = {n: sorted(map(str, store.read(n).drop("created_at").collect())) for n in names}
    members = store.read("story_articles").withColumn("similarity", F.round("similarity", 9))
    tables["members"] = sorted(map(str, members.collect()))
    tables["stories"] = sorted(
        (r.id, r.title, r.article_count, [round(x, 9) for x in r.centroid]) for r in store.stories().collect()
    )
    return tables


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """The store after all messages came in one batch."""
    return run(spark, tmp_path_factory.mktemp("one"), "store", [])


def test_batches_do_not_matter(spark, tmp_path, whole):
    assert contents(run(spark, tmp_path, "store", [13, 27])) == contents(whole)


def test_repeated_batch(spark, tmp_path, whole):
    assert contents(run(spark, tmp_path, "store", [20], repeat=1)) == contents(whole)


def test_content_of_tables(spark, whole):
    store = whole
    good = [json.loads(x) for x in payloads() if x.startswith("{")]
    good = [r for r in good if r["title"]]
    seen, rows = set(), []
    for r in good:
        if r["url"].strip() not in seen:
            seen.add(r["url"].strip())
            stamp = r["published_at"]
            t = None if stamp is None else (int(stamp[8:10]) * 24 + int(stamp[11:13])) * HOUR
            rows.append((len(rows) + 1, t, r["title"]))
    articles = {r.id: r for r in store.read("articles").collect()}
    assert {i: a.title for i, a in articles.items()} == {i: title for i, _, title in rows}
    copies = {i: a.duplicate_of_id for i, a in articles.items() if a.duplicate_of_id}
    scored = {i: (d, ratio(articles[i].title, articles[d].title)) for i, d in copies.items()}
    check_duplicates(scored, rows)
    assert copies
    fresh = sorted(set(articles) - set(copies))
    assert sorted(r.article_id for r in store.read("enrichments").collect()) == fresh
    assert {r.topic for r in store.read("enrichments").collect()} >= {"Artificial Intelligence"}
    vectors = {r.url: r.embedding for r in embeddings(spark).collect()}
    micros = lambda a: round((a.published_at or a.created_at).timestamp() * 1e6)
    members = {r.article_id: r for r in store.read("story_articles").collect()}
    assert sorted(members) == fresh
    # A story is named after the first of its articles, and each later one is close to an earlier one
    for i in fresh:
        able = [
            j for j in fresh
            if j < i and abs(micros(articles[i]) - micros(articles[j])) <= 24 * HOUR
            and cosine(vectors[articles[i].url], vectors[articles[j].url]) >= 0.6
        ]
        assert (members[i].similarity is None) == (not able) == (members[i].story_id == i)
        assert not able or members[i].story_id in {members[j].story_id for j in able}
    reasons = spark.read.parquet(f"{store.root}/quarantine").collect()
    assert sorted(r.reason for r in reasons) == ["missing field", "unreadable"]


def test_streams_end_to_end(spark, tmp_path):
    landing = tmp_path / "landing" / "source=The Verge"
    landing.mkdir(parents=True)
    (landing / "a.xml").write_text(
        "<rss><channel><item><title> AI rockets </title><link>https://v.test/1</link>"
        "<description>&lt;b&gt;Bold&lt;/b&gt; &amp;eacute;</description>"
        "<pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>"
        "<item><title>No link</title></item></channel></rss>"
    )
    (landing / "b.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Rockets of AI</title>'
        '<link rel="self" href="https://v.test/self"/><link href="https://v.test/2"/>'
        '<summary type="html">Plain</summary><updated>2024-01-02T11:00:00+01:00</updated></entry></feed>'
    )
    once = {"availableNow": True}
    path = lambda name: str(tmp_path / name)
    start_feeds(spark, path("landing"), path("c1"), "text", path("raw"), once).awaitTermination()
    raw = sorted(json.loads(r.value)["url"] for r in spark.read.text(path("raw")).collect())
    assert raw == ["https://v.test/1", "https://v.test/2"]
    sent = {json.loads(r.value)["url"]: json.loads(r.value) for r in spark.read.text(path("raw")).collect()}
    assert sent["https://v.test/1"] == {
        "source": "The Verge",
        "source_url": dict(feeds.SEED_SOURCES)["The Verge"],
        "title": "AI rockets",
        "url": "https://v.test/1",
        "published_at": "2024-01-02T10:00:00+00:00",
        "content": "Bold é",
    }
    topic = messages.read_topic(spark, "text", path=path("raw"))
    start_ingest(topic, path("store"), path("c2"), "text", path("processed"), once).awaitTermination()
    processed = messages.read_topic(spark, "text", path=path("processed"))
    start_enrich(processed, path("store"), path("c3"), trigger=once).awaitTermination()
    store = Store(spark, path("store"))
    assert store.read("articles").count() == 2
    # "AI rockets" and "Rockets of AI" have 8 characters in a row in common: 200 * 8 / 23 is over 65
    assert store.read("articles").filter("duplicate_of_id IS NOT NULL").count() == int(ratio("AI rockets", "Rockets of AI") >= 65)
    topics = {r.topic for r in store.read("enrichments").collect()}
    assert topics == {"Uncategorized"}  # one hit each for two topics is a tie
    assert spark.read.parquet(path("store") + "/rejected").count() == store.read("enrichments").count()


def test_replay_refreshes_topics(spark, tmp_path):
    """An article whose content was cleaned meanwhile gets its new topic, and keeps its story."""
    store = run(spark, tmp_path, "store", [])
    before = {r.article_id: r.topic for r in store.enrichments().collect()}
    stories = sorted(map(str, store.read("story_articles").collect()))
    cleaned = store.read("articles").withColumn("content", F.lit("nothing of note"))
    store.write("articles", materialize(cleaned, "cleaned"), 0)
    enrich_batch(store, messages.republished(store.read("articles")), 1, Models(embeddings=embeddings(spark)))
    after = {r.article_id: r.topic for r in store.enrichments().collect()}
    assert set(after) > set(before) and "Artificial Intelligence" in before.values()
    assert "Artificial Intelligence" not in after.values()
    kept = store.read("story_articles").filter(F.col("article_id").isin(list(before)))
    assert sorted(map(str, kept.collect())) == stories


def test_messages_in_many_files_are_one_batch(spark):
    """A batch has a fixed cost of many small jobs, so batches must not grow with the files that messages come in."""
    rows = spark.range(12).selectExpr("id", "'t' AS title", "'https://x/' || id AS url", "'NASA rocket' AS content")
    store, topic = jobs._stored(spark, rows.repartition(6))
    pipeline.republish(store, "text", topic)
    jobs._enrich(spark, store, topic, f"{topic}-checkpoint")
    pipeline.republish(store, "text", topic)
    jobs._enrich(spark, store, topic, f"{topic}-checkpoint")
    times = store.read("enrichments").groupBy("article_id").count().collect()
    assert len(times) == 12 and all(r["count"] == 2 for r in times)
    assert store._batches("enrichments", None).select("batch").distinct().count() == 2


def test_articles_are_cleaned_before_they_are_sent_again(spark, tmp_path):
    store = run(spark, tmp_path, "store", [])
    marked = store.articles_by_batch().withColumn("content", F.concat(F.lit("<p>a &amp; b</p>"), "content"))
    store.replace_articles(materialize(marked, "marked"))
    clean_and_republish(store, "text", str(tmp_path / "again"))
    articles = store.read("articles").collect()
    assert articles and all(a.content.startswith("a & b") for a in articles)
    sent = [json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "again")).collect()]
    assert sorted(sent) == sorted(a.id for a in articles)


def test_a_repeated_batch_sends_its_messages_once(spark, tmp_path):
    batch = spark.createDataFrame([("k", "one"), ("k", "two")], "key string, value string")
    for number in (0, 1, 1):
        messages.write_topic(batch, "text", str(tmp_path / "topic"), number)
    assert spark.read.text(str(tmp_path / "topic")).count() == 4


def _page(df):
    return [(r.id, r.title, r.article_count, r.source_names, r.first_article_at, r.latest_article_at, r.topic) for r in df.collect()]


def test_kept_summaries_equal_those_of_all_members(spark, tmp_path):
    """After batches, a repeated one, and a replay that changes topics."""
    store = run(spark, tmp_path, "store", [13, 27], repeat=1)

    def summaries():
        articles = store.read("articles")
        topics = store.enrichments().select(F.col("article_id").alias("id"), "topic")
        members = story_members(store.stories(), store.read("story_articles"), articles.join(topics, "id"), store.read("sources"))
        return materialize(story_summaries(members), "summaries")

    expected = summaries()
    assert expected.filter("article_count > 1").count() > 1
    assert _page(store.list_stories(limit=100)) == _page(list_stories(expected, 100))
    cleaned = store.read("articles").withColumn("content", F.when(F.col("id") % 2 == 0, "nothing").otherwise(F.col("content")))
    store.replace_articles(materialize(cleaned.withColumn("batch", F.lit(0)), "cleaned"))
    for number in (3, 3, 4):
        enrich_batch(store, messages.republished(store.read("articles")), number, Models(embeddings=embeddings(spark)))
    changed = summaries()
    assert {r.topic for r in changed.collect()} != {r.topic for r in expected.collect()}
    for at_least in (1, 2):
        assert _page(store.list_stories(5, 2, at_least)) == _page(list_stories(changed, 5, 2, at_least))
    total = {r.total for r in store.list_stories(5, 0, 2).collect()}
    assert total == {changed.filter("article_count >= 2").count()}
    assert store.list_stories(offset=1000).count() == 0


def _ingest(spark, folder, store, number, rows, retention):
    """One batch of (url, date); gives the urls that became articles, and what went into quarantine."""
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"source": "s", "title": f"Title {u} {d}", "url": u, "published_at": d and f"2024-01-{d}T00:00:00Z"})
             for u, d in rows]
    (folder / "part.txt").write_text("\n".join(lines))
    batch = messages.read_topic(spark, "text", stream=False, path=str(folder))
    ingest_batch(store, batch, number, retention)
    added = [r.url for r in store.articles_by_batch().filter(F.col("batch") == number).collect()]
    rejects = spark.read.parquet(f"{store.root}/quarantine").filter(F.col("batch") == number).collect()
    return sorted(added), sorted((json.loads(r.value)["url"], r.reason) for r in rejects)


def test_retention_bounds_the_urls_looked_up(spark, tmp_path):
    first = [("a", "10"), ("b", "01"), ("u", None)]
    # In time: a copy, the edge itself, a new url, one without date, and b under a new date; from before: d and b
    second = [("a", "10"), ("e", "08"), ("c", "09"), ("n", None), ("u", None), ("b", "10"), ("d", "02"), ("b", "01")]
    bounded, whole = Store(spark, str(tmp_path / "bounded")), Store(spark, str(tmp_path / "whole"))
    for store, retention in ((bounded, 48), (whole, None)):
        added, rejects = _ingest(spark, tmp_path / "first", store, 0, first, retention)
        assert (added, rejects) == (["a", "b", "u"], [])
    for _ in range(2):
        added, rejects = _ingest(spark, tmp_path / "second", bounded, 1, second, 48)
        assert (added, rejects) == (["b", "c", "e", "n"], [("b", "late"), ("d", "late")])
    assert _ingest(spark, tmp_path / "second", whole, 1, second, None) == (["c", "d", "e", "n"], [])
    ids = sorted(r.id for r in bounded.read("articles").collect())
    assert ids == list(range(1, 8))
    # A batch without dates leaves the newest date as it is
    assert _ingest(spark, tmp_path / "third", bounded, 2, [("m", None)], 48) == (["m"], [])
    assert _ingest(spark, tmp_path / "fourth", bounded, 3, [("f", "07"), ("c", "09")], 48) == ([], [("f", "late")])


def test_missing_article_is_reported(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    sent = spark.createDataFrame([("k", '{"id": 99, "url": "u"}')], "key string, value string")
    enrich_batch(store, sent, 0)
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/missing").collect()] == [99]


def test_batch_without_articles(spark, tmp_path):
    """Only rejects, then nothing to enrich."""
    store = Store(spark, str(tmp_path / "store"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('nonsense\n{"source": "s"}')
    sent = ingest_batch(store, messages.read_topic(spark, "text", stream=False, path=str(tmp_path / "in")), 0)
    enrich_batch(store, sent, 0)
    assert store.read("articles").count() == store.stories().count() == 0
    assert spark.read.parquet(f"{store.root}/quarantine").count() == 2
