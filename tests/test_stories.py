import numpy as np
import pytest

from models import HOUR, check_best_earlier, cosine
from storystream.operators import stories as st
from storystream.operators.stories import assign_stories, best_partners, story_states, threshold_sweep, timed_units
from storystream.operators.tiles import TILE, bucket_width, tiled


def rows_of(seed, n, hours, centers=6, noise=0.6, dims=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, dims))
    return [
        (
            i,
            int(rng.integers(int(hours * HOUR))),
            [float(x) for x in (middle[rng.integers(centers)] + noise * rng.normal(size=dims)) * rng.uniform(0.5, 3)],
        )
        for i in range(1, n + 1)
    ]


def articles(spark, rows):
    df = spark.createDataFrame(rows, "id long, t long, embedding array<double>")
    return df.selectExpr(
        "id", "CASE WHEN id % 5 > 0 THEN timestamp_micros(t) END AS published_at",
        "timestamp_micros(t) AS created_at", "embedding",
    )


def partners(df, **options):
    units = timed_units(df)
    return {r.article_id: (r.partner_id, r.similarity) for r in best_partners(units, units, **options).collect()}


def check_stories(members, links):
    """An article is in its partner's story; one without a partner starts a story of its own name."""
    story = {r.article_id: r.story_id for r in members}
    for r in members:
        if r.article_id in links:
            assert story[r.article_id] == story[links[r.article_id][0]] and r.similarity == links[r.article_id][1]
        else:
            assert r.story_id == r.article_id and r.similarity is None


@pytest.mark.parametrize("seed,hours,chunk", [(1, 60, 2000), (2, 400, 5), (3, 20, 7)])
def test_best_partner_and_stories(spark, monkeypatch, seed, hours, chunk):
    monkeypatch.setattr(st, "CHUNK_ROWS", chunk)
    rows = rows_of(seed, 80, hours)
    df = articles(spark, rows)
    links = partners(df)
    check_best_earlier(links, rows, cosine, 0.6, 24)
    assert len(links) > 20
    members = assign_stories(df).members.collect()
    check_stories(members, links)
    assert len(members) == 80 and {r.status for r in members} == {"created", "joined"}
    vectors, times = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}, {i: t for i, t, _ in rows}
    for r in story_states(assign_stories(df).members, df).collect():
        mine = [m.article_id for m in members if m.story_id == r.id]
        assert r.article_count == len(mine)
        assert r.centroid == pytest.approx(list(np.mean([vectors[i] for i in mine], axis=0)))
        seconds = [round(x.timestamp() * 1e6) for x in (r.first_at, r.newest_at)]
        assert seconds == [min(times[i] for i in mine), max(times[i] for i in mine)]


def test_later_articles_find_the_stories_of_earlier_ones(spark):
    """All at once, or on top of stories there are: the same."""
    rows = rows_of(21, 90, 150)
    df = articles(spark, rows)
    whole = {r.article_id: r.story_id for r in assign_stories(df).members.collect()}
    first = assign_stories(df.filter("id <= 40")).members
    found = assign_stories(df, first.drop("status")).members.collect()
    assert {r.article_id: r.story_id for r in found} == whole and len(found) == len(rows)
    assert {r.article_id for r in found if r.status == "existing"} == set(range(1, 41))


def test_states_add_up(spark):
    rows = rows_of(5, 40, 30)
    df = articles(spark, rows)
    members = assign_stories(df).members
    whole = {r.id: r for r in story_states(members, df).collect()}
    old = story_states(members.filter("article_id <= 20"), df)
    later = story_states(members.filter("article_id > 20"), df, old).collect()
    assert later
    for r in later:
        assert (r.article_count, r.first_at, r.newest_at) == (
            whole[r.id].article_count, whole[r.id].first_at, whole[r.id].newest_at,
        )
        assert r.centroid == pytest.approx(whole[r.id].centroid)


def test_long_chain(spark):
    """Each is closest to the one before: one story, named after the first."""
    angle = np.linspace(0, 3, 70)
    rows = [(i + 1, i * HOUR // 8, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)]
    members = assign_stories(articles(spark, rows)).members.collect()
    assert {r.story_id for r in members} == {1} and len(members) == 70


def test_unusable_vectors_get_no_story(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.0, 0.0]), (3, 0, None), (4, HOUR, [1.0, 0.0])]
    result = assign_stories(articles(spark, rows))
    assert {(r.article_id, r.story_id) for r in result.members.collect()} == {(1, 1), (4, 1)}
    assert {(r.id, r.reason) for r in result.rejected.collect()} == {(2, "zero embedding"), (3, "no embedding")}


def test_window_edges_and_ties(spark):
    day = 24 * HOUR
    rows = [
        (1, 0, [1.0, 0.0]),
        (2, day, [1.0, 0.0]),  # exactly a day: linked
        (3, 2 * day + 1, [1.0, 0.0]),  # a moment more: not
        (4, 2 * day + 2, [0.0, 1.0]),
        (6, 2 * day + 4, [1.0, 1.0]),  # as close to both: the lower id
    ]
    assert partners(articles(spark, rows)) == {2: (1, 1.0), 6: (3, pytest.approx(0.5**0.5))}


@pytest.mark.parametrize("hours", [24, 0.25])
def test_sweep(spark, hours):
    rows = rows_of(31, 70, 60)
    df = articles(spark, rows)
    got = threshold_sweep(df, [0.5, 0.7], hours).collect()
    dated = df.filter("published_at IS NOT NULL")
    for threshold in (0.5, 0.7):
        members = [r for r in got if r.threshold == threshold]
        assert len(members) == dated.count()
        check_stories(members, partners(dated, threshold=threshold, hours=hours))


def test_thin_times_share_buckets_and_crowded_ones_do_not(spark):
    """Tiles have a fixed cost: their number follows the rows, not the hours that the rows are spread over."""
    thin = spark.range(3000).selectExpr("id", "id * 420000000L AS t")
    crowded = spark.range(3000).selectExpr("id", "id * 1000000L AS t")
    assert bucket_width(crowded, 1) == HOUR
    assert bucket_width(thin.limit(0), 1) == HOUR
    left, right = tiled(thin, thin, 1, [-1, 0, 1], 2000)
    assert left.select(*TILE).distinct().count() < 30
    near = left.alias("a").join(right.alias("b"), TILE).where("abs(a.t - b.t) <= 3600000000L")
    pairs = near.select("a.id", "b.id").collect()
    assert len(pairs) == len(set(pairs)) == sum(1 for i in range(3000) for j in range(max(0, i - 8), min(3000, i + 9)))
