import random

import pytest

from models import HOUR, check_duplicates, title_pairs as plain_pairs
from storystream.operators import titles
from storystream.operators.titles import title_duplicates, title_partners


def articles(spark, rows):
    df = spark.createDataFrame(rows, "id long, t long, title string")
    return df.selectExpr("id", "timestamp_micros(t) AS published_at", "title")


def found(df):
    return {r.id: (r.duplicate_of_id, r.score) for r in df.collect()}


def random_rows(seed, n, spread_hours, words=("rocket", "lands", "on", "mars", "again", "x")):
    rng = random.Random(seed)
    return [
        (
            i,
            None if rng.random() < 0.05 else rng.randrange(int(spread_hours * HOUR)) // rng.choice([1, 10**6]) * 1,
            " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))),
        )
        for i in range(1, n + 1)
    ]


@pytest.mark.parametrize("seed,spread,chunk", [(1, 40, 2000), (2, 10, 7), (3, 100, 2000), (4, 1, 16)])
def test_duplicates_like_one_by_one(spark, monkeypatch, seed, spread, chunk):
    monkeypatch.setattr(titles, "CHUNK_ROWS", chunk)
    rows = random_rows(seed, 90, spread)
    check_duplicates(found(title_duplicates(articles(spark, rows))), rows)


def test_copies_of_one_title(spark):
    """A title that most articles carry, at close and equal times, in any order of arrival."""
    rng = random.Random(5)
    rows = [(i, rng.randrange(30) * HOUR // 2 + rng.randrange(3), "one and the same title") for i in range(1, 120)]
    check_duplicates(found(title_duplicates(articles(spark, rows))), rows)


def test_crowded_buckets_are_cut_by_length(spark, monkeypatch):
    """Titles of very different lengths in one bucket: fewer rows of tiles, the same duplicates."""
    monkeypatch.setattr(titles, "CHUNK_ROWS", 8)
    rng = random.Random(21)
    rows = [
        (i, rng.randrange(5 * HOUR), " ".join(rng.choice(("ab", "cd", "e")) for _ in range(rng.choice([0, 1, 2, 6, 20, 60]))))
        for i in range(1, 97)
    ]
    check_duplicates(found(title_duplicates(articles(spark, rows))), rows)
    keyed = titles._keyed(articles(spark, rows))
    whole, _ = titles.tiled(keyed, keyed, 6, [0], titles.CHUNK_ROWS)
    cut, _ = titles.tiled(keyed, keyed, 6, [0], titles.CHUNK_ROWS, *titles._length_band(65))
    assert cut.select("id").distinct().count() == len(rows)
    assert cut.count() < 0.7 * whole.count()


@pytest.mark.parametrize("threshold", [1, 40, 65, 99, 100])
def test_titles_that_can_reach_the_threshold_have_close_bands(spark, threshold):
    """Every shorter title that can still reach the threshold lies within the bands that meet."""
    band, meets = titles._length_band(threshold)
    rows = [(n, "x" * n) for n in range(0, 400)]
    bands = {r.n: r.band for r in spark.createDataFrame(rows, "n int, key string").select("n", band.alias("band")).collect()}
    for longer in range(1, 400):
        for shorter in range(1, longer + 1):
            if 200 * shorter / (shorter + longer) >= threshold:
                assert bands[longer] - bands[shorter] <= meets


def test_edges(spark):
    # 13 of 20 characters in common on both sides: 200 * 13 / 40 = 65
    a, b, short = "a" * 13 + "b" * 7, "a" * 13 + "c" * 7, "a" * 12 + "c" * 8
    rows = [
        (1, 100 * HOUR, a),
        (2, 106 * HOUR, b),
        (3, 112 * HOUR + 1, b),
        (4, 100 * HOUR, short),
        (5, 300 * HOUR, a),
        (6, 300 * HOUR, a),
        (7, 300 * HOUR, b),
        (8, 301 * HOUR, ""),
        (9, 302 * HOUR, "  "),
        (10, None, a),
    ]
    got = found(title_duplicates(articles(spark, rows)))
    check_duplicates(got, rows)
    assert got[2] == (1, 65.0) and 3 not in got and got[7][0] == 5 and got[9] == (8, 100.0)


def test_only_new_rows_are_checked(spark):
    rows = random_rows(7, 60, 12)
    df = articles(spark, rows)
    got = found(title_duplicates(df, new=df["id"] >= 40))
    check_duplicates(got, rows, only=lambda i: i >= 40)


@pytest.mark.parametrize("seed,chunk", [(11, 2000), (12, 9)])
def test_pairs(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(titles, "CHUNK_ROWS", chunk)
    rows = random_rows(seed, 60, 20)
    got = {r.id: (r.score, -r.partner_id, r.partners) for r in title_partners(articles(spark, rows)).collect()}
    pairs = plain_pairs(rows)
    assert got.keys() == {a for a, _ in pairs}
    for a, best in got.items():
        scored = [(score, -b) for (x, b), score in pairs.items() if x == a]
        assert best == pytest.approx((*max(scored), len(scored)))
