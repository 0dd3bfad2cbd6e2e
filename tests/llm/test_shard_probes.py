"""Candidate keys of the histogram sort."""

from pyspark.sql import functions as F

from storystream.llm import sharding


def narrow(docs):
    return docs.select(
        sharding.key_of(F.col("doc_id"), F.col("text")).alias("key"), sharding.size_of(F.col("text")).alias("size")
    )


def test_draw_is_near_the_wanted_number_and_sends_copies_once(spark):
    rows = spark.range(50_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    drawn = sharding._draw(narrow(rows), 50_000, 1000, 0)
    assert 900 < len(drawn) < 1300 and drawn == sorted(set(drawn))
    assert sharding._draw(narrow(rows.limit(0)), 0, 1000, 0) == []


def test_draw_finds_the_few_keys_among_many_copies(spark):
    copies = spark.range(40_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    few = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id bigint, text string")
    keys = narrow(copies.unionByName(few))
    for turn in range(4):
        assert sharding._draw(keys, 40_005, 8, turn)
    # Copies cannot be parted, so one shard holds them; all the others share what is left, and slots have no gap
    found = sharding.shard(copies.unionByName(few), 4, probes=8)
    sizes = {r.shard: (r.n, r.slots) for r in found.groupBy("shard").agg(
        F.count("*").alias("n"), F.count_distinct("slot").alias("slots")).collect()}
    assert sum(n for n, _ in sizes.values()) == 40_005 and all(n == slots for n, slots in sizes.values())
    assert found.where("text = 'same'").select("shard").distinct().count() == 1
    tops = found.groupBy("shard").agg(F.max("slot").alias("top"), F.count("*").alias("n")).collect()
    assert all(r.top == r.n - 1 for r in tops)


def test_every_splitter_is_within_tolerance_of_unequal_texts(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.expr("repeat(cast(id as string), cast(id % 37 + 1 as int))").alias("text")
    )
    bytes_of = [r.b for r in sharding.shard(docs, 16).withColumn("b", sharding.size_of(F.col("text")))
                .groupBy("shard").agg(F.sum("b").alias("b")).collect()]
    share = sum(bytes_of) / 16
    assert len(bytes_of) == 16 and all(abs(b - share) <= 2 * sharding.TOLERANCE * share + 400 for b in bytes_of)
