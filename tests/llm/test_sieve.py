"""The bit table before joins: it loses no row that has a key, and texts that have none are not shuffled."""

from pyspark.sql import functions as F

from storystream.llm import minhash
from storystream.llm.sieve import passed, sieve


def test_no_row_with_a_key_is_lost(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("id"), F.col("id").alias("h"))
    keys = rows.where("h % 9 = 0")
    met, free = passed(rows, sieve(keys, "keys"), "id", "h")
    assert met.join(keys.select("h"), "h", "left_semi").count() == keys.count()
    assert met.count() < 1.01 * keys.count() and met.count() + free.count() == 40_000
    assert met.unionByName(free).select("h").distinct().count() == 40_000
    none, all_of_them = passed(rows, sieve(keys.limit(0), "no-keys"), "id", "h")
    assert none.count() == 0 and all_of_them.count() == 40_000


def shuffled_bytes(node):
    """Bytes that the shuffles of a plan that ran have written."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_bytes(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_bytes(node.plan())
    own = node.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
    children = node.children()
    return own + sum(shuffled_bytes(children.apply(i)) for i in range(children.size()))


def test_texts_without_a_copy_are_not_shuffled(spark, tmp_path):
    text = F.concat_ws(" ", *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{i}")), 256) for i in range(30)))
    docs = spark.range(1, 2001).select(F.col("id").alias("doc_id"), text.alias("text"))
    copies = docs.where("doc_id <= 20").withColumn("doc_id", F.col("doc_id") + 5000)
    docs.union(copies).repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # As with more dropped rows than a broadcast takes
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = minhash.deduplicate(docs)
        rows = left.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.doc_id for r in rows) == list(range(1, 2001))
    assert shuffled_bytes(left._jdf.queryExecution().executedPlan()) < 0.1 * sum(len(r.text) for r in rows)
