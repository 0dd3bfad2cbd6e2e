"""Message topics: JSON values keyed by url, in Kafka or in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storystream.schema import PROCESSED_MESSAGE, RAW_MESSAGE
from storystream.session import materialize

RAW_TOPIC = "news.raw"
PROCESSED_TOPIC = "news.processed"

# JSON writers leave out NULL fields by default; messages name every field
JSON_OPTIONS = {"ignoreNullFields": "false"}


def read_topic(
    spark: SparkSession, format: str = "kafka", stream: bool = True, path: str | None = None, **options: str
) -> DataFrame:
    """Messages as `value` text, and `place`, where in the topic they stand.

    For Kafka pass `subscribe` and the servers; reading starts at the earliest
    offset. For "text" pass the folder: one message per line, in order of file
    time, name and line.
    """
    reader = spark.readStream if stream else spark.read
    if format == "kafka":
        options = {"startingOffsets": "earliest", "subscribe": RAW_TOPIC, **options}
        rows = reader.format("kafka").options(**options).load()
        place = F.struct("timestamp", "partition", "offset")
        return rows.select(F.col("value").cast("string").alias("value"), place.alias("place"))
    rows = reader.format(format).options(**options).load(path)
    place = F.struct(
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    return rows.select("value", place.alias("place"))


def with_arrival(messages: DataFrame) -> DataFrame:
    """Add `arrival`, the order of the messages of one batch.

    Lines of a file keep their order by row number; the numbers are written
    down at once, as another read could give others.
    """
    numbered = messages.withColumn("line", F.monotonically_increasing_id())
    return materialize(
        numbered.select("value", F.struct("place.*", "line").alias("arrival")), "messages"
    )


def decode_raw(messages: DataFrame) -> DataFrame:
    """Add `payload`; text that is no JSON object gives NULL."""
    payload = F.from_json("value", RAW_MESSAGE)
    is_object = F.get_json_object("value", "$").startswith("{")
    return messages.withColumn("payload", F.when(is_object, payload))


def decode_processed(messages: DataFrame) -> DataFrame:
    return messages.select(F.from_json("value", PROCESSED_MESSAGE).alias("payload")).select("payload.*")


def encode(key: Column, *fields: Column | str) -> list[Column]:
    """`key` and `value` columns of a message."""
    return [key.alias("key"), F.to_json(F.struct(*fields), JSON_OPTIONS).alias("value")]


def raw_messages(entries: DataFrame) -> DataFrame:
    return entries.select(*encode(F.col("url"), *[f.name for f in RAW_MESSAGE.fields]))


def processed_messages(articles: DataFrame) -> DataFrame:
    """`{id, url}` of the articles that are no duplicate."""
    return republished(articles.filter("duplicate_of_id IS NULL"))


def republished(articles: DataFrame) -> DataFrame:
    """`{id, url}` of all articles, to process them once more."""
    return articles.select(*encode(F.col("url"), "id", "url"))


def write_topic(
    messages: DataFrame, format: str = "kafka", path: str | None = None, batch: int | None = None, **options: str
) -> None:
    """Append messages to a topic (Kafka) or a folder (text).

    The messages of a stream's `batch` have a folder of their own, which a
    repeated batch writes anew. Kafka has no such place: a repeated batch sends
    again there, and the url that is the key tells the messages are the same.
    """
    if format == "kafka":
        messages.write.format("kafka").options(**options).save()
    elif batch is None:
        messages.select("value").write.mode("append").format(format).options(**options).save(path)
    else:
        folder = f"{path}/batch={batch}"
        messages.select("value").write.mode("overwrite").format(format).options(**options).save(folder)
