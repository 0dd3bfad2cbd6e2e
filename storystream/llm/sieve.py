"""A bounded table of bits that tells which rows cannot meet any key, so that a join need not shuffle them.

Spark decides by size whether a join broadcasts its keys; once they are too many,
the wide side is shuffled whole, also where most of it meets nothing. A sieve
holds one bit per hash of a key. A row whose bit is not set has no key for
certain; the others go on to the join, which decides. The table never exceeds
`BITS`; with very many keys it only lets more rows through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storystream.session import materialize

#: 8 MB
BITS = 1 << 26


def _bit(*columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BITS)) + 1


def sieve(keys: DataFrame, label: str) -> DataFrame:
    """Rows (sieve_bucket, bits): a bit for each row of `keys`, by all its columns in their order."""
    bits = keys.select(_bit(*keys.columns).alias("bit"))
    # Bits go to their bucket one by one: a partial bitmap is as large as a whole one
    return materialize(
        bits.withColumn("sieve_bucket", F.bitmap_bucket_number("bit"))
        .repartition("sieve_bucket")
        .groupBy("sieve_bucket")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")),
        label,
    )


def passed(rows: DataFrame, table: DataFrame, *columns: str | Column) -> tuple[DataFrame, DataFrame]:
    """`rows` that may have one of the keys, and those that have none for certain.

    `columns` are the key's, of the same types and in the same order.
    """
    at = F.bitmap_bit_position(_bit(*columns))
    byte = F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))
    is_set = F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), (at % 8).cast("int")) == 1, F.lit(False))
    met = rows.join(F.broadcast(table), F.bitmap_bucket_number(_bit(*columns)) == table["sieve_bucket"], "left")
    return met.where(is_set).select(rows.columns), met.where(~is_set).select(rows.columns)
