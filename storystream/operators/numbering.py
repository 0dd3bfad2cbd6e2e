"""Dense numbers over a total order, without passing all rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storystream.session import materialize


def with_sequence(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Add `name` = start, start + 1, … along the columns `order`, which must be unique.

    Rows are range-partitioned, numbered within their partition and shifted by
    the sizes of the partitions before it; only those sizes meet in one task.
    The range-partitioned rows are written once, because sampling the ranges
    again could move a row to another partition.
    """
    ranged = materialize(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_row", F.row_number().over(within))
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_row") + F.lit(start - 1))
        .drop("_part", "_row", "_offset")
    )
