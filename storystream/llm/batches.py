"""Python functions over Arrow batches, a bounded number of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows handed to a function at once, so that long texts are not all copied together
SLICE_ROWS = 512

Columns = list[list]


def map_slices(df: DataFrame, make: Callable[[], Callable[..., Columns]], schema: str) -> DataFrame:
    """Apply `make()(*columns)` to slices of each partition; it returns the output columns as lists.

    `make` runs once per task, so that what it builds (automata, caches) is
    shared by the slices of a partition.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                columns = apply(*(column.to_pylist() for column in part.columns))
                arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)
