"""Arrow batches in and out of Python functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def map_lists(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Apply a function to the columns of each Arrow batch, given as Python lists; it returns lists, one for each field.

    `make` runs once in each task and returns that function, so tables and caches are built once a task.
    """
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                cols = fn(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    return df.mapInArrow(run, schema)
