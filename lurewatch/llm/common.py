"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that a Python task looks at together, whatever the size of Spark's batches.
SLICE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def fold(column: str, modulus: int, rest: int):
    """Whether a row belongs to the held-out fold; rows without an id never do."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == rest, F.lit(False))


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``limit`` bytes of text each, or one row if that is more."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        if batch.num_rows > start:
            yield batch.slice(start)


def arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)
