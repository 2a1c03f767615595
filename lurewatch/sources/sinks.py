"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_splits(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """One folder per split."""
    write_table(df, path, file_format, partition_by=["split"])


def write_table(
    df: DataFrame, path: str, file_format: str = "parquet", partition_by: list[str] | None = None
) -> None:
    """``csv`` writes headers and quotes line breaks."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if file_format == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    writer.format(file_format).save(path)


def read_written(spark: SparkSession, path: str, like: DataFrame, file_format: str = "parquet") -> DataFrame:
    """What one of the functions here has written, with the columns it was written from."""
    reader = spark.read.format(file_format).schema(like.schema)
    if file_format == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.load(path)


def write_report(df: DataFrame, path: str, separator: str = ",") -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
