"""Corpus preparation: CSV folders to cleaned, de-duplicated, split tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.operators.cleaning import clean, keep_first
from lurewatch.operators.profiling import sanity_stats
from lurewatch.operators.splitting import split_hash, stratified_split
from lurewatch.session import stage
from lurewatch.sources import labelled_csv
from lurewatch.sources.sinks import read_written, write_splits, write_table


@dataclass
class Prepared:
    data: DataFrame  # with the split column
    before: DataFrame  # statistics before and after, one row each
    after: DataFrame


def preprocess_and_split(
    df: DataFrame,
    order_by: list[str],
    val_size: float = 0.1,
    test_size: float = 0.1,
    seed: int = 42,
    output: str | None = None,
    file_format: str = "parquet",
) -> Prepared:
    """Clean, keep the first row per text, split, and optionally write one folder per split.

    The de-duplicated table is written to the shared folder once, with the hash that orders the
    split; counting for the split reads labels and hashes back, no texts.
    """
    before = sanity_stats(df)
    cleaned = clean(df)
    kept = keep_first(cleaned, order_by).withColumn("_split_hash", split_hash(F.col("text_combined"), seed))
    unique = stage(kept, "deduplicated")
    after = sanity_stats(unique.drop("_split_hash"), before_count=cleaned)
    data = stratified_split(unique, val_size, test_size, seed, hash_col="_split_hash").drop("_split_hash")
    extra = [c for c in labelled_csv.ORDER_COLUMNS if c in data.columns]
    data = data.drop(*extra)
    if output:
        write_splits(data, output, file_format)
        data = read_written(df.sparkSession, output, data, file_format)
    return Prepared(data, before, after)


def build_splits(
    spark: SparkSession, raw_dir: str, output: str, file_format: str = "parquet",
    dedupe: bool = True, **options,
) -> Prepared:
    """Discover, load and split every CSV below ``raw_dir``.

    ``dedupe`` keeps the first row per raw text before the cleaning; equal texts after the
    cleaning are one row in any case.
    """
    rows = labelled_csv.load_csv(spark, _discovered(spark, raw_dir))
    if dedupe:
        rows = keep_first(rows, labelled_csv.ORDER_COLUMNS)
    return preprocess_and_split(
        rows, labelled_csv.ORDER_COLUMNS, output=output, file_format=file_format, **options
    )


def _discovered(spark: SparkSession, raw_dir: str) -> list[labelled_csv.CsvConfig]:
    configs = labelled_csv.discover_csv(spark, raw_dir)
    if not configs:
        raise FileNotFoundError(f"nothing to load: {raw_dir} holds no *.csv")
    return configs


def build_benign(
    spark: SparkSession, raw_dir: str, output: str, dedupe: bool = True, file_format: str = "parquet"
) -> DataFrame:
    """Discover and load every CSV below ``raw_dir``, write the benign rows, read them back."""
    rows = labelled_csv.load_all(spark, _discovered(spark, raw_dir), dedupe)
    benign = benign_only(rows, split=None)
    write_table(benign, output, file_format)
    return read_written(spark, output, benign, file_format)


def benign_only(df: DataFrame, split: str | None = "train") -> DataFrame:
    """Benign rows.  By default of the training split only, so that rows held out for validation
    do not leak into a model fitted on benign mail; ``split=None`` takes every row."""
    benign = df.filter(F.col("label") == 0)
    if split is not None:
        benign = benign.filter(F.col("split") == split).drop("split")
    return benign
