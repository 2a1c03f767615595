"""Dataset statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sanity_stats(df: DataFrame, before_count: int | DataFrame | None = None) -> DataFrame:
    """One row: totals, label counts, ratio of ones to zeros (infinite without zeros), removed.

    ``before_count`` is a number, or the table before cleaning -- then both are counted in the
    same query.
    """
    stats = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("label") == 0).alias("zeros"),
        F.count_if(F.col("label") == 1).alias("ones"),
    ).withColumn(
        "ratio",
        F.when(F.col("zeros") > 0, F.col("ones") / F.col("zeros")).otherwise(F.lit(float("inf"))),
    )
    if isinstance(before_count, DataFrame):
        before = before_count.agg(F.count("*").alias("before"))
        # Two one-row tables side by side.
        stats = (
            stats.withColumn("_one", F.lit(1))
            .join(before.withColumn("_one", F.lit(1)), "_one")
            .withColumn("removed", F.col("before") - F.col("total"))
            .drop("before", "_one")
        )
    elif before_count is not None:
        stats = stats.withColumn("removed", F.lit(int(before_count)) - F.col("total"))
    else:
        stats = stats.withColumn("removed", F.lit(None).cast("long"))
    return stats


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source", "label").agg(F.count("*").alias("emails"))


def source_proportions(df: DataFrame) -> DataFrame:
    """Share of each label within its source (nulls left out, as a value count does)."""
    # The window runs over the counts, a handful of rows per source.
    per_source = Window.partitionBy("source")
    return (
        source_counts(df.filter(F.col("label").isNotNull()))
        .withColumn("proportion", F.col("emails") / F.sum("emails").over(per_source))
        .select("source", "label", "proportion")
    )


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weights ``n / (classes * n_label)``, one row per label."""
    everything = Window.partitionBy()
    return (
        df.groupBy(F.col(label_col).alias("label"))
        .agg(F.count("*").alias("emails"))
        .withColumn(
            "weight",
            F.sum("emails").over(everything)
            / (F.count("*").over(everything) * F.col("emails")),
        )
    )
