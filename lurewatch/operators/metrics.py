"""Classification metrics as aggregations."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(numerator: Column, denominator: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def binary_metrics(
    df: DataFrame,
    label_col: str = "label",
    prediction_col: str = "prediction",
    by: list[str] | None = None,
) -> DataFrame:
    """rows, accuracy, precision, recall, f1 -- one row, or one per group."""
    label, predicted = F.col(label_col), F.col(prediction_col)
    cells = df.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"),
        F.count_if((label == 1) & (predicted == 1)).alias("tp"),
        F.count_if((label == 0) & (predicted == 1)).alias("fp"),
        F.count_if((label == 1) & (predicted == 0)).alias("fn"),
        F.count_if(label == predicted).alias("hits"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.select(
        *(by or []),
        "rows",
        _ratio(F.col("hits"), F.col("rows")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


_AUC_BUCKETS = 512


def roc_auc(df: DataFrame, label_col: str = "label", score_col: str = "score") -> DataFrame:
    """One row with ``roc_auc``; tied scores count half, NaN when a class is missing.

    Rows are first reduced to one per distinct score.  The running count of negatives below a
    score is taken inside buckets of about equal size (bounds from approximate quantiles, so a
    dense score range is spread over many of them) plus the total of the buckets below, a table
    of at most a few hundred rows.  No window spans the whole table.
    """
    scored = df.select(
        F.col(score_col).cast("double").alias("score"), F.col(label_col).alias("label")
    ).filter(F.col("score").isNotNull() & F.col("label").isin(0, 1))
    by_score = scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    quantiles = [i / _AUC_BUCKETS for i in range(1, _AUC_BUCKETS)]
    bounds = scored.agg(F.percentile_approx("score", quantiles, 10_000)).first()[0]
    splits = [float("-inf"), *sorted(set(bounds or [0.0])), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="score", outputCol="bucket").transform(by_score)

    # Bounded by the number of buckets, hence a single small window.
    below = (
        bucketed.groupBy("bucket")
        .agg(F.sum("neg").alias("bucket_neg"))
        .select(
            "bucket",
            (
                F.sum("bucket_neg").over(
                    Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
                )
                - F.col("bucket_neg")
            ).alias("neg_before"),
        )
    )
    inside = Window.partitionBy("bucket").orderBy("score").rowsBetween(
        Window.unboundedPreceding, 0
    )
    pairs = (
        bucketed.withColumn("neg_below", F.sum("neg").over(inside) - F.col("neg"))
        .join(below, "bucket")
        .select(
            "pos",
            "neg",
            (F.col("pos") * (F.col("neg_before") + F.col("neg_below") + F.col("neg") / 2)).alias("u"),
        )
    )
    totals = pairs.agg(
        F.sum("u").alias("u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    denominator = F.col("pos").cast("double") * F.col("neg")
    return totals.select(
        F.when(denominator > 0, F.col("u") / denominator)
        .otherwise(F.lit(float("nan")))
        .alias("roc_auc")
    )
