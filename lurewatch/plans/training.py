"""Training runs with metrics per split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.operators.features import FEATURE_COLUMNS, build_features
from lurewatch.operators.isolation import IsolationForest, outlier_flag, train_isolation_forest
from lurewatch.operators.metrics import binary_metrics, roc_auc
from lurewatch.operators.text_classifier import (
    TextClassifier,
    train_classifier,
    validate_training,
)
from lurewatch.session import stage

SPLITS = ("train", "val", "test")


def split_metrics(scored: DataFrame, with_auc: bool = True) -> DataFrame:
    """Metrics per split from (split, label, prediction, score).

    Scoring is the costly part, so the four narrow columns are stored once for all metrics.
    """
    stored = stage(scored.select("split", "label", "prediction", "score"), "scored")
    table = binary_metrics(stored, by=["split"])
    if not with_auc:
        return table.withColumn("roc_auc", F.lit(None).cast("double"))
    areas = reduce(
        DataFrame.unionByName,
        [
            roc_auc(stored.filter(F.col("split") == name)).withColumn("split", F.lit(name))
            for name in SPLITS
        ],
    )
    return table.join(areas, "split", "left")


def run_training(
    data: DataFrame, model: str = "logreg", path: str | None = None, **options
) -> tuple[TextClassifier, DataFrame]:
    """Fit on the training split; metrics for all three and the number of features."""
    target = options.get("target_col", "label")
    rows = validate_training(data, target, options.get("text_col", "text_combined"))
    present = {r["split"] for r in rows.select("split").distinct().collect()}
    missing = [s for s in SPLITS if s not in present]
    if missing:
        raise FileNotFoundError(f"Missing split: {', '.join(missing)}")
    classifier = train_classifier(rows.filter(F.col("split") == "train"), model, **options)
    scored = classifier.score(rows, "score").withColumn("label", F.col(target))
    metrics = split_metrics(scored, with_auc=model == "logreg").withColumn("num_features", F.lit(int(classifier.model.numFeatures)))
    if path:
        classifier.save(f"{path}/{model}")
        metrics.write.mode("overwrite").json(f"{path}/{model}_metrics")
    return classifier, metrics


def train_outlier_model(
    data: DataFrame, benign: DataFrame, id_col: str, **options
) -> tuple[IsolationForest, DataFrame]:
    """Forest on benign rows; metrics per split of ``data``."""
    features = stage(
        build_features(data).select("split", "label", *FEATURE_COLUMNS), "features"
    )
    forest = train_isolation_forest(
        build_features(benign), FEATURE_COLUMNS, id_col, **options
    )
    scored = forest.raw_score(features, "score").withColumn(
        "prediction", outlier_flag(F.col("score"), forest.threshold)
    )
    return forest, split_metrics(scored)
