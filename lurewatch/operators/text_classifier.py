"""Linear text classifiers on TF-IDF features."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions.labels import number_of
from lurewatch.functions.scores import sigmoid
from lurewatch.operators.profiling import class_weights
from lurewatch.operators.squared_hinge import fit_squared_hinge
from lurewatch.operators.term_weights import fit_tfidf
from lurewatch.session import stage

MODELS = ("logreg", "linear_svm")


def validate_training(df: DataFrame, target_col: str = "label", text_col: str = "text_combined"):
    """Raise when a column is missing or the target is not numeric; return integer targets."""
    for kind, name in (("Target", target_col), ("Text", text_col)):
        if name not in df.columns:
            raise KeyError(f"{kind} column '{name}' not found: the table has no such column")
    bad = count_bad_targets(df, target_col).first()["bad"]
    if bad:
        raise ValueError(f"{bad} non-numeric values in target column '{target_col}'")
    return df.withColumns(
        {
            target_col: F.col(target_col).cast("double").cast("int"),
            text_col: F.coalesce(F.col(text_col).cast("string"), F.lit("")),
        }
    )


def count_bad_targets(df: DataFrame, target_col: str) -> DataFrame:
    return df.agg(F.count_if(number_of(F.col(target_col)).isNull()).alias("bad"))


def balanced_weight(df: DataFrame, label_col: str) -> Column:
    """Weight per row as an expression; the weights are one number per class."""
    weight = F.lit(1.0)
    for row in class_weights(df, label_col).collect():
        weight = F.when(F.col(label_col) == row["label"], F.lit(row["weight"])).otherwise(weight)
    return weight


@dataclass
class TextClassifier:
    """Vectoriser and linear model; ``score`` adds the probability column."""

    vectors: PipelineModel
    model: object
    name: str
    text_col: str

    def score(
        self, df: DataFrame, output_col: str = "supervised_proba", skip: Column | None = None
    ) -> DataFrame:
        """Probability of the positive class; margins of the SVM go through a sigmoid.

        The text is that of the column the model was trained on, the combined text where that is
        empty.  Rows for which ``skip`` holds are given no text to the model and get null.
        """
        text = F.col(self.text_col) if self.text_col in df.columns else F.lit(None)
        if self.text_col != "text_combined" and "text_combined" in df.columns:
            text = F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.col("text_combined"))
        text = text.cast("string")
        if skip is not None:
            skip = F.coalesce(skip, F.lit(False))
            text = F.when(~skip, text)
        prepared = df.withColumn("_score_text", text)
        out = self.model.transform(self.vectors.transform(prepared))
        if self.name == "logreg":
            proba = vector_to_array("_probability")[1]
        else:
            proba = sigmoid(vector_to_array("_raw")[1])
        if skip is not None:
            proba = F.when(~skip, proba)
        return out.withColumn(output_col, proba).drop(
            "_score_text", "_tfidf", "_raw", "_probability"
        )

    def save(self, path: str) -> None:
        self.vectors.write().overwrite().save(f"{path}/vectors")
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.getActiveSession()
        settings = json.dumps({"name": self.name, "text_col": self.text_col})
        spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/settings")


def load_classifier(spark: SparkSession, path: str) -> TextClassifier:
    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
    kind = LogisticRegressionModel if settings["name"] == "logreg" else LinearSVCModel
    return TextClassifier(
        PipelineModel.load(f"{path}/vectors"), kind.load(f"{path}/model"),
        settings["name"], settings["text_col"],
    )


def train_classifier(
    train: DataFrame,
    model: str = "logreg",
    target_col: str = "label",
    text_col: str = "text_combined",
    max_iter: int = 2000,
    class_weight: str | None = "balanced",
    max_features: int = 20_000,
    min_df: int = 3,
    inverse_regularisation: float = 1.0,
) -> TextClassifier:
    """Fit the vectoriser and a linear model on validated rows.

    ``inverse_regularisation`` is the usual ``C``: the summed loss against half the squared norm.
    Spark's logistic regression takes the mean loss, so its penalty is scaled by the number of rows.
    The support vector machine minimises the squared hinge.
    """
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    rows = validate_training(train, target_col, text_col)
    balanced = class_weight is not None and class_weight.lower() != "none"
    weight = balanced_weight(rows, target_col) if balanced else F.lit(1.0)
    # The rows are put together once, for terms and vectors.
    prepared = stage(
        rows.select(
            F.col(text_col).alias("_score_text"),
            F.col(target_col).cast("double").alias("label"),
            weight.alias("weight"),
        ),
        "training-texts",
    )
    vectors = fit_tfidf(prepared, "_score_text", "_tfidf", max_features, min_df)
    data = vectors.transform(prepared).select("_tfidf", "label", "weight")
    columns = {"featuresCol": "_tfidf", "rawPredictionCol": "_raw", "predictionCol": "prediction"}
    if model == "logreg":
        n = prepared.count()
        estimator = LogisticRegression(
            labelCol="label", weightCol="weight", probabilityCol="_probability", maxIter=max_iter,
            regParam=1.0 / (inverse_regularisation * max(n, 1)), standardization=False, **columns,
        )
        return TextClassifier(vectors, estimator.fit(data), model, text_col)
    size = vectors.transform(prepared.limit(0)).schema["_tfidf"].metadata["ml_attr"]["num_attrs"]
    coefficients, intercept = fit_squared_hinge(data, size, "_tfidf", inverse_regularisation, max_iter)
    return TextClassifier(vectors, _svm_model(train.sparkSession, coefficients, intercept, columns), model, text_col)


def _svm_model(spark: SparkSession, coefficients, intercept: float, columns: dict[str, str]) -> LinearSVCModel:
    """Spark's own model for given coefficients, for scoring and storing."""
    fitted = LinearSVCModel(
        spark._jvm.org.apache.spark.ml.classification.LinearSVCModel(
            f"squared_hinge_{uuid.uuid4().hex[:12]}", _py2java(spark.sparkContext, Vectors.dense(coefficients)), intercept
        )
    )
    return fitted._set(**columns)
