"""Score arithmetic: margins, logits, predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def softmax_positive(logit0: Column, logit1: Column, temperature: float = 2.0) -> Column:
    """Positive-class probability of a two-class softmax with temperature."""
    return sigmoid((logit1 - logit0) / F.lit(float(temperature)))


def argmax_prediction(logit0: Column, logit1: Column) -> Column:
    """Class with the larger logit; a tie goes to class 0."""
    return F.when(logit1 > logit0, 1).otherwise(0)
