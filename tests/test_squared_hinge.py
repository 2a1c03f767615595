"""The squared hinge against a dense solution by Newton's method."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import DoubleType, StructField, StructType

from lurewatch.operators import squared_hinge
from lurewatch.operators.squared_hinge import fit_squared_hinge, minimise

SCHEMA = StructType([StructField("v", VectorUDT()), StructField("label", DoubleType()), StructField("weight", DoubleType())])


def newton(x, y, weight, c):
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        inside = 1 - y * (x @ w) > 0
        a, d = x[inside], 2 * c * weight[inside]
        gradient = w - a.T @ (d * y[inside] * (1 - y[inside] * (a @ w)))
        w = w - np.linalg.solve(np.eye(len(w)) + a.T @ (a * d[:, None]), gradient)
    return w


def table(spark, x, label, weight):
    sparse = [Vectors.sparse(x.shape[1], {int(j): float(r[j]) for j in np.flatnonzero(r)}) for r in x]
    rows = list(zip(sparse, label.tolist(), weight.tolist(), strict=True))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("c", [0.1, 1.0, 20.0])
def test_the_minimum_is_found(spark, c):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 12)) * (rng.random((80, 12)) < 0.4)
    x[5] = 0  # a text without terms
    label = (x[:, 0] + x[:, 3] + 0.5 * rng.normal(size=80) > 0.3).astype(float)
    weight = np.where(label == 1, 1.5, 0.7)
    expected = newton(x, 2 * label - 1, weight, c)
    got, intercept = fit_squared_hinge(table(spark, x, label, weight), 12, "v", c, tolerance=1e-9)
    assert np.append(got, intercept) == pytest.approx(expected, abs=1e-6)


def test_degenerate_tables(spark):
    x = np.eye(3)
    one_class, intercept = fit_squared_hinge(table(spark, x, np.ones(3), np.ones(3)), 3, "v")
    assert (one_class > 0).all() and intercept > 0
    empty, intercept = fit_squared_hinge(table(spark, x, np.ones(3), np.ones(3)).limit(0), 3, "v")
    assert not empty.any() and intercept == 0
    blank, intercept = fit_squared_hinge(table(spark, np.zeros((4, 3)), np.array([1.0, 1, 1, 0]), np.ones(4)), 3, "v")
    assert not blank.any() and intercept == pytest.approx(4 / 9, abs=1e-3)


def test_steps_stop():
    def bowl(w):
        return float(w @ w), 2 * w
    assert minimise(bowl, np.full(4, 3.0), 50, 1e-8) == pytest.approx(np.zeros(4), abs=1e-7)
    assert minimise(bowl, np.full(4, 3.0), 0, 1e-8) == pytest.approx(np.full(4, 3.0))


def test_passes_do_not_grow_with_the_table(spark, monkeypatch):
    """Many rows for a few numbers of curvature: without the sample it takes 175 passes here."""
    rng = np.random.default_rng(7)
    scales = 1 / (1 + np.arange(60.0))
    x = rng.normal(size=(3000, 60)) * scales * (rng.random((3000, 60)) < 0.5)
    label = (x @ rng.normal(size=60) + 0.3 * rng.normal(size=3000) > 0).astype(float)
    passes = []
    one = squared_hinge._pass
    monkeypatch.setattr(squared_hinge, "_pass", lambda *a: passes.append(1) or one(*a))
    monkeypatch.setattr(squared_hinge, "SAMPLE_ROWS", 600)
    data = table(spark, x, label, np.ones(3000)).cache()
    got, intercept = fit_squared_hinge(data, 60, "v", tolerance=1e-6)
    assert np.append(got, intercept) == pytest.approx(newton(x, 2 * label - 1, np.ones(3000), 1.0), abs=1e-4)
    assert len(passes) <= 20


def test_more_features_than_sampled_rows(spark, monkeypatch):
    """The curvature of all rows: by that of a sample of fewer rows than features, steps were cut again
    and again."""
    rng = np.random.default_rng(8)
    x = rng.random((600, 120)) * (rng.random((600, 120)) < 0.2)
    label = (rng.random(600) < 0.3).astype(float)
    passes = []
    one = squared_hinge._summed
    monkeypatch.setattr(squared_hinge, "_summed", lambda *a: passes.append(1) or one(*a))
    monkeypatch.setattr(squared_hinge, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(squared_hinge, "PACK_ENTRIES", 500)
    got, intercept = fit_squared_hinge(table(spark, x, label, np.ones(600)), 120, "v", 5.0)
    assert np.append(got, intercept) == pytest.approx(newton(x, 2 * label - 1, np.ones(600), 5.0), abs=0.02)
    assert len(passes) <= 120


def test_rows_are_read_once(spark):
    """However many passes there are; a vector without entries stands between others."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    x = np.eye(6)[:, :4]
    data = table(spark, x, np.array([1.0, 0, 1, 0, 1, 0]), np.ones(6))
    counted = data.mapInArrow(count, SCHEMA)
    got, _ = fit_squared_hinge(counted, 4, "v", tolerance=1e-8)
    assert read.value == 6 and got == pytest.approx([x for x in newton(x, np.array([1.0, -1] * 3), np.ones(6), 1.0)[:4]], abs=1e-6)
