import pytest
from pyspark.sql import functions as F

from lurewatch.functions.labels import normalize_has_url, normalize_label, pandas_missing
from lurewatch.operators.cleaning import clean, keep_first, to_canonical
from lurewatch.operators.profiling import (
    class_weights,
    sanity_stats,
    source_counts,
    source_proportions,
)


def values(spark, raw, schema, function):
    df = spark.createDataFrame([(v,) for v in raw], f"raw {schema}")
    return [r[0] for r in df.select(function(F.col("raw"))).collect()]


@pytest.mark.parametrize(
    "schema,raw,expected",
    [
        ("string", ["Phishing", "spam", "SAFE", "ham", "1", "0", None, "unknown", " ", " yes\n"],
         [1, 1, 0, 0, 1, 0, None, None, None, 1]),
        ("double", [0.0, 1.0, 2.0, None], [0, 1, None, None]),
        ("int", [0, 1, 3], [0, 1, None]),
        ("boolean", [True, False, None], [1, 0, None]),
    ],
)
def test_normalize_label(spark, schema, raw, expected):
    assert values(spark, raw, schema, normalize_label) == expected


@pytest.mark.parametrize(
    "schema,raw,expected",
    [
        ("string", ["1", "0", "yes", "no", "unknown", "2", "spam"], [1, 0, 1, 0, None, None, None]),
        ("double", [1.0, 0.0, 2.0], [1, 0, None]),
        ("boolean", [True, False], [1, 0]),
    ],
)
def test_normalize_has_url(spark, schema, raw, expected):
    assert values(spark, raw, schema, normalize_has_url) == expected


def test_missing_spellings(spark):
    assert values(spark, ["NA", "null", "text", "", "nan "], "string", pandas_missing) == [
        None, None, "text", None, "nan ",
    ]


def test_canonical_rows(spark):
    df = spark.createDataFrame(
        [("a@b.c", None, "hello", "spam"), ("x", "s", " \t", "ham"), ("y", "s", "body", "maybe")],
        "from_address string, subject string, body string, label string",
    )
    rows = to_canonical(df.withColumn("source", F.lit("set"))).collect()
    assert len(rows) == 1
    assert rows[0].asDict() == {
        "source": "set", "from_address": "a@b.c", "subject": "", "body": "hello", "label": 1,
        "text_combined": "FROM: a@b.c SUBJECT:  BODY: hello", "has_url": None,
    }


def test_clean_and_keep_first(spark):
    df = spark.createDataFrame(
        [(3, "a  \n b", 1), (1, "a b", 0), (2, " a b ", 1), (4, " \x1c ", 1), (5, "c", None), (6, "d", 2)],
        "id int, text_combined string, label int",
    )
    cleaned = clean(df)
    assert {r.id for r in cleaned.collect()} == {1, 2, 3}
    first = keep_first(cleaned, ["id"]).collect()
    assert [(r.id, r.text_combined, r.label) for r in first] == [(1, "a b", 0)]


def test_keep_first_limits_before_the_exchange(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("text_combined"))
    plan = keep_first(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_sanity_stats(spark):
    df = spark.createDataFrame([("x", 0), ("y", 1), ("z", 1)], "text_combined string, label int")
    row = sanity_stats(df, before_count=5).first()
    assert (row.total, row.zeros, row.ones, row.ratio, row.removed) == (3, 1, 2, 2.0, 2)
    assert sanity_stats(df.filter("label = 1")).first().ratio == float("inf")
    assert sanity_stats(df).first().removed is None
    assert sanity_stats(df.limit(1), before_count=df).first().removed == 2


def test_source_profiles_and_weights(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("b", 0)], "source string, label int")
    assert {(r.source, r.label): r.emails for r in source_counts(df).collect()} == {
        ("a", 0): 1, ("a", 1): 2, ("b", 0): 1,
    }
    shares = {(r.source, r.label): r.proportion for r in source_proportions(df).collect()}
    assert shares[("a", 1)] == pytest.approx(2 / 3) and shares[("b", 0)] == 1.0
    weights = {r.label: r.weight for r in class_weights(df.union(df.filter("label = 0"))).collect()}
    assert weights == {0: pytest.approx(6 / (2 * 4)), 1: pytest.approx(6 / (2 * 2))}
