"""Term statistics, sparse vectors and the vocabulary by sketch."""

import random

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import term_sketch, term_weights

def test_vectors_equal_the_fitted_model(spark):
    texts = ["the cat sat on the mat", "the dog sat", None, "", "cat cat dog", "ünïque wörds"]
    frame = spark.createDataFrame(list(enumerate(texts)), "email_id long, text_combined string")
    model = term_weights.fit_tfidf(frame, min_df=1, max_features=12)
    terms = model.stages[4].vocabulary
    want = {}
    for r in model.transform(frame).collect():
        for at, value in zip(r.features.indices, r.features.values, strict=True):
            want[r.email_id, terms[at]] = pytest.approx(float(value))
    top = term_weights.vocabulary(term_weights.term_stats(frame, min_df=1), 12)
    rows = term_weights.tfidf_rows(frame, term_weights.idf_weights(top, frame.count()), "email_id")
    assert {(r.email_id, r.term): r.weight for r in rows.collect()} == want


def test_term_stats_count_texts_and_occurrences(spark):
    frame = spark.createDataFrame([("aa bb aa",), ("aa",), (None,), ("bb x aa",)], "text_combined string")
    got = {r.term: (r.tf, r.df) for r in term_weights.term_stats(frame, min_df=1).collect()}
    assert got == {"aa": (4, 3), "bb": (2, 2), "aa bb": (1, 1), "bb aa": (2, 2)}


def zipf_texts(spark, n=400):
    rng = random.Random(5)
    words = [f"w{i:04}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    texts = [" ".join(rng.choices(words, weights, k=30)) for _ in range(n)] + [None, ""]
    return spark.createDataFrame([(t,) for t in texts], "text_combined string").repartition(4)


@pytest.mark.parametrize("wanted", [1, 50, 400, 100_000])
def test_sketch_gives_the_exact_vocabulary(spark, wanted, monkeypatch):
    monkeypatch.setattr(term_sketch, "SAMPLE_TEXTS", 60)
    monkeypatch.setattr(term_sketch, "CELLS", 512)
    frame = zipf_texts(spark)
    want = term_weights.vocabulary(term_weights.term_stats(frame), wanted).collect()
    assert term_sketch.frequent_terms(frame, max_features=wanted).collect() == want


def test_the_bound_and_the_sketch_keep_rare_terms_out(spark):
    frame = zipf_texts(spark)
    stats = term_weights.term_stats(frame)
    last = term_weights.vocabulary(stats, 50).agg(F.min("tf")).first()[0]
    least = term_sketch.least_count(frame, 50)
    assert 0 < least <= last
    terms = term_weights.listed_terms(frame, "text_combined").select(F.explode("terms").alias("term"))
    cells = term_sketch.sketch(terms)
    assert cells.groupBy("row").agg(F.sum("n").alias("n")).select("n").distinct().count() == 1
    high = cells.filter((F.col("n") >= least) & (F.col("row") == 0)).count()
    assert 50 <= high < cells.filter("row = 0").count() / 10


def test_sketch_of_no_texts(spark):
    empty = spark.createDataFrame([], "text_combined string")
    assert term_sketch.frequent_terms(empty).collect() == []


def test_rows_with_equal_ids_are_one_text(spark, monkeypatch):
    """Also over the borders of batches, and with ids that are null."""
    monkeypatch.setattr(term_weights, "ENTRIES_AT_ONCE", 3)
    texts = [(1, "aa bb"), (None, "aa"), (2, "cc"), (1, "aa cc"), (None, "bb bb"), (3, "zz"), (4, None), (2, "cc dd")]
    frame = spark.createDataFrame(texts, "k long, t string").repartition(3)
    weights = spark.createDataFrame([("aa", 1.0), ("bb", 2.0), ("cc", 1.0), ("aa bb", 3.0), ("bb bb", 1.0)], "term string, idf double")
    got = {}
    for r in term_weights.tfidf_rows(frame, weights, "k", "t").collect():
        assert (r.k, r.term) not in got
        got[r.k, r.term] = r.weight
    plain = {1: {"aa": 2, "bb": 2, "aa bb": 3, "cc": 1}, None: {"aa": 1, "bb": 4, "bb bb": 1}, 2: {"cc": 2}}
    want = {}
    for k, vector in plain.items():
        length = sum(v * v for v in vector.values()) ** 0.5
        want |= {(k, t): pytest.approx(v / length) for t, v in vector.items()}
    assert got == want


def test_terms_do_not_move_row_by_row(spark):
    """Vectors move once, with a row a text; counts leave a task with a row a term of a run."""
    frame = spark.createDataFrame([(i, "aa bb " * 50) for i in range(40)], "k long, t string").repartition(2)
    weights = spark.createDataFrame([("aa", 1.0)], "term string, idf double")
    plan = term_weights.tfidf_rows(frame, weights, "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "Join" not in plan
    rows = term_weights.counted_terms(frame, "t").collect()
    assert len(rows) <= 2 * 4
    assert sum(r.tf for r in rows) == 40 * 199 and sum(r.df for r in rows) == 40 * 4
