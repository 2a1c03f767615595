import os
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lurewatch.operators import isolation, metrics, text_classifier
from lurewatch.operators.sequence_scorer import with_sequence_proba
from lurewatch.operators.term_weights import fit_tfidf, idf_weights, term_stats, vocabulary
from lurewatch.plans.training import run_training, train_outlier_model

SPAM = ["win money now", "verify account now", "claim prize money", "account locked verify"]
HAM = ["meeting at noon", "project notes attached", "lunch at noon", "notes from meeting"]


def corpus(spark, n=60):
    rows = []
    for i in range(n):
        label = i % 2
        text = (SPAM if label else HAM)[i // 2 % 4] + f" extra{i % 5}"
        rows.append((i, text, label, ("train", "train", "val", "test")[i // 2 % 4]))
    return spark.createDataFrame(rows, "id int, text_combined string, label int, split string")


def test_term_stats_and_weights(spark):
    df = spark.createDataFrame([("A b cc cc dd",), ("cc dd",), ("CC x",), (None,)], "text_combined string")
    stats = {r.term: (r.tf, r.df) for r in term_stats(df, min_df=1).collect()}
    assert stats == {"cc": (4, 3), "dd": (2, 2), "cc cc": (1, 1), "cc dd": (2, 2)}
    assert {r.term for r in term_stats(df, min_df=2).collect()} == {"cc", "dd", "cc dd"}
    top = [r.term for r in vocabulary(term_stats(df, min_df=1), 2).collect()]
    assert sorted(top) == ["cc", "cc dd"]  # the tie goes to the smaller term
    idf = idf_weights(term_stats(df, min_df=3), 4).first().idf
    assert idf == pytest.approx(math.log(5 / 4) + 1)


def test_tfidf_vectors(spark):
    df = spark.createDataFrame([("aa bb",), ("aa cc",), ("aa bb bb",)], "t string")
    model = fit_tfidf(df, "t", "v", min_df=1)
    rows = [r[0] for r in model.transform(df).select(vector_to_array("v")).collect()]
    terms = sorted(["aa", "bb", "cc", "aa bb", "aa cc", "bb bb"])
    n, df_of = 3, {"aa": 3, "bb": 2, "cc": 1, "aa bb": 2, "aa cc": 1, "bb bb": 1}
    weights = {t: math.log((1 + n) / (1 + df_of[t])) + 1 for t in terms}
    raw = [weights[t] * {"aa": 1, "bb": 2, "aa bb": 1, "bb bb": 1}.get(t, 0) for t in terms]
    assert rows[2] == pytest.approx([x / math.sqrt(sum(y * y for y in raw)) for x in raw])
    assert model.transform(df).columns == ["t", "v"]


@pytest.mark.parametrize("model", ["logreg", "linear_svm"])
def test_training_run(spark, tmp_path, model):
    classifier, measured = run_training(
        corpus(spark), model, path=str(tmp_path), max_iter=15, min_df=1
    )
    rows = {r.split: r for r in measured.collect()}
    assert set(rows) == {"train", "val", "test"}
    assert rows["test"].f1 > 0.95 and rows["train"]["rows"] == 32 and rows["test"].num_features > 10
    assert (rows["test"].roc_auc is None) == (model == "linear_svm")
    loaded = text_classifier.load_classifier(spark, f"{tmp_path}/{model}")
    one = classifier.score(corpus(spark)).orderBy("id").select("supervised_proba").collect()
    two = loaded.score(corpus(spark)).orderBy("id").select("supervised_proba").collect()
    assert one == two and all(0 <= r[0] <= 1 for r in one)


def test_training_validation(spark):
    df = spark.createDataFrame([("x", "1"), ("y", "no"), ("z", None)], "text_combined string, label string")
    with pytest.raises(ValueError, match="2 non-numeric"):
        text_classifier.validate_training(df)
    with pytest.raises(KeyError, match="Target"):
        text_classifier.validate_training(df.drop("label"))
    with pytest.raises(KeyError, match="Text"):
        text_classifier.validate_training(df.drop("text_combined"))
    with pytest.raises(FileNotFoundError, match="test"):
        run_training(corpus(spark).filter("split <> 'test'"))
    with pytest.raises(ValueError):
        text_classifier.train_classifier(corpus(spark), "tree")


def test_text_column_falls_back(spark):
    classifier = text_classifier.train_classifier(corpus(spark), max_iter=10, min_df=1)
    other = text_classifier.TextClassifier(classifier.vectors, classifier.model, "logreg", "own")
    df = corpus(spark).withColumn("own", F.lit(""))
    assert (
        other.score(df).orderBy("id").select("supervised_proba").collect()
        == classifier.score(corpus(spark)).orderBy("id").select("supervised_proba").collect()
    )


def test_binary_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "label int, prediction int")
    row = metrics.binary_metrics(df).first()
    assert tuple(row) == (5, 0.6, 0.5, 0.5, 0.5)
    none = metrics.binary_metrics(df.filter("label = 0 and prediction = 0")).first()
    assert (none.precision, none.recall, none.f1, none.accuracy) == (0.0, 0.0, 0.0, 1.0)


@pytest.mark.parametrize("distinct", [3, 50, 5000])
def test_roc_auc_matches_pairs(spark, distinct):
    rng = random.Random(distinct)
    rows = [(rng.randrange(distinct) / distinct, int(rng.random() < 0.3)) for _ in range(2000)]
    rows += [(0.5, i % 2) for i in range(1000)]  # one score holds a third of the rows
    pos = np.array([s for s, l in rows if l]); neg = np.array([s for s, l in rows if not l])  # noqa: E702,E741
    expected = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "score double, label int")
    assert metrics.roc_auc(df).first()[0] == pytest.approx(expected)


def test_roc_auc_of_one_class(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert math.isnan(metrics.roc_auc(df).first()[0])
    assert math.isnan(metrics.roc_auc(df.limit(0)).first()[0])


def outliers(spark):
    rng = np.random.default_rng(1)
    inner = rng.normal(size=(600, 3))
    outer = rng.normal(size=(12, 3)) * 0.5 + 9
    rows = [(i, *map(float, v), int(i >= 600)) for i, v in enumerate(np.vstack([inner, outer]))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, label int")


def test_isolation_forest(spark):
    df = outliers(spark)
    forest = isolation.train_isolation_forest(df.filter("label = 0"), ["a", "b", "c"], "id", trees=60)
    assert forest.nodes["tree"].nunique() == 60 and forest.sample_rows == 256
    leaves = forest.nodes[forest.nodes["feature"] < 0]
    assert leaves["path"].max() <= 8 + isolation.average_path(256)
    scored = forest.score(forest.raw_score(df))
    rows = scored.collect()
    assert all(0 < r.isolation_raw <= 1 and 0.5 < r.isolation_score <= 0.7311 for r in rows)
    assert metrics.roc_auc(scored, score_col="isolation_raw").first()[0] > 0.99
    again = isolation.train_isolation_forest(df.filter("label = 0"), ["a", "b", "c"], "id", trees=60)
    assert again.nodes.equals(forest.nodes) or sorted(map(tuple, again.nodes.values)) == sorted(
        map(tuple, forest.nodes.values)
    )


def test_contamination_sets_the_threshold(spark):
    df = outliers(spark)
    forest = isolation.train_isolation_forest(df, ["a", "b", "c"], "id", trees=40, contamination=0.05)
    flags = forest.raw_score(df).select(isolation.outlier_flag(F.col("isolation_raw"), forest.threshold).alias("o"))
    assert abs(flags.agg(F.sum("o")).first()[0] - 0.05 * 612) <= 1


@pytest.mark.parametrize("n_rows", [100, 5000, 10**9])
def test_samples_are_bounded_and_distinct(spark, n_rows):
    rows = min(n_rows, 5000)
    df = spark.range(rows).select(F.col("id"), F.array(F.col("id").cast("double")).alias("values"))
    samples = isolation.tree_samples(df, "id", n_rows, trees=5, sample_rows=16, seed=1)
    per_tree = {r.tree: (r.n, r.d) for r in samples.groupBy("tree").agg(
        F.count("*").alias("n"), F.countDistinct("values").alias("d")).collect()}
    assert all(n == d for n, d in per_tree.values())
    if n_rows <= 5000:
        assert len(per_tree) == 5 and all(16 <= n < 200 for n, _ in per_tree.values())


@pytest.mark.parametrize("q", [0.0, 0.25, 0.9, 0.999, 1.0])
def test_exact_quantile(spark, q):
    rng = random.Random(7)
    values = [rng.random() ** 4 for _ in range(800)] + [0.125] * 400
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert isolation.exact_quantile(df, "v", q, grid=16) == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_average_path():
    assert isolation.average_path(1) == 0 and isolation.average_path(2) == 1
    assert isolation.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_outlier_training_run(spark):
    data = corpus(spark).withColumns({"body": F.col("text_combined"), "from_address": F.lit("a@b.c")})
    forest, measured = train_outlier_model(
        data, data.filter("label = 0 and split = 'train'"), "id", trees=20
    )
    rows = {r.split: r for r in measured.collect()}
    assert set(rows) == {"train", "val", "test"} and 0 <= rows["val"].roc_auc <= 1
    assert len(forest.feature_cols) == 52


def test_sequence_scorer_skips_blocked_rows(spark):
    def factory():
        def infer(texts):
            assert all(t != "blocked" for t in texts)
            return np.array([[0.0, 2.0 * len(t)] for t in texts])
        return infer

    df = spark.createDataFrame([("a", False), ("blocked", True), (None, False)], "text_combined string, hard boolean")
    rows = with_sequence_proba(df, factory, skip=F.col("hard")).collect()
    assert rows[0].transformer_proba == pytest.approx(1 / (1 + math.exp(-1)))
    assert rows[1].transformer_proba is None and rows[2].transformer_proba == 0.5


@pytest.mark.parametrize("n_rows,total", [(1_000, None), (1_024, None), (1_100, None), (20_000, 10_000_000)])
def test_forest_samples_by_one_method(spark, n_rows, total):
    """Around the old limits, and for a table that is a part of a larger one."""
    from lurewatch.operators.isolation import tree_samples

    rows = spark.range(n_rows).selectExpr("id", "array(double(id)) as values")
    samples = tree_samples(rows, "id", total or n_rows, 8, 64, 42).groupBy("tree").count().collect()
    counts = [r["count"] for r in samples]
    if total is None:
        assert len(counts) == 8 and min(counts) >= 64
    else:  # about the share of the part
        assert sum(counts) <= 8 * 4 * 64 * n_rows / total * 20


def test_shared_folder_is_asked_for_on_clusters():
    from lurewatch import session

    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        pass

    cluster = Session()
    cluster.conf = Conf(**{"spark.master": "spark://host:7077"})
    with pytest.raises(RuntimeError):
        session.shared_dir(cluster)
    cluster.conf = Conf(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x/"})
    assert session.shared_dir(cluster) == "hdfs:///x"


def test_staged_tables_can_be_dropped(spark):
    from lurewatch import session

    path = session.stage(spark.range(3), "x").inputFiles()[0]
    assert session.drop_staged(spark) >= 1
    assert not os.path.exists(path.removeprefix("file://"))


def test_number_spellings(spark):
    from lurewatch.functions.labels import number_of

    rows = spark.createDataFrame([("1d",), ("0f",), (" 1.0 ",), (".5",), ("1e2",), ("x",), (None,)], "v string")
    from pyspark.sql import functions as F

    assert [r.n for r in rows.select(number_of(F.col("v")).alias("n")).collect()] == [None, None, 1.0, 0.5, 100.0, None, None]
    assert spark.range(2).select(number_of(F.col("id")).alias("n")).collect()[1].n == 1.0
