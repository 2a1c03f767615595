import hashlib

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import splitting
from lurewatch.plans.prepare import benign_only, preprocess_and_split


def texts(spark, zeros, ones):
    rows = [(f"m{i}", 0 if i < zeros else 1) for i in range(zeros + ones)]
    return spark.createDataFrame(rows, "text_combined string, label int")


def test_sizes_and_ratio(spark):
    data = splitting.stratified_split(texts(spark, 80, 20), 0.1, 0.1, seed=1)
    got = {(r.split, r.label): r["emails"] for r in splitting.split_counts(data).collect()}
    assert got == {
        ("train", 0): 64, ("train", 1): 16, ("val", 0): 8, ("val", 1): 2, ("test", 0): 8, ("test", 1): 2,
    }


def test_seed_changes_members_and_is_repeatable(spark):
    df = texts(spark, 80, 20)

    def members(seed):
        data = splitting.stratified_split(df, 0.1, 0.1, seed=seed)
        return {r.text_combined for r in data.filter("split = 'test'").collect()}

    assert members(1) == members(1) != members(2)


@pytest.mark.parametrize("val,test", [(0.0, 0.1), (0.1, 0.0), (0.6, 0.5)])
def test_invalid_sizes(spark, val, test):
    with pytest.raises(ValueError):
        splitting.stratified_split(texts(spark, 5, 5), val, test)


def test_small_class(spark):
    with pytest.raises(ValueError, match="Stratified split failed"):
        splitting.stratified_split(texts(spark, 10, 1))


@pytest.mark.parametrize("step", [1, 2, 3])
def test_cut_search_matches_a_full_sort(spark, monkeypatch, step):
    monkeypatch.setattr(splitting, "_PREFIX_STEP", step)
    data = splitting.stratified_split(texts(spark, 300, 200), 0.15, 0.1, seed=3).collect()
    for label, n in ((0, 300), (1, 200)):
        ranked = sorted(
            (r.text_combined for r in data if r.label == label),
            key=lambda t: hashlib.md5(f"3|{t}".encode()).hexdigest(),
        )
        val_n, test_n = splitting.split_sizes(n, 0.15, 0.1)
        expected = {t: "test" for t in ranked[:test_n]}
        expected |= {t: "val" for t in ranked[test_n:test_n + val_n]}
        assert all(
            r.split == expected.get(r.text_combined, "train") for r in data if r.label == label
        )


def test_assignment_needs_no_exchange(spark):
    data = splitting.stratified_split(texts(spark, 80, 20))
    assert "Exchange" not in data._jdf.queryExecution().executedPlan().toString()


def test_copies_stay_together(spark):
    hot = texts(spark, 60, 60).union(spark.range(60).select(F.lit("copy"), F.lit(1)))
    data = splitting.stratified_split(hot, 0.2, 0.2)
    assert data.filter("text_combined = 'copy'").select("split").distinct().count() == 1


def dirty(spark):
    rows = [
        ("kaggle", "verify now", 1), ("kaggle", "verify   now", 1), ("kaggle", "chase alert", 1),
        ("kaggle", "apple update", 1), ("enron", "meeting", 0), ("enron", "timeline", 0),
        ("enron", "reset", 0), ("enron", "invoice", 0), ("nazario", "locked", 1),
        ("nazario", "order", 0), ("nazario", "document", 0), ("nazario", "confirm", 1),
        ("kaggle", "verify now", 1), ("enron", "lunch", 0), ("nazario", None, None),
    ]
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "n int, source string, text_combined string, label int"
    )
    return df


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_preprocess_and_split(spark, tmp_path, file_format):
    out = str(tmp_path / "splits")
    prepared = preprocess_and_split(
        dirty(spark), ["n"], 0.2, 0.2, output=out, file_format=file_format
    )
    rows = prepared.data.collect()
    assert len(rows) == len({r.text_combined for r in rows}) == 12
    assert {p.name for p in (tmp_path / "splits").iterdir() if p.is_dir()} == {
        "split=train", "split=val", "split=test",
    }
    assert prepared.before.first().total == 15
    assert (prepared.after.first().total, prepared.after.first().removed) == (12, 2)
    kept = benign_only(prepared.data).collect()
    assert kept and all(r.label == 0 for r in kept)
    assert len(benign_only(prepared.data, split=None).collect()) == 7
