"""Quality scores against plain compression of every text, and the bounds of the sample."""

import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lurewatch.llm import quality


def words(rng, kind, n):
    good, bad = ["theory", "evidence", "method", "result", "careful"], ["CLICK", "free!!!", "buy", "now", "$$$"]
    return " ".join(rng.choice(good if kind else bad) + str(rng.randrange(30)) for _ in range(n))


def tables(spark, rows, labels):
    return (
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int").repartition(3),
    )


def test_scores_equal_plain_compression(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, i % 2, rng.randint(20, 200))) for i in range(120)]
    model = quality.train([(t, i % 2) for i, t in rows])
    odd = [None, "", " ", "x", "theory " * 5000, words(rng, 0, 3000), "é中🙂" * 2000, "CLICK"]
    frame, _ = tables(spark, list(enumerate(odd)) + [(None, "buy"), (3, "x")], [(1, 1)])
    options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}

    def size(data, dictionary):
        held = zstandard.ZstdCompressionDict(dictionary)
        held.precompute_compress(level=quality.LEVEL)
        return sum(
            len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=held, **options).compress(data[at : at + quality.BLOCK_BYTES]))
            for at in range(0, len(data), quality.BLOCK_BYTES)
        )

    def expected(text):
        data = (text or "").encode()
        good, bad = size(data, model.good), size(data, model.bad)
        raw = (bad - good) / (bad + good) if data else 0.0
        return raw, 1 / (1 + np.exp(-(model.slope * raw + model.intercept)))

    got = sorted((r.doc_id is None, r.doc_id or 0, r.raw, r.score) for r in model.score(frame).collect())
    want = sorted((i is None, i or 0, *expected(t)) for i, t in [*enumerate(odd), (None, "buy"), (3, "x")])
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2:] for g in got] == [pytest.approx(w[2:]) for w in want]


def test_sample_is_bounded_by_texts(spark):
    rng = random.Random(2)
    rows = [(7, f"{words(rng, 1, 5)} {i}") for i in range(3000)] + [(i, words(rng, i % 2, 9)) for i in range(100, 400)]
    labels = [(7, 1)] * 2000 + [(i, i % 2) for i in range(100, 400)] + [(7, 0), (7, None), (None, 1), (8, 5)]
    found = quality.sample_labelled(*tables(spark, rows, labels), F.lit(False), examples=30)
    assert all(sum(label == kind for _, label in found) <= 60 for kind in (0, 1))
    whole = quality.sample_labelled(*tables(spark, rows, labels), F.lit(False), examples=1000)
    assert len(whole) == 302 and sum(text.startswith(tuple(t for i, t in rows if i == 7)) for text, _ in whole) == 2
    again = quality.sample_labelled(*tables(spark, rows[::-1], labels), F.lit(False), examples=1000)
    assert whole == again


def test_sample_takes_the_smallest_hashes(spark):
    rows = [(i, f"text {i}") for i in range(500)]
    docs, labels = tables(spark, rows, [(i, int(i < 480)) for i in range(500)])
    draws = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    unsigned = lambda i: draws[i] % (1 << 64)
    found = quality.sample_labelled(docs, labels, F.lit(False), examples=20)
    kept = {int(t.split()[1]) for t, label in found if label}
    assert len(kept) == 40 and len(found) == 60
    assert max(unsigned(i) >> (64 - quality.BUCKET_BITS) for i in kept) <= sorted(unsigned(i) >> (64 - quality.BUCKET_BITS) for i in range(480))[39]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    with pytest.raises(ValueError):
        quality.quality_scores(empty, labels)
    rng = random.Random(3)
    model = quality.train([(words(rng, i % 2, 30), i % 2) for i in range(40)])
    assert model.score(empty).collect() == []
