"""Tasks of operators on one very common line or payload; what the language stage rejects."""

import random

import pytest
from pyspark.sql import functions as F

from lurewatch.llm import language, line_dedup, warc

SKEW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "12",
}


@pytest.fixture
def skewed(spark):
    before = {key: spark.conf.get(key, None) for key in SKEW}
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_hot_line_is_dealt_to_several_tasks(skewed):
    docs = skewed.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot line").otherwise(F.concat(F.lit("line "), "id")).alias("text"))
    found = line_dedup.repeated_units(docs.repartition(12), least_words=1).withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in found.groupBy("task").count().collect()]
    assert sum(tasks) == 19_999 and max(tasks) < 19_999 / 2
    assert found.filter("kept_doc_id <> 0").count() == 0


def test_a_hot_payload_is_dealt_to_several_tasks(skewed):
    html = F.when(F.col("id") % 3 == 0, "same page").otherwise(F.concat(F.lit("page "), "id"))
    pages = skewed.range(30_000).select(F.col("id"), F.lit("u").alias("url"), F.encode(html, "utf-8").alias("payload"))
    found = warc.with_originals(pages.repartition(12)).withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in found.groupBy("task").count().collect()]
    assert sum(tasks) == 30_000 and max(tasks) < 2 * 30_000 / 12
    assert found.filter("refers_to is not null").count() == 9_999 == found.filter("refers_to = 0").count()


def test_equal_ids_and_payloads(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (2, "b"), (3, "b"), (None, "a"), (4, None), (5, "")]
    pages = spark.createDataFrame([(i, f"u{i}", h, "x", 1) for i, h in rows], "page_id long, url string, html string, digest string, first long")
    found = [(r.page_id, r.record_type, r.refers_to) for r in warc.archived_pages(pages).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(1, "response", None), (1, "response", None), (2, "response", None), (2, "response", None), (2, "revisit", 1)]
    want += [(3, "revisit", 2), (4, "response", None), (5, "revisit", 4), (None, "response", None)]
    assert sorted(found, key=key) == sorted(want, key=key)


def test_reading_back_goes_by_payload_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 100_000)
    monkeypatch.setattr(warc, "FRAME_BYTES", 2_000)
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 300).alias("html"))
    assert warc.archived_pages(pages).rdd.getNumPartitions() >= 8


SYLLABLES = {
    "aa": ["tion", "the", "ing", "er", "th", "an", "re"], "bb": ["sch", "ung", "ich", "der", "ü", "ein", "au"],
}


def text(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. "
CYRILLIC = "Все люди рождаются свободными и равными в своем достоинстве и правах. "


def test_language_stage_rejects_what_is_in_no_language(spark):
    rng = random.Random(6)
    clean = [(i, text(rng, lang, rng.choice([3, 8, 30, 200])), lang) for i, lang in enumerate(["aa", "bb"] * 300)]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(n)) for n in (60, 200, 1000)] * 3
    other = [POLISH, POLISH * 5, CYRILLIC, CYRILLIC * 9, "привет", "中文" * 40, "123 !", "", None, *noise]
    rows = clean + [(10_000 + i, t, None) for i, t in enumerate(other)] + [(20_000, text(rng, "bb", 40), None)]
    frame = spark.createDataFrame([(*r, "r", 2) for r in rows], "doc_id long, text string, lang string, row string, n_symbols long")
    kept = {r.doc_id: r.lang for r in language.in_known_language(frame.repartition(3)).collect()}
    assert not {10_000 + i for i in range(len(other))} & set(kept)
    assert kept[20_000] == "bb"
    assert sum(i in kept for i, _, _ in clean) >= 0.995 * len(clean)
    assert all(kept[i] == lang for i, _, lang in clean if i in kept)


def test_shortest_phrases_grow_with_the_text():
    rng = random.Random(7)
    model = language.model_of({lang: [text(rng, lang, 60) for _ in range(40)] for lang in SYLLABLES})
    floors = language.shortest_phrases(model, {lang: [text(rng, lang, 60) for _ in range(40)] for lang in SYLLABLES})
    assert [w for w, _ in floors] == list(language.WINDOWS)
    assert floors == sorted(floors, key=lambda f: f[1]) and floors[-1][1] > 1.5
    assert {least for _, least in language.shortest_phrases(model, {})} == {0.0}
