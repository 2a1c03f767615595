"""The corpus pipeline: every stage against a brute-force version of its decision."""

import pytest

import corpus_pipeline
from lurewatch.session import stage
from test_text_operators import expected_components, expected_hits, expected_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"


@pytest.fixture()
def tables(spark, tmp_path):
    words = "the of and tion ing house river stone light garden water".split()
    texts = [" ".join(words[(i * 7 + j * (i % 5 + 1)) % 11] + str((i * j) % 13) for j in range(40)) for i in range(30)]
    texts += [texts[0], texts[1] + " more", texts[2].upper(), f"before {PASSAGE} behind", PASSAGE.upper()]
    texts += ["my token = abcdefgh12345678 and deadbeefdeadbeef00 end of it", None, "", "123 !!", "one"]
    rows = [(i, t, "en" if i % 9 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_stages(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [r[:2] for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    results = {}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, folder), f"test-{name}")
        results[name] = docs
    assert all(results[n].columns == COLUMNS for n in list(results)[:-1])

    def rows_of(name):
        return sorted((r.doc_id, r.text) for r in results[name].collect())

    assert rows_of("language") == sorted(kept)
    assert results["language"].filter("lang is null").count() == 0
    component = expected_components(kept)
    kept = [(i, t) for i, t in kept if component[i][1] == i]
    assert len(component) - len(kept) >= 3 and rows_of("near_duplicates") == sorted(kept)
    hit = {d for d, *_, contaminated in expected_hits(kept, [(1, PASSAGE)]) if contaminated}
    kept = [(i, t) for i, t in kept if i not in hit]
    assert hit and rows_of("decontamination") == sorted(kept)
    masked = []
    for i, text in kept:
        out, at = "", 0
        for start, _, end in expected_spans(text):
            if start > at or at == 0:
                out += text[at:start] + "[secret]"
            at = max(at, end)
        masked.append((i, out + text[at:]))
    assert rows_of("secrets") == sorted(masked) and masked != kept
    assert all(r.n_chars == len(r.text) for r in results["secrets"].collect())
    pieces = results["packing"].collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in masked}
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 4096


def test_run_gives_the_last_stage(spark, tables):
    folder, rows = tables
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < out.count() <= len(rows)
