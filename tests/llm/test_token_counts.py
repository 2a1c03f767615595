"""Token counts against the tokenizer's own, on whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lurewatch.llm import token_counts
from lurewatch.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
PARTS = [
    "a", "Word", "don't", "'LL", "'s", "'", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", " ",
    "　", "᠎", "﻿", "é", "é", "中文", "½", "٣", "12", "!", "?!", "(", "_", "\x00", "🙂", "<|", "<|endoftext|>",
]


def texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(n)]


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    found = tokenizer.encode_batch([t or "" for t in rows], add_special_tokens=False)
    return [(len((t or "").encode()), len(e.ids)) for t, e in zip(rows, found, strict=True)]


def test_equals_the_tokenizer(spark):
    rows = [*texts(3000), "", None, "word " * 60_000, "x" * 20_000, "\n" * 5000, " leading", "trailing  "]
    data = [(i, t, i, "x") for i, t in enumerate(rows)]
    frame = spark.createDataFrame(data, "doc_id long, text string, n_tokens long, pretoken string").repartition(3)
    got = {r.doc_id: r for r in token_counts.token_counts(frame, PATH).collect()}
    assert [(got[i].n_bytes, got[i].n_tokens) for i in range(len(rows))] == expected(rows)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got.values())


@pytest.mark.parametrize("frequent", [[], [b" "], [b"a", b"a", b" a", b"'", b"x" * 100]])
def test_the_table_does_not_change_counts(spark, frequent):
    rows = texts(300, 6)
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(frame, PATH, frequent=frequent).collect()}
    assert [got[i] for i in range(len(rows))] == expected(rows)


def test_special_string_across_two_texts():
    encoder = token_counts.encoder(PATH)
    pieces, first, sizes = token_counts.pieces_of(pa.array(["<|endof", "text|> a", None, "<|endoftext|>"]), encoder.special_at)
    assert pieces.to_pylist()[: first[1]] == [b"<|", b"endof"]
    assert pieces.to_pylist()[first[3] :] == [b"<|endoftext|>"]
    assert sizes.tolist() == [7, 8, 0, 13]


def test_slices_of_a_batch_count_alike():
    encoder, rows = token_counts.encoder(PATH), texts(200, 7)
    lengths = token_counts.Lengths(PATH, [], b"")
    pieces, first, _ = token_counts.pieces_of(pa.array(["skipped", *rows]).slice(1), encoder.special_at)
    before = np.concatenate([[0], np.cumsum(lengths.of(pieces))])
    assert (before[first[1:]] - before[first[:-1]]).tolist() == [n for _, n in expected(rows)]


def test_frequent_pretokens_are_those_of_all_texts(spark):
    rows = [(i, "common thing" if i % 3 else f"rare{i} thing") for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = token_counts.frequent_pretokens(frame, PATH, entries=3)
    assert found == [b" thing", b"common", b"rare"]


def test_summary_keeps_what_is_frequent(monkeypatch):
    monkeypatch.setattr(token_counts, "SHARE", 20)
    monkeypatch.setattr(token_counts, "SUMMARY", 100)
    rng, held, exact = random.Random(8), token_counts.Summary(), {}
    for turn in range(20_000):
        key = b"hot" if turn % 15 == 0 else b"%d" % rng.randrange(5000)
        held.add(key, 1)
        exact[key] = exact.get(key, 0) + 1
        held.prune()
    found = dict(held.frequent())
    assert b"hot" in found and exact[b"hot"] - 200 <= found[b"hot"] <= exact[b"hot"]
    assert len(found) <= 25


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(empty, PATH).collect() == []
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(twice, PATH).collect())
    assert got == [(0, 2), (0, 2), (1, 0)]


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError):
        token_counts.Encoder(tokenizer_path("word_bpe_49k.json"))
