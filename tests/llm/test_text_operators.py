"""Decontamination, near duplicates, line hashing and secrets: brute force and edge cases."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import decontamination, line_dedup, near_duplicates, secrets
from lurewatch.llm.queries import QUERIES

CLASH = "doc_id long, text string, node long, n long, row string, shingle string, spans string, w string, t string"


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def with_clashes(spark, rows):
    """Columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, 2, "r", "s", "p", "w", "t") for i, t in rows], CLASH)


# --- decontamination ------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def expected_hits(docs, items):
    patterns = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            patterns.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in patterns}:
            for i in range(len(w) - n + 1):
                owners = patterns.get(tuple(w[i : i + n]))
                if owners is not None:
                    hit.update(range(i, i + n))
                    found |= {str(o) for o in owners if o is not None}
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("shard", [200_000, 7])
def test_passages_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(decontamination, "SHARD_WINDOWS", shard)
    rng = random.Random(3)
    pick = lambda n: " ".join(rng.choice(["a", "bé", "C", "d-e", "中文", "7"]) for _ in range(n))
    items = [(i, pick(rng.randint(0, 14))) for i in range(12)] + [(3, "a C a"), (None, "bé bé C"), (20, None), (21, " .!"), (22, "a C a")]
    docs = [(i, pick(rng.randint(0, 60))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, items[4][1]), (102, items[4][1]), (103, "x " * 3000 + items[5][1] + " y" * 3000)]
    got = decontamination.contamination(table(spark, docs), table(spark, items, "item_id long, text string")).collect()
    key = lambda r: (r[0], r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(expected_hits(docs, items), key=key)


def test_decontamination_edges(spark):
    items = table(spark, [(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    passage = "x ONE, two three four five six seven eight nine ten y"
    docs = with_clashes(spark, [(1, passage), (1, passage), (2, "clean text"), (3, None), (None, "")])
    kept = decontamination.clean_of_passages(docs, items)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(2, "clean text"), (3, None), (None, "")}
    none = table(spark, [], "item_id long, text string")
    assert decontamination.contamination(docs.select("doc_id", "text"), none).filter("contaminated").count() == 0
    assert decontamination.contamination(table(spark, []), items).count() == 0


def test_search_of_many_lanes():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 20_000).astype(np.int32)
    patterns = np.unique(rng.integers(1, 4, (40, 6)).astype(np.int32), axis=0)
    ends, found = decontamination.PatternSet(patterns).search(text)
    views = np.lib.stride_tricks.sliding_window_view(text, 6)
    expected = {(i + 5, j) for j, p in enumerate(patterns) for i in np.flatnonzero((views == p).all(1)).tolist()}
    assert set(zip(ends.tolist(), found.tolist(), strict=True)) == expected


# --- near duplicates ------------------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected_components(docs):
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: (len(x), find(i)) for i, x in sets}


def edited(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(["the", "of", "new", str(rng.random())])
    return " ".join(w)


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "of", "the", "in", "on", "to", "x", "y"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(n))
    bases, passage = [text(rng.randint(20, 150)) for _ in range(8)], text(40)
    docs = [edited(rng, b, rng.randint(0, len(b.split()) // 12)) for b in bases for _ in range(25)]
    docs += [text(rng.randint(1, 12)) for _ in range(60)] + [passage + " " + text(60) for _ in range(30)]
    docs += [b[: -len(b) // rng.randint(6, 14)] for b in bases] + [bases[0]] * 5 + [bases[1].upper()]
    docs += [None, "", "  \n ", "one", "one", "one two", "1 2 3 4 5", "1  2\t3 4 5 ", "1 2 3 4", "long " * 30_000]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    got = near_duplicates.near_duplicates(table(spark, rows)).collect()
    expected = expected_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert len(got) == len(rows)
    assert len({c for _, c in expected.values()}) < len(rows) - 40


def test_large_list_of_near_copies(spark):
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(140))
    rows = list(enumerate([edited(rng, base, rng.choice([0, 1, 2, 3, 5, 8, 13])) for _ in range(260)]))
    got = near_duplicates.near_duplicates(table(spark, rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == expected_components(rows)


def test_near_duplicate_edges(spark):
    text = "one two three four five six seven"
    docs = with_clashes(spark, [(5, text), (5, text), (3, text.upper()), (None, text), (9, None)])
    rows = sorted(map(tuple, near_duplicates.near_duplicates(docs).collect()), key=str)
    assert rows == [(3, 3, 3), (5, 3, 3), (5, 3, 3), (9, 0, 9), (None, 3, None)]
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None"]
    assert near_duplicates.near_duplicates(table(spark, [])).count() == 0


def test_neighbour_pairs_hold_for_linked_sets():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(4, 300))
        x = np.unique(rng.integers(-(2**62), 2**62, n))
        drop, add = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 5 + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(-(2**62), 2**62, add)]))
        met = len(np.intersect1d(x, y))
        if 100 * met >= 80 * (len(x) + len(y) - met):
            shared = len(np.intersect1d(near_duplicates.neighbour_pairs(x), near_duplicates.neighbour_pairs(y)))
            for size in (len(x), len(y)):
                assert shared >= near_duplicates._wanted(math.ceil(0.8 * size))


# --- line hashing ---------------------------------------------------------------------------


def expected_repeats(docs):
    units = []
    for doc, text in docs:
        at = 0
        for line in (text or "").split("\n"):
            w = line.lower().split()
            units.append((" ".join(w), len(w), doc, at, at + len(line)))
            ends = [m.span() for m in re.finditer(r"(?<=[.!?])\s+", line)]
            if len(w) > 50 and ends:
                begin = 0
                for stop, after in [*ends, (len(line), len(line))]:
                    part = line[begin:stop].lower().split()
                    units.append((" ".join(part), len(part), doc, at + begin, at + stop))
                    begin = after
            at += len(line) + 1
    first = {}
    for key, n, doc, start, _ in units:
        if n >= 5 and doc is not None:
            first[key] = min(first.get(key, (doc, start)), (doc, start))
    return {(d, s, e, *first[k]) for k, n, d, s, e in units if n >= 5 and d is not None and (d, s) > first[k]}


def test_repeated_lines(spark):
    passage = ". ".join(f"Sentence number {i} of a long passage here" for i in range(9)) + "."
    docs = [
        (4, f"Own line of document four.\n{passage}\nThe  End of this one"), (2, f"{passage}\nthe end of THIS one"),
        (7, f"Before it. {passage} Behind it all stands this."), (1, "short one\nshort one"), (3, None), (5, ""),
        (6, "again and again and again\nother\nAgain and  again and again"), (6, "again and again and again\nother\nAgain and  again and again"),
        (8, "é ü ö ä ß\n\né ü ö ä ß"), (9, "word " * 40_000), (None, passage),
    ]
    frame = table(spark, docs)
    got = {tuple(r) for r in line_dedup.repeated_units(frame).select("doc_id", "start", "end", "kept_doc_id", "kept_start").collect()}
    assert got == expected_repeats(docs)
    assert {7, 4, 6, 8} == {d for d, *_ in got}
    clean = {(r.doc_id, r.text) for r in line_dedup.without_repeats(frame).collect()}
    assert (4, "Own line of document four.\n\n") in clean and (8, "é ü ö ä ß\n\n") in clean and (3, None) in clean
    assert (2, docs[1][1]) in clean
    assert line_dedup.repeated_units(table(spark, [])).count() == 0


def test_repeated_paragraphs_and_clashing_columns(spark):
    docs = with_clashes(spark, [(1, "one two three\nfour five\n\nother"), (2, "x\n \none  two three four five")])
    row = line_dedup.repeated_units(docs, unit="paragraph").collect()
    assert [tuple(r)[:3] for r in row] == [(2, 4, 28)]
    assert line_dedup.without_repeats(docs).columns == docs.columns


def test_short_lines_are_units_of_the_registered_query(spark, tmp_path):
    docs = [(1, "Home\nAll rights reserved\n\n \nown text"), (2, "home\n\nother text\nall  rights RESERVED"), (3, "x. Home")]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_line_hashing"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(2, 0, 4, "line", 1, 0), (2, 17, 37, "line", 1, 5)]
    clean = {r.doc_id: r.text for r in line_dedup.without_repeats(table(spark, docs), least_words=1).collect()}
    assert clean == {1: docs[0][1], 2: "\n\nother text\n", 3: "x. Home"}


def test_sentences_of_short_lines_are_compared(spark):
    kept = "One sentence that both lines have. "
    docs = [(1, kept + "Then an end of its own."), (2, kept + "Then another end of its own.")]
    got = line_dedup.repeated_units(table(spark, docs)).collect()
    assert [tuple(r) for r in got] == [(2, 0, len(kept) - 1, "sentence", 1, 0)]


# --- secrets --------------------------------------------------------------------------------

ASSIGN = re.compile(
    "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    + r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def expected_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(spans)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(4)
    parts = ["token", "TOKEN: ", "api_key=", "ApiKey", '" : "', "= '", "secret", "passwd:", "AKIA", "ABCD0123", "deadbeef", "0a1b2c3d4e5f6071",
             " ", "\n", "é", "😀", "/x.y-z=", "password", "longvalue123", "Z9", "ſ"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    docs += [(900, None), (901, ""), (902, "token=" + "a1" * 50_000), (903, "x 0123456789abcdef " * 300), (903, "same id")]
    got = secrets.secret_spans(table(spark, docs)).collect()
    written = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    expected = sorted(
        (i, sum(k == 0 for _, k, _ in s), sum(k == 1 for _, k, _ in s), sum(k == 2 for _, k, _ in s), hashlib.sha256(written(s).encode()).hexdigest())
        for i, t in docs for s in [expected_spans(t or "")]
    )
    assert sorted(tuple(r)[:5] for r in got) == expected
    for row in got:
        base = ",".join(x for x in row.spans.split(",") if x and not x.startswith("random"))
        assert hashlib.sha256(base.encode()).hexdigest() == row.base_sha256
    assert secrets.secret_spans(table(spark, [])).count() == 0


def p_value(symbols, k):
    """The battery in plain Python."""
    n = len(symbols)
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    # Equal pairs: their mean, variance and third moment under uniform symbols.
    equal = sum(a == b for a, b in itertools.combinations(symbols, 2))
    pairs, triples = math.comb(n, 2), math.comb(n, 3)
    deviation = math.sqrt(pairs * (k - 1)) / k
    third = pairs * (k - 1) * (k - 2) / k**3 + 6 * triples * (k - 1) / k**3
    shape = (2 * deviation**3 / third) ** 2
    gamma = max(0.0, 1 + (equal - 0.5 - pairs / k) / deviation / math.sqrt(shape))
    uniform = tail((gamma ** (1 / 3) - (1 - 1 / (9 * shape))) * 3 * math.sqrt(shape))
    x = [s - (k - 1) / 2 for s in symbols]
    high = sum(v > 0 for v in x)
    runs = 1 + sum((a > 0) != (b > 0) for a, b in zip(x, x[1:], strict=False))
    expected = 2 * high * (n - high) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = (runs - expected) / math.sqrt(variance) if variance > 0 else math.sqrt(n)
    centred = [v - sum(x) / n for v in x]
    power = sum(v * v for v in centred)
    lag = sum(a * b for a, b in zip(centred, centred[1:], strict=False))
    z_serial = (lag / power + 1 / n) * n * math.sqrt(n - 1) / (n - 2) if power > 1e-9 else math.sqrt(n)
    # The covariance, from the uniform symbols themselves.
    middle = [abs(s - (k - 1) / 2) for s in range(k)]
    shared = (sum(middle) / k) ** 2 / (sum(m * m for m in middle) / k)
    scores = np.array([z_runs, z_serial])
    order = min(scores @ np.linalg.inv([[1, -shared], [-shared, 1]]) @ scores / 2, 70)
    h = order - math.log(min(1, max(1e-30, uniform)))
    return math.exp(-h) * (1 + h)


@pytest.mark.parametrize("k", [10, 16, 36, 62, 64])
def test_random_tokens_have_the_p_values_they_should(spark, k):
    rng = np.random.default_rng(k)
    rows = [(rng.integers(0, k, n).tolist(), k) for n in (20, 24, 40, 96) for _ in range(4000)]
    p = secrets.randomness(F.col("s"), F.col("k"))
    frame = spark.createDataFrame(rows, "s array<int>, k int").select(p.alias("p"))
    limits = {0.05: 0.05, 0.01: 0.0105, 0.001: 0.0015}
    found = frame.agg(*[F.avg((F.col("p") <= level).cast("int")) for level in limits]).first()
    assert all(share <= limit for share, limit in zip(found, limits.values(), strict=True)), found


def test_battery_equals_plain_python(spark):
    rng = random.Random(6)
    rows = [([rng.randrange(k) for _ in range(rng.randint(20, 90))], k) for k in (16, 32, 62, 64) for _ in range(10)]
    rows += [([3] * 30, 16), (list(range(16)) * 4, 16), ([0, 15] * 20, 16)]
    frame = spark.createDataFrame(rows, "s array<int>, k int")
    for row in frame.withColumn("p", secrets.randomness(F.col("s"), F.col("k"))).collect():
        assert row.p == pytest.approx(p_value(row.s, row.k), rel=2e-3, abs=1e-9)


def test_random_tokens_are_found_and_ordinary_ones_cleared(spark):
    rng = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows, keys = [], set()
    for i in range(120):
        if i % 4 == 0:
            rows.append((i, "see " + "".join(rng.choice(alphabet) for _ in range(44)) + " end"))
            keys.add(i)
        else:
            rows.append((i, "see " + "aaAA11" * 9 + "a" * (i % 5) + " or Version1Version1Version1Version1Version1 end"))
    found = {r.doc_id for r in secrets.secret_spans(table(spark, rows)).filter("spans like '%random%'").collect()}
    assert len(found & keys) >= 27 and not found - keys


def test_tokens_of_every_alphabet_and_after_names_are_tested(spark):
    rng = random.Random(10)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    key = lambda alphabet, n=44: "".join(rng.choice(alphabet) for _ in range(n))
    alphabets = {
        "DB_PASS=": lower + lower.upper() + digits, "?sig=": lower + lower.upper() + digits + "_-", "base36 ": lower + digits,
        "letters ": lower + lower.upper(), "lower ": lower, "both ": lower + lower.upper() + digits + "+/-_",
        "A_LONG_NAME_OF_A_SETTING_IN_CAPITALS=": lower + lower.upper() + digits,
    }
    rows = [(i, name + key(alphabet)) for i, (name, alphabet) in enumerate([*alphabets.items()] * 20)]
    plain = ["a_name_of_snakes_and_more_snakes_and_snakes", "/usr/share/the-tests/of-all/the_tests/there", "aaaabbbbaaaabbbbaaaabbbbaaaabbbb", "abcabc123abcabc123abcabc123abcabc123"]
    rows += [(1000 + i, p) for i, p in enumerate(plain * 10)]
    found = {}
    for row in secrets.secret_spans(table(spark, rows)).collect():
        found[row.doc_id] = {tuple(map(int, x.split(":")[1:])) for x in row.spans.split(",") if x.startswith("random")}
    for number, name in enumerate(alphabets):
        whole = [(len(name), len(name) + 44) in found[i] for i in range(number, 7 * 20, 7)]
        assert sum(whole) >= 14, name
    assert not any(found[i] for i in found if i >= 1000)


def test_false_discovery_control(spark):
    cells = [(1, 48, 5), (1, 0, 95), (2, 0, 10)]
    frame = spark.createDataFrame(cells, "class int, bin int, n long")
    assert secrets.cleared_from(frame) == {1: 48}  # exp(-6) * 100 <= 0.05 * 5; bin 0 clears nothing


def test_redaction(spark):
    key = "AKIA" + "ABCD0123" * 3
    docs = with_clashes(spark, [(1, f"é {key} and token={'x' * 12}0123456789abcdef!"), (2, None), (3, "clean"), (3, "clean")])
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(1, "é [secret] and [secret]!"), (3, "clean"), (3, "clean")]
