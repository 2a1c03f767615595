"""Language, quality, packing, neighbours, archives and chats: round trips, held-out accuracy,
brute force and edge cases."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest

from lurewatch.llm import chat, language, neighbours, packing, quality, warc
from lurewatch.llm.queries import tokenizer_path

DOCUMENT = "doc_id long, text string, lang string"
CLASH = DOCUMENT + ", row string, lang_pred string, score double, node long, length long, start long, raw double"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, lang, "r", "l", 0.5, 1, 2, 3, 0.1) for i, t, lang in rows], CLASH)


# --- language -------------------------------------------------------------------------------

SYLLABLES = {"aa": ["tion", "the", "ing", "er", "th", "an"], "bb": ["sch", "ung", "ich", "der", "ü", "ein"], "cc": ["eau", "que", "é", "le", "ment", "oi"]}


def sentence(rng, lang, n=25):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_automaton_parses_like_a_search():
    rng = random.Random(1)
    training = [rng.randint(1, 4) for _ in range(300)]
    model = language.LanguageModel(["x"], np.array([97, 98, 99], np.uint32), [np.array(training, np.uint8)])
    parser = language.CrossParser(model)
    whole = bytes(training)
    for _ in range(60):
        text = "".join(rng.choice(" abcd") for _ in range(rng.randint(0, 60)))
        codes, sizes = language.normalise([text], parser.letters)
        symbols = parser.symbols[codes].tolist()
        at = phrases = 0
        while at < len(symbols):
            n = 1
            while at + n < len(symbols) and bytes(symbols[at : at + n + 1]) in whole:
                n += 1
            at, phrases = at + n, phrases + 1
        assert parser.phrases(codes, sizes)[0, 0] == phrases


def test_normalise_many_texts():
    letters = language._letters()
    texts = ["Ab, c!", "", "1", "É x"]
    codes, sizes = language.normalise(texts, letters)
    assert "".join(chr(c) if c else "_" for c in codes) == "_ab_c_" + "_" + "_" + "_é_x"
    assert sizes.tolist() == [6, 1, 1, 4]


def test_held_out_languages(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(240))]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !?", None), (1003, sentence(rng, "bb", 20_000), None), (None, sentence(rng, "cc"), "aa")]
    got = language.language_predictions(clashing(spark, rows)).collect()
    by_id = {r.doc_id: r for r in got}
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "bb", "cc"]
    assert all(0 <= r.score <= 1 for r in got) and by_id[1001].score == 0 and len(got) == len(rows)


def test_every_letter_is_a_symbol_of_its_own():
    rng = random.Random(12)
    # Two languages over the same 600 Han letters in another order, and a rare script.
    letters = [chr(0x4E00 + i) for i in range(600)]
    words = {name: ["".join(rng.sample(letters, 3)) for _ in range(300)] for name in ("h1", "h2")}
    words["rare"] = ["".join(chr(0x10D0 + rng.randrange(30)) for _ in range(4)) for _ in range(20)]
    text = lambda name, n: " ".join(rng.choice(words[name]) for _ in range(n))
    model = language.model_of({name: [text(name, 100) for _ in range(10 if name != "rare" else 1)] for name in words})
    assert len(model.alphabet) > 400 and all((t > 0).all() for t in model.training)
    parser = language.CrossParser(model)
    texts = [text(name, 12) for name in words for _ in range(20)]
    names = [name for name in words for _ in range(20)]
    assert parser.languages_of(texts)[0].to_pylist() == names
    # Letters that no training text has are phrases of their own.
    unknown = "".join(chr(0xAC00 + rng.randrange(5000)) for _ in range(200))
    _, _, n_symbols, n_phrases = (column.to_pylist()[0] for column in parser.languages_of([unknown]))
    assert n_symbols - n_phrases <= 2
    # The phrases are those of a plain search, whatever has a column.
    whole = {name: t.tolist() for name, t in zip(model.languages, model.training, strict=True)}
    codes, sizes = language.normalise(texts[:3] + texts[-3:], parser.letters)
    counts, at = parser.phrases(codes, sizes), 0
    for column, size in enumerate(sizes.tolist()):
        symbols = parser.symbols[codes[at : at + size]].tolist()
        at += size
        for row, name in enumerate(model.languages):
            text_of = "".join(map(chr, whole[name]))
            i = phrases = 0
            while i < size:
                n = 1
                while i + n < size and "".join(map(chr, symbols[i : i + n + 1])) in text_of:
                    n += 1
                i, phrases = i + n, phrases + 1
            assert counts[row, column] == phrases


def test_known_language_stage(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, "aa"), "aa") for i in range(20)] + [(50, "привет мир как дела друзья", "aa"), (51, None, "aa"), (52, "42", None), (53, sentence(rng, "aa"), None)]
    docs = clashing(spark, rows)
    kept = language.in_known_language(docs)
    assert kept.columns == docs.columns
    # The Cyrillic letters are in no training text but their own; they stand out by short phrases
    # only where the text itself was not learned from, so only texts without letters surely go.
    ids = {r.doc_id: r for r in kept.collect()}
    assert set(range(20)) <= set(ids) and 53 in ids and not {51, 52} & set(ids) and ids[53].lang == "aa"
    with pytest.raises(ValueError):
        language.in_known_language(docs.filter("doc_id < 0"))


# --- quality --------------------------------------------------------------------------------


def test_held_out_quality(spark):
    rng = random.Random(4)
    good = lambda: sentence(rng, "aa", 60)
    bad = lambda: " ".join(w + "$$$" for w in sentence(rng, "aa", 60).split())
    rows = [(i, good() if i % 3 else bad(), None) for i in range(300)]
    labels = [(i, 1 if i % 3 else 0) for i in range(300)] + [(5, 1), (7, None), (None, 1), (8, 9)]
    extra = [(1000, None, None), (1001, "", None), (1002, "x " * 40_000, None), (None, good(), None)]
    docs = clashing(spark, rows + extra)
    got = quality.quality_scores(docs.select("doc_id", "text", "row"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.predicted == (1 if r.doc_id % 3 else 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got) and len(got) == len(rows + extra)
    empty = {r.score for r in got if r.doc_id in (1000, 1001)}
    assert len(empty) == 1
    with pytest.raises(ValueError):
        quality.train([("only good", 1)] * 5)


# --- packing --------------------------------------------------------------------------------


def pack_one_by_one(lengths, capacity):
    """The algorithm on single pieces: sequences as sorted lists of lengths."""
    left, out = sorted(lengths), []
    while left:
        own, gap = [], capacity
        while True:
            fit = [x for x in left if x <= gap]
            if not fit:
                break
            own.append(fit[-1])
            left.remove(fit[-1])
            gap -= fit[-1]
        if gap and len(own) > 1:
            small = min(own)
            best = max(
                ((a + b, b, a) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= gap + small), default=None
            )
            if best:
                own.remove(small)
                left = sorted([*left, small])
                for x in best[1:]:
                    own.append(x)
                    left.remove(x)
        out.append(sorted(own))
    return out


def test_plan_equals_packing_one_by_one():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.randint(5, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        plan = packing.best_two_fit(counts)
        got = [sorted(x for length, n in runs for x in [length] * n) for runs, repeats in plan for _ in range(repeats)]
        assert sorted(x for s in got for x in s) == sorted(lengths) and all(sum(s) <= capacity for s in got)
        assert len(got) == len(pack_one_by_one(lengths, capacity))


def test_tokens_of_odd_texts(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    plain = Tokenizer.from_file(tokenizer_path())
    chars = "aB '.,!?\n\t́éÉİΣσß1\xa0\x85\x1c<|>中#*'s'll😀"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += ["a<|endoftext|>b", "<|ENDOFTEXT|> X", "x" * 5000, "word " * 9000, None, "", " \n ", "Same", "Same"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(3, texts[3], None), (None, "no id", None)]
    got = packing.pack_documents(clashing(spark, rows), tokenizer_path(), capacity=256, keep_ids=True).collect()
    ids = {}
    for r in sorted(got, key=lambda r: r.piece):
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert r.length == len(part) <= 256 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        if r.doc_id not in (3, None):
            assert r.start == len(ids.setdefault(r.doc_id, []))
            ids[r.doc_id] += part
    for i, text in enumerate(texts):
        if i != 3:
            assert ids[i] == [*plain.encode(text or "", add_special_tokens=False).ids, 1], text
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r.doc_id == 3 and r.piece == 0 for r in got) == 2
    assert packing.pack_documents(clashing(spark, []), tokenizer_path()).count() == 0


# --- neighbours -----------------------------------------------------------------------------


def nearest(rows, query, k):
    q = dict(rows)[query]
    scored = {}
    for i, v in rows:
        if i != query and len(v) == len(q):
            score = float(np.sum(np.array(q) * np.array(v)))
            scored[i] = max(score, scored.get(i, score))
    return sorted(scored.items(), key=lambda p: (-p[1], p[0]))[:k]


@pytest.mark.parametrize("scale", [0.0, 1.0])
def test_recall_against_brute_force(spark, scale):
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((900, 24))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors *= np.exp(scale * rng.standard_normal((900, 1)))
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # a group of copies
    bad = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] + [1.0] * 23), (2060, [float("inf")] * 24), (None, rows[0][1])]
    frame = spark.createDataFrame(rows + rows[:3] + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 as bucket", "'x' as same")
    got = {}
    for r in neighbours.search(frame, "vec_id % 20 = 0", k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    queries = [i for i, _ in rows if i % 20 == 0]
    assert set(got) == set(queries)
    hits = 0
    for q in queries:
        expected, found = nearest(rows, q, 10), sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        exact = dict(nearest(rows, q, len(rows)))
        assert all(score == pytest.approx(exact[i], abs=1e-12) for _, i, score in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in expected})
    assert hits / (10 * len(queries)) >= 0.9
    assert [i for _, i, _ in sorted(got[1000])] == [i for i, _ in nearest(rows, 1000, 10)]
    if scale == 0:  # unit vectors: the copies are the nearest
        assert [i for _, i, _ in sorted(got[1000])] == [3, *range(1001, 1010)]


def test_few_vectors_and_mixed_dimensions(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 2.0, 3.0]), (20, [0.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.search(frame, "vec_id % 20 = 0").collect()]
    assert sorted(got) == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert neighbours.search(frame.filter("vec_id < 0"), "vec_id % 20 = 0").count() == 0


def test_rotations_keep_lengths():
    rows = np.random.default_rng(1).standard_normal((5, 20))
    turned = neighbours.rotated(rows, 1, 0)
    assert np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(rows, axis=1)) and turned.shape == (5, 32)
    near = neighbours.buckets(rows, 0, 2)
    assert (neighbours.probes(rows, 0, 2, 5)[:, :] == near[:, None]).any(1).all()


# --- archives -------------------------------------------------------------------------------


def test_archives_round_trip(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FRAME_BYTES", 300)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 900)
    pages = [(i, f"http://x/{i}", f"<p>page {i % 9}</p>" + "z" * (i % 9) * 40) for i in range(30)]
    pages += [(40, None, None), (41, "http://a\r\nb", ""), (None, "u", "<p>page 1</p>"), (42, "u", "\r\n\r\n"), (43, "u", "é" * 5000), (43, "u", "é" * 5000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "1 as id")
    got = warc.archived_pages(frame).collect()
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    expected = []
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = i is not None and i != first[html or ""]
        digest = warc.payload_digest(data)
        expected.append((i, len(data), digest, "revisit" if revisit else "response", first[html or ""] if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert warc.archived_pages(frame.filter("page_id < 0")).count() == 0
    assert warc.with_originals(spark.createDataFrame([(1, b"ab"), (2, b"ab")], "id long, payload binary"), 3).filter("refers_to is not null").count() == 0


def test_seek_table_and_frames(tmp_path):
    import zstandard
    from pyarrow import fs

    writer = warc.ArchiveWriter(tmp_path.as_uri())
    data = {f"r{i}": warc.record(f"r{i}", "u", bytes([65 + i]) * 700_000, None) for i in range(5)}
    rows = [row for name, body in data.items() for row in writer.add(name, body)] + writer.close()
    path = tmp_path / rows[0][1]
    assert zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read() == b"".join(data.values())
    file = fs.LocalFileSystem().open_input_file(str(path))
    places = warc.frame_places(file)
    for name, _, frame, offset, length in rows:
        file.seek(places[frame][0])
        plain = zstandard.ZstdDecompressor().decompress(file.read(places[frame][1]))
        assert plain[offset : offset + length] == data[name]
    assert len(places) == 3


# --- chats ----------------------------------------------------------------------------------


def test_escapes_round_trip():
    rng = random.Random(8)
    for _ in range(5000):
        text = "".join(rng.choice("\\<|ax>") for _ in range(rng.randint(0, 10)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_conversations_round_trip(spark):
    text = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 2, "assistant", text), (1, 0, "user", None), (1, 1, "assistant", "a\\<|b\n"), (2, 5, None, ""), (2, 5, "user", "é😀"), (2, 5, "user", "é😀")]
    turns += [(3, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(300)] + [(None, 0, "user", "lost"), (4, None, "assistant", "x" * 100_000)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as number", "'s' as span")
    got = {r.conv_id: r for r in chat.formatted_conversations(frame).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, row in got.items():
        own = sorted(((t, r or "none", x or "") for c, t, r, x in turns if c == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert row.n_turns == len(own) and row.loss_chars == len(learned)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert row.formatted_chars == len(chat.chat_template([(r, x) for _, r, x in own]))
    spans = chat.render_turns(frame).filter("conv_id = 3").orderBy("number").collect()
    assert "".join(s.span for s in spans) == chat.chat_template([(s.role, f"turn {s.turn}") for s in spans])
    assert chat.formatted_conversations(frame.filter("conv_id = 99")).count() == 0


def last_marked(turns):
    return "".join(f"[{r}]{t}" for r, t in turns[:-1]) + "".join(f"[last {r}]{t}" for r, t in turns[-1:])


def counted(turns):
    return f"{len(turns)} turns;" + "".join(t for _, t in turns)


@pytest.mark.parametrize("template", [last_marked, counted, lambda turns: json.dumps(turns)])
def test_templates_that_rewrite_history_are_found(template):
    with pytest.raises(chat.RewritesHistory):
        chat.spans_of(template, [("user", f"t{i}") for i in range(20)])


def test_template_with_an_opening():
    spans = chat.spans_of(lambda turns: "<s>" + "".join(f"[{r}]{t}" for r, t in turns), [("user", f"t{i}") for i in range(20)])
    assert spans[0] == "<s>[user]t0" and spans[1:] == [f"[user]t{i}" for i in range(1, 20)]


def with_system(turns):
    mark = "!" if turns and turns[0][0] == "system" else ""
    return "".join(f"[{r}{mark}]{t}" for r, t in turns)


def numbered(turns):
    return "".join(f"{i}:{r}{t};" for i, (r, t) in enumerate(turns))


def by_length_so_far(turns):
    out = ""
    for r, t in turns:
        out += f"[{r}{len(out) % 7}]{t}"
    return out


@pytest.mark.parametrize("template", [with_system, numbered, by_length_so_far, chat.chat_template])
@pytest.mark.parametrize("length", [1, 8, 9, 12, 20, 200])
def test_append_only_templates_pass_at_any_length(template, length):
    turns = [("user" if i else "system", f"t{i}") for i in range(length)]
    spans = chat.spans_of(template, turns)
    assert all("".join(spans[:i]) == template(turns[:i]) for i in range(1, length + 1))


@pytest.mark.parametrize("length", [11, 12, 40, 200])
def test_forgotten_turns_are_found(length):
    with pytest.raises(chat.RewritesHistory):
        chat.spans_of(lambda turns: "".join(t for _, t in turns[-10:]), [("user", f"t{i}") for i in range(length)])


def test_long_memory_in_the_table(spark):
    turns = [(c, i, "user" if i else "system", f"t{i:02}") for c in (1, 2) for i in range(30 if c == 1 else 3)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1)
    template = lambda turns: "".join(f"[{turns[0][0]} {r}]{t}" for r, t in turns)
    found = sorted(chat.render_turns(frame, template).collect())
    assert [r.span for r in found] == [f"[system {r}]{t}" for _, _, r, t in turns]
    assert [r.begin for r in found if r.conv_id == 2] == [0, len(found[0].span), len(found[0].span) + len(found[1].span)]
    forgets = lambda turns: "".join(t for _, t in turns[-10:])
    with pytest.raises(Exception, match="RewritesHistory"):
        chat.render_turns(frame, forgets).collect()
