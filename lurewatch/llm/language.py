"""Language identification by cross-parsing.

For every language a suffix automaton of labelled text is built.  A text is then cut greedily
into phrases, each the longest that occurs in that training text; a character that occurs nowhere
is a phrase of its own.  Text in the language of the training text needs few phrases.  The
language with the fewest phrases per symbol wins.

Letters are lower-cased; everything between letters counts as one boundary symbol.  Long texts
are parsed in stretches of ``STRETCH`` symbols, so a phrase ends there at the latest; all
stretches of a text count.  Many stretches are parsed side by side, one symbol of each at a time,
against all automata at once.

Training uses a bounded sample: ``snippets`` parts of ``SNIPPET_CHARS`` characters per language,
fewer if there are many languages (``MAX_TRAINING_CHARS`` in all bounds the automata).  Prediction
reads whole texts.  Null texts and texts without a letter get ``und`` and score 0.  Equal phrase
counts go to the language that sorts first.  Without labelled text ``train`` raises
``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lurewatch.llm.common import fold, text_slices

UNDETERMINED = "und"
SNIPPETS = 60
SNIPPET_CHARS = 400
MAX_TRAINING_CHARS = 160_000
# The most frequent letters have a column in the tables of transitions; those of others are sorted.
DENSE_SYMBOLS = 120
STRETCH = 2048
RANKED_PARTS = 64
# Rejection is calibrated on labelled parts that the automata have not seen, cut to these numbers of
# symbols: the phrases of a text must be at least MARGIN times as long as those of all but a share
# of RARE of them.
WINDOWS = (8, 16, 32, 64, 128, 256, 400)
RARE, MARGIN = 0.002, 0.8
# Text with phrases of so many symbols is never rejected, however uniform the labelled text is.
ALWAYS_KNOWN = 2.5
# Bytes of text that are normalised together.
PARSED_BYTES = 2 << 20
# Symbols of all stretches that are parsed side by side.
SIDE_BY_SIDE = 4 << 20


def _letters() -> np.ndarray:
    """The lower-case form of every letter, 0 for other characters."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def normalise(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row with one 0 for each stretch of other characters, and
    the number of symbols of each text.  Every text starts and ends with a boundary."""
    joined = "\0".join(["", *texts, ""])
    codes = letters[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    # The text that each character belongs to; a separator opens the next text.
    opens = np.cumsum([0] + [len(t) + 1 for t in texts])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    after = opens + 1
    after = after[after < len(codes)]
    keep[after] &= codes[after] != 0  # one boundary is enough
    keep[opens] = True  # every text has its opening boundary
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    bounds = kept_before[opens]
    return codes[keep][: bounds[-1]], np.diff(bounds)


def suffix_automaton(symbols: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the automaton of all parts of ``symbols``: 0 where there is none.

    State 1 is the start; row s of the first table holds the next state for every symbol below
    ``width``.  The second has rows of (state, symbol, next state) for the others.
    """
    link, size = [0, 0], [0, 0]
    steps: list[dict[int, int]] = [{}, {}]
    last = 1
    for symbol in symbols:
        new = len(size)
        size.append(size[last] + 1)
        link.append(1)
        steps.append({})
        at = last
        while at and symbol not in steps[at]:
            steps[at][symbol] = new
            at = link[at]
        if at:
            to = steps[at][symbol]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                copy = len(size)
                size.append(size[at] + 1)
                link.append(link[to])
                steps.append(dict(steps[to]))
                while at and steps[at].get(symbol) == to:
                    steps[at][symbol] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    table, others = np.zeros((len(size), width), np.int32), []
    for state, row in enumerate(steps):
        for symbol, to in row.items():
            if symbol < width:
                table[state, symbol] = to
            else:
                others.append((state, symbol, to))
    return table, np.array(others, np.int64).reshape(-1, 3)


@dataclass
class LanguageModel:
    languages: list[str]
    # Code points, frequent ones first; their index + 2 is the symbol, 1 is the boundary, 0 other.
    alphabet: np.ndarray
    training: list[np.ndarray]  # symbols per language

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str | None = "text") -> DataFrame:
        """``doc_id, lang_pred, score, n_symbols, n_phrases`` of every row.

        With ``text_col=None`` the id is a whole row that holds ``text``, which then is sent once.
        """
        rows = docs.select(F.col(id_col).alias("doc_id"), *([F.col(text_col).alias("text")] if text_col else []))

        def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row = batch.column("doc_id")
                text = batch.column("text") if text_col else row.field("text")
                yield pa.RecordBatch.from_arrays([row, text], ["doc_id", "text"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parser = None
            for batch in text_slices(with_text(batches), "text", PARSED_BYTES):
                parser = parser or CrossParser(self)
                found = parser.languages_of(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found], names)

        names = ["doc_id", "lang_pred", "score", "n_symbols", "n_phrases"]
        added = StructType.fromDDL("lang_pred string, score double, n_symbols long, n_phrases long")
        # The id may be of any type, whole rows included.
        return rows.mapInArrow(run, StructType([rows.schema["doc_id"], *added.fields]))


class CrossParser:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.letters = _letters()
        self.symbols = _symbols(model.alphabet)
        width = min(len(model.alphabet), DENSE_SYMBOLS) + 2
        tables, others, starts, rows = [], [], [], 0
        for training in model.training:
            table, rare = suffix_automaton(training.tolist(), width)
            table[:, 0] = 0  # an unknown symbol is never part of a longer phrase
            tables.append(np.where(table > 0, table + rows, 0))
            others.append(rare + [rows, 0, rows])
            starts.append(rows + 1)
            rows += len(table)
        self.width = width
        # Transitions by letters without a column: sorted keys of state and symbol.
        self.letters_in_all = len(model.alphabet) + 2
        rare = np.concatenate(others)
        keys = rare[:, 0] * self.letters_in_all + rare[:, 1]
        order = np.argsort(keys)
        self.rare_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rare_steps = np.append(rare[order, 2], 0).astype(np.int32)
        self.steps = np.concatenate(tables).astype(np.int32).ravel()
        self.starts = np.array(starts, np.int32)
        # The first step of a phrase in each language, 0 for a symbol that its text lacks.
        self.first = self.steps.reshape(-1, width)[self.starts]

    def _rare_step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next states for letters without a column; ``symbols`` fits the last axis."""
        keys = states.astype(np.int64) * self.letters_in_all + symbols
        at = np.searchsorted(self.rare_keys, keys)
        return np.where(self.rare_keys[at] == keys, self.rare_steps[at], 0)

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases that each language needs for each text; texts stand in a row in ``codes``."""
        symbols = self.symbols[codes].astype(np.int32)
        owner, begin, length = _stretches(sizes)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        counts = np.zeros((len(self.starts), len(owner)), np.int32)
        state = np.zeros((len(self.starts), len(owner)), np.int32)  # 0: no phrase is open
        # How many stretches still have a symbol at each step.
        alive = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        for step, n in enumerate(alive.tolist()):
            symbol = symbols[begin[:n] + step]
            at = state[:, :n]
            rare = np.flatnonzero(symbol >= self.width)
            dense = symbol if not len(rare) else np.where(symbol < self.width, symbol, 0)
            to = self.steps.take(at * self.width + dense)
            first = self.first.take(dense, axis=1)
            if len(rare):
                to[:, rare] = self._rare_step(at[:, rare], symbol[rare])
                first[:, rare] = self._rare_step(self.starts[:, None], symbol[rare])
            ends = to == 0
            counts[:, :n] += ends & (at != 0)
            to = np.where(ends, first, to)
            counts[:, :n] += to == 0  # a symbol that occurs nowhere is a phrase
            state[:, :n] = to
        counts += state != 0  # the phrase that is open at the end
        out = np.zeros((len(self.starts), len(sizes)), np.int64)
        for language, row in enumerate(counts):
            out[language] = np.bincount(owner, row, len(sizes))
        return out

    def languages_of(self, texts: list[str | None]):
        codes, sizes = normalise([t or "" for t in texts], self.letters)
        phrases = np.zeros((len(self.starts), len(texts)), np.int64)
        # Parsed in parts, so that very long texts take no more memory than many short ones.
        done, at = 0, 0
        while done < len(sizes):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[done:]), SIDE_BY_SIDE, side="right")))
            total = int(sizes[done : done + n].sum())
            phrases[:, done : done + n] = self.phrases(codes[at : at + total], sizes[done : done + n])
            done, at = done + n, at + total
        best = phrases.argmin(0)
        fewest = phrases[best, np.arange(len(texts))]
        # The share of the winner if every phrase more makes a language e times less likely.
        score = 1 / np.exp(-np.minimum(phrases - fewest, 700)).sum(0)
        known = np.array([size > 1 for size in sizes], bool)  # more than the opening boundary
        names = [self.model.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return [
            pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)),
            pa.array(np.where(known, sizes, 0).astype(np.int64)), pa.array(np.where(known, fewest, 0)),
        ]


def _stretches(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, begin and length of the stretches that texts standing in a row are cut into."""
    parts = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(sizes) - sizes, parts) + number * STRETCH
    return owner, begin, np.minimum(STRETCH, sizes[owner] - number * STRETCH)


def _symbols(alphabet: np.ndarray) -> np.ndarray:
    """The symbol of every code point of normalised text."""
    table = np.zeros(0x110000, np.int32)
    table[alphabet] = np.arange(2, len(alphabet) + 2)
    table[0] = 1
    return table


def train(docs: DataFrame, usable, snippets: int = SNIPPETS) -> LanguageModel:
    """Automata of labelled text; ``usable`` tells which rows may be learned from."""
    return model_of(labelled_snippets(docs, usable, snippets))


def labelled_snippets(docs: DataFrame, usable, snippets: int = SNIPPETS) -> dict[str, list[str]]:
    """At most ``snippets`` parts of labelled texts for each language."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    draw = F.xxhash64(F.col("doc_id").cast("string"))
    places = F.greatest(F.lit(1), F.ceil(F.length("text") / SNIPPET_CHARS))
    part = F.pmod(draw, places) * SNIPPET_CHARS + 1
    rows = rows.select(
        "lang", draw.alias("draw"),
        F.substr("text", part.cast("int"), F.lit(SNIPPET_CHARS)).alias("text"),
    )
    # The rank is cut in every task before the exchange: a bounded number of rows moves.
    # The parts keep what meets in one task from growing with the table.
    for keys in (["lang", F.pmod("draw", F.lit(RANKED_PARTS))], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("draw", "text")
        rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= snippets)
    picked = rows.collect()
    by_language: dict[str, list[str]] = {}
    for row in sorted(picked, key=lambda r: (r.lang, r.n)):
        by_language.setdefault(row.lang, []).append(row.text)
    return {language: list(dict.fromkeys(texts)) for language, texts in by_language.items()}


def model_of(by_language: dict[str, list[str]]) -> LanguageModel:
    if not by_language:
        raise ValueError("no labelled text to learn languages from")
    limit = max(200, MAX_TRAINING_CHARS // len(by_language))
    letters = _letters()
    languages, coded = sorted(by_language), []
    for language in languages:
        coded.append(normalise(by_language[language], letters)[0][:limit])
    codes, counts = np.unique(np.concatenate(coded), return_counts=True)
    codes, counts = codes[codes > 0], counts[codes > 0]
    # Every letter of the training text is told apart; it has MAX_TRAINING_CHARS of them at most.
    alphabet = codes[np.argsort(-counts, kind="stable")]
    symbols = _symbols(alphabet)
    return LanguageModel(languages, alphabet, [symbols[c] for c in coded])


def shortest_phrases(model: LanguageModel, unseen: dict[str, list[str]]) -> list[tuple[int, float]]:
    """For each number of symbols in ``WINDOWS``: the mean phrase that a text needs at least.

    Short texts scatter more, so they need less.  The language that needs most phrases counts.
    Without unseen text nothing is asked.
    """
    parser, floors, least = CrossParser(model), [], 0.0
    for window in WINDOWS:
        lows = []
        for texts in unseen.values():
            codes, sizes = normalise(texts, parser.letters)
            ends = np.cumsum(sizes)
            # Whole windows of each text, side by side.
            starts = [np.arange(end - size, end - window + 1, window) for end, size in zip(ends, sizes, strict=True)]
            begins = np.concatenate(starts) if starts else np.zeros(0, int)
            if len(begins):
                cut = codes[(begins[:, None] + np.arange(window)).ravel()]
                phrases = parser.phrases(cut, np.full(len(begins), window)).min(0)
                lows.append(np.quantile(window / phrases, RARE, method="lower"))
        if lows:
            least = max(least, min(ALWAYS_KNOWN, MARGIN * float(min(lows))))
        floors.append((window, least))
    return floors


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows whose text is in one of the languages of the table itself; all columns.

    Rejected are texts without a letter, texts whose letters no language has, and texts that need
    more phrases than labelled text of their length does (see :func:`shortest_phrases`), such as
    those in a language that the table does not label.  Of the labelled sample one half makes the
    automata, the other half these bounds.  A missing ``lang`` is filled in.
    """
    sample = labelled_snippets(docs, F.lit(True), 2 * SNIPPETS)
    model = model_of({language: texts[::2] for language, texts in sample.items()})
    floors = shortest_phrases(model, {language: texts[1::2] for language, texts in sample.items()})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = model.predict(rows, id_col="row", text_col=None).withColumnRenamed("doc_id", "row")
    size, floor = F.col("n_symbols"), F.lit(0.0)
    for window, least in floors:
        floor = F.when(size >= window, least).otherwise(floor)
    # A phrase of one symbol each is what text in an unknown script has.
    known = (size > F.col("n_phrases")) & (size >= floor * F.col("n_phrases"))
    kept = found.filter((F.col("lang_pred") != UNDETERMINED) & known)
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    columns["lang"] = F.coalesce(columns["lang"], "lang_pred")
    # The names of the input come last, so that none of them is taken for a helper's.
    return kept.select(F.struct(*[c.alias(name) for name, c in columns.items()]).alias("_done")).select("_done.*")


def language_predictions(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learned outside the fold crc32(id) % 4 = 2."""
    held_out = fold("doc_id", 4, 2)
    model = train(docs, ~held_out)
    return model.predict(docs).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_symbols", "n_phrases"
    )
