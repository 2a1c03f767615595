"""Token counts of whole texts by a two-tier look-up on the map side.

A byte-level tokenizer cuts a text into pre-tokens that are encoded one by one, so the number of
tokens of a text is the sum over its pre-tokens.  The first tier is a compact table of frequent
pre-tokens and their lengths in tokens, sent to every task; the second is a store of the misses
that a Python worker has encoded so far.  Only what neither knows is encoded.  Neither pre-tokens
nor texts are shuffled.

Which pre-tokens are frequent is counted over all texts.  Each task keeps a Misra-Gries summary of
``SUMMARY`` counters and hands on the pre-tokens that make up at least one in ``SHARE`` of its
own; one that is that frequent in the whole corpus is so in at least one task.  A task hands on at
most ``1 / (1 / SHARE - 1 / SUMMARY)`` rows, the table has at most ``TABLE`` entries, and no
pre-token of more than ``STORE_BYTES`` bytes is in it.  The table only saves work: counts are the
same with any.

Texts are cut without a copy where no pre-token goes on: before white space that follows something
else, and between plain letters, digits and marks.  Equal pieces of a slice are looked up once.
Special strings inside a text count as the tokenizer counts them, as one token each.

Null and empty texts have no bytes and no tokens.  Repeated rows are counted each, rows without an
id as well.  Other columns are not looked at.  An empty table gives an empty result.  A run of
letters without an end is one pre-token and is encoded in one piece.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import text_slices

LIMIT = 1024
SHARE, SUMMARY, TABLE = 20_000, 100_000, 1 << 15
# Lengths that a worker keeps, and the longest key; a full store is emptied.
STORE, STORE_BYTES = 400_000, 64
# Bytes of text whose pieces are looked up together.
TOGETHER_BYTES = 4 << 20
# Lead bytes of the blocks that hold white space beyond ASCII.
WIDE_SPACE_2, WIDE_SPACE_3 = 0xC2, (0xE1, 0xE2, 0xE3, 0xEF)
# A piece that is one pre-token for certain.
ONE_PRETOKEN = re.compile(rb" ?(?:[A-Za-z]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n+")


def _kinds() -> np.ndarray:
    """What a byte is in a text: a letter, a digit, a mark, an apostrophe, or 0 if that depends."""
    kinds = np.zeros(256, np.uint8)
    kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    kinds[0x30:0x3A] = DIGIT
    kinds[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = MARK
    kinds[ord("'")] = APOSTROPHE
    return kinds


LETTER, DIGIT, MARK, APOSTROPHE = 1, 2, 3, 4
KINDS = _kinds()
# No pre-token goes on from the first kind to the second; an apostrophe may start an ending.
PARTED = np.zeros((5, 5), bool)
for _kind, _next in ((LETTER, (DIGIT, MARK, APOSTROPHE)), (DIGIT, (LETTER, MARK, APOSTROPHE)), (MARK, (LETTER, DIGIT)), (APOSTROPHE, (DIGIT,))):
    PARTED[_kind, list(_next)] = True


class Encoder:
    """Pre-tokens and their lengths from a byte-level tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        # Only then do pieces that are encoded one by one add up to the whole text.
        if self.tokenizer.normalizer or "ByteLevel" not in repr(self.tokenizer.pre_tokenizer) or not plain or self._prefixes():
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        self.special = {t.content.encode() for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_at = re.compile(b"|".join(map(re.escape, longest_first))) if added else None
        self.store: dict[bytes, int] = {}

    def _prefixes(self) -> bool:
        """Whether a space is put before a text that has none."""
        return len(self.split("a")[0][0]) != 1

    def pretokens(self, piece: bytes) -> list[bytes]:
        if piece in self.special or ONE_PRETOKEN.fullmatch(piece):
            return [piece]
        text = piece.decode("utf-8", "replace")
        letters = text[1:] if text[0] == " " else text
        if letters.isalpha() and max(letters) < "\u0250":
            return [piece]
        return [text[begin:end].encode() for _, (begin, end) in self.split(text)]

    def lengths(self, pretokens: list[bytes]) -> list[int]:
        out = []
        for start in range(0, len(pretokens), 4096):
            part = [p.decode("utf-8", "replace") for p in pretokens[start : start + 4096]]
            out += [len(e) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so what it has encoded serves all of its tasks."""
    pa.set_cpu_count(1)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for every core
    return Encoder(path)


def pieces_of(texts: pa.Array, special_at: re.Pattern | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces of all texts in a row, the first piece of each text (and the end), bytes of each."""
    whole = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    held = whole.buffers()[2]
    base, stop = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = np.frombuffer(held, np.uint8)[base:stop] if held is not None else np.zeros(0, np.uint8)
    bounds = offsets - base
    cut = np.zeros(len(data) + 1, bool)
    space = (data == 0x20) | (data == 0x0A) | (data == 0x09) | (data == 0x0D)
    may_be_space = (data <= 0x20) & (((data >= 0x09) & (data <= 0x0D)) | (data >= 0x1C))
    wide = np.flatnonzero(data >= 0x80)
    if len(wide):
        lead = wide[wide >= 1]
        may_be_space[lead[data[lead - 1] == WIDE_SPACE_2]] = True
        lead = wide[wide >= 2]
        may_be_space[lead[np.isin(data[lead - 2], WIDE_SPACE_3)]] = True
    kind = KINDS[data]
    cut[1:-1] = (space[1:] & ~may_be_space[:-1]) | PARTED[kind[:-1], kind[1:]]
    cut[bounds[:-1]] = True
    if special_at is not None and len(data):
        view = memoryview(data)
        near = {f.start() for f in special_at.finditer(view)}
        # Each of these texts by itself: two neighbours may look like a special string together.
        for text in np.unique(np.searchsorted(bounds, sorted(near), side="right") - 1) if near else ():
            for found in special_at.finditer(view, int(bounds[text]), int(bounds[text + 1])):
                cut[found.start() + 1 : found.end()] = False
                cut[found.start()] = cut[found.end()] = True
    cut[-1] = False
    starts = np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)
    places = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, places, pa.py_buffer(data)])
    return pieces, np.searchsorted(starts, bounds), np.diff(bounds)


class Summary:
    """Misra-Gries counters: each count is short by at most ``total / SUMMARY``."""

    def __init__(self):
        self.counts: dict[bytes, int] = {}
        self.total = 0

    def add(self, key: bytes, n: int) -> None:
        self.counts[key] = self.counts.get(key, 0) + n
        self.total += n

    def prune(self) -> None:
        if len(self.counts) > 2 * SUMMARY:
            sizes = np.fromiter(self.counts.values(), np.int64, len(self.counts))
            least = int(np.partition(sizes, -SUMMARY - 1)[-SUMMARY - 1])
            self.counts = {k: n - least for k, n in self.counts.items() if n > least}

    def frequent(self) -> list[tuple[bytes, int]]:
        least = self.total / SHARE - self.total / SUMMARY
        return [(k, n) for k, n in self.counts.items() if n >= least]


def frequent_pretokens(texts: DataFrame, tokenizer: str, text_col: str = "text", entries: int = TABLE) -> list[bytes]:
    """The most frequent pre-tokens of all texts, at most ``entries``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = Summary(), {}
        for batch in text_slices(batches, "text", TOGETHER_BYTES):
            own = encoder(tokenizer)
            pieces, _, _ = pieces_of(batch.column("text"), own.special_at)
            values = pieces.dictionary_encode()
            weights = np.bincount(values.indices.to_numpy(), minlength=len(values.dictionary))
            if len(seen) > STORE:
                seen = {}
            for piece, n in zip(values.dictionary.to_pylist(), weights.tolist(), strict=True):
                parts = seen.get(piece)
                if parts is None:
                    parts = [p for p in own.pretokens(piece) if len(p) <= STORE_BYTES]
                    if len(piece) <= STORE_BYTES:
                        seen[piece] = parts
                for part in parts:
                    held.add(part, n)
            held.prune()
        if rows := held.frequent():
            keys, counts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], ["pretoken", "n"])

    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "pretoken binary, n long")
    totals = counted.groupBy("pretoken").agg(F.sum("n").alias("n"))
    top = totals.orderBy(F.desc("n"), "pretoken").limit(entries)
    # At most ``entries`` rows of at most STORE_BYTES bytes.
    return [bytes(r.pretoken) for r in top.collect()]


class Lengths:
    """Tokens of pieces: the sent table first, then what the worker knows, then the tokenizer."""

    def __init__(self, tokenizer: str, keys: list[bytes], sizes: bytes):
        self.encoder = encoder(tokenizer)
        self.keys = pa.array(keys, pa.large_binary())
        self.sizes = np.frombuffer(sizes, "<u2").astype(np.int64)
        self.table = dict(zip(keys, self.sizes.tolist(), strict=True))

    def of(self, pieces: pa.Array) -> np.ndarray:
        at = pc.index_in(pieces, value_set=self.keys)
        out = np.zeros(len(pieces), np.int64)
        hit = at.is_valid().to_numpy(zero_copy_only=False)
        out[hit] = self.sizes[at.drop_null().to_numpy()]
        if not hit.all():
            out[~hit] = self._misses(pieces.filter(pa.array(~hit)).to_pylist())
        return out

    def _misses(self, pieces: list[bytes]) -> list[int]:
        own, table = self.encoder, self.table
        if len(own.store) > STORE:
            own.store = {}
        store = own.store
        new = {piece: own.pretokens(piece) for piece in pieces if piece not in store}
        unknown = list({p for parts in new.values() for p in parts if p not in table and p not in store})
        fresh = dict(zip(unknown, own.lengths(unknown), strict=True))

        def length(pretoken: bytes) -> int:
            for known in (table, store, fresh):
                if pretoken in known:
                    return known[pretoken]
            raise KeyError(pretoken)

        sums = {piece: sum(map(length, parts)) for piece, parts in new.items()}
        out = [store[piece] if piece in store else sums[piece] for piece in pieces]
        for known in (fresh, sums):
            store.update((k, n) for k, n in known.items() if len(k) <= STORE_BYTES)
        return out


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
    frequent: list[bytes] | None = None,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``frequent`` are the pre-tokens of the table; without them they are counted first.
    """
    keys = frequent_pretokens(docs, tokenizer, text_col) if frequent is None else frequent[:TABLE]
    keys = list(dict.fromkeys(k for k in keys if len(k) <= STORE_BYTES))
    own = encoder(tokenizer)
    sizes = np.array(own.lengths(keys), "<u2").tobytes()
    # At most TABLE * (STORE_BYTES + 2) bytes: two megabytes.
    sent = docs.sparkSession.sparkContext.broadcast((keys, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = None
        for batch in text_slices(batches, "text", TOGETHER_BYTES):
            lengths = lengths or Lengths(tokenizer, *sent.value)
            pieces, first, n_bytes = pieces_of(batch.column("text"), lengths.encoder.special_at)
            values = pieces.dictionary_encode()
            tokens = lengths.of(values.dictionary)[values.indices.to_numpy()]
            before = np.concatenate([[0], np.cumsum(tokens)])
            n = before[first[1:]] - before[first[:-1]]
            arrays = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
