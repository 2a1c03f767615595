"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A sequence is filled greedily with the longest piece that fits its gap.  Then its shortest piece
is taken out if two unpacked pieces fit the widened gap more tightly, and they take its place.

Only the *number of pieces of each length* decides what happens next, so the plan is made from a
histogram (at most ``capacity`` rows, whatever the corpus): a pattern of lengths is laid out
once, together with how often it can be repeated before one of its lengths runs out.  Pieces then
find their place from their rank among the pieces of equal length, which is counted in salted
parts, so a length that a third of the corpus has is no hot spot.

Null texts count as empty; a document without tokens is a sequence piece of the end token alone.
Repeated rows are packed once each.  Columns of ``docs`` other than the id and the text are not
looked at, so clashing names do no harm.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import text_slices
from lurewatch.session import stage

CAPACITY = 4096
END_ID = 1
# Encoded words and joined words kept by a worker, and the longest; a full store is emptied.
ENCODED_WORDS, JOINED_WORDS, STORE_CHARS = 500_000, 250_000, 64
# Bytes of text whose words are looked up together.
TOGETHER_BYTES = 12 << 20
# Pieces of one length that are numbered together, on average at most.
RANKED_TOGETHER = 100_000


class WordTokenizer:
    """Ids of whole texts from a tokenizer that never joins what white space parts.

    The distinct words of a slice are looked up in a store of ids; the ids of the texts are then
    gathered from those of their words.  Letters are lower-cased by the tokenizer, so plain
    letters may be lower-cased before the look-up, unless a text could name a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        pa.set_cpu_count(1)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.encoded: dict[str, bytes] = {}
        self.joined: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and where each text begins and ends."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        ids = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        known = np.frombuffer(b"".join(ids), "<u4")
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        n = sizes[index]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total, dtype=np.int32) if total < 1 << 31 else np.arange(total)
        place += np.repeat((begins[index] - (ends - n)).astype(place.dtype), n)
        words = np.concatenate([[0], ends])
        return known[place], words[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.encoded) > ENCODED_WORDS:
            self.encoded = {}
        if len(self.joined) > JOINED_WORDS:
            self.joined = {}
        encoded, joined = self.encoded, self.joined
        # A run of letters with marks behind it is encoded as its two parts.
        letters, whole, parted = set(), set(), []
        for word in words:
            if word in joined or word in encoded:
                continue
            core = word.rstrip(TAIL_MARKS)
            if not _plain(core):
                whole.add(word)
                continue
            if core not in encoded:
                letters.add(core)
            if len(core) < len(word):
                tail = word[len(core) :]
                if tail not in encoded:
                    whole.add(tail)
                parted.append((word, core, tail))
        self._letters(list(letters))
        self._whole(list(whole))
        for word, core, tail in parted:
            joined[word] = encoded[core] + encoded[tail]
        found = [joined[w] if w in joined else encoded[w] for w in words]
        for word in letters | whole:
            if len(word) > STORE_CHARS:
                del encoded[word]
        return found

    def _letters(self, words: list[str]) -> None:
        """Encodes runs of letters many at a time: each ends with the one token that ends a word."""
        for start in range(0, len(words), 512):
            part = words[start : start + 512]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            data, begin = ids.tobytes(), 0
            for word, end in zip(part, ends.tolist(), strict=True):
                self.encoded[word] = data[begin:end]
                begin = end

    def _whole(self, words: list[str]) -> None:
        for start in range(0, len(words), 4096):
            part = words[start : start + 4096]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            for word, encoded in zip(part, found, strict=True):
                self.encoded[word] = np.array(encoded.ids, "<u4").tobytes()


# Marks that the tokenizer parts from letters before them; no apostrophe, which starts endings.
TAIL_MARKS = ".,;:!?#$%&*"


def _plain(word: str) -> bool:
    """Letters of the Latin blocks, of which no two make up one and each has one lower case."""
    return word.isalpha() and max(word) < "\u0250" and "\u0130" not in word


def token_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
) -> DataFrame:
    """Every document as pieces of at most ``capacity`` tokens, the end token included.

    Only longer documents are cut, and only their last piece may be shorter.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in text_slices(batches, "text", TOGETHER_BYTES):
            words = words or WordTokenizer(tokenizer)
            ids, bounds = words.encode(batch.column("text"))
            data, rows, columns, kept = ids.tobytes(), [], ([], [], [], []), []
            for row, (begin, stop) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                size = stop - begin + 1  # the end token included
                for piece, start in enumerate(range(0, size, capacity)):
                    length = min(capacity, size - start)
                    part = data[4 * (begin + start) : 4 * min(begin + start + length, stop)]
                    if start + length == size:
                        part += end
                    rows.append(row)
                    for column, value in zip(columns, (piece, start, length, zlib.crc32(part)), strict=True):
                        column.append(value)
                    if keep_ids:
                        kept.append(part)
            arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(cut, schema + (", ids binary" if keep_ids else ""))


def best_two_fit(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """The patterns, as (length, how many) runs in order of filling, and their repeats.

    ``counts[n]`` is the number of pieces of length ``n``; the last index is the capacity.
    Equals the algorithm run bin by bin: while every length of a pattern is left often enough,
    the same choices come out again, since nothing else is used up.
    """
    left, capacity = counts.astype(np.int64).copy(), len(counts) - 1
    lengths = np.arange(capacity + 1)
    open_lengths = np.flatnonzero(left[1:]).__add__(1).tolist()
    plan = []
    while open_lengths:
        used: dict[int, int] = {}
        gap, below = capacity, len(open_lengths)
        while gap and (below := bisect_right(open_lengths, gap, 0, below)):
            length = open_lengths[below - 1]
            used[length] = min(gap // length, int(left[length]))
            gap -= used[length] * length
            below -= 1
        if gap and sum(used.values()) > 1:
            shortest = min(used)
            room = gap + shortest
            spare = left[: room + 1].copy()
            for length, n in used.items():
                if length <= room:
                    spare[length] -= n
            first = np.flatnonzero(spare > 0)
            longest = np.maximum.accumulate(np.where(spare > 0, lengths[: room + 1], 0))
            second = longest[room - first]
            twice = (second == first) & (spare[first] < 2)
            second[twice] = longest[first[twice] - 1]
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > shortest:
                best = int(total.argmax())
                used[shortest] -= 1
                for length in (int(second[best]), int(first[best])):
                    used[length] = used.get(length, 0) + 1
                used = {length: n for length, n in used.items() if n}
        repeats = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * repeats
        plan.append((sorted(used.items(), reverse=True), repeats))
        if any(left[length] == 0 for length in used):
            open_lengths = [length for length in open_lengths if left[length]]
    return plan


def _places(plan) -> dict[str, np.ndarray]:
    """For every length and run of ranks: the first sequence, pieces a sequence, first offset."""
    rows, next_rank, next_sequence = [], {}, 0
    for runs, repeats in plan:
        offset = 0
        for length, n in runs:
            rank = next_rank.get(length, 0)
            rows.append(((length << 44) + rank, n, next_sequence, offset))
            next_rank[length] = rank + n * repeats
            offset += n * length
        next_sequence += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "n", "sequence", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to staged pieces."""
    total = pieces.count()
    parts = max(16, -(-total // RANKED_TOGETHER))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))

    # At most one row for each length up to the capacity.
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    places = _places(best_two_fit(counts))

    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        salted.withColumn("rank", F.row_number().over(own).cast("long"))
        .join(firsts, ["length", "salt"])
        .withColumn("rank", F.col("rank") - 1 + F.col("before"))
        .drop("salt", "before")
        .select(*pieces.columns, "rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.searchsorted(places["key"], (length << 44) + rank, side="right") - 1
            turn, slot = np.divmod(rank - (places["key"][row] - (length << 44)), places["n"][row])
            arrays = [batch.column(c) for c in batch.schema.names if c != "rank"]
            arrays += [pa.array(places["sequence"][row] + turn), pa.array(places["offset"][row] + slot * length)]
            yield pa.RecordBatch.from_arrays(arrays, [*[c for c in batch.schema.names if c != "rank"], "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece number, place in the document, place in its sequence."""
    pieces = token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids)
    return pack(stage(pieces, "pieces"), capacity)
