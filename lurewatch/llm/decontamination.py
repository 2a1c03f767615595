"""Benchmark passages in documents, found by Wu-Manber search over words.

The patterns are windows of ``WINDOW`` consecutive benchmark words; an item with fewer words is
one pattern.  Patterns of equal length form one set, so no pattern is cut to a shorter one.  For
each set a shift table over blocks of two words says how far the search may jump; where it says
zero, the block's bucket names the patterns that end so, and these are compared word by word.
Many stretches of a batch of documents are searched side by side.

Windows are cut and made distinct in Spark.  They go to the tasks in shards of at most about
``SHARD_WINDOWS`` (window, item) pairs; a benchmark of any size is searched shard after shard.  The
documents are written once if there are several, and each shard after the first writes only the
marked words and items of the documents it hits.

Words are maximal runs of digits, letters a-z and characters beyond ASCII after lower-casing A-Z.
Null and empty texts have no words and no hits; items without words match nothing.  Repeated rows
are searched each; repeated items count once per id, and ids are compared as strings.  Null item
ids match but name no item.  With an empty benchmark nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.llm.common import text_slices
from lurewatch.session import stage

WINDOW = 10
SHARD_WINDOWS = 200_000
# Bytes of text that are searched together.
SEARCHED_BYTES = 2 << 20
# Last words of windows that one lane of the search walks over.
LANE = 512
# (position, pattern) pairs that are compared at once.
COMPARED_TOGETHER = 1 << 16
HITS = T.StructType().add("hit_words", T.ArrayType(T.LongType())).add("items", T.ArrayType(T.StringType()))

# A-Z become a-z; what is no word character becomes a space.
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def word_array(text: Column) -> Column:
    """The words of a text, in Spark's own functions."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spaced = F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.filter(F.split(F.coalesce(spaced, F.lit("")), " "), lambda w: w != "")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``window`` (words joined by a space) and ``item`` (id as text), distinct."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    cut = rows.filter(F.size("w") > 0).select("item", "w", F.explode(starts).alias("at"))
    return cut.select(
        F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " ").alias("window"), "item"
    ).distinct()


class PatternSet:
    """Patterns of one length with their shift table and suffix buckets."""

    def __init__(self, patterns: np.ndarray):
        self.patterns, self.length = patterns, patterns.shape[1]
        self.block = min(2, self.length)
        bits = max(10, min(22, int(len(patterns) * self.length * 4).bit_length()))
        self.mask = (1 << bits) - 1
        furthest = self.length - self.block + 1
        self.shift = np.full(1 << bits, furthest, np.int32)
        for end in range(self.block, self.length + 1):
            keys = self._key(patterns[:, end - 2] if self.block == 2 else None, patterns[:, end - 1])
            np.minimum.at(self.shift, keys, self.length - end)
        last = self._key(patterns[:, -2] if self.block == 2 else None, patterns[:, -1])
        self.order = np.argsort(last, kind="stable")
        self.bucket_keys, self.bucket_start, self.bucket_size = np.unique(last[self.order], return_index=True, return_counts=True)

    def _key(self, before: np.ndarray | None, word: np.ndarray) -> np.ndarray:
        mixed = word.astype(np.int64) * 0x9E3779B1
        if before is not None:
            mixed = mixed + before.astype(np.int64) * 0x85EBCA77
        return (mixed ^ (mixed >> 15)) & self.mask

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End positions of occurrences in ``words`` and the pattern found at each."""
        n = len(words)
        begin = np.arange(self.length - 1, n, LANE)
        at, stop = begin.copy(), np.minimum(begin + LANE, n)
        ends, found = [], []
        while len(at):
            shift = self.shift[self._key(words[at - 1] if self.block == 2 else None, words[at])]
            if len(stopped := at[shift == 0]):
                for end, pattern in self._confirmed(words, stopped):
                    ends.append(end)
                    found.append(pattern)
            at = at + np.maximum(shift, 1)
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]
        empty = np.zeros(0, np.int64)
        return (np.concatenate(ends), np.concatenate(found)) if ends else (empty, empty)

    def _confirmed(self, words: np.ndarray, ends: np.ndarray):
        keys = self._key(words[ends - 1] if self.block == 2 else None, words[ends])
        bucket = np.searchsorted(self.bucket_keys, keys)
        bucket[bucket == len(self.bucket_keys)] = 0
        hit = self.bucket_keys[bucket] == keys
        ends, bucket = ends[hit], bucket[hit]
        sizes = self.bucket_size[bucket]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        total = int(bounds[-1])
        for low in range(0, total, COMPARED_TOGETHER):
            pair = np.arange(low, min(low + COMPARED_TOGETHER, total))
            row = np.searchsorted(bounds, pair, side="right") - 1
            pattern = self.order[self.bucket_start[bucket[row]] + pair - bounds[row]]
            end = ends[row]
            for back in range(self.length):  # from the end, and only what still agrees
                same = words[end - back] == self.patterns[pattern, self.length - 1 - back]
                end, pattern = end[same], pattern[same]
                if not len(end):
                    break
            if len(end):
                yield end, pattern


class Searcher:
    def __init__(self, shard: list[tuple[str, list[str]]]):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, tuple[list, list]] = {}
        for window, items in shard:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window.encode().split(b" ")]
            patterns, owners = by_length.setdefault(len(ids), ([], []))
            patterns.append(ids)
            owners.append([i for i in items if i is not None])
        self.sets = [(PatternSet(np.array(p, np.int32)), o) for p, o in by_length.values()]

    def word_ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words of all texts in a row, a 0 after each text, and the number of words of each.

        A word that no pattern has is a 0 as well, so no occurrence spans two texts.
        """
        get, parts, sizes = self.vocabulary.get, [], []
        for text in texts:
            words = text.encode().translate(_BYTES).split() if text else []
            sizes.append(len(words))
            parts += [get(w, 0) for w in words]
            parts.append(0)
        return np.array(parts, np.int32), np.array(sizes, np.int64)

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
        """Words of each text, the sorted numbers of its hit words, and the items found."""
        words, sizes = self.word_ids(texts)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        marks = np.zeros(len(words) + 1, np.int64)
        items: list[set[str]] = [set() for _ in texts]
        for patterns, owners in self.sets:
            ends, found = patterns.search(words)
            np.add.at(marks, ends - patterns.length + 1, 1)
            np.add.at(marks, ends + 1, -1)
            text = np.searchsorted(begins, ends, side="right") - 1
            for row, pattern in {*zip(text.tolist(), found.tolist(), strict=True)}:
                items[row].update(owners[pattern])
        hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        owner = np.searchsorted(begins, hit, side="right") - 1
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        return sizes, [hit[bounds[i] : bounds[i + 1]] - begins[i] for i in range(len(texts))], items


def find_passages(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    size: int = WINDOW, keep: list[str] | None = None,
) -> DataFrame:
    """``id, n_words, hit_words, items`` and the columns in ``keep``: which words of a document
    stand inside an occurrence, by number, and the ids of the items found, sorted."""
    keep = keep or []
    pairs = stage(windows(items, size=size), "benchmark-windows")
    shards = max(1, -(-pairs.count() // SHARD_WINDOWS))
    sharded = pairs.withColumn("shard", F.pmod(F.xxhash64("window", "item"), F.lit(shards)))

    def sent(number: int):
        # Bounded by SHARD_WINDOWS pairs; a window's items may be spread over shards.
        rows = sharded.filter(F.col("shard") == number).groupBy("window").agg(F.collect_list("item").alias("items"))
        return docs.sparkSession.sparkContext.broadcast([(r.window, list(r["items"])) for r in rows.collect()])

    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), *HITS.fields])
    found = rows.mapInArrow(_search_step(sent(0)), schema)
    if shards > 1:
        found = _with_further_shards(found, sent, shards)
    names = [F.col(f"_{i}").alias(c) for i, c in enumerate(keep)]
    return found.select(F.col("_id").alias(id_col), "n_words", "hit_words", "items", *names)


def _with_further_shards(found: DataFrame, sent, shards: int) -> DataFrame:
    """What the first shard found, merged with the hits of the others.

    The table is written once, with a number per row.  Every further shard reads numbers and
    texts back and writes the rows it hits, without their texts; a row has at most one such
    entry a shard.
    """
    held = stage(found.withColumn("_row", F.monotonically_increasing_id()), "benchmark-first-shard")
    parts = [held.filter(F.size("hit_words") > 0).select("_row", *HITS.names)]
    schema = T.StructType([held.schema["_row"], *HITS.fields])
    for number in range(1, shards):
        shard = sent(number)
        hits = held.select("_row", "text").mapInArrow(_search_step(shard, hits_only=True), schema)
        parts.append(stage(hits, "benchmark-hits"))
        shard.unpersist()
    merged = reduce(DataFrame.unionAll, parts).groupBy("_row").agg(
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in HITS.names]
    )
    columns = [c for c in held.columns if c not in ("text", *HITS.names)]
    empty = {f.name: F.array().cast(f.dataType) for f in HITS.fields}
    return (
        held.select(*columns).join(merged, "_row", "left")
        .select(*columns, *[F.coalesce(c, empty[c]).alias(c) for c in HITS.names])
    )


def _search_step(sent, hits_only: bool = False):
    """Adds what the windows of a shard hit; with ``hits_only`` to the rows that are hit, in place
    of their text and number of words."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = None
        for batch in text_slices(batches, "text", SEARCHED_BYTES):
            searcher = searcher or Searcher(sent.value)
            sizes, hits, items = searcher.hits(batch.column("text").to_pylist())
            columns = {name: batch.column(name) for name in batch.schema.names}
            if hits_only:
                del columns["text"]
            else:
                columns["n_words"] = pa.array(sizes)
            columns["hit_words"] = pa.array(hits, pa.list_(pa.int64()))
            columns["items"] = pa.array([sorted(names) for names in items], pa.list_(pa.string()))
            out = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            yield out.filter(pa.array([len(h) > 0 for h in hits], pa.bool_())) if hits_only else out

    return step


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: words, hit words, items and a digest of their ids."""
    return find_passages(docs, items).select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def clean_of_passages(docs: DataFrame, items: DataFrame, share: float = 0.0) -> DataFrame:
    """The documents of which at most ``share`` of the words are benchmark text; all columns."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    # The text travels inside the row and once more for the search, within one stage.
    found = find_passages(
        rows.select("row", F.lit(0).alias("doc_id"), F.col("row.text").alias("text")), items, keep=["row"]
    )
    kept = found.filter(F.size("hit_words") <= share * F.col("n_words"))
    return kept.select("row.*")
