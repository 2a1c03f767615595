"""Removal of lines or paragraphs that another document, or the same one, has had before.

A text is cut into units: lines, or paragraphs between blank lines.  Units are compared by the
128-bit digest of their normalised form (lower case, runs of white space as one space, none at
the ends).  Of equal units the earliest by (rank, place) stays; the others are removed.  Every
unit keeps its offsets in the original text, in code points.  A unit of more than one sentence
is also compared by its sentences, so that a passage is found where it was set into a longer line
and a line with one word edited still loses its other sentences.

Digests meet their earliest occurrence in a grouping that keeps one row per digest and task, so a
line that a third of the documents have is no hot spot there.  Only digests that occur more than
once are joined back.  They are written out first: both sides of that join then have an exchange
right below their sort, which Spark's splitting of skewed joins asks for, so the units of a hot
digest are dealt to several tasks.

Units with fewer than ``least_words`` words are never removed; with 1 only blank units are exempt,
as in the registered query.  Sentences need ``SENTENCE_WORDS`` words in any case, since a short one
inside a line says little.  Null texts and texts without such units lose nothing; rows with a null rank lose nothing and keep nothing from others.  Repeated
rows of one id are one document: what stays in one of them stays in all.  Columns other than rank
and text are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import text_slices
from lurewatch.session import stage

LEAST_WORDS = 5
SENTENCE_WORDS = 5
BREAKS = {"line": r"\n", "paragraph": r"\n[ \t]*\n\s*"}
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def _cuts(text: str, begin: int, end: int, breaks: re.Pattern) -> Iterator[tuple[int, int]]:
    for found in breaks.finditer(text, begin, end):
        yield begin, found.start()
        begin = found.end()
    yield begin, end


def unit_table(
    docs: DataFrame, rank_col: str = "doc_id", text_col: str = "text", unit: str = "line",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``rank, start, end, level, d1, d2``: places and digests of all units that may go."""
    breaks = re.compile(BREAKS[unit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in text_slices(batches, "text", 2 << 20):
            rows, starts, ends, levels, high, low = [], [], [], [], [], []

            def add(row, text, start, end, level):
                words = text[start:end].lower().split()
                if len(words) >= (SENTENCE_WORDS if level else max(least_words, 1)):
                    digest = xxhash.xxh3_128_intdigest(" ".join(words))
                    rows.append(row)
                    starts.append(start)
                    ends.append(end)
                    levels.append(level)
                    high.append((digest >> 64) - (1 << 63))
                    low.append((digest & (1 << 64) - 1) - (1 << 63))

            for row, text in enumerate(batch.column("text").to_pylist()):
                for start, end in _cuts(text, 0, len(text), breaks):
                    add(row, text, start, end, 0)
                    inner = list(_cuts(text, start, end, SENTENCE_END))
                    for begin, stop in inner if len(inner) > 1 else []:
                        add(row, text, begin, stop, 1)
            arrays = [batch.column("rank").take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(c, pa.int64()) for c in (starts, ends, levels, high, low)]
            yield pa.RecordBatch.from_arrays(arrays, ["rank", "start", "end", "level", "d1", "d2"])

    rows = docs.select(F.col(rank_col).alias("rank"), F.col(text_col).alias("text"))
    rows = rows.filter("rank is not null and text is not null")
    kind = dict(docs.dtypes)[rank_col]
    return rows.mapInArrow(run, f"rank {kind}, start long, end long, level long, d1 long, d2 long")


def repeated_units(
    docs: DataFrame, rank_col: str = "doc_id", text_col: str = "text", unit: str = "line", least_words: int = LEAST_WORDS
) -> DataFrame:
    """One row per unit to remove: its document and offsets, and where the kept one stands."""
    table = stage(unit_table(docs, rank_col, text_col, unit, least_words), "units")
    place = F.struct("rank", "start")
    firsts = table.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = stage(firsts.filter("first <> last").select("d1", "d2", "first"), "repeated-units")
    later = table.join(firsts, ["d1", "d2"]).filter(place > F.col("first"))
    return later.select(
        F.col("rank").alias(rank_col), "start", "end",
        F.when(F.col("level") == 0, unit).otherwise("sentence").alias("unit"),
        F.col("first.rank").alias(f"kept_{rank_col}"), F.col("first.start").alias("kept_start"),
    )


def without_repeats(
    docs: DataFrame, rank_col: str = "doc_id", text_col: str = "text", unit: str = "line", least_words: int = LEAST_WORDS
) -> DataFrame:
    """All rows and columns, with the repeated units cut out of the text.

    A removed unit leaves its line break, so the lines around it stay lines.
    """
    gone = repeated_units(docs, rank_col, text_col, unit, least_words).groupBy(F.col(rank_col).alias("_rank")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_gone")
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.col(f"`{text_col}`")

    def part(begin, end):
        return F.substr(text, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))

    def step(state, s):
        out = F.concat(state["out"], part(state["at"], s["start"]))
        return F.struct(out.alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    cut = F.aggregate("_gone", start, step, lambda s: F.concat(s["out"], part(s["at"], F.length(text).cast("long"))))
    joined = docs.join(gone, F.col(f"`{rank_col}`") == F.col("_rank"), "left")
    return joined.select(
        *[F.when(F.col("_gone").isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    )
