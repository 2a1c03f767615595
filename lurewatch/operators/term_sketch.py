"""The most frequent terms of a corpus without exact counts of all others.

Exact counts of every distinct term send each of them through an exchange, and most terms of a
large corpus are rare.  Here the same answer comes from narrow passes:

1. The most frequent terms of a bounded sample of texts are a first guess.  They are counted
   exactly; the count of the last wanted one is a lower bound of what it takes to be in the answer.
2. A sketch counts all terms of all texts in hash cells, several rows of them: a bounded number of
   counters.  The total of a cell is an upper bound of the count of any term in it.
3. Only terms none of whose cells lies under the bound are counted exactly.

No term of the answer can be lost: its count reaches the bound, and none of its cells counts less.
Sample and sketch decide only how much is left to the last pass.  Texts are cut into tokens once;
the passes read the counts of runs of texts, which are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.operators.term_weights import counted_terms, summed_terms, term_stats, vocabulary
from lurewatch.session import stage

# Rows of the sketch and cells of each, and texts of the sample: bounded, whatever the corpus.
ROWS, CELLS = 3, 1 << 18
SAMPLE_TEXTS = 2000


def _cell(row: int, term: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(row), term), F.lit(CELLS))


def sketch(terms: DataFrame, times: Column | None = None) -> DataFrame:
    """``row, cell, n``: how many of ``terms (term)``, each so many ``times``, fall into each cell
    of each row."""
    cells = [F.struct(F.lit(row).alias("row"), _cell(row, F.col("term")).alias("cell")) for row in range(ROWS)]
    return terms.select(F.explode(F.array(*cells)).alias("c"), (F.lit(1) if times is None else times).alias("n")).groupBy("c.row", "c.cell").agg(F.sum("n").alias("n"))


def least_count(
    df: DataFrame, wanted: int, text_col: str = "text_combined", min_df: int = 3, counted: DataFrame | None = None
) -> int:
    """A lower bound of the count of the last of the ``wanted`` most frequent terms; 0 if the
    guess holds too few terms to tell.  ``counted`` is ``counted_terms`` of the texts, if stored."""
    counted = counted_terms(df, text_col) if counted is None else counted
    # The texts of the smallest hashes: Spark keeps SAMPLE_TEXTS of them in each task.
    sample = df.select(text_col).orderBy(F.xxhash64(text_col), text_col).limit(SAMPLE_TEXTS)
    guessed = stage(vocabulary(term_stats(sample, text_col, 1), wanted).select("term"), "guessed-terms")
    exact = summed_terms(counted.join(guessed, "term", "left_semi"), min_df)
    found = exact.agg(F.count("*").alias("n"), F.min("tf").alias("least")).first()
    return int(found["least"]) if found["n"] >= wanted else 0


def frequent_terms(
    df: DataFrame, text_col: str = "text_combined", max_features: int = 20_000, min_df: int = 3
) -> DataFrame:
    """The same as ``vocabulary(term_stats(df, text_col, min_df), max_features)``."""
    counted = stage(counted_terms(df, text_col), "counted-terms")
    least = least_count(df, max_features, text_col, min_df, counted)
    # At most ROWS * CELLS rows.
    high = stage(sketch(counted, F.col("tf")).filter(F.col("n") >= least), "sketch")

    def may_reach(rows: DataFrame) -> DataFrame:
        for row in range(ROWS):
            cells = high.filter(F.col("row") == row).select(F.col("cell").alias("_cell"))
            rows = rows.withColumn("_cell", _cell(row, F.col("term"))).join(cells, "_cell", "left_semi").drop("_cell")
        return rows

    return vocabulary(summed_terms(may_reach(counted), min_df), max_features)
