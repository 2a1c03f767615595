"""Exact stratified train/validation/test split without moving rows.

Every row gets a hash of its key.  Within a label, the rows with the smallest hashes form the
test set, the next ones the validation set.  The two cut hashes per label are found by counting
hash prefixes -- narrow aggregations whose results are bounded by the prefix length -- and
descending into the prefix that holds the cut.  Assigning the split is then a comparison with
literals: no sort, no exchange, no group that could be too big for a task.

Rows with equal keys share a hash and therefore stay together on one side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PREFIX_STEP = 3  # hex digits added per level: at most 4096 prefixes below each open cut


@dataclass
class _Cut:
    """The ``rank``-th smallest hash of ``label`` (1-based), narrowed down by prefix."""

    label: int
    rank: int
    prefix: str = ""
    value: str | None = None


def split_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def split_sizes(n: int, val_size: float, test_size: float) -> tuple[int, int]:
    """Rows of one label for (validation, test), halves rounded up."""
    held_out = int(n * (val_size + test_size) + 0.5)
    test = int(held_out * test_size / (val_size + test_size) + 0.5)
    return held_out - test, test


def _locate(df: DataFrame, label_col: str, cuts: list[_Cut]) -> None:
    """Fill in the hash value of every cut."""
    open_cuts = list(cuts)
    while open_cuts:
        depth = len(open_cuts[0].prefix)
        wanted = sorted({(c.label, c.prefix) for c in open_cuts})
        inside = F.lit(False)
        for label, prefix in wanted:
            inside = inside | ((F.col(label_col) == label) & F.col("_hash").startswith(prefix))
        subset = df if depth == 0 else df.filter(inside)
        step = F.substring("_hash", 1, depth + _PREFIX_STEP).alias("prefix")
        counts: dict[tuple[int, str], list[tuple[str, int]]] = {}
        for row in (
            subset.groupBy(F.col(label_col).alias("label"), step)
            .agg(F.count("*").alias("n"))
            .collect()  # at most 4096 rows per open prefix
        ):
            counts.setdefault((row["label"], row["prefix"][:depth]), []).append(
                (row["prefix"], row["n"])
            )
        still_open: list[_Cut] = []
        for cut in open_cuts:
            for prefix, n in sorted(counts[(cut.label, cut.prefix)]):
                if cut.rank <= n:
                    cut.prefix = prefix
                    if cut.rank == n or len(prefix) >= 32:
                        # The cut ends with the last hash of the prefix.
                        cut.value = prefix.ljust(32, "f")
                    else:
                        still_open.append(cut)
                    break
                cut.rank -= n
        open_cuts = still_open


def stratified_split(
    df: DataFrame,
    val_size: float = 0.1,
    test_size: float = 0.1,
    seed: int = 42,
    key_col: str = "text_combined",
    label_col: str = "label",
    hash_col: str | None = None,
) -> DataFrame:
    """Add a ``split`` column (train/val/test) that keeps label proportions.

    ``key_col`` should identify a row; after de-duplication the combined text does.  Counting
    needs a few passes over label and hash; a table that has the hash already, in ``hash_col``,
    is not hashed again.
    """
    if val_size <= 0:
        raise ValueError("val_size must be > 0")
    if test_size <= 0:
        raise ValueError("test_size must be > 0")
    if val_size + test_size >= 1.0:
        raise ValueError("val_size + test_size must be less than 1.0")

    hashed = df.withColumn("_hash", F.col(hash_col) if hash_col else split_hash(F.col(key_col), seed))
    totals = {
        r["label"]: r["n"]
        for r in hashed.filter(F.col(label_col).isNotNull())
        .groupBy(F.col(label_col).alias("label"))
        .agg(F.count("*").alias("n"))
        .collect()
    }
    cuts: dict[int, tuple[_Cut, _Cut]] = {}
    for label, n in totals.items():
        val_n, test_n = split_sizes(n, val_size, test_size)
        if min(val_n, test_n, n - val_n - test_n) < 1:
            raise ValueError(
                f"Stratified split failed: {n} rows of label {label} cannot fill all three splits."
            )
        cuts[label] = (_Cut(label, test_n), _Cut(label, test_n + val_n))
    _locate(
        hashed.filter(F.col(label_col).isNotNull()).select(label_col, "_hash"),
        label_col,
        [cut for pair in cuts.values() for cut in pair],
    )
    split = F.lit(None).cast("string")
    for label, (test_cut, val_cut) in cuts.items():
        split = F.when(
            F.col(label_col) == label,
            F.when(F.col("_hash") <= test_cut.value, "test")
            .when(F.col("_hash") <= val_cut.value, "val")
            .otherwise("train"),
        ).otherwise(split)
    return hashed.withColumn("split", split).drop("_hash")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "label").agg(F.count("*").alias("emails"))
