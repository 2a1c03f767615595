"""Canonical email table, cleaning and exact de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.functions import mail
from lurewatch.functions.labels import normalize_has_url, normalize_label
from lurewatch.functions.text import as_text, collapse_spaces, is_blank

CANONICAL_COLUMNS = [
    "source", "from_address", "subject", "body", "label", "text_combined", "has_url",
]
ORDER_COLUMNS = ["source_ord", "block_ord", "row_ord"]
CANONICAL_SCHEMA = (
    "source string, from_address string, subject string, body string, "
    "label int, text_combined string, has_url int"
)


def to_canonical(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Missing columns added, labels and flags normalised, unusable rows dropped.

    ``keep`` names further columns (ids, load order) to carry along.
    """
    present = set(df.columns)

    def column(name: str):
        return F.col(name) if name in present else F.lit(None)

    prepared = df.select(
        as_text(column("source")).alias("source"),
        as_text(column("from_address")).alias("from_address"),
        as_text(column("subject")).alias("subject"),
        as_text(column("body")).alias("body"),
        normalize_label(column("label")).alias("label"),
        normalize_has_url(column("has_url")).alias("has_url"),
        *(keep or []),
    ).filter(F.col("label").isNotNull() & ~is_blank(F.col("body")))
    combined = mail.combined_text(F.col("from_address"), F.col("subject"), F.col("body"))
    return prepared.withColumn("text_combined", combined).select(*CANONICAL_COLUMNS, *(keep or []))


def clean(df: DataFrame) -> DataFrame:
    """Keep 0/1 labels, collapse white space in the combined text, drop empty texts."""
    return (
        # Blank texts are told apart before collapsing: a filter on the result would be pushed
        # below the projection and run the replacement twice.
        df.filter(F.col("label").isin(0, 1) & ~is_blank(as_text(F.col("text_combined"))))
        .withColumn("label", F.col("label").cast("int"))
        .withColumn("text_combined", collapse_spaces(as_text(F.col("text_combined"))))
    )


def keep_first(df: DataFrame, order_by: list[str], text_col: str = "text_combined") -> DataFrame:
    """One row per distinct text: the first in load order.

    ``row_number() = 1`` lets Spark put a group limit in front of the exchange: each task ships at
    most one row per text, so a text that fills a third of the table costs one row per task.  The
    leading hash makes the sort compare eight bytes instead of whole texts.
    """
    window = Window.partitionBy("_text_hash", text_col).orderBy(*order_by)
    return (
        df.withColumn("_text_hash", F.xxhash64(text_col))
        .withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") == 1)
        .drop("_rank", "_text_hash")
    )
