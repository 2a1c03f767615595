"""Normalising labels and flags to 0/1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions.text import is_one_of, strip


def _binary(c: Column, positive: list[str], negative: list[str]) -> Column:
    # Booleans and 0/1 numbers print as members of the same vocabularies.
    text = F.lower(strip(c.cast("string")))
    return F.when(is_one_of(text, positive), F.lit(1)).when(is_one_of(text, negative), F.lit(0)).cast("int")


def normalize_label(c: Column) -> Column:
    """1 for phishing spellings, 0 for benign ones, null for anything else."""
    return _binary(c, K.LABEL_POSITIVE, K.LABEL_NEGATIVE)


def normalize_has_url(c: Column) -> Column:
    """1/0 for yes/no spellings, null for anything else."""
    return _binary(c, K.FLAG_POSITIVE, K.FLAG_NEGATIVE)


# Decimal numbers; letters that a cast would accept behind one (1d, 0f) are not part of it.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number_of(c: Column) -> Column:
    """The number a column holds or spells out, null for anything else."""
    spelled = F.when(c.cast("string").rlike(NUMBER), c.try_cast("double"))
    return F.when(F.typeof(c) == "string", spelled).otherwise(c.try_cast("double"))


def pandas_missing(c: Column) -> Column:
    """Null for the spellings CSV readers commonly take as missing (``NA``, ``null``, ...)."""
    return F.when(~is_one_of(c, K.CSV_NA_VALUES), c)
