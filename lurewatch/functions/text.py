"""Text expressions: stripping, counting, entropy.

All built-in Spark expressions but :func:`char_profile`, which counts the characters of Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from lurewatch import constants as K


def as_text(c: Column) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Trim Unicode white space; looks only at the ends of the value."""
    return F.btrim(c, F.lit(K.SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def collapse_spaces(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.btrim(F.regexp_replace(c, f"(?U)[{K.SPACE_CLASS}]+", " "))


_LINE_BREAK = r"[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"


def normalise_lines(c: Column) -> Column:
    """Squeeze blanks and drop blank lines, as message bodies are stored."""
    squeezed = F.regexp_replace(c, r"[ \t]+", " ")
    # From one line break to the last one of the same white-space run: a single new line.
    one_break = F.regexp_replace(
        squeezed, f"(?U){_LINE_BREAK}(?:[{K.SPACE_CLASS}]*{_LINE_BREAK})?", "\n"
    )
    return strip(one_break)


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_one_of(c: Column, values: list[str]) -> Column:
    """Membership in a list of constants.

    The list is one literal array, so building the expression takes two calls into the JVM
    however long it is.
    """
    return F.array_contains(F.expr(f"array({', '.join(map(sql_text, values))})"), c)


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def count_char(c: Column, char: str) -> Column:
    """Occurrences of one character, by length difference (no match array is built)."""
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def count_chars(c: Column, chars: str) -> Column:
    """Occurrences of any of a few characters."""
    rest = c
    for char in chars:
        rest = F.replace(rest, F.lit(char), F.lit(""))
    return F.length(c) - F.length(rest)


def count_tags(c: Column) -> Column:
    """Markup tags.  Text after the last ``>`` cannot hold one and is cut off first, so a long
    run of ``<`` without a closing bracket costs linear time."""
    tail = F.length(F.substring_index(c, ">", -1))
    return count_matches(F.substr(c, F.lit(1), F.length(c) - tail), K.HTML_TAG_PATTERN)


def count_words(c: Column) -> Column:
    return count_matches(c, f"(?U)[^{K.SPACE_CLASS}]+")


# --- term lists -----------------------------------------------------------------------------


def lexicon_hits(c: Column, lexicons: list[str]) -> Column:
    """All whole-word hits of the named term lists as one short string, ``|term|term|``.

    Texts are scanned once for all lists; the per-list tests then look at the hits only.  That
    is exact because no term of one list overlaps a term of another.
    """
    pattern = K.whole_words([t for name in lexicons for t in K.LEXICONS[name]])
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.concat(F.lit("|"), F.array_join(hits, "|"), F.lit("|"))


def _listed(lexicon: str) -> str:
    return f"(?iU)(?<=\\|)(?:{'|'.join(K.LEXICONS[lexicon])})(?=\\|)"


def has_lexicon(hits: Column, lexicon: str) -> Column:
    return hits.rlike(_listed(lexicon))


def count_lexicon(hits: Column, lexicon: str) -> Column:
    return count_matches(hits, _listed(lexicon))


# --- characters -----------------------------------------------------------------------------

_ASCII_SPACE = np.array([chr(b).isspace() and b < 128 for b in range(256)])
_CURRENCY = np.array([ord(c) for c in K.CURRENCY_SYMBOLS])
# Spelled with types, since text is parsed by a session and this module is imported without one.
_PROFILE = StructType().add("entropy", DoubleType()).add("words", IntegerType()).add("currency", IntegerType())


@F.arrow_udf(_PROFILE)
def char_profile(texts: pa.Array) -> pa.Array:
    """Entropy, words and currency symbols of a text, from one pass over its characters.

    No built-in expression counts all characters of a value at once; one replacement a character
    costs several times as much as handing the text to numpy.  No exchange; linear in the text, a
    text at a time, whatever its alphabet.  Null for null.
    """
    data, starts = _utf8(texts)
    rows = len(texts)
    entropy, words, currency = np.zeros(rows), np.zeros(rows, np.int32), np.zeros(rows, np.int32)
    for row in range(rows):
        value = data[starts[row] : starts[row + 1]]
        counts = np.bincount(value, minlength=256)
        if counts[128:].any():
            decoded = value.tobytes().decode("utf-8", "replace")
            codes = np.frombuffer(decoded.encode("utf-32-le"), np.uint32)
            others = codes[codes > 127]
            currency[row] = np.isin(others, _CURRENCY).sum()
            words[row] = len(decoded.split())
            counts = np.concatenate([counts[:128], np.unique(others, return_counts=True)[1]])
        elif len(value):
            space = _ASCII_SPACE[value]
            words[row] = np.count_nonzero(space[:-1] > space[1:]) + (not space[0])
        currency[row] += counts[_CURRENCY[_CURRENCY < 128]].sum()
        entropy[row] = _entropy(counts[counts > 0])
    columns = [pa.array(entropy), pa.array(words), pa.array(currency)]
    missing = texts.is_null() if texts.null_count else None
    return pa.StructArray.from_arrays(columns, ["entropy", "words", "currency"], mask=missing)


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string array, and where each of them starts (one more: ends)."""
    _, offsets, values = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, kind)
    starts = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8), starts


def _entropy(counts: np.ndarray) -> float:
    """Shannon entropy in bits; 0 without characters."""
    n = counts.sum()
    return float(np.log2(n) - (counts * np.log2(counts)).sum() / n) if n else 0.0


def char_entropy(c: Column) -> Column:
    """Shannon entropy in bits over the characters of the value; 0 for the empty string."""
    return char_profile(c)["entropy"]
