"""Message-header expressions: addresses, attachments, DKIM results, combined text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions.text import as_text, strip


def combined_text(from_address: Column, subject: Column, body: Column) -> Column:
    return F.concat(
        F.lit("FROM: "), as_text(from_address),
        F.lit(" SUBJECT: "), as_text(subject),
        F.lit(" BODY: "), as_text(body),
    )


def bare_address(header: Column) -> Column:
    """``a@b`` out of ``Name <a@b>``; the whole header when there are no brackets."""
    inner = F.regexp_extract(header, "<([^>]+)>", 1)
    return strip(F.when(inner != "", inner).otherwise(header))


def sender_domain(from_address: Column) -> Column:
    """Domain of a stripped, lower-cased address; empty unless it ends the value."""
    return F.regexp_extract(from_address, f"(?U)@([^{K.SPACE_CLASS}@]+)$", 1)


def sender_local(from_address: Column) -> Column:
    return F.regexp_extract(from_address, f"(?U)^([^@{K.SPACE_CLASS}]+)@", 1)


def domain_after_at(from_address: Column) -> Column:
    """What follows the last ``@``, lower-cased, without stripping (rules and trust use this)."""
    address = F.lower(as_text(from_address))
    return F.when(address.contains("@"), F.substring_index(address, "@", -1)).otherwise(F.lit(""))


def attachment_extensions(filenames: Column) -> Column:
    """Lower-cased text from the last dot of every name that has one."""
    dotted = F.filter(filenames, lambda n: n.contains("."))
    return F.transform(
        dotted, lambda n: F.lower(F.concat(F.lit("."), F.substring_index(n, ".", -1)))
    )


DKIM_PASS_PATTERN = (
    f"(?iU)(?<![{K.WORD_CLASS}])dkim[{K.SPACE_CLASS}]*=[{K.SPACE_CLASS}]*pass(?![{K.WORD_CLASS}])"
)
DKIM_DOMAIN_PATTERN = (
    f"(?iU)header\\.[id][{K.SPACE_CLASS}]*=[{K.SPACE_CLASS}]*@?([{K.WORD_CLASS}.\\-]+)"
)


def dkim_header(auth_headers: Column) -> Column:
    """First authentication header that reports a DKIM pass, else null."""
    return F.get(F.filter(auth_headers, lambda h: h.rlike(DKIM_PASS_PATTERN)), 0)


def dkim_domain(passing_header: Column) -> Column:
    """First ``header.i``/``header.d`` domain of that header, lower-cased, else null."""
    domain = F.lower(F.regexp_extract(passing_header, DKIM_DOMAIN_PATTERN, 1))
    return F.when(domain != "", domain)
