"""URL and domain expressions.

All of them compile to code-generated built-ins.  Rules about *any* URL of a message work on
``url_text`` -- the extracted URLs joined by single spaces, lower-cased -- because URLs hold no
white space: one pattern anchored at the start of each URL then replaces a lambda over an array,
which would take the whole stage out of code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions.text import is_one_of, strip


def extract_urls(c: Column) -> Column:
    """All http/https URLs in order.  The substring test spares most texts the pattern."""
    return F.when(
        c.contains("://"), F.regexp_extract_all(c, F.lit(K.URL_PATTERN), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))


def joined_urls(urls: Column) -> Column:
    return F.lower(F.array_join(urls, " "))


def first_of(urls: Column) -> Column:
    return F.coalesce(F.get(urls, 0), F.lit(""))


def netloc(url: Column) -> Column:
    """Lower-cased network location up to the first colon.

    User info stays part of it.  Unbalanced brackets, and bracketed hosts that cannot be an IP
    literal, give the empty string.  (Look-alike characters that normalise to ``/?#@:`` are not
    rejected.)
    """
    authority = F.lower(F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.-]*)://([^/?#]*)", 1))
    brackets = F.regexp_extract(authority, r"^[^\[\]]*\[([^\[\]]*)\][^\[\]]*$", 1)
    plausible = brackets.rlike(r"^(?:[0-9a-f.]*:[0-9a-f.]*:[0-9a-f.:]*(?:%.*)?|v[0-9a-f]+\..+)$")
    host = F.substring_index(authority, ":", 1)
    return F.when(~authority.rlike(r"[\[\]]") | plausible, host).otherwise(F.lit(""))


def is_ip(domain: Column) -> Column:
    return domain.rlike(K.IP_PATTERN)


def root_domain(domain: Column) -> Column:
    """Last two labels, or three below a listed two-level suffix."""
    d = F.lower(strip(domain))
    labels = F.regexp_replace(F.btrim(d, F.lit(".")), r"\.{2,}", ".")
    last_two = F.substring_index(labels, ".", -2)
    return (
        F.when(~labels.contains("."), d)
        .when(is_one_of(last_two, K.TWO_LEVEL_SUFFIXES), F.substring_index(labels, ".", -3))
        .otherwise(last_two)
    )


# --- links in running text ------------------------------------------------------------------


def has_shortener(c: Column) -> Column:
    return c.rlike(K.SHORTENER_HINT) & c.rlike(K.SHORTENER_PATTERN)


def count_shorteners(c: Column) -> Column:
    return F.when(
        c.rlike(K.SHORTENER_HINT), F.regexp_count(c, F.lit(K.SHORTENER_PATTERN))
    ).otherwise(0)


def count_bare_domains(c: Column) -> Column:
    """Domains written without a scheme; real URLs are blanked out first."""
    without_urls = F.when(
        c.contains("://"), F.regexp_replace(c, K.URL_PATTERN, " ")
    ).otherwise(c)
    return F.when(
        without_urls.rlike(K.BARE_DOMAIN_HINT),
        F.regexp_count(without_urls, F.lit(K.BARE_DOMAIN_PATTERN)),
    ).otherwise(0)


# --- any-URL tests over joined_urls() -------------------------------------------------------

# After the part of interest: optional port or rest of the authority, then the end of it.  A
# bracket anywhere in the authority means there is no usable host.
_START = r"(?:^| )https?://"
_END = r"(?::[^/?#\[\] ]*)?(?:[/?# ]|$)"
_HOST_CHARS = r"[^/?#:\[\] ]*"


def any_ip(url_text: Column) -> Column:
    return url_text.rlike(_START + r"\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}" + _END)


def any_risky_tld(url_text: Column) -> Column:
    tlds = "|".join(K.RISKY_TLDS)
    return url_text.rlike(f"{_START}(?:{_HOST_CHARS}\\.)?(?:{tlds})\\.*{_END}")


def any_punycode(url_text: Column) -> Column:
    return url_text.rlike(f"{_START}{_HOST_CHARS}(?:xn--|[^\\x00-\\x7f]){_HOST_CHARS}{_END}")


# --- links taken from markup ----------------------------------------------------------------


def is_safelink(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.-]*)://([^/?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return host.contains(K.SAFELINKS_HOST) & query.rlike(r"(?:^|&)url=[^&]")


def unwrap_safelink(url: Column) -> Column:
    """Target of a wrapped link, percent-decoded twice (plus means space only the first time)."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    value = F.regexp_extract(query, r"(?:^|&)url=([^&]+)", 1)
    once = F.coalesce(F.try_url_decode(value), value)
    twice = F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once)
    return F.when(is_safelink(url), twice).otherwise(url)


def is_tracking(url: Column) -> Column:
    """Open/click tracking path words; note that ``//`` lets a host name match as well."""
    return url.rlike(K.TRACKING_PATTERN)


def clean_hrefs(hrefs: Column) -> Column:
    """http links only, unwrapped, tracking links dropped, first occurrence kept."""
    http_only = F.filter(hrefs, lambda h: h.startswith("http"))
    unwrapped = F.transform(http_only, unwrap_safelink)
    return F.array_distinct(F.filter(unwrapped, lambda h: ~is_tracking(h)))
