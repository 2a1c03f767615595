"""Similarity of domains to known brands.

The similarity ratio (longest matching blocks) has no built-in counterpart, so it runs in a
vectorised Python function that only receives the short domain strings.  Its results are
remembered per worker, because mail domains repeat heavily; rows are neither shuffled nor joined,
so a domain that fills a third of the table is no hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions.text import is_one_of, sql_text, strip

MATCH_SCHEMA = "best_brand string, similarity double, edit_distance int"
REMEMBERED = 1 << 16  # domains that a worker keeps; a full store is emptied
NO_DISTANCE = 999  # fixed value: distance reported when there is nothing to compare


def normalize_domain(c: Column) -> Column:
    """Without scheme and ``www.``, cut at the first slash and colon."""
    bare = F.regexp_replace(F.lower(strip(c)), "^(?:https?://)?(?:www\\.)?", "")
    return F.substring_index(F.substring_index(bare, "/", 1), ":", 1)


def registrable_domain(normalized: Column) -> Column:
    """The last two labels, whatever the suffix."""
    labels = F.regexp_replace(F.btrim(normalized, F.lit(".")), r"\.{2,}", ".")
    return F.when(~labels.contains("."), normalized).otherwise(F.substring_index(labels, ".", -2))


def domain_label(normalized: Column) -> Column:
    """First label of the registrable domain."""
    return F.substring_index(registrable_domain(normalized), ".", 1)


def _label(domain: str) -> str:
    labels = [part for part in domain.split(".") if part]
    return labels[-2] if len(labels) >= 2 else domain.split(".")[0]


def similarity_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks over those of both strings; 0 for an empty one."""
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def best_similarity(domain: str, brands: Sequence[str]) -> list[float]:
    """Per brand: the better of the whole-domain and the label ratio."""
    label = _label(domain)
    return [max(similarity_ratio(domain, b), similarity_ratio(label, _label(b))) for b in brands]


def _brand_similarities(brands: tuple[str, ...]):
    """Similarities of several domains of a row at once: an array per domain, null for an empty
    one.  The distinct domains of a batch are matched once, and remembered by the worker."""
    remembered: dict[str, list[float]] = {}

    @F.pandas_udf("array<array<double>>")
    def similarities(domains: pd.Series) -> pd.Series:
        if len(remembered) > REMEMBERED:
            remembered.clear()
        for domain in {d for row in domains for d in row if d and d not in remembered}:
            remembered[domain] = best_similarity(domain, brands)
        return pd.Series([[remembered.get(d) for d in row] for row in domains])

    return similarities


def normalized_brands(brands: Sequence[str]) -> list[str]:
    """Brand domains in the form :func:`normalize_domain` gives them."""
    result = []
    for brand in brands:
        text = (brand or "").strip().lower()
        for prefix in ("https://", "http://"):
            if text.startswith(prefix):
                text = text[len(prefix):]
                break
        text = text.removeprefix("www.").split("/")[0].split(":")[0]
        if text:
            result.append(text)
    return result


def with_brand_match(
    df: DataFrame,
    domains: dict[str, str],
    brand_domains: Sequence[str] | None = None,
    similarity_threshold: float = 0.8,
    max_edit_distance: int = 2,
) -> DataFrame:
    """Brand metrics of one or more domain columns; ``domains`` maps column prefix to column.

    Adds ``<prefix>best_brand``, ``similarity``, ``edit_distance``, ``exact_match``,
    ``punycode``, ``non_ascii`` and ``typosquat``.  Only the similarities come from Python, for
    all columns in one pass.  Distances are the built-in ``levenshtein``, and the choice of the
    best brand (higher similarity, then smaller distance, then earlier brand) is the greatest of
    one struct per brand.
    """
    brands = normalized_brands(K.KNOWN_BRAND_DOMAINS if brand_domains is None else brand_domains)
    out = df.withColumns(
        {
            f"{p}norm": normalize_domain(F.coalesce(F.col(c), F.lit("")))
            for p, c in domains.items()
        }
    )
    if brands:
        similarities = _brand_similarities(tuple(brands))
        out = (
            out.withColumn("_sims", similarities(F.array(*[F.col(f"{p}norm") for p in domains])))
            .withColumns(
                {f"{p}label": domain_label(F.col(f"{p}norm")) for p in domains}
                | {f"{p}sims": F.get("_sims", F.lit(i)) for i, p in enumerate(domains)}
            )
            .withColumns({f"{p}best": F.expr(_best_brand(p, brands)) for p in domains})
            .drop("_sims")
        )
    chosen, flags = {}, {}
    for p in domains:
        exact = is_one_of(F.col(f"{p}norm"), brands) if brands else F.lit(False)
        # With no similarity anywhere the nearest brand by distance still counts.
        chosen |= {
            f"{p}best_brand": F.expr(f"coalesce({p}best.brand, '')" if brands else "''"),
            f"{p}similarity": F.expr(f"coalesce({p}best.similarity, 0.0D)" if brands else "0.0D"),
            f"{p}edit_distance": F.expr(
                f"coalesce(-{p}best.closeness, {NO_DISTANCE})" if brands else f"{NO_DISTANCE}"
            ),
            f"{p}exact_match": exact.cast("int"),
            f"{p}punycode": F.expr(f"CAST(contains({p}norm, 'xn--') AS INT)"),
            f"{p}non_ascii": F.expr(f"CAST({p}norm RLIKE '[^\\\\x00-\\\\x7f]' AS INT)"),
        }
        flags[f"{p}typosquat"] = F.expr(
            f"CAST({p}exact_match = 0 AND {p}similarity >= {float(similarity_threshold)}D "
            f"AND {p}edit_distance <= {int(max_edit_distance)} AS INT)"
        )
    helpers = [f"{p}{c}" for p in domains for c in ("norm", "label", "sims", "best")]
    return out.withColumns(chosen).withColumns(flags).drop(*helpers)


def _best_brand(p: str, brands: Sequence[str]) -> str:
    """SQL for the winning struct; null for an empty domain."""
    candidates = ", ".join(
        f"named_struct('similarity', {p}sims[{i}], "
        f"'closeness', -levenshtein({p}label, {sql_text(_label(b))}), "
        f"'earlier', {-i}, 'brand', {sql_text(b)})"
        for i, b in enumerate(brands)
    )
    best = f"greatest({candidates})" if len(brands) > 1 else candidates
    return f"IF({p}norm = '', NULL, {best})"


def domain_metrics(
    domains: DataFrame, domain_col: str = "domain", brand_domains: Sequence[str] | None = None, **kw
) -> DataFrame:
    """Brand metrics once per distinct domain, with the number of rows that carry it."""
    counted = domains.groupBy(F.col(domain_col).alias("domain")).agg(F.count("*").alias("emails"))
    return with_brand_match(counted, {"": "domain"}, brand_domains, **kw)
