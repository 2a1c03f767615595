"""Similarity of domains to a brand table of any size, by joins.

:func:`lurewatch.operators.brand_match.with_brand_match` compares every domain with every brand of
a short list.  Here both sides are tables, and only pairs that can reach the threshold are compared.

The ratio of two strings with ``s`` characters in all is ``2 m / s`` for ``m`` characters in
matching blocks.  A ratio of at least ``t`` needs ``m >= t s / 2``; the other ``s - 2 m`` characters
can part the blocks at as many places, and a block of ``n`` characters holds ``n - 1`` bigrams, so
at least ``3 m - s - 1`` bigrams are common.  The rarest common one then lies among the rarest
``length - common`` bigrams of either string (prefix filter), and only strings with such a bigram in
common meet.  Endings such as ``.com``, which nearly all names hold, are frequent and stay out.
Very short strings, for which no common bigram is certain, meet by single characters as well.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.operators.brand_match import NO_DISTANCE, domain_label, normalize_domain, similarity_ratio

SLACK = 1e-9  # keeps a product such as 0.8 * 15 / 2 from being rounded up past a whole number


def _matched(total: str, t: float) -> str:
    """SQL: characters in matching blocks that strings of ``total`` characters need."""
    return f"CAST(ceil({t}D * ({total}) / 2 - {SLACK}D) AS INT)"


def _certain_bigrams(n: str, t: float) -> str:
    """SQL: bigrams that a string of ``n`` characters shares with any string similar to it."""
    total = f"{n} + m"
    shortest, longest = f"CAST(ceil({n} * {t}D / {2 - t}D - {SLACK}D) AS INT)", f"CAST({n} * {2 - t}D / {t}D + {SLACK}D AS INT)"
    return f"array_min(transform(sequence({shortest}, {longest}), m -> 3 * {_matched(total, t)} - ({total}) - 1))"


def _grams(strings: DataFrame, t: float) -> DataFrame:
    """``text, n, certain, gram`` with repeated grams of a text numbered."""
    sized = strings.withColumn("n", F.length("text")).withColumn("certain", F.expr(_certain_bigrams("n", t)))
    bigrams = "transform(sequence(1, n - 1), i -> substring(text, i, 2))"
    singles = "split(text, '')"
    grams = F.expr(
        f"concat(IF(n > 1, {bigrams}, array()), IF(certain <= 0, filter({singles}, c -> c <> ''), array()))"
    )
    counted = sized.withColumn("gram", F.explode(grams)).groupBy("text", "n", "certain", "gram").agg(F.count("*").alias("k"))
    return counted.select("text", "n", "certain", F.explode(F.sequence(F.lit(1), "k")).alias("k"), "gram")


def _prefixes(grams: DataFrame, frequency: DataFrame) -> DataFrame:
    """The grams that a similar string must share one of: the rarest ones of each text."""
    ranked = grams.join(frequency, ["gram", "k"], "left").withColumn(
        "place", F.expr("row_number() OVER (PARTITION BY text ORDER BY coalesce(frequency, 0), gram, k)")
    )
    # Grams that no brand holds have a place in the order and meet nothing.
    kept = ranked.filter("frequency IS NOT NULL AND (certain <= 0 OR place <= n - certain)")
    return kept.select("text", "n", "gram", "k")


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs ``left, right`` that hold all whose ratio is at least ``threshold``.

    ``right`` is the side whose grams are counted.
    """
    if not 2 / 3 < threshold <= 1:
        raise ValueError("threshold must be over 2/3, since below that common bigrams are not certain, and at most 1")
    a, b = (side.select("text").filter("text <> ''").distinct() for side in (left, right))
    b_grams = _grams(b, threshold)
    frequency = b_grams.groupBy("gram", "k").agg(F.count("*").alias("frequency"))
    a_rare = _prefixes(_grams(a, threshold), frequency).withColumnsRenamed({"text": "left", "n": "a"})
    b_rare = _prefixes(b_grams, frequency).withColumnsRenamed({"text": "right", "n": "b"})
    met = a_rare.join(b_rare, ["gram", "k"]).filter(f"{_matched('a + b', threshold)} <= least(a, b)")
    # An edit distance exceeds the unmatched characters of no pair, and is at hand without Python.
    pairs = met.select("left", "right", "a", "b").distinct()
    return pairs.filter(f"levenshtein(left, right) <= a + b - 2 * {_matched('a + b', threshold)}").select("left", "right")


def similar_strings(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``left, right, ratio`` of a ``text`` column each with a ratio of at least ``threshold``.

    Equal texts of a side are one; null and empty ones are similar to nothing.
    """
    pairs = candidate_pairs(left, right, threshold).withColumn("ratio", _ratios("left", "right"))
    return pairs.filter(F.col("ratio") >= threshold)


def _ratios(left: str, right: str) -> Column:
    @F.pandas_udf("double")
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratios(left, right)


def match_brand_table(
    domains: DataFrame,
    brands: DataFrame,
    domain_col: str = "domain",
    brand_col: str = "brand",
    similarity_threshold: float = 0.8,
    max_edit_distance: int = 2,
) -> DataFrame:
    """Brand metrics once per distinct domain against every row of ``brands``.

    Returns ``domain``, ``emails`` (rows that carry it) and the metrics of
    :func:`~lurewatch.operators.brand_match.domain_metrics`.  The best brand has the highest
    similarity, then the smallest distance of labels, then the least name; one below
    ``similarity_threshold`` is not named, and its row is that of an empty list: no brand, similarity
    0, distance 999.  ``typosquat`` is the flag that comparing with every brand gives, as it needs
    that similarity.  Null and empty domains and brands match nothing; repeated brands count once.
    """
    counted = domains.groupBy(F.col(domain_col).alias("domain")).agg(F.count("*").alias("emails"))
    names = counted.withColumn("norm", normalize_domain(F.coalesce("domain", F.lit(""))))
    names = names.withColumn("label", domain_label(F.col("norm")))
    known = brands.select(normalize_domain(F.col(brand_col)).alias("brand")).filter("brand <> ''").distinct()
    known = known.withColumn("brand_label", domain_label(F.col("brand")))

    # A text stands for a brand as its whole name, as its label or as both.  All brands with one
    # label are as similar by it, so the least name of them stands for the label.
    meanings = known.select(F.col("brand").alias("text"), "brand", F.lit(None).cast("string").alias("labelled"))
    meanings = meanings.union(known.select("brand_label", F.lit(None), "brand"))
    meanings = meanings.groupBy("text").agg(F.max("brand").alias("brand"), F.min("labelled").alias("labelled"))
    texts = names.select(F.explode(F.array("norm", "label")).alias("text"))
    similar = similar_strings(texts, meanings, similarity_threshold)
    similar = similar.join(meanings.withColumnRenamed("text", "right"), "right")
    best = similar.groupBy("left").agg(
        F.min(F.when(F.col("brand").isNotNull(), _rank(domain_label(F.col("left")), "brand"))).alias("by_name"),
        F.min(F.when(F.col("labelled").isNotNull(), _rank(F.col("left"), "labelled"))).alias("by_label"),
        F.max((F.col("left") == F.col("brand")).cast("int")).alias("same"),
    )
    by_name = best.select(F.col("left").alias("norm"), "by_name", "same")
    by_label = best.select(F.col("left").alias("label"), "by_label")
    found = names.join(by_name, "norm", "left").join(by_label, "label", "left")
    found = found.withColumn("best", F.least("by_name", "by_label"))
    return found.select(
        "domain", "emails",
        F.coalesce("best.brand", F.lit("")).alias("best_brand"),
        F.coalesce(-F.col("best.unlike"), F.lit(0.0)).alias("similarity"),
        F.coalesce("best.distance", F.lit(NO_DISTANCE)).alias("edit_distance"),
        F.coalesce("same", F.lit(0)).alias("exact_match"),
        F.col("norm").contains("xn--").cast("int").alias("punycode"),
        F.col("norm").rlike(r"[^\x00-\x7f]").cast("int").alias("non_ascii"),
    ).withColumn(
        "typosquat",
        F.expr(f"CAST(exact_match = 0 AND best_brand <> '' AND edit_distance <= {int(max_edit_distance)} AS INT)"),
    )


def _rank(label: Column, brand: str) -> Column:
    """The least of these is the best brand."""
    return F.struct(
        (-F.col("ratio")).alias("unlike"),
        F.levenshtein(label, domain_label(F.col(brand))).alias("distance"),
        F.col(brand).alias("brand"),
    )
