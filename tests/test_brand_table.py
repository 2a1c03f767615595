"""Brand tables against the loop over every brand."""

import random
from difflib import SequenceMatcher

import pytest

from lurewatch.operators.brand_table import candidate_pairs, match_brand_table, similar_strings
from test_features_and_brands import brute_force


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.95, 1.0])
def test_similar_strings_loses_no_pair(spark, threshold):
    rng = random.Random(7)
    left = {"".join(rng.choice("abc.") for _ in range(rng.randint(0, 9))) for _ in range(150)} | {"ab", "axb", "a", "ab" * 40}
    right = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(120)} | {"ab", "a", "ab" * 38}
    def frame(texts):
        return spark.createDataFrame([(t, "x") for t in [*texts, *texts, None]], "text string, gram string")
    got = similar_strings(frame(left), frame(right), threshold).collect()
    ratios = {(a, b): SequenceMatcher(None, a, b).ratio() for a in left if a for b in right}
    assert {(r.left, r.right): r.ratio for r in got} == {p: v for p, v in ratios.items() if v >= threshold}
    assert len(got) == len({(r.left, r.right) for r in got})


def test_brand_table_is_the_loop_above_the_threshold(spark):
    rng = random.Random(5)
    def word():
        return "".join(rng.choice("abeilnoprst") for _ in range(rng.randint(2, 12)))
    brands = sorted({f"{word()}.{rng.choice(['com', 'net', 'co'])}" for _ in range(300)} | {"same.com", "same.net", "same.co"})
    domains = ["", "same.org", "same.net", "www.same.com", "mail.same.com", "xn--sme-bla.com", "säme.com", ".", "a..b", "same"]
    for _ in range(300):
        name = list(rng.choice(brands))
        for _ in range(rng.randint(0, 4)):
            name[rng.randrange(len(name))] = rng.choice("abe1.-")
        domains.append("".join(name))
    frame = spark.createDataFrame([(d, 1) for d in [*domains, domains[1], None]], "domain string, brand int")
    table = spark.createDataFrame([(b, "x") for b in [*brands, brands[0], "", None]], "brand string, domain string")
    got = {r.domain: r for r in match_brand_table(frame, table).collect()}
    assert set(got) == {*domains, None} and got["same.org"].emails == 2
    named = 0
    for domain in set(domains):
        r = got[domain]
        brand, similarity, distance = brute_force(domain.removeprefix("www."), brands)
        exact = domain.removeprefix("www.") in brands
        assert r.typosquat == int(not exact and similarity >= 0.8 and distance <= 2), domain
        if similarity < 0.8:
            brand, similarity, distance = "", 0.0, 999
        named += bool(brand)
        assert (r.best_brand, r.similarity, r.edit_distance, r.exact_match) == (brand, similarity, distance, exact), domain
    assert 100 < named < len(set(domains))


def test_empty_tables_and_bad_thresholds(spark):
    names = spark.createDataFrame([("paypal.com",)], "domain string")
    none = spark.createDataFrame([], "brand string")
    only = match_brand_table(names, none).first()
    assert (only.best_brand, only.similarity, only.edit_distance, only.typosquat) == ("", 0.0, 999, 0)
    assert match_brand_table(names.limit(0), names, brand_col="domain").count() == 0
    for bad in (0.5, 2 / 3, 1.1):
        with pytest.raises(ValueError):
            match_brand_table(names, none, similarity_threshold=bad)


def test_common_endings_bring_nothing_together(spark):
    """Ten thousand brands with one ending: few of the pairs are ever looked at."""
    rng = random.Random(1)
    def names(n):
        return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) + ".com" for _ in range(n)]
    brands, domains = names(10_000), names(1_000)
    frames = [spark.createDataFrame([(x,) for x in t], "text string") for t in (domains + [brands[0]], brands)]
    pairs = candidate_pairs(*frames, 0.8)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    looked_at = {(r.left, r.right) for r in pairs.collect()}
    assert (brands[0], brands[0]) in looked_at and len(looked_at) < 1_000 * 10_000 // 500
