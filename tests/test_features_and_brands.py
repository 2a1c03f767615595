import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.operators import features
from lurewatch.operators.brand_match import domain_metrics, normalized_brands, with_brand_match


def base(spark):
    return spark.createDataFrame(
        [
            ("FROM: support@bank.com SUBJECT: URGENT BODY: CLICK NOW! Visit https://secure-bank.com/login",
             "URGENT ACTION REQUIRED! CLICK NOW!", "URGENT", "support@bank.com", "set_a", 1),
            ("FROM: hr@company.com SUBJECT: Meeting BODY: See you tomorrow", "See you tomorrow",
             "Meeting", "hr@company.com", "set_b", 0),
        ],
        "text_combined string, body string, subject string, from_address string, source string, label int",
    )


def rows(df):
    return df.collect()


def test_all_columns_present_and_numeric(spark):
    built = features.build_features(base(spark))
    types = dict(built.dtypes)
    assert len(features.FEATURE_COLUMNS) == len(set(features.FEATURE_COLUMNS)) == 52
    assert all(types[c] in ("int", "bigint", "double") for c in features.FEATURE_COLUMNS)
    assert "first_url" not in types and "first_url_domain" not in types
    assert all(r[c] is not None for r in rows(built) for c in features.FEATURE_COLUMNS)


def test_has_url_inferred_or_provided(spark):
    first, second = rows(features.build_features(base(spark), lookalike=False))
    assert (first.has_url, second.has_url, first.has_url_was_missing) == (1, 0, 1)
    given = base(spark).withColumn("has_url", F.when(F.col("label") == 1, "0").otherwise("1.0"))
    first, second = rows(features.build_features(given, lookalike=False))
    assert (first.has_url, second.has_url) == (0, 1)
    assert first.has_url_was_missing == second.has_url_was_missing == 0
    odd = base(spark).withColumn("has_url", F.lit("yes"))
    assert rows(features.build_features(odd, lookalike=False))[0].has_url_was_missing == 1


def test_signals(spark):
    first, second = rows(features.build_features(base(spark), lookalike=False))
    assert first.num_uppercase_chars_body > second.num_uppercase_chars_body
    assert first.uppercase_ratio_body == pytest.approx(first.num_uppercase_chars_body / 34)
    assert first.has_urgent_terms == first.has_action_terms == 1
    assert first.num_suspicious_keyword_hits == 2 + 1 + 2  # urgent, action, "bank" twice
    assert first.sender_url_domain_mismatch == 1 and second.sender_url_domain_mismatch == 0
    assert first.body_to_subject_len_ratio == pytest.approx(34 / 6)


def test_markup_and_links(spark):
    df = spark.createDataFrame(
        [
            ("FROM: x SUBJECT: y BODY: Visit bit.ly/abc and http://evil.zip now",
             "<a href='http://evil.zip'>Click</a> now!", "Alert", "support@bank.com"),
            ("FROM: x SUBJECT: y BODY: See docs at secure-bank.com", "Visit secure-bank.com for details",
             "Info", "hr@company.com"),
        ],
        "text_combined string, body string, subject string, from_address string",
    )
    first, second = rows(features.build_features(df))
    assert first.num_short_urls == 1 and first.tld_risk_flag == 1 and first.num_html_tags_body == 2
    assert second.has_bare_domain_links_body == 1 and first.char_entropy_text > 0
    assert first.source_missing == 1


def test_missing_text_columns(spark):
    row = rows(features.build_features(spark.createDataFrame([(1,)], "n int")))[0]
    assert row.sender_missing == row.subject_missing == row.from_subject_missing == 1
    assert row.text_len == 0 and row.char_entropy_text == 0.0 and row.sender_brand_edit_distance == 999


def test_lookalike_flags(spark):
    df = spark.createDataFrame(
        [
            ("FROM: support@paypa1.com BODY: http://paypa1.com/login", "support@paypa1.com"),
            ("FROM: help@paypal.com BODY: http://paypal.com/login", "help@paypal.com"),
            ("FROM: x@mail.paypal.com BODY: none", "x@mail.paypal.com"),
        ],
        "text_combined string, from_address string",
    )
    first, second, third = rows(features.build_features(df, brand_domains=["paypal.com"]))
    assert first.sender_typosquat_flag == first.url_typosquat_flag == 1
    assert second.sender_typosquat_flag == second.url_typosquat_flag == 0
    assert third.sender_typosquat_flag == 1  # a brand's own subdomain is no exact match


def levenshtein(a, b):
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        current = [i]
        for j, y in enumerate(b, 1):
            current.append(min(previous[j] + 1, current[-1] + 1, previous[j - 1] + (x != y)))
        previous = current
    return previous[-1]


def brute_force(domain, brands):
    if not domain:
        return "", 0.0, 999
    def label(d):
        parts = [p for p in d.split(".") if p]
        return parts[-2] if len(parts) > 1 else d.split(".")[0]
    def sim(a, b):
        return SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    best = ("", 0.0, 999)
    for b in brands:
        s = max(sim(domain, b), sim(label(domain), label(b)))
        d = levenshtein(label(domain), label(b))
        if s > best[1] or (s == best[1] and d < best[2]):
            best = (b, s, d)
    return best


def test_best_brand_matches_brute_force(spark):
    rng = random.Random(3)
    domains = ["", "zzz", "tide", "paypal.com", "www.paypal.com", "a..b", ".", "x.co.uk", "xn--pypal-4ve.com", "päypal.com"]
    for _ in range(150):
        d = list(rng.choice(K.KNOWN_BRAND_DOMAINS))
        for _ in range(rng.randint(0, 4)):
            d[rng.randrange(len(d))] = rng.choice("abcdeo1.-")
        domains.append("".join(d))
    domains = [d for d in domains if not d.startswith("www.www.")]
    df = spark.createDataFrame([(d,) for d in domains], "d string")
    for r in with_brand_match(df, {"": "d"}).collect():
        brand, similarity, distance = brute_force(r.d.removeprefix("www."), K.KNOWN_BRAND_DOMAINS)
        assert (r.best_brand, r.similarity, r.edit_distance) == (brand, similarity, distance), r.d
        assert r.non_ascii == int(any(ord(c) > 127 for c in r.d))
        assert r.punycode == int("xn--" in r.d)


def test_brand_list_edge_cases(spark):
    assert normalized_brands([" HTTPS://www.PayPal.com/x", "", "a.b:80"]) == ["paypal.com", "a.b"]
    df = spark.createDataFrame([("paypal.com",), ("paypal.com",), ("",)], "domain string")
    none = {r.domain: r for r in domain_metrics(df, brand_domains=[]).collect()}
    assert none["paypal.com"].edit_distance == 999 and none["paypal.com"]["emails"] == 2
    one = {r.domain: r for r in domain_metrics(df, brand_domains=["paypal.com"]).collect()}
    assert one["paypal.com"].exact_match == 1 and one["paypal.com"].typosquat == 0


def test_no_exchange_and_one_regex_per_shared_value(spark):
    built = features.build_features(base(spark)).select(*features.FEATURE_COLUMNS)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("regexp_extract_all(text_combined") <= 5


def test_characters_are_counted_once_and_not_in_interpreted_steps(spark):
    built = features.build_features(base(spark)).select(*features.FEATURE_COLUMNS)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "lambdafunction" not in plan
    assert plan.count("char_profile(") == 1


def test_feature_matrix_fills_nulls(spark):
    df = spark.createDataFrame([(None, "x")], "text_len int, body_len string")
    matrix = features.feature_matrix(df)
    assert matrix.first().text_len == 0.0 and dict(matrix.dtypes)["body_len"] == "string"
