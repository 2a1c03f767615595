import pytest
from pyspark.sql import functions as F

from lurewatch.operators.rules import DEFAULT_RULES, HARD_RULES, Rule, rule_profile, score_rules
from lurewatch.operators.verdict import Thresholds, fuse, verdict_summary
from lurewatch.plans.scoring import score_emails

RECORD = "from_address string, subject string, body string, attachment_extensions array<string>"


def record(body="", sender="a@example.com", subject="hi", exts=None):
    return sender, subject, body, exts


def scored(spark, *records):
    rows = score_rules(spark.createDataFrame(list(records), RECORD)).collect()
    return [(r.rule_score, [m.rule_id for m in r.rule_matches], r.hard_block) for r in rows]


CASES = [
    ("malicious_attachment_ext", dict(exts=[".txt", ".hta"]), dict(exts=[".zip"])),
    ("suspicious_attachment_lure", dict(body="Find \n attached", exts=[".zip"]), dict(body="find attached")),
    ("free_sender_brand_text", dict(sender="X@Gmail.com", body="we purchase"), dict(body="paypal")),
    ("sender_url_domain_mismatch", dict(body="http://other.org"), dict(body="http://www.example.com")),
    ("ip_url", dict(body="http://10.0.0.1:80/x"), dict(body="http://u@10.0.0.1/ http://10.0.0.1./")),
    ("risky_tld", dict(body="https://a.example.com http://x.TK./"), dict(body="http://tk.example.com/x.zip")),
    ("shortener", dict(body="go to T.CO/abc"), dict(body="xt.co")),
    ("urgent_or_action", dict(subject="Action Required"), dict(body="reopened unlocked")),
    ("credentials_with_url", dict(body="bank http://example.com"), dict(body="bank")),
    ("crypto_with_url", dict(body="seed phrase http://example.com"), dict(body="seed phrase")),
    ("punycode_domain", dict(body="http://é.com"), dict(body="http://e.com/é")),
    ("subject_missing_with_url", dict(subject=" \t", body="http://example.com"), dict(subject="")),
    ("many_urls", dict(body="http://a.com http://b.com http://c.com"), dict(body="http://a.com http://a.com http://b.com")),
]


def test_each_rule(spark):
    hits = scored(spark, *[record(**hit) for _, hit, _ in CASES])
    misses = scored(spark, *[record(**miss) for _, _, miss in CASES])
    for (rule_id, _, _), hit, miss in zip(CASES, hits, misses):
        assert rule_id in hit[1] and rule_id not in miss[1], rule_id


def test_every_rule_is_covered_and_weighted():
    assert [c[0] for c in CASES] == [r.rule_id for r in DEFAULT_RULES]
    assert sum(r.weight for r in DEFAULT_RULES) == 26
    assert set(HARD_RULES) == {"ip_url", "punycode_domain", "malicious_attachment_ext"}


def test_score_is_the_sum_in_rule_order(spark):
    [(score, ids, hard)] = scored(spark, record(
        sender="user@gmail.com", subject="Urgent: verify your account",
        body="Please login and update your password at http://somesite.com/verify",
    ))
    assert ids == ["sender_url_domain_mismatch", "urgent_or_action", "credentials_with_url"]
    assert score == 5 and not hard


def test_nulls_and_defaults(spark):
    row = score_rules(spark.createDataFrame([(None,)], "from_address string")).first()
    assert row.text_combined == "FROM:  SUBJECT:  BODY: " and row.rule_matches == []
    given = spark.createDataFrame([("own text verify",)], "text_combined string")
    assert score_rules(given).first().rule_score == 1


def test_custom_rules_and_profile(spark):
    rules = [Rule("short", "Short body", 4, lambda: F.length("body") < 3)]
    df = spark.createDataFrame([("ab", 1), ("abcd", 0), ("a", 0)], "body string, label int")
    flagged = score_rules(df, rules, keep_flags=True)
    assert [r.rule_score for r in flagged.collect()] == [4, 0, 4]
    assert tuple(rule_profile(flagged, rules=rules).first()) == ("short", 4, 2, 1, 1)


FUSED = (
    "hard_block boolean, rule_score int, supervised_proba double, transformer_proba double, "
    "dkim_pass boolean, dkim_domain string, from_address string"
)


def fused(spark, s, t, r=0, hard=False, dkim=None, sender="a@b.com", thresholds=Thresholds()):
    df = spark.createDataFrame([(hard, r, s, t, dkim is not None, dkim, sender)], FUSED)
    row = fuse(df, thresholds).first()
    return row.is_phish, row.triggered_by, row.confidence, row


PATHS = [
        (0.1, 0.995, 0, "transformer_certain", 0.995),
        (0.55, 0.99, 0, "transformer_corroborated", 0.77),
        (0.1, 0.95, 2, "transformer_rule_corroborated", 0.95),
        (0.40, 0.97, 0, "transformer_dominant", 0.97),
        (0.55, 0.75, 0, "ml_consensus", 0.65),
        (0.87, 0.1, 3, "rule_assisted", 0.87),
        (0.1, 0.8, 3, "rule_assisted", 0.8),
        (0.1, 0.995 - 1e-6, 0, None, 1 - 0.995 + 1e-6),
        (0.55 - 1e-6, 0.99, 0, "transformer_dominant", 0.99),
        (0.39, 0.99, 1, None, 0.01),
        (0.1, 0.95, 1, None, 0.05),
        (0.1, 0.95 - 1e-6, 2, None, 0.05 + 1e-6),
        (0.95, 0.1, 2, None, 0.05),
        (0.95, 0.75 - 1e-6, 0, None, 0.05),
        (0.3, 0.2, 26, None, 0.7),
]


def test_paths(spark):
    rows = [(False, r, s, t, False, None, "a@b.com") for s, t, r, _, _ in PATHS]
    for case, row in zip(PATHS, fuse(spark.createDataFrame(rows, FUSED)).collect()):
        path, confidence = case[3:]
        assert (row.is_phish, row.triggered_by) == (int(path is not None), path), case
        assert row.confidence == pytest.approx(confidence, abs=1e-9), case


def test_hard_block_wins_and_hides_scores(spark):
    is_phish, by, confidence, row = fused(spark, 0.1, 0.1, hard=True, dkim="paypal.com")
    assert (is_phish, by, confidence) == (1, "rules", 1.0)
    assert row.supervised_proba is None and row.transformer_proba is None


@pytest.mark.parametrize(
    "dkim,sender,trusted",
    [
        ("paypal.com", "a@b.com", True),
        ("mail.paypal.com", "a@b.com", True),  # the root decides
        ("google.com", "x@Accounts.Google.com", True),
        ("google.com", "x@gmail.com", False),
        ("amazon.co.jp", "a@b.com", False),  # reduces to co.jp
        ("amazon.co.uk", "a@b.com", True),
        ("", "a@b.com", False),
    ],
)
def test_dkim_trust(spark, dkim, sender, trusted):
    is_phish, by, confidence, row = fused(spark, 0.9, 0.999, 5, dkim=dkim, sender=sender)
    assert row.dkim_trusted is trusted and is_phish == int(not trusted)
    if trusted:
        assert by is None and confidence == pytest.approx(0.001)


def test_custom_thresholds(spark):
    th = Thresholds(supervised=0.5, transformer=0.5)
    assert fused(spark, 0.5, 0.5, thresholds=th)[1] == "ml_consensus"


def test_end_to_end_record(spark):
    df = spark.createDataFrame(
        [("user@gmail.com", "Urgent: verify your account", "password http://somesite.com/verify", 0.95, 0.1),
         ("a@b.c", "s", "Click http://192.168.1.1/login", 0.0, 0.0)],
        "from_address string, subject string, body string, supervised_proba double, transformer_proba double",
    )
    verdicts = score_emails(df)
    assert [r.triggered_by for r in verdicts.collect()] == ["rule_assisted", "rules"]
    assert {r.path: r["emails"] for r in verdict_summary(verdicts).collect()} == {"rule_assisted": 1, "rules": 1}
