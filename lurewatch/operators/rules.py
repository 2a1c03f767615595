"""Weighted detection rules.

Each rule is an id, a description, a weight and a boolean column over the working columns that
:func:`with_signals` adds.  Callers may pass their own list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions import mail, urls
from lurewatch.functions.text import (
    as_text,
    has_lexicon,
    is_blank,
    is_one_of,
    lexicon_hits,
    sql_text,
)

HARD_RULES = ("ip_url", "punycode_domain", "malicious_attachment_ext")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    description: str
    weight: int
    predicate: Callable[[], Column]


def _has_url() -> Column:
    return F.col("sig_url_text") != ""


def _free_sender_brand_text() -> Column:
    terms = [d.split(".")[0] for d in K.KNOWN_BRAND_DOMAINS]
    mentions = F.lower(F.col("text_combined")).rlike("|".join(terms))
    return is_one_of(F.col("sig_sender_domain"), K.FREE_EMAIL_DOMAINS) & mentions


def _sender_url_mismatch() -> Column:
    sender, link = F.col("sig_sender_root"), F.col("sig_first_url_root")
    return _has_url() & (sender != "") & (link != "") & (sender != link)


def _extension_in(extensions: list[str]) -> Column:
    wanted = f"array({', '.join(map(sql_text, extensions))})"
    return F.expr(f"arrays_overlap(sig_extensions, {wanted})")


def _mentions(lexicon: str) -> Column:
    return has_lexicon(F.col("sig_hits"), lexicon)


# Ids, wording and weights.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(
        "malicious_attachment_ext",
        "Attachment uses a directly-executable or credential-harvesting extension",
        3,
        lambda: _extension_in(K.HARD_BLOCK_EXTENSIONS),
    ),
    Rule(
        "suspicious_attachment_lure",
        "Suspicious attachment extension paired with invoice/payment lure language",
        2,
        lambda: _extension_in(K.SUSPICIOUS_EXTENSIONS + K.HARD_BLOCK_EXTENSIONS)
        & F.col("text_combined").rlike(K.ATTACHMENT_LURE_PATTERN),
    ),
    Rule(
        "free_sender_brand_text",
        "Free email sender with brand terms in message",
        2,
        _free_sender_brand_text,
    ),
    Rule(
        "sender_url_domain_mismatch",
        "Sender domain does not match first URL domain",
        2,
        _sender_url_mismatch,
    ),
    Rule(
        "ip_url",
        "URL uses a raw IP address",
        3,
        lambda: _has_url() & urls.any_ip(F.col("sig_url_text")),
    ),
    Rule(
        "risky_tld",
        "URL uses a risky TLD",
        2,
        lambda: _has_url() & urls.any_risky_tld(F.col("sig_url_text")),
    ),
    Rule(
        "shortener",
        "Message contains a URL shortener",
        2,
        lambda: urls.has_shortener(F.col("text_combined")),
    ),
    Rule(
        "urgent_or_action",
        "Urgent or action language present",
        1,
        lambda: _mentions("urgent") | _mentions("action"),
    ),
    Rule(
        "credentials_with_url",
        "Credential terms with URL present",
        2,
        lambda: _has_url() & _mentions("credential"),
    ),
    Rule(
        "crypto_with_url",
        "Crypto terms with URL present",
        2,
        lambda: _has_url() & _mentions("crypto"),
    ),
    Rule(
        "punycode_domain",
        "URL domain uses punycode or non-ASCII characters",
        3,
        lambda: _has_url() & urls.any_punycode(F.col("sig_url_text")),
    ),
    Rule(
        "subject_missing_with_url",
        "Missing subject with URL present",
        1,
        lambda: is_blank(F.col("subject")) & _has_url(),
    ),
    Rule(
        "many_urls",
        "Message contains multiple URLs",
        1,
        lambda: _has_url() & (F.size(F.array_distinct(F.col("sig_urls"))) >= 3),
    ),
)

_SIGNALS = (
    "sig_urls", "sig_url_text", "sig_sender_domain", "sig_sender_root", "sig_first_url_root",
    "sig_extensions", "sig_hits",
)


def with_defaults(df: DataFrame) -> DataFrame:
    """Optional input columns of a scoring record, filled with their defaults."""
    present = set(df.columns)

    def text(name: str) -> Column:
        return as_text(F.col(name)) if name in present else F.lit("")

    combined = mail.combined_text(text("from_address"), text("subject"), text("body"))
    if "text_combined" in present:
        given = as_text(F.col("text_combined"))
        combined = F.when(given != "", given).otherwise(combined)
    no_extensions = F.array().cast("array<string>")
    return df.withColumns(
        {
            "from_address": text("from_address"),
            "subject": text("subject"),
            "body": text("body"),
            "text_combined": combined,
            "attachment_extensions": F.coalesce(F.col("attachment_extensions"), no_extensions)
            if "attachment_extensions" in present
            else no_extensions,
            "dkim_pass": F.coalesce(F.col("dkim_pass").cast("boolean"), F.lit(False))
            if "dkim_pass" in present
            else F.lit(False),
            "dkim_domain": F.col("dkim_domain").cast("string")
            if "dkim_domain" in present
            else F.lit(None).cast("string"),
        }
    )


def with_signals(df: DataFrame) -> DataFrame:
    """Extract URLs and term hits once; every rule reads the results."""
    return (
        with_defaults(df)
        .withColumns(
            {
                "sig_urls": urls.extract_urls(F.col("text_combined")),
                "sig_hits": lexicon_hits(F.col("text_combined"), list(K.LEXICONS)),
            }
        )
        .withColumns(
            {
                "sig_url_text": urls.joined_urls(F.col("sig_urls")),
                "sig_sender_domain": mail.domain_after_at(F.col("from_address")),
                "sig_extensions": F.col("attachment_extensions"),
            }
        )
        .withColumns(
            {
                "sig_sender_root": urls.root_domain(F.col("sig_sender_domain")),
                "sig_first_url_root": urls.root_domain(urls.netloc(urls.first_of(F.col("sig_urls")))),
            }
        )
    )


def rule_flags(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """One boolean column ``rule_<id>`` per rule."""
    flags = {f"rule_{r.rule_id}": F.coalesce(r.predicate(), F.lit(False)) for r in rules}
    return with_signals(df).withColumns(flags).drop(*_SIGNALS)


def score_rules(
    df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, keep_flags: bool = False
) -> DataFrame:
    """Add ``rule_score``, ``rule_matches`` (in rule order) and ``hard_block``."""
    flagged = rule_flags(df, rules)
    # SQL text instead of column calls: one call into the JVM for all rules.  Concatenating
    # zero- or one-element arrays stays inside generated code, which filtering one array with a
    # lambda would not.
    score, matches = ["0"], []
    for r in rules:
        match = (
            f"array(named_struct('rule_id', {sql_text(r.rule_id)}, "
            f"'description', {sql_text(r.description)}, 'weight', {int(r.weight)}))"
        )
        score.append(f"IF(`rule_{r.rule_id}`, {int(r.weight)}, 0)")
        matches.append(f"IF(`rule_{r.rule_id}`, {match}, slice({match}, 1, 0))")
    hard = [f"`rule_{r.rule_id}`" for r in rules if r.rule_id in HARD_RULES]
    scored = flagged.withColumns(
        {
            "rule_score": F.expr(f"CAST({' + '.join(score)} AS INT)"),
            "rule_matches": F.expr(f"concat({', '.join(matches)})" if matches else "array()"),
            "hard_block": F.expr(" OR ".join(hard) if hard else "false"),
        }
    )
    return scored if keep_flags else scored.drop(*[f"rule_{r.rule_id}" for r in rules])


def rule_profile(
    scored: DataFrame, label_col: str = "label", rules: Sequence[Rule] = DEFAULT_RULES
) -> DataFrame:
    """Hits per rule, split by label.

    ``scored`` carries the flag columns.  All counts come from a single aggregation with one row
    of partial sums per task, and are unpivoted afterwards, so no row is multiplied by the number
    of rules it matched.
    """
    counts, rows = [], []
    for r in rules:
        flag, name = f"`rule_{r.rule_id}`", r.rule_id
        counts += [
            F.expr(f"count_if({flag})").alias(f"{name}__all"),
            F.expr(f"count_if({flag} AND `{label_col}` = 1)").alias(f"{name}__pos"),
            F.expr(f"count_if({flag} AND `{label_col}` = 0)").alias(f"{name}__neg"),
        ]
        rows.append(
            f"named_struct('rule_id', {sql_text(name)}, 'weight', {int(r.weight)}, "
            f"'emails', `{name}__all`, 'phish_emails', `{name}__pos`, 'benign_emails', `{name}__neg`)"
        )
    totals = scored.agg(*counts)
    return totals.selectExpr(f"inline(array({', '.join(rows)}))").filter(F.col("emails") > 0)
