"""The 52 numeric features of an email.

Columns are built in a few projections so that shared intermediate values (URL array, term hits,
domains) are computed once; everything but the character counts and the brand similarity, which
take Arrow batches, is generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions import labels, mail, text, urls
from lurewatch.functions.text import as_text, is_blank, strip
from lurewatch.operators.brand_match import with_brand_match

# The feature names in model order.
FEATURE_COLUMNS = [
    "text_len", "body_len", "subject_len", "subject_missing",
    "num_words_text", "num_digits_text", "num_currency_symbols_text",
    "has_crypto_terms", "num_crypto_term_hits", "char_entropy_text",
    "num_exclamations_body", "num_question_marks_body",
    "num_uppercase_chars_body", "uppercase_ratio_body",
    "body_to_subject_len_ratio",
    "num_html_tags_body", "has_html_tags_body",
    "num_bare_domain_links_body", "has_bare_domain_links_body",
    "has_urgent_terms", "has_action_terms", "has_credential_terms",
    "num_suspicious_keyword_hits",
    "num_urls_in_text", "num_short_urls",
    "first_url_has_https", "first_url_len",
    "first_url_domain_len", "first_url_domain_num_dots",
    "first_url_domain_num_hyphens", "first_url_domain_is_ip",
    "has_url", "has_url_was_missing", "tld_risk_flag",
    "sender_missing", "sender_domain_len", "sender_local_len",
    "sender_has_digits", "sender_is_free_email", "sender_url_domain_mismatch",
    "sender_brand_similarity", "sender_brand_edit_distance",
    "sender_domain_punycode", "sender_domain_non_ascii", "sender_typosquat_flag",
    "url_brand_similarity", "url_brand_edit_distance",
    "url_domain_punycode", "url_domain_non_ascii", "url_typosquat_flag",
    "source_missing", "from_subject_missing",
]


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _with_columns_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = {n: F.lit("") for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def text_features(df: DataFrame, text_col: str, body_col: str, subject_col: str) -> DataFrame:
    t, b, s = as_text(F.col(text_col)), as_text(F.col(body_col)), as_text(F.col(subject_col))
    hits_text, hits_body = F.col("_hits_text"), F.col("_hits_body")
    return (
        df.withColumn("_chars", text.char_profile(t))
        .withColumns(
            {
                "_hits_text": text.lexicon_hits(t, ["credential", "crypto"]),
                "_hits_body": text.lexicon_hits(b, ["urgent", "action"]),
                "text_len": F.length(t),
                "body_len": F.length(b),
                "subject_len": F.length(s),
                "subject_missing": _flag(is_blank(s)),
                "num_words_text": F.col("_chars.words"),
                "num_digits_text": text.count_matches(t, r"\p{Nd}"),
                "num_currency_symbols_text": F.col("_chars.currency"),
                "char_entropy_text": F.col("_chars.entropy"),
                "num_exclamations_body": text.count_char(b, "!"),
                "num_question_marks_body": text.count_char(b, "?"),
                "num_uppercase_chars_body": text.count_matches(b, "[A-Z]"),
                "num_html_tags_body": text.count_tags(b),
                "num_bare_domain_links_body": urls.count_bare_domains(b),
            }
        )
        .withColumns(
            {
                "uppercase_ratio_body": F.col("num_uppercase_chars_body")
                / F.greatest(F.col("body_len"), F.lit(1)),
                "body_to_subject_len_ratio": F.col("body_len")
                / F.greatest(F.col("subject_len"), F.lit(1)),
                "has_html_tags_body": _flag(F.col("num_html_tags_body") > 0),
                "has_bare_domain_links_body": _flag(F.col("num_bare_domain_links_body") > 0),
                "num_crypto_term_hits": text.count_lexicon(hits_text, "crypto"),
                "_credential_hits": text.count_lexicon(hits_text, "credential"),
                "_urgent_hits": text.count_lexicon(hits_body, "urgent"),
                "_action_hits": text.count_lexicon(hits_body, "action"),
            }
        )
        .withColumns(
            {
                "has_crypto_terms": _flag(F.col("num_crypto_term_hits") > 0),
                "has_urgent_terms": _flag(F.col("_urgent_hits") > 0),
                "has_action_terms": _flag(F.col("_action_hits") > 0),
                "has_credential_terms": _flag(F.col("_credential_hits") > 0),
                "num_suspicious_keyword_hits": F.col("_urgent_hits")
                + F.col("_action_hits")
                + F.col("_credential_hits")
                + F.col("num_crypto_term_hits"),
            }
        )
        .drop("_chars", "_hits_text", "_hits_body", "_credential_hits", "_urgent_hits", "_action_hits")
    )


def url_features(df: DataFrame, text_col: str, has_url_col: str = "has_url") -> DataFrame:
    """Also leaves ``first_url`` and ``first_url_domain`` for later steps."""
    t = as_text(F.col(text_col))
    domain = F.col("first_url_domain")
    inferred = _flag(F.col("num_urls_in_text") > 0)
    if has_url_col in df.columns:
        number = labels.number_of(F.col(has_url_col))
        provided = F.when(number.isin(0.0, 1.0), number.cast("int"))
    else:
        provided = F.lit(None).cast("int")
    return (
        df.withColumns({"_urls": urls.extract_urls(t), "_provided": provided})
        .withColumns(
            {
                "num_urls_in_text": F.size("_urls"),
                "_url_text": urls.joined_urls(F.col("_urls")),
                "first_url": urls.first_of(F.col("_urls")),
                "num_short_urls": urls.count_shorteners(t),
            }
        )
        .withColumn("first_url_domain", urls.netloc(F.col("first_url")))
        .withColumns(
            {
                "first_url_has_https": _flag(F.col("first_url").startswith("https://")),
                "first_url_len": F.length("first_url"),
                "first_url_domain_len": F.length(domain),
                "first_url_domain_num_dots": text.count_char(domain, "."),
                "first_url_domain_num_hyphens": text.count_char(domain, "-"),
                "first_url_domain_is_ip": _flag(urls.is_ip(domain)),
                "has_url": F.coalesce(F.col("_provided"), inferred),
                "has_url_was_missing": _flag(F.col("_provided").isNull()),
                "tld_risk_flag": _flag(
                    (F.col("_url_text") != "") & urls.any_risky_tld(F.col("_url_text"))
                ),
            }
        )
        .drop("_urls", "_provided", "_url_text")
    )


def sender_features(df: DataFrame, from_col: str) -> DataFrame:
    """Needs the URL features; leaves ``_sender_domain``."""
    return (
        df.withColumn("_from", F.lower(strip(as_text(F.col(from_col)))))
        .withColumn("_sender_domain", mail.sender_domain(F.col("_from")))
        .withColumns(
            {
                "_sender_root": urls.root_domain(F.col("_sender_domain")),
                "_url_root": urls.root_domain(F.col("first_url_domain")),
            }
        )
        .withColumns(
            {
                "sender_missing": _flag(F.col("_from") == ""),
                "sender_domain_len": F.length("_sender_domain"),
                "sender_local_len": F.length(mail.sender_local(F.col("_from"))),
                "sender_has_digits": _flag(F.col("_from").rlike(r"\p{Nd}")),
                "sender_is_free_email": _flag(text.is_one_of(F.col("_sender_domain"), K.FREE_EMAIL_DOMAINS)),
                "sender_url_domain_mismatch": _flag(
                    (F.col("has_url") == 1)
                    & (F.col("_sender_root") != "")
                    & (F.col("_url_root") != "")
                    & (F.col("_sender_root") != F.col("_url_root"))
                ),
            }
        )
        .drop("_from", "_sender_root", "_url_root")
    )


def lookalike_features(
    df: DataFrame,
    brand_domains: Sequence[str] | None,
    similarity_threshold: float,
    max_edit_distance: int,
) -> DataFrame:
    columns = {"_s_": "_sender_domain", "_u_": "first_url_domain"}
    matched = with_brand_match(
        df, columns, brand_domains, similarity_threshold, max_edit_distance
    )
    return matched.withColumns(
        {
            "sender_brand_similarity": F.col("_s_similarity"),
            "sender_brand_edit_distance": F.col("_s_edit_distance"),
            "sender_domain_punycode": F.col("_s_punycode"),
            "sender_domain_non_ascii": F.col("_s_non_ascii"),
            "sender_typosquat_flag": F.col("_s_typosquat"),
            "url_brand_similarity": F.col("_u_similarity"),
            "url_brand_edit_distance": F.col("_u_edit_distance"),
            "url_domain_punycode": F.col("_u_punycode"),
            "url_domain_non_ascii": F.col("_u_non_ascii"),
            "url_typosquat_flag": _flag((F.col("has_url") == 1) & (F.col("_u_typosquat") == 1)),
        }
    ).drop(*[f"{p}{c}" for p in ("_s_", "_u_") for c in _MATCH_COLUMNS])


_MATCH_COLUMNS = (
    "best_brand", "similarity", "edit_distance", "exact_match", "punycode", "non_ascii", "typosquat",
)


def metadata_features(df: DataFrame) -> DataFrame:
    source_missing = _flag(is_blank(as_text(F.col("source")))) if "source" in df.columns else F.lit(1)
    return df.withColumns(
        {
            "source_missing": source_missing,
            "from_subject_missing": _flag(
                (F.col("sender_missing") == 1) & (F.col("subject_missing") == 1)
            ),
        }
    )


def build_features(
    df: DataFrame,
    text_col: str = "text_combined",
    body_col: str = "body",
    subject_col: str = "subject",
    from_col: str = "from_address",
    has_url_col: str = "has_url",
    brand_domains: Sequence[str] | None = None,
    similarity_threshold: float = 0.8,
    max_edit_distance: int = 2,
    lookalike: bool = True,
) -> DataFrame:
    """Append all features.  ``lookalike=False`` leaves out the ten brand columns."""
    out = _with_columns_present(df, [text_col, body_col, subject_col, from_col])
    out = text_features(out, text_col, body_col, subject_col)
    out = url_features(out, text_col, has_url_col)
    out = sender_features(out, from_col)
    out = metadata_features(out)
    if lookalike:
        out = lookalike_features(out, brand_domains, similarity_threshold, max_edit_distance)
    return out.drop("_sender_domain", "first_url", "first_url_domain")


def feature_matrix(df: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """The feature columns that are present and numeric, as doubles with nulls set to 0."""
    numeric = {
        f.name
        for f in df.schema.fields
        if f.dataType.typeName() in {"integer", "long", "double", "float", "short", "byte", "decimal"}
    }
    present = [c for c in columns if c in numeric]
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in present})
