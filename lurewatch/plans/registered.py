"""Named queries over a folder of Parquet tables, one per operator or report."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions import labels, mail, scores, text, urls
from lurewatch.operators import (
    brand_match,
    brand_table,
    cleaning,
    features,
    isolation,
    metrics,
    profiling,
    reports,
    rules,
    sequence_scorer,
    splitting,
    term_sketch,
    term_weights,
    text_classifier,
    verdict,
)
from lurewatch.plans.fixture import emails, emails_from, read_table, table_stream
from lurewatch.plans.prepare import benign_only as keep_benign
from lurewatch.plans.prepare import build_benign, build_splits, preprocess_and_split
from lurewatch.plans.scoring import Scorers, evaluate_corpus, score_emails, write_evaluation
from lurewatch.plans.training import run_training
from lurewatch.session import run_dir, stage
from lurewatch.sources import labelled_csv, markup, message_files, messages
from lurewatch.streaming.verdicts import message_file_stream, read_scored, start_message_scoring, start_scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, so that engines with another summation order agree."""
    return df.select(
        *[
            F.round(F.col(n), other.get(n, digits)).alias(n) if t == "double" else F.col(n)
            for n, t in df.dtypes
        ]
    )


def _flagged_emails(spark: SparkSession, sf: str, labelled: bool = False) -> DataFrame:
    """Emails with the combined text and a 0/1/null URL flag."""
    return rules.with_defaults(emails(spark, sf, labelled)).withColumn(
        "has_url", labels.normalize_has_url(F.col("has_url_raw"))
    )


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return score_emails(emails(spark, sf))


# --- rules and verdicts ---------------------------------------------------------------------


@query
def rule_score(spark, sf):
    return rules.score_rules(emails(spark, sf, labelled=False)).select("email_id", "rule_score", "hard_block")


@query
def rule_matches(spark, sf):
    scored = rules.score_rules(emails(spark, sf, labelled=False))
    return scored.select("email_id", F.array_join("rule_matches.rule_id", "|").alias("matches"))


@query
def rule_profile(spark, sf):
    return rules.rule_profile(rules.score_rules(emails(spark, sf), keep_flags=True))


@query
def record_defaults(spark, sf):
    """Scoring records with nulls in optional columns, and records that have a body alone."""
    docs = read_table(spark, sf, "documents")
    every = lambda n: F.col("doc_id") % n == 0
    sparse = docs.select(
        "doc_id", F.lit("sparse").alias("record"),
        F.when(~every(3), F.concat("source", F.lit("@example.com"))).alias("from_address"),
        F.when(~every(4), F.concat(F.lit("About "), "lang")).alias("subject"),
        F.when(~every(5), F.col("text")).alias("body"),
        F.when(every(7), F.lit("")).when(every(2), F.lower("text")).alias("text_combined"),
        F.when(~every(6), F.array(F.lit(".zip"), F.lit(".exe"))).alias("attachment_extensions"),
        F.when(~every(8), every(2)).alias("dkim_pass"), F.when(every(2), F.col("source")).alias("dkim_domain"),
    )
    plain = docs.select("doc_id", F.lit("plain").alias("record"), F.col("text").alias("body"))
    columns = [
        "doc_id", "record", "from_address", "subject", F.md5("body").alias("body_md5"),
        F.md5("text_combined").alias("text_md5"), F.size("attachment_extensions").alias("extensions"),
        "dkim_pass", "dkim_domain",
    ]
    filled = [rules.with_defaults(records).select(*columns) for records in (sparse, plain)]
    return filled[0].unionByName(filled[1])


@query
def verdicts(spark, sf):
    return _rounded(
        _verdicts(spark, sf).select(
            "email_id", "is_phish", "confidence", "triggered_by", "rule_score", "dkim_trusted",
            "supervised_proba", "transformer_proba",
        )
    )


@query
def verdict_summary(spark, sf):
    return verdict.verdict_summary(_verdicts(spark, sf))


# --- normalising, cleaning, profiling, splitting --------------------------------------------

# A vocabulary of spellings, spread over the rows of the document table.
LABEL_SPELLINGS = [
    "Phishing Email", " spam ", "HAM", "Safe Email", "1", "0.0", "TRUE", "n", "unknown", "2", "",
    "legit", "malicious", "yes", "No", "benign",
]


def _spelling(id_col: str) -> Column:
    return F.get(
        F.array(*[F.lit(s) for s in LABEL_SPELLINGS]), (F.col(id_col) % len(LABEL_SPELLINGS)).cast("int")
    )


@query
def normalize_label(spark, sf):
    docs = read_table(spark, sf, "documents").withColumn("raw", _spelling("doc_id"))
    return docs.select("doc_id", "raw", labels.normalize_label(F.col("raw")).alias("label"))


@query
def normalize_has_url(spark, sf):
    docs = read_table(spark, sf, "documents").withColumn("raw", _spelling("doc_id"))
    return docs.select("doc_id", "raw", labels.normalize_has_url(F.col("raw")).alias("has_url"))


def _canonical(spark: SparkSession, sf: str) -> DataFrame:
    raw = emails(spark, sf).withColumn("has_url", F.col("has_url_raw"))
    return cleaning.to_canonical(raw, keep=["email_id"])


@query
def canonical_emails(spark, sf):
    return _canonical(spark, sf).select(
        "email_id", "source", "from_address", "label", "has_url",
        F.md5("text_combined").alias("text_md5"),
    )


def _clean_unique(spark: SparkSession, sf: str) -> DataFrame:
    # The sender is left out of the text so that copies of a document meet again.
    rows = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("email_id"), "source", F.col("text").alias("text_combined"),
        (F.col("doc_id") % 3 % 2).alias("label"),
    )
    return cleaning.keep_first(cleaning.clean(rows), ["email_id"])


@query
def clean_dedupe(spark, sf):
    return _clean_unique(spark, sf).select(
        "email_id", "source", "label", F.md5("text_combined").alias("text_md5")
    )


@query
def sanity_stats(spark, sf):
    before = read_table(spark, sf, "documents")
    return _rounded(profiling.sanity_stats(_clean_unique(spark, sf), before_count=before))


@query
def source_counts(spark, sf):
    return profiling.source_counts(emails(spark, sf))


@query
def source_proportions(spark, sf):
    return _rounded(profiling.source_proportions(emails(spark, sf)))


@query
def class_weights(spark, sf):
    labelled = emails(spark, sf).filter(F.col("label").isNotNull())
    return _rounded(profiling.class_weights(labelled))


def _split_emails(spark: SparkSession, sf: str) -> DataFrame:
    labelled = emails(spark, sf).filter(F.col("label").isNotNull())
    return splitting.stratified_split(labelled, 0.1, 0.1, seed=42, key_col="email_id")


@query
def stratified_split(spark, sf):
    return _split_emails(spark, sf).select("email_id", "label", "split")


@query
def split_counts(spark, sf):
    return splitting.split_counts(_split_emails(spark, sf))


@query
def preprocess_pipeline(spark, sf):
    """Clean, de-duplicate, split: rows per split and label."""
    rows = _canonical(spark, sf)
    prepared = preprocess_and_split(rows, ["email_id"], 0.1, 0.1, seed=42)
    return prepared.data.select("email_id", "label", "split")


@query
def split_sink(spark, sf):
    """The same pipeline through the partitioned sink: rows read back per folder."""
    rows = _canonical(spark, sf)
    prepared = preprocess_and_split(
        rows, ["email_id"], 0.1, 0.1, seed=42, output=run_dir(spark, "splits")
    )
    return splitting.split_counts(prepared.data)


@query
def benign_only(spark, sf):
    return keep_benign(_split_emails(spark, sf)).select("email_id", "source")


@query
def benign_only_all_rows(spark, sf):
    return keep_benign(emails(spark, sf), split=None).select("email_id", "source")


# --- CSV corpora ----------------------------------------------------------------------------


def _write_corpora(spark: SparkSession, sf: str) -> str:
    """The email table written out as CSV corpora in four layouts, in nested folders."""
    root = run_dir(spark, "corpora")
    table = emails(spark, sf).withColumn(
        "label_text", F.when(F.col("label") == 1, "Phishing Email").when(F.col("label") == 0, "ham")
    )
    pick = F.col("email_id") % 4
    layouts = {
        "mail/seven": table.filter(pick == 0).select(
            F.col("from_address").alias("sender"), F.lit("me@example.com").alias("receiver"),
            F.lit("2024-01-01").alias("date"), "subject", "body", F.col("label_text").alias("label"),
            F.col("has_url_raw").alias("urls"),
        ),
        "typed": table.filter(pick == 1).select(
            F.col("body").alias("Email Text"), F.col("label_text").alias("Email Type")
        ),
        "mail/deep/plain": table.filter(pick == 2).select("subject", "body", F.col("label_text").alias("label")),
        "combined": table.filter(pick == 3).select(
            F.col("body").alias("text_combined"), F.col("label_text").alias("label")
        ),
    }
    for name, rows in layouts.items():
        (
            rows.write.option("header", True).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(f"{root}/{name}")
        )
    return root


@query
def load_layouts(spark, sf):
    """Every layout through header detection; the file part of the source name is dropped."""
    root = _write_corpora(spark, sf)
    rows = labelled_csv.load_csv(spark, labelled_csv.discover_csv(spark, root))
    return rows.select(
        F.regexp_replace("source", "_part-.*$", "").alias("source"), "from_address", "label",
        "has_url", F.length("subject").alias("subject_chars"), F.md5("text_combined").alias("text_md5"),
    )


@query
def load_all(spark, sf):
    """Distinct combined texts over all corpora."""
    root = _write_corpora(spark, sf)
    rows = labelled_csv.load_all(spark, labelled_csv.discover_csv(spark, root))
    return rows.select(F.md5("text_combined").alias("text_md5"))


# --- features -------------------------------------------------------------------------------


def _feature_query(spark, sf, columns: list[str]) -> DataFrame:
    built = features.build_features(_flagged_emails(spark, sf), lookalike=False)
    return _rounded(built.select("email_id", *columns), char_entropy_text=4)


@query
def text_features(spark, sf):
    return _feature_query(spark, sf, features.FEATURE_COLUMNS[:23])


@query
def url_features(spark, sf):
    return _feature_query(spark, sf, features.FEATURE_COLUMNS[23:34])


@query
def sender_features(spark, sf):
    return _feature_query(
        spark, sf, features.FEATURE_COLUMNS[34:40] + ["source_missing", "from_subject_missing"]
    )


@query
def entropy(spark, sf):
    turns = read_table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", F.round(text.char_entropy(F.col("text")), 4).alias("entropy"))


@query
def bare_domains(spark, sf):
    rows = emails(spark, sf, labelled=False)
    return rows.select("email_id", urls.count_bare_domains(F.col("body")).alias("bare_domains"))


@query
def page_locations(spark, sf):
    """Location and root domain of page addresses."""
    pages = read_table(spark, sf, "pages").withColumn("netloc", urls.netloc(F.col("url")))
    return pages.select("page_id", "netloc", urls.root_domain(F.col("netloc")).alias("root_domain"))


def _sender_domains(spark: SparkSession, sf: str) -> DataFrame:
    sender = mail.sender_domain(F.lower(text.strip(F.col("from_address"))))
    return emails(spark, sf, labelled=False).select(sender.alias("domain"))


@query
def brand_edit_distance(spark, sf):
    """Edit distance of every distinct page and sender label to every brand label."""
    pages = read_table(spark, sf, "pages").select(urls.netloc(F.col("url")).alias("domain"))
    domains = pages.union(_sender_domains(spark, sf)).filter(F.col("domain") != "").distinct()
    norm = brand_match.normalize_domain(F.col("domain"))
    labelled = domains.withColumn("label", brand_match.domain_label(norm))
    brands = [b.split(".")[0] for b in K.KNOWN_BRAND_DOMAINS]
    return labelled.select(
        "domain", "label", *[F.levenshtein("label", F.lit(b)).alias(f"to_{b}") for b in brands]
    )


@query
def brand_match_domains(spark, sf):
    """Best brand per distinct sender and page domain."""
    pages = read_table(spark, sf, "pages").select(urls.netloc(F.col("url")).alias("domain"))
    domains = pages.union(_sender_domains(spark, sf))
    return _rounded(brand_match.domain_metrics(domains))


@query
def brand_table_match(spark, sf):
    """Altered names of pages against the table of all names of pages."""
    named = read_table(spark, sf, "pages").withColumn("host", urls.netloc(F.col("url"))).withColumns(
        {"word": F.regexp_extract("host", r"([^.]+)[.][^.]+[.]([^.]+)$", 1),
         "ending": F.regexp_extract("host", r"([^.]+)[.][^.]+[.]([^.]+)$", 2)}
    ).filter("word <> ''")
    altered = F.expr(
        """CASE page_id % 5 WHEN 0 THEN word WHEN 1 THEN replace(word, 'th', 't')
        WHEN 2 THEN concat(substring(word, 1, 2), '-', substring(word, 3)) WHEN 3 THEN replace(word, 'i', '1')
        ELSE concat('my', word, 'login') END"""
    )
    domains = named.select(F.concat_ws(".", altered, "ending").alias("domain"))
    brands = named.select(F.concat_ws(".", "word", "ending").alias("brand"))
    return _rounded(brand_table.match_brand_table(domains, brands))


@query
def lookalike_features(spark, sf):
    built = features.build_features(_flagged_emails(spark, sf))
    return _rounded(built.select("email_id", *features.FEATURE_COLUMNS[40:50]))


@query
def features_full(spark, sf):
    built = features.build_features(_flagged_emails(spark, sf))
    matrix = features.feature_matrix(built).select("email_id", *features.FEATURE_COLUMNS)
    return _rounded(matrix, char_entropy_text=4)


# --- messages and markup --------------------------------------------------------------------


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages")


@query
def html_text(spark, sf):
    content = _pages(spark, sf).select("page_id", markup.page_content(F.col("html")).alias("c"))
    return content.select("page_id", markup.html_text(F.col("c")).alias("text"))


def _linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with absolute, wrapped, tracking and repeated links added to their own."""
    wrapped = F.concat(
        F.lit(f"https://eur01.{K.SAFELINKS_HOST}/?url="), F.url_encode(F.col("url")), F.lit("&data=1")
    )

    def anchor(target: Column) -> Column:
        return F.concat(F.lit('<a href="'), target, F.lit('">go</a>'))

    html = F.concat(
        "html",
        anchor(F.concat(F.col("url"), F.lit("#top"))),
        F.when(F.col("page_id") % 3 == 0, anchor(wrapped)).otherwise(""),
        F.when(F.col("page_id") % 5 == 0, anchor(F.concat(F.col("url"), F.lit("/pixel.gif")))).otherwise(""),
        F.when(F.col("page_id") % 7 == 0, anchor(F.concat(F.col("url"), F.lit("#top")))).otherwise(""),
        F.lit('<a href="HTTP://UPPER.example.com/">up</a><a href="mailto:x@example.com">mail</a>'),
    )
    content = _pages(spark, sf).withColumn("content", markup.page_content(html))
    return content.select("page_id", F.col("content.hrefs").alias("hrefs"))


@query
def href_links(spark, sf):
    return messages.link_table(_linked_pages(spark, sf), "page_id", "hrefs")


@query
def clean_links(spark, sf):
    """Links of a page as one ordered list."""
    pages = _linked_pages(spark, sf)
    return pages.select("page_id", F.array_join(urls.clean_hrefs(F.col("hrefs")), " ").alias("links"))


@query
def safelinks(spark, sf):
    pages = read_table(spark, sf, "pages")
    wrapped = F.when(
        F.col("page_id") % 2 == 0,
        F.concat(
            F.lit(f"https://nam02.{K.SAFELINKS_HOST}/?data=x&url="),
            F.url_encode(F.url_encode(F.col("url"))),
        ),
    ).otherwise(F.concat(F.col("url"), F.lit("&url="), F.url_encode(F.col("url"))))
    return pages.select(
        "page_id", urls.unwrap_safelink(wrapped).alias("target"), urls.is_tracking(F.col("url")).alias("tracking")
    )


def _auth_headers() -> Column:
    """Authentication headers as they arrive, derived from the DKIM columns."""
    result = F.concat(
        F.lit("mx.example.net; spf=pass; dkim"),
        F.when(F.col("email_id") % 2 == 0, "=").otherwise(" = "),
        F.when(F.col("dkim_pass"), "PASS").otherwise("fail"),
        F.when(
            F.col("dkim_domain").isNotNull(), F.concat(F.lit(" header.i=@Mail."), F.col("dkim_domain"))
        ).otherwise(""),
    )
    return F.array(F.lit("mx.example.net; spf=none"), result)


@query
def auth_results(spark, sf):
    header = mail.dkim_header(_auth_headers())
    return emails(spark, sf, labelled=False).select(
        "email_id", header.isNotNull().alias("passed"), mail.dkim_domain(header).alias("domain")
    )


@query
def attachments(spark, sf):
    names = F.array(
        F.concat(F.lit("Invoice."), F.col("email_id").cast("string"), F.upper(F.coalesce("attachment_ext", F.lit("")))),
        F.lit("README"),
    )
    exts = mail.attachment_extensions(names)
    return emails(spark, sf, labelled=False).select(
        "email_id", F.array_join(exts, "|").alias("extensions"), F.size(names).alias("attachment_count")
    )


@query
def bare_addresses(spark, sf):
    header = F.when(
        F.col("email_id") % 2 == 0, F.concat(F.lit("Some One < "), F.col("from_address"), F.lit(" >"))
    ).otherwise(F.col("from_address"))
    return emails(spark, sf, labelled=False).select("email_id", mail.bare_address(header).alias("address"))


@query
def body_lines(spark, sf):
    turns = read_table(spark, sf, "conversations")
    padded = F.replace(F.col("text"), F.lit("\n"), F.lit(" \n \t\n  "))
    return turns.select("conv_id", "turn", text.normalise_lines(padded).alias("body"))


def _raw_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Raw message bytes built from the email table: plain, HTML and multipart."""
    nl = F.lit("\n")
    # base64() breaks lines every 76 characters, which would end the header.
    encoded = F.translate(F.base64(F.encode("subject", "utf-8")), "\r\n", "")
    subject = F.concat(F.lit("=?utf-8?B?"), encoded, F.lit("?="))
    head = F.concat(
        F.lit("From: Sender <"), F.col("from_address"), F.lit(">\nSubject: "), subject, nl,
        F.lit("Authentication-Results: "), F.get(_auth_headers(), 1), nl, F.lit("MIME-Version: 1.0\n"),
    )
    plain = F.concat(
        F.lit('Content-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n'), F.col("body")
    )
    html = F.concat(
        F.lit("Content-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"),
        F.lit("<html><head><title>t</title></head><body><p>"), F.col("markup_text"),
        F.lit('</p><a href="https://www.example.com/a">x</a></body></html>'),
    )
    attachment = F.concat(
        F.lit('\n--frontier\nContent-Type: application/octet-stream; name="f'), F.coalesce("attachment_ext", F.lit("")),
        F.lit('"\nContent-Disposition: attachment; filename="file'), F.coalesce("attachment_ext", F.lit("")),
        F.lit('"\n\nAAAA\n--frontier--\n'),
    )
    multipart = F.concat(
        F.lit('Content-Type: multipart/mixed; boundary="frontier"\n\n--frontier\n'), plain, attachment
    )
    kind = F.col("email_id") % 3
    content = F.concat(head, F.when(kind == 0, plain).when(kind == 1, html).otherwise(multipart))
    table = emails(spark, sf).withColumn("markup_text", F.replace("body", F.lit("<"), F.lit("&lt;")))
    return table.select(
        "email_id", "label", F.concat(F.lit("/mail/"), F.col("email_id"), F.lit(".eml")).alias("path"),
        F.encode(content, "utf-8").alias("content"),
    )


@query
def parse_messages(spark, sf):
    return _message_fields(messages.parse_messages(_raw_messages(spark, sf)))


@query
def corpus_results(spark, sf):
    """Raw messages to the results report, rules only."""
    parsed = messages.parse_messages(_raw_messages(spark, sf))
    named = parsed.withColumn("file", reports.file_name(F.col("path")))
    return reports.results_report(score_emails(named))


def _message_folder(spark: SparkSession, sf: str) -> str:
    """A folder of message files, in sub-folders, made from the email table."""
    folder = run_dir(spark, "messages")
    name = F.concat(F.lit("box"), F.col("email_id") % 7, F.lit("/"), F.col("email_id"), F.lit(".eml"))
    message_files.write_messages(_raw_messages(spark, sf).select(name.alias("name"), "content"), folder)
    return folder


def _message_fields(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        reports.file_name(F.col("path")).alias("file"), "from_address", "subject", "urls_found",
        "attachment_count", F.array_join("attachment_extensions", "|").alias("extensions"),
        F.array_join("attachment_filenames", "|").alias("filenames"), "dkim_pass", "dkim_domain",
        F.md5("body").alias("body_md5"), F.length("body").alias("body_chars"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query
def eml_source(spark, sf):
    """Message files read through the data source and parsed."""
    return _message_fields(messages.parse_messages(message_files.read_messages(spark, _message_folder(spark, sf))))


@query
def eml_source_limit(spark, sf):
    """The first half of the message files by path."""
    folder = _message_folder(spark, sf)
    half = len(message_files.message_files(folder)) // 2
    found = message_files.read_messages(spark, folder, limit=half) if half else message_files.read_messages(spark, folder).limit(0)
    return found.select(reports.file_name(F.col("path")).alias("file"), (F.length("content") == F.col("length")).alias("whole"))


@query
def stream_messages(spark, sf):
    """Message files as a stream in several batches, to verdicts and errors."""
    files = message_file_stream(spark, _message_folder(spark, sf), files_per_trigger=4000)
    output = run_dir(spark, "stream-messages")
    start_message_scoring(files, f"{output}/data", f"{output}/checkpoint").awaitTermination()
    return reports.results_report(read_scored(spark, f"{output}/data"))


@query
def charset_bodies(spark, sf):
    """Bodies in declared, missing, unknown and wrong character sets."""
    text = F.col("body")
    kind = F.when(text.rlike("[^\\x00-\\xFF]"), 0).otherwise(F.col("email_id") % 5)
    declared = (
        F.when(kind == 0, '; charset="utf-8"').when(kind == 1, "; charset=iso-8859-1").when(kind == 2, "")
        .when(kind == 3, "; charset=x-no-such-set").otherwise("; charset=us-ascii")
    )
    head = F.concat(
        F.lit("From: a@example.com\nMIME-Version: 1.0\nContent-Type: text/plain"), declared,
        F.lit("\nContent-Transfer-Encoding: 8bit\n\n"),
    )
    content = F.concat(
        F.encode(head, "utf-8"), F.when(kind == 1, F.encode(F.when(kind == 1, text), "iso-8859-1")).otherwise(F.encode(text, "utf-8"))
    )
    rows = emails(spark, sf, labelled=False).select(F.col("email_id").cast("string").alias("path"), content.alias("content"))
    parsed = messages.parse_messages(rows)
    return parsed.select(
        F.col("path").cast("long").alias("email_id"), F.md5("body").alias("body_md5"), F.length("body").alias("body_chars")
    )


# --- models ---------------------------------------------------------------------------------


@query
def tfidf_vectors(spark, sf):
    """Sparse unit-length TF-IDF vectors, one row per email and term."""
    rows = stage(_flagged_emails(spark, sf).select("email_id", "text_combined"), "texts")
    top = term_weights.vocabulary(term_weights.term_stats(rows))
    weights = stage(term_weights.idf_weights(top, rows.count()).select("term", "idf"), "vocabulary")
    return _rounded(term_weights.tfidf_rows(rows, weights, "email_id"))


@query
def tfidf_terms_pruned(spark, sf):
    """The vocabulary with a sketch that keeps rare terms out of the exchange."""
    rows = stage(_flagged_emails(spark, sf).select("text_combined"), "texts")
    top = term_sketch.frequent_terms(rows)
    return _rounded(term_weights.idf_weights(top, rows.count()).select("term", "tf", "df", "idf"))


@query
def tfidf_terms(spark, sf):
    rows = _flagged_emails(spark, sf)
    top = term_weights.vocabulary(term_weights.term_stats(rows))
    return _rounded(
        term_weights.idf_weights(top, rows.count()).select("term", "tf", "df", "idf")
    )


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged_emails(spark, sf, labelled=True).filter(F.col("label").isNotNull())


def _classifier_scores(spark, sf, model: str) -> DataFrame:
    rows = _labelled(spark, sf)
    fitted = text_classifier.train_classifier(rows, model)
    return _rounded(fitted.score(rows).select("email_id", "supervised_proba", "prediction"))


@query
def logreg_scores(spark, sf):
    return _classifier_scores(spark, sf, "logreg")


@query
def svm_scores(spark, sf):
    return _classifier_scores(spark, sf, "linear_svm")


def _training_rows(spark: SparkSession, sf: str) -> DataFrame:
    split = splitting.stratified_split(_labelled(spark, sf), key_col="email_id")
    return stage(split.select("text_combined", "label", "split"), "training")


@query
def training_metrics(spark, sf):
    """A whole training run: metrics of every split."""
    return _rounded(run_training(_training_rows(spark, sf), "logreg")[1])


@query
def training_files(spark, sf):
    """What a training run has written: rows of each split in the metrics file, and the number of
    features there and in the saved model."""
    path = run_dir(spark, "training-run")
    run_training(_training_rows(spark, sf), "linear_svm", path)
    saved = text_classifier.load_classifier(spark, f"{path}/linear_svm")
    return spark.read.json(f"{path}/linear_svm_metrics").select(
        "split", "rows", "num_features", F.lit(int(saved.model.numFeatures)).cast("long").alias("saved_features")
    )


@query
def sequence_scores(spark, sf):
    """The pluggable scorer with logits that depend on the text length only; rows a hard rule
    has decided are skipped."""

    def factory():
        return lambda texts: np.array([[(len(t) % 7 - 3) / 2, (len(t) % 11 - 5) / 2] for t in texts])

    scored = rules.score_rules(emails(spark, sf, labelled=False)).drop("transformer_proba")
    scored = sequence_scorer.with_sequence_proba(scored, factory, skip=F.col("hard_block"))
    return _rounded(scored.select("email_id", "transformer_proba"))


@query
def bad_targets(spark, sf):
    rows = emails(spark, sf).withColumn("target", _spelling("email_id"))
    return text_classifier.count_bad_targets(rows, "target")


@query
def margin_probability(spark, sf):
    margin = (F.col("email_id") % 17 - 8) / 4.0
    return _rounded(emails(spark, sf, labelled=False).select("email_id", scores.sigmoid(margin).alias("proba")))


@query
def softmax_temperature(spark, sf):
    logit0, logit1 = (F.col("email_id") % 7 - 3) / 2.0, (F.col("email_id") % 11 - 5) / 2.0
    return _rounded(
        emails(spark, sf, labelled=False).select(
            "email_id",
            scores.softmax_positive(logit0, logit1).alias("proba"),
            scores.argmax_prediction(logit0, logit1).alias("prediction"),
        )
    )


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return (
        emails(spark, sf)
        .filter(F.col("label").isNotNull())
        .select(
            "source", "label", F.col("supervised_proba").alias("score"),
            (F.col("supervised_proba") >= 0.55).cast("int").alias("prediction"),
        )
    )


@query
def binary_metrics(spark, sf):
    return _rounded(metrics.binary_metrics(_predictions(spark, sf)))


@query
def binary_metrics_by_source(spark, sf):
    return _rounded(metrics.binary_metrics(_predictions(spark, sf), by=["source"]))


@query
def roc_auc(spark, sf):
    return _rounded(metrics.roc_auc(_predictions(spark, sf)))


@query
def isolation_scores(spark, sf):
    featured = features.build_features(_flagged_emails(spark, sf, labelled=True))
    table = stage(featured.select("email_id", "label", *features.FEATURE_COLUMNS), "features")
    benign = table.filter(F.col("label") == 0)
    forest = isolation.train_isolation_forest(benign, features.FEATURE_COLUMNS, "email_id")
    return _rounded(forest.score(forest.raw_score(table)).select(
        "email_id", "isolation_raw", "isolation_score",
        isolation.outlier_flag(F.col("isolation_raw"), forest.threshold).alias("outlier"),
    ))


@query
def embedding_outliers(spark, sf):
    """The same forest on the vectors of the embedding table."""
    vectors = read_table(spark, sf, "embeddings")
    widths = vectors.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if widths.low != widths.high:
        raise ValueError(f"vectors of {widths.low} to {widths.high} components")
    width = widths.low
    names = [f"x{i}" for i in range(width)]
    table = vectors.select(
        "vec_id", *[F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(names)]
    )
    forest = isolation.train_isolation_forest(table, names, "vec_id", contamination=0.1)
    raw = forest.raw_score(table)
    return _rounded(raw.select(
        "vec_id", "isolation_raw",
        isolation.outlier_flag(F.col("isolation_raw"), forest.threshold).alias("outlier"),
    ))


@query
def scorer_text_column(spark, sf):
    """A classifier on the subject through the scoring plan: its scores are those it gives by
    itself, and rows that a hard rule decides have none."""
    fitted = text_classifier.train_classifier(_labelled(spark, sf), "logreg", text_col="subject")
    rows = fitted.score(rules.with_defaults(emails(spark, sf, labelled=False)), "direct").drop("prediction")
    scored = score_emails(rows, Scorers(supervised=fitted))
    differs = F.abs(F.col("direct") - F.col("supervised_proba")) > 1e-9
    return scored.agg(
        F.count("*").alias("emails"), F.count_if("hard_block").alias("blocked"),
        F.count_if(~F.col("hard_block") & F.coalesce(differs, F.lit(True))).alias("mismatches"),
        F.count_if(F.col("hard_block") & F.col("supervised_proba").isNotNull()).alias("scored_blocks"),
    )


@query
def classifier_quality(spark, sf):
    """Both linear models on their training rows: probabilities in range, better than chance."""
    rows = _labelled(spark, sf)
    parts = []
    for model in text_classifier.MODELS:
        fitted = text_classifier.train_classifier(rows, model)
        scored = fitted.score(rows).select("label", "prediction", F.col("supervised_proba").alias("score"))
        right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
        parts.append(scored.agg(
            F.lit(model).alias("model"), F.count("*").alias("emails"),
            (F.min("score") >= 0).alias("from_0"), (F.max("score") <= 1).alias("to_1"), (right > 0.9).alias("fits"),
        ))
    return parts[0].unionByName(parts[1])


@query
def svm_optimality(spark, sf):
    """The support vector machine is at its minimum: the gradient there, summed anew from the rows
    of (email, term, weight), against the gradient at zero."""
    rows = _labelled(spark, sf)
    fitted = text_classifier.train_classifier(rows, "linear_svm")
    terms, idf = term_weights.fitted_weights(fitted.vectors)
    weights = spark.createDataFrame(
        pd.DataFrame({"term": terms, "idf": idf, "coefficient": fitted.model.coefficients.toArray()})
    )
    intercept = F.lit(float(fitted.model.intercept))
    y = F.col("label") * 2.0 - 1.0
    emails_ = rows.select("email_id", y.alias("y"), text_classifier.balanced_weight(rows, "label").alias("c"))
    parts = stage(term_weights.tfidf_rows(rows, weights, "email_id"), "parts")
    margins = parts.join(weights, "term").groupBy("email_id").agg(F.sum(F.col("weight") * F.col("coefficient")).alias("m"))
    short = F.greatest(F.lit(0.0), 1 - F.col("y") * (F.coalesce("m", F.lit(0.0)) + intercept))
    pulls = emails_.join(margins, "email_id", "left").select(
        "email_id", (-2 * F.col("c") * F.col("y") * short).alias("pull"), (-2 * F.col("c") * F.col("y")).alias("pull_0")
    )
    # The intercept is the coefficient of a term that every email has once.
    held = parts.unionByName(emails_.select("email_id", F.lit("").alias("term"), F.lit(1.0).alias("weight")))
    own = weights.select("term", "coefficient").union(spark.range(1).select(F.lit(""), intercept))
    summed = held.join(pulls, "email_id").groupBy("term").agg(
        F.sum(F.col("weight") * F.col("pull")).alias("g"), F.sum(F.col("weight") * F.col("pull_0")).alias("g_0"),
        F.count("*").alias("emails"),
    ).join(own, "term", "right")
    left = F.coalesce("g", F.lit(0.0)) + F.col("coefficient")
    return summed.agg(
        F.max(F.when(F.col("term") == "", F.col("emails"))).alias("emails"),
        (F.sqrt(F.sum(left * left)) <= 2e-4 * F.sqrt(F.sum(F.col("g_0") * F.col("g_0")))).alias("optimal"),
    )


def _vectors(spark: SparkSession, sf: str, width: int = 2) -> DataFrame:
    """The first components of the vectors as columns."""
    parts = [F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(width)]
    return read_table(spark, sf, "embeddings").select("vec_id", *parts)


def _whole_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """All components, and their names."""
    width = read_table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 1
    return _vectors(spark, sf, width), [f"x{i}" for i in range(width)]


@query
def fixed_forest_scores(spark, sf):
    """A forest given as rows, walked by every vector."""
    columns = ["tree", "node", "feature", "threshold", "left_child", "right_child", "path"]
    nodes = pd.DataFrame(
        [
            (0, 0, 0, 0.0, 1, 2, 0.0), (0, 1, -1, 0.0, -1, -1, 2.5), (0, 2, 1, 0.05, 3, 4, 0.0),
            (0, 3, -1, 0.0, -1, -1, 3.0), (0, 4, -1, 0.0, -1, -1, 1.5),
            (1, 0, 1, 0.0, 1, 2, 0.0), (1, 1, -1, 0.0, -1, -1, 2.0), (1, 2, -1, 0.0, -1, -1, 4.0),
        ],
        columns=columns,
    )
    forest = isolation.IsolationForest(nodes, ["x0", "x1"], 256)
    scored = forest.score(forest.raw_score(_vectors(spark, sf)))
    return _rounded(scored.select("vec_id", "isolation_raw", "isolation_score"))


@query
def outlier_share(spark, sf):
    """How many vectors a forest with a contamination of 10 % calls outliers."""
    table, parts = _whole_vectors(spark, sf)
    forest = isolation.train_isolation_forest(table, parts, "vec_id", contamination=0.1)
    flag = isolation.outlier_flag(F.col("isolation_raw"), forest.threshold)
    return forest.raw_score(table).agg(F.count("*").alias("vectors"), F.sum(flag).alias("outliers"))


@query
def forest_roundtrip(spark, sf):
    """A forest saved and loaded scores as before."""
    table, parts = _whole_vectors(spark, sf)
    forest = isolation.train_isolation_forest(table, parts, "vec_id")
    path = run_dir(spark, "forest")
    forest.save(path)
    both = isolation.load_forest(spark, path).raw_score(forest.raw_score(table, "before"), "after")
    return both.agg(F.count("*").alias("vectors"), F.count_if(F.col("before") != F.col("after")).alias("mismatches"))


@query
def benign_job(spark, sf):
    """CSV corpora to the written table of benign rows."""
    root = _write_corpora(spark, sf)
    benign = build_benign(spark, root, run_dir(spark, "benign"), dedupe=False)
    return benign.select("label", F.md5("text_combined").alias("text_md5"))


@query
def splits_job(spark, sf):
    """CSV corpora to written splits: every text, in one split."""
    job = build_splits(spark, _write_corpora(spark, sf), run_dir(spark, "job-splits"))
    return job.data.select(
        F.md5("text_combined").alias("text_md5"), F.col("split").isin(["train", "val", "test"]).alias("placed")
    )


@query
def report_files(spark, sf):
    """The evaluation reports written as files and read back: rows of each."""
    parsed = messages.parse_messages(_raw_messages(spark, sf))
    paths = write_evaluation(evaluate_corpus(parsed, truth="benign"), run_dir(spark, "reports"))
    parts = [
        spark.read.option("header", True).option("sep", "\t" if name == "errors" else ",")
        .option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
        .agg(F.lit(name).alias("report"), F.count("*").alias("written"))
        for name, path in sorted(paths.items()) if name in ("results", "review", "errors")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def isolation_binary(spark, sf):
    """Outlier flags of given raw scores at a contamination of 10 %."""
    rows = emails(spark, sf).select("email_id", F.col("transformer_proba").alias("raw"))
    threshold = isolation.exact_quantile(rows, "raw", 0.9)
    return _rounded(rows.select(
        "email_id", scores.sigmoid(F.col("raw")).alias("score"),
        isolation.outlier_flag(F.col("raw"), threshold).alias("outlier"),
        isolation.outlier_flag(F.col("raw")).alias("outlier_auto"),
    ))


# --- reports --------------------------------------------------------------------------------


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of files, some of which could not be read."""
    problem = F.when(F.col("email_id") % 50 == 7, F.concat(F.lit("cannot read\nmessage "), F.col("email_id")))
    table = emails(spark, sf).withColumns(
        {
            "file": F.concat(F.col("email_id"), F.lit(".eml")),
            "urls_found": (F.col("email_id") % 4).cast("int"),
            "error": problem,
        }
    )
    return score_emails(table)


@query
def results_report(spark, sf):
    return reports.results_report(_files(spark, sf))


@query
def review_report(spark, sf):
    sound = stage(_files(spark, sf), "verdicts").filter(F.col("error").isNull())
    return reports.review_report(sound, truth="benign")


@query
def errors_report(spark, sf):
    return reports.errors_report(_files(spark, sf))


@query
def eval_summary(spark, sf):
    return reports.eval_summary(reports.results_report(_files(spark, sf)))


@query
def label_metrics(spark, sf):
    return reports.label_metrics(reports.results_report(_files(spark, sf)), "phish")


@query
def score_bands(spark, sf):
    return reports.score_bands(_verdicts(spark, sf))


# --- streaming ------------------------------------------------------------------------------


@query
def stream_verdicts(spark, sf):
    """Verdicts of the document table read as a stream of files."""
    documents = table_stream(spark, sf, "documents")
    table = emails_from(documents, read_table(spark, sf, "labels"))
    output = run_dir(spark, "stream-verdicts")
    running = start_scoring(
        table, f"{output}/data", f"{output}/checkpoint", Scorers(),
        columns=["email_id", "is_phish", "confidence", "triggered_by", "rule_score"],
    )
    running.awaitTermination()
    result = spark.read.schema(
        "email_id long, is_phish int, confidence double, triggered_by string, rule_score int"
    ).parquet(f"{output}/data")
    return _rounded(result)
