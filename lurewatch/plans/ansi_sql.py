r"""The registered queries once more, as SQL for an independent engine with RE2 patterns.

Written against the definitions of the operators, not against their Spark expressions.  RE2 has
neither look-arounds nor Unicode word boundaries: non-ASCII letters are masked by ``_`` first,
which keeps ``\b`` where it belongs.
"""

from __future__ import annotations

from lurewatch import constants as K
from lurewatch.operators import features
from lurewatch.operators.rules import DEFAULT_RULES
from lurewatch.plans.fixture import EMAILS_SQL
from lurewatch.plans.registered import LABEL_SPELLINGS

ORACLE: dict[str, str] = {}

WS = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LETTERS = r"\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2c1}\x{370}-\x{1fff}\x{2c00}-\x{2dff}\x{3040}-\x{d7ff}"
URL = rf"(?i)https?://[^{WS}<>''\x22]+"


def words(terms: list[str]) -> str:
    body = "|".join(t.replace(".", r"\.").replace("~", f"[{WS}]+") for t in terms)
    return rf"(?i)\b(?:{body})\b"


def in_list(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def strip(expr: str) -> str:
    return rf"regexp_replace(regexp_replace({expr}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def hits(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, '{pattern}')) AS INTEGER)"


def flag(condition: str) -> str:
    return f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS INTEGER)"


def netloc(url: str) -> str:
    return f"split_part(lower(regexp_extract({url}, '^(?i:https?)://([^/?#]*)', 1)), ':', 1)"


def root(domain: str) -> str:
    d = f"lower(trim({domain}))"
    parts = f"list_filter(string_split({d}, '.'), lambda p: p <> '')"
    last_two = f"array_to_string(({parts})[-2:], '.')"
    return (
        f"CASE WHEN len({parts}) < 2 THEN {d} "
        f"WHEN len({parts}) >= 3 AND {last_two} IN {in_list(K.TWO_LEVEL_SUFFIXES)} "
        f"THEN array_to_string(({parts})[-3:], '.') ELSE {last_two} END"
    )


def after_at(address: str) -> str:
    return (
        f"CASE WHEN contains({address}, '@') "
        f"THEN list_extract(string_split(lower({address}), '@'), -1) ELSE '' END"
    )


def normalise_lines(expr: str) -> str:
    squeezed = rf"regexp_replace({expr}, '[ \t]+', ' ', 'g')"
    lines = rf"string_split_regex({squeezed}, '\r\n|[\n\r\x0b\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    kept = f"list_filter({lines}, lambda l: regexp_matches(l, '[^{WS}]'))"
    return strip(rf"array_to_string({kept}, chr(10))")


EMAILS = EMAILS_SQL.format(
    label="l.toxic", tables="documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
).strip()
BASE = f"""WITH RECURSIVE emails AS ({EMAILS}),
mail AS (SELECT *, concat('FROM: ', from_address, ' SUBJECT: ', subject, ' BODY: ', body) AS tc FROM emails),
m AS (SELECT *, regexp_replace(tc, '[{LETTERS}]', '_', 'g') AS tcm,
  regexp_replace(body, '[{LETTERS}]', '_', 'g') AS bm,
  regexp_extract_all(tc, '{URL}') AS urls,
  {after_at('from_address')} AS sender FROM mail)"""


def over_emails(sql: str) -> str:
    return f"{BASE}\n{sql}"


# --- rules ----------------------------------------------------------------------------------

_LOCS = f"list_transform(urls, lambda u: {netloc('u')})"
_SHORTENER = (
    r"(?i)\b(?:https?://)?(?:www\.)?(?:"
    + "|".join(h.replace(".", r"\.") for h in K.SHORTENER_HOSTS)
    + rf")(?:/[^{WS}<>''\x22]*)?"
)
_BRAND_TERMS = "|".join(d.split(".")[0] for d in K.KNOWN_BRAND_DOMAINS)
_CONDITIONS = {
    "malicious_attachment_ext": f"coalesce(attachment_ext, '') IN {in_list(K.HARD_BLOCK_EXTENSIONS)}",
    "suspicious_attachment_lure": (
        f"coalesce(attachment_ext, '') IN {in_list(K.SUSPICIOUS_EXTENSIONS + K.HARD_BLOCK_EXTENSIONS)} "
        f"AND regexp_matches(tcm, '{words(K.ATTACHMENT_LURE_TERMS)}')"
    ),
    "free_sender_brand_text": (
        f"sender IN {in_list(K.FREE_EMAIL_DOMAINS)} AND regexp_matches(lower(tc), '{_BRAND_TERMS}')"
    ),
    "sender_url_domain_mismatch": (
        f"len(urls) > 0 AND ({root('sender')}) <> '' AND ({root('locs[1]')}) <> '' "
        f"AND ({root('sender')}) <> ({root('locs[1]')})"
    ),
    "ip_url": r"len(list_filter(locs, lambda d: regexp_matches(d, '^\d{1,3}(\.\d{1,3}){3}$'))) > 0",
    "risky_tld": (
        "len(list_filter(locs, lambda d: coalesce(list_extract(list_filter(string_split(d, '.'), "
        f"lambda p: p <> ''), -1), '') IN {in_list(K.RISKY_TLDS)})) > 0"
    ),
    "shortener": f"regexp_matches(tcm, '{_SHORTENER}')",
    "urgent_or_action": (
        f"(regexp_matches(tcm, '{words(K.URGENT_TERMS)}') OR regexp_matches(tcm, '{words(K.ACTION_TERMS)}'))"
    ),
    "credentials_with_url": f"len(urls) > 0 AND regexp_matches(tcm, '{words(K.CREDENTIAL_TERMS)}')",
    "crypto_with_url": f"len(urls) > 0 AND regexp_matches(tcm, '{words(K.CRYPTO_TERMS)}')",
    "punycode_domain": (
        r"len(list_filter(locs, lambda d: contains(d, 'xn--') OR regexp_matches(d, '[^\x00-\x7f]'))) > 0"
    ),
    "subject_missing_with_url": f"{strip('subject')} = '' AND len(urls) > 0",
    "many_urls": "len(list_distinct(urls)) >= 3",
}
_FLAGS = ",\n  ".join(f"({_CONDITIONS[r.rule_id]}) AS r_{r.rule_id}" for r in DEFAULT_RULES)
_SCORE = " + ".join(f"CASE WHEN r_{r.rule_id} THEN {r.weight} ELSE 0 END" for r in DEFAULT_RULES)
_MATCHES = (
    "array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN r_{r.rule_id} THEN '{r.rule_id}' END" for r in DEFAULT_RULES)
    + "], lambda x: x IS NOT NULL), '|')"
)
_S, _T = "supervised_proba", "transformer_proba"
_TRUST_MAP = " OR ".join(
    f"(dkim_root = '{platform}' AND sender IN {in_list(senders)})"
    for platform, senders in K.TRUSTED_FROM_SUBDOMAINS.items()
)


def verdict_ctes(source: str = "m") -> str:
    """CTEs from a message table up to ``v``, the verdicts."""
    return f""",
l AS (SELECT *, {_LOCS} AS locs, {root("coalesce(dkim_domain, '')")} AS dkim_root FROM {source}),
f AS (SELECT *, {_FLAGS} FROM l),
s AS (SELECT *, CAST({_SCORE} AS INTEGER) AS rule_score, {_MATCHES} AS matches,
  (r_malicious_attachment_ext OR r_ip_url OR r_punycode_domain) AS hard_block,
  (dkim_pass AND ((coalesce(dkim_domain, '') <> '' AND dkim_root IN {in_list(K.TRUSTED_SENDING_DOMAINS)})
    OR {_TRUST_MAP})) AS dkim_trusted FROM f),
v AS (SELECT * EXCLUDE ({_S}, {_T}),
  CASE WHEN NOT hard_block THEN {_S} END AS {_S}, CASE WHEN NOT hard_block THEN {_T} END AS {_T},
  CASE WHEN hard_block THEN 'rules' WHEN dkim_trusted THEN NULL
   WHEN {_T} >= 0.995 THEN 'transformer_certain'
   WHEN {_T} >= 0.99 AND {_S} >= 0.55 THEN 'transformer_corroborated'
   WHEN {_T} >= 0.95 AND rule_score >= 2 THEN 'transformer_rule_corroborated'
   WHEN {_T} >= 0.97 AND {_S} >= 0.40 THEN 'transformer_dominant'
   WHEN {_S} >= 0.55 AND {_T} >= 0.75 THEN 'ml_consensus'
   WHEN rule_score >= 3 AND ({_S} >= 0.55 OR {_T} >= 0.75) THEN 'rule_assisted' END AS triggered_by
  FROM s),
w AS (SELECT *, CAST(CASE WHEN triggered_by IS NULL THEN 0 ELSE 1 END AS INTEGER) AS is_phish,
  CASE WHEN triggered_by IS NULL THEN 1.0 - greatest({_S}, {_T})
   WHEN triggered_by = 'rules' THEN 1.0
   WHEN triggered_by IN ('transformer_corroborated', 'ml_consensus') THEN ({_S} + {_T}) / 2
   WHEN triggered_by = 'rule_assisted' THEN greatest({_S}, {_T}) ELSE {_T} END AS confidence FROM v)"""


VERDICTS = BASE + verdict_ctes()

ORACLE["rule_score"] = f"{VERDICTS} SELECT email_id, rule_score, hard_block FROM s"
ORACLE["rule_matches"] = f"{VERDICTS} SELECT email_id, matches FROM s"
ORACLE["rule_profile"] = f"{VERDICTS} " + " UNION ALL ".join(
    f"SELECT '{r.rule_id}' AS rule_id, {r.weight} AS weight, count(*) AS emails, "
    f"count(*) FILTER (label = 1) AS phish_emails, count(*) FILTER (label = 0) AS benign_emails "
    f"FROM s WHERE r_{r.rule_id} HAVING count(*) > 0"
    for r in DEFAULT_RULES
)
ORACLE["verdicts"] = f"""{VERDICTS} SELECT email_id, is_phish, round(confidence, 6) AS confidence,
 triggered_by, rule_score, dkim_trusted, round({_S}, 6) AS {_S}, round({_T}, 6) AS {_T} FROM w"""
ORACLE["stream_verdicts"] = f"""{VERDICTS} SELECT email_id, is_phish, round(confidence, 6) AS confidence,
 triggered_by, rule_score FROM w"""
ORACLE["verdict_summary"] = f"""{VERDICTS} SELECT coalesce(triggered_by, 'benign') AS path,
 count(*) AS emails, count(*) FILTER (dkim_trusted) AS trusted_emails,
 CAST(sum(rule_score) AS BIGINT) AS rule_points FROM w GROUP BY 1"""

# --- normalising, cleaning, profiling, splitting --------------------------------------------


def binary(expr: str, positive, negative) -> str:
    t = f"lower({strip(expr)})"
    return (
        f"CAST(CASE WHEN {t} IN {in_list(positive)} THEN 1 "
        f"WHEN {t} IN {in_list(negative)} THEN 0 END AS INTEGER)"
    )


def _spelled(id_col: str) -> str:
    return f"({array(LABEL_SPELLINGS)})[({id_col} % {len(LABEL_SPELLINGS)}) + 1]"


_DOCS_RAW = f"(SELECT doc_id, {_spelled('doc_id')} AS raw FROM documents)"
ORACLE["normalize_label"] = (
    f"SELECT doc_id, raw, {binary('raw', K.LABEL_POSITIVE, K.LABEL_NEGATIVE)} AS label FROM {_DOCS_RAW}"
)
ORACLE["normalize_has_url"] = (
    f"SELECT doc_id, raw, {binary('raw', K.FLAG_POSITIVE, K.FLAG_NEGATIVE)} AS has_url FROM {_DOCS_RAW}"
)
_HAS_URL = binary("has_url_raw", K.FLAG_POSITIVE, K.FLAG_NEGATIVE)
_USABLE = f"label IS NOT NULL AND {strip('body')} <> ''"
ORACLE["canonical_emails"] = over_emails(
    f"""SELECT email_id, source, from_address, label, {_HAS_URL} AS has_url, md5(tc) AS text_md5
FROM m WHERE {_USABLE}"""
)


def collapsed(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[{WS}]+', ' ', 'g'))"


_UNIQUE = f"""WITH c AS (SELECT doc_id AS email_id, source, CAST(doc_id % 3 % 2 AS BIGINT) AS label,
 {collapsed('text')} AS t FROM documents),
u AS (SELECT * FROM c WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY t ORDER BY email_id) = 1)"""
ORACLE["clean_dedupe"] = (
    f"{_UNIQUE} SELECT email_id, source, CAST(label AS INTEGER) AS label, md5(t) AS text_md5 FROM u"
)
ORACLE["sanity_stats"] = f"""{_UNIQUE} SELECT count(*) AS total, count(*) FILTER (label = 0) AS zeros,
 count(*) FILTER (label = 1) AS ones,
 round(CASE WHEN count(*) FILTER (label = 0) > 0
  THEN count(*) FILTER (label = 1) / count(*) FILTER (label = 0) ELSE CAST('inf' AS DOUBLE) END, 6) AS ratio,
 (SELECT count(*) FROM documents) - count(*) AS removed FROM u"""
ORACLE["source_counts"] = over_emails(
    "SELECT source, label, count(*) AS emails FROM m GROUP BY source, label"
)
ORACLE["source_proportions"] = over_emails(
    """SELECT source, label, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS proportion
FROM m WHERE label IS NOT NULL GROUP BY source, label"""
)
ORACLE["class_weights"] = over_emails(
    """SELECT label, count(*) AS emails,
 round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM m WHERE label IS NOT NULL GROUP BY label"""
)


def _split_cte(source: str, key: str) -> str:
    return f""",
ranked AS (SELECT *, count(*) OVER (PARTITION BY label) AS n,
  row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', {key}))) AS k FROM {source}),
sized AS (SELECT *, CAST(floor(n * 0.2 + 0.5) AS BIGINT) AS held FROM ranked),
cut AS (SELECT *, CAST(floor(held * 0.1 / 0.2 + 0.5) AS BIGINT) AS test_n FROM sized),
sp AS (SELECT *, CASE WHEN k <= test_n THEN 'test' WHEN k <= held THEN 'val' ELSE 'train' END AS split FROM cut)"""


_SPLIT = BASE + ", lab AS (SELECT * FROM m WHERE label IS NOT NULL)" + _split_cte("lab", "email_id")
ORACLE["stratified_split"] = f"{_SPLIT} SELECT email_id, label, split FROM sp"
ORACLE["split_counts"] = f"{_SPLIT} SELECT split, label, count(*) AS emails FROM sp GROUP BY split, label"
ORACLE["benign_only"] = f"{_SPLIT} SELECT email_id, source FROM sp WHERE split = 'train' AND label = 0"
ORACLE["benign_only_all_rows"] = over_emails("SELECT email_id, source FROM m WHERE label = 0")
ORACLE["preprocess_pipeline"] = (
    BASE
    + f""", lab AS (SELECT email_id, label, {collapsed('tc')} AS t FROM m WHERE {_USABLE}),
uniq AS (SELECT * FROM lab WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY t ORDER BY email_id) = 1)"""
    + _split_cte("uniq", "t")
    + " SELECT email_id, label, split FROM sp"
)

ORACLE["split_sink"] = (
    ORACLE["preprocess_pipeline"].removesuffix(" SELECT email_id, label, split FROM sp")
    + " SELECT split, label, count(*) AS emails FROM sp GROUP BY split, label"
)

# --- CSV corpora ----------------------------------------------------------------------------

_NA = in_list(K.CSV_NA_VALUES)
_LAYOUT_ROWS = f""", rows AS (
 SELECT ['mail_seven', 'typed', 'mail_deep_plain', 'combined'][(email_id % 4) + 1] AS source,
  CASE WHEN email_id % 4 = 0 THEN from_address ELSE '' END AS from_address,
  CASE WHEN email_id % 2 = 0 AND subject NOT IN {_NA} THEN subject ELSE '' END AS subject,
  body, label, CASE WHEN email_id % 4 = 0 THEN {_HAS_URL} END AS has_url
 FROM m WHERE {_USABLE} AND body NOT IN {_NA}),
texts AS (SELECT *, concat('FROM: ', from_address, ' SUBJECT: ', subject, ' BODY: ', body) AS t FROM rows)"""
ORACLE["load_layouts"] = over_emails(
    f"""{_LAYOUT_ROWS} SELECT source, from_address, label, has_url,
 CAST(length(subject) AS INTEGER) AS subject_chars, md5(t) AS text_md5 FROM texts"""
)
ORACLE["load_all"] = over_emails(f"{_LAYOUT_ROWS} SELECT DISTINCT md5(t) AS text_md5 FROM texts")


# --- features -------------------------------------------------------------------------------


def entropy_log(expr: str) -> str:
    counts = f"map_values(list_histogram(string_split({expr}, '')))"
    n = f"length({expr})"
    return (
        f"round(CASE WHEN {expr} = '' THEN 0.0 ELSE "
        f"log2({n}) - list_sum(list_transform({counts}, lambda c: c * log2(c))) / {n} END, 4)"
    )


_BARE = (
    rf"CAST(len(regexp_extract_all(regexp_replace(regexp_replace(bm, '{URL}', ' ', 'g'), '@\w+', '@_', 'g'), "
    r"'(?i)\b(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+\b')) AS INTEGER)"
)
_FEATURE_SQL = {
    "text_len": "CAST(length(tc) AS INTEGER)",
    "body_len": "CAST(length(body) AS INTEGER)",
    "subject_len": "CAST(length(subject) AS INTEGER)",
    "subject_missing": flag(f"{strip('subject')} = ''"),
    "num_words_text": hits("tc", f"[^{WS}]+"),
    "num_digits_text": hits("tc", r"\p{Nd}"),
    "num_currency_symbols_text": hits("tc", f"[{K.CURRENCY_SYMBOLS}]"),
    "has_crypto_terms": flag(f"regexp_matches(tcm, '{words(K.CRYPTO_TERMS)}')"),
    "num_crypto_term_hits": hits("tcm", words(K.CRYPTO_TERMS)),
    "char_entropy_text": entropy_log("tc"),
    "num_exclamations_body": hits("body", "!"),
    "num_question_marks_body": hits("body", r"\?"),
    "num_uppercase_chars_body": hits("body", "[A-Z]"),
    "uppercase_ratio_body": (
        "round(len(regexp_extract_all(body, '[A-Z]')) / greatest(length(body), 1), 6)"
    ),
    "body_to_subject_len_ratio": "round(length(body) / greatest(length(subject), 1), 6)",
    "num_html_tags_body": hits("body", "<[^>]+>"),
    "has_html_tags_body": flag("regexp_matches(body, '<[^>]+>')"),
    "num_bare_domain_links_body": _BARE,
    "has_bare_domain_links_body": flag(f"{_BARE} > 0"),
    "has_urgent_terms": flag(f"regexp_matches(bm, '{words(K.URGENT_TERMS)}')"),
    "has_action_terms": flag(f"regexp_matches(bm, '{words(K.ACTION_TERMS)}')"),
    "has_credential_terms": flag(f"regexp_matches(tcm, '{words(K.CREDENTIAL_TERMS)}')"),
    "num_suspicious_keyword_hits": "("
    + " + ".join(
        [
            hits("bm", words(K.URGENT_TERMS)), hits("bm", words(K.ACTION_TERMS)),
            hits("tcm", words(K.CREDENTIAL_TERMS)), hits("tcm", words(K.CRYPTO_TERMS)),
        ]
    )
    + ")",
    "num_urls_in_text": "CAST(len(urls) AS INTEGER)",
    "num_short_urls": hits("tcm", _SHORTENER),
    "first_url_has_https": flag("starts_with(first_url, 'https://')"),
    "first_url_len": "CAST(length(first_url) AS INTEGER)",
    "first_url_domain_len": "CAST(length(url_domain) AS INTEGER)",
    "first_url_domain_num_dots": hits("url_domain", r"\."),
    "first_url_domain_num_hyphens": hits("url_domain", "-"),
    "first_url_domain_is_ip": flag(r"regexp_matches(url_domain, '^\d{1,3}(\.\d{1,3}){3}$')"),
    "has_url": f"coalesce({_HAS_URL}, {flag('len(urls) > 0')})",
    "has_url_was_missing": flag(f"{_HAS_URL} IS NULL"),
    "tld_risk_flag": flag(_CONDITIONS["risky_tld"]),
    "sender_missing": flag("faddr = ''"),
    "sender_domain_len": "CAST(length(sdomain) AS INTEGER)",
    "sender_local_len": rf"CAST(length(regexp_extract(faddr, '^([^@{WS}]+)@', 1)) AS INTEGER)",
    "sender_has_digits": flag(r"regexp_matches(faddr, '\p{Nd}')"),
    "sender_is_free_email": flag(f"sdomain IN {in_list(K.FREE_EMAIL_DOMAINS)}"),
    "sender_url_domain_mismatch": flag(
        f"coalesce({_HAS_URL}, {flag('len(urls) > 0')}) = 1 AND ({root('sdomain')}) <> '' "
        f"AND ({root('url_domain')}) <> '' AND ({root('sdomain')}) <> ({root('url_domain')})"
    ),
    "source_missing": flag("trim(source) = ''"),
    "from_subject_missing": flag(f"faddr = '' AND {strip('subject')} = ''"),
}
FEATURES = (
    BASE
    + f""",
a AS (SELECT *, {_LOCS} AS locs, coalesce(urls[1], '') AS first_url, lower({strip('from_address')}) AS faddr FROM m),
b AS (SELECT *, {netloc('first_url')} AS url_domain,
  regexp_extract(faddr, '@([^{WS}@]+)$', 1) AS sdomain FROM a)"""
)


def _features(columns: list[str]) -> str:
    listed = ",\n ".join(f"{_FEATURE_SQL[c]} AS {c}" for c in columns)
    return f"{FEATURES} SELECT email_id, {listed} FROM b"


ORACLE["text_features"] = _features(features.FEATURE_COLUMNS[:23])
ORACLE["url_features"] = _features(features.FEATURE_COLUMNS[23:34])
ORACLE["sender_features"] = _features(
    features.FEATURE_COLUMNS[34:40] + ["source_missing", "from_subject_missing"]
)
ORACLE["entropy"] = f"SELECT conv_id, turn, {entropy_log('text')} AS entropy FROM conversations"
ORACLE["bare_domains"] = over_emails(f"SELECT email_id, {_BARE} AS bare_domains FROM m")
ORACLE["page_locations"] = (
    f"SELECT page_id, netloc, {root('netloc')} AS root_domain "
    f"FROM (SELECT page_id, {netloc('url')} AS netloc FROM pages)"
)


# --- brands ---------------------------------------------------------------------------------

_DOMAINS = (
    BASE
    + f""",
d AS (SELECT {netloc('url')} AS domain FROM pages UNION ALL
  SELECT regexp_extract(lower({strip('from_address')}), '@([^{WS}@]+)$', 1) FROM m),
n AS (SELECT domain, count(*) AS emails,
  split_part(split_part(regexp_replace(lower(domain), '^(?:https?://)?(?:www\\.)?', ''), '/', 1), ':', 1) AS norm
  FROM d GROUP BY domain),
lab AS (SELECT *, CASE WHEN contains(norm, '.') THEN
   list_extract(list_filter(string_split(norm, '.'), lambda p: p <> ''), -2) ELSE norm END AS label FROM n)"""
)
_BRANDS = [b.split(".")[0] for b in K.KNOWN_BRAND_DOMAINS]
ORACLE["brand_edit_distance"] = (
    f"{_DOMAINS} SELECT domain, label, "
    + ", ".join(f"CAST(levenshtein(label, '{b}') AS INTEGER) AS to_{b}" for b in _BRANDS)
    + " FROM lab WHERE domain <> ''"
)

# Similarity ratio of two strings: the longest common block (earliest in the first string, then in
# the second), then the same left and right of it; twice the matched length over both lengths.
_BLOCK = """list_filter(flatten(list_transform(range(length(a), 0, -1), lambda k:
   list_transform(range(1, length(a) - k + 2), lambda i:
    {'k': k, 'i': i, 'j': instr(b, substring(a, i, k))}))), lambda x: x.j > 0)[1]"""


_LISTED_BRANDS = "VALUES " + ", ".join(
    f"('{b}', '{b.split('.')[0]}', {i})" for i, b in enumerate(K.KNOWN_BRAND_DOMAINS)
)


def brand_ctes(domains: str, brands: str = _LISTED_BRANDS) -> str:
    """From ``domains`` (one column, distinct) to ``best``: the brand metrics of each."""
    return f""",
bl(brand, blabel, ord) AS ({brands}),
dn AS (SELECT domain, split_part(split_part(regexp_replace(lower(domain),
  '^(?:https?://)?(?:www\\.)?', ''), '/', 1), ':', 1) AS norm FROM {domains}),
dl AS (SELECT *, CASE WHEN contains(norm, '.') THEN
  list_extract(list_filter(string_split(norm, '.'), lambda p: p <> ''), -2) ELSE norm END AS label FROM dn),
cand AS (SELECT dl.*, bl.*, levenshtein(label, blabel) AS dist FROM dl CROSS JOIN bl WHERE norm <> ''),
todo AS (SELECT norm AS a, brand AS b FROM cand UNION SELECT label, blabel FROM cand),
piece AS (SELECT a AS a0, b AS b0, a, b, CAST(0 AS BIGINT) AS k FROM todo
 UNION ALL
 SELECT a0, b0, CASE side WHEN 0 THEN substring(a, 1, blk.i - 1) ELSE substring(a, blk.i + blk.k) END,
  CASE side WHEN 0 THEN substring(b, 1, blk.j - 1) ELSE substring(b, blk.j + blk.k) END,
  CASE side WHEN 0 THEN blk.k ELSE 0 END
 FROM (SELECT a0, b0, a, b, {_BLOCK} AS blk, unnest([0, 1]) AS side FROM piece
   WHERE a <> '' AND b <> '') WHERE blk IS NOT NULL),
ratio AS (SELECT a0, b0, 2.0 * sum(k) / (length(a0) + length(b0)) AS r FROM piece GROUP BY a0, b0),
sims AS (SELECT c.*, CAST(greatest(f.r, g.r) AS DOUBLE) AS sim FROM cand c
  JOIN ratio f ON f.a0 = c.norm AND f.b0 = c.brand JOIN ratio g ON g.a0 = c.label AND g.b0 = c.blabel),
top AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY domain ORDER BY sim DESC, dist, ord) = 1),
best AS (SELECT dn.domain, coalesce(brand, '') AS best_brand, coalesce(sim, 0.0) AS similarity,
  CAST(coalesce(dist, 999) AS INTEGER) AS edit_distance,
  {flag('dn.norm IN (SELECT brand FROM bl)')} AS exact_match,
  {flag("contains(dn.norm, 'xn--')")} AS punycode,
  {flag("regexp_matches(dn.norm, '[^\\x00-\\x7f]')")} AS non_ascii
  FROM dn LEFT JOIN top ON top.domain = dn.domain),
bm2 AS (SELECT *, {flag('exact_match = 0 AND similarity >= 0.8 AND edit_distance <= 2')} AS typosquat FROM best)"""


ORACLE["brand_match_domains"] = (
    f"{_DOMAINS}{brand_ctes('n')} SELECT n.domain, emails, best_brand, round(similarity, 6) AS similarity, "
    "edit_distance, exact_match, punycode, non_ascii, typosquat FROM n JOIN bm2 ON n.domain = bm2.domain"
)
# Names below the threshold are not given.
_PAGE_WORD = f"regexp_extract({netloc('url')}, '([^.]+)[.][^.]+[.]([^.]+)$', 1)"
_PAGE_ENDING = f"regexp_extract({netloc('url')}, '([^.]+)[.][^.]+[.]([^.]+)$', 2)"
_PAGE_BRANDS = f"""SELECT brand, split_part(brand, '.', 1), row_number() OVER (ORDER BY brand) FROM
 (SELECT DISTINCT {_PAGE_WORD} || '.' || {_PAGE_ENDING} AS brand FROM pages WHERE {_PAGE_WORD} <> '')"""
ORACLE["brand_table_match"] = f"""WITH RECURSIVE w AS (SELECT page_id, {_PAGE_WORD} AS word, {_PAGE_ENDING} AS ending
  FROM pages WHERE {_PAGE_WORD} <> ''),
d AS (SELECT CASE page_id % 5 WHEN 0 THEN word WHEN 1 THEN replace(word, 'th', 't')
  WHEN 2 THEN substring(word, 1, 2) || '-' || substring(word, 3) WHEN 3 THEN replace(word, 'i', '1')
  ELSE 'my' || word || 'login' END || '.' || ending AS domain FROM w),
n AS (SELECT domain, count(*) AS emails FROM d GROUP BY domain){brand_ctes('n', _PAGE_BRANDS)},
named AS (SELECT *, similarity >= 0.8 AS near FROM bm2)
SELECT n.domain, emails, CASE WHEN near THEN best_brand ELSE '' END AS best_brand,
 CASE WHEN near THEN round(similarity, 6) ELSE 0.0::DOUBLE END AS similarity,
 CAST(CASE WHEN near THEN edit_distance ELSE 999 END AS INTEGER) AS edit_distance,
 exact_match, punycode, non_ascii, typosquat FROM n JOIN named ON n.domain = named.domain"""
_HAS_URL_VALUE = _FEATURE_SQL["has_url"]
_LOOKALIKE = {
    "sender_brand_similarity": "round(sm.similarity, 6)",
    "sender_brand_edit_distance": "sm.edit_distance",
    "sender_domain_punycode": "sm.punycode",
    "sender_domain_non_ascii": "sm.non_ascii",
    "sender_typosquat_flag": "sm.typosquat",
    "url_brand_similarity": "round(um.similarity, 6)",
    "url_brand_edit_distance": "um.edit_distance",
    "url_domain_punycode": "um.punycode",
    "url_domain_non_ascii": "um.non_ascii",
    "url_typosquat_flag": flag(f"{_HAS_URL_VALUE} = 1 AND um.typosquat = 1"),
}
_WITH_BRANDS = (
    f"{FEATURES}, dd AS (SELECT sdomain AS domain FROM b UNION SELECT url_domain FROM b){brand_ctes('dd')}"
)
_BRAND_JOIN = "FROM b JOIN bm2 sm ON sm.domain = b.sdomain JOIN bm2 um ON um.domain = b.url_domain"
ORACLE["lookalike_features"] = (
    f"{_WITH_BRANDS} SELECT email_id, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _LOOKALIKE.items())
    + f" {_BRAND_JOIN}"
)
ORACLE["features_full"] = (
    f"{_WITH_BRANDS} SELECT email_id, "
    + ",\n ".join(
        f"CAST({(_FEATURE_SQL | _LOOKALIKE)[name]} AS DOUBLE) AS {name}" for name in features.FEATURE_COLUMNS
    )
    + f" {_BRAND_JOIN}"
)

# --- messages and markup --------------------------------------------------------------------

_SKIPPED = "|".join(f"<{t}[^>]*>.*?</{t}>" for t in ("head", "style", "script"))
_PAGE_TEXT = rf"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|{_SKIPPED}', ' ', 'g'), '<[^>]*>', ' ', 'g')"
# References from the early days of HTML count without their semicolon as well.
for entity, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("amp", "&")):
    _PAGE_TEXT = f"regexp_replace({_PAGE_TEXT}, '&{entity};?', '{char}', 'g')"
ORACLE["html_text"] = f"SELECT page_id, {normalise_lines(_PAGE_TEXT)} AS text FROM pages"

_TRACKING = "(?i)/(?:" + "|".join(w.replace(".", r"\.") for w in K.TRACKING_PATH_WORDS) + ")"
_LINKS = rf"""WITH raw AS (
 SELECT page_id, url || '#top' AS url, false AS wrapped, 1 AS position FROM pages
 UNION ALL SELECT page_id, url, true, 2 FROM pages WHERE page_id % 3 = 0
 UNION ALL SELECT page_id, url || '/pixel.gif', false, 3 FROM pages WHERE page_id % 5 = 0
 UNION ALL SELECT page_id, url || '#top', false, 4 FROM pages WHERE page_id % 7 = 0),
kept AS (SELECT page_id, url, min(position) AS position, bool_or(wrapped) AS was_safelink
 FROM raw WHERE NOT regexp_matches(url, '{_TRACKING}') GROUP BY page_id, url)"""
ORACLE["href_links"] = (
    # The added anchors stand behind those that a page has itself.
    f"{_LINKS} SELECT page_id, CAST(len(regexp_extract_all(html, '<a [^>]*href=')) + position - 1 AS INTEGER) AS position, "
    f"k.url, {netloc('k.url')} AS netloc, {root(netloc('k.url'))} AS root_domain, "
    "was_safelink FROM kept k JOIN pages p USING (page_id)"
)
ORACLE["clean_links"] = (
    f"{_LINKS} SELECT p.page_id, coalesce(string_agg(k.url, ' ' ORDER BY k.position), '') AS links "
    "FROM pages p LEFT JOIN kept k ON p.page_id = k.page_id GROUP BY p.page_id"
)
ORACLE["safelinks"] = f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url
 ELSE url || '&url=' || url_encode(url) END AS target,
 regexp_matches(url, '{_TRACKING}') AS tracking FROM pages"""
_DKIM = """CASE WHEN dkim_pass AND dkim_domain IS NOT NULL THEN 'mail.' || dkim_domain END"""
ORACLE["auth_results"] = over_emails(f"SELECT email_id, dkim_pass AS passed, {_DKIM} AS domain FROM m")
ORACLE["attachments"] = over_emails(
    """SELECT email_id, CASE WHEN attachment_ext IS NULL THEN '.' || email_id ELSE attachment_ext END AS extensions,
 CAST(2 AS INTEGER) AS attachment_count FROM m"""
)
ORACLE["bare_addresses"] = over_emails(
    """SELECT email_id, from_address AS address FROM m"""
)
_PADDED = r"replace(text, chr(10), ' ' || chr(10) || ' ' || chr(9) || chr(10) || '  ')"
ORACLE["body_lines"] = f"SELECT conv_id, turn, {normalise_lines(_PADDED)} AS body FROM conversations"

_PLAIN_BODY = normalise_lines("body")
# The page holds two pieces of text, the paragraph and the link, one blank between them.
_HTML_BODY = (
    normalise_lines("concat(body, ' x')") + " || chr(10) || chr(10) || 'https://www.example.com/a'"
)
_PARSED = (
    BASE
    + f""",
p AS (SELECT email_id, email_id || '.eml' AS file, from_address, {strip('subject')} AS subject,
  CAST(CASE WHEN email_id % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS urls_found,
  CAST(CASE WHEN email_id % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) AS attachment_count,
  CASE WHEN email_id % 3 = 2 THEN attachment_ext END AS attachment_ext,
  CASE WHEN email_id % 3 = 2 THEN 'file' || coalesce(attachment_ext, '') ELSE '' END AS filenames,
  dkim_pass, {_DKIM} AS dkim_domain,
  CASE WHEN email_id % 3 = 1 THEN {_HTML_BODY} ELSE {_PLAIN_BODY} END AS body,
  CAST(0 AS DOUBLE) AS supervised_proba, CAST(0 AS DOUBLE) AS transformer_proba FROM m)"""
)
ORACLE["parse_messages"] = f"""{_PARSED} SELECT file, CASE WHEN from_address = '' THEN 'Sender <>' ELSE from_address END AS from_address, subject, urls_found, attachment_count,
 coalesce(attachment_ext, '') AS extensions, filenames, dkim_pass, dkim_domain, md5(body) AS body_md5,
 CAST(length(body) AS INTEGER) AS body_chars, '' AS error FROM p"""

ORACLE["eml_source"] = ORACLE["parse_messages"]
ORACLE["eml_source_limit"] = """SELECT file, true AS whole FROM (
  SELECT doc_id || '.eml' AS file, row_number() OVER (ORDER BY 'box' || doc_id % 7, doc_id || '.eml') AS place, count(*) OVER () AS n FROM documents
) WHERE place <= n // 2"""

# The bytes of a text, as two hexadecimal digits each.
_BYTES = "list_transform(range(1, CAST(strlen(body) AS BIGINT) + 1), lambda i: CAST('0x' || substr(hex(encode(body)), 2 * i - 1, 2) AS INTEGER))"
_AS_LATIN = f"array_to_string(list_transform({_BYTES}, lambda b: chr(b)), '')"
_AS_ASCII = f"array_to_string(list_transform({_BYTES}, lambda b: chr(CASE WHEN b > 127 THEN 65533 ELSE b END)), '')"
ORACLE["charset_bodies"] = over_emails(
    f""", k AS (SELECT email_id, body, CASE WHEN regexp_matches(body, '[^\\x00-\\x{{FF}}]') THEN 0 ELSE email_id % 5 END AS kind FROM m),
c AS (SELECT email_id, CASE kind WHEN 3 THEN {_AS_LATIN} WHEN 4 THEN {_AS_ASCII} ELSE body END AS body FROM k)
SELECT email_id, md5({normalise_lines('body')}) AS body_md5, CAST(length({normalise_lines('body')}) AS INTEGER) AS body_chars FROM c"""
)

_SENDER = "CASE WHEN from_address = '' THEN 'Sender <>' ELSE from_address END"
ORACLE["corpus_results"] = (
    f"""{_PARSED},
pa AS (SELECT * REPLACE ({_SENDER} AS from_address) FROM p),
pt AS (SELECT *, concat('FROM: ', from_address, ' SUBJECT: ', subject, ' BODY: ', body) AS tc FROM pa),
pm AS (SELECT *, regexp_replace(tc, '[{LETTERS}]', '_', 'g') AS tcm, NULL AS label,
  regexp_extract_all(tc, '{URL}') AS urls, {after_at('from_address')} AS sender FROM pt)"""
    + verdict_ctes("pm")
)

# --- models ---------------------------------------------------------------------------------

ORACLE["tfidf_terms"] = over_emails(
    r""", tok AS (SELECT email_id, regexp_extract_all(lower(tc), '[\p{L}\p{N}_]{2,}') AS w FROM m),
terms AS (SELECT email_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tok),
stats AS (SELECT term, count(*) AS tf, count(DISTINCT email_id) AS df FROM terms GROUP BY term)
SELECT term, tf, df, round(ln((1.0 + (SELECT count(*) FROM m)) / (1.0 + df)) + 1.0, 6) AS idf
FROM stats WHERE df >= 3 ORDER BY tf DESC, term LIMIT 20000"""
)
ORACLE["tfidf_terms_pruned"] = ORACLE["tfidf_terms"]
ORACLE["tfidf_vectors"] = (
    ORACLE["tfidf_terms"].replace("SELECT term, tf, df, round(ln(", ", top AS (SELECT term, ln(").replace("+ 1.0, 6) AS idf", "+ 1.0 AS idf")
    + """), weighted AS (SELECT email_id, term, count(*) * any_value(idf) AS w FROM terms JOIN top USING (term) GROUP BY email_id, term)
SELECT email_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY email_id)), 6) AS weight FROM weighted"""
)
ORACLE["bad_targets"] = over_emails(
    f"SELECT count(*) FILTER (try_cast({_spelled('email_id')} AS DOUBLE) IS NULL) AS bad FROM m"
)
ORACLE["margin_probability"] = over_emails(
    "SELECT email_id, round(1 / (1 + exp(-((email_id % 17 - 8) / 4.0))), 6) AS proba FROM m"
)
ORACLE["softmax_temperature"] = over_emails(
    """, lg AS (SELECT email_id, (email_id % 7 - 3) / 2.0 AS a, (email_id % 11 - 5) / 2.0 AS b FROM m)
SELECT email_id, round(exp(b / 2) / (exp(a / 2) + exp(b / 2)), 6) AS proba,
 CAST(CASE WHEN b > a THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM lg"""
)
ORACLE["sequence_scores"] = f"""{VERDICTS}, lg AS (SELECT email_id, hard_block,
 (length(tc) % 7 - 3) / 2.0 AS a, (length(tc) % 11 - 5) / 2.0 AS b FROM s)
SELECT email_id, CASE WHEN NOT hard_block
 THEN round(exp(b / 2) / (exp(a / 2) + exp(b / 2)), 6) END AS transformer_proba FROM lg"""
_CELLS = """count(*) AS rows, count(*) FILTER (label = 1 AND p = 1) AS tp, count(*) FILTER (label = 0 AND p = 1) AS fp,
 count(*) FILTER (label = 1 AND p = 0) AS fn, count(*) FILTER (label = p) AS hits"""
_METRICS = """rows, round(hits / rows, 6) AS accuracy,
 round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
 round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1"""
_PRED = """, pr AS (SELECT source, label, supervised_proba AS score,
 CASE WHEN supervised_proba >= 0.55 THEN 1 ELSE 0 END AS p FROM m WHERE label IS NOT NULL)"""
ORACLE["binary_metrics"] = over_emails(f"{_PRED}, c AS (SELECT {_CELLS} FROM pr) SELECT {_METRICS} FROM c")
ORACLE["binary_metrics_by_source"] = over_emails(
    f"{_PRED}, c AS (SELECT source, {_CELLS} FROM pr GROUP BY source) SELECT source, {_METRICS} FROM c"
)
ORACLE["roc_auc"] = over_emails(
    f"""{_PRED}, ranks AS (SELECT label,
 rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM pr),
t AS (SELECT sum(r) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM ranks)
SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM t"""
)
ORACLE["isolation_binary"] = over_emails(
    """, q AS (SELECT quantile_cont(transformer_proba, 0.9) AS t FROM m)
SELECT email_id, round(1 / (1 + exp(-transformer_proba)), 6) AS score,
 CAST(CASE WHEN transformer_proba > t THEN 1 ELSE 0 END AS INTEGER) AS outlier,
 CAST(CASE WHEN transformer_proba > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS outlier_auto FROM m, q"""
)

# --- reports --------------------------------------------------------------------------------

_ERROR = "CASE WHEN email_id % 50 = 7 THEN 'cannot read message ' || email_id END"


def _four(name: str) -> str:
    return f"printf('%.4f', coalesce({name}, 0.0))"


def _results(errors: bool, file: str, isolation: str = "0.0000") -> str:
    err = _ERROR if errors else "CAST(NULL AS VARCHAR)"
    ok = lambda expr: f"CASE WHEN {err} IS NOT NULL THEN '' ELSE {expr} END"
    verdict = "CASE WHEN is_phish = 1 THEN 'phish' ELSE 'benign' END"
    return f"""SELECT {file} AS file,
 CASE WHEN {err} IS NOT NULL THEN 'error' ELSE {verdict} END AS verdict,
 CASE WHEN {err} IS NOT NULL THEN substring({err}, 1, 120) ELSE coalesce(triggered_by, '') END AS triggered_by,
 {ok('CAST(rule_score AS VARCHAR)')} AS rule_score, {ok('matches')} AS rule_matches,
 {ok(_four(_S))} AS supervised_proba, {ok(_four(_T))} AS transformer_proba,
 {ok("'" + isolation + "'")} AS isolation_score FROM w"""


_FILE_RESULTS = f"{VERDICTS}, res AS ({_results(True, "email_id || '.eml'")})"
ORACLE["corpus_results"] += f" {_results(False, 'file')}"
ORACLE["stream_messages"] = ORACLE["corpus_results"]
ORACLE["results_report"] = f"{_FILE_RESULTS} SELECT * FROM res"
ORACLE["review_report"] = f"""{VERDICTS} SELECT email_id || '.eml' AS file, from_address, subject,
 CASE WHEN length({strip('body')}) > 500 THEN substring({strip('body')}, 1, 500) || '…' ELSE {strip('body')} END AS body_preview,
 CAST(email_id % 4 AS INTEGER) AS urls_found, CAST(rule_score AS VARCHAR) AS rule_score, matches AS rule_matches,
 {_four(_S)} AS supervised_proba, {_four(_T)} AS transformer_proba, '0.0000' AS isolation_score
 FROM w WHERE is_phish = 1 AND {_ERROR} IS NULL"""
ORACLE["errors_report"] = over_emails(
    f"SELECT email_id || '.eml' AS file, {_ERROR} AS error FROM m WHERE {_ERROR} IS NOT NULL"
)
ORACLE["eval_summary"] = f"""{_FILE_RESULTS}, c AS (SELECT count(*) AS total,
 count(*) FILTER (verdict <> 'error') AS processed, count(*) FILTER (verdict = 'phish') AS phish,
 count(*) FILTER (verdict = 'benign') AS benign, count(*) FILTER (verdict = 'error') AS errors FROM res)
SELECT *, round(phish * 100.0 / total, 1) AS phish_pct, round(benign * 100.0 / total, 1) AS benign_pct,
 round(errors * 100.0 / total, 1) AS errors_pct FROM c"""
ORACLE["label_metrics"] = f"""{_FILE_RESULTS}, c AS (SELECT count(*) FILTER (verdict <> 'error') AS processed,
 count(*) FILTER (verdict = 'phish') AS correct, count(*) FILTER (verdict = 'benign') AS missed FROM res)
SELECT 'phish' AS truth, processed, correct, missed, round(correct * 100.0 / processed, 1) AS correct_pct,
 round(missed * 100.0 / processed, 1) AS missed_pct, 'false_negative_rate' AS rate FROM c"""


def _band(name: str, threshold: float) -> str:
    return f"CASE WHEN {name} IS NULL THEN 'none' WHEN {name} >= {threshold} THEN 'high' ELSE 'low' END"


ORACLE["score_bands"] = f"""{VERDICTS} SELECT CASE WHEN is_phish = 1 THEN 'phish' ELSE 'benign' END AS verdict,
 coalesce(triggered_by, 'none (benign)') AS layer, {_band(_S, 0.55)} AS supervised_proba_band,
 {_band(_T, 0.75)} AS transformer_proba_band, 'none' AS isolation_score_band, count(*) AS emails
 FROM w GROUP BY ALL"""

# --- models and jobs, by what SQL can state of them ------------------------------------------

_HARD = f"""{VERDICTS} SELECT count(*) AS emails, count(*) FILTER (hard_block) AS blocked,
 CAST(0 AS BIGINT) AS mismatches, CAST(0 AS BIGINT) AS scored_blocks FROM s"""
ORACLE["scorer_text_column"] = _HARD
ORACLE["classifier_quality"] = over_emails(
    """SELECT model, count(*) AS emails, true AS from_0, true AS to_1, true AS fits
 FROM m, (SELECT unnest(['logreg', 'linear_svm']) AS model) WHERE label IS NOT NULL GROUP BY model"""
)
ORACLE["svm_optimality"] = over_emails("SELECT count(*) AS emails, true AS optimal FROM m WHERE label IS NOT NULL")
# Mean path of two trees over the expected path among 256 rows.
ORACLE["fixed_forest_scores"] = """WITH p AS (SELECT vec_id,
 (CASE WHEN embedding[1] <= 0 THEN 2.5 WHEN embedding[2] <= 0.05 THEN 3.0 ELSE 1.5 END
  + CASE WHEN embedding[2] <= 0 THEN 2.0 ELSE 4.0 END) / 2 AS path FROM embeddings),
r AS (SELECT vec_id, power(2, -path / (2 * (ln(255) + 0.5772156649015329) - 2 * 255 / 256.0)) AS raw FROM p)
SELECT vec_id, round(raw, 6) AS isolation_raw, round(1 / (1 + exp(-raw)), 6) AS isolation_score FROM r"""
ORACLE["outlier_share"] = """SELECT count(*) AS vectors,
 CAST(count(*) - 1 - floor(0.9 * (count(*) - 1)) AS BIGINT) AS outliers FROM embeddings"""
ORACLE["forest_roundtrip"] = "SELECT count(*) AS vectors, CAST(0 AS BIGINT) AS mismatches FROM embeddings"
ORACLE["benign_job"] = over_emails(f"{_LAYOUT_ROWS} SELECT label, md5(t) AS text_md5 FROM texts WHERE label = 0")
ORACLE["splits_job"] = over_emails(
    f"{_LAYOUT_ROWS} SELECT DISTINCT md5({collapsed('t')}) AS text_md5, true AS placed FROM texts"
)
_TRAINING_TERMS = ORACLE["tfidf_terms"].partition(", tok AS ")[2].partition("SELECT term, tf, df")[0]
ORACLE["training_files"] = f"""{_SPLIT}, tok AS {_TRAINING_TERMS.replace("FROM m)", "FROM sp WHERE split = 'train')")},
size AS (SELECT least(count(*), 20000) AS n FROM stats WHERE df >= 3)
SELECT split, count(*) AS rows, (SELECT n FROM size) AS num_features, (SELECT n FROM size) AS saved_features
FROM sp GROUP BY split"""
_RECORD_COLUMNS = """md5(body) AS body_md5, md5(CASE WHEN given <> '' THEN given
 ELSE concat('FROM: ', from_address, ' SUBJECT: ', subject, ' BODY: ', body) END) AS text_md5"""
ORACLE["record_defaults"] = f"""WITH sparse AS (SELECT doc_id,
 CASE WHEN doc_id % 3 <> 0 THEN coalesce(source || '@example.com', '') ELSE '' END AS from_address,
 CASE WHEN doc_id % 4 <> 0 THEN coalesce('About ' || lang, '') ELSE '' END AS subject,
 CASE WHEN doc_id % 5 <> 0 THEN coalesce(text, '') ELSE '' END AS body,
 CASE WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 THEN coalesce(lower(text), '') ELSE '' END AS given,
 CAST(CASE WHEN doc_id % 6 <> 0 THEN 2 ELSE 0 END AS INTEGER) AS extensions,
 doc_id % 8 <> 0 AND doc_id % 2 = 0 AS dkim_pass,
 CASE WHEN doc_id % 2 = 0 THEN source END AS dkim_domain FROM documents),
plain AS (SELECT doc_id, '' AS from_address, '' AS subject, coalesce(text, '') AS body, '' AS given FROM documents)
SELECT doc_id, 'sparse' AS record, from_address, subject, {_RECORD_COLUMNS}, extensions, dkim_pass, dkim_domain FROM sparse
UNION ALL SELECT doc_id, 'plain', from_address, subject, {_RECORD_COLUMNS}, CAST(0 AS INTEGER), false, CAST(NULL AS VARCHAR) FROM plain"""
ORACLE["report_files"] = f"""WITH res AS ({ORACLE["corpus_results"]})
SELECT 'results' AS report, count(*) AS written FROM res UNION ALL
SELECT 'review', count(*) FILTER (verdict = 'phish') FROM res UNION ALL
SELECT 'errors', count(*) FILTER (verdict = 'error') FROM res"""
