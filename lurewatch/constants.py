r"""Detection patterns and domain lists.

Everything in this module is a value the results depend on, kept as plain text.
Patterns are Java regular expressions.  Word boundaries are spelled out as look-arounds, because
``\b`` changed its meaning between JDK versions.
"""

from __future__ import annotations

# White space as Python's str.isspace() sees it, as a character class body; patterns that use it
# carry the (?U) flag.  (A list of ranges would say the same but runs several times slower.)
SPACE_CLASS = r"\s\x1c-\x1f"
# The same characters as a plain string, for btrim().
SPACE_CHARS = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)
# A word character as Python's \w sees it.
WORD_CLASS = r"\p{L}_\p{N}"

# ---------------------------------------------------------------------------
# Term lists (whole words, case-insensitive)
# ---------------------------------------------------------------------------
URGENT_TERMS = ["urgent", "immediate", "action required", "verify", "suspend", "locked", "alert"]
ACTION_TERMS = ["click", "login", "confirm", "update", "reset", "submit", "open"]
CREDENTIAL_TERMS = [
    "password", "credential", "ssn", "account", "bank", "billing", "payment", "wallet",
]
CRYPTO_TERMS = ["seed phrase", "btc", "bitcoin", "eth", "ethereum", "usdt", "crypto"]
# A "~" stands for one or more white-space characters.
ATTACHMENT_LURE_TERMS = [
    "see~attached", "find~attached", "invoice", "receipt",
    "payment~confirmation", "payment~receipt", "payment~details",
    "statement", "open~the~attached", "review~the~attached",
    "attached~file", "attached~document",
]
CURRENCY_SYMBOLS = "$€£¥₹₩₽"

# ---------------------------------------------------------------------------
# Domain and extension lists
# ---------------------------------------------------------------------------
SHORTENER_HOSTS = [
    "bit.ly", "tinyurl.com", "t.co", "t.ly", "goo.gl", "is.gd", "ow.ly", "buff.ly",
    "rebrand.ly", "cutt.ly", "tiny.cc", "rb.gy", "clck.ru", "u.to",
]
FREE_EMAIL_DOMAINS = [
    "gmail.com", "yahoo.com", "outlook.com", "hotmail.com",
    "aol.com", "icloud.com", "proton.me", "protonmail.com",
]
# The order matters: it breaks ties in the best-brand search.
KNOWN_BRAND_DOMAINS = [
    "paypal.com", "microsoft.com", "apple.com", "amazon.com", "google.com",
    "bankofamerica.com", "chase.com", "wellsfargo.com", "citibank.com", "coinbase.com",
]
RISKY_TLDS = ["zip", "review", "work", "click", "gq", "tk", "ml", "cf", "ga"]
TWO_LEVEL_SUFFIXES = [
    "co.uk", "org.uk", "gov.uk", "ac.uk", "com.au", "net.au", "org.au", "co.nz",
]
TRUSTED_SENDING_DOMAINS = [
    "amazon.com", "amazon.co.uk", "amazon.ca", "amazon.de", "amazon.fr", "amazon.co.jp",
    "paypal.com", "paypal-communication.com",
    "googlemail.com",
    "apple.com",
    "microsoft.com", "microsoftemail.com",
    "stripe.com",
    "shopify.com", "shopifyemail.com",
    "linkedin.com",
    "facebook.com", "facebookmail.com", "meta.com",
    "netflix.com",
    "spotify.com",
    "dropbox.com",
    "slack.com",
    "zoom.us",
    "intuit.com", "turbotax.com", "quickbooks.com",
    "chase.com", "bankofamerica.com", "wellsfargo.com", "citibank.com",
    "americanexpress.com", "capitalone.com", "discover.com", "usbank.com", "ally.com",
    "coinbase.com", "kraken.com",
    "adobe.com",
    "notion.so",
    "ebay.com", "etsy.com", "walmart.com", "target.com",
    "ups.com", "fedex.com", "usps.com", "dhl.com",
    "airbnb.com", "booking.com", "expedia.com", "united.com", "delta.com", "southwest.com",
    "trello.com", "atlassian.com", "salesforce.com",
    "huggingface.co",
]
# DKIM signing root -> From domains trusted under it.
TRUSTED_FROM_SUBDOMAINS = {"google.com": ["accounts.google.com", "payments.google.com"]}
HARD_BLOCK_EXTENSIONS = [
    ".html", ".htm", ".js", ".vbs", ".lnk", ".iso", ".img", ".exe", ".bat", ".ps1", ".scr", ".hta",
]
SUSPICIOUS_EXTENSIONS = [".zip", ".rar", ".7z", ".xlsm", ".docm", ".pdf", ".jar"]
SAFELINKS_HOST = "safelinks.protection.outlook.com"
TRACKING_PATH_WORDS = [
    "open", "track", "pixel", "beacon", "click.php", "wf/open", "trk", "e/", "o.aspx",
]

# ---------------------------------------------------------------------------
# Label vocabularies and missing-value spellings in CSV files
# ---------------------------------------------------------------------------
LABEL_POSITIVE = [
    "phishing email", "phishing", "phish", "spam", "malicious", "1", "1.0", "yes", "true", "t", "y",
]
LABEL_NEGATIVE = [
    "safe email", "safe", "ham", "legit", "benign", "0", "0.0", "no", "false", "f", "n",
]
FLAG_POSITIVE = ["1", "1.0", "yes", "true", "t", "y"]
FLAG_NEGATIVE = ["0", "0.0", "no", "false", "f", "n"]
CSV_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---------------------------------------------------------------------------
# Patterns assembled from the lists above
# ---------------------------------------------------------------------------


def _literal(term: str) -> str:
    return term.replace(".", r"\.").replace("~", f"[{SPACE_CLASS}]+")


def _grouped(terms: list[str]) -> str:
    """Alternation grouped by first letter: a word starting with none of them fails at once."""
    groups: dict[str, list[str]] = {}
    for term in terms:
        groups.setdefault(term[0], []).append(_literal(term[1:]))
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())


def _beginning(terms: list[str]) -> str:
    """The first characters of the terms, up to three, as classes: few places of a text go on."""
    length = min(3, *(len(term.split("~")[0]) for term in terms))
    return "".join(f"[{''.join(sorted({_literal(t[i]) for t in terms}))}]" for i in range(length))


def whole_words(terms: list[str]) -> str:
    """Case-insensitive whole-word alternation."""
    return f"(?iU)(?={_beginning(terms)})(?<![{WORD_CLASS}])(?:{_grouped(terms)})(?![{WORD_CLASS}])"


def _host_behind(host: str) -> str:
    """The last label of the host, which what stands before it completes at the start of a word."""
    return f"{host.rsplit('.', 1)[1]}(?<=(?<![{WORD_CLASS}]){_literal(host)})"


URL_PATTERN = f"(?iU)https?://[^{SPACE_CLASS}<>'\"]+"
_BOUNDARY = f"(?:(?<![{WORD_CLASS}])(?=[{WORD_CLASS}])|(?<=[{WORD_CLASS}])(?![{WORD_CLASS}]))"
# A word boundary, and no "@" in front, before a letter or digit, or before a hyphen.
_LABEL_START = f"(?:(?<![{WORD_CLASS}@])(?=[a-z0-9])|(?=-)(?<=[{WORD_CLASS}]))"
# Two or more dot-joined labels; a leading "www." is just one more label.
BARE_DOMAIN_PATTERN = (
    f"(?iU){_LABEL_START}[a-z0-9-]++(?:\\.[a-z0-9-]+)+{_BOUNDARY}"
)
HTML_TAG_PATTERN = "<[^>]+>"
LEXICONS = {
    "urgent": URGENT_TERMS,
    "action": ACTION_TERMS,
    "credential": CREDENTIAL_TERMS,
    "crypto": CRYPTO_TERMS,
}
ATTACHMENT_LURE_PATTERN = whole_words(ATTACHMENT_LURE_TERMS)
IP_PATTERN = r"^\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}$"
# A scheme or "www." in front of the host ends in a non-word character, so looking for the host
# at a word start finds the same links.  There is no right boundary.
SHORTENER_PATTERN = (
    f"(?iU)(?<![{WORD_CLASS}])(?:{_grouped(SHORTENER_HOSTS)})(?:/[^{SPACE_CLASS}<>'\"]*)?"
)
# Looks for the last dot of a host first, which few places of a text hold, and behind it for the
# host: true for the texts that the pattern above finds something in.
SHORTENER_HINT = f"(?iU)\\.(?:{'|'.join(_host_behind(h) for h in SHORTENER_HOSTS)})"
BARE_DOMAIN_HINT = r"(?iU)\.[a-z0-9-]"
TRACKING_PATTERN = f"(?iU)/(?:{'|'.join(_literal(w) for w in TRACKING_PATH_WORDS)})"
