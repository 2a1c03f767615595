import math
import random
import re
from collections import Counter
from urllib.parse import urlparse

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions import mail, text, urls

RANDOM = random.Random(5)
PIECES = [
    "verify", "Urgent", "clicK", "action required", "ethereum", "eth", "é", "ß", " ", "  ", "\n", "\t",
    " ", "\x1c", "\x85", ".", "-", "@", "_", "foo", "www.a-b.com", "x.co", "http://evil.zip/a?b=c", "HTTPS://A.b/c",
    "<b>", "<", ">", "bit.ly/q", "t.co", "'", '"', "$", "€", "9", "٣", "A", "z", "😀", "中文", "account", "Wallet", "!", "?",
]
SAMPLES = ["", " ", "a", " "] + [
    "".join(RANDOM.choice(PIECES) for _ in range(RANDOM.randint(1, 25))) for _ in range(600)
]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "n int, t string").cache()


def check(samples, function, expected):
    column = function(F.col("t"))
    got = {r.n: r[1] for r in samples.select("n", column.alias("v")).collect()}
    wrong = [(SAMPLES[n], v, expected(SAMPLES[n])) for n, v in got.items() if v != expected(SAMPLES[n])]
    assert not wrong, wrong[:5]


def words(terms):
    alternatives = "|".join(t.replace(".", r"\.") for t in terms)
    return re.compile(rf"\b(?:{alternatives})\b", re.IGNORECASE)


URL = re.compile(r"https?://[^\s<>'\"]+", re.IGNORECASE)
BARE = re.compile(r"(?<!@)\b(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+\b", re.IGNORECASE)
SHORT = re.compile(
    r"\b(?:https?://)?(?:www\.)?(?:" + "|".join(h.replace(".", r"\.") for h in K.SHORTENER_HOSTS)
    + r")(?:/[^\s<>'\"]*)?", re.IGNORECASE,
)

def test_counts(samples):
    check(samples, text.count_words, lambda s: len(re.findall(r"\S+", s)))
    check(samples, lambda t: text.count_matches(t, r"\p{Nd}"), lambda s: len(re.findall(r"\d", s)))
    check(samples, text.count_tags, lambda s: len(re.findall(r"<[^>]+>", s)))
    check(samples, lambda t: text.count_char(t, "€"), lambda s: s.count("€"))


def test_strip_and_collapse(samples):
    check(samples, text.strip, str.strip)
    check(samples, text.is_blank, lambda s: s.strip() == "")
    check(samples, text.collapse_spaces, lambda s: re.sub(r"\s+", " ", s).strip())


def test_normalise_lines(samples):
    def expected(s):
        s = re.sub(r"\n\s*\n+", "\n\n", re.sub(r"[ \t]+", " ", s))
        return "\n".join(line for line in s.splitlines() if line.strip()).strip()

    check(samples, text.normalise_lines, expected)


@pytest.mark.parametrize("name", list(K.LEXICONS))
def test_lexicons(samples, name):
    pattern = words(K.LEXICONS[name])

    def together(t):
        return text.lexicon_hits(t, list(K.LEXICONS))

    check(samples, lambda t: text.count_lexicon(together(t), name), lambda s: len(pattern.findall(s)))
    check(samples, lambda t: text.has_lexicon(together(t), name), lambda s: bool(pattern.search(s)))


def test_lexicons_do_not_overlap():
    everything = [t for terms in K.LEXICONS.values() for t in terms]
    assert len(everything) == len(set(everything))
    parts = [w for t in everything if " " in t for w in t.split()]
    assert not set(parts) & set(everything)


def test_entropy(spark, samples):
    def expected(s):
        counts, n = Counter(s), len(s)
        return round(-sum(c / n * math.log2(c / n) for c in counts.values()), 6) + 0.0 if s else 0.0

    check(samples, lambda t: F.round(text.char_entropy(t), 6), expected)


def test_char_profile(spark, samples):
    profile = samples.select("n", text.char_profile(F.col("t")).alias("p")).select("n", "p.*")
    for r in profile.collect():
        s = SAMPLES[r.n]
        assert (r.words, r.currency) == (len(s.split()), sum(s.count(c) for c in K.CURRENCY_SYMBOLS)), s
    spaces = spark.createDataFrame([(f"a{c}b",) for c in K.SPACE_CHARS] + [("a\u200bb",), (None,)], "t string")
    counted = spaces.select("t", text.count_words(F.col("t")).alias("built_in"), text.char_profile(F.col("t")).alias("p"))
    for r in counted.collect():
        assert (r.p.words == r.built_in) if r.t is not None else (r.p is None), r


def test_char_profile_of_slices():
    whole = pa.array(["päß", None, "a b", "", "€ $5"])
    for kind in (pa.string(), pa.large_string()):
        for start in range(len(whole) + 1):
            for length in range(len(whole) + 1 - start):
                got = text.char_profile.func(whole.cast(kind).slice(start, length)).to_pylist()
                words = [r and (r["words"], r["currency"]) for r in got]
                assert words == [(1, 0), None, (2, 0), (0, 0), (2, 2)][start : start + length]


def test_shortener_hint_is_exact(samples):
    dotted = samples.withColumn("t", F.concat("t", F.lit(" FROM: a@mail.paypal.com xt.co/a")))
    hinted = dotted.select("t", F.col("t").rlike(K.SHORTENER_HINT).alias("h")).collect()
    assert all(r.h == bool(SHORT.search(r.t)) for r in hinted)
    assert {r.h for r in hinted} == {True, False}


def test_label_starts(spark):
    pieces = ["a.b", "-", "@", "é", "_", " ", ".", "x-y.z", "İ", "9"]
    texts = ["".join(RANDOM.choice(pieces) for _ in range(RANDOM.randint(1, 9))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", urls.count_bare_domains(F.col("t")))
    assert all(n == len(BARE.findall(t)) for t, n in got.collect())


def test_links_in_text(samples):
    check(samples, urls.extract_urls, URL.findall)
    check(samples, urls.count_bare_domains, lambda s: len(BARE.findall(URL.sub(" ", s))))
    check(samples, urls.count_shorteners, lambda s: len(SHORT.findall(s)))
    check(samples, urls.has_shortener, lambda s: bool(SHORT.search(s)))


def python_netloc(url):
    try:
        return urlparse(url).netloc.lower().split(":")[0]
    except ValueError:
        return ""


def python_root(domain):
    d = domain.strip().lower()
    parts = [p for p in d.split(".") if p]
    if len(parts) < 2:
        return d
    last = ".".join(parts[-2:])
    return ".".join(parts[-3:]) if len(parts) > 2 and last in K.TWO_LEVEL_SUFFIXES else last


LINKS = [
    "http://192.168.1.1/login", "HTTPS://User:pw@Example.COM:8080/x?y#z", "http://a.b.co.uk/", "http://co.uk",
    "http://evil.zip.", "http://x.tk?u=http://1.2.3.4/", "http://[::1]:80/a", "http://[abc.zip/", "http://a]b.zip/",
    "http://a.zip:[80/", "http://1.2.3.4@evil.com/", "http://1.2.3.4.", "http://xn--a.com#f", "http://é.com", "http:///x",
    "http://a..b..com/", "http://ſ.tK/", "http://a.zip:80/", "http://.zip", "http://zip", "http://999.1.1.1:1", "http://x\\y.ml/a",
]


def test_netloc_and_root(spark):
    df = spark.createDataFrame([(u,) for u in LINKS], "u string").withColumn("d", urls.netloc(F.col("u")))
    for row in df.select("u", "d", urls.root_domain(F.col("d")).alias("r")).collect():
        assert row.d == python_netloc(row.u), row
        assert row.r == python_root(row.d), row


@pytest.mark.parametrize("test,expected", [
    (urls.any_ip, lambda ds: any(re.match(r"^\d{1,3}(?:\.\d{1,3}){3}$", d) for d in ds)),
    (urls.any_risky_tld, lambda ds: any([p for p in d.split(".") if p][-1:] and
                                        [p for p in d.split(".") if p][-1] in K.RISKY_TLDS for d in ds)),
    (urls.any_punycode, lambda ds: any("xn--" in d or any(ord(c) > 127 for c in d) for d in ds)),
])
def test_any_url_rules(spark, test, expected):
    messages = LINKS + [" ".join(RANDOM.sample(LINKS, 3)) for _ in range(150)]
    df = spark.createDataFrame([(m,) for m in messages], "t string")
    joined = urls.joined_urls(urls.extract_urls(F.col("t")))
    for row in df.select("t", test(joined).alias("v")).collect():
        domains = [python_netloc(u) for u in URL.findall(row.t)]
        assert row.v == expected(domains), row.t


def test_safelinks_and_tracking(spark):
    host = "https://eur01.safelinks.protection.outlook.com/"
    rows = [
        (host + "?url=https%3A%2F%2Fa.com%2Fx%3Fq%3D1%2B1&data=1", "https://a.com/x?q=1+1"),
        (host + "?url=https%253A%252F%252Fa.com%252Fp%2520q", "https://a.com/p q"),
        (host + "?data=1&url=a+b%252Bc", "a b+c"),
        (host + "?url=&url=x", "x"),
        (host + "?data=1", host + "?data=1"),
        ("https://b.com/?url=https%3A%2F%2Fa.com", "https://b.com/?url=https%3A%2F%2Fa.com"),
    ]
    df = spark.createDataFrame(rows, "u string, want string")
    for row in df.select("*", urls.unwrap_safelink(F.col("u")).alias("got")).collect():
        assert row.got == row.want
    tracked = {
        "https://a.com/Open/1": True, "https://openai.com": True, "https://a.com/e/1": True,
        "https://a.com/click.php": True, "https://a.com/clickXphp": False, "https://a.com/x": False,
    }
    df = spark.createDataFrame([(u,) for u in tracked], "u string")
    assert {r.u: r.v for r in df.select("u", urls.is_tracking(F.col("u")).alias("v")).collect()} == tracked


def test_clean_hrefs(spark):
    links = ["/rel", "mailto:x@y", "HTTP://up.com", "https://a.com", "https://a.com/pixel", "https://a.com", "httpfoo"]
    df = spark.createDataFrame([(links,)], "l array<string>")
    assert df.select(urls.clean_hrefs(F.col("l"))).first()[0] == ["https://a.com", "httpfoo"]


def test_mail_fields(spark):
    df = spark.createDataFrame([
        ("Name <a@b.com>", ["x.PDF.HTML", "README", ".bashrc", "end."], ["dkim=fail header.i=@no.com",
         "spf=pass header.d=spf.example; DKIM = Pass header.i=@Mail.PayPal.com"]),
        ("plain@b.com ", [], ["xdkim=pass"]),
        ("<>", [], ["dkim=pass"]),
    ], "f string, names array<string>, auth array<string>")
    header = mail.dkim_header(F.col("auth"))
    rows = df.select(
        mail.bare_address(F.col("f")).alias("a"), mail.attachment_extensions(F.col("names")).alias("e"),
        header.isNotNull().alias("p"), mail.dkim_domain(header).alias("d"),
    ).collect()
    assert tuple(rows[0]) == ("a@b.com", [".html", ".bashrc", "."], True, "spf.example")
    assert tuple(rows[1]) == ("plain@b.com", [], False, None)
    assert tuple(rows[2]) == ("<>", [], True, None)
