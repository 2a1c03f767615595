"""Secrets in texts: three fixed patterns, and a battery of randomness tests for the rest.

Built from DataFrame functions only.  ``scan`` finds the base spans (kinds ``assign``, ``access``
and ``hex``) and candidate tokens: runs of at least ``MIN_TOKEN`` characters of the usual
encodings that no base span covers, '=' only as padding at their end.  The encoding of a token
(hex, base32, alphanumeric, base64, or the kinds of characters it has) gives its alphabet; every
token has one, so the tests decide on each.  Three tests ask whether its symbols look drawn at random: chi-squared
uniformity over the alphabet, the number of runs above and below the middle, and the correlation
of neighbours.  The last two measure related things, so their normal scores are joined by the
covariance that uniform symbols give them; Fisher's rule joins the result with the first test,
which is independent of any order.

Ordinary tokens fail the tests.  A token is cleared if the step-up rule of Benjamini and Hochberg
rejects randomness at ``RATE``: of the cleared tokens at most that share is expected to be random
after all.  The rule runs by encoding and class of length, since short tokens have little power
and would otherwise live on the ranks of long ones.  Tokens that are not cleared become spans of
kind ``random``.  The p-values go into fixed bins (rounded up, so the control stays), which makes
the corpus-wide part a count of at most a few thousand (class, bin) cells.

Null and empty texts have no spans.  Repeated rows are scanned each.  All columns of the input
are kept by ``scan`` and ``redact``; the columns they add take free names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.session import stage

# --- fixed values ---------------------------------------------------------------------------
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]
MIN_ASSIGNED = 12
# --------------------------------------------------------------------------------------------
MIN_TOKEN = 20
RATE = 0.05
BINS_PER_E = 8
MAX_BIN = 400
# '=' before a token is the end of a name; after it, padding unless more of the same follows.
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}(?:={{1,6}}(?![A-Za-z0-9+/_=-]))?"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# name, pattern, alphabet; the first that fits is taken.
ENCODINGS = [
    ("hex", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", UPPER + "234567"),
    ("alnum", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+=*$", UPPER + LOWER + DIGITS),
    ("base64", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
    ("digits", "^[0-9]+=*$", DIGITS),
    ("lower", "^[a-z]+=*$", LOWER),
    ("UPPER", "^[A-Z]+=*$", UPPER),
    ("letters", "^[A-Za-z]+=*$", UPPER + LOWER),
    ("lower36", "^[0-9a-z]+=*$", DIGITS + LOWER),
    ("UPPER36", "^[0-9A-Z]+=*$", DIGITS + UPPER),
    ("lower-url", "^[0-9a-z_-]+=*$", DIGITS + LOWER + "-_"),
    ("UPPER-url", "^[0-9A-Z_-]+=*$", DIGITS + UPPER + "-_"),
    ("lower/", "^[0-9a-z+/]+=*$", DIGITS + LOWER + "+/"),
    ("UPPER/", "^[0-9A-Z+/]+=*$", DIGITS + UPPER + "+/"),
    ("letters-url", "^[A-Za-z_-]+=*$", UPPER + LOWER + "-_"),
    ("letters/", "^[A-Za-z+/]+=*$", UPPER + LOWER + "+/"),
    ("mixed", "^[0-9A-Za-z+/_-]+=*$", UPPER + LOWER + DIGITS + "+/-_"),
]
# Upper ends of the classes of length.
LENGTHS = [24, 32, 48, 64, 128, 1024]

SPAN = "struct<start:bigint,kind:int,end:bigint>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of all matches whose ``group`` has ``least`` characters, in code points.

    What stands between the matches and the matches themselves alternate, so their lengths add
    up to the places.  Texts without a match are told apart first; most are.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.zip_with(
        F.zip_with(between, whole, lambda b, w: F.struct(F.length(b).alias("b"), F.length(w).alias("w"))),
        checked, lambda x, c: F.struct(x["b"].alias("b"), x["w"].alias("w"), F.length(c).alias("c")),
    )
    empty = F.array().cast(f"array<{SPAN}>")

    def step(state, row):
        start = state["at"] + row["b"]
        end = start + F.coalesce(row["w"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        taken = F.coalesce(row["c"] >= least, F.lit(False)) & row["w"].isNotNull()
        more = F.when(taken, F.array_append(state["found"], span)).otherwise(state["found"])
        return F.struct(end.alias("at"), more.alias("found"))

    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found"))
    found = F.aggregate(rows, start, step, lambda state: state["found"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def base_spans(text: Column) -> Column:
    spans = F.concat(
        _spans(text, ASSIGN, 0, group=2, least=MIN_ASSIGNED), _spans(text, ACCESS, 1), _spans(text, HEX, 2)
    )
    return F.array_sort(spans)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal: a rational approximation, far out the leading terms."""
    size = F.abs(z)
    density = F.exp(-size * size / 2) / math.sqrt(2 * math.pi)
    t = 1 / (1 + 0.2316419 * size)
    near = density * t * (
        0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    far = density / F.greatest(size, F.lit(1.0)) * (1 - 1 / F.greatest(size * size, F.lit(2.0)))
    tail = F.when(size > 6, far).otherwise(near)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def randomness(symbols: Column, alphabet_size: Column) -> Column:
    """The combined p-value of the battery for an array of symbol numbers from 0."""
    n = F.size(symbols).cast("double")
    k = alphabet_size.cast("double")

    # Chi-squared: squares of the symbol counts, from runs of equal symbols in sorted order.
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares"))

    def count(state, symbol):
        same = symbol == state["last"]
        run = F.when(same, state["run"] + 1).otherwise(F.lit(1.0))
        # (r + 1)^2 - r^2 = 2 r + 1
        return F.struct(symbol.alias("last"), run.alias("run"), (state["squares"] + 2 * run - 1).alias("squares"))

    squares = F.aggregate(F.array_sort(symbols), start, count, lambda s: s["squares"])

    # Runs and neighbours in one pass over the symbols.
    middle = (k - 1) / 2
    walk = F.struct(
        *[F.lit(None).cast("double").alias(c) for c in ("first", "last")],
        *[F.lit(0.0).alias(c) for c in ("high", "runs", "s", "ss", "sp")],
    )

    def step(state, symbol):
        x = symbol.cast("double") - middle
        turn = state["last"].isNull() | ((x > 0) != (state["last"] > 0))
        return F.struct(
            F.coalesce(state["first"], x).alias("first"),
            x.alias("last"), (state["high"] + (x > 0).cast("double")).alias("high"),
            (state["runs"] + turn.cast("double")).alias("runs"), (state["s"] + x).alias("s"),
            (state["ss"] + x * x).alias("ss"), (state["sp"] + x * F.coalesce(state["last"], F.lit(0.0))).alias("sp"),
        )

    def combine(w):
        high, low = w["high"], n - w["high"]
        expected = 2 * high * low / n + 1
        variance = (expected - 1) * (expected - 2) / (n - 1)
        # All on one side of the middle is as far from random as can be.
        z_runs = F.when(variance > 0, (w["runs"] - expected) / F.sqrt(F.abs(variance))).otherwise(F.sqrt(n))
        mean = w["s"] / n
        power = w["ss"] - n * mean * mean
        neighbours = w["sp"] - mean * (2 * w["s"] - w["first"] - w["last"]) + (n - 1) * mean * mean
        spread = F.greatest(n - 2, F.lit(1.0)) / (n * F.sqrt(n - 1))
        z_serial = F.when(power > 0, (neighbours / F.abs(power) + 1 / n) / spread).otherwise(F.sqrt(n))
        # Fewer runs go with a higher correlation: for uniform symbols by (mean |x|)^2 / mean x^2.
        shared = F.least(0.75 * k * k / (k * k - 1), F.lit(0.99))
        order = (z_runs * z_runs + 2 * shared * z_runs * z_serial + z_serial * z_serial) / (1 - shared * shared) / 2
        uniform = -F.log(F.least(F.lit(1.0), F.greatest(_uniformity(squares, n, k), F.lit(1e-30))))
        return _let(uniform + F.least(order, F.lit(70.0)), lambda h: F.exp(-h) * (1 + h))

    return _let(F.aggregate(symbols, walk, step), combine)


def _uniformity(squares: Column, n: Column, k: Column) -> Column:
    """Upper tail of the chi-squared statistic, given the sum of the squared symbol counts.

    The statistic is linear in the number of pairs of equal symbols.  Mean, variance and third
    moment of that number are known exactly for uniform symbols, so a shifted gamma distribution
    with these moments (the chi-squared one, for long tokens) holds for tokens shorter than
    their alphabet as well; the number is whole, hence the half.
    """
    p = 1 / k
    pairs = n * (n - 1) / 2
    variance = pairs * p * (1 - p)
    third = variance * (1 - 2 * p) + n * (n - 1) * (n - 2) * p * p * (1 - p)
    root = 2 * variance * F.sqrt(variance) / F.greatest(third, F.lit(1e-9))
    z = ((squares - n) / 2 - 0.5 - pairs * p) / F.sqrt(variance)
    return _upper_tail(3 * root * (F.cbrt(F.greatest(1 + z / root, F.lit(0.0))) - 1 + 1 / (9 * root * root)))


def _tokens(text: Column, base: Column) -> Column:
    """Candidate tokens outside the base spans: start, end, class and bin of the p-value."""
    spans = F.filter(
        _spans(text, TOKEN, 3),
        lambda t: ~F.exists(base, lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])),
    )
    named = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("token"))
    )

    def encoding(token: Column) -> Column:
        chosen = F.lit(None).cast("int")
        for number, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
            chosen = F.when(token.rlike(pattern), F.lit(number)).otherwise(chosen)
        return chosen

    coded = F.filter(
        F.transform(named, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.rtrim(s["token"], F.lit("=")).alias("token"), encoding(s["token"]).alias("code"))),
        lambda s: s["code"].isNotNull() & (F.length(s["token"]) >= 2),
    )
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])

    def judged(s: Column) -> Column:
        def with_alphabet(alphabet: Column) -> Column:
            chars = F.filter(F.split(s["token"], ""), lambda c: c != "")
            symbols = F.transform(chars, lambda c: F.instr(alphabet, c) - 1)
            return randomness(symbols, F.length(alphabet))

        p = _let(F.get(alphabets, s["code"]), with_alphabet)
        size = s["end"] - s["start"]
        length_class = sum(((size > limit).cast("int") for limit in LENGTHS), F.lit(0))
        cell = F.floor(-F.log(F.greatest(p, F.lit(1e-30))) * BINS_PER_E)
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            (s["code"] * 16 + length_class).cast("int").alias("class"),
            F.least(F.greatest(cell, F.lit(0)), F.lit(MAX_BIN)).cast("int").alias("bin"),
        )

    return F.transform(coded, judged)


def cleared_from(cells: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per class the smallest bin whose tokens are cleared, from ``class, bin, n`` rows."""
    by_class: dict[int, dict[int, int]] = {}
    # At most (encodings x lengths x bins) rows.
    for row in cells.collect():
        by_class.setdefault(row["class"], {})[row["bin"]] = row["n"]
    out = {}
    for name, bins in by_class.items():
        total, seen = sum(bins.values()), 0
        for cell in sorted(bins, reverse=True):
            seen += bins[cell]
            if math.exp(-cell / BINS_PER_E) * total <= rate * seen:
                out[name] = cell
    return out


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with ``base_spans`` and ``spans``, arrays in order.

    The table is staged once, with its kept columns, between the tests and the control.
    """
    keep = docs.columns if keep is None else keep
    text = F.coalesce(F.col("t"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("t"))
    found = rows.withColumn("base_spans", base_spans(text)).withColumn("tokens", _tokens(text, F.col("base_spans")))
    held = stage(found.select("row", "base_spans", "tokens"), "secrets")
    cells = held.select(F.explode("tokens").alias("t")).groupBy("t.class", "t.bin").agg(F.count("*").alias("n"))
    cleared = cleared_from(cells)
    limits = F.create_map(*[F.lit(x) for pair in cleared.items() for x in pair]) if cleared else None

    def kept(t: Column) -> Column:
        if limits is None:
            return F.lit(True)
        return t["bin"] < F.coalesce(F.element_at(limits, t["class"]), F.lit(MAX_BIN + 1))

    random = F.transform(
        F.filter("tokens", kept), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"))
    )
    return held.select("row", "base_spans", F.array_sort(F.concat("base_spans", random)).alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base spans, all spans as text."""
    found = scan(docs, keep=["doc_id"])

    def counted(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select(
        F.col("row.doc_id").alias("doc_id"), *[counted(i) for i in range(3)],
        F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """All rows and columns, with each stretch that spans cover replaced by ``mask``."""
    found = scan(docs, text_col)
    text = F.col("row").getField(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state, s):
        gap = F.substr(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        return (
            F.when(s["end"] <= state["at"], state)
            .when((s["start"] < state["at"]) | ((s["start"] == state["at"]) & (state["at"] > 0)), F.struct(state["out"].alias("out"), s["end"].alias("at")))
            .otherwise(F.struct(F.concat(state["out"], gap, F.lit(mask)).alias("out"), s["end"].alias("at")))
        )

    def finish(state):
        return F.concat(state["out"], F.substr(text, (state["at"] + 1).cast("int"), F.length(text)))

    masked = F.when(F.size("spans") == 0, text).otherwise(F.aggregate("spans", start, step, finish))
    # The names of the input come last, so that none of them is taken for a helper's.
    done = found.select(F.col("row").alias("_row"), masked.alias("_masked"))
    columns = [F.col("_masked") if c == text_col else F.col("_row").getField(c) for c in docs.columns]
    return done.select(F.struct(*[c.alias(n) for c, n in zip(columns, docs.columns, strict=True)]).alias("_done")).select("_done.*")
