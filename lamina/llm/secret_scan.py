"""Secret scans: patterns, and a battery of randomness tests for tokens that no pattern knows.

Everything here is DataFrame functions; nothing runs in Python on the executors. Base kinds
are assign, access and hex, leftmost and without overlaps for each kind; a match that is too
short is dropped and nothing inside it is tried again. Offsets are code points: the lengths
of the pieces between the matches, and of the matches, added up.

The method adds kind random. Tokens of MIN_TOKEN characters or more with digits and letters
are given the smallest encoding that holds them (hex, base 36, 32, 62 or 64). Three tests ask
whether a token could be uniform noise in its encoding: chi-squared over the alphabet, runs
above and below its middle, and lag-one serial correlation. The least of the three p-values,
times three, is a token's p. Natural words and identifiers have small ones. False discoveries
are held at FDR (Benjamini-Hochberg) apart in each length class, from counts of all the
corpus's tokens in bins of p: a token whose p lies over its class's cut stands as noise, that
is as a secret, if it doesn't overlap a base span and has at least MIN_BITS bits.

Null and empty texts have no spans; each row of documents gives one row. Work and memory are
linear in a text's length and in a token's; running sums over m matches are made in chunks of
CHUNK and take CHUNK m / 2 + (m / CHUNK)^2 / 2 additions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import id_and_text

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 18 (16) characters or more is found if and only if the run as a whole is that long.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
MIN_ASSIGN, MIN_TOKEN, MIN_BITS = 12, 20, 90
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

#: Encodings from the smallest alphabet up, as (pattern, alphabet).
ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Za-z+/]+=*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"),
    ("^[0-9A-Za-z_-]+=*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"),
)
FDR = 0.1
#: Least lengths of the length classes.
CLASSES = (20, 32, 64)
#: Bins of -log10 p: BIN wide, up to LAST.
BIN, LAST = 0.05, 400

CHUNK = 64
SPAN = "struct<start:long,kind_no:int,end:long,kind:string,token:string>"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once even where lambdas refer to it again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def before(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array, those before it combined."""

    def scan(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, combine))
        starts = bind(totals, lambda t: F.transform(t, lambda _, i: F.aggregate(F.slice(t, F.lit(1), i), zero, combine)))
        return F.flatten(F.zip_with(chunks, starts, lambda c, start: F.transform(c, lambda _, i: F.aggregate(F.slice(c, F.lit(1), i), start, combine))))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda i: F.slice(v, i * CHUNK + 1, F.lit(CHUNK)))
    return bind(values, lambda v: F.when(F.size(v) > 0, bind(cut(v), scan)).otherwise(F.slice(v, 1, 0)))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches of a pattern."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))  # one more than there are matches

    def placed(m: Column) -> Column:
        moved = before(F.zip_with(m["gaps"], m["found"], lambda gap, token: gap + F.coalesce(F.length(token), F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)
        starts = F.zip_with(moved, m["gaps"], lambda a, gap: a + gap)
        span = lambda start, token: F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), (start + F.length(token)).alias("end"), F.lit(kind).alias("kind"), token.alias("token"))
        return F.filter(F.zip_with(starts, m["found"], span), lambda x: x["token"].isNotNull())

    return F.when(F.regexp_like(text, F.lit(pattern)), bind(F.struct(gaps.alias("gaps"), found.alias("found")), placed)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def two_sided(z: Column) -> Column:
    """Of a standard normal, by the rational approximation of erfc of Abramowitz and Stegun, 7.1.26."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    return F.greatest(F.lit(1e-300), t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x))


def battery(token: Column) -> Column:
    """struct(p, bits) of a token; null if no encoding holds it."""
    body = F.rtrim(token, F.lit("="))
    alphabet = F.coalesce(*(F.when(F.regexp_like(token, F.lit(pattern)), F.lit(letters)) for pattern, letters in ENCODINGS))

    def tests(state: Column) -> Column:
        x, k, n = state["x"], state["k"], state["n"]
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda acc, s: acc + F.pow(F.size(F.filter(x, lambda v: v == s)), F.lit(2.0)))
        chi = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        chi_p = F.when(chi > 0, two_sided(chi) / 2).otherwise(F.lit(0.5))
        middle, spread = (k - 1) / 2, (k * k - 1) / 12
        above = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.when(v * 2 >= k, 1.0).otherwise(0.0))
        below = n - above
        last = F.size(x) - 1
        beside = lambda of: F.aggregate(F.zip_with(F.slice(x, F.lit(2), last), F.slice(x, F.lit(1), last), of), F.lit(0.0), lambda acc, v: acc + v)
        runs = 1 + beside(lambda a, b: F.when((a * 2 >= k) != (b * 2 >= k), 1.0).otherwise(0.0))
        mean = 2 * above * below / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        runs_p = F.when(variance > 0, two_sided((runs - mean) / F.sqrt(variance))).otherwise(F.pow(F.lit(2.0), 1 - n))
        products = beside(lambda a, b: (a - middle) * (b - middle))
        serial_p = two_sided(products / (spread * F.sqrt(n - 1)))
        return F.struct(F.least(F.lit(1.0), 3 * F.least(chi_p, runs_p, serial_p)).alias("p"), (n * F.log2(k)).alias("bits"))

    letters = bind(alphabet, lambda a: F.transform(F.slice(F.split(body, ""), F.lit(1), F.length(body)), lambda c: (F.instr(a, c) - 1).cast("double")))
    state = F.struct(letters.alias("x"), F.length(alphabet).cast("double").alias("k"), F.length(body).cast("double").alias("n"))
    usable = alphabet.isNotNull() & (F.length(body) >= MIN_TOKEN) & F.regexp_like(token, F.lit("[0-9]")) & F.regexp_like(token, F.lit("[A-Za-z]"))
    return F.when(usable, bind(state, tests))


def length_class(size: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(CLASSES):
        out = F.when(size >= least, F.lit(i)).otherwise(out)
    return out


def p_bin(p: Column) -> Column:
    return F.least(F.lit(LAST), F.floor(-F.log10(p) / BIN)).cast("int")


def cuts(tokens: DataFrame) -> list[int]:
    """For each length class, the least bin of -log10 p that is rejected as noise."""
    counts = tokens.groupBy(length_class(F.col("end") - F.col("start")).alias("class"), p_bin(F.col("p")).alias("bin")).count().collect()  # at most classes x bins rows
    out = []
    for c in range(len(CLASSES)):
        own = {r["bin"]: r["count"] for r in counts if r["class"] == c}
        total, seen, cut = sum(own.values()), 0, LAST + 1
        for b in sorted(own, reverse=True):
            seen += own[b]
            if 10 ** (-b * BIN) <= FDR * seen / total:  # the bin's largest p
                cut = b
        out.append(cut)
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, kind_no, end, kind, token) by start, then kind; a row for each row of docs."""
    text = F.col("text")
    tested = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"), battery(s["token"]).alias("test"))
    scanned = id_and_text(docs).select(
        "doc_id",
        F.filter(matches(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 2)) >= MIN_ASSIGN).alias("assign"),
        matches(text, ACCESS, "access").alias("access"),
        matches(text, HEX, "hex").alias("hex"),
        matches(text, TOKEN, "random").alias("tokens"),
    )
    # read twice, once for the cuts and once for the spans, rather than written: what it holds is secrets
    scanned = scanned.withColumn("tokens", F.filter(F.transform("tokens", tested), lambda t: t["test"].isNotNull())).withColumn("base", F.concat("assign", "access", "hex"))
    limits = F.array(*(F.lit(c) for c in cuts(scanned.select(F.explode("tokens").alias("t")).select("t.start", "t.end", "t.test.p"))))
    noise = lambda t: (p_bin(t["test"]["p"]) < F.element_at(limits, length_class(t["end"] - t["start"]) + 1)) & (t["test"]["bits"] >= MIN_BITS)
    as_span = lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind_no"), t["end"].alias("end"), F.lit("random").alias("kind"), t["token"].alias("token"))
    found = F.when(F.size("tokens") > 0, F.transform(F.filter("tokens", noise), as_span)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))
    spans = F.array_sort(F.concat("base", found))
    return scanned.select("doc_id", F.when(F.size(found) > 0, bind(spans, apart)).otherwise(spans).alias("spans"))


def apart(spans: Column) -> Column:
    """Sorted spans without the random ones that overlap a base span: one that ends after their start and starts no later, or starts before their end."""
    is_base = lambda s: s["kind_no"] != KINDS.index("random")
    low, high = F.lit(-1).cast("long"), F.lit(1 << 60).cast("long")
    covered = before(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(low)), low, lambda a, b: F.greatest(a, b))
    following = F.reverse(before(F.reverse(F.transform(spans, lambda s: F.when(is_base(s), s["start"]).otherwise(high))), high, lambda a, b: F.least(a, b)))
    told = F.arrays_zip(spans.alias("span"), covered.alias("covered"), following.alias("following"))
    free = lambda t: is_base(t["span"]) | ((t["covered"] <= t["span"]["start"]) & (t["following"] >= t["span"]["end"]))
    return F.transform(F.filter(told, free), lambda t: t["span"])
