"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds are email, ip, card and phone, found leftmost and without overlaps for each kind;
a proposal that fails its check is dropped and nothing inside it is tried again. The method
adds kind iban (mod 97, at the length that its country fixes, whatever follows it; a start that
fails hides none after it) and kind ssn (only with a context word near it). Offsets are code points, the end exclusive. A null or empty text has no spans; every pattern runs in time
linear in the text, so one very long word is no trouble.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm.common import id_and_text, slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}+")
IBAN_GOES_ON = re.compile(r"[A-Za-z0-9]")
#: Lengths in the registry of ISO 13616.
IBAN_LENGTHS = {
    code: length
    for length, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Words that speak for a kind when they stand near a span.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security"),
}
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT_SCORE, CONTEXT_CHARS, THRESHOLD = 0.3, 40, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over its local part: no start is tried twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, (done := (end := m.end()))
        else:
            done = at + 1
        at = text.find("@", end)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """At each start the length of its country; between these, for codes that aren't listed, the longest that mod 97 confirms."""
    listed: list[tuple[int, int]] = []
    others, done = [], 0
    for m in IBAN.finditer(text):
        if not (rest := IBAN_REST.match(text, m.end())):
            continue
        places = [i + 1 for i in range(*rest.span()) if text[i] != " "]  # at most 30 ends
        if not (length := IBAN_LENGTHS.get(m[0][:2])):
            others.append((m.start(), places[:9:-1]))
        elif m.start() >= done and len(places) > length - 5 and _is_iban(text, m.start(), places[length - 5]):
            listed.append((m.start(), done := places[length - 5]))
    yield from listed
    done = 0
    for start, ends in others:
        at = bisect.bisect(listed, (start,))
        if start >= max(done, listed[at - 1][1] if at else 0):
            limit = listed[at][0] if at < len(listed) else len(text)
            done = next((end for end in ends if end <= limit and _is_iban(text, start, end)), done)
            if done > start:
                yield start, done


def _is_iban(text: str, start: int, end: int) -> bool:
    return not IBAN_GOES_ON.match(text, end) and mod97(text[start:end].replace(" ", ""))


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that passed their checks."""
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield "phone", m.start(), m.end()
    for start, end in ibans(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def find_spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score), by start, then kind; what the method adds must reach THRESHOLD."""
    out = []
    for kind, start, end in proposals(text):
        near = f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_CHARS]}".lower()
        score = BASE_SCORE[kind] + CONTEXT_SCORE * any(re.search(rf"(?<!\w){re.escape(w)}(?!\w)", near) for w in CONTEXT[kind])
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append((start, end, kind, min(score, 1.0)))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in slices(batches):
        spans = [[{"kind": k, "start": a, "end": b, "score": s} for a, b, k, s in find_spans(t)] for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, SPANS)], ["doc_id", "spans"])


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (kind, start, end, score), in order; one row for each row of docs, no shuffle."""
    return id_and_text(docs).mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def base_sha256(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined([s for s in spans if s[0] in BASE_KINDS]).encode()).hexdigest()
