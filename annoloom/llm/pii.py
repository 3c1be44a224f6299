"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds are email, ip (parts up to 255), card (14 to 19 digits that pass Luhn) and phone (10 to 15
digits after a plus). The method adds ``iban`` (mod 97), ``id`` (nine digits in 3-2-4 groups; no group of
zeros, first group not 666 or from 900 on) and ``local_phone`` (national notation; ten or eleven digits, not all
alike, area and exchange as numbering plans have them). Every proposal has a prior score; a validator drops
those that fail; a context word of its kind within 40 characters before or after it raises the score. An added span is
kept at a score of 0.6 or more and if no other span touches it. Base spans stay whatever their score.

Defined cases: a null or empty text has no spans; texts are scanned whole; only ``doc_id`` and ``text``
are read; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoloom.llm import spans as S

KINDS = ("email", "ip", "card", "phone", "iban", "id", "local_phone")
#: An email is a local part, found by walking left from an @, and this domain. Tried from the left instead,
#: a long run without an @ would take quadratic time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?0?[0-9]{2,4}\)?[\x20-][0-9]{3}[\x20-][0-9]{4}(?![0-9])")
THRESHOLD, CONTEXT_CHARS = 0.6, 40
#: Context words a kind, in lower case.
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "id": ("ssn", "social", "security", "identity"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
}
#: Score of a proposal before its context is read.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "id": 0.4, "local_phone": 0.4}
BOOST = 0.25


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    iban = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def issued_id(number: str) -> bool:
    """Whether a number in 3-2-4 groups can have been issued."""
    area, group, serial = number.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def national_number(number: str) -> bool:
    """Whether a number can be one in national notation: with a trunk 0, ten or eleven digits, the second not
    0; without, ten digits whose area and exchange begin with 2 to 9."""
    digits = re.sub("[^0-9]", "", number)
    if len(set(digits)) == 1:
        return False
    if digits[0] == "0":
        return len(digits) in (10, 11) and digits[1] != "0"
    return len(digits) == 10 and digits[0] >= "2" and digits[3] >= "2"


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = re.findall(r"[a-z]+", f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_CHARS]}".lower())
    return min(1.0, PRIOR[kind] + BOOST * any(w in near for w in CONTEXT[kind]))


def _emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    found += [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text) if "." in text else ():
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def scan(text: str) -> list[tuple]:
    """All spans of one text, by start, then kind."""
    found = [(k, a, b, _score(text, k, a, b), True) for k, a, b in base_spans(text)]
    for kind, pattern, valid in (("iban", IBAN, mod97), ("id", ID, issued_id), ("local_phone", LOCAL_PHONE, national_number)):
        earlier = S.Cover(found)
        for m in pattern.finditer(text):
            if not valid(m[0]) or earlier.touches(m.start(), m.end()):
                continue
            score = _score(text, kind, m.start(), m.end())
            if score >= THRESHOLD:
                found.append((kind, m.start(), m.end(), score, False))
    return S.in_order(found, KINDS)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row."""
    return S.map_spans(docs, scan)


def redact_text(text: str) -> str:
    """The text with each maximal run of overlapping spans replaced by ``[KIND]`` of its first span."""
    out, at, spans = [], 0, scan(text)
    i = 0
    while i < len(spans):
        kind, start, end = spans[i][:3]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]]) if out else text


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans, one row a document."""
    return find_pii(docs).select(
        "doc_id",
        *[S.count_of("spans", k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(S.joined("spans", base_only=True), 256).alias("base_sha256"),
        S.joined("spans").alias("spans"),
    )
