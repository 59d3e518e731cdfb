"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "routing")
BASE = KINDS[:4]

# The patterns of the base kinds and of the added ones.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match of the plain form starts and ends with whole numbers
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
ROUTING = re.compile(r"(?<![0-9.+-])[0-9]{9}(?![0-9.-])")

DIGIT = re.compile(r"[0-9]")

# Words that make a kind likelier, the score a confirmed span starts from, and what a word adds.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse", "dirección"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "téléphone", "telefon", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "tax"),
    "routing": ("routing", "aba", "bank", "transit"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "routing": 0.2}
BONUS, NEAR, LEAST = 0.3, 40, 0.5
WORDS = {kind: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)", re.I)
         for kind, words in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Whether an account number, its first four characters moved to the end and letters as 10 to 35, leaves 1 over 97."""
    turned = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def aba(digits: str) -> bool:
    return sum(int(c) * (3, 7, 1)[i % 3] for i, c in enumerate(digits)) % 10 == 0 and digits != "0" * 9


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, an at sign and a dotted domain, found from the at signs outward."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def proposed(text: str) -> list[tuple[int, int, int]]:
    """Confirmed spans (start, kind's place, end), without the score of the added kinds."""
    spans = [(s, 0, e) for s, e in emails(text)]
    if not DIGIT.search(text):  # every other kind has one
        return spans
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    for m in IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            spans.append((m.start(), 4, m.end()))
    spans += [(m.start(), 5, m.end()) for m in SSN.finditer(text)]
    spans += [(m.start(), 6, m.end()) for m in ROUTING.finditer(text) if aba(m[0])]
    return sorted(spans)


def scored(text: str) -> list[tuple[str, int, int, float]]:
    """All spans with scores: base kinds whatever their score, added kinds from ``LEAST`` up."""
    found = []
    for start, place, end in proposed(text):
        kind = KINDS[place]
        near = text[max(0, start - NEAR):start] + "\n" + text[end:end + NEAR]
        score = min(1.0, PRIOR[kind] + BONUS * bool(WORDS[kind].search(near)))
        if kind in BASE or score >= LEAST:
            found.append((kind, start, end, score))
    return found


FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for value in batch.column(1):
            text = value.as_py() or ""
            spans.append([dict(zip(("kind", "start", "end", "score"), s)) for s in scored(text)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, FOUND)], ["_key", "spans"])


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data per row: ``key`` and an array of kind, start, end, score.

    Offsets count code points, ends are exclusive, spans are ordered by start and kind. A row
    depends on its own text alone, so nothing is shuffled. Null and empty texts have no
    spans; repeated rows and null keys are kept as they come; an empty table gives
    no rows; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).mapInArrow(
        _batches, f"_key {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    ).withColumnRenamed("_key", key)


def listed(spans, kinds: tuple[str, ...] | None = None):
    """Spans as kind:start:end, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per base kind, a checksum of the base spans, and all spans with their scores as text."""
    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select(
        key, *counts, F.sha2(listed(F.col("spans"), BASE), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))
