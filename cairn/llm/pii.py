"""Personal data in texts: patterns propose, checksums confirm, context adjusts.

Method. Regular expressions propose spans; validators confirm or reject them (Luhn for cards,
mod-97 for bank account numbers, digit counts and part ranges elsewhere); words near a span raise
or lower its score. The four base kinds (email, ip, card, phone) stay whatever their score. Two
more kinds are added: ``iban`` when mod-97 holds, and ``national_id`` (three groups of 3, 2 and 4
digits) only where context lifts its score to ``THRESHOLD``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small_batches
from cairn.llm.spans import SPAN, bare_string, ordered

KINDS = ["email", "ip", "card", "phone", "iban", "national_id"]
#: Score from which an added kind is reported.
THRESHOLD = 0.5
#: Characters on either side in which context words count.
CONTEXT_CHARS = 60

# What each pattern is worth before and after its validator, and what speaks for or against it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.3}
FOR = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "mobile", "call", "fax", "telephone"),
    "iban": ("iban", "account", "bank", "konto", "transfer"),
    "national_id": ("ssn", "social", "security", "insurance", "identity"),
}
AGAINST = ("example", "version", "release", "isbn", "order", "invoice", "test", "sample")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A longer start in the same run of digits fails or succeeds with the first, so only run starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORDS = re.compile(r"[a-z-]+")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number's letters and digits, country and check digits last, are 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards in time linear in the text."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-6:]) <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest validated reading at each place: a pattern may run on into the next word."""
    for m in _IBAN.finditer(text):
        for end in range(m.end(), m.start() + 14, -1):
            if text[end - 1] != " " and not text[end : end + 1].isalnum() and mod97(text[m.start() : end].replace(" ", "")):
                yield m.start(), end
                break


def national_ids(text: str) -> Iterator[tuple[int, int]]:
    for m in _NATIONAL.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "national_id": national_ids}
BASE = frozenset(KINDS[:4])


def context_score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, moved by the words around the span."""
    near = set(_WORDS.findall((text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()))
    return min(1.0, max(0.0, PRIOR[kind] + 0.3 * any(w in near for w in FOR[kind]) - 0.2 * any(w in near for w in AGAINST)))


def find(text: str) -> list[tuple]:
    """(kind, start, end, score, base) of a text's findings, by start and then kind."""
    found = []
    for kind in KINDS:
        for start, end in FINDERS[kind](text):
            score = context_score(text, kind, start, end)
            if kind in BASE or score >= THRESHOLD:
                found.append((kind, start, end, score, kind in BASE))
    return ordered(found, KINDS)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
_NAMES = ("kind", "start", "end", "score", "base")


def scan(finder):
    """A batch function that returns ``finder``'s findings of each text beside its doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(_NAMES, s, strict=True)) for s in finder(t)] for t in bare_string(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], ["doc_id", "spans"])

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end, score, base) of every row's whole text.

    Null and empty texts have no spans; repeated rows give repeated rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan(find), f"doc_id long, spans array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>")
