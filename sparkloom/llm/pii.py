"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds: ``email``, ``ip``, ``card`` (Luhn), ``phone`` and ``iban`` (mod 97), plus ``ssn`` and ``secret``, whose shape
alone says little. Each span has a score: its kind's prior, raised where a word nearby, before or after it, speaks for
the kind, and lowered where one speaks for something else (an order number, a version, a checksum). Spans of the last
three kinds count from a least score on; those of the first four that pass their checks always stay, whatever theirs.

Every search is linear in the text, whose whole length is read. Offsets are code points, ends exclusive.

Defined results: a null or empty text has no spans; repeated rows each give a row; a null id is kept; extra columns
are ignored by ``find`` and kept untouched by ``stage``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
#: Score from which a span of the added kinds counts.
LEAST_SCORE = 0.6
#: How many characters before and after a span are searched for context words.
NEAR = 48
BEHIND = 24

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}(?![A-Za-z0-9_/+-])")

#: Words that speak for a kind, with the score that each adds; fixed values.
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("key", "token", "secret", "password", "passwd", "apikey", "bearer"),
}
#: Words that speak for something else; fixed values.
AGAINST = {
    "email": (),
    "ip": ("version", "release", "build", "section", "chapter"),
    "card": ("order", "isbn", "tracking", "serial", "invoice"),
    "phone": ("isbn", "order", "serial", "version"),
    "iban": ("serial", "part", "model"),
    "ssn": ("order", "part", "serial", "invoice", "case"),
    "secret": ("hash", "commit", "checksum", "digest", "uuid", "path"),
}
#: What such words add and take away; fixed values.
FOR_SCORE, AGAINST_SCORE = 0.4, 0.35
#: Score of a span without context words, by kind, after its checks; fixed values.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.2}
NEARBY = re.compile(r"[a-z]+")


class Span(NamedTuple):
    start: int
    kind: str
    end: int
    score: float


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the local part before it as far as it goes, the domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Every four parts of a chain of dotted numbers, from its left."""
    if "." not in text:
        return
    for chain in DOTTED.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" not in text:
        return
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest beginning of each proposal that passes mod 97."""
    for m in IBAN.finditer(text):
        found = m.group()
        ends = (e for e in range(len(found), 14, -1) if e == len(found) or found[e] == " ")
        for end in ends:
            if 15 <= len(found[:end].replace(" ", "")) <= 34 and mod97(found[:end]):
                yield m.start(), m.start() + end
                break


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Long runs of letters of both cases and digits."""
    for m in SECRET.finditer(text):
        run = m.group()
        if not run.islower() and not run.isupper() and any(map(str.isdigit, run)) and any(map(str.isalpha, run)):
            yield m.span()


SEARCH = {
    "email": emails,
    "ip": addresses,
    "card": cards,
    "phone": phones,
    "iban": ibans,
    "ssn": lambda text: (m.span() for m in SSN.finditer(text)),
    "secret": secrets,
}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = {*NEARBY.findall(text[max(0, start - NEAR) : start].lower()), *NEARBY.findall(text[end : end + BEHIND].lower())}
    points = PRIOR[kind] + FOR_SCORE * (not near.isdisjoint(CONTEXT[kind])) - AGAINST_SCORE * (not near.isdisjoint(AGAINST[kind]))
    return round(min(1.0, max(0.0, points)), 2)


def spans(text: str | None, least: float = LEAST_SCORE) -> list[Span]:
    """All spans by start, then by kind as listed; added kinds give way to base spans they overlap."""
    if not text:
        return []
    found, taken = [], []
    for kind, search in SEARCH.items():
        for start, end in search(text):
            points = score(text, kind, start, end)
            if kind in BASE_KINDS:
                taken.append((start, end))
            elif points < least or any(a < end and start < b for a, b in taken):
                continue
            found.append(Span(start, kind, end, points))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def joined(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


SCHEMA = (
    "spans array<struct<kind: string, start: int, end: int, score: double>>, n_email long, n_ip long, n_card long, "
    "n_phone long, base_sha256 string, joined string, scores string"
)
COLUMNS = ("spans", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "joined", "scores")


def find(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Per row: ``doc_id``, its spans with scores, counts of the base kinds, and digests of the spans."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in slices(batch, 1)):
            rows = [spans(x.as_py(), least) for x in part.column(1)]
            base = [[s for s in row if s.kind in BASE_KINDS] for row in rows]
            columns = [
                pa.array([[s._asdict() for s in row] for row in rows], pa.list_(span)),
                *(pa.array([sum(s.kind == k for s in row) for row in base], pa.int64()) for k in BASE_KINDS),
                pa.array([hashlib.sha256(joined(row).encode()).hexdigest() for row in base], pa.string()),
                pa.array([joined(row) for row in rows], pa.string()),
                pa.array([",".join(f"{s.score:.2f}" for s in row) for row in rows], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *COLUMNS])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, {SCHEMA}")


def masked(text: str | None, least: float = LEAST_SCORE) -> str | None:
    """The text with each span replaced by its kind; of overlapping spans the first gives the name."""
    found = spans(text, least)
    if not found:
        return text
    out, at = [], 0
    for s in found:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def op6_pii(spark, sf_dir):
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.col("joined").alias("spans"), "scores"
    )


def stage(spark, docs, sf_dir):
    """Mask the spans in every text; ``n_chars`` follows the new text, all else stays, rows without an id or text too."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, at):
                texts = pa.array([masked(x.as_py()) for x in part.column(at)], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), texts)

    out = docs.mapInArrow(batches, docs.schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)
