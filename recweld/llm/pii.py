"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Kinds: email, ip, card (Luhn), phone are the base kinds; iban (mod 97), ssn and secret (keys and tokens, some of which end in
a CRC) are added by the method. A span's score is the prior of its pattern, more if a checksum confirms it, more with a word
nearby that goes with its kind, less with one that speaks against it; words are whole words. Base spans are always kept,
whatever their score; added spans are kept from a score of 0.5: an IBAN needs its checksum, and no word against it unless
one for it is there; an ssn or a secret without a checksum needs a word for it. Spans are in code points, end exclusive, in
the order of start, then of KINDS. Spans of different kinds may overlap.

Each pattern is linear in the text: possessive repeats, and no start inside a run of digits or letters that was tried.
Null and empty texts have no spans. Repeated rows give repeated results; an empty table an empty result. Only the id and
text columns are read (redact() carries all along), whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
CONTEXT_CHARS = 40
KEEP_SCORE = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])(?:(?P<crc>gh[pousr]_[A-Za-z0-9]{36})|[A-Za-z0-9]{20,128}+)(?![A-Za-z0-9_])")
_DIGIT = re.compile("[0-9]")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Score of a proposed span; what a checksum, a word for its kind and a word against it change.
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.2, "ssn": 0.3, "secret": 0.3}
_CONFIRMED, _FOR, _AGAINST = 0.4, 0.25, -0.2
#: Words within CONTEXT_CHARS that speak for a kind.
_CONTEXT = {
    "email": frozenset("mail email mails contact write reply courriel correo".split()),
    "ip": frozenset("ip address addresses host server login adresse".split()),
    "card": frozenset("card cards visa mastercard credit debit payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon handy appel llama".split()),
    "iban": frozenset("iban bank account accounts konto compte cuenta".split()),
    "ssn": frozenset("ssn social security tax".split()),
    "secret": frozenset("secret secrets token tokens key keys apikey api password passwd pwd passwort auth bearer credential credentials".split()),
}
#: Words that speak against any kind.
_DOUBTS = frozenset("version isbn example test sample part".split())
_WORD = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping: the run of local characters before an @, no further back than the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = at
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(part := x.lstrip("0")) <= 3 and int(part or 0) <= 255 for x in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start the longest one that the checksum confirms and no letter or digit follows."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 4
        for end in range(m.end(), m.start() + 14, -1):
            if text[end - 1] != " " and not (text[end : end + 1].isascii() and text[end : end + 1].isalnum()) and mod97(text[m.start() : end]):
                yield m.start(), end
                at = end
                break


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _SSN.finditer(text))


def crc_confirmed(token: str) -> bool:
    """Whether the last six characters are the CRC-32 of those between prefix and them, in base 62."""
    body, end = token[4:-6], token[-6:]
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = _BASE62[d] + digits
    return digits.rjust(6, "0") == end


def _secrets(text: str) -> Iterator[tuple[int, int, bool]]:
    """Long runs of letters and digits that have several of both, and whether a checksum confirms them."""
    for m in _SECRET.finditer(text):
        digits = len(_DIGIT.findall(m[0]))
        if m["crc"] or 4 <= digits <= len(m[0]) - 4:
            yield *m.span(), bool(m["crc"]) and crc_confirmed(m[0])


#: Kinds whose spans have all passed a checksum.
_CHECKED = frozenset(("card", "iban"))


def _words_near(text: str, start: int, end: int) -> set[str]:
    """The whole words within CONTEXT_CHARS of a span, in lower case."""
    low, high = max(0, start - CONTEXT_CHARS), min(len(text), end + CONTEXT_CHARS)
    found = [m for m in _WORD.finditer(text, low, start) if m.start() > low or not low or not text[low - 1].isalpha()]
    found += [m for m in _WORD.finditer(text, end, high) if m.end() < high or high == len(text) or not text[high].isalpha()]
    return {m[0].lower() for m in found}


def _score(kind: str, confirmed: bool, text: str, start: int, end: int) -> float:
    near = _words_near(text, start, end)
    score = _PRIOR[kind] + _CONFIRMED * confirmed + _FOR * (not near.isdisjoint(_CONTEXT[kind])) + _AGAINST * (not near.isdisjoint(_DOUBTS))
    return round(min(1.0, max(0.0, score)), 3)


def find_spans(text: str | None, digits: bool = True) -> list[Span]:
    """All spans of a text. digits: false if the text is known to have none of 0-9."""
    if not text:
        return []
    found = [("email", *x, False) for x in _emails(text)] if "@" in text else []
    if digits:
        for kind, f in (("ip", _ips), ("card", _cards), ("phone", _phones), ("iban", _ibans), ("ssn", _ssns)):
            found += [(kind, *x, kind in _CHECKED) for x in f(text)]
        found += [("secret", *x) for x in _secrets(text)]
    spans = [Span(kind, a, b, _score(kind, confirmed, text, a, b)) for kind, a, b, confirmed in found]
    spans = [s for s in spans if s.kind in BASE_KINDS or s.score >= KEEP_SCORE]
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first in angle brackets."""
    out, last = [], 0
    for s in spans:
        if s.start >= last:
            out += [text[last : s.start], f"<{s.kind.upper()}>"]
        last = max(last, s.end)
    return "".join(out) + text[last:]


def _with_digits(array: pa.Array) -> np.ndarray:
    """Whether each text has a digit."""
    out = np.zeros(len(array), bool)
    for i, j, data, offs in K.slices(array):
        seen = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        out[i:j] = seen[offs[1:]] > seen[offs[:-1]]
    return out


def _spans_of(array: pa.Array) -> Iterator[tuple[str | None, list[Span]]]:
    for text, digits in zip(array, _with_digits(array), strict=True):
        value = text.as_py()
        yield value, find_spans(value, bool(digits))


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: its id and spans, an array of (kind, start, end, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            spans = [[s._asdict() for s in found] for _, found in _spans_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,score:double>>")


def redact(documents: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with their spans replaced by <KIND>, and length_col (if there) set to the new length.

    Rows without spans are unchanged; a null text stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [redact_text(t, s) if s else t for t, s in _spans_of(batch.column(at))]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if length_col in batch.schema.names:
                k = batch.schema.get_field_index(length_col)
                old = batch.column(k).to_pylist()
                new = [n if t is None else len(t) for n, t in zip(old, texts, strict=True)]
                batch = batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))
            yield batch

    return documents.mapInArrow(run, documents.schema)


def pii_digest(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_pii() as counts per base kind, the sha256 of the base spans, and all spans as text."""

    def joined(spans: list[Span]) -> str:
        return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)

    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, every = {k: [] for k in BASE_KINDS}, [], []
            for _, spans in _spans_of(batch.column("text")):
                base = [s for s in spans if s.kind in BASE_KINDS]
                for k in BASE_KINDS:
                    counts[k].append(sum(s.kind == k for s in base))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest() if base else empty)
                every.append(joined(spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(sha, pa.string()), pa.array(every, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {counts}, base_sha256 string, spans string")
