"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates are found by pattern and validated (check sums, ranges, calendar). A keyed Feistel network permutes
each value within its own format: separators, length, letter case and check digits stay valid, and equal values get
equal pseudonyms in every document, so links survive. E-mail addresses and access keys are permuted by character class.

Kinds: email, card (Luhn), iban (mod 97), ipv4, ssn, phone, date, key (access keys, and what is assigned to password,
secret, token or api key). Digits that fail validation stay as they are.

Null texts stay null with no findings; empty texts likewise have none. Repeated rows keep a row each. Columns other than
``doc_id`` and ``text`` are left aside. An empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days

PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})
  | (?P<key>\bAKIA[0-9A-Z]{16}\b
      | (?i:\b(?:password|passwd|secret|token|api_?key)["']?[ ]{0,2}[=:][ ]{0,2}["']?)[A-Za-z0-9+/_-]{8,128})
  | (?P<iban>\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
  | (?P<date>(?<![\d./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d?\.\d\d?\.(?:19|20)\d\d|\d\d?/\d\d?/(?:19|20)\d\d)(?![\d/-]|\.\d))
  | (?P<ipv4>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d))
  | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
  | (?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d]|-\d))
  | (?P<phone>(?<![\w-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}
      | \(\d{3}\)[ ]?\d{3}-\d{4} | \d{3}[.-]\d{3}[.-]\d{4} | \d{3}-\d{4})(?![\w-]))
    """,
    re.VERBOSE | re.ASCII,
)
_HINT = re.compile(r"[0-9@=:]")
KINDS = ("email", "card", "iban", "ipv4", "ssn", "phone", "date", "key")


class Feistel:
    """Keyed permutations of mixed-radix strings: each half is shifted in turn by a keyed function of the other."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def numbers(self, digits: list[int], radices: list[int], tweak: str) -> list[int]:
        half = len(digits) // 2
        sizes = [1, 1]
        values = [0, 0]
        for i, (d, r) in enumerate(zip(digits, radices)):
            side = i >= half
            values[side] = values[side] * r + d
            sizes[side] *= r
        for k in range(ROUNDS):
            side = k & 1
            values[side] = (values[side] + self._round(f"{tweak}/{k}/{sizes[0]}/{sizes[1]}/{values[1 - side]}")) % sizes[side]
        out = []
        for i in reversed(range(len(digits))):
            side = i >= half
            values[side], d = divmod(values[side], radices[i])
            out.append(d)
        return out[::-1]

    def _round(self, message: str) -> int:
        return int.from_bytes(hashlib.blake2b(message.encode(), key=self.key, digest_size=40).digest(), "big")

    def below(self, value: int, size: int, tweak: str) -> int:
        """Permutation of 0..size-1: walks the cycle of a slightly larger square until it is inside."""
        side = 1
        while side * side < size:
            side += 1
        while True:
            a, b = self.numbers([*divmod(value, side)], [side, side], tweak)
            value = a * side + b
            if value < size:
                return value

    def classes(self, text: str, tweak: str) -> str:
        """Digits, small and capital letters permuted each within its class; all else stays."""
        spots = [(i, 48, 10) if c.isdigit() else (i, 97, 26) if c.islower() else (i, 65, 26) for i, c in enumerate(text) if c.isascii() and c.isalnum()]
        out = list(text)
        new = self.numbers([ord(text[i]) - base for i, base, _ in spots], [r for *_, r in spots], tweak)
        for (i, base, _), d in zip(spots, new):
            out[i] = chr(base + d)
        return "".join(out)


def luhn(digits: list[int]) -> int:
    """Check sum modulo 10; 0 for a valid number."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10


def iban_sum(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _refill(pattern: str, digits: list[int]) -> str:
    left = iter(digits)
    return "".join(str(next(left)) if c.isdigit() else c for c in pattern)


def _ssn_ok(d: list[int]) -> bool:
    area, group, serial = d[0] * 100 + d[1] * 10 + d[2], d[3] * 10 + d[4], sum(d[5:])
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _date(text: str) -> tuple[datetime.date, str] | None:
    """Day and format, or None where there is no such day. With slashes a first number above 12 is a day, else a month."""
    a, b, c = map(int, re.split(r"[-./]", text))
    kind, day = ("ymd", (a, b, c)) if "-" in text else ("dmy", (c, b, a)) if "." in text or a > 12 else ("mdy", (c, a, b))
    try:
        return datetime.date(*day), kind
    except ValueError:
        return None


def pseudonym(kind: str, text: str, f: Feistel) -> str | None:
    """Stand-in of a found value, or None if it is not valid."""
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "email":
        local, _, domain = text.partition("@")
        name, _, top = domain.rpartition(".")
        if not any(c.isalnum() for c in local) or not top.isalpha():
            return None
        return f"{f.classes(local, kind)}@{f.classes(name, 'domain')}.{top}"
    if kind == "key":
        fixed = 4 if text.startswith("AKIA") else re.match(r"[A-Za-z_]+[\"']?[ ]*[=:][ ]*[\"']?", text).end()
        return text[:fixed] + f.classes(text[fixed:], kind)
    if kind == "card":
        if luhn(digits) or not any(digits):
            return None
        inner = f.numbers(digits[1:-1], [10] * (len(digits) - 2), kind)
        body = [digits[0], *inner]
        return _refill(text, [*body, -luhn([*body, 0]) % 10])
    if kind == "iban":
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_sum(plain) != 1:
            return None
        body = f.classes(plain[4:], plain[:2])
        new = iter(f"{plain[:2]}{98 - iban_sum(plain[:2] + '00' + body):02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)
    if kind == "ipv4":
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255:
            return None
        return ".".join(map(str, f.numbers(parts, [256] * 4, kind)))
    if kind == "ssn":
        if not _ssn_ok(digits):
            return None
        while True:
            digits = f.numbers(digits, [10] * 9, kind)
            if _ssn_ok(digits):
                return _refill(text, digits)
    if kind == "phone":
        head = text[1 : 1 + len(re.match(r"\d{1,3}(?=[ .(-])|\d", text[1:])[0])] if text[0] == "+" else ""
        own = digits[len(head) :]
        if not 7 <= len(digits) <= 15:
            return None
        radices = [8 if i == 0 and own[0] > 1 else 10 for i in range(len(own))]
        new = f.numbers([own[0] - 2 if radices[0] == 8 else own[0], *own[1:]], radices, kind)
        return _refill(text, [*map(int, head), new[0] + (2 if radices[0] == 8 else 0), *new[1:]])
    day, form = _date(text) or (None, "")
    if day is None or not 0 <= (at := (day - FIRST_DAY).days) < DAYS:
        return None
    # the same permutation of days for all formats, walked on until the day can be written as the value was
    mark = re.search(r"[-./]", text)[0]
    width = dict(zip(form, map(len, text.split(mark))))
    while True:
        at = f.below(at, DAYS, "date")
        new = FIRST_DAY + datetime.timedelta(at)
        parts = {c: f"{v:0{width[c]}d}" for c, v in zip("ymd", (new.year, new.month, new.day))}
        if all(len(parts[c]) == width[c] for c in form) and not (mark == "/" and form == "dmy" and new.day <= 12):
            return mark.join(parts[c] for c in form)


class Pseudonymizer:
    def __init__(self, key: bytes):
        feistel = Feistel(key)
        self.stand_in = lru_cache(1 << 16)(lambda kind, text: pseudonym(kind, text, feistel))

    def spans(self, text: str) -> list[tuple[str, int, int, str]]:
        """(kind, start, stop, pseudonym) of all findings, in order, positions in code points."""
        found, at = [], 0
        for line in text.split("\n"):
            if _HINT.search(line):
                pos = 0
                while m := PATTERN.search(line, pos):
                    new = self.stand_in(m.lastgroup, m[0])
                    # what fails validation as one kind may still be another further on
                    pos = m.end() if new is not None else m.start() + 1
                    if new is not None:
                        found.append((m.lastgroup, at + m.start(), at + m.end(), new))
            at += len(line) + 1
        return found

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        spans, out, at = self.spans(text), [], 0
        for _, start, stop, new in spans:
            out += [text[at:start], new]
            at = stop
        return ("".join([*out, text[at:]]) if spans else text), spans


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("pseudonym", pa.string())])


def _replaced(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    worker = Pseudonymizer(key)
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            texts, spans = [], []
            for t in part.column(1).to_pylist():
                new, found = worker.replace(t) if t else (t, [])
                texts.append(new)
                spans.append([dict(zip(("kind", "start", "stop", "pseudonym"), s)) for s in found])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(_SPAN))],
                ["doc_id", "text", "n_found", "spans"],
            )


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, the text with stand-ins, n_found, and the spans replaced (in the old text's code points)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda b: _replaced(b, key),
        "doc_id long, text string, n_found long, spans array<struct<kind: string, start: int, stop: int, pseudonym: string>>",
    )
