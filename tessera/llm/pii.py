"""PII replaced by format-preserving Feistel pseudonyms.

Identifiers are found by pattern and validated: card numbers (13 to 19 digits, Luhn), IBANs (mod 97), US social security
numbers, phone numbers with a country code or an area code, IPv4 addresses, calendar dates (year first, day first,
or month first where that alone is a date), mail addresses, cloud access keys and assigned secrets. Each value is read as a number (or as the
rank of its string) in the domain of its format and moved by a keyed permutation of that domain: an alternating
Feistel network of ``ROUNDS`` rounds over two halves of the number, its round function a keyed BLAKE2 hash, walked on
until it falls into the domain. Check digits are computed anew, punctuation and letter case stay.

As the permutation depends on the key, the kind and the value alone, equal values get equal pseudonyms in every document
(however they are punctuated), so they stay linked, different ones never collide within a format, and who
holds the key can reverse them (``restore``). Documents are independent: nothing is shuffled.

A card number may stand among other digit groups: at every group start the longest valid run of whole groups is taken. Where
a pseudonym would make another run the first valid one, and for month-first dates that would read as day-first, the walk goes on, as
``restore`` must find the same places again: there equal values can get different pseudonyms. Secrets of any length are moved whole, in
pieces that depend on the ones before.

Edge cases: null text stays null with nothing found; an empty text has none; texts are searched whole, however long;
overlapping finds go to the one that begins first, then to the longer, and
cards are sought among the digits that are left, as no other kind depends on a check that a neighbour's pseudonym could change; repeated rows are each returned; an empty table
gives an empty result; other columns are passed through.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import itertools
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY
FOUND = "array<struct<kind:string,first:int,size:int,pseudonym:string>>"


class Permutation:
    """Keyed permutation of 0 .. size-1."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.key, self.tweak, self.size = key, f"{kind}:{size}".encode(), size
        self.a = math.isqrt(max(0, size - 1)) + 1              # least a with a * a >= size

    def _round(self, i: int, x: int) -> int:
        h = hashlib.blake2b(b"%s|%d|%d" % (self.tweak, i, x), key=self.key, digest_size=64).digest()
        return int.from_bytes(h, "big") % self.a

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.a)
        for i in range(ROUNDS):
            left, right = right, (left + self._round(i, right)) % self.a
        return left * self.a + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.a)
        for i in reversed(range(ROUNDS)):
            left, right = (right - self._round(i, left)) % self.a, left
        return left * self.a + right

    def move(self, x: int, back: bool = False) -> int:
        step = self._back if back else self._once
        x = step(x)
        while x >= self.size:              # walk on until inside the domain: still a permutation of it
            x = step(x)
        return x


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _fill(shape: str, digits: str) -> str:
    """The digits in the places of the shape's digits."""
    left = iter(digits)
    return re.sub(r"\d", lambda _: next(left), shape)


def _number(key: bytes, kind: str, digits: str, back: bool) -> str:
    if not digits:
        return digits
    return str(Permutation(key, kind, 10 ** len(digits)).move(int(digits), back)).zfill(len(digits))


def _card_spans(groups: list[str], i: int):
    """(first, past the last) group of each card from group ``i`` on: at each start the longest valid run of 13 to 19 digits."""
    while i < len(groups):
        ends, size = [], 0
        for j in range(i, len(groups)):
            size += len(groups[j])
            if size > 19:
                break
            if size >= 13:
                ends.append(j + 1)
        for j in reversed(ends):
            d = "".join(groups[i:j])
            if luhn_digit(d[:-1]) == d[-1] and len(set(d)) > 1:
                yield i, j
                i = j - 1
                break
        i += 1


def _digit_groups(text: str, taken: list[tuple[int, int]]):
    """Lists of (first character, digits) of groups in a row, apart from the places taken (in order)."""
    for run in RUN.finditer(text):
        if run.end() - run.start() < 13:
            continue
        row = []
        for m in DIGITS.finditer(text, run.start(), run.end()):
            before = bisect.bisect_left(taken, (m.end(), 0)) - 1         # the last that begins before the group's end
            if before >= 0 and taken[before][1] > m.start():
                yield row
                row = []
            else:
                row.append((m.start(), m[0]))
        yield row


def _cards(text: str, key: bytes, back: bool, taken: list[tuple[int, int]]):
    """(start, end, pseudonym) of the cards; each is walked on until the same groups are found in its place."""
    for row in _digit_groups(text, taken):
        at, groups = [a for a, _ in row], [g for _, g in row]
        spans = list(_card_spans(groups, 0))
        for n in reversed(range(len(spans))) if back else range(len(spans)):
            i, j = spans[n]
            begin = spans[n - 2][1] if n > 1 else 0                # what begins before does not reach this card
            same = spans[max(0, n - 1):n + 1]
            shape = re.sub(r"\d", "0", " ".join(groups[i:j]))
            d = "".join(groups[i:j])
            while True:
                body = _number(key, "card", d[:-1], back)
                d = body + luhn_digit(body)
                groups[i:j] = _fill(shape, d).split(" ")
                if len(set(d)) > 1 and list(itertools.islice(_card_spans(groups, begin), len(same))) == same:
                    break
        for i, j in spans:
            start, end = at[i], at[j - 1] + len(groups[j - 1])
            yield start, end, _fill(text[start:end], "".join(groups[i:j]))


def _iban(key: bytes, s: str, back: bool) -> str | None:
    c = re.sub(r"\s", "", s)
    check = lambda head, body: int("".join(str(int(x, 36)) for x in body + head))
    if not 15 <= len(c) <= 34 or check(c[:4], c[4:]) % 97 != 1:
        return None
    body = _rank_text(key, "iban", c[4:], back)
    new = c[:2] + f"{98 - check(c[:2] + '00', body) % 97:02d}" + body
    left = iter(new)
    return re.sub(r"\S", lambda _: next(left), s)


def _ssn(key: bytes, s: str, back: bool) -> str | None:
    """Area 001-899 but 666, group 01-99, serial 0001-9999."""
    area, group, serial = (int(x) for x in s.split("-"))
    if not area or area == 666 or area >= 900 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank, serial = divmod(Permutation(key, "ssn", 898 * 99 * 9999).move(rank, back), 9999)
    area, group = divmod(rank, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(key: bytes, s: str, back: bool) -> str | None:
    """The last ten digits move; a country code stays."""
    d = _digits(s)
    if not 10 <= len(d) <= 13 or (len(d) > 10 and not s.startswith("+")):
        return None
    return _fill(s, d[:-10] + _number(key, "phone", d[-10:], back))


def _ip(key: bytes, s: str, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    x = Permutation(key, "ip", 2 ** 32).move(int.from_bytes(bytes(map(int, parts)), "big"), back)
    return ".".join(str(b) for b in x.to_bytes(4, "big"))


def _date(key: bytes, s: str, back: bool) -> str | None:
    a, b, c = re.split(r"[-/.]", s)
    first = len(a) == 4
    y, m, d = (a, b, c) if first else (c, b, a)
    month_first = not first and int(m) > 12
    if month_first:
        m, d = d, m
    try:
        day = datetime.date(int(y), int(m), int(d)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    moves = Permutation(key, "date", DAYS)
    new = datetime.date.fromordinal(FIRST_DAY + moves.move(day, back))
    while month_first and new.day <= 12:                   # would be read as day first
        new = datetime.date.fromordinal(FIRST_DAY + moves.move(new.toordinal() - FIRST_DAY, back))
    sep, parts = s[len(a)], (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")
    return sep.join(parts if first else (parts[1], parts[2], parts[0]) if month_first else parts[::-1])


def _rank_text(key: bytes, kind: str, s: str, back: bool) -> str:
    """Letters and digits of a string moved together; their places, cases and everything else stay."""
    base, size, rank = [], 1, 0
    for c in s:
        low, n = ("0", 10) if c.isascii() and c.isdigit() else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else ("", 1)
        base.append((low, n))
        size *= n
        rank = rank * n + (ord(c) - ord(low) if low else 0)
    if size == 1:
        return s
    shape = "".join(low or c for (low, _), c in zip(base, s))
    rank = Permutation(key, f"{kind}:{shape}", size).move(rank, back)
    out = []
    for (low, n), c in zip(reversed(base), reversed(s)):
        rank, x = divmod(rank, n)
        out.append(chr(ord(low) + x) if low else c)
    return "".join(reversed(out))


def _mail(key: bytes, s: str, back: bool) -> str | None:
    name, _, host = s.rpartition("@")
    return _rank_text(key, "mail", name, back) + "@" + host


def _cloud(key: bytes, s: str, back: bool) -> str | None:
    return s[:4] + _rank_text(key, "key", s[4:], back)


def _secret(key: bytes, s: str, back: bool) -> str | None:
    head = re.match(r"[A-Za-z_]+\s?[=:]\s?[\"']?", s)[0]
    out, before = [head], hashlib.blake2b(key=key, digest_size=16)
    for i in range(len(head), len(s), PIECE):
        old = s[i:i + PIECE]
        new = _rank_text(key, "secret" if i == len(head) else f"secret:{before.hexdigest()}", old, back)
        before.update((new if back else old).encode())           # the clear text before, known when going back as well
        out.append(new)
    return "".join(out)


# kind, pattern, pseudonym (None: not valid, left alone)
KINDS: list[tuple[str, str, Callable]] = [
    ("mail", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}", _mail),
    ("secret", r"(?i:password|passwd|secret|token|api_?key)\s?[=:]\s?[\"']?[A-Za-z0-9/+_-]{8,}", _secret),
    ("key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", _cloud),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)", _ip),
    ("date", r"(?<![\d./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![./-]?\d)", _date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("phone", r"(?<![\dA-Za-z.])(?:\+\d{1,3}[ -]?)?\(\d{3}\)[ -]?\d{3}[ -]?\d{4}(?!\d)|(?<![\dA-Za-z.])\+\d{1,3}(?:[ -]?\d){10}(?!\d)"
              r"|(?<![\dA-Za-z.-])\d{3}[ -]\d{3}[ -]\d{4}(?![\d-])", _phone),
]
DIGIT = re.compile(r"\d")
DIGITS = re.compile(r"[0-9]+")
RUN = re.compile(r"(?<![\dA-Za-z.])[0-9]++(?:[ -][0-9]++(?![A-Za-z]))*+(?![\dA-Za-z])")     # digit groups in a row
PIECE = 128                                                      # characters of a secret moved together
MARKS = {"mail": "@", "secret": "=:", "key": ("AKIA", "ASIA")}   # other kinds: a digit
PATTERNS = [(kind, re.compile(p), f) for kind, p, f in KINDS]


def finds(text: str, key: bytes, back: bool = False) -> list[tuple[str, int, int, str]]:
    """Valid identifiers (kind, first character, length, pseudonym) that do not overlap, in order."""
    all_, digit = [], DIGIT.search(text) is not None
    for kind, pattern, f in PATTERNS:
        if not (any(x in text for x in MARKS[kind]) if kind in MARKS else digit):
            continue                       # nothing of this kind can match
        for m in pattern.finditer(text):
            new = f(key, m[0], back)
            if new is not None:
                all_.append((m.start(), -len(m[0]), kind, new))
    out, end = [], 0
    for start, minus, kind, new in sorted(all_):
        if start >= end:
            out.append((kind, start, -minus, new))
            end = start - minus
    if digit:
        cards = _cards(text, key, back, [(start, start + size) for _, start, size, _ in out])
        out += [("card", start, end - start, new) for start, end, new in cards]
        out.sort(key=lambda x: x[1])
    return out


def replace(text: str, found: list[tuple[str, int, int, str]]) -> str:
    parts, at = [], 0
    for _, s, n, new in found:
        parts += [text[at:s], new]
        at = s + n
    return "".join(parts) + text[at:]


def restore(text: str, key: bytes) -> str:
    """The text before ``replace``, for who holds the key."""
    return replace(text, finds(text, key, True))


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", out_col: str = "clean_text", found_col: str = "found") -> DataFrame:
    """``docs`` with the text after replacement and the finds (kind, first character, size, pseudonym)."""
    if not key:
        raise ValueError("a key is needed")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("size", pa.int32()), ("pseudonym", pa.string())]))

    def run(batches):
        for b in batches:
            texts, found = [], []
            for t in b.column(1).to_pylist():
                f = finds(t, key) if t else []
                texts.append(replace(t, f) if f else t)
                found.append([dict(zip(("kind", "first", "size", "pseudonym"), x)) for x in f])
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), pa.array(found, kind)], names=["row", "clean", "found"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, clean string, found {FOUND}"
    return rows.mapInArrow(run, schema).select("row.*", F.col("clean").alias(out_col), F.col("found").alias(found_col))
