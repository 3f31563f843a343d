"""Format-preserving pseudonyms by a keyed Feistel permutation.

A value is found by its shape and validated (check digits, ranges, the calendar); only valid values are
replaced. Its format is a numbered set of strings: 16-digit numbers with a right check digit, the days of
two centuries, local parts of one letter-and-digit pattern. A Feistel network permutes the numbers, so
equal values get equal pseudonyms in every document without any table, and a holder of the key can
undo them. Each value moves one step along a single keyed cycle, so none keeps its own text.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from functools import lru_cache
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common

ROUNDS = 10
FIRST_DAY, DAYS = date(1900, 1, 1), 73049


class Permutation:
    """A keyed permutation of range(size): Feistel rounds over pairs of about the root of size, walked until in range."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.key, self.tweak, self.size = hashlib.blake2b(key).digest(), tweak.encode(), size
        self.a = isqrt(max(size - 1, 0)) + 1
        self.b = -(-size // self.a)

    def _mask(self, i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d|%d|%d|%s" % (i, self.size, half, self.tweak), key=self.key, digest_size=32).digest(), "big")

    def _walk(self, x: int, order: range, sign: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in order:
                if i % 2:
                    right = (right + sign * self._mask(i, left)) % self.b
                else:
                    left = (left + sign * self._mask(i, right)) % self.a
            x = left * self.b + right
            if x < self.size:
                return x

    def forward(self, x: int) -> int:
        return self._walk(x, range(ROUNDS), 1)

    def back(self, x: int) -> int:
        return self._walk(x, range(ROUNDS)[::-1], -1)

    def step(self, x: int, by: int = 1) -> int:
        """The neighbour of x on a cycle through the whole range: a permutation that moves every number."""
        return self.back((self.forward(x) + by) % self.size)


@dataclass(frozen=True)
class Value:
    """A valid value: its number within its format, and what writes a number back."""

    number: int
    size: int
    tweak: str
    write: Callable[[int], str]


@dataclass(frozen=True)
class Format:
    kind: str
    pattern: re.Pattern
    read: Callable[[str], Value | None]
    #: The part of a match that is replaced.
    group: int = 0


def _fill(layout: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in layout)


def _luhn(body: str) -> str:
    """The check digit after body."""
    doubled = (int(c) * 2 if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-sum(d - 9 if d > 9 else d for d in doubled) % 10)


def _card(text: str) -> Value | None:
    digits = re.sub("[^0-9]", "", text)
    n = len(digits)
    if len(set(digits)) == 1 or _luhn(digits[:-1]) != digits[-1]:
        return None
    return Value(int(digits[:-1]), 10 ** (n - 1), f"card{n}", lambda x: _fill(text, (b := f"{x:0{n - 1}d}") + _luhn(b)))


def _phone(text: str) -> Value | None:
    digits = re.sub("[^0-9]", "", text)
    code = re.match(r"\+([0-9]{1,3})(?=[^0-9])", text)
    head = code.group(1) if code else ""
    rest = digits[len(head) :]
    if not (8 <= len(digits) <= 15 if code else len(digits) == 10) or len(rest) < 6:
        return None
    return Value(int(rest), 10 ** len(rest), f"phone{head}", lambda x: _fill(text, head + f"{x:0{len(rest)}d}"))


def _social(text: str) -> Value | None:
    area, group, serial = text.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    return Value(int(area + group + serial), 10**9, "social", lambda x: _fill(text, f"{x:09d}"))


def _address(text: str) -> Value | None:
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    return Value(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "address", lambda x: ".".join(map(str, x.to_bytes(4, "big"))))


_CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase)


def _alphabets(text: str) -> list[str | None]:
    return [next((a for a in _CLASSES if c in a), None) for c in text]


def _rank(text: str, alphabets: list[str | None]) -> tuple[int, int]:
    number = 0
    for c, a in zip(text, alphabets, strict=True):
        if a:
            number = number * len(a) + a.index(c)
    return number, prod(len(a) for a in alphabets if a)


def _unrank(number: int, layout: str, alphabets: list[str | None]) -> str:
    out = list(layout)
    for i in reversed(range(len(out))):
        if a := alphabets[i]:
            number, at = divmod(number, len(a))
            out[i] = a[at]
    return "".join(out)


def _patterned(text: str, tweak: str) -> Value | None:
    """Letters stay letters of their case, digits digits, other characters as they are."""
    alphabets = _alphabets(text)
    number, size = _rank(text, alphabets)
    shape = "".join("-" if a is None else a[0] for a in alphabets)
    return Value(number, size, f"{tweak}|{shape}", lambda x: _unrank(x, text, alphabets)) if size > 1 else None


def _email(text: str) -> Value | None:
    local, _, domain = text.rpartition("@")
    own = _patterned(local, "email" + domain.lower())
    return own and Value(own.number, own.size, own.tweak, lambda x: f"{own.write(x)}@{domain}")


#: A longer secret is replaced in blocks of at most so many characters, since half of a number must not exceed a mask.
LONG = 96


def _secret_kind(text: str) -> str | None:
    """The digits of a hexadecimal secret, an empty string for any other, None for a text that is none."""
    if not any(c.isdigit() for c in text) or not any(c.isalpha() for c in text):
        return None
    return next((digits for digits in ("0123456789abcdef", "0123456789ABCDEF") if set(text) <= set(digits)), "")


def _secret(text: str) -> Value | None:
    digits = _secret_kind(text)
    if digits is None:
        return None
    if digits:
        alphabets: list[str | None] = [digits] * len(text)
        number, size = _rank(text, alphabets)
        return Value(number, size, "hex" + digits[-1], lambda x: _unrank(x, text, alphabets))
    return _patterned(text, "secret")


def _secret_blocks(text: str) -> list[tuple[str, Value | None]]:
    """Even blocks of a valid long secret, each a value of its place; None where a block has nothing to replace."""
    digits, n = _secret_kind(text), -(-len(text) // LONG)
    out: list[tuple[str, Value | None]] = []
    for i in range(n):
        part = text[len(text) * i // n : len(text) * (i + 1) // n]
        if digits:
            alphabets: list[str | None] = [digits] * len(part)
            number, size = _rank(part, alphabets)
            out.append((part, Value(number, size, f"hex{digits[-1]}|{i}", lambda x, part=part, alphabets=alphabets: _unrank(x, part, alphabets))))
        else:
            out.append((part, _patterned(part, f"secret|{i}")))
    return out


def _mod97(bban: str, country: str) -> str:
    number = int("".join(str(int(c, 36)) for c in bban + country + "00"))
    return f"{98 - number % 97:02d}"


def _account(text: str) -> Value | None:
    compact = text.replace(" ", "")
    country, check, bban = compact[:2], compact[2:4], compact[4:]
    if not 11 <= len(bban) <= 30 or _mod97(bban, country) != check:
        return None
    own = _patterned(bban, "account" + country)

    def write(x: int) -> str:
        new = iter(country + _mod97(b := own.write(x), country) + b)
        return "".join(c if c == " " else next(new) for c in text)

    return own and Value(own.number, own.size, own.tweak, write)


def _day(text: str) -> Value | None:
    """Year first, or day first; month first only where day first is no date. The separators and leading zeros stay."""
    a, sep, b, _, c = re.match(r"([0-9]+)([-/.])([0-9]+)([-/.])([0-9]+)", text).groups()
    widths = (len(a), len(b), len(c))
    orders = ((0, 1, 2),) if widths[0] == 4 else ((2, 1, 0), (2, 0, 1))
    for order in orders:
        parts = [int((a, b, c)[i]) for i in order]
        try:
            number = (date(*parts) - FIRST_DAY).days
        except ValueError:
            continue
        if not 0 <= number < DAYS:
            return None

        def write(x: int, order=order) -> str:
            d = FIRST_DAY + timedelta(days=x)
            out = ["", "", ""]
            for i, v in zip(order, (d.year, d.month, d.day), strict=True):
                out[i] = f"{v:0{widths[i]}d}"
            return sep.join(out)

        return Value(number, DAYS, "day", write)
    return None


#: In order of precedence where matches overlap.
FORMATS = (
    Format("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"), _email),
    Format("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _account),
    Format("secret", re.compile(r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']? {0,4}[=:] {0,4}[\"']([A-Za-z0-9_.+/=-]{16,}+)[\"']"), _secret, 1),
    Format("card", re.compile(r"(?<![A-Za-z0-9_])(?<![0-9][.,-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![A-Za-z0-9_])(?![.,-][0-9])"), _card),
    Format("social", re.compile(r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])"), _social),
    Format("date", re.compile(r"(?<![A-Za-z0-9_])(?<![0-9][-/.])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![A-Za-z0-9_])(?![-/.][0-9])"), _day),
    Format("address", re.compile(r"(?<![A-Za-z0-9_])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9_])(?!\.[0-9])"), _address),
    Format("phone", re.compile(r"(?<![A-Za-z0-9_+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,3}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})(?![A-Za-z0-9_])"), _phone),
)


class Pseudonyms:
    def __init__(self, key: bytes, formats: tuple[Format, ...] = FORMATS):
        self.key, self.formats = key, formats
        self.of = lru_cache(65536)(self._of)

    def _of(self, at: int, text: str, by: int = 1) -> str | None:
        """The pseudonym of a value of the format with this number; None if the text is no valid value."""
        read = self.formats[at].read
        if read is _secret and len(text) > LONG:
            return self._long(text, by)
        value = read(text)
        if value is None:
            return None
        permutation = Permutation(self.key, value.tweak, value.size)
        number = value.number
        while True:
            number = permutation.step(number, by)
            new = value.write(number)
            # Numbers that aren't valid values of this format are stepped over.
            if (back := read(new)) and (back.number, back.size, back.tweak) == (number, value.size, value.tweak):
                return new

    def _long(self, text: str, by: int) -> str | None:
        """The pseudonym of a long secret, each block of which moves along its own cycle."""
        kind = _secret_kind(text)
        if kind is None:
            return None
        parts = [(part, value, value and Permutation(self.key, value.tweak, value.size)) for part, value in _secret_blocks(text)]
        numbers = [value.number if value else 0 for _, value, _ in parts]
        while True:
            numbers = [permutation.step(x, by) if permutation else x for x, (_, _, permutation) in zip(numbers, parts, strict=True)]
            new = "".join(value.write(x) if value else part for x, (part, value, _) in zip(numbers, parts, strict=True))
            if _secret_kind(new) == kind:
                return new

    def replace(self, text: str, by: int = 1) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many values of each kind it had. by=-1 undoes by=1."""
        if not re.search("[0-9@]", text):
            return text, {}
        found: list[tuple[int, int, str]] = []
        counts: dict[str, int] = {}
        for at, f in enumerate(self.formats):
            taken, spans = 0, sorted(found)
            for m in f.pattern.finditer(text):
                start, end = m.span(f.group)
                while taken < len(spans) and spans[taken][1] <= start:
                    taken += 1
                if taken < len(spans) and spans[taken][0] < end:
                    continue
                # Very long values are not remembered.
                new = (self.of if end - start <= LONG else self._of)(at, m.group(f.group), by)
                if new is not None:
                    found.append((start, end, new))
                    counts[f.kind] = counts.get(f.kind, 0) + 1
        out, last = [], 0
        for start, end, new in sorted(found):
            out += [text[last:start], new]
            last = end
        return "".join([*out, text[last:]]), counts


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """Replace every valid personal value of each whole text by its pseudonym under a secret key, whose holder can undo it.

    Returns one row per input row: doc_id, text, n_values, kinds (kind:count, by kind, comma-joined). A
    null text stays null and has no values; an empty text stays empty; numbers and dates that fail their
    validation stay as they are; equal values get equal pseudonyms in all rows, repeated rows included;
    where matches overlap, the earlier format of FORMATS wins; an empty table gives an empty result;
    other columns are ignored; a text of any length is searched whole. Rows are independent: nothing is shuffled.
    """
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in batches:
            texts, numbers, kinds = [], [], []
            for raw in batch["text"].to_pylist():
                text, counts = (None, {}) if raw is None else own.replace(raw.decode("utf-8", "surrogateescape"))
                texts.append(text if text is None else text.encode("utf-8", "surrogateescape"))
                numbers.append(sum(counts.values()))
                kinds.append(",".join(f"{k}:{n}" for k, n in sorted(counts.items())))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.binary()), pa.array(numbers, pa.int64()), pa.array(kinds, pa.string())], ["doc_id", "text", "n_values", "kinds"])

    done = common.texts_of(docs).mapInArrow(run, "doc_id long, text binary, n_values long, kinds string")
    return done.withColumn("text", F.col("text").cast("string"))
