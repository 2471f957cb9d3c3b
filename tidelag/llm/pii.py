"""Format-preserving pseudonyms: a keyed Feistel permutation of validated numbers and dates.

A value that passes its check is replaced by another valid value of the same format. The permutation
depends on the key and the kind of value alone, so equal values stay equal in all documents, days also as
2024-05-01 and 01.05.2024, and phone numbers with and without their country's code; two values of a
format never meet. Nothing is stored or shuffled.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 10
_PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9._%+-]+(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}))
    |(?P<iso>(?<![\w/-])\d{4}-\d{2}-\d{2}(?![\w/-]))
    |(?P<date>(?<![\w./-])\d{2}(?P<sep>[./])\d{2}(?P=sep)\d{4}(?![\w/-]))
    |(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<phone>(?<![\w-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]))
    |(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))
    |(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?!\w))""",
    re.VERBOSE,
)
_worth = re.compile(r"[0-9]|@").search
_group = re.compile(r"[^\W_]+")
_chain = re.compile(r"\d+(?:[ -]\d+)*")
_inner = re.compile(r"\w").match
# The length of each country's IBANs.
_IBAN_LENGTHS = {
    country: n
    for n, countries in (
        (15, "NO"), (16, "BE"), (18, "DK FI FO GL NL"), (19, "MK SI"), (20, "AT BA EE KZ LT LU XK"), (21, "CH HR LI LV"), (22, "BG BH CR DE GB GE IE ME RS"), (23, "AE GI IL TL"),
        (24, "AD CZ ES MD PK RO SA SE SK TN VG"), (25, "PT"), (26, "IS TR"), (27, "FR GR IT MC MR SM"), (28, "AL AZ BY CY DO GT HU LB PL SV"), (29, "BR PS QA UA"), (30, "JO KW MU"), (31, "MT SC"), (32, "LC"),
    )
    for country in countries.split()
}


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed bijection of 0 .. size - 1: a Feistel network over a * a >= size, walked until inside."""
    if size < 2:
        return value
    a = 1
    while a * a < size:
        a *= 2
    wide = (a.bit_length() + 7) // 8 + 8
    while True:
        left, right = divmod(value, a)
        for r in range(ROUNDS):
            f = hashlib.blake2b(f"{tweak}:{size}:{r}:{right}".encode(), key=key[:64], digest_size=wide).digest()
            left, right = right, (left + int.from_bytes(f, "big")) % a
        value = left * a + right
        if value < size:
            return value


def invert(value: int, size: int, key: bytes, tweak: str) -> int:
    """The inverse of permute()."""
    if size < 2:
        return value
    a = 1
    while a * a < size:
        a *= 2
    wide = (a.bit_length() + 7) // 8 + 8
    while True:
        left, right = divmod(value, a)
        for r in reversed(range(ROUNDS)):
            f = hashlib.blake2b(f"{tweak}:{size}:{r}:{left}".encode(), key=key[:64], digest_size=wide).digest()
            left, right = (right - int.from_bytes(f, "big")) % a, left
        value = left * a + right
        if value < size:
            return value


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """Luhn sum modulo 10; 0 for a valid number."""
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _card(s: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", s)
    if luhn(d):
        return None
    body = f"{permute(int(d[1:-1]), 10 ** (len(d) - 2), key, f'card{len(d)}{d[0]}'):0{len(d) - 2}d}"
    out = d[0] + body
    return _refill(s, out + str(-luhn(out + "0") % 10))


def _ip(s: str, key: bytes) -> str | None:
    o = [int(x) for x in s.split(".")]
    if max(o) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
        return None
    return ".".join(map(str, permute(int.from_bytes(bytes(o), "big"), 2**32, key, "ip").to_bytes(4, "big")))


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(s: str, key: bytes) -> str | None:
    d = s.replace("-", "")
    if not _ssn_valid(d):
        return None
    while True:
        d = f"{permute(int(d), 10**9, key, 'ssn'):09d}"
        if _ssn_valid(d):
            return _refill(s, d)


def _phone(s: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", s)
    return _refill(s, d[:-10] + f"{permute(int(d[-10:]), 10**10, key, 'phone'):010d}")


def _day(year: int, month: int, day: int) -> datetime.date | None:
    try:
        return datetime.date(year, month, day)
    except ValueError:
        return None


def _shift_date(d: datetime.date, key: bytes, tweak: str) -> datetime.date:
    """Another date of the same 200 years."""
    first = datetime.date(max(1, d.year // 200 * 200), 1, 1).toordinal()
    last = datetime.date(min(9999, d.year // 200 * 200 + 199), 12, 31).toordinal()
    return datetime.date.fromordinal(first + permute(d.toordinal() - first, last - first + 1, key, f"{tweak}{first}"))


def _iso(s: str, key: bytes) -> str | None:
    d = _day(int(s[:4]), int(s[5:7]), int(s[8:]))
    return d and _shift_date(d, key, "date").isoformat()


def _date(s: str, key: bytes) -> str | None:
    """Day first, linked with the same day in other formats; month first only if it can't be day first, and then its pseudonym can't be either."""
    a, b, y, sep = int(s[:2]), int(s[3:5]), int(s[6:]), s[2]
    if d := _day(y, b, a):
        d = _shift_date(d, key, "date")
        return f"{d.day:02d}{sep}{d.month:02d}{sep}{d.year:04d}"
    if d := _day(y, a, b):
        while True:
            d = _shift_date(d, key, "mdy")
            if d.day > 12:
                return f"{d.month:02d}{sep}{d.day:02d}{sep}{d.year:04d}"
    return None


def _mix_classes(s: str, key: bytes, tweak: str) -> str:
    """Digits to digits, letters to letters of their case, all of s permuted as one number of mixed radix."""
    kinds = [("0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isascii() and c.isalnum() else c for c in s]
    n, size = 0, 1
    for c, k in zip(s, kinds, strict=True):
        n, size = n * len(k) + k.index(c), size * len(k)
    n, out = permute(n, size, key, tweak), []
    for k in reversed(kinds):
        n, i = divmod(n, len(k))
        out.append(k[i])
    return "".join(reversed(out))


def _iban_mod(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(s: str, key: bytes) -> str | None:
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_mod(plain) != 1:
        return None
    shape = re.sub("[A-Z]", "A", re.sub(r"\d", "9", plain[4:]))
    body = _mix_classes(plain[4:], key, f"iban{plain[:2]}{shape}")
    out = plain[:2] + f"{98 - _iban_mod(plain[:2] + '00' + body):02d}" + body
    it = iter(out)
    return "".join(c if c == " " else next(it) for c in s)


def _email(s: str, key: bytes) -> str | None:
    """The name before the @, each letter and digit within its kind; shorter than 2 stays."""
    shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))
    return _mix_classes(s, key, f"email{shape}") if len(s) > 1 else None


_KINDS = {"email": _email, "iso": _iso, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card, "iban": _iban}


@lru_cache(50_000)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The value's pseudonym; None if it fails its check."""
    return _KINDS[kind](value, key)


def _inside(kind: str, text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """Places of what may be a valid value where a match fails its check, cut at separators.

    Cards: 13 to 19 digits from any of the match's groups, also beyond the match, which its length cut
    off; the usual lengths of the large issuers first, then the longest. IBANs: from the start, of the
    country's length, or of any length where the country is not known.
    """
    if kind == "iban":
        groups = [m.span() for m in _group.finditer(text, start, stop)]
        sizes = [sum(b - a for a, b in groups[: i + 1]) for i in range(len(groups))]
        own = _IBAN_LENGTHS.get(text[start : start + 2])
        return [(start, b) for (_, b), n in reversed(list(zip(groups, sizes, strict=True))) if n in ((own,) if own else range(15, 35))]
    if kind != "card":
        return []
    groups = [m.span() for m in _group.finditer(text, start, _chain.match(text, start, stop + 40).end())]
    found = []
    for i, (a, _) in enumerate(groups):
        n = 0
        for c, b in groups[i:] if a < stop else ():
            n += b - c
            if 13 <= n <= 19 and not _inner(text, b):
                usual = n == 16 and text[a] in "23456" or n == 15 and text[a] == "3"
                found.append((not usual, -n, a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def _next_value(text: str, at: int, key: bytes) -> tuple[str, int, int, str] | None:
    """Kind, start, stop and pseudonym of the first valid value from `at` on.

    Behind a match that fails, and holds no valid value, the scan goes on after the match's first group.
    """
    while m := _PATTERN.search(text, at):
        kind = "date" if m.lastgroup == "sep" else m.lastgroup
        if (new := pseudonym(kind, m[0], key)) is not None:
            return kind, m.start(), m.end(), new
        for a, b in _inside(kind, text, *m.span()):
            if (new := pseudonym(kind, text[a:b], key)) is not None:
                return kind, a, b, new
        first = _group.search(text, m.start(), m.end())
        at = first.end() if first else m.end()
    return None


def replace_all(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """text with every valid value replaced, and the kind and place of each in the new text."""
    if not text or not _worth(text):
        return text, []
    out, spans, at, size = [], [], 0, 0
    while found := _next_value(text, at, key):
        kind, start, stop, new = found
        out += [text[at:start], new]
        size += start - at + len(new)
        spans.append((kind, size - len(new), size))
        at = stop
    return "".join([*out, text[at:]]) if spans else text, spans


def pseudonymised(text: Column, key: bytes) -> Column:
    """Struct of the pseudonymised text and its spans (kind, start, stop, in code points of the new text).

    Kinds: card (Luhn), iban (mod 97), ssn, phone, ip, iso and date (calendar dates), email (the name
    before the @). Numbers that fail their check stay. Null text stays null, without spans.
    """

    @F.pandas_udf("text string, spans array<struct<kind:string,start:int,stop:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            both = [replace_all(t, key) for t in texts]
            yield pd.DataFrame({"text": pd.Series([t for t, _ in both], dtype=object), "spans": pd.Series([[{"kind": k, "start": a, "stop": b} for k, a, b in s] for _, s in both], dtype=object)})

    return run(text)
