"""Format-preserving pseudonyms for personal numbers, dates and addresses."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The key of the query alone. It is public, so its pseudonyms can be reversed; callers of ``pseudonymise`` bring their own.
QUERY_KEY = "asterism"
#: Letters and digits that move together; longer runs are cut into blocks.
BLOCK = 32
#: Longer values are not remembered.
LONGEST_KEPT = 256
#: Kinds in the order in which overlapping matches are settled.
KINDS = ("email", "secret", "iban", "card", "ssn", "phone", "ip", "date")
DAY_ONE, DAY_LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
#: Characters in an IBAN by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

#: Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

EMAIL = re.compile(r"[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?<=[=:])[0-9a-f]{16,}|AKIA[0-9A-Z]{16})(?![0-9A-Za-z])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
NUMBER = re.compile(
    r"(?<![\w.@+-])(?:"
    r"(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\.?\d)"
    r"|(?P<date>\d{4}([-/.])\d{1,2}\3\d{1,2}|\d{1,2}([-/.])\d{1,2}\4\d{4})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<phone>(?:\+1[ .-]?|001[ .-])(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|(?:\+[2-9]|00[2-9](?=\d{0,2}[ .(-]))\d{0,2}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,4}){1,4}"
    r"|(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4})"
    r"|(?P<card>\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})"
    r")(?![\w@]|-\d)"
)


def _round(key: bytes, tweak: bytes, i: int, x: int, bits: int) -> int:
    """``bits`` keyed bits from ``x``."""
    data = b"%d|%d|%s%s" % (i, len(tweak), tweak, x.to_bytes((bits + 7) // 8, "big"))
    if bits <= 512:
        found = hashlib.blake2b(data, key=key, digest_size=(bits + 7) // 8).digest()
    else:
        found = hashlib.shake_128(key + data).digest((bits + 7) // 8)
    return int.from_bytes(found, "big") & ((1 << bits) - 1)


def permute(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0..size-1: a Feistel network on the next even number of bits, walked until it is inside.

    At least four bits are used; a walk always ends, as it follows the cycle of
    a permutation on which ``x`` itself lies.
    """
    if size < 2:
        return x
    half = max(2, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for i in range(ROUNDS):
            left, right = right, left ^ _round(key, tweak, i, right, half)
        x = left << half | right
        if x < size:
            return x


def unpermute(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """The inverse of ``permute``."""
    if size < 2:
        return x
    half = max(2, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for i in reversed(range(ROUNDS)):
            left, right = right ^ _round(key, tweak, i, left, half), left
        x = left << half | right
        if x < size:
            return x


def _refill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced by ``digits`` in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def _move(digits: str, key: bytes, tweak: str) -> str:
    return f"{permute(int(digits), 10 ** len(digits), key, f'{tweak}{len(digits)}'.encode()):0{len(digits)}d}"


def card(s: str, key: bytes) -> str | None:
    """13 to 19 digits that pass the Luhn check, and are not all the same, become such digits again."""
    d = _digits(s)
    if len(set(d)) == 1 or int(d[-1]) != luhn(d[:-1]):
        return None
    moved = _move(d[:-1], key, "card")
    return _refill(s, moved + str(luhn(moved)))


def ssn(s: str, key: bytes) -> str | None:
    """AAA-GG-SSSS with a valid area (not 000, 666, 900 on), group and serial number."""
    a, g, n = int(s[:3]), int(s[4:6]), int(s[7:])
    if a in (0, 666) or a >= 900 or g == 0 or n == 0:
        return None
    areas = 898
    x = permute(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1, areas * 99 * 9999, key, b"ssn")
    x, n = divmod(x, 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{n + 1:04d}"


def country_code(digits: str) -> str:
    """The country code at the head of an international number, by the zones of E.164: one digit, one of the two-digit codes, or three digits."""
    return digits[:1] if digits[:1] in ("1", "7") else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


def phone(s: str, key: bytes) -> str | None:
    """The country code stays and the national number moves, whatever parts them.

    A code follows ``+`` or ``00``; ten digits without one, or behind a 1, have code 1. A 0 in
    brackets behind the code is no part of the number and stays. A number of
    code 1 has ten digits, others 7 to 15 with their code. Numbers that code 1
    could assign (area and exchange from 2 on) become such numbers, and others
    keep whether they begin with a 0: the permutation is walked until they do.
    """
    d = _digits(s)
    head = 0 if s[0] == "+" else 2 if s.startswith("00") else None
    if head is not None:
        code = country_code(d[head:])
        skip = head + len(code)
    else:
        code, skip = "1", int(len(d) == 11)
    at = 0
    while skip:
        skip -= s[at].isdigit()
        at += 1
    if trunk := re.match(r"[ .-]?\(0\)", s[at:]):
        at += trunk.end()
    number = _digits(s[at:])
    if (len(number) != 10) if code == "1" else (len(number) < 4 or not 7 <= len(code) + len(number) <= 15):
        return None
    form = (lambda x: x[0] in "23456789" and x[3] in "23456789") if code == "1" else (lambda x: x[0] == "0")
    moved = _move(number, key, f"phone+{code}")
    while form(moved) != form(number):
        moved = _move(moved, key, f"phone+{code}")
    return s[:at] + _refill(s[at:], moved)


def ip(s: str, key: bytes) -> str | None:
    """Four octets up to 255, none with a leading zero, stay such."""
    parts = s.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def date(s: str, key: bytes) -> str | None:
    """A real day from 1900 to 2099, year first, or last with day or month first, moves to another such day.

    Parts keep their order and the padding of the original. Equal days in
    different notations stay equal days.
    """
    sep = re.search(r"\D", s)[0]
    p = s.split(sep)
    try:
        if len(p[0]) == 4:
            order, (y, m, d) = "ymd", map(int, p)
        else:
            a, b, y = map(int, p)
            order = "mdy" if sep == "/" and a <= 12 else "dmy"
            d, m = (b, a) if order == "mdy" else (a, b)
        day = dt.date(y, m, d).toordinal()
    except ValueError:
        return None
    if not DAY_ONE <= day <= DAY_LAST:
        return None
    size = DAY_LAST - DAY_ONE + 1
    new = dt.date.fromordinal(DAY_ONE + permute(day - DAY_ONE, size, key, b"date"))
    part = {"y": f"{new.year:04d}", "m": new.month, "d": new.day}
    padded = any(len(x) == 2 and x[0] == "0" for x in p) or all(len(x) != 1 for x in p)
    return sep.join(part[o] if o == "y" else f"{part[o]:02d}" if padded else str(part[o]) for o in order)


def iban(s: str, key: bytes) -> str | None:
    """Right length for the country and a right check number; letters stay letters, digits digits."""
    flat = s.replace(" ", "")
    if IBAN_LENGTHS.get(flat[:2]) != len(flat):
        return None
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = characters(flat[4:], key, "iban" + flat[:2])
    check = 98 - number(body + flat[:2] + "00") % 97
    it = iter(flat[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(it) for c in s)


_CLASSES = {c: k for k in (("0", 10), ("a", 26), ("A", 26)) for c in map(chr, range(ord(k[0]), ord(k[0]) + k[1]))}


def _block(s: str, key: bytes, tweak: bytes) -> str:
    """Letters and digits of a short string, moved together."""
    x, size = 0, 1
    for c in s:
        if k := _CLASSES.get(c):
            x, size = x * k[1] + ord(c) - ord(k[0]), size * k[1]
    x = permute(x, size, key, tweak)
    out = []
    for c in reversed(s):
        if k := _CLASSES.get(c):
            x, r = divmod(x, k[1])
            c = chr(ord(k[0]) + r)
        out.append(c)
    return "".join(reversed(out))


def characters(s: str, key: bytes, tweak: str) -> str:
    """Digits, small and capital ASCII letters move together, each within its class; others stay.

    A long string moves in blocks, from left to right and back again; what has
    moved before enters the next block's tweak, so all of it depends on all of
    it, is still a permutation, and takes time in proportion to its length.
    """
    shape = hashlib.blake2b("".join(_CLASSES[c][0] if c in _CLASSES else c for c in s).encode("utf-8", "replace"), digest_size=16).digest()
    tweak = f"{tweak}|".encode("utf-8", "replace") + shape
    if len(s) <= BLOCK:
        return _block(s, key, tweak)
    parts = [s[i : i + BLOCK] for i in range(0, len(s), BLOCK)]
    for way, order in ((b">", range(len(parts))), (b"<", range(len(parts) - 1, -1, -1))):
        seen = hashlib.blake2b(way + tweak, key=key, digest_size=16)
        for i in order:
            parts[i] = _block(parts[i], key, seen.copy().digest())
            seen.update(parts[i].encode("utf-8", "replace"))
    return "".join(parts)


def email(s: str, key: bytes) -> str | None:
    """The part before the @ moves and the domain stays, so addresses of one domain stay together; capitals stay where they are and make no other address."""
    local, _, domain = s.partition("@")
    moved = characters(local.translate(_SMALL), key, "email" + domain.translate(_SMALL))
    return "".join(c.upper() if "A" <= o <= "Z" else c for c, o in zip(moved, local, strict=True)) + "@" + domain


def secret(s: str, key: bytes) -> str | None:
    """Hexadecimal digits, 32 or more, or 16 or more after a sign of assignment, that hold both letters and digits; access keys."""
    if s.isdigit() or s.isalpha():
        return None
    if s.startswith("AKIA"):
        return "AKIA" + characters(s[4:], key, "access key")
    x = permute(int(s, 16), 16 ** len(s), key, b"secret%d" % len(s))
    return f"{x:0{len(s)}{'X' if s.upper() == s else 'x'}}"


_MAKE = {"email": email, "secret": secret, "iban": iban, "card": card, "ssn": ssn, "phone": phone, "ip": ip, "date": date}


@lru_cache(maxsize=50_000)
def _kept(kind: str, value: str, key: bytes) -> str | None:
    return _MAKE[kind](value, key)


def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of a value, or None if it isn't a valid one of its kind."""
    return _kept(kind, value, key) if len(value) <= LONGEST_KEPT else _MAKE[kind](value, key)


_HINT = re.compile(r"[0-9@]")
_LONG_HEX = re.compile(r"[0-9a-fA-F]{32}|[=:][0-9a-f]{16}|AKIA")


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, pseudonym`` of every valid value of a text, in order and without overlap."""
    if not _HINT.search(text):
        return []
    found = []
    if "@" in text:
        at = -1
        while (at := text.find("@", at + 1)) >= 0:  # from each @ back over its local part, so that words are not tried one by one
            start = at
            while start and (text[start - 1].isalnum() or text[start - 1] in "._+-"):
                start -= 1
            while start < at and text[start] in ".+-":
                start += 1
            if start < at and (m := EMAIL.match(text, start)):
                found.append((m.start(), m.end(), "email", m[0]))
    if _LONG_HEX.search(text):
        found += [(m.start(), m.end(), "secret", m[0]) for m in SECRET.finditer(text)]
    found += [(m.start(), m.end(), "iban", m[0]) for m in IBAN.finditer(text)]
    found += [(m.start(), m.end(), m.lastgroup, m[0]) for m in NUMBER.finditer(text)]
    found.sort(key=lambda m: (KINDS.index(m[2]), m[0]))
    taken: list[tuple[int, int, str, str]] = []
    for start, end, kind, value in found:
        at = bisect_left(taken, (start,))
        if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
            continue
        new = pseudonym(kind, value, key)
        if new is not None:
            taken.insert(at, (start, end, kind, new))
    return taken


def replaced(text: str, key: bytes) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds of what was replaced."""
    parts, at, kinds = [], 0, []
    for start, end, kind, new in find(text, key):
        parts += [text[at:start], new]
        at = end
        kinds.append(kind)
    return ("".join([*parts, text[at:]]), kinds) if kinds else (text, kinds)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal values replaced in ``text_col``, and ``pii_kinds`` (array of string, one for each value).

    Values: e-mail addresses, hexadecimal secrets, IBANs, card numbers, US
    social security numbers, telephone numbers, IPv4 addresses and dates, each
    only if it is valid of its kind (see the function of that name). A value
    maps to the same pseudonym in every row, so links stay; the mapping is a
    permutation, so different values stay apart. A null text stays null and has
    no kinds; texts without values stay as they are; repeated rows stay. An
    older column ``pii_kinds`` is replaced. Who knows ``key`` can reverse the
    mapping, so there is no default, and an empty one raises an error.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    secret_key = hashlib.sha256(key.encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            pairs = [(None, []) if (s := t.as_py()) is None else replaced(s, secret_key) for t in batch.column(at)]
            columns = [pa.array([x for x, _ in pairs], batch.column(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([k for _, k in pairs], pa.list_(pa.string()))], [*batch.schema.names, "pii_kinds"])

    docs = docs.drop("pii_kinds")
    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("array<string>").alias("pii_kinds")).schema)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Every document with its text under pseudonyms, the number of values and their kinds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = pseudonymise(docs, QUERY_KEY)
    return found.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_values"), F.array_join(F.array_sort(F.array_distinct("pii_kinds")), ",").alias("kinds"))
