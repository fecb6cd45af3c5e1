"""Personal data: validated numbers, dates and addresses become keyed, format-preserving Feistel pseudonyms."""

from __future__ import annotations

import bisect
import datetime as dt
import functools
import hashlib
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causetrace.llm.common import fresh, map_text

#: Used when no key is given; pass a secret of your own in production.
DEMO_KEY = b"causetrace demonstration key"
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()

#: How each kind is written.
KINDS = {
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
    "isodate": r"(?<![0-9])(?<![0-9][./-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|[./-][0-9])",
    "dmydate": r"(?<![0-9])(?<![0-9][./-])[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9])(?<![0-9][./-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
    r"|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])(?<![0-9][./-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]|[./-][0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
SINGLE = {k: re.compile(p) for k, p in KINDS.items()}
#: Fewest characters of the kinds that are tried at shorter ends when the check fails.
LEAST = {"iban": 15, "card": 13}
DOMAIN = re.compile(r"@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: The longest local part of an address (RFC 5321).
LOCAL_CHARS = 64
#: Every kind has a digit or an @ near its start; only the places around them are looked at.
SPARK = re.compile(r"[0-9@]")
DIGITS = re.compile(r"[0-9]+")


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1: eight Feistel rounds over two halves, walked until inside the range."""
    if size < 2:
        return x
    half = math.isqrt(size - 1) + 1
    width = half.bit_length() // 8 + 9  # bytes of a round's output: 64 bits more than the half, so that every part of it changes
    while True:
        left, right = divmod(x, half)
        for r in range(8):
            left, right = right, (left + _round(f"{tweak}|{size}|{r}|{right}".encode(), key, width)) % half
        x = left * half + right
        if x < size:
            return x


def _round(message: bytes, key: bytes, width: int) -> int:
    """A keyed digest of ``width`` bytes, from as many blocks as it takes."""
    blocks = [hashlib.blake2b(b"%d|%b" % (k, message), key=key[:64], digest_size=64).digest() for k in range(-(-width // 64))]
    return int.from_bytes(b"".join(blocks)[:width], "big")


@functools.cache
def _late_days() -> list[int]:
    """The days of the range that fall after the 12th of a month, in order."""
    return [k for k in range(DAYS) if dt.date.fromordinal(FIRST_DAY + k).day > 12]


def digits_in_place(value: str, new: str) -> str:
    """``value`` with its digits replaced one by one, all other characters as they are."""
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in value)


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` followed by it valid."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _numbers(digits: str, key: bytes, tweak: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{tweak}{len(digits)}")).zfill(len(digits))


def _day(y: int, m: int, d: int) -> int | None:
    try:
        at = dt.date(y, m, d).toordinal() - FIRST_DAY
    except ValueError:
        return None
    return at if 0 <= at < DAYS else None


def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym in the same format, or None if the value isn't valid for its kind."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "card":
        if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        body = _numbers(digits[:-1], key, kind)
        return digits_in_place(value, body + str(luhn(body)))
    if kind == "phone":
        lead = re.match(r"\+[0-9]{1,3}(?=[ .(-])", value)
        fixed = len(lead[0]) - 1 if lead else 0
        if not 7 <= len(digits) - fixed <= 12:
            return None
        return digits_in_place(value, digits[:fixed] + _numbers(digits[fixed:], key, kind))
    if kind == "ssn":
        if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000":
            return None
        areas = [a for a in range(1, 900) if a != 666]
        k = (areas.index(int(digits[:3])) * 99 + int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1
        rest, serial = divmod(permute(k, len(areas) * 99 * 9999, key, kind), 9999)
        area, group = divmod(rest, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "ip":
        octets = [int(o) for o in value.split(".")]
        if max(octets) > 255 or any(len(o) > 1 and o[0] == "0" for o in value.split(".")):
            return None
        n = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, kind)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "isodate":
        at = _day(*map(int, value.split("-")))
        return None if at is None else dt.date.fromordinal(FIRST_DAY + permute(at, DAYS, key, "date")).isoformat()
    if kind == "dmydate":
        a, sep, b, sep2, y = re.split(r"([./])", value)
        at = _day(int(y), int(b), int(a))
        swap = at is None and sep == "/"
        at = _day(int(y), int(a), int(b)) if swap else at
        if at is None or sep != sep2:
            return None
        if swap:  # month first shows by a day over 12, and does so in the pseudonym, which no day-first date can equal then
            late = _late_days()
            new = dt.date.fromordinal(FIRST_DAY + late[permute(bisect.bisect_left(late, at), len(late), key, "late date")])
        else:
            new = dt.date.fromordinal(FIRST_DAY + permute(at, DAYS, key, "date"))
        first, second = (new.month, new.day) if swap else (new.day, new.month)
        return f"{first:0{len(a)}d}{sep}{second:0{len(b)}d}{sep}{new.year}"
    if kind == "iban":
        flat = value.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
            return None
        body = _letters(flat[4:], key, f"iban{flat[:2]}")
        check = 98 - number(body + flat[:2] + "00") % 97
        it = iter(flat[:2] + f"{check:02d}" + body)
        return "".join(c if c == " " else next(it) for c in value)
    local, _, domain = value.partition("@")
    return _letters(local, key, f"email{domain.lower()}") + "@" + domain


def _letters(s: str, key: bytes, tweak: str) -> str:
    """Permute the letters and digits of ``s`` as one mixed-radix number; case and punctuation stay."""
    kinds = [(ord("0"), 10) if c.isdigit() else (ord("A"), 26) if c.isupper() else (ord("a"), 26) if c.isalpha() else (ord(c), 1) for c in s]
    value, size = 0, 1
    for c, (first, n) in zip(s, kinds, strict=True):
        value, size = value * n + ord(c) - first, size * n
    value = permute(value, size, key, f"{tweak}{[(first, n) for first, n in kinds]}")
    out = []
    for first, n in reversed(kinds):
        value, r = divmod(value, n)
        out.append(chr(first + r))
    return "".join(reversed(out))


def pseudonymise_text(text: str, key: bytes, memo: dict) -> tuple[str, list[str]]:
    """The text with pseudonyms in place, and the kinds replaced in order."""
    kinds: list[str] = []
    out: list[str] = []
    done = at = 0
    while spark := SPARK.search(text, at):
        i = spark.start()
        new = None
        for kind, start, end in _candidates(text, i, done):
            value = text[start:end]
            new = memo.get((kind, value), "")
            if new == "":
                if len(memo) > 200_000:
                    memo.clear()
                new = memo[kind, value] = pseudonym(kind, value, key)
            if new is not None:
                break
        if new is None:
            at = i + 1 if text[i] == "@" else DIGITS.match(text, i).end()
            continue
        kinds.append(kind)
        out += (text[done:start], new)
        done = at = end
    return ("".join(out) + text[done:] if kinds else text), kinds


def _candidates(text: str, i: int, done: int) -> Iterator[tuple[str, int, int]]:
    """The kinds and places of what may begin with the first digit or @ at ``i``, best first; nothing before ``done`` is touched."""
    start = i
    m = DOMAIN.match(text, i)
    if not m and text[i] != "@":
        end = i
        while end < len(text) and end - i <= LOCAL_CHARS and text[end] in LOCAL:
            end += 1
        m = DOMAIN.match(text, end)
    if m:
        while start > done and i - start <= LOCAL_CHARS and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start() <= start + LOCAL_CHARS:
            yield "email", start, m.end()
    for start in range(max(done, i - 2), i + 1):
        m = PATTERN.match(text, start)
        if m:
            yield from _ends(m.lastgroup, m)
            for kind, pattern in SINGLE.items():
                if kind != m.lastgroup and (other := pattern.match(text, start)):
                    yield from _ends(kind, other)


def _ends(kind: str, m: re.Match) -> Iterator[tuple[str, int, int]]:
    """A match, then for cards and IBANs its beginnings up to each separator, longest first."""
    yield kind, m.start(), m.end()
    if kind in LEAST:
        value = m[0]
        for at in range(len(value) - 1, 0, -1):
            if value[at] in " -" and sum(c.isalnum() for c in value[:at]) >= LEAST[kind]:
                yield kind, m.start(), m.start() + at


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """Every row of ``docs`` with pseudonyms in ``text``, plus ``pii_kinds`` (array, in order of appearance).

    Equal values of a kind get equal pseudonyms in every document, under one key, so records stay
    linked; cards and IBANs stay checksum-valid, dates stay valid dates between 1900 and 2099. Null texts stay
    null. Values that fail their check (Luhn, mod 97, octets, calendar) remain as they are. All columns
    pass through; there is no shuffle.
    """

    new = fresh(docs, "__new")

    def make():
        memo: dict = {}

        def f(texts: list) -> dict[str, list]:
            got = [(None, []) if t is None else pseudonymise_text(t, key, memo) for t in texts]
            return {new: [g[0] for g in got], "pii_kinds": [g[1] for g in got]}

        return f

    rest = tuple(c for c in docs.columns if c not in ("text", "pii_kinds"))
    out = map_text(docs, make, f"{new} string, pii_kinds array<string>", keep=rest)
    return out.select(*[F.col(new).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "pii_kinds"], "pii_kinds")


def report(docs: DataFrame) -> DataFrame:
    """Per document the pseudonymised text, how many values were replaced, and their kinds; one row for each row of ``docs``, a null text stays null with none replaced."""
    return pseudonymise(docs).select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_replaced"), F.array_sort(F.array_distinct("pii_kinds")).alias("kinds"))
