"""PII: format-preserving Feistel pseudonyms, so that equal values stay linked across documents.

Found: card numbers (13 to 19 digits, Luhn), IBANs (mod 97), US social security numbers, phone numbers, IPv4 addresses,
dates (calendar days of 1900 to 2099: year first, month/day/year, day.month.year and day-month-year, with the other order of
day and month where that one is no date, days and months of one or two digits), e-mail addresses and hex secrets of 32 digits or more.  Each is
a number below the size of its format's domain, and a keyed Feistel network with cycle walking permutes that domain:
digits stay digits, letters letters of their kind, separators stay, check digits are made valid again, a date becomes
another date of its format.  The permutation depends on the key and the kind alone, so a value's pseudonym is the same
wherever it stands (a card number with and without separators too), and the key's holder can undo it.  Dates with a part of one digit and
dates in the other order are formats of their own, each permuted within itself.  A card number may stand among other
groups of digits: where the whole is none, runs of whole groups that pass the check are taken, first those grouped like
cards with an issuer's first digits, then the longest; these are undone by the places that ``finds`` gives.

Defined cases: an empty table gives an empty result; null text stays null with no finds; text without finds stays as it
is; of overlapping finds the first, then the first kind in the order above counts, but a
phone number does not run into a card number.  Added columns (replacing those of
these names): ``clean_text`` and ``finds`` (kind, start, length in code points of the text, pseudonym).
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KEY = b"replace-this-key"
ROUNDS = 10
CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])),
           "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))]
CLASS = {c: k for k in CLASSES for c in k}
DAY0, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
CARD_SHAPES = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 4, 1), (6, 13)}
ISSUER = re.compile(r"2[2-7]|3|4|5|6")
ADDED = ["clean_text", "finds"]
FINDS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("pseudonym", pa.string())]))
SCHEMA = "clean_text string, finds array<struct<kind:string,start:int,length:int,pseudonym:string>>"


def keyed(key: bytes, tweak: str, turn: int, x: int, below: int) -> int:
    size = (below.bit_length() + 7) // 8 + 8
    raw = x.to_bytes((x.bit_length() + 7) // 8 or 1, "big")
    out, k = b"", 0
    while len(out) < size:
        out += hashlib.blake2b(b"%s|%d|%d|" % (tweak.encode(), turn, k) + raw, key=key[:64]).digest()
        k += 1
    return int.from_bytes(out[:size], "big") % below


def permute(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """The keyed permutation of 0 to size - 1 (or its inverse): Feistel over a x b >= size, walked until below size."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    tweak = f"{tweak}|{size}"
    while True:
        left, right = divmod(x, b)
        for turn in range(ROUNDS):
            turn = ROUNDS - 1 - turn if back else turn
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * keyed(key, tweak, turn, left, b)) % b
            else:
                left = (left + sign * keyed(key, tweak, turn, right, a)) % a
        x = left * b + right
        if x < size:
            return x


def spelled(value: str, key: bytes, kind: str, back: bool = False) -> str:
    """Permute the letters and digits of ``value`` within their classes; other characters stay."""
    x, size = 0, 1
    for c in value:
        if c in CLASS:
            x, size = x * len(CLASS[c]) + CLASS[c].index(c), size * len(CLASS[c])
    y, out = permute(x, size, key, f"{kind}|" + "".join(str(CLASSES.index(CLASS[c])) for c in value if c in CLASS), back), []
    for c in reversed(value):
        if c in CLASS:
            y, k = divmod(y, len(CLASS[c]))
            c = CLASS[c][k]
        out.append(c)
    return "".join(reversed(out))


def fill(shape: str, digits: str) -> str:
    """``shape`` with its letters and digits replaced by ``digits`` in order."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def card(m: str, key: bytes, back: bool = False) -> str | None:
    d = re.sub(r"\D", "", m)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = d[0] + spelled(d[1:-1], key, "card", back)
    return fill(m, body + luhn_digit(body))


def cards_within(m: str, key: bytes, back: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, pseudonym) of runs of whole digit groups in ``m`` that are card numbers and do not overlap."""
    groups, found = [g.span() for g in re.finditer(r"\d+", m)], []
    for i in range(len(groups)):
        digits = ""
        for j in range(i, len(groups)):
            digits += m[slice(*groups[j])]
            if len(digits) > 19:
                break
            if len(digits) >= 13 and luhn_digit(digits[:-1]) == digits[-1]:
                shape = tuple(b - a for a, b in groups[i:j + 1])
                found.append((not (shape in CARD_SHAPES or i == j) or not ISSUER.match(digits), -len(digits), groups[i][0], groups[j][1]))
    out: list[tuple[int, int, str]] = []
    taken = [False] * len(m)
    for _, _, start, end in sorted(found):
        if not any(taken[start:end]) and (other := card(m[start:end], key, back)) is not None:
            taken[start:end] = [True] * (end - start)
            out.append((start, end, other))
    return out


def iban_digits(country: str, body: str) -> str:
    n = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - n % 97:02d}"


def iban(m: str, key: bytes, back: bool = False) -> str | None:
    v = m.replace(" ", "")
    if not 15 <= len(v) <= 34 or iban_digits(v[:2], v[4:]) != v[2:4]:
        return None
    body = spelled(v[4:], key, "iban", back)
    return fill(m, v[:2] + iban_digits(v[:2], body) + body)


def ssn(m: str, key: bytes, back: bool = False) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    d = re.sub(r"\D", "", m)
    if not valid(d):
        return None
    while True:
        d = spelled(d, key, "ssn", back)
        if valid(d):
            return fill(m, d)


def phone(m: str, key: bytes, back: bool = False) -> str | None:
    d = re.sub(r"\D", "", m)
    if not 10 <= len(d) <= 15:
        return None
    lead = len(re.match(r"\+?(\d*)", m)[1]) if m[0] == "+" and re.match(r"\+\d{1,3}\D", m) else 0
    return fill(m, d[:lead] + spelled(d[lead:], key, "phone", back))


def ip(m: str, key: bytes, back: bool = False) -> str | None:
    octets = m.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    x = permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


@functools.cache
def days(one_month: bool, one_day: bool, other: bool) -> list[int]:
    """The calendar days that a format can write: parts of one digit; ``other``: days that the usual order cannot mean."""
    each = (datetime.date.fromordinal(DAY0 + i) for i in range(DAYS))
    return [d.toordinal() for d in each if (d.month < 10 or not one_month) and (d.day < 10 or not one_day) and (d.day > 12 or not other)]


def date(m: str, key: bytes, back: bool = False) -> str | None:
    parts = re.split(r"([-/.])", m)
    if parts[1] != parts[3]:
        return None
    first = "Ymd" if len(parts[0]) == 4 else "mdY" if parts[1] == "/" else "dmY"
    for other, order in enumerate([first] if first[0] == "Y" else [first, first[1::-1] + "Y"]):
        at = dict(zip(order, parts[::2]))
        try:
            day = datetime.date(int(at["Y"]), int(at["m"]), int(at["d"])).toordinal()
        except ValueError:
            continue
        form = (len(at["m"]) == 1, len(at["d"]) == 1, bool(other))
        among = days(*form)
        x = bisect.bisect_left(among, day)
        if x == len(among) or among[x] != day:
            return None
        new = datetime.date.fromordinal(among[permute(x, len(among), key, "date" if not any(form) else "date|" + "".join("01"[f] for f in form), back)])
        text = {"Y": f"{new.year}", "m": f"{new.month:0{len(at['m'])}d}", "d": f"{new.day:0{len(at['d'])}d}"}
        return parts[1].join(text[c] for c in order)
    return None


def email(m: str, key: bytes, back: bool = False) -> str | None:
    name, _, host = m.rpartition("@")
    return f"{spelled(name, key, 'email', back)}@{host}"


def secret(m: str, key: bytes, back: bool = False) -> str | None:
    if m.isdigit() or m.isalpha():
        return None
    low = m == m.lower()
    x = permute(int(m, 16), 16 ** len(m), key, f"hex{len(m)}", back)
    out = f"{x:0{len(m)}x}"
    return out if low else out.upper()


KINDS: list[tuple[str, str, Callable[..., str | None]]] = [
    ("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,}(?!\w)", card),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    ("date", r"(?<![\w./-])(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?![\w/-])", date),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", ip),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?!\w)", phone),
    ("email", r"[^\W_](?:[\w.+%-]*[\w])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", email),
    ("secret", r"(?<![\w])[0-9a-f]{32,}(?!\w)|(?<![\w])[0-9A-F]{32,}(?!\w)", secret),
]
PATTERNS = [(kind, re.compile(pattern), make) for kind, pattern, make in KINDS]
LIKELY = re.compile(r"[0-9@]")


def pseudonymise(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, list[dict]]:
    """The text with pseudonyms in place of the finds, and the finds."""
    if not LIKELY.search(text):
        return text, []
    found, left = [], text
    for rank, (kind, pattern, make) in enumerate(PATTERNS):
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(left if kind == "phone" else text):
            other = make(m[0], key, back)
            if other is not None:
                found.append((m.start(), rank, m.end(), kind, other))
            elif kind == "card":  # among other digits
                found += [(m.start() + a, rank, m.start() + b, kind, o) for a, b, o in cards_within(m[0], key, back)]
        if kind == "ip" and any(f[3] == "card" for f in found):  # no phone number begins before a card number and ends in it
            bare, at = [], 0
            for start, _, end, found_kind, _ in apart(found):
                if found_kind == "card":
                    bare += [text[at:start], "\0" * (end - start)]
                    at = end
            left = "".join([*bare, text[at:]])
    out, finds, at = [], [], 0
    for start, _, end, kind, other in apart(found):
        out += [text[at:start], other]
        finds.append({"kind": kind, "start": start, "length": end - start, "pseudonym": other})
        at = end
    return "".join([*out, text[at:]]), finds


def apart(found: list[tuple]) -> list[tuple]:
    """The finds that stay where they overlap: the first, then the first kind."""
    out, at = [], 0
    for f in sorted(found):
        if f[0] >= at:
            out.append(f)
            at = f[2]
    return out


def pseudonyms(df: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """``df`` with ``clean_text`` and ``finds``."""
    df = df.drop(*ADDED)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, []) if t is None else pseudonymise(t, key) for t in batch[text_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], FINDS)], [*batch.schema.names, *ADDED])
    return df.mapInArrow(run, f"{head}, {SCHEMA}")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonyms(docs.select("doc_id", "text")).drop("text").withColumnRenamed("clean_text", "text")
