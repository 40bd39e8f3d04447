"""Operator 9: format-preserving pseudonyms of personal numbers and dates by a keyed Feistel network.

A found value is validated (checksums, ranges, calendars), read as a number of its format's domain,
permuted there under a key, and written back in the same format: card numbers keep a valid check
digit, telephone numbers their country code and punctuation, dates their notation and field widths.
A permutation keeps equal values equal in whatever notation, so they stay linked across documents, and
different ones different. Dates move among those whose day and month have as many digits and whose day
is as clearly no month (above 12 or not), so every notation can express the image of every day. Names
before @ in mail addresses (capitals fall where they were, so spellings of a name stay linked) and
hexadecimal secrets are permuted as digits of their alphabet. The key is an argument; nothing here has one.

Edge cases: a null text stays null; numbers that fail their check stay as they are, and what they hold is
looked at by itself; an IBAN that swallowed the words after it is tried without them, and a telephone number in groups
ends where its country's numbers do or another value begins; longer dotted numbers hold no address; texts, names and secrets of any length are read
whole; of overlapping finds the one that begins first wins, then the first kind in KINDS order; repeated
rows change alike; an empty table gives no rows; all other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanforge.llm import common

KINDS = ("email", "ip", "date", "phone", "ssn", "card", "iban", "secret")
ROUNDS = 8
FIRST_YEAR, LAST_YEAR = 1900, 2099
#: The country codes of one and two digits; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
              "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
#: Digits of national numbers (without trunk 0) by country code, least and most; codes that are not listed may have any length.
NATIONAL = {"1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (8, 11), "40": (9, 9), "41": (9, 9),
            "43": (7, 13), "44": (9, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (7, 11), "51": (8, 9), "52": (10, 10), "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (10, 10),
            "60": (8, 10), "61": (9, 9), "62": (8, 12), "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10),
            "351": (9, 9), "352": (6, 9), "353": (7, 9), "354": (7, 7), "358": (6, 10), "359": (8, 9), "370": (8, 8), "371": (8, 8), "372": (7, 8), "380": (9, 9), "385": (8, 9), "386": (8, 8),
            "420": (9, 9), "421": (9, 9), "852": (8, 8), "853": (8, 8), "886": (8, 9), "966": (9, 9), "971": (8, 9), "972": (8, 9)}
#: Characters of a name or secret that are permuted together.
PART = 64
_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"

_END = r"(?![^\W_])"
NUMBERS = re.compile(
    r"(?<![\w@])(?:"
    rf"(?P<ip>\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}})(?!\.?\d){_END}"
    rf"|(?P<date>\d{{4}}(?P<d1>[-/.])\d{{2}}(?P=d1)\d{{2}}|\d{{1,2}}(?P<d2>[-/.])\d{{1,2}}(?P=d2)\d{{4}})(?![-/.]?\d)(?:(?=T\d)|{_END})"
    rf"|(?P<phone>(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{3}}\) ?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}|\+\d{{8,15}}|\+\d{{1,5}}(?:[ .-](?:\(\d{{1,4}}\) ?)?\d{{1,10}}){{1,5}})(?![-./]?\d)(?:(?=(?i:x|ext)\.?\d)|{_END})"
    rf"|(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}})(?![-.]?\d){_END}"
    rf"|(?P<card>\d{{13,19}}|\d{{4}}(?P<c1>[ -])\d{{4}}(?P=c1)\d{{4}}(?P=c1)\d{{1,7}}|\d{{4}}(?P<c2>[ -])\d{{6}}(?P=c2)\d{{5}})(?![-.]?\d){_END}"
    r")|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
)
_KIND = {NUMBERS.groupindex[k]: k for k in KINDS if k in NUMBERS.groupindex}
SECRET = re.compile(r"(?i)(?:token|secret|key|password|passwd)[\"']?\s*[:=]\s*[\"']?(?P<v>[0-9a-f]{16,})(?![0-9a-z])")
_DIGIT, _GAP = re.compile(r"\d"), re.compile(r"(?<=\d) (?=\d)")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")


def permute(x: int, n: int, key: bytes, use: str) -> int:
    """A keyed permutation of 0 .. n - 1: a Feistel network over a grid of n cells or a few more, walked until inside."""
    if n < 2:
        return x
    a = int(n**0.5) if n < 1 << 50 else 1 << (n.bit_length() // 2)
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for r in range(ROUNDS):
            if r % 2:
                right = (right + _mixed(key, use, n, r, left)) % b
            else:
                left = (left + _mixed(key, use, n, r, right)) % a
        x = left * b + right
        if x < n:
            return x


def _mixed(key: bytes, use: str, n: int, r: int, v: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{use}|{n:x}|{r}|{v:x}".encode(), key=key[:64], digest_size=32).digest(), "big")


def _walk(digits: str, key: bytes, use: str, valid) -> str:
    """Permutes digit strings of one length until one is valid again, which permutes the valid ones."""
    n, x = len(digits), int(digits)
    while True:
        x = permute(x, 10**n, key, use)
        if valid(s := f"{x:0{n}d}"):
            return s


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _only_digits(s: str) -> str:
    return "".join(filter(str.isdigit, s))


def _card(s: str, key: bytes) -> str | None:
    d = _only_digits(s)
    if not d.isascii() or not 13 <= len(d) <= 19 or not luhn(d) or not int(d):
        return None
    body = _walk(d[:-1], key, "card", lambda x: int(x) > 0)
    return _refill(s, body + next(c for c in _DIGITS if luhn(body + c)))


def _phone(s: str, key: bytes) -> str | None:
    d = _only_digits(s)
    national = lambda x: x[0] > "1" and x[3] > "1"
    if len(d) == 10 and not s.startswith("+") or len(d) == 11 and d[0] == "1" and s.startswith("+1"):
        own, good = d[-10:], national(d[-10:])
        if not good and s[0] not in "+(":
            return None  # bare digits are a telephone number only if their prefixes exist
        # numbers with existing prefixes change among themselves, and so do the others
        return _refill(s, d[:-10] + _walk(own, key, "phone", lambda x: national(x) == good))
    trunk = "(0)" in s  # written, never dialled after a country code
    d = _only_digits(s.replace("(0)", "", 1))
    if not s.startswith("+") or not 8 <= len(d) <= 15:
        return None
    code = len(_country(d))
    own = d[:code] + _walk(d[code:], key, f"phone+{d[:code]}", lambda x: True)
    if not trunk:
        return _refill(s, own)
    at = s.index("(0)")
    before = len(_only_digits(s[:at]))
    return _refill(s[:at], own[:before]) + "(0)" + _refill(s[at + 3 :], own[before:])


def _country(digits: str) -> str:
    """The country code at the beginning of an international number."""
    return digits[: 1 if digits[0] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3]


def _own_part(text: str, start: int, end: int, key: bytes) -> str:
    """An international number in groups without what only follows it.

    It may end where a space follows, at a length that its country has, or where there is no such place, at any
    valid length: at the first of these places where another valid value begins, else at the last.
    """
    value = text[start:end]
    cuts = [m.start() for m in _GAP.finditer(value)] + [len(value)]
    digits = {c: _only_digits(value[:c].replace("(0)", "", 1)) for c in cuts}
    fit = [c for c in cuts if 8 <= len(digits[c]) <= 15]
    low, high = NATIONAL.get(_country(digits[cuts[-1]]), (0, 15))
    known = [c for c in fit if low <= len(digits[c]) - len(_country(digits[c])) <= high]
    places = known or fit or cuts
    return value[: next((c for c in places if c < len(value) and _begins_other(text, start + c + 1, key)), places[-1])]


def _begins_other(text: str, at: int, key: bytes) -> bool:
    m = NUMBERS.match(text, at)
    return m is not None and (kind := _kind(m)) != "phone" and pseudonym(kind, m[kind], key) is not None


def _ssn(s: str, key: bytes) -> str | None:
    valid = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
    d = _only_digits(s)
    return _refill(s, _walk(d, key, "ssn", valid)) if valid(d) else None


def _ip(s: str, key: bytes) -> str | None:
    parts = [int(p) for p in s.split(".")]
    if max(parts) > 255 or parts[0] == 0:
        return None
    x = int.from_bytes(bytes(parts), "big")
    while True:
        x = permute(x, 1 << 32, key, "ip")
        if x >> 24:
            return ".".join(map(str, x.to_bytes(4, "big")))


def _class(day: date) -> tuple[bool, int]:
    return day.month > 9, (day.day > 9) + (day.day > 12)


@lru_cache(1)
def _days() -> dict[tuple[bool, int], list[date]]:
    """All days by the digits of their month and day, and whether the day could be a month."""
    out: dict[tuple[bool, int], list[date]] = {}
    for n in range(date(FIRST_YEAR, 1, 1).toordinal(), date(LAST_YEAR, 12, 31).toordinal() + 1):
        day = date.fromordinal(n)
        out.setdefault(_class(day), []).append(day)
    return out


def moved_day(day: date, key: bytes) -> date:
    """The day's image, of its own class."""
    own = _days()[_class(day)]
    return own[permute(bisect_left(own, day), len(own), key, f"date|{_class(day)}")]


def _date(s: str, key: bytes) -> str | None:
    mark = next(c for c in s if not c.isdigit())
    fields = s.split(mark)
    if len(fields[0]) == 4:
        order = (0, 1, 2)
    else:  # day first, unless only month first makes a date
        order = (2, 0, 1) if int(fields[1]) > 12 >= int(fields[0]) else (2, 1, 0)
    try:
        day = date(*(int(fields[k]) for k in order))
    except ValueError:
        return None
    if not FIRST_YEAR <= day.year <= LAST_YEAR:
        return None
    new = moved_day(day, key)
    for k, v in zip(order, (new.year, new.month, new.day), strict=True):
        fields[k] = f"{v:0{len(fields[k])}d}"
    return mark.join(fields)


def _iban(s: str, key: bytes) -> str | None:
    flat = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _alphabets(flat[4:], key, f"iban|{flat[:2]}")
    check = 98 - number(body + flat[:2] + "00") % 97
    it = iter(f"{flat[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in s)


def _alphabets(s: str, key: bytes, use: str) -> str:
    """Permutes a string among those with digits and letters in the same places; capitals stay where they are."""
    kinds = [_DIGITS if c in _DIGITS else _LETTERS if c.lower() in _LETTERS else "" for c in s]
    x, n = 0, 1
    for c, k in zip(s, kinds, strict=True):
        if k:
            x, n = x * len(k) + k.index(c.lower()), n * len(k)
    x = permute(x, n, key, f"{use}|{''.join(k[:1] or c for c, k in zip(s, kinds, strict=True))}")
    out = []
    for c, k in zip(reversed(s), reversed(kinds), strict=True):
        if k:
            x, i = divmod(x, len(k))
            c = k[i].upper() if c.isupper() else k[i]
        out.append(c)
    return "".join(reversed(out))


def _by_parts(s: str, key: bytes, use: str) -> str:
    """Permutes strings of any length, at a cost that grows with it: the first part under a digest of the others,
    each later one under a digest of the new ones before it. Each step can be undone, so it is a permutation."""
    parts = [s[k : k + PART] for k in range(0, len(s), PART)] or [""]
    if len(parts) == 1:
        return _alphabets(s, key, use)
    rest = hashlib.blake2b("".join(parts[1:]).lower().encode(), key=key[:64], digest_size=16).hexdigest()
    out = [_alphabets(parts[0], key, f"{use}|{len(s)}|{rest}")]
    seen = hashlib.blake2b(out[0].lower().encode(), key=key[:64], digest_size=16)
    for p in parts[1:]:
        out.append(_alphabets(p, key, f"{use}|{len(s)}|{seen.hexdigest()}"))
        seen.update(out[-1].lower().encode())
    return "".join(out)


def _secret(s: str, key: bytes) -> str:
    # hexadecimal digits, as numbers of one alphabet
    parts = [s[k : k + PART] for k in range(0, len(s), PART)]
    rest = hashlib.blake2b("".join(parts[1:]).lower().encode(), key=key[:64], digest_size=16).hexdigest() if len(parts) > 1 else ""
    out, seen = [], hashlib.blake2b(key=key[:64], digest_size=16)
    for k, p in enumerate(parts):
        x = permute(int(p, 16), 16 ** len(p), key, f"secret|{len(s)}|{rest if k == 0 else seen.hexdigest()}")
        out.append(f"{x:0{len(p)}x}")
        seen.update(out[-1].encode())
    new = "".join(out)
    return new.upper() if s.isupper() else new


_CHANGE = {"card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date, "iban": _iban, "secret": _secret}


@lru_cache(100_000)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The value's pseudonym, or None if it isn't valid."""
    return _by_parts(value, key, "email") if kind == "email" else _CHANGE[kind](value, key)


def _mails(text: str):
    at = text.find("@")
    while at >= 0:
        first = at
        while first and text[first - 1] in _NAME:
            first -= 1
        if first < at and _DOMAIN.match(text, at + 1):
            yield first, at, "email"
        at = text.find("@", at + 1)


def _kind(m: re.Match) -> str:
    return _KIND[m.lastindex] if m.lastindex in _KIND else next(k for k in KINDS if m.groupdict().get(k))


def _numbers(text: str, key: bytes):
    """Valid values; the search goes on behind what is taken, and inside what is not."""
    m = NUMBERS.search(text)
    while m:
        kind = _kind(m)
        start, end = m.span(kind)
        value = _own_part(text, start, end, key) if kind == "phone" and text[start] == "+" else text[start:end]
        # a longer dotted number, such as a version, holds no address or date
        dotted = kind in ("ip", "date") and "." in value and start > 1 and text[start - 1] == "." and (text[start - 2].isalnum() or text[start - 2] == "_")
        new = None if dotted else pseudonym(kind, value, key)
        while kind == "iban" and new is None and " " in value:
            value = value[: value.rindex(" ")]
            new = pseudonym(kind, value, key)
        if new is not None:
            yield start, start + len(value), kind, new
        m = NUMBERS.search(text, start + (1 if new is None else len(value)))


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of each valid value, overlapping ones too, in the order in which they win."""
    found = [(a, b, k, pseudonym(k, text[a:b], key)) for a, b, k in _mails(text)]
    if _DIGIT.search(text):  # every number has one
        found += _numbers(text, key)
    if "=" in text or ":" in text:  # every secret follows one
        found += [(m.start("v"), m.end("v"), "secret", pseudonym("secret", m["v"], key)) for m in SECRET.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def pseudonymised(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """(text with pseudonyms, how many of each kind)."""
    counts = dict.fromkeys(KINDS, 0)
    out, end = [], 0
    for a, b, kind, new in find(text, key):
        if a < end:
            continue
        out += [text[end:a], new]
        end = b
        counts[kind] += 1
    return ("".join([*out, text[end:]]) if out else text), counts


def pseudonymise(docs: DataFrame, key: bytes, counted: bool = False, column: str = "text") -> DataFrame:
    """The documents with pseudonyms in their text column; counted adds one long column n_<kind> per kind."""
    if not key:
        raise ValueError("pseudonyms need a key")
    at = docs.columns.index(column)
    fields = docs.schema[at].dataType.simpleString()
    if fields != "string":
        raise ValueError(f"{column} is {fields}, not string")

    def changed(batches):
        for batch in batches:
            texts, counts = [], {k: [] for k in KINDS}
            for t in batch.column(at).to_pylist():
                new, n = (None, dict.fromkeys(KINDS, 0)) if t is None else pseudonymised(t, key)
                texts.append(new)
                for k in KINDS:
                    counts[k].append(n[k])
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns)]
            names = batch.schema.names
            if counted:
                columns += [pa.array(counts[k], pa.int64()) for k in KINDS]
                names = [*names, *[f"n_{k}" for k in KINDS]]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType(list(docs.schema.fields))
    if counted:
        for k in KINDS:
            schema = schema.add(f"n_{k}", "long")
    return common.map_arrow(docs, changed, schema)
