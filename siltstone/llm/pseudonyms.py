"""Operator 9: private data to format-preserving pseudonyms.

A value found in a text is read as a number in the domain of its format (digits, letters by case, days of
a calendar, IPv4 addresses), permuted by a keyed Feistel network with cycle walking, and written back
in the layout it had.  The permutation depends on the key, the kind and the format alone, so equal
values get equal pseudonyms in every document, different ones stay different, and holders of the key
can invert it.  Values are validated first and only valid ones are replaced: card and account numbers
by their check digits (which the pseudonyms have too), dates by the calendar (1900 to 2099), social
security numbers by their areas, groups and serials, addresses by their range; a named secret must have
a digit, letters of both cases inside or 20 characters.  What a value means is permuted, not how it is
written: a date, a telephone number (ten digits are taken as +1), an e-mail name of any case or an
address links with itself in every layout.  E-mail domains and country codes stay.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from siltstone.sources.tables import load

from .storage import modest_batches

#: Where queries look for the key.  Without it they use one that is no secret, which suits synthetic tables alone.
KEY_SETTING, DEMONSTRATION_KEY = "spark.siltstone.pseudonyms.key", "siltstone demonstration key"
ROUNDS = 8
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
FOUND = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}")
_NUMBER = re.compile(
    rf"(?P<ip>(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9]))"
    r"|(?P<ymd>(?<![0-9./-])[0-9]{4}(?P<s1>[/.-])[0-9]{1,2}(?P=s1)[0-9]{1,2}(?![0-9]|[/.-][0-9]))"
    r"|(?P<dmy>(?<![0-9./-])[0-9]{1,2}(?P<s2>[/.-])[0-9]{1,2}(?P=s2)[0-9]{4}(?![0-9]|[/.-][0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))"
    r"|(?P<phone>(?<![0-9])\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,4}(?![0-9])"
    r"|(?<![0-9+(])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9]))"
    r"|(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]))"
)
_SECRET = re.compile(
    r"(?i)(?<![A-Za-z0-9])(?:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)\b[\"']?\s{0,3}(?:=|:)\s{0,3}(?:\"(?P<double>[^\"\s]{8,})\"|'(?P<single>[^'\s]{8,})'|(?P<value>[^\s\"'<>,;()]{7,}[A-Za-z0-9_+/~=!@#$%^&*-]))"
    r"|\b(?P<key>AKIA[0-9A-Z]{16}|(?:sk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])"
)
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]{1,34}[0-9A-Fa-f](?![0-9A-Za-z:])")
_SECRET_SIGNS = ("=", ":", "AKIA", "sk-", "sk_", "ghp_", "gho_", "xox")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})\b")
#: Where any of the number formats must lie.
_DIGITS = re.compile(r"[+(0-9][0-9 ()./+-]{6,}")


def feistel(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1 (its inverse if ``back``); the identity if size < 2."""
    if size < 2:
        return x
    half = ((size - 1).bit_length() + 1) // 2
    mask, n = (1 << half) - 1, (half + 7) // 8
    head = f"{tweak}|{size}|".encode()

    def f(k: int, v: int) -> int:
        h = hashlib.blake2b(head + bytes([k]) + v.to_bytes(n, "big"), key=key, digest_size=min(64, max(8, n)))
        out = h.digest()
        while len(out) < n:
            out += hashlib.blake2b(out, key=key).digest()
        return int.from_bytes(out[: max(8, n)], "big") & mask

    while True:
        left, right = x >> half, x & mask
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = (right ^ f(k, left), left) if back else (right, left ^ f(k, right))
        x = left << half | right
        if x < size:
            return x


#: Characters of a value that are permuted as one number; a longer value is permuted block by block.
LETTERS = 512


def letters(value: str, key: bytes, kind: str, back: bool = False) -> str:
    """Permute the letters and digits of a value; case, digits and all other characters stay in place.

    The blocks of a long value are chained: what a block becomes also depends on its place, the length
    and the pseudonym of the block before, so work is linear and equal values have one pseudonym.
    """
    if len(value) > LETTERS:
        out, before = [], ""
        for i in range(0, len(value), LETTERS):
            part = value[i : i + LETTERS]
            tweak = hashlib.blake2b(f"{i}|{len(value)}|{before}".encode(), digest_size=16).hexdigest()
            out.append(letters(part, key, f"{kind}|{tweak}", back))
            before = part if back else out[-1]
        return "".join(out)
    shape = "".join("9" if "0" <= c <= "9" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c for c in value)
    number, size, base = 0, 1, {"9": (10, 48), "a": (26, 97), "A": (26, 65)}
    kinds = [base.get(s) if s in base else None for s in shape]
    kinds = [k if (c.isascii() and c.isalnum()) else None for k, c in zip(kinds, value)]
    for c, k in zip(value, kinds):
        if k:
            number, size = number * k[0] + ord(c) - k[1], size * k[0]
    number, out = feistel(number, size, key, f"{kind}|{shape}", back), list(value)
    for i in range(len(value) - 1, -1, -1):
        if kinds[i]:
            number, r = divmod(number, kinds[i][0])
            out[i] = chr(r + kinds[i][1])
    return "".join(out)


def digits(value: str, key: bytes, kind: str, keep: int = 0, back: bool = False) -> str:
    """Permute the digits after the first ``keep`` ones as one number; the layout stays and does not matter."""
    d = [c for c in value if "0" <= c <= "9"]
    free = d[keep:]
    new = iter(d[:keep] + list(str(feistel(int("".join(free)), 10 ** len(free), key, f"{kind}|{''.join(d[:keep])}", back)).zfill(len(free))))
    return "".join(next(new) if "0" <= c <= "9" else c for c in value)


def luhn(d: str) -> int:
    """The check digit that d needs."""
    return -sum(int(c) if i % 2 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(d))) % 10


def _card(value: str, key: bytes, back: bool) -> str | None:
    d = re.sub("[^0-9]", "", value)
    if luhn(d[:-1]) != int(d[-1]):
        return None
    body = digits(d[:-1], key, "card", 0, back)
    new = iter(body + str(luhn(body)))
    return "".join(next(new) if "0" <= c <= "9" else c for c in value)


def valid_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(value: str, key: bytes, back: bool) -> str | None:
    """Walk on until the result is valid too."""
    if not valid_ssn(value.replace("-", "")):
        return None
    while True:
        value = digits(value, key, "ssn", 0, back)
        if valid_ssn(value.replace("-", "")):
            return value


def _phone(value: str, key: bytes, back: bool) -> str | None:
    """The digits behind the country code as one number, in whatever layout; a number has 7 to 15 digits."""
    d = re.sub("[^0-9]", "", value)
    if not 7 <= len(d) <= 15:
        return None
    lead = re.match(r"\+([0-9]{1,3})[ .(-]", value)
    code = lead[1] if lead else "1" if value[0] == "+" and len(d) == 11 and d[0] == "1" else ""
    rest = digits(d[len(code) :], key, "phone" + (code or "1" * (len(d) == 10)), 0, back)
    new = iter(code + rest)
    return "".join(next(new) if "0" <= c <= "9" else c for c in value)


def _email(value: str, key: bytes, back: bool) -> str:
    """Letters as if in lower case; capitals stay where they are."""
    local, at, domain = value.rpartition("@")
    new = letters(local.lower(), key, "email", back)
    return "".join(n.upper() if c.isupper() else n for c, n in zip(local, new)) + at + domain


def _secret(value: str, key: bytes, back: bool) -> str | None:
    inner = value[1:]
    if not (any(c.isdigit() for c in value) or inner.lower() != inner and inner.upper() != inner or len(value) >= 20):
        return None
    return letters(value, key, "secret", back)


def iban_rest(value: str) -> int:
    """An account number's remainder modulo 97, 1 if it is valid."""
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97


def _iban(value: str, key: bytes, back: bool) -> str:
    """Permute the account part; the country stays and the check digits follow."""
    v = value.replace(" ", "")
    body = letters(v[4:], key, f"iban{v[:2]}", back)
    new = iter(v[:2] + str(98 - iban_rest(v[:2] + "00" + body)).zfill(2) + body)
    return "".join(c if c == " " else next(new) for c in value)


def _ip(value: str, key: bytes, back: bool) -> str:
    x = 0
    for part in value.split("."):
        x = x << 8 | int(part)
    x = feistel(x, 1 << 32, key, "ip", back)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(value: str, key: bytes, back: bool) -> str | None:
    try:
        old = ipaddress.IPv6Address(value)
    except ValueError:
        return None
    if old.is_loopback or old.is_unspecified:
        return None
    x = int(old)
    while True:
        x = feistel(x, 1 << 128, key, "ipv6", back)
        if x > 1:
            return str(ipaddress.IPv6Address(x))


def _day(value: str, key: bytes, back: bool) -> str | None:
    """Dates as year-month-day, day-month-year or, where only that is a date, month-day-year; separators and padding stay.

    Days up to the twelfth are permuted among themselves and so are the others, so every layout stays
    readable as the order it had, and one permutation serves all.
    """
    sep = next(c for c in value if not "0" <= c <= "9")
    p = value.split(sep)
    for order in ((0, 1, 2),) if len(p[0]) == 4 else ((2, 1, 0), (2, 0, 1)):
        try:
            old = dt.date(*(int(p[i]) for i in order))
        except ValueError:
            continue
        new = old.toordinal()
        if FIRST_DAY <= new <= LAST_DAY:
            while True:
                new = feistel(new - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", back) + FIRST_DAY
                t = dt.date.fromordinal(new)
                if (t.day > 12) == (old.day > 12):
                    break
            out = [""] * 3
            for i, v in zip(order, (t.year, t.month, t.day)):
                out[i] = str(v).zfill(2 if len(p[i]) == 2 else 1) if i != order[0] else str(v).zfill(4)
            return sep.join(out)
    return None


@lru_cache(20_000)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The value's pseudonym, or with ``back`` the value of a pseudonym; None if it is no valid value."""
    kinds = {"email": _email, "iban": _iban, "ip": _ip, "ipv6": _ipv6, "ymd": _day, "dmy": _day, "card": _card, "phone": _phone, "ssn": _ssn, "secret": _secret}
    if kind in kinds:
        return kinds[kind](value, key, back)
    lead = re.match("AKIA|[A-Za-z]+[-_]", value)[0]
    return lead + letters(value[len(lead) :], key, f"key{lead}", back)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that look like private values, by start, longer ones first; they may overlap and be no valid values."""
    got = []
    if "@" in text:
        got += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
    if any(sign in text for sign in _SECRET_SIGNS):
        got += [(*m.span(m.lastgroup), "key" if m["key"] else "secret") for m in _SECRET.finditer(text)]
    if "::" in text or text.count(":") > 6:
        got += [(*m.span(), "ipv6") for m in _IPV6.finditer(text)]
    got += [(*m.span(), "iban") for m in _IBAN.finditer(text) if iban_rest(m[0]) == 1]
    for run in _DIGITS.finditer(text):
        got += [(*m.span(), next(k for k in ("ip", "ymd", "dmy", "ssn", "phone", "card") if m[k])) for m in _NUMBER.finditer(text, run.start(), run.end() + 2)]
    return sorted(got, key=lambda s: (s[0], -s[1]))


def pseudonymise_text(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and the replaced spans of the old text.

    Of overlapping candidates the first valid one is replaced, so a refused one hides no value inside it.
    """
    parts, at, done = [], 0, []
    for start, end, kind in candidates(text):
        new = pseudonym(kind, text[start:end], key) if start >= at else None
        if new is not None:
            parts += [text[at:start], new]
            done.append((start, end, kind))
            at = end
    return "".join([*parts, text[at:]]) if parts else text, done


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans of private values that do not overlap, in order: (start, end, kind)."""
    return pseudonymise_text(text, b"")[1]


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with pseudonyms in its text, and ``private``: kind, start and end of each in the old text.

    A null text stays null, an empty one empty; ids are not looked at, repeated rows get equal
    results; other columns pass through (an old ``private`` is replaced).
    """
    modest_batches(docs.sparkSession)
    docs = docs.drop("private")
    names, at = docs.columns, docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                some = b.slice(i, 500)
                texts, spans = some.column(at).to_pylist(), []
                for k, text in enumerate(texts):
                    texts[k], done = pseudonymise_text(text, key) if text else (text, [])
                    spans.append([{"kind": x, "start": s, "end": e} for s, e, x in done])
                cols = list(some.columns)
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, kind)], [*names, "private"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("private", FOUND)]))


def session_key(spark: SparkSession) -> bytes:
    return spark.conf.get(KEY_SETTING, DEMONSTRATION_KEY).encode()


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(load(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    kinds = F.array_join(F.transform("private", lambda p: p["kind"]), " ")
    return out.select("doc_id", "text", F.size("private").cast("long").alias("n_private"), kinds.alias("kinds"))
