"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (check digits, calendar, ranges).
Each is replaced by another value of the same format, by a keyed permutation of
all values of that format: a Feistel network over a pair of residues, walked on
until the result is valid again. So equal values get equal pseudonyms in every
document, different values different ones, and whoever has the key can undo it.

Found: card numbers (Luhn), IBANs (mod 97), North American phone numbers, social
security numbers, IPv4 addresses, dates, e-mail names, and access keys,
passwords and tokens.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import os
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.storage import texts, with_id

ROUNDS = 8
#: Setting and environment variable that name the key.
KEY_CONF, KEY_ENV = "spark.scriptorium.pii.key", "SCRIPTORIUM_PII_KEY"
_of_application: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key that the session or the environment names; else one drawn for this application, so that no key is in code.

    Pseudonyms of different applications are linked only where they are given the same key.
    """
    named = spark.conf.get(KEY_CONF, None) or os.environ.get(KEY_ENV)
    return named.encode() if named else _of_application.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


class Feistel:
    """A keyed permutation of 0 .. size - 1, one for each tag."""

    def __init__(self, key: bytes, tag: str, size: int):
        self.a = math.isqrt(max(size - 1, 0)) + 1
        self.b = -(-size // self.a)
        self.size, self.seed = size, hashlib.blake2b(f"{tag}:{size}".encode(), key=key[:64], digest_size=32).digest()

    def _f(self, k: int, x: int, modulus: int) -> int:
        raw = hashlib.blake2b(b"%d:%d" % (k, x), key=self.seed, digest_size=max(16, (modulus.bit_length() + 71) // 8) if modulus.bit_length() < 400 else 64).digest()
        return int.from_bytes(raw, "big") % modulus

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in range(ROUNDS):
            if k % 2:
                right = (right + self._f(k, left, self.b)) % self.b
            else:
                left = (left + self._f(k, right, self.a)) % self.a
        return left * self.b + right

    def _undo(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in reversed(range(ROUNDS)):
            if k % 2:
                right = (right - self._f(k, left, self.b)) % self.b
            else:
                left = (left - self._f(k, right, self.a)) % self.a
        return left * self.b + right

    def apply(self, x: int, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """The image of x among the values that are valid; x must be one of them."""
        step = self._undo if back else self._once
        x = step(x)
        while x >= self.size or not valid(x):
            x = step(x)
        return x


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS_OF = {c: s for s in _CLASSES for c in s}
_HEX = "0123456789abcdef"


def permute_text(key: bytes, tag: str, text: str, back: bool = False, alphabet: str | None = None) -> str:
    """Permute a text among those with digits, small and large letters in the same places."""
    sets = [alphabet if alphabet and c in alphabet else _CLASS_OF.get(c) for c in text]
    size, x = 1, 0
    for c, s in zip(text, sets):
        if s:
            size, x = size * len(s), x * len(s) + s.index(c)
    if size == 1:
        return text
    shape = "".join("-" if not s else "x" if s == alphabet else s[0] for s in sets)
    x = Feistel(key, f"{tag}:{shape}", size).apply(x, back=back)
    out = []
    for c, s in zip(reversed(text), reversed(sets)):
        if s:
            x, k = divmod(x, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(body: str) -> int:
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def card(value: str, key: bytes, back: bool = False) -> str | None:
    """13 to 19 digits with a right check digit."""
    d = re.sub("[^0-9]", "", value)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    n = len(d) - 1
    body = Feistel(key, f"card{n}", 10**n).apply(int(d[:-1]), lambda x: len(set((s := f"{x:0{n}d}") + str(luhn_digit(s)))) > 1, back)
    return _refill(value, f"{body:0{n}d}" + str(luhn_digit(f"{body:0{n}d}")))


def iban(value: str, key: bytes, back: bool = False) -> str | None:
    """Country, check digits, account; the account's digits and letters are permuted, the check digits follow."""
    d = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(d) <= 34 or number(d[4:] + d[:4]) % 97 != 1 or not 2 <= int(d[2:4]) <= 98:
        return None
    body = permute_text(key, "iban" + d[:2], d[4:], back)
    d = f"{d[:2]}{98 - number(body + d[:2] + '00') % 97:02d}{body}"
    it = iter(d)
    return "".join(c if c == " " else next(it) for c in value)


def phone(value: str, key: bytes, back: bool = False) -> str | None:
    """Ten digits whose area and exchange start with 2 to 9, however they are written."""
    d = re.sub("[^0-9]", "", value)
    head, d = d[:-10], d[-10:]
    ok = lambda x: 2 <= x // 10**9 and 2 <= x // 10**6 % 10
    if len(d) != 10 or not ok(int(d)):
        return None
    return _refill(value, head + f"{Feistel(key, 'phone', 10**10).apply(int(d), ok, back):010d}")


def ssn(value: str, key: bytes, back: bool = False) -> str | None:
    """Nine digits in groups of 3, 2 and 4, with an area, group and serial that are given out."""

    def ok(x: int) -> bool:
        area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    d = int(value.replace("-", ""))
    return _refill(value, f"{Feistel(key, 'ssn', 10**9).apply(d, ok, back):09d}") if ok(d) else None


def ipv4(value: str, key: bytes, back: bool = False) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, Feistel(key, "ipv4", 1 << 32).apply(x, back=back).to_bytes(4, "big")))


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_MONTHS = "January February March April May June July August September October November December".split()


def _moved(y: int, m: int, d: int, key: bytes, back: bool) -> datetime.date | None:
    try:
        day = datetime.date(y, m, d).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    late = lambda x: (datetime.date.fromordinal(_FIRST + x).day > 12) == (d > 12)
    return datetime.date.fromordinal(_FIRST + Feistel(key, "date", _LAST - _FIRST + 1).apply(day - _FIRST, late, back))


def date(value: str, key: bytes, back: bool = False) -> str | None:
    """Year-month-day, day-month-year (month-day-year where only that is a date), or with an English month."""
    if m := re.fullmatch(r"(\d{4})([-/.])(\d\d)\2(\d\d)", value):
        new = _moved(int(m[1]), int(m[3]), int(m[4]), key, back)
        return new and f"{new.year:04d}{m[2]}{new.month:02d}{m[2]}{new.day:02d}"
    if m := re.fullmatch(r"(\d\d)([-/.])(\d\d)\2(\d{4})", value):
        a, b = int(m[1]), int(m[3])
        if b > 12:  # then it must be the day, and so it is in its image
            new = _moved(int(m[4]), a, b, key, back)
            return new and f"{new.month:02d}{m[2]}{new.day:02d}{m[2]}{new.year:04d}"
        new = _moved(int(m[4]), b, a, key, back)
        return new and f"{new.day:02d}{m[2]}{new.month:02d}{m[2]}{new.year:04d}"
    if m := re.fullmatch(r"(\d{1,2}) ([A-Z][a-z]+) (\d{4})", value):
        new = _moved(int(m[3]), _MONTHS.index(m[2]) + 1, int(m[1]), key, back)
        return new and f"{new.day} {_MONTHS[new.month - 1]} {new.year:04d}"
    if m := re.fullmatch(r"([A-Z][a-z]+) (\d{1,2}), (\d{4})", value):
        new = _moved(int(m[3]), _MONTHS.index(m[1]) + 1, int(m[2]), key, back)
        return new and f"{_MONTHS[new.month - 1]} {new.day}, {new.year:04d}"
    return None


def email(value: str, key: bytes, back: bool = False) -> str | None:
    """The name before the @ is permuted, the domain stays."""
    name, _, domain = value.rpartition("@")
    return f"{permute_text(key, 'email@' + domain.lower(), name, back)}@{domain}"


def secret(value: str, key: bytes, back: bool = False) -> str | None:
    """An access key after its AKIA, or what follows = in a password or token; hexadecimal stays so."""
    at = 4 if value.startswith("AKIA") else re.search(r"=\s*\"?", value).end()
    head, body = value[:at], value[at:]
    return head + permute_text(key, "secret", body, back, _HEX if re.fullmatch('[0-9a-f]+"?', body) else None)


_MONTH = "(?:" + "|".join(_MONTHS) + ")"
#: Kinds in the order in which they are tried at one place, with their patterns.
KINDS: dict[str, tuple[str, Callable]] = {
    "secret": (r"\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|secret|token|api_key)\s?=\s?\"?[0-9A-Za-z]{8,}\"?", secret),
    "email": (r"\b[0-9A-Za-z][0-9A-Za-z._%+-]*@(?:[0-9A-Za-z-]+\.)+[A-Za-z]{2,}\b", email),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b", iban),
    "date": (rf"(?<![\w.-])(?:\d{{4}}(?P<s>[-/.])\d\d(?P=s)\d\d|\d\d(?P<t>[-/.])\d\d(?P=t)\d{{4}}|\d{{1,2}} {_MONTH} \d{{4}}|{_MONTH} \d{{1,2}}, \d{{4}})(?:(?![\w-])|(?=[Tt]\d\d:?\d\d))", date),
    "ipv4": (r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)", ipv4),
    "ssn": (r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])", ssn),
    "phone": (r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)", phone),
    "card": (r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])", card),
}
_RX = re.compile("|".join(f"(?P<{k}>{p})" for k, (p, _) in KINDS.items()))
_EACH = {k: re.compile(p) for k, (p, _) in KINDS.items()}
#: Kinds of which a shorter value may stand in what their pattern takes, and what can't follow one.
_SHORTER = {"iban": re.compile(r"\w"), "card": re.compile(r"[\w-]")}
_MAYBE = re.compile(r"[0-9@]|\b(?:password|passwd|secret|token|api_key)\b")


def _at(text: str, start: int, key: bytes) -> tuple[str, int, str] | None:
    """Kind, end and pseudonym of the first kind, longest first, of which a valid value starts here."""
    for kind, rx in _EACH.items():
        m = rx.match(text, start)
        if not m:
            continue
        end = m.end()
        if new := KINDS[kind][1](text[start:end], key):
            return kind, end, new
        if kind in _SHORTER:
            for end in range(m.end() - 1, start, -1):
                if not _SHORTER[kind].match(text, end) and (m := rx.fullmatch(text, start, end)) and (new := KINDS[kind][1](m[0], key)):
                    return kind, end, new
    return None


def pseudonymise(text: str, key: bytes, found: dict[str, int] | None = None) -> str:
    """The text with every validated value replaced; found counts them by kind."""
    if not _MAYBE.search(text):
        return text
    out, done, at = [], 0, 0
    while m := _RX.search(text, at):
        start = m.start()
        if (hit := _at(text, start, key)) is None:
            at = start + 1
            continue
        kind, at, new = hit
        out += [text[done:start], new]
        done = at
        if found is not None:
            found[kind] = found.get(kind, 0) + 1
    return "".join([*out, text[done:]])


def pseudonymise_pii(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(doc_id, text, replaced): every document's text with pseudonyms, and how many of each kind.

    Where values could overlap, the one that starts first is taken, of those the
    first kind in the order of KINDS, and of that the longest.

    Null text stays null and has an empty map; empty text stays empty; repeated
    rows come out alike; an empty table gives no rows. Other columns are not
    looked at, and ids may be of any type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed, counts = [], []
            for text in batch.column(1).to_pylist():
                found: dict[str, int] = {}
                changed.append(None if text is None else pseudonymise(text, key, found))
                counts.append(sorted(found.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(changed, pa.string()), pa.array(counts, pa.map_(pa.string(), pa.int64()))], ["doc_id", "text", "replaced"])

    src = texts(docs, "doc_id", text_col)
    return src.mapInArrow(run, with_id(src, "text string, replaced map<string, bigint>"))
