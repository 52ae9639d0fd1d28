"""Personal data replaced by format-preserving Feistel pseudonyms.

Numbers and dates that validate are permuted by a keyed Feistel network within the set of valid values of their format,
so the result has the same form and validates too, distinct values stay distinct, and equal values get equal pseudonyms
in every document, without any join or table. The kinds, tried in this order at each place (the first that matches and
validates wins; a candidate that doesn't validate stays as it is):

- ``email``: ASCII letters and digits of the local part are permuted, letters as letters and digits as digits; its other
  signs and the domain stay. Capitals don't tell addresses apart: they are laid over the pseudonym of the small letters;
- ``key``: access key ids of 20 capitals and digits that start with AKIA or ASIA; the sixteen after that are permuted;
- ``secret``: the value after ``password=``, ``passwd=``, ``secret=``, ``token=`` or ``api_key=`` (or with a colon) in any
  case, with or without blanks around the sign and quotes around key and value; ASCII letters and digits permuted within
  their class, other signs stay;
- ``iban``: mod-97 valid; the account digits and letters are permuted and the check digits computed anew;
- ``card``: 13 to 19 digits, alone or in groups, Luhn valid and with a known first digit (3 to 6); all digits after the
  first and before the last are permuted, the last makes the Luhn sum right;
- ``ssn``: ddd-dd-dddd with a valid area, group and serial;
- ``phone``: North American numbers with area and exchange codes that begin with 2 to 9 (after +1 the area may begin with
  0 or 1, and does so in the pseudonym), and others written with a plus sign and a country code (the code stays);
- ``date``: year-month-day with hyphens or slashes, and day or month first with slashes or dots (day first unless only
  month first is a date), from 1900 to 2099. Days after the 12th of a month are permuted among themselves and the others
  among themselves, by the same permutation in whatever order a date is written, so its order can still be told;
- ``ip``: dotted quads with parts up to 255, other than loopback, unspecified and broadcast addresses; permuted among
  all such addresses.

Strings of letters and digits of any length are permuted sign by sign in time that grows with their length: each half is
shifted in turn by a keyed stream that depends on the other. Values of a small set (numbers of a form, dates, addresses)
are permuted as integers, walking along the cycle while outside of it.

Null texts stay null, with no findings; empty texts and texts without findings are unchanged; texts of any length are
read whole, in time that grows with it. Rows are kept one for one, repeated ones alike. Other columns pass through, but for
one named as ``spans``, which is replaced. Who has the key can invert the permutation (``Pseudonyms(key, invert=True)``), but
for leading zeros of days and months, so it has no default: ``key_of`` takes it from the session's setting ``KEY_SETTING``,
and where that is unset draws one at random for the application, so that nobody can.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from bisect import bisect_left
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from .bpe import _q, portions

KEY_SETTING = "spark.ctxgraph.pii.key"
ROUNDS = 10
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST, DAYS = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal() - date(1900, 1, 1).toordinal() + 1
#: Days by whether they are after the 12th of a month.
SORTED_DAYS = [[d for d in range(FIRST, FIRST + DAYS) if (date.fromordinal(d).day > 12) == late] for late in (False, True)]
#: Only values up to this length are remembered.
SHORT = 64

FIND = re.compile(
    r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
  | (?P<key>(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9]))
  | (?P<secret>(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api_key)["']?[^\S\r\n]*[=:](?:\s|[^\S\r\n]*)["']?(?=\S{6})(?:[^\s"'<>]+))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
  | (?P<phone>(?<![\w+.])(?:\+?1[ .-]?)?(?:\(\d{3}\)\ ?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\w-])
      | (?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?![\w-]))
  | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
  | (?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))
  | (?P<ymd>(?<![\w-])(?:19|20)\d\d(?P<s1>[-/])\d{1,2}(?P=s1)\d{1,2}(?![\w]|-\d))
  | (?P<dmy>(?<![\w./-])\d{1,2}(?P<s2>[./])\d{1,2}(?P=s2)(?:19|20)\d\d(?![\w]|[./-]\d))
  | (?P<card>(?<![\w.-])[3-6](?:[ -]?\d){12,18}(?![\w]|-\d))
    """,
    re.X,
)
#: Each kind needs one of these; most texts have none.
HINT = re.compile(r"@|\d[\d .()/-]{5}|A[KS]IA|(?i:password|passwd|secret|token|api_key)[\"']?[^\S\r\n]*[=:]")


def luhn(digits: str) -> int:
    """The digit that makes the sum right after ``digits``."""
    total = sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def refill(form: str, chars: str) -> str:
    """``form`` with its letters and digits replaced in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in form)


class Pseudonyms:
    def __init__(self, key: bytes, invert: bool = False):
        self.key, self.inverted, self.known = hashlib.sha256(key).digest(), invert, {}

    def permute(self, kind: str, value: int, size: int) -> int:
        """A keyed permutation of 0..size-1, of sizes up to 2^64: a balanced Feistel network on the next even number of
        bits, walked along its cycle until the value falls inside. ``kind`` tweaks it."""
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        tweak = f"{kind}:{size}:".encode()
        while True:
            left, right = value >> half, value & mask
            for r in reversed(range(ROUNDS)) if self.inverted else range(ROUNDS):
                seen = left if self.inverted else right
                f = int.from_bytes(hashlib.blake2b(tweak + bytes([r]) + seen.to_bytes(4, "big"), key=self.key, digest_size=8).digest(), "big") & mask
                left, right = (right ^ f, left) if self.inverted else (right, left ^ f)
            value = left << half | right
            if value < size:
                return value

    def mixed(self, kind: str, text: str) -> str:
        """Permute a string of any length within its pattern of ASCII digits, small and capital letters: a Feistel network
        over its two halves, each sign of one shifted within its class by a stream keyed with the other."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        base, size = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for c in (DIGITS, LOWER, UPPER):
            own = (codes >= ord(c[0])) & (codes <= ord(c[-1]))
            base[own], size[own] = ord(c[0]), len(c)
        at = np.flatnonzero(size)
        tweak = hashlib.blake2b(kind.encode() + b":" + base.astype(np.uint8).tobytes(), key=self.key).digest()
        value, size = codes[at] - base[at], size[at]
        half = len(at) // 2
        sides = (slice(0, half), slice(half, None))
        for r in reversed(range(ROUNDS)) if self.inverted else range(ROUNDS):
            mine, other = sides[r % 2], sides[1 - r % 2]
            n = len(value[mine])
            stream = hashlib.shake_256(tweak + bytes([r]) + value[other].astype(np.uint8).tobytes()).digest(4 * n)
            shift = np.frombuffer(stream, "<u4").astype(np.int64)
            value[mine] = (value[mine] + (-shift if self.inverted else shift)) % size[mine]
        codes = codes.copy()
        codes[at] = value + base[at]
        return codes.tobytes().decode("utf-32-le")

    def number(self, kind: str, digits: str) -> str:
        return self.mixed(kind, "".join(str(int(d)) for d in digits))

    def one(self, kind: str, text: str) -> tuple[str, str] | None:
        """(kind, pseudonym) of a validated value, None of anything else."""
        got = self.known.get((kind, text), 0)
        if got == 0:
            if len(self.known) > 50_000:
                self.known.clear()
            got = getattr(self, "_" + kind)(text)
            if len(text) <= SHORT:
                self.known[kind, text] = got
        return got

    def _email(self, text):
        local, _, domain = text.partition("@")
        small = "".join(c.lower() if c in UPPER else c for c in local)
        new = self.mixed("email", small)
        return "email", "".join(n.upper() if c in UPPER else n for c, n in zip(local, new)) + "@" + domain

    def _key(self, text):
        return "key", text[:4] + self.mixed("key", text[4:])

    def _secret(self, text):
        at = re.search(r"[=:]\s*[\"']?", text).end()
        return "secret", text[:at] + self.mixed("secret", text[at:])

    def _iban(self, text):
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        account = self.mixed("iban" + plain[:2], plain[4:])
        check = 98 - iban_rest(plain[:2] + "00" + account)
        return "iban", refill(text, f"{plain[:2]}{check:02d}{account}")

    def _card(self, text):
        digits = re.sub(r"\D", "", text)
        if luhn(digits[:-1]) != int(digits[-1]):
            return None
        body = digits[0] + self.number("card" + digits[0], digits[1:-1])
        return "card", refill(text, body + str(luhn(body)))

    def _ssn(self, text):
        area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        areas = area - 1 - (area > 666)
        value = self.permute("ssn", (areas * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
        value, serial = divmod(value, 9999)
        area, group = divmod(value, 99)
        return "ssn", f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, text):
        digits = re.sub(r"\D", "", text)
        if not text.startswith("+") or text[1] == "1":
            own = digits[-10:]
            if len(digits) not in (10, 11) or len(digits) == 11 and digits[0] != "1" or own[3] in "01":
                return None
            if own[0] in "01":
                if not text.startswith("+"):
                    return None
                value = self.permute("phone01", (int(own[:3]) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:]), 200 * 800 * 10_000)
                return "phone", refill(text, f"{digits[:-10]}{value // 8_000_000:03d}{value // 10_000 % 800 + 200}{value % 10_000:04d}")
            a, b, c = int(own[:3]) - 200, int(own[3:6]) - 200, int(own[6:])
            value, c = divmod(self.permute("phone", (a * 800 + b) * 10_000 + c, 800 * 800 * 10_000), 10_000)
            a, b = divmod(value, 800)
            return "phone", refill(text, f"{digits[:-10]}{a + 200}{b + 200}{c:04d}")
        code = re.match(r"\+(\d{1,3}?)(?=\D|\d{7})", text)
        if not code or not 8 <= len(digits) <= 15:
            return None
        rest = digits[len(code[1]) :]
        return "phone", refill(text, code[1] + self.number("phone" + code[1], rest))

    def _ip(self, text):
        parts = text.split(".")
        value = 0
        for p in parts:
            if int(p) > 255 or len(p) > 1 and p[0] == "0":
                return None
            value = value << 8 | int(p)
        special = lambda v: v >> 24 in (0, 127) or v == 0xFFFFFFFF
        if special(value):
            return None
        value = self.permute("ip", value, 1 << 32)
        while special(value):
            value = self.permute("ip", value, 1 << 32)
        return "ip", ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))

    def _date(self, y, m, d):
        try:
            day = date(y, m, d)
        except ValueError:
            return None
        days = SORTED_DAYS[d > 12]
        return date.fromordinal(days[self.permute(f"date{d > 12}", bisect_left(days, day.toordinal()), len(days))])

    def _ymd(self, text):
        y, m, d = re.split("[-/]", text)
        new = self._date(int(y), int(m), int(d))
        if new is None:
            return None
        z = 2 if len(m) == 2 and len(d) == 2 else 1
        return "date", text[4].join((str(new.year), str(new.month).zfill(z), str(new.day).zfill(z)))

    def _dmy(self, text):
        sign = re.search(r"\D", text)[0]
        a, b, y = text.split(sign)
        z = 2 if len(a) == 2 and len(b) == 2 else 1
        for swap in (False, True):
            d, m = (b, a) if swap else (a, b)
            new = self._date(int(y), int(m), int(d))
            if new is not None:
                p, q = (new.month, new.day) if swap else (new.day, new.month)
                return "date", sign.join((str(p).zfill(z), str(q).zfill(z), str(new.year)))
        return None

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in the text as it was."""
        if not HINT.search(text):
            return text, []
        out, spans, last, at = [], [], 0, 0
        while m := FIND.search(text, at):
            kind = m.lastgroup
            got = self.one(kind, m.group(kind))
            at = m.end()
            if got is None:  # a later kind may still begin inside it
                at = m.start() + 1
                continue
            out += [text[last : m.start()], got[1]]
            spans.append((got[0], m.start(), m.end()))
            last = at
        return "".join(out) + text[last:] if spans else text, spans


SPANS = "array<struct<kind:string,start:int,end:int>>"


def key_of(spark: SparkSession) -> bytes:
    """The key of the session's setting, else one drawn at random for the application and kept in the driver."""
    named = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING)
    if named:
        return named.encode()
    sc = spark.sparkContext
    if not hasattr(sc, "_ctxgraph_pii_key"):
        sc._ctxgraph_pii_key = secrets.token_bytes(32)
    return sc._ctxgraph_pii_key


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """Replace ``text`` and add ``spans``: kind, start and end (code points) in the text as it was. No shuffle."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != spans]
    schema = docs.select(*map(_q, kept)).withColumn(spans, F.expr(f"CAST(array() AS {SPANS})")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        own = Pseudonyms(key)
        for b in batches:
            for part in portions(b, text, 16_000_000):
                done = [(None, []) if (t := x.as_py()) is None else own.text(t) for x in part.column(text)]
                columns = {c: part.column(c) for c in kept} | {text: pa.array([t for t, _ in done], pa.string())}
                found = pa.array([[{"kind": k, "start": a, "end": z} for k, a, z in s] for _, s in done], kind)
                yield pa.RecordBatch.from_arrays([columns[c] for c in kept] + [found], names=[*kept, spans])

    return docs.mapInArrow(run, schema)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Every document with its pseudonymised text, the number of values replaced and their kinds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, key_of(spark))
    return out.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_replaced"), F.array_sort(F.array_distinct("pii_spans.kind")).alias("kinds"))
