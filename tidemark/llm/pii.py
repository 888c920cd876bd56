"""Personal data: format-preserving pseudonyms.

Numbers, dates and addresses are found by pattern, validated (check digits, registered lengths, ranges,
calendar), and replaced by a keyed permutation within their own format: a Feistel network over the
format's domain, walked on while it leaves the domain, and moved on by one place, so that no value
stands for itself. Each kind has one canonical value, whatever the separators: a phone number is its
country code and digits, a date is a day, a mail address is a name under a domain. Equal values get
equal pseudonyms in all documents; with the key a pseudonym can be turned back. Values that don't
validate stay as they are; the search then goes on with shorter ends, later kinds and the next start
inside. A pseudonym beside other numbers or words may be valid together with them by chance, so to
turn a text back exactly, take the places from `private`.

Kept in clear: a phone's country code, an IBAN's country, a mail address's last label, whether a day lies
after the 12th. Days after the 12th and others are permuted among themselves, so a date that is only
valid with the month first stays so.

The key comes from the caller, or from the session's SECRET_CONF. Without one, the session draws a key of
its own: values are linked within the session, and nobody can turn them back.

Defined cases: a null text stays null; an empty or clean text is unchanged; of overlapping finds the
leftmost counts, then the earlier kind of KINDS; a date that is valid with the day first is read so;
repeated rows give equal rows; an empty table gives an empty table. The caller's columns are kept, but
for those named like a result (n_private, private); in the stage all are kept.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import math
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import pieces
from tidemark.llm.common import documents, kept_whole, quoted

ROUNDS = 10
#: Where a session keeps its key; Spark's own rules keep settings of such names out of logs.
SECRET_CONF = "spark.tidemark.pseudonyms.secret"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Country calling codes of one and of two digits; all others have three.
SHORT_CODES = {"1", "7"}
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Registered lengths of IBANs by country.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BI=27, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DJ=27, DK=18, DO=28, EE=20, EG=29,
    ES=24, FI=18, FK=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28,
    LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MN=20, MR=27, MT=31, MU=30, NI=28, NL=18, NO=15, OM=23, PK=24, PL=28, PS=29, PT=25,
    QA=29, RO=24, RS=22, RU=33, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, SO=23, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20, YE=30,
)


@functools.cache
def days(late: bool) -> list[int]:
    """Days after the 12th of their month, or others, in order."""
    return [n for n in range(FIRST_DAY, LAST_DAY + 1) if (datetime.date.fromordinal(n).day > 12) == late]


def session_secret(spark: SparkSession) -> bytes:
    """The session's key; one that was not set is drawn and kept for the session."""
    found = spark.conf.get(SECRET_CONF, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(SECRET_CONF, found)
    return found.encode()


class Permutation:
    """A keyed permutation of 0 to size - 1; `tweak` keeps formats apart."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.high = math.isqrt(size - 1) + 1 if size > 1 else 1
        self.low = -(-size // self.high)
        self.secret = hashlib.blake2b(f"{tweak}|{size}".encode(), key=key[:64], digest_size=32).digest()

    def _round(self, n: int, value: int) -> int:
        said = n.to_bytes(1, "big") + value.to_bytes(24, "big")
        return int.from_bytes(hashlib.blake2b(said, key=self.secret, digest_size=24).digest(), "big")

    def forward(self, value: int) -> int:
        while True:
            a, b = divmod(value, self.low)
            for n in range(0, ROUNDS, 2):
                a = (a + self._round(n, b)) % self.high
                b = (b + self._round(n + 1, a)) % self.low
            value = a * self.low + b
            if value < self.size:
                return value

    def backward(self, value: int) -> int:
        while True:
            a, b = divmod(value, self.low)
            for n in range(ROUNDS - 2, -1, -2):
                b = (b - self._round(n + 1, a)) % self.low
                a = (a - self._round(n, b)) % self.high
            value = a * self.low + b
            if value < self.size:
                return value


def luhn_digit(payload: str) -> str:
    doubled = sum(sum(divmod(2 * int(c), 10)) for c in payload[::-2])
    return str(-(doubled + sum(map(int, payload[-2::-2]))) % 10)


def iban_digits(country: str, account: str) -> str:
    value = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - value % 97:02d}"


def refill(shape: str, fresh: str) -> str:
    """shape with its digits and letters replaced in turn, letters in the case they had."""
    left = iter(fresh)
    return "".join((next(left).upper() if c.isupper() else next(left)) if c.isalnum() else c for c in shape)


def radix(text: str) -> tuple[int, int]:
    """Number of a text of digits and letters among all texts of its classes, and how many there are."""
    value, size = 0, 1
    for c in text:
        base, digit = (10, int(c)) if c.isdigit() else (26, LETTERS.index(c))
        value, size = value * base + digit, size * base
    return value, size


def unradix(value: int, classes: str) -> str:
    out = []
    for c in reversed(classes):
        value, digit = divmod(value, 10 if c.isdigit() else 26)
        out.append(str(digit) if c.isdigit() else LETTERS[digit])
    return "".join(reversed(out))


class Pseudonyms:
    """Replaces validated values under one key; with back=True it restores them."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self.permutation = functools.lru_cache(maxsize=4096)(lambda tweak, size: Permutation(key, tweak, size))
        self.known = functools.lru_cache(maxsize=100_000)(self._one)

    def permute(self, tweak: str, size: int, value: int) -> int:
        """A permutation without fixed places: to the value's hidden place, one on, and back."""
        own = self.permutation(tweak, size)
        return own.backward((own.forward(value) + (-1 if self.back else 1)) % size)

    def text(self, tweak: str, value: str) -> str:
        number, size = radix(value)
        return unradix(self.permute(f"{tweak}|{re.sub('[0-9]', '0', re.sub('[a-z]', 'a', value))}", size, number), value)

    def domain(self, found: str) -> str:
        """The domain with all labels but the last replaced as one value."""
        head, dot, last = found.rpartition(".")
        plain = re.sub(r"[^a-z0-9]", "", head.lower())
        return refill(head, self.text(f"domain|{last.lower()}", plain)) + dot + last if plain else found

    def email(self, found: str) -> str | None:
        local, _, domain = found.rpartition("@")
        plain = re.sub(r"[^a-z0-9]", "", local.lower())
        if not plain:
            return None
        fresh = self.domain(domain)
        under = fresh if self.back else domain
        return f"{refill(local, self.text(f'email|{under.lower()}', plain))}@{fresh}"

    def iban(self, found: str) -> str | None:
        plain = found.replace(" ", "")
        country, check, account = plain[:2], plain[2:4], plain[4:]
        if IBAN_LENGTHS.get(country) != len(plain) or iban_digits(country, account) != check:
            return None
        fresh = self.text(f"iban|{country}", account.lower()).upper()
        return refill(found, country.lower() + iban_digits(country, fresh) + fresh.lower())

    def card(self, found: str) -> str | None:
        plain = re.sub(r"\D", "", found)
        if not 13 <= len(plain) <= 19 or luhn_digit(plain[:-1]) != plain[-1] or not plain.strip("0"):
            return None
        fresh = self.text("card", plain[:-1])
        return refill(found, fresh + luhn_digit(fresh))

    def address(self, found: str) -> str | None:
        parts = found.split(".")
        if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
            return None
        value = self.permute("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"))
        return ".".join(map(str, value.to_bytes(4, "big")))

    def social(self, found: str) -> str | None:
        area, group, serial = map(int, found.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        place = area - 1 - (area > 666)
        value = self.permute("social", 898 * 99 * 9999, (place * 99 + group - 1) * 9999 + serial - 1)
        (place, group), serial = divmod(value // 9999, 99), value % 9999
        return f"{place + 1 + (place >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, found: str) -> str | None:
        """Numbers of three, three and four digits without a country code are read as of code 1."""
        plain = re.sub(r"\D", "", found)
        if found.startswith("+"):
            country = plain[: 1 if plain[0] in SHORT_CODES else 2 if plain[:2] in TWO_DIGIT_CODES else 3]
        else:
            country, plain = "1", "1" + plain
        number = plain[len(country) :]
        if plain[0] == "0" or not 7 <= len(number) <= 14 or len(plain) > 15:
            return None
        fresh = self.text(f"phone|{country}", number)
        return refill(found, (country if found.startswith("+") else "") + fresh)

    def date(self, found: str) -> str | None:
        parts = re.split(r"\D", found)
        orders = ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy")
        for order in orders:
            y, m, d = (int(parts[order.index(c)]) for c in "ymd")
            try:
                day = datetime.date(y, m, d).toordinal()
            except ValueError:
                continue
            if FIRST_DAY <= day <= LAST_DAY:
                among = days(d > 12)
                fresh = datetime.date.fromordinal(among[self.permute(f"date|{d > 12}", len(among), bisect.bisect_left(among, day))])
                said = {"y": f"{fresh.year:04d}", "m": f"{fresh.month:02d}", "d": f"{fresh.day:02d}"}
                return refill(found, "".join(said[c] for c in order))
        return None

    def secret(self, found: str) -> str | None:
        size = 16 ** len(found)
        fresh = f"{self.permute(f'secret|{len(found)}', size, int(found, 16)):0{len(found)}x}"
        return fresh.upper() if found.upper() == found else fresh

    def _one(self, kind: str, found: str) -> str | None:
        return getattr(self, kind)(found)

    def _valid(self, text: str, m: re.Match) -> tuple[str, int, int, str] | None:
        """Kind, start, end and pseudonym of the first value that begins where m does: kinds in order, longer ends first."""
        for kind in NAMES[NAMES.index(m.lastgroup) :]:
            own = m if kind == m.lastgroup else ALONE[kind].match(text, m.start())
            if own is None:
                continue
            a, b = own.span(kind)
            ends = [b, *(e for e in range(b - 1, a, -1) if text[e] in " .-" and CORES[kind].fullmatch(text, a, e))] if kind in CORES else [b]
            for e in ends:
                fresh = self.known(kind, text[a:e])
                if fresh is not None:
                    return kind, a, e, fresh
        return None

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and kind, start and end of each value in the text as it was."""
        finds: list[tuple[str, int, int]] = []
        out, done, at = [], 0, 0
        while m := PATTERN.search(text, at):
            found = self._valid(text, m)
            if found is None:
                at = m.start() + 1
                continue
            kind, a, b, fresh = found
            finds.append((kind, a, b))
            out += [text[done:a], fresh]
            done = at = b
        return ("".join([*out, text[done:]]) if finds else text), finds


#: Patterns by kind; each begins where its run of characters begins, so a long run is scanned once.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])(?P<email>[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+)",
    "secret": r"(?i:\b(?:token|secret|api[_-]?key|password)\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>[0-9a-f]{16,}+|[0-9A-F]{16,}+)(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "address": r"(?<![0-9.])(?P<address>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?P<date>[0-9]{4}(?P<y>[-/])[0-9]{2}(?P=y)[0-9]{2}|[0-9]{2}(?P<d>[./])[0-9]{2}(?P=d)[0-9]{4})(?![0-9]|[./-][0-9])",
    "social": r"(?<![0-9-])(?P<social>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])(?P<card>[0-9]{13,19}|[0-9]{4}(?P<c>[ -])[0-9]{4}(?P=c)[0-9]{4}(?P=c)[0-9]{1,7}|[0-9]{4}(?P<e>[ -])[0-9]{6}(?P=e)[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+(])(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
}


PATTERN = re.compile("|".join(KINDS.values()))
NAMES = list(KINDS)
ALONE = {kind: re.compile(pattern) for kind, pattern in KINDS.items()}
#: Kinds that may hold words of the text after them, without what must stand around them.
CORES = {kind: re.compile(re.sub(r"^\(\?<!.*?\]\)|\(\?![^()]*\)$", "", KINDS[kind])) for kind in ("iban", "phone")}


def pseudonymise(docs: DataFrame, secret: bytes | None = None, text: str = "text", back: bool = False) -> DataFrame:
    """docs with the text rewritten, and n_private and private (kind, start and end of each value in the old text).

    Texts without a digit and without @ can hold no value and are passed over.
    """
    found = _rewritten(docs, secret, text, back)
    own = [F.col("text").alias(c) if c == text else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns if c.lower() not in ("n_private", "private")]
    return found.select(*own, "n_private", "private")


def _rewritten(docs: DataFrame, secret: bytes | None, text: str, back: bool) -> DataFrame:
    """row (the other columns of docs), text, n_private and private."""
    secret = secret or session_secret(docs.sparkSession)
    rows = docs.select(kept_whole(docs, text), docs[quoted(text)].cast("string").alias("text"))
    found = T.StructType.fromDDL("n_private long, private array<struct<kind:string,start:int,end:int>>")
    schema = T.StructType([*rows.schema.fields, *found.fields])
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(secret, back)
        for batch in pieces(batches, "text"):
            row, column = batch.columns
            likely = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False).to_pylist()
            texts = column.to_pylist()
            results = [own.replace(t) if hit else (t, []) for t, hit in zip(texts, likely, strict=True)]
            finds = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for _, f in results], spans)
            yield pa.RecordBatch.from_arrays([row, pa.array([t for t, _ in results], column.type), pa.array([len(f) for _, f in results], pa.int64()), finds], names=["row", "text", "n_private", "private"])

    return rows.mapInArrow(run, schema)


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("private", lambda x: x["kind"]))), ",")
    return pseudonymise(docs).select("doc_id", "text", "n_private", kinds.alias("kinds"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts, under the session's key."""
    found = _rewritten(docs, None, "text", False)
    return found.select(*[F.col("text").alias(c) if c == "text" else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
