"""Personal data: values in a validated format are replaced by a keyed permutation of that format.

Equal values have equal pseudonyms in every document, which keeps them linked; without the key they can't be undone.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 10
#: Letters and digits that are permuted as one number; longer values are chained.
CHUNK = 32
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()

#: A kind's pattern; what it finds still has to be valid.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("date", r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![\w/-]|\.[0-9])"),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"),
    ("card", r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])"),
    ("phone", r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![\w-])"),
)
KINDS = tuple(k for k, _ in PATTERNS)
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
#: Country codes of telephone numbers: none begins another, so a code is known without a separator behind it.
_CODE = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})")
_DATE_SHAPE = re.compile(r"[0-9]{1,2}([.-])[0-9]{1,2}\1[0-9]{4}|[0-9]{4}([.-])[0-9]{2}\2[0-9]{2}")
#: Characters of an IBAN by country; those of other countries may have any number.
IBAN_LENGTHS = {c: int(n) for n, codes in (x.split(":") for x in (
    "15:NO", "16:BE", "18:DK FI FO GL NL SD FK", "19:MK SI", "20:AT BA EE KZ LT LU XK MN", "21:CH HR LI LV", "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM TL SO", "24:AD CZ ES MD PK RO SA SE SK TN VG",
    "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HU LB NI PL SV", "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
)) for c in codes.split()}
_MAY = re.compile("[0-9@]")


class Feistel:
    """A keyed permutation of range(n) for any n: a balanced Feistel network over the next even power of two, walked until it lands within n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mix(self, tag: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        data = i.to_bytes(1, "big") + len(tag).to_bytes(1, "big") + tag + half.to_bytes(size, "big")
        return int.from_bytes(hashlib.shake_256(self.key + data).digest(size), "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tag: bytes, back: bool = False) -> int:
        if n < 2:
            return x
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, tag = (1 << bits) - 1, tag + n.to_bytes((n.bit_length() + 7) // 8, "big")[:64]
        while True:
            a, b = x >> bits, x & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                a, b = (b ^ self._mix(tag, i, a, bits), a) if back else (b, a ^ self._mix(tag, i, b, bits))
            x = (a << bits) | b
            if x < n:
                return x


def luhn_digit(digits: str) -> str:
    """The check digit that belongs behind digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_rest(country: str, bban: str) -> int:
    return int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97


def _poured(template: str, chars: str) -> str:
    """template with its letters and digits replaced in turn."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in template)


class Pseudonyms:
    """Replaces a valid value by another of its format; None if the value isn't valid."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.of = lru_cache(maxsize=100_000)(self._of)

    def _of(self, kind: str, value: str, back: bool = False) -> str | None:
        return getattr(self, "_" + kind)(value, back)

    def _permuted(self, part: str, tag: str, back: bool) -> str:
        """Letters and digits of one part as one number; letters stay letters of their case, digits digits."""
        n, x = 1, 0
        radix = lambda c: (10, "0") if c.isdigit() else (26, "a") if c.islower() else (26, "A")
        for c in part:
            r, zero = radix(c)
            n, x = n * r, x * r + ord(c) - ord(zero)
        shape = "".join(radix(c)[1] for c in part)
        y, out = self.feistel.permute(x, n, hashlib.sha256(f"{tag}:{shape}".encode()).digest()[:16], back), []
        for c in reversed(part):
            r, zero = radix(c)
            y, d = divmod(y, r)
            out.append(chr(ord(zero) + d))
        return "".join(reversed(out))

    def _chained(self, parts: list[str], tag: str, back: bool) -> list[str]:
        """Each part permuted under a tag that holds the pseudonym of the one before."""
        out, before = [], ""
        for part in parts:
            out.append(self._permuted(part, f"{tag}:{before}", back))
            before = part if back else out[-1]
        return out

    def _mapped(self, text: str, tag: str, back: bool, fold: bool = False) -> str:
        """Digits to digits, letters to letters of their case; other characters stay. With fold, case doesn't count, but stays where it stands.

        Parts of CHUNK characters are chained forwards, then backwards, so that every part depends on all others and the
        time grows with the length alone.
        """
        own = "".join(c for c in text if c.isalnum())
        own = own.lower() if fold else own
        parts = [own[i : i + CHUNK] for i in range(0, len(own), CHUNK)]
        for turn in (1, 0) if back else (0, 1):
            if turn and len(parts) > 1:
                parts = self._chained(parts[::-1], tag + ":back", back)[::-1]
            elif not turn:
                parts = self._chained(parts, tag, back)
        new = iter("".join(parts))
        return "".join((next(new).upper() if fold and c.isupper() else next(new)) if c.isalnum() else c for c in text)

    def _email(self, v: str, back: bool) -> str:
        """The top-level domain stays; addresses that differ in case alone have pseudonyms that differ in case alone."""
        head, dot, top = v.rpartition(".")
        return self._mapped(head, "email", back, fold=True) + dot + top

    def _iban(self, v: str, back: bool) -> str | None:
        bare = v.replace(" ", "")
        country, check, bban = bare[:2], bare[2:4], bare[4:]
        if not 11 <= len(bban) <= 30 or 98 - _iban_rest(country, bban) != int(check):
            return None
        new = self._mapped(bban, "iban" + country, back)
        return _poured(v, f"{country}{98 - _iban_rest(country, new):02d}{new}")

    def _date(self, v: str, back: bool) -> str | None:
        sign = "-" if "-" in v else "." if "." in v else "/"
        parts = v.split(sign)
        orders = {"-": ("ymd",), ".": ("dmy",), "/": ("mdy", "dmy")}[sign]
        for order in orders:
            y, m, d = (int(parts[order.index(c)]) for c in "ymd")
            if 1900 <= y < 2100 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]:
                new = datetime.date.fromordinal(FIRST_DAY + self.feistel.permute(datetime.date(y, m, d).toordinal() - FIRST_DAY, DAYS, b"date", back))
                wide = any(len(x) == 2 and x[0] == "0" for x in parts) or sign == "-"
                show = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if wide else str(new.month), "d": f"{new.day:02d}" if wide else str(new.day)}
                return sign.join(show[c] for c in order)
        return None

    def _ssn(self, v: str, back: bool) -> str | None:
        """Areas 001-899 but 666, groups 01-99, serials 0001-9999, as one number."""
        area, group, serial = map(int, v.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self.feistel.permute(x, 898 * 99 * 9999, b"ssn", back), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _ip(self, v: str, back: bool) -> str | None:
        octets = [int(x) for x in v.split(".")]
        if max(octets) > 255:
            return None
        y = self.feistel.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ip", back)
        return ".".join(map(str, y.to_bytes(4, "big")))

    def _card(self, v: str, back: bool) -> str | None:
        """The first digit stays, the last follows from the others."""
        digits = re.sub(r"\D", "", v)
        if luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
            return None
        n = len(digits) - 2
        body = f"{digits[0]}{self.feistel.permute(int(digits[1:-1]), 10**n, b'card%d' % n, back):0{n}d}"
        return _poured(v, body + luhn_digit(body))

    def _phone(self, v: str, back: bool) -> str | None:
        """A country code stays; separators do not count, so one number links however it is written. With a code or brackets it takes seven digits, without them ten, or seven with a leading 0 (which stays), in groups."""
        code = _CODE.match(v)
        head = code[0] if code else ""
        marked = bool(code) or "(" in v
        digits = re.sub(r"\D", "", v[len(head) :])
        if not marked and v[0] == "0" and 7 <= len(digits) < 10 and not _DATE_SHAPE.fullmatch(v):
            head, least, digits = "0", 6, digits[1:]
        else:
            least = 7 if marked else 10
        if not least <= len(digits) <= 15 - len(head.lstrip("+")) or not (marked or re.search("[ .-]", v)):
            return None
        n = len(digits)
        return head + _poured(v[len(head) :], f"{self.feistel.permute(int(digits), 10**n, b'phone%d' % n, back):0{n}d}")

    def _longest(self, kind: str, m: re.Match, back: bool) -> tuple[int, str] | None:
        """End and replacement of a candidate, or of the longest part from its start that ends at a separator and is valid.

        Shorter parts are tried for cards, IBANs (of the country's length, where known) and telephone numbers with a code or brackets.
        """
        of, v = (lambda part: self._of(kind, part, True)) if back else (lambda part: self.of(kind, part)), m[0]
        if (new := of(v)) is not None:
            return m.end(), new
        if kind not in ("card", "iban") and not (kind == "phone" and v[0] in "+("):
            return None
        for end in reversed([x.start() for x in re.finditer({"card": "[ -]", "iban": " ", "phone": "[ .(-]"}[kind], v)]):
            part = v[:end]
            n = sum(c.isalnum() for c in part)
            if n < {"card": 13, "iban": 15, "phone": 7}[kind] or kind == "iban" and n != IBAN_LENGTHS.get(part[:2], n):
                continue
            if (new := of(part)) is not None:
                return m.start() + end, new
        return None

    def replaced(self, text: str, back: bool = False) -> tuple[str, list[str]]:
        """The text with its valid values replaced, and their kinds in order. A candidate that isn't valid, nor shortened, is looked into again from its second character.

        Back, the text is the same again unless a longer candidate that wasn't valid has become so by chance.
        """
        out, kinds, at, done = [], [], 0, 0
        while m := _FIND.search(text, at):
            k, found = m.lastgroup, self._longest(m.lastgroup, m, back)
            if found is None:
                rest = ((k, x) for k, p in PATTERNS[KINDS.index(m.lastgroup) + 1 :] if (x := re.compile(p).match(text, m.start())))
                k, found = next(((k, y) for k, x in rest if (y := self._longest(k, x, back)) is not None), (None, None))
                if found is None:
                    at = m.start() + 1
                    continue
            end, new = found
            out += [text[done : m.start()], new]
            kinds.append(k)
            at = done = end
        return "".join([*out, text[done:]]), kinds


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", kinds: str | None = None) -> DataFrame:
    """docs with personal data in `text` replaced; with `kinds`, a further array column of that name lists what was found, in order.

    Found: e-mail addresses, IBANs with right check digits, dates of 1900 to 2099, social security numbers, IPv4
    addresses, 13 to 19 digits that pass the Luhn test, telephone numbers. A null text stays null (no kinds), an empty
    one empty. Rows, order and all other columns stay; whole texts, one pass, no shuffle. A column called `kinds` is replaced.
    """
    own = [c for c in docs.columns if c != kinds]
    at = own.index(text)
    schema = docs.select(*own).schema
    if kinds:
        schema = schema.add(kinds, T.ArrayType(T.StringType()))

    def work(batches: Callable):
        names = Pseudonyms(key)
        for batch in batches:
            new = [(x, []) if x is None or not _MAY.search(x) else names.replaced(x) for x in batch.column(at).to_pylist()]
            columns = [pa.array([x for x, _ in new], pa.string()) if i == at else batch.column(i) for i in range(len(own))]
            if kinds:
                columns.append(pa.array([k for _, k in new], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=[*own, *([kinds] if kinds else [])])

    return docs.select(*own).mapInArrow(work, schema)


def counted(docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text (replaced), n_pii and one n_ column for each kind. A null text stays null and has counts of 0, an empty one too; repeated rows stay, no other column is read, an empty table gives an empty one."""
    a = pseudonymised(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), key, "text", "kinds")
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return a.select("doc_id", "text", F.size("kinds").cast("long").alias("n_pii"), *map(count, KINDS))
