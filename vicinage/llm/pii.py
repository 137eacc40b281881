"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Candidates are found by pattern and validated (Luhn sum, octets, calendar,
issued ranges, mod 97).  A valid value is numbered within the set of all values
of its format and length, the number goes through a keyed Feistel network, walked
on until it falls into the set again, and the result is written in the format of
the original: separators, letter case and check digits stay right.  The map is a
permutation, so different values stay different and the same value has the same
pseudonym in every document and format.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import pieces

ROUNDS = 8
#: First and number of days that dates are permuted within.
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Feistel:
    """Keyed permutations of ``range(size)``, one for each name and size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _once(self, x: int, half: int, tweak: bytes) -> int:
        mask = (1 << half) - 1
        a, b = x >> half, x & mask
        width = (half + 7) // 8
        for r in range(ROUNDS):
            digest = hashlib.blake2b(tweak + bytes([r]) + b.to_bytes(width, "big"), key=self.key, digest_size=max(16, width)).digest()
            a, b = b, a ^ (int.from_bytes(digest, "big") & mask)
        return (a << half) | b

    def permute(self, x: int, size: int, name: str) -> int:
        if size < 2:
            return x
        half = ((size - 1).bit_length() + 1) // 2
        tweak = f"{name}/{size}/".encode()
        x = self._once(x, half, tweak)
        while x >= size:  # walk the cycle until it enters the set
            x = self._once(x, half, tweak)
        return x


def luhn_digit(payload: str) -> int:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def _refilled(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _number(f: Feistel, digits: str, name: str, keep: int = 1) -> str:
    """Digits permuted among those of their length; the first ``keep`` stay."""
    head, rest = digits[:keep], digits[keep:]
    return head + str(f.permute(int(rest), 10 ** len(rest), f"{name}{head}")).zfill(len(rest)) if rest else head


def card(f: Feistel, text: str) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn_digit(digits[:-1]) != int(digits[-1]):
        return None
    payload = _number(f, digits[:-1], "card")
    return _refilled(text, payload + str(luhn_digit(payload)))


def phone(f: Feistel, text: str) -> str | None:
    digits = _digits(text)
    if not 10 <= len(digits) <= 15:
        return None
    country = digits[:-10] or "1"
    own = _number(f, digits[-10:], f"phone{country}")
    return _refilled(text, digits[:-10] + own)


def ip(f: Feistel, text: str) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets) or octets[0] in ("0", "127"):
        return None
    first = int(octets[0])
    place = first - 1 - (first > 127)  # of the 254 first octets that are valid
    rest = int.from_bytes(bytes(map(int, octets[1:])), "big")
    place, rest = divmod(f.permute(place << 24 | rest, 254 << 24, "ip"), 1 << 24)
    return ".".join(str(b) for b in (place + 1 + (place >= 126), *rest.to_bytes(3, "big")))


def ssn(f: Feistel, text: str) -> str | None:
    area, group, serial = (int(x) for x in re.split(r"\D", text))
    if area in (0, 666) or area >= 900 or group == 0 or serial == 0:
        return None
    place = area - 1 - (area > 666)
    number = f.permute((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    rest, serial = divmod(number, 9999)
    place, group = divmod(rest, 99)
    return _refilled(text, f"{place + 1 + (place >= 665):03}{group + 1:02}{serial + 1:04}")


def iban(f: Feistel, text: str) -> str | None:
    plain = text.replace(" ", "")
    value = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or value(plain[4:] + plain[:4]) % 97 != 1:
        return None
    country, account = plain[:2], plain[4:]
    body = _mixed(f, account, f"iban{country}")
    full = f"{country}{98 - value(body + country + '00') % 97:02}{body}"
    it = iter(full)
    return "".join(c if c == " " else next(it) for c in text)


def _mixed(f: Feistel, text: str, name: str) -> str:
    """ASCII letters and digits permuted, each place within its own class; the
    rest stays.  Case does not matter for the permutation and is kept."""
    places = [(k, 10 if c.isdigit() else 26) for k, c in enumerate(text) if c.isascii() and c.isalnum()]
    size = number = 0
    for k, base in places:
        c = text[k].lower()
        number = number * base + (int(c) if base == 10 else ord(c) - 97)
        size = (size or 1) * base
    shape = "".join("9" if c.isdigit() else "a" if c.isascii() and c.isalpha() else c for c in text)
    number = f.permute(number, size, f"{name}/{shape}/")
    out = list(text)
    for k, base in reversed(places):
        number, d = divmod(number, base)
        c = str(d) if base == 10 else chr(97 + d)
        out[k] = c.upper() if text[k].isupper() else c
    return "".join(out)


def email(f: Feistel, text: str) -> str | None:
    local, _, host = text.rpartition("@")
    if local[0] == "." or local[-1] == "." or ".." in local or len(local) > 64:
        return None
    return f"{_mixed(f, local, 'mail/' + host.lower())}@{host}"


def date(f: Feistel, text: str) -> str | None:
    a, sep, b, sep2, c = re.split(r"(\D)", text)
    if sep != sep2:
        return None
    orders = ("ymd",) if len(a) == 4 else (("mdy", "dmy") if sep == "/" else ("dmy", "mdy")) if len(c) == 4 else ()
    for order in orders:
        parts = dict(zip(order, (int(a), int(b), int(c)), strict=True))
        try:
            day = datetime.date(parts["y"], parts["m"], parts["d"]).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < DAYS:
            return None
        to = datetime.date.fromordinal(FIRST_DAY + f.permute(day, DAYS, "date"))
        wide = {"y": f"{to.year:04}", "m": f"{to.month:02}", "d": f"{to.day:02}"}
        short = any(len(x) == 1 for x in (a, b, c))
        return sep.join((wide[k].lstrip("0") if short and k != "y" else wide[k]) for k in order)
    return None


#: Kind -> pattern and pseudonym; the first that fits and validates wins.
_EDGE, _END = r"(?<![\w.+\-])", r"(?![\w\-]|\.\d)"
KINDS: dict[str, tuple[str, Callable[[Feistel, str], str | None]]] = {
    "email": (r"(?<![\w.+%\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w\-])", email),
    "iban": (_EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END, iban),
    "ip": (_EDGE + r"\d{1,3}(?:\.\d{1,3}){3}" + _END, ip),
    "date": (_EDGE + r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})" + _END, date),
    "ssn": (_EDGE + r"\d{3}-\d{2}-\d{4}" + _END, ssn),
    "card": (_EDGE + r"\d(?:[ -]?\d){12,18}" + _END, card),
    "phone": (r"(?<![\w.+\-])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[.\-])\d{3}[ .\-]\d{4}" + _END + r"|(?<![\w.+\-])\+\d{1,3}(?:[ .\-]?\d{2,4}){3,5}" + _END, phone),
}
_ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, (pattern, _) in KINDS.items()))
_EACH = {kind: re.compile(pattern) for kind, (pattern, _) in KINDS.items()}
_AFTER = re.compile(_END)
_WORTH = re.compile(r"@|\d\D{0,3}\d\D{0,3}\d")

#: First digits of card numbers and the lengths issued with them.
ISSUED = re.compile(
    r"4(?:\d{12}|\d{15}|\d{18})|3[47]\d{13}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|(?:30[0-5]|309|36\d|3[89]\d)\d{11,16}|35(?:2[89]|[3-8]\d)\d{12,15}|6(?:011|4[4-9]\d|5\d\d)\d{12,15}|62\d{14,17}|(?:50|5[6-9]|6[0137-9])\d{11,17}"
)
#: Country -> characters of its IBANs.
_IBAN = "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,TL,SO 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
IBAN_CHARS = {country: int(n) for n, _, countries in (x.partition(":") for x in _IBAN.split()) for country in countries.split(",")}
#: Country code -> least and most digits behind it.
_PHONE = "1:10:10 7:10:10 20:8:10 27:9:9 30:10:10 31:9:9 32:8:9 33:9:9 34:9:9 36:8:9 39:6:11 40:9:9 41:9:9 43:4:13 44:9:10 45:8:8 46:7:10 47:8:8 48:9:9 49:5:11 51:8:9 52:10:10 54:10:11 55:10:11 56:9:9 57:10:10 58:10:10 60:8:10 61:9:9 62:8:12 63:8:10 64:8:10 65:8:8 66:8:9 81:9:10 82:8:10 84:9:10 86:10:11 90:10:10 91:10:10 92:9:10 94:9:9 98:10:10 212:9:9 213:8:9 216:8:8 234:8:10 254:9:9 351:9:9 352:5:11 353:7:9 354:7:7 355:8:9 356:8:8 357:8:8 358:5:12 359:8:9 370:8:8 371:8:8 372:7:8 380:9:9 385:8:9 386:8:8 420:9:9 421:9:9 852:8:8 886:8:9 966:8:9 971:8:9 972:8:9"
PHONE_DIGITS = {code: (int(a), int(b)) for code, a, b in (x.split(":") for x in _PHONE.split())}


def _phone_fit(text: str) -> int:
    """0 for a number of its country's length written in one run, 1 for another of
    that length, 2 for a run of a country that is not listed, else 3."""
    digits = _digits(text)
    run = re.fullmatch(r"\+\d{10,15}", text) is not None
    code = next((digits[:n] for n in (1, 2, 3) if digits[:n] in PHONE_DIGITS), None) if text[0] == "+" else None
    if code is None:
        return 2 if run else 3
    least, most = PHONE_DIGITS[code]
    return (0 if run else 1) if least <= len(digits) - len(code) <= most else 3


def _card_fit(text: str) -> int:
    """0 for a number of a known issuer in the usual groups, 1 in others, else 2."""
    if not ISSUED.fullmatch(_digits(text)):
        return 2
    groups = [len(x) for x in re.split("[ -]", text)]
    usual = len(groups) == 1 or groups in ([4, 6, 5], [4, 6, 4]) or (set(groups[:-1]) == {4} and groups[-1] <= 4)
    return 0 if usual else 1


#: Kinds whose pattern can run on into what stands behind the value -> how well a
#: reading fits, 0 best; of readings that fit alike the longest is tried first.
FITS: dict[str, Callable[[str], int]] = {
    "iban": lambda text: int(len(text.replace(" ", "")) != IBAN_CHARS.get(text[:2])),
    "card": _card_fit,
    "phone": _phone_fit,
}


def _readings(kind: str, text: str, start: int, end: int) -> list[str]:
    """Every way to end a value of the kind at ``start``, in the order of trial."""
    if kind not in FITS:
        return [text[start:end]]
    pattern = _EACH[kind]
    ends = [end] + [e for e in range(end - 1, start + 9, -1) if _AFTER.match(text, e) and pattern.fullmatch(text, start, e)]
    return sorted((text[start:e] for e in ends), key=FITS[kind])


def _better_card(f: Feistel, text: str, start: int, end: int, fit: int) -> bool:
    """Whether a valid card that fits better begins between the places."""
    for s in range(start, end):
        if (own := _EACH["card"].match(text, s)) and any(_card_fit(x) < fit and card(f, x) is not None for x in _readings("card", text, s, own.end())):
            return True
    return False


def _value_at(text: str, start: int, f: Feistel) -> tuple[str, int, str] | None:
    """Kind, end and pseudonym of the value that begins at ``start``."""
    for kind, pattern in _EACH.items():  # another kind may be valid where the first is not
        if own := pattern.match(text, start):
            for value in _readings(kind, text, start, own.end()):
                if (new := KINDS[kind][1](f, value)) is not None:
                    end = start + len(value)
                    if kind == "card" and (fit := _card_fit(value)) and _better_card(f, text, start + 1, end, fit):
                        break  # a number before a card, read together with a part of it
                    return kind, end, new
    return None


def pseudonymise(text: str, f: Feistel) -> tuple[str, dict[str, int]]:
    """The text with every valid value replaced, and how many of each kind."""
    found: dict[str, int] = {}
    if not _WORTH.search(text):
        return text, found
    parts, at, done = [], 0, 0
    while m := _ANY.search(text, at):
        start = m.start()
        if value := _value_at(text, start, f):
            kind, end, new = value
            found[kind] = found.get(kind, 0) + 1
            parts += [text[done:start], new]
            at = done = end
        else:
            at = start + 1
    return ("".join(parts) + text[done:] if parts else text), found


def pseudonymise_documents(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id, text, n_found, kinds``: the text with pseudonyms,
    the number of replaced values and their kinds (sorted, comma-joined, '' if none).

    Null text stays null and empty text empty, both with nothing found.  Texts
    without personal data are returned unchanged.  Very long texts take time in
    proportion to their length.  Repeated rows give repeated
    results; an empty table gives no rows; other columns are ignored.  One narrow
    pass; rows are independent, so no value needs to be looked up elsewhere.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for rows in batches:
            for some in pieces(rows, 1):
                done = [(None, {}) if x is None else pseudonymise(x, f) for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([sum(n.values()) for _, n in done], pa.int64()), pa.array([",".join(sorted(n)) for _, n in done], pa.string())],
                    names=["doc_id", "text", "n_found", "kinds"],
                )

    return source.mapInArrow(run, f"doc_id {kind}, text string, n_found long, kinds string")


def with_pseudonyms(docs: DataFrame, key: bytes, *, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows with all their columns, the text with pseudonyms and, where there
    is such a column, its number of code points in ``chars_col``.  Null text stays
    null; an empty table gives no rows, with the same columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for rows in batches:
            for some in pieces(rows, at):
                texts = [None if x is None else pseudonymise(x, f)[0] for x in some.column(at).to_pylist()]
                columns = list(some.columns)
                columns[at] = pa.array(texts, rows.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
