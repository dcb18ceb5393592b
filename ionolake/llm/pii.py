"""PII as format-preserving pseudonyms: validated values are permuted within their own format by a keyed Feistel network.

Kinds, in order of precedence where spans overlap: secrets (quoted hexadecimal of 32 digits or more, keys of known prefixes, and what is assigned to a name such as token or password if it has 16 characters or more, letters and
digits among them), e-mail addresses, IBANs (mod 97), card numbers (13 to 19 digits, Luhn), US
social security numbers (SSA ranges), IPv4 addresses (octets to 255), phone numbers (+ and 8 to 15 digits, or national (ddd) ddd-dddd and ddd-ddd-dddd), and calendar dates
(YYYY-MM-DD, DD.MM.YYYY, MM/DD/YYYY) that exist. What looks like one but isn't valid (a number that fails its check digit, 31 February) is left alone.

A candidate may hold more than the value (digits or capitals that stand after or before it). The parts of it that the layout suggests are tried first (cards in their usual groups or as one
run, IBANs of their country's length, phones of their country's number of digits), then the whole, then its shorter ends at separators; if none is valid, the search goes on one character
after the candidate's start. reveal() reads by the same order; where a neighbour makes the layout ambiguous (numbers in fours before a card), a longer reading of the pseudonym can be valid by chance.

A value of N possibilities is numbered, the number goes through a balanced Feistel network over the least even number of bits that holds N (rounds of keyed BLAKE2b), walking the
cycle until it falls under N, and is written back in the value's own layout: separators, case and length stay, check digits are computed anew, dates stay dates. It is a permutation
of the format, so equal values get equal pseudonyms in every document and different values stay different; reveal() inverts it with the key.

Everything happens within a row: no shuffle, no state between tasks. Values that differ in layout only (4111-1111... and 4111 1111...) are numbered by their digits, so they stay linked too.

Cases: null text stays null with 0 found, empty text stays empty; repeated rows get equal pseudonyms; a text is scrubbed whole, however long; an empty table gives no rows; a null doc_id is returned as null; other columns are untouched, whatever their names. A text takes time in proportion to its length.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key for tests and examples, which anyone can read here: whoever wants it passes it by name. Production passes its own, or sets it as SECRET in the session.
EXAMPLE_KEY = b"ionolake-example-key"
SECRET = "spark.ionolake.pii.secret"
ROUNDS = 8
KINDS = ("secret", "email", "iban", "card", "ssn", "ip", "phone", "date")
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY

#: What keys of well-known services begin with, and words that a secret is assigned to.
_PREFIX = r"sk-(?:proj-|live-|test-)?|AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|AIza|eyJ"
_NAMED = r"(?:api[_-]?key|access[_-]?key|private[_-]?key|token|secret|passw(?:or)?d)"
#: Texts, one of which is in every text that matches _PREFIX, or, lower-cased, _NAMED.
_PREFIX_MARKS = ("sk-", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "AIza", "eyJ")
_NAMED_MARKS = ("apikey", "accesskey", "privatekey", "_key", "-key", "token", "secret", "passw")
_KEYS = rf"""|(?<![A-Za-z0-9_])(?:{_PREFIX})(?=[A-Za-z0-9_.-]{{0,40}}[0-9])[A-Za-z0-9_-]{{16,}}(?:\.[A-Za-z0-9_-]+)*)
    |(?P<named>(?i:{_NAMED})["']?[ ]?[=:][ ]?["']?(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{{16,}}={{0,2}}"""
#: The part before an address's @ has 64 characters at most, its domain eleven labels of 63. It begins where its characters do, or, in a longer run of them (percent-encoded text), 64 before the @: each place is looked at for
#: at most 64 characters, so any text takes time in proportion to its length.
_DOMAIN = r"@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,9}\.[A-Za-z]{2,63}"
_LOCAL = r"[\w.+%-]"
_EMAILS = ("", rf"|(?P<email>(?<!{_LOCAL}){_LOCAL}{{1,64}}{_DOMAIN})", rf"|(?P<email>(?:(?<!{_LOCAL})|(?={_LOCAL}{{64}}@)){_LOCAL}{{1,64}}{_DOMAIN})")
_NEXT_EMAIL = re.compile(rf"(?P<email>{_LOCAL}{{1,64}}{_DOMAIN})", re.ASCII)
_LONG_LOCAL = re.compile(rf"{_LOCAL}{{65}}", re.ASCII)
_CANDIDATES = {
    (bool(keys), n): re.compile(
        rf"""(?P<secret>(?<=["'])[0-9A-Fa-f]{{32,}}(?=["']){keys})
    {email}
    """
        r"""
    |(?P<iban>\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b)
    |(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9]|\.[0-9])|(?<![\w])\([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![\w.+-])[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}(?![\w-]))
    |(?P<date>(?<![\d./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\d/-]))
    |(?P<ssn>(?<![\d-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\d-]))
    |(?P<ip>(?<![\d.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\d]|\.\d))
    |(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))""",
        re.VERBOSE | re.ASCII,
    )
    for keys in ("", _KEYS)
    for n, email in enumerate(_EMAILS)
}
#: Every candidate has one of these; a text without needs no further look.
_HINT = re.compile(r"@|[0-9][^\n]{0,3}[0-9]|[\"'][0-9A-Fa-f]{32}", re.ASCII)


#: Lengths of IBANs by country.
_IBAN_LENGTHS = {k: n for n, names in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for k in names.split()}
#: Digits after the country code, at most, of countries whose numbers have a settled length.
_PHONE_DIGITS = {k: n for n, names in {8: "45 47 65", 9: "27 31 33 34 36 40 41 48 51 56 61 351 380 420", 10: "1 7 20 30 44 52 57 63 81 90 91 92", 11: "49 55 86"}.items() for k in names.split()}
_CARD_GROUPS = re.compile(r"(?<![0-9-])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}|[0-9]{13,19})(?![0-9-])")


def _parts(kind: str, value: str) -> Iterator[tuple[int, int]]:
    """Where the value may lie in a candidate, in the order to be tried."""
    ends = [m.start() for m in re.finditer(r"[ .-]", value)]
    if kind == "named":
        yield re.match(r"[^=:]*[=:][ ]?[\"']?", value).end(), len(value)
    elif kind == "card":
        at = 0
        while m := _CARD_GROUPS.search(value, at):
            yield m.span()
            at = m.start() + 1
        yield 0, len(value)
        yield from ((0, e) for e in reversed(ends) if 13 <= len(_digits(value[:e])))
    elif kind == "iban":
        sizes = {e: e - value[:e].count(" ") for e in (*ends, len(value))}
        yield from ((0, e) for e, n in sizes.items() if n == _IBAN_LENGTHS.get(value[:2]))
        yield 0, len(value)
        yield from ((0, e) for e in reversed(ends) if sizes[e] >= 15)
    elif kind == "phone" and value[0] == "+":
        country = re.match(r"\+([0-9]{1,3})(?=[ .(-])", value)
        if country:
            most = len(country[1]) + _PHONE_DIGITS.get(country[1], 15) + ("(0)" in value)
            yield from ((0, e) for e in (len(value), *reversed(ends)) if 8 <= len(_digits(value[:e])) <= most)
        else:
            yield from ((0, e) for e in ends if 8 <= len(_digits(value[:e])))
        yield 0, len(value)
        yield from ((0, e) for e in reversed(ends))
    else:
        yield 0, len(value)


def _feistel(value: int, n: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A permutation of 0..n-1."""
    if n < 2:
        return value
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8
    while True:
        a, b = value >> half, value & mask
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            word = a if inverse else b
            # blocks of 64 bytes of keyed hash, as many as half a value needs
            stream = b"".join(blake2b(word.to_bytes(size, "big") + block.to_bytes(2, "big"), key=key[:64], salt=bytes([r]), person=tweak[:16]).digest() for block in range(-(-size // 64)))
            f = int.from_bytes(stream[:size], "big") & mask
            a, b = (b ^ f, a) if inverse else (b, a ^ f)
        value = a << half | b
        if value < n:
            return value


def _luhn(digits: str) -> int:
    """The check digit that these digits want after them."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _refill(layout: str, chars: str) -> str:
    """The layout with its letters and digits replaced in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in layout)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _mixed(chars: str, key: bytes, tweak: bytes, inverse: bool, hexa: bool = False) -> str:
    """Letters to letters of their case, digits to digits, together as one number (hexa: hexadecimal digits in the value's own case)."""
    if hexa:
        n = int(chars, 16)
        out = f"{_feistel(n, 16 ** len(chars), key, tweak, inverse):0{len(chars)}x}"
        return out.upper() if chars.upper() == chars else out
    sets = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in chars]
    value, total = 0, 1
    for c, s in zip(chars, sets, strict=True):
        value, total = value * len(s) + s.index(c), total * len(s)
    value = _feistel(value, total, key, tweak, inverse)
    out = []
    for s in reversed(sets):
        value, at = divmod(value, len(s))
        out.append(s[at])
    return "".join(reversed(out))


_DATE_LAYOUTS = ((re.compile(r"\d{4}-\d{2}-\d{2}"), "%Y-%m-%d"), (re.compile(r"\d{2}\.\d{2}\.\d{4}"), "%d.%m.%Y"), (re.compile(r"\d{2}/\d{2}/\d{4}"), "%m/%d/%Y"))


def _ssn_number(d: str) -> int | None:
    """The place of a social security number among the valid ones: areas 001 to 899 without 666, groups and serials from 1."""
    area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    return ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes, inverse: bool = False) -> str | None:
    """The value's pseudonym (inverse: the value of a pseudonym); None if it isn't valid as that kind."""
    tweak = kind.encode()
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", value):
            return _mixed(value, key, tweak, inverse, hexa=True)
        keep = re.match(_PREFIX, value)
        head = keep[0] if keep else ""
        return head + _refill(value[len(head) :], _mixed(re.sub(r"[^A-Za-z0-9]", "", value[len(head) :]), key, tweak, inverse))
    if kind == "email":
        user, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        chars = re.sub(r"[^A-Za-z0-9]", "", user + host)
        return _refill(f"{user}@{host}", _mixed(chars, key, tweak, inverse)) + "." + top
    if kind == "iban":
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
            return None
        body = plain[:2] + "00" + _mixed(plain[4:], key, tweak, inverse)
        return _refill(value, body[:2] + f"{98 - _mod97(body):02d}" + body[4:])
    if kind == "card":
        d = _digits(value)
        if _luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return None
        body = d[:-1]
        while True:  # walk on past numbers of one repeated digit, which don't count as cards
            body = f"{_feistel(int(body), 10 ** len(body), key, tweak, inverse):0{len(body)}d}"
            out = body + str(_luhn(body))
            if len(set(out)) > 1:
                return _refill(value, out)
    if kind == "ssn":
        n = _ssn_number(_digits(value))
        if n is None:
            return None
        area, rest = divmod(_feistel(n, 898 * 99 * 9999, key, tweak, inverse), 99 * 9999)
        area += 1 + (area >= 665)
        return f"{area:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None
        n = _feistel(int.from_bytes(bytes(octets), "big"), 1 << 32, key, tweak, inverse)
        return ".".join(str(b) for b in n.to_bytes(4, "big"))
    if kind == "phone":
        d = _digits(value)
        if not 8 <= len(d) <= 15:
            return None
        country = re.match(r"\+([0-9]{1,3})(?=[ .(-])", value)
        keep = len(country[1]) if country else 0  # a country code that is set off stays
        return _refill(value, d[:keep] + _mixed(d[keep:], key, tweak + d[:keep].encode(), inverse))
    if kind == "date":
        for pattern, layout in _DATE_LAYOUTS:
            if pattern.fullmatch(value):
                try:
                    day = datetime.datetime.strptime(value, layout).date().toordinal() - _FIRST_DAY
                except ValueError:
                    return None
                if not 0 <= day < _DAYS:
                    return None
                return datetime.date.fromordinal(_FIRST_DAY + _feistel(day, _DAYS, key, tweak, inverse)).strftime(layout)
    return None


def _emails_in(text: str) -> int:
    """0: the text has no @; 1: it has; 2: one follows on a run of more characters than an address has before it."""
    at = text.find("@")
    if at < 0:
        return 0
    while at >= 0:
        if at > 64 and _LONG_LOCAL.match(text, at - 65, at):
            return 2
        at = text.find("@", at + 1)
    return 1


def scrub(text: str, key: bytes, inverse: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and the spans (start, end, kind) of the values in the text given."""
    low = text.lower()
    keys = any(x in text for x in _PREFIX_MARKS) or any(x in low for x in _NAMED_MARKS)
    if not keys and not _HINT.search(text):
        return text, []
    candidate = _CANDIDATES[keys, _emails_in(text)]
    out, at, found = [], 0, []
    look = 0
    # an address may follow on another value at once
    while m := (found and look == at and "@" in text[at : at + 65] and _NEXT_EMAIL.match(text, at)) or candidate.search(text, look):
        kind, value, look = m.lastgroup, m.group(), m.start() + 1
        parts = _parts(kind, value)
        kind = "secret" if kind == "named" else kind
        for a, b in parts:
            new = pseudonym(kind, value[a:b], key, inverse)
            if new is not None:
                start, look = m.start() + a, m.start() + b
                out += [text[at:start], new]
                at = look
                found.append((start, at, kind))
                break
    return "".join([*out, text[at:]]) if found else text, found


def reveal(text: str, key: bytes) -> str:
    """The text that scrub() made this of."""
    return scrub(text, key, inverse=True)[0]


def key_of(spark: SparkSession, without: bytes | None = None) -> bytes:
    """The session's key (SECRET, which Spark masks in its logs). Where it is unset: the key given as without, or an error, since a key that is known protects nobody."""
    key = spark.conf.get(SECRET, None)
    if key:
        return key.encode()
    if without is None:
        raise RuntimeError(f"{SECRET} is not set: pseudonyms need a secret key")
    return without


def scrub_documents(docs: DataFrame, key: bytes, spans: str | None = "pii") -> DataFrame:
    """docs with text pseudonymised, and a column of that name (with _ after it if docs has one; None: without): an array of (start, end, kind) in the original text (null where text is)."""

    @F.pandas_udf("text string, pii array<struct<start:int,end:int,kind:string>>")
    def run(texts):
        import pandas as pd

        done = [(None, None) if t is None else scrub(t, key) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in done], "pii": [s and [{"start": a, "end": b, "kind": k} for a, b, k in s] if s is not None else None for _, s in done]})

    def free(name: str) -> str:
        return name if name not in docs.columns else free(name + "_")

    held = free("_pii")
    done = docs.withColumn(held, run("text"))
    columns = [F.col(f"`{held}`.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*columns, *([F.col(f"`{held}`.pii").alias(free(spans))] if spans else []))


def scrub_report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text (pseudonymised), n_found, and a count for each kind: a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                done = [(None, []) if t is None else scrub(t, key) for t in part.column(1).to_pylist()]
                counts = {k: pa.array([sum(s[2] == k for s in x) for _, x in done], pa.int64()) for k in KINDS}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "text": pa.array([t for t, _ in done], pa.string()), "n_found": pa.array([len(x) for _, x in done], pa.int64()), **{f"n_{k}": v for k, v in counts.items()}})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, n_found long, " + ", ".join(f"n_{k} long" for k in KINDS))
