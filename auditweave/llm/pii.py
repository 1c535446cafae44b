"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Found values are validated (check digits, calendar, ranges) and mapped by a keyed permutation of their own format: a
Feistel network over the value's index in the format's domain, walked on until it is valid again. So a
pseudonym looks like what it stands for, passes the same validation, and equal values get equal pseudonyms in every
document, without a table; who has the key can map back. Punctuation and spacing stay as they are.

Kinds: card (13 to 19 digits that begin as an issuer's do and pass the Luhn check; the first digit stays, the check digit is computed anew), iban (mod
97; country and
letters' places stay), phone (international or North American layout; the country code stays), ssn (valid areas and
groups), ip (four octets of up to 255; reserved first octets 0, 127 and 255 are left), date (day-month-year, or year-month-day between hyphens,
slashes or dots, from 1900 to 2099, that exist),
email (letters and digits of the local part), secret (hexadecimal strings of 32 or more that a key or token name precedes).

Defined results: null texts stay null, with nothing found; where findings overlap the first in the text wins, of those
that begin together the kind named first above (of cards the longest), and what isn't valid hides no other. Where numbers adjoin
the text alone may not map back: a pseudonym and what follows can pass as a card by chance, `found` tells the places; digits inside words or longer
numbers are left; rows that repeat are each mapped;
an empty table gives no rows; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import arrow_limits, map_rows, unused

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Cipher:
    """Keyed permutations of range(n), one for each kind and n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def round(self, kind: str, i: int, value: int, n: int) -> int:
        h = hashlib.blake2b(f"{kind}|{i}|{n}|{value}".encode(), key=self.key, digest_size=16 + (n.bit_length() + 7) // 8)
        return int.from_bytes(h.digest(), "big")

    def once(self, kind: str, x: int, n: int, back: bool) -> int:
        """A Feistel network over a x b >= n."""
        a = 1 << (n - 1).bit_length() // 2
        b = -(-n // a)
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self.round(kind, i, left, n)) % b
            else:
                left = (left + sign * self.round(kind, i, right, n)) % a
        return left * b + right

    def permute(self, kind: str, x: int, n: int, valid=None, back: bool = False) -> int:
        """Walks the network from x, in range(n) and valid, to the next number that is so too."""
        if n < 2:
            return x
        while True:
            x = self.once(kind, x, n, back)
            if x < n and (valid is None or valid(x)):
                return x


def luhn_sum(digits: str) -> int:
    return sum(int(c) if i % 2 else (int(c) * 2 - 9 * (c > "4")) for i, c in enumerate(reversed(digits)))


def check_digit(payload: str) -> str:
    return str(-luhn_sum(payload) % 10)


#: Other scripts' digits aren't digits here: what was written for them couldn't be told from what they stand for.
DIGITS = frozenset("0123456789")


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def refill(text: str, digits: str) -> str:
    """text with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in text)


def as_number(text: str) -> tuple[int, list[int]]:
    """The index of text among those with its pattern of digits and letters, and each place's size."""
    value, sizes = 0, []
    for c in text:
        size = 10 if c in "0123456789" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 1
        sizes.append(size)
        value = value * size + (int(c) if size == 10 else ord(c.lower()) - 97 if size == 26 else 0)
    return value, sizes


def from_number(value: int, sizes: list[int], like: str) -> str:
    out = []
    for size, c in zip(reversed(sizes), reversed(like), strict=True):
        value, d = divmod(value, size)
        out.append(str(d) if size == 10 else chr((65 if c.isupper() else 97) + d) if size == 26 else c)
    return "".join(reversed(out))


def domain(sizes: list[int]) -> int:
    n = 1
    for s in sizes:
        n *= s
    return n


# Each kind has a function (text, cipher, back) -> pseudonym, or None if the text isn't valid.


#: Leading digits of card numbers and the lengths of such numbers. Public issuer ranges.
ISSUERS = [
    ("4", (13, 16, 19)), ("51-55", (16,)), ("2221-2720", (16,)), ("34", (15,)), ("37", (15,)), ("36", range(14, 20)), ("38-39", range(14, 20)),
        ("300-305", range(14, 20)),
    ("3528-3589", range(16, 20)), ("6011", range(16, 20)), ("62", range(16, 20)), ("644-649", range(16, 20)), ("65", range(16, 20)),
    ("5018", range(13, 20)), ("5020", range(13, 20)), ("5038", range(13, 20)), ("5893", range(13, 20)), ("6304", range(13, 20)), ("6759", range(13, 20)),
        ("6761-6763", range(13, 20)),
]


def issued(digits: str) -> bool:
    """Whether a card number of this length may begin so."""
    for span, lengths in ISSUERS:
        low, _, high = span.partition("-")
        if len(digits) in lengths and low <= digits[: len(low)] <= (high or low):
            return True
    return False


def card(text, cipher, back):
    d = only_digits(text)
    if not 13 <= len(d) <= 19 or luhn_sum(d[:-1]) % 10 != -int(d[-1]) % 10 or not issued(d):
        return None
    size = len(d) - 2
    same = lambda x: issued(d[0] + f"{x:0{size}d}0")
    payload = d[0] + f"{cipher.permute(f'card{d[0]}', int(d[1:-1]), 10**size, same, back):0{size}d}"
    return refill(text, payload + check_digit(payload))


def iban(text, cipher, back):
    plain = text.replace(" ", "")
    spell = lambda s: "".join(str(int(c, 36)) for c in s)
    if not 15 <= len(plain) <= 34 or int(spell(plain[4:] + plain[:4])) % 97 != 1:
        return None
    value, sizes = as_number(plain[4:])
    body = from_number(cipher.permute(f"iban{plain[:2]}{sizes}", value, domain(sizes), None, back), sizes, plain[4:])
    it = iter(plain[:2] + f"{98 - int(spell(body + plain[:2] + '00')) % 97:02d}" + body)
    return "".join(c if c == " " else next(it) for c in text)


#: Country codes of compact numbers: one digit, two, or else three.
COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})")


def phone(text, cipher, back):
    own = text
    if text.startswith("+"):
        code = re.match(r"\+[0-9]{1,3}(?=\D)", text) or COUNTRY.match(text)
        own = text[code.end() :]
    d = only_digits(own)
    if not 7 <= len(d) <= 12:
        return None
    return text[: len(text) - len(own)] + refill(own, f"{cipher.permute(f'phone{len(d)}', int(d), 10 ** len(d), None, back):0{len(d)}d}")


def valid_ssn(x: int) -> bool:
    area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def ssn(text, cipher, back):
    x = int(only_digits(text))
    return refill(text, f"{cipher.permute('ssn', x, 10**9, valid_ssn, back):09d}") if valid_ssn(x) else None


def ip(text, cipher, back):
    octets = [int(p) for p in text.split(".")]
    valid = lambda x: x >> 24 not in (0, 127, 255)
    x = sum(o << 8 * (3 - i) for i, o in enumerate(octets))
    if max(octets) > 255 or not valid(x) or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    x = cipher.permute("ip", x, 1 << 32, valid, back)
    return ".".join(str(x >> 8 * i & 255) for i in (3, 2, 1, 0))


def date(text, cipher, back):
    parts = re.split(r"[-/.]", text)
    iso = len(parts[0]) == 4
    y, m, d = map(int, parts if iso else parts[::-1])
    swapped = not iso and m > 12 >= d  # month first
    if swapped:
        m, d = d, m
    try:
        x = datetime.date(y, m, d).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= x <= LAST_DAY - FIRST_DAY:
        return None
    widths = [len(p) for p in parts]

    def write(x):
        t = datetime.date.fromordinal(FIRST_DAY + x)
        new = [t.year, t.month, t.day] if iso else [t.month, t.day, t.year] if swapped else [t.day, t.month, t.year]
        return new

    def same_format(x):
        """What is written for x must be read as x again, in fields of the same widths."""
        new = write(x)
        narrow = all(len(str(v)) <= w if w != 1 else v < 10 for v, w in zip(new, widths, strict=True))
        return narrow and (not swapped or new[1] > 12)

    if swapped and not same_format(x):
        return None
    new = iter(write(cipher.permute(f"date{iso}{swapped}{widths}", x, LAST_DAY - FIRST_DAY + 1, same_format, back)))
    return re.sub(r"[0-9]+", lambda g: f"{next(new):0{len(g[0])}d}", text)


#: Characters of a local part that are permuted at once; longer ones, which no mail server takes, go piece by piece.
LOCAL_PIECE = 64


def email(text, cipher, back):
    local, _, host = text.partition("@")
    out = []
    for at in range(0, len(local), LOCAL_PIECE):
        piece = local[at : at + LOCAL_PIECE]
        value, sizes = as_number(piece)
        place = f"{at}:" if at else ""
        out.append(from_number(cipher.permute(f"email{place}{sizes}@{host.lower()}", value, domain(sizes), None, back), sizes, piece))
    return "".join(out) + "@" + host if domain(as_number(local[:LOCAL_PIECE])[1]) > 1 or len(local) > LOCAL_PIECE else None


def secret(text, cipher, back):
    n = len(text)
    upper = text.upper() == text
    if not upper and text.lower() != text:
        return None
    # letters and digits may change places: what is kept is the length, the case and that it is hexadecimal
    valid = lambda x: any(c in "abcdef" for c in f"{x:0{n}x}")
    if not valid(int(text, 16)):
        return None
    out = f"{cipher.permute(f'secret{n}{upper}', int(text, 16), 16**n, valid, back):0{n}x}"
    return out.upper() if upper else out


KINDS = {"card": card, "iban": iban, "phone": phone, "ssn": ssn, "ip": ip, "date": date, "email": email, "secret": secret}
#: Where formats that begin with a digit, a plus or a parenthesis may start, and what each looks like there.
START = re.compile(r"(?<![\w.,+-])(?:[0-9]|\+[0-9]|\([0-9])")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,18}")
NUMBERS = {
    "phone": re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![\w-])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\w-])|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "ip": re.compile(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\w|\.[0-9])"),
    "date": re.compile(r"(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![\w/-])"),
}
MORE = re.compile(r"[\w-]")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
LOCAL, HOST = re.compile(r"[A-Za-z0-9._%+'À-ɏ-]*"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?!\w)")
SECRET = re.compile(r"(?i:key|token|secret|password|passwd|pwd)\w*[\"']?\s*[:=]\s*[\"']?(?P<secret>[0-9a-fA-F]{32,})(?!\w)")
DIGIT, CAPITALS = re.compile(r"[0-9]"), re.compile(r"[A-Z]{2}[0-9]{2}")


def candidates(text: str):
    """(start, end, kind) of what has the look of a kind."""
    if "@" in text:
        past, at = 0, text.find("@")
        while at >= 0:
            local, host = LOCAL.match(text[past:at][::-1]).end(), HOST.match(text, at + 1)  # read backwards, as far as it goes
            if local and host:
                yield at - local, host.end(), "email"
            past, at = at + 1, text.find("@", at + 1)
    if DIGIT.search(text):
        for start in START.finditer(text):  # all kinds from every start: what isn't valid hides nothing
            at = start.start()
            if m := CARD.match(text, at):
                ends = [at + i + 1 for i, c in enumerate(m[0]) if c in DIGITS]
                for end in reversed(ends[12:]):  # the longest first
                    if not MORE.match(text, end):
                        yield at, end, "card"
            for kind, look in NUMBERS.items():
                if m := look.match(text, at):
                    yield at, m.end(), kind
        if CAPITALS.search(text):
            for m in IBAN.finditer(text):
                yield m.start(), m.end(), "iban"
        for m in SECRET.finditer(text):
            yield m.start("secret"), m.end("secret"), "secret"


def pseudonymise(text: str, cipher: Cipher, back: bool = False) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and for each its kind, place and length in the original and what it became."""
    out, found, done = [], [], 0
    rank = list(KINDS).index
    for start, end, kind in sorted(candidates(text), key=lambda c: (c[0], rank(c[2]))):
        if start < done:
            continue
        new = KINDS[kind](text[start:end], cipher, back)
        if new is None:
            continue
        out += [text[done:start], new]
        found.append({"kind": kind, "first": start, "length": end - start, "pseudonym": new})
        done = end
    return "".join([*out, text[done:]]), found


@lru_cache(4)
def cipher_of(key: bytes) -> Cipher:
    return Cipher(key)


FOUND = "array<struct<kind:string, first:long, length:long, pseudonym:string>>"


def mask(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """docs with pseudonyms in text; two columns follow: n_found and found, with underscores where docs has columns of these names."""
    arrow_limits(docs.sparkSession)
    names, more = docs.columns, unused(docs, "n_found", "found")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("length", pa.int64()), ("pseudonym", pa.string())]))

    def run(batches):
        own = cipher_of(key)
        for b in batches:
            texts, found = [], []
            for t in b.column("text").to_pylist():
                t, f = (None, []) if t is None else pseudonymise(t, own, back)
                texts.append(t)
                found.append(f)
            b = b.set_column(names.index("text"), "text", pa.array(texts, b.column("text").type))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(f) for f in found], pa.int64()), pa.array(found, kind)], names=[*names, *more])

    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(f"`{more[0]}` long, `{more[1]}` {FOUND}").fields])
    return map_rows(docs, run, schema)


#: The setting that holds the key, a secret of whoever runs it: given when the application starts, as Spark leaves such settings out of its logs by this last
#: word only then.
KEY_SETTING = "spark.auditweave.pii.secret"
#: Keys drawn for sessions that have none: they are in this process alone.
_drawn: dict[str, str] = {}


def session_key(spark: SparkSession) -> bytes:
    """The application's key. Where none is given a random one is drawn, and kept in this process: values are linked within the session, and no one
    can map back later.

    Raises ValueError for a key that was set in a running session: event logs would tell it."""
    given = spark.sparkContext.getConf().get(KEY_SETTING)
    if spark.conf.get(KEY_SETTING, None) != given:
        raise ValueError(f"give {KEY_SETTING} when the application starts, or the key itself to mask(): settings of a session are written to event logs")
    return (given or _drawn.setdefault(spark._jsparkSession.sessionUUID(), secrets.token_hex(32))).encode()
