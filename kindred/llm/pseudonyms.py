"""PII: format-preserving Feistel pseudonyms.

Values are found by pattern and validated (check digits, ranges, calendar).  A valid value is ranked among all values of
its format, the rank is permuted by a keyed Feistel network, and the result is written in the format of the value: equal
values get equal pseudonyms wherever they stand and however they are punctuated, different values of a format get
different ones, and a pseudonym is itself valid.  The permutation is the network conjugated with a step by one, so it has
no fixed point: no value of a format with two or more members stays as it is.

Formats: card numbers (the issuer's digits stay, the check digit is made anew), social security numbers, IBANs, phone numbers, IPv4
and IPv6 addresses, dates (1900 to 2099, in figures or with a month's name in four languages), e-mail names (one permutation for all cases), and credentials (access keys,
signed web tokens, and values given to a name that ends in a word such as ``password``, in any case and of any length), where letters stay letters of their case and digits stay digits.
All notations of a date share one permutation, of days up to the 12th and of later ones, as a later day tells ``month/day`` from ``day/month``.

The key is a parameter; :func:`session_key` takes it from the session's setting, or makes one that lies in the cluster's shared folder.
Who holds the key can undo the pseudonyms (``reverse``), up to leading zeros of days and months and the short form of IPv6.

Defined cases: a null text stays null, with no values; a text without values is returned unchanged; invalid look-alikes are
left alone.  Repeated rows are changed alike; an empty table gives an empty result; other columns are carried along, and
one named like a result column is replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, types as T

from kindred.llm.workspace import filesystem, shared_folder, ship

ROUNDS = 8
#: Characters that are permuted as one number; longer values are permuted piece by piece.
PIECE = 256
KEY_SETTING, KEY_FILE = "spark.kindred.pseudonyms.key", "pseudonyms.key"


def session_key(spark: SparkSession) -> bytes:
    """The key that the session sets, or one that is made once for all sessions that share a folder."""
    if given := spark.conf.get(KEY_SETTING, None):
        return given.encode()
    store, root = filesystem(shared_folder(spark))
    path = f"{root}/{KEY_FILE}"
    if store.get_file_info(path).type == fs.FileType.NotFound:
        store.create_dir(root, recursive=True)
        with store.open_output_stream(path) as out:
            out.write(secrets.token_bytes(32))
    with store.open_input_stream(path) as file:
        return file.read()


class Permutation:
    """Keyed permutation of ``range(n)`` by an unbalanced Feistel network on ``range(a * b)`` with cycle walking."""

    def __init__(self, n: int, key: bytes, tweak: str) -> None:
        self.n, self.a = n, math.isqrt(max(0, n - 1)) + 1
        self.b = -(-n // self.a)
        self.key, self.tweak = hashlib.blake2b(key, digest_size=32).digest(), tweak.encode()

    def _round(self, i: int, x: int, size: int) -> int:
        data = b"%d|%s|%d|%d" % (i, self.tweak, self.n, x)
        width = 16 + (size.bit_length() + 7) // 8
        if width <= hashlib.blake2b.MAX_DIGEST_SIZE:
            return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=width).digest(), "big") % size
        blocks = (hashlib.blake2b(b"%s|%d" % (data, k), key=self.key).digest() for k in range(-(-width // hashlib.blake2b.MAX_DIGEST_SIZE)))
        return int.from_bytes(b"".join(blocks), "big") % size

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + self._round(i, left, self.b)) % self.b
            else:
                left = (left + self._round(i, right, self.a)) % self.a
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(ROUNDS)):
            if i % 2:
                right = (right - self._round(i, left, self.b)) % self.b
            else:
                left = (left - self._round(i, right, self.a)) % self.a
        return left * self.b + right

    def _encrypt(self, x: int) -> int:
        while (x := self._once(x)) >= self.n:
            pass
        return x

    def _decrypt(self, x: int) -> int:
        while (x := self._back(x)) >= self.n:
            pass
        return x

    def forward(self, x: int) -> int:
        return self._decrypt((self._encrypt(x) + 1) % self.n)

    def inverse(self, x: int) -> int:
        return self._decrypt((self._encrypt(x) - 1) % self.n)


def luhn_digit(body: str) -> str:
    """The check digit that makes ``body`` plus it valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _assigned(own: str) -> bool:
    return own[0] not in "01" and own[3] not in "01"


def _refill(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced by ``chars``, punctuation kept."""
    found = iter(chars)
    return "".join(next(found) if c.isascii() and c.isalnum() else c for c in shape)


#: Character classes, each permuted within itself.
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST_DAY + 1
#: Days after the 12th, and the others, each with its rank among them.
_BY_LATE = {late: [d for d in range(_FIRST_DAY, _FIRST_DAY + _DAYS) if (datetime.date.fromordinal(d).day > 12) == late] for late in (True, False)}
_DAY_RANK = {d: i for days in _BY_LATE.values() for i, d in enumerate(days)}
#: Months by language.
MONTHS = {
    "en": "January February March April May June July August September October November December",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
_MONTHS = {language: names.split() for language, names in MONTHS.items()}
_MONTH_OF = {language: {n.casefold(): i for i, n in enumerate(names)} for language, names in _MONTHS.items()}
_ANY_MONTH = "|".join(sorted({n.lower() for names in _MONTHS.values() for n in names}, key=lambda n: (-len(n), n)))
#: Digits and lengths of the card networks; the first four digits tell the network.
_CARD = re.compile(
    r"4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11,16}"
    r"|35(?:2[89]|[3-8][0-9])[0-9]{12,15}|(?:50|5[6-9]|6[0-9])[0-9]{11,17}"
)

_BEFORE, _AFTER = r"(?<![0-9A-Za-z_.\-])", r"(?![0-9A-Za-z_])"
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?P<secret>(?P<word>(?ai:password|passwd|pwd|token|secret|api[_\-]?key))(?P<is>\"?\s{0,3}[:=]\s{0,3}[\"']?)(?P<value>[A-Za-z0-9+/_\-]{8,}))"
    rf"|(?P<access>{_BEFORE}(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}|gh[pousr]_[0-9A-Za-z]{{36,}}|eyJ[0-9A-Za-z_\-]{{8,}}\.[0-9A-Za-z_\-]{{8,}}\.[0-9A-Za-z_\-]{{8,}}){_AFTER})"
    rf"|(?P<iban>{_BEFORE}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_AFTER})"
    rf"|(?P<iso>{_BEFORE}(?P<y1>(?:19|20)[0-9]{{2}})(?P<s1>[\-/.])(?P<m1>[0-9]{{1,2}})(?P=s1)(?P<d1>[0-9]{{1,2}})(?![0-9A-Za-z_.\-/]*[0-9]))"
    rf"|(?P<dmy>{_BEFORE}(?P<d2>[0-9]{{1,2}})(?P<s2>[\-/.])(?P<m2>[0-9]{{1,2}})(?P=s2)(?P<y2>(?:19|20)[0-9]{{2}})(?![0-9A-Za-z_\-/]|\.[0-9]))"
    rf"|(?P<named>{_BEFORE}(?:(?P<d3>[0-9]{{1,2}})(?P<o3>er|\.|º)? (?P<p3>de )?(?P<b3>(?i:{_ANY_MONTH}))(?P<q3> de | )(?P<y3>(?:19|20)[0-9]{{2}})|(?P<b4>(?i:{'|'.join(_MONTHS['en'])})) (?P<d4>[0-9]{{1,2}}), (?P<y4>(?:19|20)[0-9]{{2}})){_AFTER})"
    r"|(?P<ip6>(?<![0-9A-Za-z_.:\-])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{6,39}(?<!:)(?![0-9A-Za-z_:]))"
    rf"|(?P<ip>{_BEFORE}(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?!\.?[0-9A-Za-z_]))"
    rf"|(?P<ssn>{_BEFORE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z_\-]))"
    r"|(?P<phone>(?<![0-9A-Za-z_+.])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?(?:[0-9]{2,4}[ .\-]?){1,4}[0-9]{2,4}|\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9A-Za-z_]))"
    rf"|(?P<card>{_BEFORE}[0-9](?:[ \-]?[0-9]){{12,18}}(?![0-9A-Za-z_]|[\-][0-9]))",

)
#: Of a text in lower case: a search that ignores case is three times as slow.
#: Plain words, which after a colon and without quotes are prose; a pseudonym of such a value would be of the same form.
_WORDS = re.compile(r"(?:[A-Za-z][a-z]*|[A-Z]+)(?:[\-/_](?:[A-Za-z][a-z]*|[A-Z]+))*")
_ANCHOR = re.compile(rf"[0-9@]|akia|asia|gh[pousr]_|eyj|password|passwd|pwd|token|secret|api[_\-]?key|{'|'.join(_MONTHS['en']).lower()}")
_RUN = re.compile(r"[0-9A-Za-z]*")
#: Characters before an anchor at which a value may begin (an e-mail name has 64 at most).
_REACH = 72


class Pseudonyms:
    """Replaces the values of texts under one key, or puts them back (``reverse``)."""

    def __init__(self, key: bytes, reverse: bool = False) -> None:
        self.key, self.reverse, self.made = key, reverse, {}
        self.own = hashlib.blake2b(key, digest_size=32).digest()

    def _turn(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        if (at := (n, tweak)) not in self.made:
            if len(self.made) > 4096:
                self.made.clear()
            self.made[at] = Permutation(n, self.key, tweak)
        return self.made[at].inverse(x) if self.reverse else self.made[at].forward(x)

    def characters(self, text: str, tweak: str) -> str:
        """Letters and digits permuted within their classes, as one mixed-radix number.

        Of a long text each piece is such a number, permuted by the pieces before it.
        """
        if len(text) > PIECE:
            out, before = [], b""
            for k in range(0, len(text), PIECE):
                piece = text[k : k + PIECE]
                out.append(self.characters(piece, f"{tweak}:{before.hex()}" if k else tweak))
                before = hashlib.blake2b(before + (out[-1] if self.reverse else piece).encode(), key=self.own, digest_size=32).digest()
            return "".join(out)
        kinds = [next((k for k in _CLASSES if c in k), None) for c in text]
        rank, n = 0, 1
        for c, kind in zip(text, kinds):
            if kind:
                rank, n = rank * len(kind) + kind.index(c), n * len(kind)
        shape = "".join("d" if k is _CLASSES[0] else "l" if k is _CLASSES[1] else "u" if k else c for c, k in zip(text, kinds))
        rank, out = self._turn(rank, n, f"{tweak}:{shape}"), []
        for c, kind in zip(reversed(text), reversed(kinds)):
            if kind:
                rank, at = divmod(rank, len(kind))
                c = kind[at]
            out.append(c)
        return "".join(reversed(out))

    def card(self, value: str) -> str | None:
        digits = re.sub(r"[ \-]", "", value)
        if not _CARD.fullmatch(digits) or digits[-1] != luhn_digit(digits[:-1]):
            return None
        width = len(digits) - 5
        body = digits[:4] + f"{self._turn(int(digits[4:-1]), 10**width, f'card{len(digits)}{digits[:4]}'):0{width}d}"
        return _refill(value, body + luhn_digit(body))

    def ssn(self, value: str) -> str | None:
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rank, serial = divmod(self._turn(rank, 898 * 99 * 9999, "ssn"), 9999)
        area, group = divmod(rank, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        number = lambda x: int("".join(str(int(c, 36)) for c in x))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self.characters(plain[4:], f"iban{plain[:2]}")
        return _refill(value, f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}")

    def ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        rank = self._turn(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return ".".join(map(str, rank.to_bytes(4, "big")))

    def ip6(self, value: str) -> str | None:
        try:
            at = ipaddress.IPv6Address(value)
        except ValueError:
            return None
        if sum(map(bool, value.split(":"))) < 3 or not re.search("[0-9]", value):  # names such as a::b
            return None
        rank = self._turn(int(at), 1 << 128, "ip6")
        new = ":".join(f"{rank >> shift & 0xFFFF:x}" for shift in range(112, -1, -16))
        return new.upper() if value.isupper() else new

    def phone(self, value: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", value)
        country = re.match(r"\+([0-9]{1,3})", value)
        national = not country or re.match(r"\+?1(?![0-9])", value) or (digits[:1] == "1" and len(digits) == 11)
        if national:
            own = digits[-10:]
            if len(digits) - len(own) != bool(country) or len(own) != 10 or (not country and not _assigned(own)):
                return None
            return _refill(value, digits[:-10] + self._national(own))
        code = country[1] if re.match(r"\+[0-9]{1,3}(?![0-9])", value) else digits[:2]
        own = digits[len(code) :]
        if not 8 <= len(digits) <= 15 or len(own) < 6:
            return None
        return _refill(value, code + f"{self._turn(int(own), 10 ** len(own), f'phone+{code}:{len(own)}'):0{len(own)}d}")

    def _national(self, own: str) -> str:
        """Ten digits of the North American plan; numbers that it can't assign are permuted among themselves."""
        if not _assigned(own):
            while _assigned(own := f"{self._turn(int(own), 10**10, 'phone+1?'):010d}"):
                pass
            return own
        rank = ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:])
        rank, line = divmod(self._turn(rank, 800 * 800 * 10_000, "phone+1"), 10_000)
        area, office = divmod(rank, 800)
        return f"{area + 200:03d}{office + 200:03d}{line:04d}"

    def day(self, year: str, month: int, day: str) -> datetime.date | None:
        try:
            at = datetime.date(int(year), month, int(day))
        except ValueError:
            return None
        days = _BY_LATE[at.day > 12]
        return datetime.date.fromordinal(days[self._turn(_DAY_RANK[at.toordinal()], len(days), f"day{at.day > 12}")])

    def date(self, m: re.Match) -> str | None:
        if m["iso"]:
            new = self.day(m["y1"], int(m["m1"]), m["d1"])
            return new and m["s1"].join((str(new.year), _like(new.month, m["m1"]), _like(new.day, m["d1"])))
        if m["dmy"]:
            first, second = int(m["d2"]), int(m["m2"])
            month_first = second > 12
            new = self.day(m["y2"], *((first, m["m2"]) if month_first else (second, m["d2"])))
            parts = new and ((new.month, new.day) if month_first else (new.day, new.month))
            return parts and m["s2"].join((_like(parts[0], m["d2"]), _like(parts[1], m["m2"]), str(new.year)))
        day, month, year = (m["d3"], m["b3"], m["y3"]) if m["d3"] else (m["d4"], m["b4"], m["y4"])
        order = ["en"] if m["b4"] else ["es"] if m["p3"] or m["q3"] == " de " else ["de", "en", "fr", "es"] if m["o3"] == "." else ["en", "fr", "de", "es"]
        language = next((x for x in order if month.casefold() in _MONTH_OF[x]), None)
        new = language and self.day(year, _MONTH_OF[language][month.casefold()] + 1, day)
        if not new:
            return None
        name = _MONTHS[language][new.month - 1]
        name = name.upper() if month.isupper() else name.lower() if month.islower() else name.title()
        return f"{_like(new.day, day)}{m['o3'] or ''} {m['p3'] or ''}{name}{m['q3']}{new.year}" if m["d3"] else f"{name} {_like(new.day, day)}, {new.year}"

    def replace(self, m: re.Match) -> tuple[str, str] | None:
        """Kind and pseudonym of a found value; None if it isn't valid."""
        kind, value = m.lastgroup, m[0]
        if m["email"]:
            name, _, host = value.rpartition("@")
            new = self.characters(name.lower(), "email")  # addresses are the same in any case
            return "email", "".join(n.upper() if c.isupper() else n for n, c in zip(new, name)) + f"@{host}"
        if m["secret"]:
            if ":" in m["is"] and m["is"][-1] not in "\"'" and _WORDS.fullmatch(m["value"]):
                return None  # "the secret: understanding people"
            return "credential", m["word"] + m["is"] + self.characters(m["value"], "credential")
        if m["access"]:
            return "credential", value[:4] + self.characters(value[4:], "credential")
        if m["iso"] or m["dmy"] or m["named"]:
            kind, new = "date", self.date(m)
        else:
            kind = next(k for k in ("iban", "ip6", "ip", "ssn", "phone", "card") if m[k])
            new = getattr(self, kind)(value)
            if new is None and kind == "phone":
                new, kind = self.card(value.lstrip("+")) if "(" not in value and "+" not in value else None, "card"
        return ("ip" if kind == "ip6" else kind, new) if new else None

    def text(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds of the values that were replaced."""
        out, kinds, at, begin = [], [], 0, 0
        low = text.replace("\u0130", "i").lower()  # the only letter that grows in lower case
        while anchor := _ANCHOR.search(low, begin):
            # A value begins in the token of its first digit, at sign or key word.
            spot = anchor.start()
            first = max(begin, spot - _REACH)
            first = max(first, *(text.rfind(c, first, spot) + 1 for c in " \n\t"))
            for start in range(first, spot + 1):
                m = PATTERN.match(text, start)
                if m and m.end() > spot and (found := self.replace(m)):
                    out += [text[at:start], found[1]]
                    kinds.append(found[0])
                    at = begin = m.end()
                    break
            else:
                begin = max(anchor.end(), _RUN.match(text, spot).end())
        return ("".join([*out, text[at:]]), kinds) if kinds else (text, [])


def _like(number: int, was: str) -> str:
    return f"{number:02d}" if len(was) == 2 else str(number)


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, ``n_values`` replaced and ``kinds`` (distinct, sorted, comma-joined)."""
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in (text.lower(), "n_values", "kinds")]
    schema = T.StructType([*[docs.schema[c] for c in own], T.StructField(text, T.StringType()), T.StructField("n_values", T.LongType()), T.StructField("kinds", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Pseudonyms(key)
        for batch in batches:
            for at in range(0, max(1, len(batch)), 256):
                part = batch.slice(at, 256)
                done = [(x, []) if x is None else made.text(x) for x in part.column(text).to_pylist()]
                yield pa.record_batch(
                    [*[part.column(c) for c in own], pa.array([d[0] for d in done], pa.string()), pa.array([len(d[1]) for d in done], pa.int64()), pa.array([",".join(sorted(set(d[1]))) for d in done], pa.string())],
                    names=[*own, text, "n_values", "kinds"],
                )

    return docs.select(*[f"`{c}`" for c in [*own, text]]).mapInArrow(run, schema)
