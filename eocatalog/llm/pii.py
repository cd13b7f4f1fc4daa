"""Format-preserving pseudonyms for personal data and secrets, by a keyed Feistel permutation.

A value that its pattern finds and its rule validates is turned into a number within the values of its
format, that number is permuted, and the result is written in the same format. The permutation depends on the
key and the kind alone, so equal values stay equal across documents, different ones stay different, and
who has the key can go back.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import math
import re
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eocatalog.llm import _common as c
from eocatalog.llm._chunks import in_parts

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ("email", "secret", "iban", "date", "ssn", "phone", "ip", "ip6", "card")

#: Characters of an IBAN by country.
IBAN_LENGTHS = {pair[:2]: int(pair[2:]) for pair in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
#: Country calling codes of one and two digits; all others have three.
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Lengths of national numbers, where they are fixed: digits past these are another number's.
NATIONAL_DIGITS = {"7": (10,), "31": (9,), "32": (8, 9), "33": (9,), "34": (9,), "41": (9,), "44": (9, 10), "45": (8,), "47": (8,), "48": (9,), "52": (10,), "55": (10, 11), "61": (9,), "65": (8,), "81": (9, 10), "86": (10, 11), "90": (10,), "91": (10,), "351": (9,), "353": (7, 8, 9), "420": (9,)}
#: Country code 1: with brackets, after +1, after 1 with separators; without such marks only by its ranges.
_AMERICAN = (
    r"(?:(?:\+|00)?1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}",
    r"\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}",
    r"(?:00)?1[ .-]?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
    r"[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}",
)
_ABROAD = r"(?:\+|00(?=[2-9][0-9]{0,2}[ ./-]))[2-9][0-9]{0,2}(?:[ ./-]?\(0\))?(?:[ ./-]?\([0-9]{1,5}\))?(?:[ ./-]?[0-9]){4,14}"
#: Ten digits in a row are a telephone number after a word that says so, and groups of digits after one that says nothing else.
_NAMED = (
    r"(?P<says>\b(?i:tel|telephone|phone|mobile|cell|fax|call)[.:]{0,2} ?)(?P<bare>[0-9]{10})",
    r"(?P<said>\b(?i:tel|telephone|telefon|téléphone|tél|teléfono|phone|mobile|mobil|handy|móvil|portable|cell|fax)\b[.:]{0,2} ?)(?P<national>\(?[0-9]{2,6}\)?(?:[ ./-]?[0-9]){4,10})",
)
#: Access keys by how they begin, with what follows: its characters and how many at least.
KEY_FORMATS = (
    ("AKIA|ASIA", "A-Za-z0-9", 16), ("gh[pousr]_", "A-Za-z0-9", 16), ("github_pat_", "A-Za-z0-9_", 20), ("glpat-", "A-Za-z0-9_-", 16), ("sk-(?:proj-|ant-|or-)?", "A-Za-z0-9_-", 16),
    ("[srp]k_(?:live|test)_", "A-Za-z0-9", 16), ("xox[abeoprs]-", "A-Za-z0-9-", 10), ("AIza", "A-Za-z0-9_-", 30), ("ya29\\.", "A-Za-z0-9_-", 20), ("SG\\.", "A-Za-z0-9_.-", 40),
    ("npm_", "A-Za-z0-9", 30), ("pypi-", "A-Za-z0-9_-", 30), ("hf_", "A-Za-z0-9", 30), ("eyJ(?=[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.)", "A-Za-z0-9_.-", 20),
)
_KEYS = "|".join(f"(?:{begin})(?=[{chars}]{{{least}}})" for begin, chars, least in KEY_FORMATS)
_NAMES = r"(?i:password|passwd|passphrase|pwd|token|secret|credential|(?:api|access|private|auth|secret|account)[_-]?key)"
_DATE_LIKE = re.compile(r"(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](?:19|20)[0-9]{2}")
#: Letters and digits that are permuted together: the steps of a longer value are permuted one by one.
STEP = 64


class Feistel:
    """A permutation of 0..n-1 for each kind and n."""

    def __init__(self, key: bytes):
        self._key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, i: int, half: int) -> int:
        said = f"{kind}/{n}/{i}/{half}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self._key, digest_size=48).digest(), "big")

    def permute(self, kind: str, x: int, n: int, back: bool = False) -> int:
        """Unbalanced Feistel rounds over a grid that just covers n; a result past n goes round again."""
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if i % 2:
                    right = (right + sign * self._round(kind, n, i, left)) % b
                else:
                    left = (left + sign * self._round(kind, n, i, right)) % a
            x = left * b + right
            if x < n:
                return x


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits followed by it valid."""
    doubled = [int(d) * (2 if i % 2 == 0 else 1) for i, d in enumerate(reversed(digits))]
    return str(-sum(d - 9 * (d > 9) for d in doubled) % 10)


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(ch, 36)) for ch in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _refill(shape: str, values: str) -> str:
    """shape with its letters and digits replaced one by one."""
    it = iter(values)
    return "".join(next(it) if ch.isalnum() else ch for ch in shape)


def _group_ends(found: str) -> list[int]:
    """Where runs of letters and digits end."""
    return [m.end() for m in re.finditer("[A-Za-z0-9]+", found)]


def _length(found: str) -> int:
    return sum(ch.isalnum() for ch in found)


@functools.lru_cache(maxsize=4096)
def _class_of(ch: str) -> str:
    """The characters that may stand for a letter or digit: its kind, for others than ASCII in its row of 32."""
    for own in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if ch in own:
            return own
    kind, row = unicodedata.category(ch), ord(ch) & ~31
    return "".join(x for x in map(chr, range(row, row + 32)) if x.isalnum() and not x.isascii() and unicodedata.category(x) == kind)


class Pseudonyms:
    """replace() gives the text with pseudonyms and how many values of each kind it had."""

    #: Patterns in the order in which they are tried at a place.
    PATTERNS = (
        ("email", r"(?<![\w.%+-])(?P<local>[\w.%+-]+)@(?P<domain>(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)*)\.(?P<tld>[^\W\d_]{2,24})(?![\w@])"),
        ("secret", rf"(?:(?P<name>{_NAMES}[\"']?\s*[:=]\s*[\"']?)(?P<value>[^\s\"'<>]{{7,}}[^\s\"'<>.,;:!?)\]}}])|(?P<begin>-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY(?: BLOCK)?-----)(?P<block>[^-]+(?:-{{1,4}}[^-]+)*)(?=-----END )|\b(?P<id>{_KEYS})(?P<rest>[A-Za-z0-9](?:[A-Za-z0-9_.-]*[A-Za-z0-9])?))"),
        ("iban", r"\b(?P<country>[A-Z]{2})(?P<check>[0-9]{2})(?P<bban>(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b"),
        ("date", r"(?<![0-9./-])(?:(?P<y>(?:19|20)[0-9]{2})(?P<s1>[-/.])(?P<m>[0-9]{2})(?P=s1)(?P<d>[0-9]{2})|(?P<p>[0-9]{2})(?P<s2>[-/.])(?P<q>[0-9]{2})(?P=s2)(?P<y2>(?:19|20)[0-9]{2}))(?![0-9])(?![./-][0-9])"),
        ("ssn", r"(?<![0-9-])(?P<area>[0-9]{3})-(?P<group>[0-9]{2})-(?P<serial>[0-9]{4})(?![0-9])(?!-[0-9])"),
        ("phone", rf"(?<![0-9+])(?:(?P<us>{'|'.join(_AMERICAN)})|(?P<abroad>{_ABROAD})|{'|'.join(_NAMED)})(?![0-9])"),
        ("ip", r"(?<![0-9.])(?P<o1>[0-9]{1,3})\.(?P<o2>[0-9]{1,3})\.(?P<o3>[0-9]{1,3})\.(?P<o4>[0-9]{1,3})(?![0-9])(?!\.[0-9])"),
        ("ip6", r"(?<![0-9A-Za-z:.])(?P<v6>(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)(?:(?P<v6head>[0-9A-Fa-f:]{1,30}:)(?P<v4>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?!\.[0-9])|[0-9A-Fa-f:]{3,39}))(?![0-9A-Za-z:])"),
        ("card", r"(?<![0-9])(?P<digits>[0-9](?:[ -]?[0-9]){12,18})(?![0-9])"),
    )
    #: Every value of every kind holds one of these, so a text without them needs no look at its places.
    NEEDED = re.compile(r"[0-9@]|:[A-Fa-f]{0,4}:|AKIA|ASIA|gh[pousr]_|_pat_|glpat-|[srp]k[-_]|xox|AIza|ya29|SG\.|npm_|pypi-|hf_|eyJ|-----BEGIN|(?i:passw|passp|pwd|token|secret|credential|key)")

    def __init__(self, key: bytes):
        self._feistel = Feistel(key)
        self._pattern = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in self.PATTERNS))
        # right after a value an address begins where it is looked at, not only where its run of characters does
        self._joined = re.compile(f"(?P<email>{self.PATTERNS[0][1].partition(')')[2]})" + "".join(f"|(?P<{kind}>(?!))" for kind, _ in self.PATTERNS[1:]))

    def _letters(self, kind: str, text: str) -> str:
        """Letters and digits of text permuted, each within its class and case; the rest stays."""
        kept = [ch for ch in text if ch.isalnum()]
        done = "".join(self._step(kind if not at else f"{kind} {at}", kept[at : at + STEP]) for at in range(0, len(kept), STEP))
        return _refill(text, done)

    def _step(self, kind: str, kept: list[str]) -> str:
        classes = [_class_of(ch) for ch in kept]
        size, value = 1, 0
        for ch, own in zip(kept, classes, strict=True):
            value = value * len(own) + own.index(ch)
            size *= len(own)
        value, out = self._feistel.permute(kind, value, size), []
        for own in reversed(classes):
            value, place = divmod(value, len(own))
            out.append(own[place])
        return "".join(reversed(out))

    def _email(self, m: re.Match) -> str:
        return f"{self._letters('email local', m['local'])}@{self._letters('email domain', m['domain'])}.{m['tld']}"

    def _secret(self, m: re.Match) -> str | None:
        if m["id"]:
            return m["id"] + self._letters("secret", m["rest"])
        if m["begin"]:
            return m["begin"] + self._letters("secret", m["block"])
        if m["value"].isalpha() and m["value"][1:].islower() and ":" in m["name"] and not re.match("(?i)pass|pwd", m["name"]):
            return None  # a word of prose: only a password is told by its name alone
        return m["name"] + self._letters("secret", m["value"])

    def _iban(self, m: re.Match) -> tuple[str, int] | None:
        """The country's length first, then the longest that is valid and ends with a group."""
        found, country = m["bban"], m["country"]
        ends = sorted(_group_ends(found), key=lambda k: (_length(found[:k]) + 4 != IBAN_LENGTHS.get(country), -k))
        for end in ends:
            bban = found[:end].replace(" ", "")
            if 11 <= len(bban) <= 30 and iban_check(country, bban) == m["check"]:
                new = self._letters("iban", bban)
                return country + iban_check(country, new) + _refill(found[:end], new), m.start("bban") + end
        return None

    def _date(self, m: re.Match) -> str | None:
        def day(y, mo, d):
            try:
                return datetime.date(int(y), int(mo), int(d)).toordinal()
            except ValueError:
                return None

        if m["y"]:
            kind, order, sep, found = "date", "ymd", m["s1"], day(m["y"], m["m"], m["d"])
        elif (found := day(m["y2"], m["q"], m["p"])) is not None:
            kind, order, sep = "date", "dmy", m["s2"]
        else:
            kind, order, sep, found = "date mdy", "mdy", m["s2"], day(m["y2"], m["p"], m["q"])
        if found is None or not FIRST_DAY <= found <= LAST_DAY:
            return None
        while True:
            found = FIRST_DAY + self._feistel.permute(kind, found - FIRST_DAY, LAST_DAY - FIRST_DAY + 1)
            new = datetime.date.fromordinal(found)
            if order != "mdy" or new.day > 12:  # month first is only told by a day past 12
                break
        parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return sep.join(parts[x] for x in order)

    def _ssn(self, m: re.Match) -> str | None:
        area, group, serial = int(m["area"]), int(m["group"]), int(m["serial"])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self._feistel.permute("ssn", x, 898 * 99 * 9999), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _american(self, number: str) -> str:
        """Ten digits permuted among those in the ranges of area code and exchange, or among those out of them."""
        area, exchange, line = int(number[:3]), int(number[3:6]), int(number[6:])
        if area >= 200 and exchange >= 200:
            x = ((area - 200) * 800 + exchange - 200) * 10_000 + line
            x, line = divmod(self._feistel.permute("phone", x, 800 * 800 * 10_000), 10_000)
            area, exchange = divmod(x, 800)
            return f"{area + 200}{exchange + 200}{line:04d}"
        while True:
            number = f"{self._feistel.permute('phone out of range', int(number), 10**10):010d}"
            if number[0] < "2" or number[3] < "2":
                return number

    def _phone(self, m: re.Match) -> str | tuple[str, int] | None:
        if m["bare"]:
            return m["says"] + self._american(m["bare"])
        if m["national"]:
            return self._national(m)
        if m["us"]:
            digits = re.sub("[^0-9]", "", m["us"])
            return _refill(m["us"], digits[:-10] + self._american(digits[-10:]))
        return self._abroad(m["abroad"], m.start())

    def _national(self, m: re.Match) -> str | None:
        """Seven to thirteen digits after a word that names them; a leading 0 stays one. A date isn't a number."""
        found = m["national"]
        number = re.sub("[^0-9]", "", found)
        if not 7 <= len(number) <= 13 or _DATE_LIKE.match(found) or found.count("(") != found.count(")"):
            return None
        led = number[0] == "0"
        while True:
            number = str(self._feistel.permute("phone national", int(number), 10 ** len(number))).zfill(len(number))
            if (number[0] == "0") == led:
                return m["said"] + _refill(found, number)

    def _abroad(self, found: str, start: int) -> tuple[str, int] | None:
        """The digits after the country code and a bracketed 0 permuted; a leading 0 stays one."""
        head = re.match(r"(?:\+|00)([0-9]+)", found)
        code = next((head[1][:k] for k in (1, 2) if head[1][:k] in CALLING_CODES), head[1][:3])
        if code not in CALLING_CODES and len(code) < 3:  # it goes on after a separator
            return None
        at = head.start(1) + len(code)
        at += len(re.match(r"(?:[ ./-]?\(0\))?", found[at:])[0])
        ends = [k for k in _group_ends(found) if k > at]
        lengths = {k: _length(found[at:k]) for k in ends}
        own = [k for k in ends if lengths[k] in NATIONAL_DIGITS.get(code, ())]
        end = max(own or [k for k in ends if 8 <= lengths[k] + len(code) <= 15], default=None)
        if end is None:
            return None
        number = re.sub("[^0-9]", "", found[at:end])
        led = number[0] == "0"
        while True:
            number = str(self._feistel.permute(f"phone {code}", int(number), 10 ** len(number))).zfill(len(number))
            if (number[0] == "0") == led:
                return found[:at] + _refill(found[at:end], number), start + end

    def _ip(self, m: re.Match) -> str | None:
        octets = [m[f"o{i}"] for i in range(1, 5)]
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        return self._octets(octets)

    def _octets(self, octets: list[str]) -> str:
        x = self._feistel.permute("ip", int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _ip6(self, m: re.Match) -> str | None:
        """The hexadecimal digits permuted; how the address is written stays."""
        found = m["v6"]
        try:
            ipaddress.IPv6Address(found)
        except ValueError:
            return None
        if m["v4"]:  # the address within is the same as alone; what says that it is mapped stays
            head = m["v6head"] if m["v6head"].lower() == "::ffff:" else self._hexadecimal(m["v6head"])
            return head + self._octets(m["v4"].split("."))
        return self._hexadecimal(found)

    def _hexadecimal(self, found: str) -> str | None:
        digits = found.replace(":", "")
        if not digits:
            return None
        new = f"{self._feistel.permute('ip6', int(digits, 16), 16 ** len(digits)):0{len(digits)}x}"
        return _refill(found, new.upper() if any(ch.isupper() for ch in digits) else new)

    def _card(self, m: re.Match) -> tuple[str, int] | None:
        """The longest valid number that ends with a group; digits after it are looked at again."""
        found, lengths = m["digits"], {}
        digits = found.replace(" ", "").replace("-", "")
        if digits[0] == "0":
            return None
        for end in _group_ends(found):
            lengths[end] = end - found.count(" ", 0, end) - found.count("-", 0, end)
        # Luhn sums of all beginnings, with the digits at even or at odd places doubled
        sums = ([0], [0])
        for i, d in enumerate(map(int, digits)):
            twice = 2 * d - 9 * (d > 4)
            sums[i % 2].append(sums[i % 2][-1] + twice)
            sums[1 - i % 2].append(sums[1 - i % 2][-1] + d)
        for end, n in reversed(lengths.items()):
            if n < 13 or sums[n % 2][n] % 10:
                continue
            body = digits[: n - 1]
            # the issuer's first digit stays
            new = body[0] + str(self._feistel.permute(f"card {n}", int(body[1:]), 10 ** (n - 2))).zfill(n - 2)
            return _refill(found[:end], new + luhn_digit(new)), m.start() + end
        return None

    def replace(self, text: str | None) -> tuple[str | None, Counter]:
        found: Counter = Counter()
        if not text or not self.NEEDED.search(text):
            return text, found
        out, at = [], 0
        while m := (self._joined.match(text, at) if found else None) or self._pattern.search(text, at):
            kind = next(k for k in KINDS if m[k] is not None)
            new = getattr(self, f"_{kind}")(m)
            if new is None:  # not valid: go on after its first character's run
                skip = re.compile("[0-9]+|.", re.S).match(text, m.start()).end()
                out.append(text[at:skip])
                at = skip
                continue
            new, end = new if isinstance(new, tuple) else (new, m.end())  # a match may hold more than the value
            out += text[at : m.start()], new
            at = end
            found[kind] += 1
        out.append(text[at:])
        return "".join(out), found


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_pii and n_<kind> for each of KINDS, of every row.

    A null text stays null with counts 0. Rows are looked at one by one, so null and repeated ids change
    nothing. What no pattern finds, or its rule rejects, stays as it is: emails (of any letters); what follows a name like
    "password", "token" or "api key" (eight characters or more without white space; a mere word after a colon is a password only); access keys by KEY_FORMATS; private
    key blocks; IBANs (mod 97); dates from 1900 to 2099 (calendar); social security numbers (ranges); telephone
    numbers (any digits after a country code or with brackets, or seven to thirteen digits after a word like "tel"; ranges where
    only separators show them; ten digits without any mark stay); IPv4 (octets) and IPv6 addresses, mixed ones too; card numbers (Luhn).
    """

    def run(batches):
        import pyarrow as pa

        own = Pseudonyms(key)
        for part in in_parts(batches):
            done = [own.replace(t) for t in part.column(1).to_pylist()]
            counts = [pa.array([f[k] for _, f in done], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([f.total() for _, f in done], pa.int64()), *counts], ["doc_id", "text", "n_pii", *(f"n_{k}" for k in KINDS)])

    schema = "doc_id long, text string, n_pii long, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(c.table(spark, sf_dir, "documents"), key=b"key of the registered query")
