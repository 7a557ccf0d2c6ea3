"""Format-preserving pseudonyms for personal data, with Spark expressions only.

Numbers and dates that pass validation are permuted within their own format by
a keyed Feistel network: the value is split in two counters L (mod a) and R
(mod b) that number every valid value of the format, and eight rounds add a
keyed SHA-256 of one to the other.  That is a bijection of the format for any
a and b, so equal values get equal pseudonyms in every document, different
values stay different, and lengths and separators stay as they were.  A date
with slashes may be read in two ways, so its strings are permuted: those that
both readings allow, those with a day first and those with a month first, each
among themselves.

=============  =====================================================  =====================
kind           recognised and validated                               kept as it is
=============  =====================================================  =====================
email          local@domain.tld, of any length                        domain, punctuation
card           13 to 19 digits that pass the Luhn test                first digit; check digit is recomputed
iban           country, check digits mod 97; in one or in fours       country, letters, spaces; check digits recomputed
ssn            ddd-dd-dddd, area 001-899 but 666, no zero part        separators
phone          North American form, any area, exchange begins with 2-9; country code, separators
               ten digits in one, area and exchange begin with 2-9
intl           + country code and two to five groups, 7 to 15 digits   country code, separators
ip6            eight groups, or :: and three groups or more            lengths of groups, digits and letters of either case
ip             four octets 0-255 without leading zeros                digits of each octet
date           yyyy-mm-dd, dd/mm/yyyy, mm/dd/yyyy or dd.mm.yyyy, 1800-2199 order, separators, a time after T
secret         access keys of known prefixes; values of password, passwd,  prefix, character classes
               pwd, secret, token, api key or access key after = or :,
               in any case, with a digit or quoted and long
=============  =====================================================  =====================

Not covered: names, addresses, dates outside of 1800 to 2199 or in words, phone
numbers without a plus in other forms than the North American ones, secrets
without a known prefix or name.  Domains of e-mail addresses stay, so the
members of a small private domain can still be told as such.

The key decides everything: whoever holds it can undo the pseudonyms.  It is the
caller's; ``session_key`` reads it from the session's ``spark.spanmill.pii.key``.

A null text stays null and an empty one empty.  Texts are searched whole, and
no pattern steps back over more than a few characters, so long texts and long
values take time in proportion.  Rows are independent, so repeated rows get
equal results; columns other than the text stay, whatever their names, but a
column with the name asked for ``kinds`` is replaced.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_SETTING = "spark.spanmill.pii.key"
#: For demonstrations on made-up data alone: a key that everyone can read protects nobody.
DEMO_KEY = "spanmill-demo-key"
ROUNDS = 8

_EDGE, _STOP = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_NUM, _END = r"(?<![A-Za-z0-9_])(?<![0-9][.,-])", r"(?![A-Za-z0-9_])(?![.,-][0-9])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_YEAR = "(?:1[89]|2[01])[0-9]{2}"
_VALUE = "[A-Z0-9]++(?:[_-]++[A-Z0-9]++)*+"
_NAMED = r"(?:password|passwd|pwd|secret|token|api[ _-]?key|access[ _-]?key)"
_DIGIT = "(?=[A-Z_-]*[0-9])"
#: What stands before a secret value of six characters or more: a password's name and =, or any name
#: with = or :, where the value must have a digit or be quoted and long.
_BEFORE = rf"(?:(?:password|passwd|pwd)=|{_NAMED}[\"']?[ ]?[=:][ ]?(?:[\"'](?:{_DIGIT}|(?=[A-Z0-9_-]{{16}}))|{_DIGIT}))(?=[A-Z0-9_-]{{6}})"
_ISSUED = r"(?:AKIA(?=[A-Z0-9]{16}(?![A-Za-z0-9_]))|sk-(?=[A-Za-z0-9_-]{16})|gh[opsu]_(?=[A-Za-z0-9]{30})|xox[abprs]-(?=[A-Za-z0-9-]{10})|AIza(?=[A-Za-z0-9_-]{30}))"
_GROUP6 = "[0-9A-Fa-f]{1,4}"

#: Length of an IBAN -> its countries.  In groups of four only the length tells where it ends.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _grouped(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?= [A-Z ]*[0-9])(?: [A-Z0-9]{{4}}){{{fours}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "")


#: One pattern per kind, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])(?=[._%+-]*+[A-Za-z0-9])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9.-]*?\.[A-Za-z]{2,24}(?![A-Za-z0-9_-]))[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": _EDGE + rf"(?i:{_ISSUED}{_VALUE}|{_BEFORE}{_VALUE})",
    "iban": _EDGE + r"(?:[A-Z]{2}[0-9]{2}(?=[A-Z]*[0-9])[A-Z0-9]{8,30}|" + "|".join(_grouped(*x) for x in IBAN_LENGTHS.items()) + ")" + _STOP,
    "ip6": rf"(?<![A-Za-z0-9_:.])(?:(?:{_GROUP6}:){{7}}{_GROUP6}|(?:{_GROUP6}:){{0,6}}:(?:{_GROUP6}:){{0,5}}{_GROUP6})(?![A-Za-z0-9_:])",
    "ip": _NUM + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + _END,
    "intl": r"(?<![A-Za-z0-9_+])\+(?!1[ .-]?\(?[0-9]{3}\)?[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9]))(?=(?:[ .-]?[0-9]){7,15}(?![ .-]?[0-9]))[1-9][0-9]{0,2}(?:[ .-][0-9]{1,8}){2,5}" + _END,
    "phone": _NUM + r"[2-9][0-9]{2}[2-9][0-9]{6}" + _END + r"|(?<![A-Za-z0-9_+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}" + _END,
    "ssn": _NUM + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + _END,
    "date": _NUM + rf"(?:{_YEAR}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/{_YEAR}|[0-9]{{2}}\.[0-9]{{2}}\.{_YEAR})(?:(?=T[0-9]{{2}})|{_END})",
    "card": _NUM + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _END,
}
PATTERN = "|".join(PATTERNS.values())
#: Every match holds a digit, an at sign or one of these words.
HINT = "[0-9@]|(?i:AKIA|sk-|gh[opsu]_|xox|AIza|passw|pwd|secret|token|key)"

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
GROUP = 16


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _long(x: Column) -> Column:
    return x.cast("long")


def _pad(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def feistel(left: Column, right: Column, a: Column, b: Column, tweak: Column, key: Column) -> Column:
    """struct<l,r>: the permuted pair; l counts modulo ``a``, r modulo ``b``."""

    def noise(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", key, tweak, i.cast("string"), half.cast("string")), 256)
        return _long(F.conv(F.substring(digest, 1, 15), 16, 10))

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        l = F.when(even, F.pmod(acc["l"] + F.pmod(noise(i, acc["r"]), a), a)).otherwise(acc["l"])
        r = F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + F.pmod(noise(i, acc["l"]), b), b))
        return F.struct(l.alias("l"), r.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_long(left).alias("l"), _long(right).alias("r")), turn)


def _fixed(x: int) -> Column:
    return F.lit(x).cast("long")


def _digits(d: Column, tweak: Column, key: Column) -> Column:
    """Permute a string of up to 36 digits among those of its length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    size = lambda k: _long(F.concat(F.lit("1"), F.repeat(F.lit("0"), k)))
    mixed = feistel(_long(F.concat(F.lit("0"), F.left(d, u))), _long(F.substring(d, u + 1, n)), size(u), size(n - u), F.concat_ws("|", tweak, n.cast("string")), key)
    return _let(mixed, lambda m: F.concat(F.when(u > 0, _pad(m["l"], u)).otherwise(""), _pad(m["r"], n - u)))


def _characters(text: Column, alphabets: list[str], tweak: Column, key: Column) -> Column:
    """Permute characters within their alphabet; others stay.  Groups of 16 are
    split in halves counted in mixed radix; the group's place and the text's
    length go into the tweak."""
    known = [F.lit(a) for a in alphabets]

    def tagged(c: Column) -> Column:
        own = F.coalesce(*(F.when(F.contains(a, c), a) for a in known), c)
        return F.struct(c.alias("c"), own.alias("s"))

    def size(cs: Column) -> Column:
        return F.aggregate(cs, _fixed(1), lambda acc, e: acc * F.length(e["s"]))

    def value(cs: Column) -> Column:
        return F.aggregate(cs, _fixed(0), lambda acc, e: acc * F.length(e["s"]) + F.position(e["c"], e["s"]) - 1)

    def spelled(cs: Column, v: Column) -> Column:
        def step(acc: Column, e: Column) -> Column:
            n = F.length(e["s"])
            letter = F.substring(e["s"], (F.pmod(acc["v"], n) + 1).cast("int"), F.lit(1))
            return F.struct(_long(F.floor(acc["v"] / n)).alias("v"), F.concat(letter, acc["t"]).alias("t"))

        return F.aggregate(F.reverse(cs), F.struct(v.alias("v"), F.lit("").alias("t")), step)["t"]

    def group(start: Column) -> Column:
        chars = F.transform(F.split(F.substring(text, start + 1, F.lit(GROUP)), ""), tagged)

        def permuted(h: Column) -> Column:
            place = F.concat_ws("|", tweak, F.length(text).cast("string"), start.cast("string"))
            mixed = feistel(value(h["x"]), value(h["y"]), size(h["x"]), size(h["y"]), place, key)
            return _let(mixed, lambda m: F.concat(spelled(h["x"], m["l"]), spelled(h["y"], m["r"])))

        def halves(cs: Column) -> Column:
            n = F.floor(F.size(cs) / 2).cast("int")
            return _let(F.struct(F.slice(cs, F.lit(1), n).alias("x"), F.slice(cs, n + 1, F.lit(GROUP)).alias("y")), permuted)

        return _let(chars, halves)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(GROUP)), group), "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order."""

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        put = F.when(is_digit, F.substring(digits, acc["i"], F.lit(1))).otherwise(c)
        return F.struct(F.when(is_digit, acc["i"] + 1).otherwise(acc["i"]).alias("i"), F.concat(acc["t"], put).alias("t"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("t")), step)["t"]


def _luhn(d: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10."""

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        double = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when((F.length(d) - i) % 2 == 1, double).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10


def _mod97(s: Column) -> Column:
    """ISO 7064 remainder of an upper-case alphanumeric string."""

    def add(acc: Column, c: Column) -> Column:
        digit = acc * 10 + F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(0)
        return F.when(c.between("0", "9"), digit).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(s, ""), F.lit(0), add)


def _card(m: Column, key: Column) -> Column:
    d = F.regexp_replace(m, "[^0-9]", "")

    def new(d: Column) -> Column:
        n = F.length(d)
        inner = F.concat(F.left(d, F.lit(1)), _digits(F.substring(d, F.lit(2), n - 2), F.lit("card"), key))
        whole = _let(inner, lambda x: F.concat(x, ((10 - _luhn(F.concat(x, F.lit("0")))) % 10).cast("string")))
        return F.when(_luhn(d) == 0, _refill(m, whole))

    return _let(d, new)


def _phone(m: Column, key: Column) -> Column:
    d = F.regexp_replace(m, "[^0-9]", "")

    def new(d: Column) -> Column:
        ten = F.right(d, F.lit(10))
        number = lambda a, n: _long(F.substring(ten, a, n))
        mixed = feistel(number(1, 3), (number(4, 3) - 200) * 10000 + number(7, 4), _fixed(1000), _fixed(8_000_000), F.lit("phone"), key)
        made = _let(mixed, lambda p: F.concat(_pad(p["l"], 3), _pad(F.floor(p["r"] / 10000) + 200, 3), _pad(p["r"] % 10000, 4)))
        return _refill(m, F.concat(F.left(d, F.length(d) - 10), made))

    return _let(d, new)


def _ssn(m: Column, key: Column) -> Column:
    number = lambda a, n: _long(F.substring(m, a, n))
    area = number(1, 3)
    area = F.when(area < 666, area - 1).otherwise(area - 2)
    mixed = feistel(area, (number(5, 2) - 1) * 9999 + number(8, 4) - 1, _fixed(898), _fixed(99 * 9999), F.lit("ssn"), key)

    def text(p: Column) -> Column:
        first = F.when(p["l"] < 665, p["l"] + 1).otherwise(p["l"] + 2)
        return F.concat_ws("-", _pad(first, 3), _pad(F.floor(p["r"] / 9999) + 1, 2), _pad(p["r"] % 9999 + 1, 4))

    return _let(mixed, text)


def _ip(m: Column, key: Column) -> Column:
    def octet(o: Column) -> Column:
        n = F.length(o)
        low = F.when(n == 1, 0).when(n == 2, 10).otherwise(100)
        return F.struct((_long(o) - low).alias("v"), _long(low).alias("low"), _long(F.when(n == 1, 10).when(n == 2, 90).otherwise(156)).alias("n"))

    def new(o: Column) -> Column:
        at = lambda i, f: F.get(o, i)[f]
        mixed = feistel(
            at(0, "v") * at(1, "n") + at(1, "v"), at(2, "v") * at(3, "n") + at(3, "v"), at(0, "n") * at(1, "n"), at(2, "n") * at(3, "n"),
            F.concat_ws("|", F.lit("ip"), F.array_join(F.transform(o, lambda x: x["n"].cast("string")), "|")), key,
        )
        part = lambda v, i: (_long(v) + at(i, "low")).cast("string")
        return _let(mixed, lambda p: F.concat_ws(".", part(F.floor(p["l"] / at(1, "n")), 0), part(p["l"] % at(1, "n"), 1), part(F.floor(p["r"] / at(3, "n")), 2), part(p["r"] % at(3, "n"), 3)))

    return _let(F.transform(F.split(m, "\\."), octet), new)


def _date(m: Column, key: Column) -> Column:
    """The days of 1800 to 2199 are a whole Gregorian cycle: 146097 = 189 * 773."""
    first = F.lit("1800-01-01").cast("date")

    def new(form: str) -> Column:
        day = F.try_to_date(m, form)

        def moved(n: Column) -> Column:
            mixed = feistel(_long(F.floor(n / 773)), _long(n % 773), _fixed(189), _fixed(773), F.lit("date"), key)
            return _let(mixed, lambda p: F.date_format(F.date_add(first, (p["l"] * 773 + p["r"]).cast("int")), form))

        return F.when(day.isNotNull(), _let(F.date_diff(day, first), moved))

    dash, dot = m.rlike("^[0-9]{4}-"), F.contains(m, F.lit("."))
    return F.when(dash, new("yyyy-MM-dd")).when(dot, new("dd.MM.yyyy")).otherwise(_slash_date(m, key))


def _slash_date(m: Column, key: Column) -> Column:
    """Strings a/b/yyyy.  With a and b up to 12 there are 144 a year, for 400 years.  The
    others have one reading: days 13 and later, 88497 = 9 * 9833 of them, numbered by date."""
    first = F.lit("1800-01-01").cast("date")
    number = lambda at, n: _long(F.substring(m, at, n))
    a, b, year = number(1, 2), number(4, 2), number(7, 4)
    either = a.between(1, 12) & b.between(1, 12)
    both = feistel((a - 1) * 12 + b - 1, year - 1800, _fixed(144), _fixed(400), F.lit("date|either"), key)
    shown = lambda x, y, year: F.concat_ws("/", _pad(x, 2), _pad(y, 2), _pad(year, 4))
    ambiguous = _let(both, lambda p: shown(F.floor(p["l"] / 12) + 1, p["l"] % 12 + 1, p["r"] + 1800))

    def before(month: Column) -> Column:
        """Late days before a month, which is counted from 1800."""
        return F.date_diff(F.add_months(first, month), first) - 12 * month

    def late(form: str) -> Column:
        day = F.try_to_date(m, form)

        def written(i: Column) -> Column:
            guess = F.floor(i * 4800 / 88497).cast("int")  # right but for one month
            month = F.when(before(guess) > i, guess - 1).when(before(guess + 1) <= i, guess + 1).otherwise(guess)
            return _let(month, lambda k: F.date_format(F.date_add(F.add_months(first, k), (i - before(k) + 12).cast("int")), form))

        def moved(n: Column) -> Column:
            mixed = feistel(_long(F.floor(n / 9833)), _long(n % 9833), _fixed(9), _fixed(9833), F.lit("date|" + form), key)
            return _let(mixed, lambda p: _let(_long(p["l"] * 9833 + p["r"]), written))

        months = (F.year(day) - 1800) * 12 + F.month(day) - 1
        return F.when(day.isNotNull(), _let(_long(F.date_diff(day, first) - 12 * (months + 1)), moved))

    return F.when(either, ambiguous).when(a > 12, late("dd/MM/yyyy")).otherwise(late("MM/dd/yyyy"))


def _iban(m: Column, key: Column) -> Column:
    country, whole = F.left(m, F.lit(2)), F.replace(m, F.lit(" "), F.lit(""))
    bban = F.substring(whole, F.lit(5), F.lit(40))
    letters, number = F.regexp_replace(bban, "[0-9]", ""), F.regexp_replace(bban, "[A-Z]", "")

    def made(digits: Column) -> Column:
        check = _pad(98 - _mod97(F.concat(_refill(bban, digits), country, F.lit("00"))), 2)
        return _refill(m, F.concat(check, digits))

    new = _let(_digits(number, F.concat_ws("|", F.lit("iban"), country, letters), key), made)
    return F.when(_mod97(F.concat(bban, F.left(whole, F.lit(4)))) == 1, new)


def _email(m: Column, key: Column) -> Column:
    """Punctuation before the local part is no part of it."""
    local = F.substring_index(m, "@", 1)
    name = F.regexp_replace(local, "^[^A-Za-z0-9]+", "")
    made = _let(name, lambda n: _characters(n, [DIGITS, LOWER, UPPER], F.lit("email"), key))
    return F.concat(F.left(local, F.length(local) - F.length(name)), made, F.substring(m, F.length(local) + 1, F.length(m)))


def _secret(m: Column, key: Column) -> Column:
    prefix = F.regexp_extract(m, rf"^(?i:{_ISSUED}|{_BEFORE})", 0)
    value = F.substring(m, F.length(prefix) + 1, F.length(m))
    made = F.when(value.rlike('^[0-9a-f]+"?$'), _characters(value, [HEX], F.lit("secret"), key)).otherwise(_characters(value, [DIGITS, LOWER, UPPER], F.lit("secret"), key))
    return F.concat(prefix, made)


def _intl(m: Column, key: Column) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]+", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return F.concat(country, _refill(rest, _digits(F.regexp_replace(rest, "[^0-9]", ""), F.concat_ws("|", F.lit("intl"), country), key)))


def _ip6(m: Column, key: Column) -> Column:
    groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
    whole = (groups == 8) | (F.contains(m, F.lit("::")) & groups.between(3, 7) & m.rlike("[0-9]"))
    return F.when(whole, _characters(m, [DIGITS, "abcdef", "ABCDEF"], F.lit("ip6"), key))


_MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip6": _ip6, "ip": _ip, "intl": _intl, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card}


def pseudonym(match: Column, key: str) -> Column:
    """struct<kind, text> for a match of ``PATTERN``; kind is null and the text as it was
    where validation fails."""
    secret = F.lit(key)
    kind = F.coalesce(*(F.when(match.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()))

    def made(k: Column) -> Column:
        out = None
        for name, maker in _MAKERS.items():
            out = F.when(k == name, maker(match, secret)) if out is None else out.when(k == name, maker(match, secret))
        return _let(out, lambda t: F.struct(F.when(t.isNotNull(), k).alias("kind"), F.coalesce(t, match).alias("text")))

    return _let(kind, made)


def session_key(spark: SparkSession) -> str:
    """The session's key.  Without one, the demonstration key, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms under the demonstration key can be undone by anyone", stacklevel=2)
    return key or DEMO_KEY


def pseudonymize(docs: DataFrame, key: str, text: str = "text", kinds: str | None = None) -> DataFrame:
    """``docs`` with the text column pseudonymised under ``key``; ``kinds`` names a further column:
    the kinds of the values replaced, in the order of the text."""
    if not key:
        raise ValueError("pseudonyms need a key")
    body, held = F.col(f"`{text}`"), _unused(docs, "found")
    pattern = F.lit(PATTERN)
    found = F.when(body.rlike(HINT), F.transform(F.regexp_extract_all(body, pattern, F.lit(0)), lambda m: pseudonym(m, key)))
    rest = F.split(body, PATTERN, -1)
    joined = F.array_join(F.zip_with(rest, F.col(held), lambda a, m: F.concat(a, F.coalesce(m["text"], F.lit("")))), "")
    names = [c for c in docs.columns if kinds is None or c.lower() != kinds.lower()]
    out = docs.withColumn(held, found)
    changed = F.when(F.size(held) > 0, joined).otherwise(body)
    columns = [changed.alias(text) if c == text else F.col(f"`{c}`") for c in names]
    if kinds:
        listed = F.coalesce(F.filter(F.transform(held, lambda m: m["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
        columns.append(listed.alias(kinds))
    return out.select(*columns)


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name
