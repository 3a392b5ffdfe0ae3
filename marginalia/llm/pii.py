"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame operations alone.

Candidates are found by one pattern, validated (Luhn, mod 97, octets, calendar) and permuted by a keyed
Feistel network within their own format: a card stays a valid card, a date a date. The permutation
depends on key, kind and value only, so equal values stay linked across documents, and different
values of one format stay different. What does not validate is left alone.

Feistel rounds add a keyed hash of one part to the other, modulo the other's size. That is a
permutation of pairs of any two sizes, so no format needs cycle walking. The rounds' keys are hashes of the
secret that the driver makes, so the secret itself is in no plan or event log; who reads plans still has the
rounds' keys, so plans of a corpus that matters are to be redacted (``spark.sql.redaction.string.regex``).
"""

from __future__ import annotations

import hashlib
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

#: The formats that are looked for, each with its kind.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LOCAL = r"\p{L}\p{N}._%+\-"
#: Length of an IBAN by country; those of other countries may end at any token.
_IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_SHAPES = [rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + rf" ?[A-Z0-9]{{{n % 4}}}" * (n % 4 > 0) for n, c in _IBAN_COUNTRIES.items()]
_IBAN_OTHER = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
PATTERNS = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9](?:[A-Za-z0-9-]{{0,62}}\.){{1,8}}[A-Za-z]{{2,24}}(?![A-Za-z0-9])",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)",
    "date": r"(?<![\p{L}\p{N}./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\p{L}\p{N}/-]|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}.-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|[.-]\d)",
    "iban": rf"(?<![\p{{L}}\p{{N}}])(?=[A-Z]{{2}}\d{{2}})(?:{'|'.join([*_IBAN_SHAPES, _IBAN_OTHER])})(?![\p{{L}}\p{{N}}])",
    "card": r"(?<![\p{L}\p{N}])(?<!\d[.-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\p{L}\p{N}]|[.-]\d)",
}
KINDS = tuple(PATTERNS)
_ANY = "|".join(PATTERNS.values())
#: Texts without this hold none of the formats; a cheap test first.
_HINT = r"\d[\d .()/-]{4}|[A-Z]{2}\d\d|@"
_ROUNDS = 8
#: Setting that holds the secret key, and the published key that synthetic tables and tests may use.
KEY_SETTING, TEST_KEY = "spark.marginalia.pii.key", "not a secret"
#: Hexadecimal digits of a hash that a round adds (60 bits).
_DIGITS_OF_HASH = 15


def secret(spark: SparkSession, otherwise: str | None = None) -> str:
    """The session's key. Without one, ``otherwise`` with a warning, or an error."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found and not otherwise:
        raise ValueError(f"{KEY_SETTING} must hold the secret key of the pseudonyms")
    if not found:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms by a published key", stacklevel=2)
    return found or otherwise


def _rounds(key: str, kind: str) -> Column:
    """The keys of the rounds, hashed from the secret."""
    return F.array(*[F.lit(hashlib.sha256(f"{key}|{kind}|{i}".encode()).hexdigest()) for i in range(_ROUNDS)])


def _keyed(turn: Column, *value: Column) -> Column:
    """60 bits of SHA-256 over a round's key and values."""
    digest = F.sha2(F.concat_ws("|", turn, *[v.cast("string") for v in value]).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, _DIGITS_OF_HASH), 16, 10).cast("long")


def _permute(key: str, kind: str, left: Column, right: Column, lefts: Column, rights: Column, part: Column | None = None) -> Column:
    """Permutation of the pairs of ``left`` below ``lefts`` and ``right`` below ``rights``, of each ``part`` on its own: a struct ``l, r``."""
    parts = [F.lit(0) if part is None else part]
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), lefts.cast("long").alias("a"), rights.cast("long").alias("b"), parts[0].cast("int").alias("p"))

    def turn(s: Column, k: Column) -> Column:
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + _keyed(k, s["p"], s["r"]), s["a"]).alias("r"), s["b"].alias("a"), s["a"].alias("b"), s["p"].alias("p"))

    return F.aggregate(_rounds(key, kind), start, turn)


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """Permutation of the digit strings of one length (2 to 18)."""
    size = F.length(digits)
    half = F.floor(size / 2).cast("int")
    tens = lambda n: F.pow(F.lit(10.0), n).cast("long")
    done = F.array(_permute(key, kind, F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, size), tens(half), tens(size - half), size))
    return F.transform(done, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), size - half, "0")))[0]


def permute_chars(key: str, kind: str, value: Column) -> Column:
    """Permutation of strings that keeps the place and class (digit, small, capital) of each character; others stay."""

    def shifted(part: Column, by: Column, turn: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            code, move = F.ascii(c), _keyed(turn, at, by)
            moved = lambda first, n: F.char(F.lit(first) + F.pmod(code - first + move, F.lit(n)))
            return F.when(c.rlike("^[0-9]$"), moved(48, 10)).when(c.rlike("^[a-z]$"), moved(97, 26)).when(c.rlike("^[A-Z]$"), moved(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), one), "")

    half = F.ceil(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    return F.aggregate(_rounds(key, kind), start, lambda s, k: F.struct(s["r"].alias("l"), shifted(s["l"], s["r"], k).alias("r")), lambda s: F.concat(s["l"], s["r"]))


def _refilled(shape: Column, new: Column, what: str = "^[0-9]$") -> Column:
    """``shape`` with its digits, or what else is asked for, replaced by the characters of ``new``, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        taken = c.rlike(what)
        return F.struct(F.concat(s["out"], F.when(taken, F.substring(new, s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(taken, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """Luhn sum; ``doubled_first`` tells whether the first digit is one of those that count double."""

    def step(s: Column, c: Column) -> Column:
        d = c.cast("int")
        return F.struct((s["sum"] + F.when(s["two"], F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)).alias("sum"), (~s["two"]).alias("two"))

    return F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.struct(F.lit(0).alias("sum"), doubled_first.alias("two")), step, lambda s: s["sum"])


def _mod97(text: Column) -> Column:
    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _email(key: str, m: Column) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_chars(key, "email", F.substring(m, F.lit(1), at - 1)), F.substring(m, at, F.length(m)))


def _phone(key: str, m: Column) -> Column:
    head = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)
    tail = F.substring(m, F.length(head) + 1, F.length(m))
    return F.concat(head, _refilled(tail, permute_digits(key, "phone", F.regexp_replace(tail, r"\D", ""))))


def _ip(key: str, m: Column) -> Column:
    part = lambda i: F.split(m, r"\.")[i].cast("long")
    # bound once by a one-element array: a lambda's variable is computed once
    done = F.array(_permute(key, "ip", part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(1 << 16), F.lit(1 << 16)))
    return F.transform(done, lambda s: F.concat_ws(".", *[F.floor(s[h] / d).cast("int") % 256 for h in "lr" for d in (256, 1)]))[0]


def _date(key: str, m: Column) -> Column:
    """A date of the years 1900 to 2099 as another, each field as wide as it was.

    Days up to the 12th, from 13th to 28th, 29th and 30th, 31st and leap days are permuted on their own. So what
    can be read in two ways (day first) stays so, and a string with the month first never meets one with the day first.
    """
    sep = F.regexp_extract(m, r"\D", 0)
    year_first = m.rlike(r"^\d{4}")
    f = F.split(m, r"[./-]")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    iso = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, pad(mo), pad(d)), "yyyy-MM-dd")
    day_first = iso(f[2], f[1], f[0])
    read = F.when(year_first, iso(f[0], f[1], f[2])).otherwise(F.coalesce(day_first, iso(f[2], f[0], f[1])))

    def permuted(date: Column) -> Column:
        year, month, day = F.year(date) - 1900, F.month(date), F.day(date)
        part = F.when(day <= 12, 0).when(day <= 28, 1).when((day < 31) & (month != 2), 2).when(day == 31, 3).otherwise(4)
        # of the leap days 49 years, else the year and the day's place among those of its part in a year
        leap = F.floor((year - 4) / 4)
        places = [(month - 1) * 12 + day - 1, (month - 1) * 16 + day - 13, F.when(month == 1, 0).otherwise(month - 2) * 2 + day - 29, F.floor((month + F.when(month > 7, 1).otherwise(0)) / 2), leap % 7]
        of = lambda values: F.element_at(F.array(*[F.lit(v) if isinstance(v, int) else v.cast("int") for v in values]), part + 1)
        moved = _permute(key, "date", F.when(part == 4, F.floor(leap / 7)).otherwise(year), of(places), F.when(part == 4, 7).otherwise(200), of([144, 192, 22, 7, 7]), part)
        return F.struct(moved.alias("to"), part.alias("part"))

    def shown(s: Column) -> Column:
        part, left, right = s["part"], s["to"]["l"], s["to"]["r"]
        pick = lambda *values: F.element_at(F.array(*[v.cast("int") for v in values]), part + 1)
        year = F.when(part == 4, 1904 + 4 * (left * 7 + right)).otherwise(1900 + left)
        third = F.floor(right / 2)
        month = pick(F.floor(right / 12) + 1, F.floor(right / 16) + 1, F.when(third == 0, 1).otherwise(third + 2), F.when(right < 4, 2 * right + 1).otherwise(2 * right), F.lit(2))
        day = pick(right % 12 + 1, right % 16 + 13, right % 2 + 29, F.lit(31), F.lit(29))
        return F.struct(year.cast("string").alias("y"), month.alias("m"), day.alias("d"))

    def field(value: Column, own: Column, other: Column) -> Column:
        bare = (F.length(own) == 1) | ((F.length(other) == 1) & ~own.startswith("0"))
        return F.when(bare, value.cast("string")).otherwise(pad(value))

    def written(n: Column) -> Column:
        first, second = F.when(day_first.isNotNull(), n["d"]).otherwise(n["m"]), F.when(day_first.isNotNull(), n["m"]).otherwise(n["d"])
        return F.when(year_first, F.concat_ws("-", n["y"], pad(n["m"]), pad(n["d"]))).otherwise(F.concat_ws("-", field(first, f[0], f[1]), field(second, f[1], f[0]), n["y"]))

    # a lambda's variable is computed once
    dates = F.filter(F.array(read), lambda d: d.isNotNull() & F.year(d).between(1900, 2099))
    return F.replace(F.get(F.transform(F.transform(F.transform(dates, permuted), shown), written), F.lit(0)), F.lit("-"), sep)


def _ssn(key: str, m: Column) -> Column:
    area, rest = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int") * 10000 + F.substring(m, 8, 4).cast("int")
    group, serial = F.floor(rest / 10000), rest % 10000
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    # 898 areas, 99 groups, 9999 serials
    left = area - F.when(area > 666, 2).otherwise(1)
    done = F.array(_permute(key, "ssn", left, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999)))
    show = F.transform(done, lambda s: F.format_string("%03d-%02d-%04d", s["l"] + F.when(s["l"] >= 665, 2).otherwise(1), F.floor(s["r"] / 9999) + 1, s["r"] % 9999 + 1))[0]
    return F.when(valid, show)


def _iban(key: str, m: Column) -> Column:
    """The pseudonym of ``m``; where the country's length is not known, of its longest valid start that ends with a token, and the rest as it is."""
    plain = lambda c: F.regexp_replace(c, " ", "")
    valid = lambda c: (F.length(c) >= 12) & (_mod97(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))) == 1)
    tokens = F.split(m, " ")
    starts = F.transform(F.reverse(F.sequence(F.lit(1), F.size(tokens))), lambda n: F.array_join(F.slice(tokens, F.lit(1), n), " "))
    starts = F.when(F.substring(m, 1, 2).isin(" ".join(_IBAN_COUNTRIES.values()).split()), F.array(m)).otherwise(starts)

    def made(old: Column) -> Column:
        flat = plain(old)
        body = F.array(permute_chars(key, "iban", F.substring(flat, F.lit(5), F.length(flat))))
        new = F.transform(body, lambda b: F.concat(F.substring(flat, 1, 2), F.lpad((98 - _mod97(F.concat(b, F.substring(flat, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b))
        spaced = F.transform(new, lambda n: _refilled(old, n, "^[^ ]$"))[0]
        return F.concat(spaced, F.substring(m, F.length(old) + 1, F.length(m)))

    return F.get(F.transform(F.slice(F.filter(starts, lambda c: valid(plain(c))), 1, 1), made), F.lit(0))


def _card(key: str, m: Column) -> Column:
    digits = F.regexp_replace(m, r"\D", "")
    size = F.length(digits)
    odd = size % 2 == 0
    valid = luhn_sum(digits, odd) % 10 == 0
    body = F.array(permute_digits(key, "card", F.substring(digits, F.lit(1), size - 1)))
    full = F.transform(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, odd), F.lit(10)).cast("string")))
    return F.when(valid, F.transform(full, lambda d: _refilled(m, d))[0])


def kind_of(m: Column) -> Column:
    """Which format a match has."""
    found = F.when(m.contains("@"), "email").when(m.startswith("+"), "phone")
    for kind, pattern in (("ip", rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), ("date", r"^(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})$"), ("ssn", r"^\d{3}-\d{2}-\d{4}$"), ("iban", "^[A-Z]")):
        found = found.when(m.rlike(pattern), kind)
    return found.otherwise("card")


def pseudonyms(docs: DataFrame, key: str, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with the personal values of ``text`` replaced, and ``out``: their number by kind.

    Null texts stay null with no values; empty and very long texts are handled whole. Other columns are
    untouched, whatever their names; one already named as ``out`` is replaced. Rows are independent of one another:
    there is no shuffle. Emails keep their host and the punctuation of the local part; phones their country code
    (one digit, where nothing parts it); dates outside 1900 to 2099 stay. Dates that are equal as read become equal
    dates, in whatever form they are written.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    makers = {"email": _email, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "iban": _iban, "card": _card}
    found, new, kinds = (unused(docs, name) for name in ("_found", "_new", "_kinds"))

    def made(pair: Column) -> Column:
        value = F.lit(None).cast("string")
        for kind, make in makers.items():
            value = F.when(pair["kind"] == kind, make(key, pair["old"])).otherwise(value)
        return F.struct(pair["kind"].alias("kind"), pair["old"].alias("old"), value.alias("new"))

    matches = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # explicit steps, so that each is computed once
    marked = docs.drop(out).withColumn(found, matches)
    named = F.transform(F.transform(found, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("old"))), made)
    swapped = marked.withColumn(new, F.when(F.size(found) > 0, named))
    rest = F.split(text, _ANY, -1)
    parts = F.zip_with(rest, new, lambda a, b: F.concat(a, F.coalesce(b["new"], b["old"], F.lit(""))))
    valid = F.filter(F.coalesce(new, F.array().cast(swapped.schema[new].dataType)), lambda x: x["new"].isNotNull())
    counted = swapped.withColumn(kinds, F.transform(valid, lambda x: x["kind"]))
    number = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*[F.size(F.filter(kinds, (lambda kind: lambda x: x == kind)(k))) for k in KINDS]))
    changed = F.when(F.size(kinds) > 0, F.array_join(parts, "")).otherwise(F.col(text_col))
    return counted.withColumn(out, number).withColumn(text_col, changed).drop(found, new, kinds)
