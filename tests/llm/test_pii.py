import datetime
import hashlib
import ipaddress
import re

import pytest
from pyspark.sql import functions as F

from marginalia.llm import pii

KEY = "k"


def rounds(kind, left, right, a, b, part=0):
    for i in range(8):
        turn = hashlib.sha256(f"{KEY}|{kind}|{i}".encode()).hexdigest()
        h = int(hashlib.sha256(f"{turn}|{part}|{right}".encode()).hexdigest()[:15], 16)
        left, right, a, b = right, (left + h) % a, b, a
    return left, right


def brute_digits(kind, digits):
    n, h = len(digits), len(digits) // 2
    left, right = rounds(kind, int(digits[:h]), int(digits[h:]), 10**h, 10 ** (n - h), n)
    return f"{left:0{h}}{right:0{n - h}}"


def brute_chars(kind, value):
    half = -(-len(value) // 2)
    left, right = value[:half], value[half:]
    for i in range(8):
        turn = hashlib.sha256(f"{KEY}|{kind}|{i}".encode()).hexdigest()
        out = ""
        for at, c in enumerate(left):
            h = int(hashlib.sha256(f"{turn}|{at}|{right}".encode()).hexdigest()[:15], 16)
            for first, n in ("09", "az", "AZ"):
                if first <= c <= n:
                    c = chr(ord(first) + (ord(c) - ord(first) + h) % (ord(n) - ord(first) + 1))
                    break
            out += c
        left, right = right, out
    return left + right


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def brute_iban(value):
    flat = value.replace(" ", "")
    body = brute_chars("iban", flat[4:])
    new = iter(f"{flat[:2]}{98 - mod97(f'{flat[:2]}00{body}'):02}{body}")
    return "".join(c if c == " " else next(new) for c in value)


def brute_ssn(value):
    area, group, serial = map(int, value.split("-"))
    areas = [a for a in range(1, 900) if a != 666]
    left, right = rounds("ssn", areas.index(area), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    return f"{areas[left]:03}-{right // 9999 + 1:02}-{right % 9999 + 1:04}"


def brute_day(day):
    """The day that a day becomes: by its place in a list of its part's days of a year."""
    leap = datetime.date(2000, 1, 1)
    year = [leap + datetime.timedelta(i) for i in range(366)]
    part = 4 if (day.month, day.day) == (2, 29) else 0 if day.day <= 12 else 1 if day.day <= 28 else 2 if day.day < 31 else 3
    if part == 4:
        left, right = rounds("date", *divmod((day.year - 1904) // 4, 7), 7, 7, 4)
        return datetime.date(1904 + 4 * (left * 7 + right), 2, 29)
    days = [(d.month, d.day) for d in year if (d.day <= 12, 13 <= d.day <= 28, 29 <= d.day <= 30 and d.month != 2, d.day == 31)[part]]
    left, right = rounds("date", day.year - 1900, days.index((day.month, day.day)), 200, len(days), part)
    return datetime.date(1900 + left, *days[right])


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10


def brute_card(m):
    digits = re.sub(r"\D", "", m)
    if luhn(digits):
        return m
    body = brute_digits("card", digits[:-1])
    new = iter(body + next(str(c) for c in range(10) if luhn(body + str(c)) == 0))
    return "".join(next(new) if c.isdigit() else c for c in m)


def replaced(spark, *values):
    rows = pii.pseudonyms(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string"), KEY).collect()
    return [r.text for r in sorted(rows)]


def test_cards_match_brute_force(spark):
    body = [f"{x:015}" for x in range(41111111111111, 41111111111111 + 40)]
    cards = [b + next(str(c) for c in range(10) if luhn(b + str(c)) == 0) for b in body]
    cards += ["4417 7442 8035 1547", "4417-7442-8035-1547", "4417744280351548", "378282246310005", "3782 822463 10005"]
    got = replaced(spark, *[f"({c})." for c in cards])
    assert got == [f"({brute_card(c)})." for c in cards]
    assert len(set(got)) == len(cards) and all(luhn(re.sub(r"\D", "", g)) == 0 for g, c in zip(got, cards, strict=True) if not luhn(re.sub(r"\D", "", c)))


def test_addresses_and_phones_match_brute_force(spark):
    ip = ipaddress.ip_address("192.168.7.1")
    left, right = rounds("ip", int(ip) >> 16, int(ip) & 65535, 65536, 65536)
    tail = iter(brute_digits("phone", "2435555526"))
    phone = "+1 " + "".join(next(tail) if c == "0" else c for c in "(000) 000-0000")
    assert replaced(spark, "at 192.168.7.1, x", "+1 (243) 555-5526%%%") == [f"at {ipaddress.ip_address(left << 16 | right)}, x", f"{phone}%%%"]


def test_dates_stay_dates_of_their_form(spark):
    new = brute_day(datetime.date(2021, 2, 28))
    got = replaced(spark, "2021-02-28", "2021/02/28", "28.02.2021", "28.2.2021", "02/28/2021", "2/28/2021", "2021-02-30", "1850-01-01", "2021-02-28-1")
    assert got == [f"{new}", f"{new:%Y/%m/%d}", f"{new:%d.%m.%Y}", f"{new.day}.{new.month}.{new.year}", f"{new:%m/%d/%Y}", f"{new.month}/{new.day}/{new.year}", "2021-02-30", "1850-01-01", "2021-02-28-1"]
    new = brute_day(datetime.date(2020, 4, 3))
    assert replaced(spark, "3/04/2020", "03/04/2020", "3/4/2020") == [f"{new.day}/{new.month:02}/{new.year}", f"{new:%d/%m/%Y}", f"{new.day}/{new.month}/{new.year}"]


@pytest.mark.parametrize("form", ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y"])
def test_all_days_of_some_years_match_brute_force(spark, form):
    days = [datetime.date(1999, 1, 1) + datetime.timedelta(i) for i in range(1100)]
    # month first only where it cannot be read day first
    days = [d for d in days if form[1] != "m" or d.day > 12]
    assert replaced(spark, *[d.strftime(form) for d in days]) == [brute_day(d).strftime(form) for d in days]


def test_dates_of_both_readings_stay_apart(spark):
    days = [datetime.date(2019, 1, 1) + datetime.timedelta(i) for i in range(4 * 366)]
    values = sorted({d.strftime(f) for d in days for f in ("%d/%m/%Y", "%m/%d/%Y")})
    got = replaced(spark, *values)
    assert len(set(got)) == len(values) and all(int(g[:2]) <= 12 or int(g[3:5]) <= 12 for g in got)
    assert sum(int(g[3:5]) > 12 for g in got) == sum(int(v[3:5]) > 12 for v in values)


def test_numbers_and_addresses_match_brute_force(spark):
    ssns = ["001-01-0001", "899-99-9999", "665-10-1234", "667-10-1234"]
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NL91 ABNA 0417 1643 00", "NO93 86011117947"]
    mails = ["joe.Ann-12@x.org", "a@b.example.com", "Zz9_%+x@q.io"]
    assert all(mod97(i.replace(" ", "")) == 1 for i in ibans)
    assert replaced(spark, *ssns) == [brute_ssn(v) for v in ssns]
    assert replaced(spark, *ibans) == [brute_iban(v) for v in ibans]
    assert replaced(spark, *mails) == [brute_chars("email", v.split("@")[0]) + v[v.index("@") :] for v in mails]


def test_the_secret_is_in_no_plan(spark, capsys):
    done = pii.pseudonyms(spark.createDataFrame([("4417744280351547",)], "text string"), "hush-hush-key")
    done.explain("extended")
    assert "hush-hush-key" not in capsys.readouterr().out
    with pytest.raises(ValueError, match="secret key"):
        pii.secret(spark)
    with pytest.warns(UserWarning, match="published"):
        assert pii.secret(spark, otherwise=pii.TEST_KEY) == pii.TEST_KEY


def test_permutations_are_one_to_one(spark):
    days = [str(datetime.date(1999, 1, 1) + datetime.timedelta(i)) for i in range(700)]
    phones = [f"+49 {i:04} 55512" for i in range(700)]
    for values in (days, phones, [f"12{i % 10}-45-{1000 + i}" for i in range(300)], [f"a{i}.b@x.org" for i in range(300)]):
        got = replaced(spark, *values)
        assert len(set(got)) == len(values) and [re.sub(r"\d", "0", re.sub("[a-z]", "a", g)) for g in got] == [re.sub(r"\d", "0", re.sub("[a-z]", "a", v)) for v in values]


def test_iban_and_email_keep_their_form(spark):
    def mod(s):
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97

    (got,) = replaced(spark, "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 not DE89 3704 0044 0532 0130 01")
    one, two, three = re.split(" and | not ", got)
    assert mod(one.replace(" ", "")) == mod(two) == 1 and one[:2] == "DE" and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", two) and three.startswith("DE89 3704")
    (mail,) = replaced(spark, "<joé.Ann-12@Mail8.example.com>")
    assert re.fullmatch(r"<[a-z]{2}é\.[A-Z][a-z]{2}-\d\d@Mail8\.example\.com>", mail) and "joé" not in mail


def test_ibans_before_other_tokens(spark):
    ibans = ["ES9121000418450200051332", "AT611904300234573201", "BE68 5390 0754 7034", "NO93 8601 1117 947"]
    rests = [" EUR 50", " 2024", " BIC X", " 4417 7442 8035 1547", " AT61 1904 3002 3457 3201"]
    # of a country whose length is not known
    pairs = [(i, r) for i in ibans for r in rests] + [("XY04 5390 0754 7034", r) for r in rests[:3]]
    alone, got, other = (replaced(spark, *values) for values in zip(*((i, i + r, r) for i, r in pairs), strict=True))
    for (iban, _), a, both, o in zip(pairs, alone, got, other, strict=True):
        flat = a.replace(" ", "")
        assert a != iban and both == a + o and a[:2] == iban[:2] and len(a) == len(iban)
        assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def test_equal_values_stay_linked_and_keys_matter(spark):
    a, b = replaced(spark, "x 4417744280351547", "4417744280351547 y 10.0.0.1")
    assert a.split()[1] == b.split()[0]
    other = pii.pseudonyms(spark.createDataFrame([("4417744280351547",)], "text string"), "other").first().text
    assert other != b.split()[0]


@pytest.mark.parametrize("text", [None, "", "plain words", "v1.2.3.4 and 1.2.3.4.5, 300.1.1.1", "room 4417 7442", "12345678901234567890", "1-2-3 a@b 2021-13-01", "000-12-3456 no"])
def test_other_text_is_left_alone(spark, text):
    (row,) = pii.pseudonyms(spark.createDataFrame([(text,)], "text string"), KEY).collect()
    assert row.text == text and not any(row.pii.values())


def test_defined_on_odd_tables(docs_of):
    assert pii.pseudonyms(docs_of([]), KEY).count() == 0
    long = "words " * 300_000 + "10.1.2.3" + "9" * 100_000
    odd = docs_of([(1, "10.1.2.3 10.1.2.3"), (1, "10.1.2.3 10.1.2.3"), (None, long)]).withColumn("pii", F.lit(3)).withColumn("kind", F.lit("q")).withColumn("_found", F.lit(1)).withColumn("_NEW", F.lit(2))
    got = sorted(pii.pseudonyms(odd, KEY).collect(), key=lambda r: len(r.text))
    assert got[0].text == got[1].text and got[0].pii["ip"] == 2 and len(set(got[0].text.split())) == 1 and got[0].kind == "q" and (got[0]._found, got[0]._NEW) == (1, 2)
    assert got[2].text == long and got[2].n_chars == len(long)
